"""tessera: a PySpark-native engine for paired XML/JSON corpora and training-data preparation."""
