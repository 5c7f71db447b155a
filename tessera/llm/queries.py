"""The training-data operators as queries over whole tables, with SQL where it can express them."""

from __future__ import annotations

from .collocations import OP11_SQL, op11_collocations
from .exact_dedup import OP6_SQL, op6_exact_dedup
from .licences import op9_licences
from .lsh_forest import op13_lsh_forest
from .packing import op1_packing
from .pii import op5_pii
from .quality import op4_quality_rules
from .ranked_search import OP12_SQL, op12_ranked_search
from .repeats import op2_suffix_dedup
from .sentencepieces import op7_sentencepiece
from .sharding import op3_sharding
from .simhash import op10_simhash
from .token_counts import op8_token_counts

QUERIES = {
    f.__name__: f
    for f in (op1_packing, op2_suffix_dedup, op3_sharding, op4_quality_rules, op5_pii, op6_exact_dedup, op7_sentencepiece, op8_token_counts, op9_licences, op10_simhash, op11_collocations, op12_ranked_search, op13_lsh_forest)
}
ORACLE_SQL = {"op6_exact_dedup": OP6_SQL, "op11_collocations": OP11_SQL, "op12_ranked_search": OP12_SQL}
