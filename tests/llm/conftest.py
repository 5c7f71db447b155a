import numpy as np
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kind int, sha string, fp long, part string"


def frame(spark, rows):
    """Documents with extra columns whose names clash with the operators' own; rows are (id, text)."""
    return spark.createDataFrame([(i, t, "en", None, None if t is None else len(t), 1, "x", 2, None) for i, t in rows], SCHEMA)


@pytest.fixture(scope="session")
def docs_of(spark):
    return lambda rows: frame(spark, rows)


@pytest.fixture(scope="session")
def corpus():
    """Invented prose with copies, near copies, shared passages, odd white space, nulls and repeated rows."""
    rng = np.random.default_rng(7)
    stem = ["".join(rng.choice(list("abcdeéfgîlmnoprst"), rng.integers(2, 8))) for _ in range(600)]
    prose = lambda n: " ".join(rng.choice(stem, n))
    base = [prose(int(n)) for n in rng.integers(1, 400, 60)]
    passage = prose(80)
    rows = list(enumerate(base))
    rows += [(100 + i, base[i].replace(" ", "  ", 2)) for i in range(8)]
    rows += [(200 + i, base[i] + " zz") for i in range(8)]
    rows += [(300 + i, base[20 + i] + "\n" + passage + "\n" + prose(30)) for i in range(6)]
    rows += [(400, ""), (401, None), (402, " \t\n"), (403, "one"), (404, "One two\tthree"), (405, "A\r\nB\x0bC\x0cD E  \n\nF "), (None, base[3]), (None, None), (7, base[7]), (7, base[7])]
    rows += [(500, prose(20_000)), (501, "x" * 50_000), (502, "rep rep rep " * 300), (503, "emoji 😀 ▁ x▁y <|endoftext|> </s> tab\there")]
    return rows
