from random import Random

import pytest
from pyspark.sql import functions as F

from tessera.operators import curation as U
from tessera.operators import selection as S


@pytest.mark.parametrize(("ranked", "keys"), [(100_000, "small"), (1, "small"), (5, "wide"), (3, "same")])
def test_first_rows_are_exact(spark, ranked, keys):
    rng = Random(ranked)
    key = {"small": lambda: rng.randint(0, 40), "wide": lambda: rng.choice([-(1 << 63), (1 << 63) - 1, rng.randint(-(1 << 62), 1 << 62), 0, -1]), "same": lambda: 7}[keys]
    rows = [(rng.choice("abcd") if i else "lone", key(), rng.choice("xyz")) for i in range(400)]
    wanted = {"a": 13, "b": 0, "c": 10_000, "lone": 1, "nowhere": 4}
    frame = spark.createDataFrame(rows, "g string, k long, t string").repartition(5)
    asked = spark.createDataFrame(list(wanted.items()), "_g string, _want long")
    got = [tuple(r) for r in S.first_rows(frame, F.col("g"), asked, F.col("k"), [F.col("t")], "s", ranked).collect()]
    assert sorted(r[:3] for r in got) == sorted(rows)
    for g in "abcd":
        own = sorted((k, t) for h, k, t in rows if h == g)
        assert sorted((k, t) for h, k, t, s in got if h == g and s) == own[: wanted.get(g, 0)]
    assert [s for h, _, _, s in got if h == "lone"] == [True]


def test_empty_and_null(spark):
    frame = spark.createDataFrame([("a", 1), (None, 2)], "g string, k long")
    asked = spark.createDataFrame([("a", 1)], "_g string, _want long")
    assert sorted((r.k, r.s) for r in S.first_rows(frame, F.col("g"), asked, F.col("k"), [], "s").collect()) == [(1, True), (2, False)]
    assert S.first_rows(frame.limit(0), F.col("g"), asked, F.col("k"), [], "s").count() == 0


@pytest.mark.parametrize("kind", ["long", "string"])
def test_hints_with_repeated_ids(spark, kind):
    rows = [(1, 0), (1, 0), (1, 0), *((i, i % 2) for i in range(2, 9))]
    frame = spark.createDataFrame([(i if kind == "long" else f"id-{i}", c) for i, c in rows], f"ex_id {kind}, complexity int")
    leaked = [r.ex_id for r in U.hint_leak(frame, 0.1).filter("leaked").collect()]
    assert leaked == ([1] if kind == "long" else ["id-1"])
    assert U.hint_leak(frame, 0.7).filter("leaked").groupBy("complexity").count().orderBy("complexity").first()["count"] == 7
    assert U.hint_leak(frame, 0.7).filter("leaked").count() == 7


def test_quotas_take_the_largest_remainders(spark):
    rng = Random(2)
    sizes = {f"s{i}": rng.randint(1, 30) for i in range(40)}
    frame = spark.createDataFrame([(s,) for s, n in sizes.items() for _ in range(n)], "stratum string")
    total, tests = sum(sizes.values()), 97
    whole = {s: tests * n // total for s, n in sizes.items()}
    for s in sorted(sizes, key=lambda s: (-(tests * sizes[s] % total), s))[: tests - sum(whole.values())]:
        whole[s] += 1
    assert {r.stratum: r.quota for r in U.quotas(frame, tests).collect()} == whole


@pytest.mark.parametrize("count", [1, 2, 3, 5, 64, 65, 1000, 4097])
def test_permutation_is_a_bijection(spark, count):
    places = [r.p for r in spark.range(count).select(S.permuted(F.col("id"), count, 7).alias("p")).collect()]
    assert sorted(places) == list(range(count))
    if count > 60:
        assert sum(abs(p - i) for i, p in enumerate(places)) > count * count / 5
        assert places != [r.p for r in spark.range(count).select(S.permuted(F.col("id"), count, 8).alias("p")).collect()]


def test_shuffle_doesnt_depend_on_partitions(spark):
    frame = spark.createDataFrame([(i * 7 % 501, "abc"[i % 3]) for i in range(500)], "id long, block string")
    one, many = ({r.id: r.place for r in S.shuffled(frame.repartition(n), "id").collect()} for n in (1, 9))
    assert one == many and sorted(one.values()) == list(range(500))
    blocks = sorted((r.place, r.block) for r in S.shuffled(frame.repartition(3), "id", blocks="block", first=["b", "a"]).collect())
    assert [b for _, b in blocks] == ["b"] * 167 + ["a"] * 167 + ["c"] * 166 and [p for p, _ in blocks] == list(range(500))
    inner = [r.id for r in S.shuffled(frame, "id", blocks="block").filter("block = 'a'").orderBy("place").collect()]
    assert inner != sorted(inner)
