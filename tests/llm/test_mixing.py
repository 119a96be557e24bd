from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tests.llm.oracle import duck, spark_rows
from tidemark.llm import mixing


def test_query_against_sql(spark):
    for sf in ("0.001", "0.01"):
        d = f"/root/testdata/sf{sf}"
        assert spark_rows(mixing.op6_mixing(spark, d)) == duck(d, mixing.ORACLE)


def fill(budget, children):
    """Shares by the definition: raise the level until the budget is used. children: {name: (weight, room)}."""
    shares, still, left = {}, dict(children), Fraction(budget)
    while still:
        level = left / sum(w for w, _ in still.values())
        full = [n for n, (w, room) in still.items() if room <= level * w]
        if not full:
            return shares | {n: int(level * w) for n, (w, _) in still.items()}
        for n in full:
            shares[n] = still.pop(n)[1]
            left -= shares[n]
    return shares


def test_shortages_go_to_siblings_first(spark):
    rooms = {("a", "x"): 100, ("a", "y"): 1000, ("b", "x"): 5000, ("b", "y"): 10}
    leaves = spark.createDataFrame([(*k, v) for k, v in rooms.items()], "l0 string, l1 string, tokens long")
    weights = ({"a": 50, "b": 50}, {"x": 70, "y": 30})
    for budget in (0, 50, 999, 1500, 4000, 10**6):
        got = {(r.l0, r.l1): r.share for r in mixing.allocate(leaves, 2, weights, F.lit(budget).cast("long"), 1).collect()}
        top = fill(min(budget, 6110), {k: (50, sum(v for (p, _), v in rooms.items() if p == k)) for k in "ab"})
        expected = {(p, c): s for p in "ab" for c, s in fill(top[p], {c: (weights[1][c], rooms[p, c]) for c in "xy"}).items()}
        assert got == expected


def test_edges(spark):
    rows = [(1, "a b c", "en", None), (1, "a b c", "en", None), (2, None, None, "s"), (3, "", "en", "s"), (None, "w " * 40_000, "en", "s"), (4, "one", "en", "t")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, source string, copies string, l0 int")
    for broadcast in (0, 100):
        got = mixing.mix(df, [F.col("lang"), F.col("source")], [{}, {}], 100, 1, leaves_broadcast=broadcast)
        assert got.columns == [*df.columns, "n_tokens", "copies_"] and got.count() == len(rows)
        assert sorted((r.n_tokens, r.copies_) for r in got.collect()) == [(0, 0), (0, 1), (1, 1), (3, 1), (3, 1), (40_000, 1)]
    assert mixing.mix(df.limit(0), [F.col("lang")], [{}], 50, 1).count() == 0


@pytest.mark.parametrize("percent", [1, 37, 100, 150, 400])
def test_budget_is_met(spark, percent):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = mixing.mix(docs, [F.col("source")], [{}], percent, 3).agg(F.sum(F.col("n_tokens") * F.col("copies")), F.sum("n_tokens"), F.max("copies")).first()
    assert got[0] <= got[1] * percent // 100 and got[2] <= 3
