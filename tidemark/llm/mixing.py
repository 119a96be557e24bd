"""Mixing sources to target weights by hierarchical budgeting, with DataFrame operations only.

Documents are the leaves' content of a tree (by default domain, language, source). A budget of tokens flows
from the root: at every node it is shared among the children by their weights, no child getting more than its subtree
holds (tokens times epochs); what a child cannot take goes to its siblings, and only what a whole
family cannot take is left to the relatives of its parent. Each leaf then takes whole epochs of its documents as
often as its share holds, and of one more epoch, in an order seeded by epoch and document, the longest prefix of
documents that fits.

The prefix of a leaf of any size is found by bounded steps: token sums by the first 10 bits of the order's hash,
then by the next 10 bits inside the bucket where the budget ends, and only documents of that small part are
put in order. Rows with the same id are taken or left together.

Null levels count as ''. Null and empty texts have no tokens; they go with the epochs of their leaf, and a leaf
without any token is not taken. Repeated rows count each. Empty tables give empty ones. Extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import checkpointed, fresh, table

TOKEN = r"[^\x20\x09-\x0D]+"
LEAVES_BROADCAST = 100_000
"""A table of leaves of at most so many rows is broadcast; a larger one is joined by its key."""


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("long")


def _weight(level: Column, weights: Mapping[str, int], default: int) -> Column:
    out = F.lit(default)
    for value, weight in weights.items():
        out = F.when(level == value, weight).otherwise(out)
    return out.cast("long")


def allocate(leaves: DataFrame, levels: int, weights: Sequence[Mapping[str, int]], budget: Column, epochs: int, default: int = 1) -> DataFrame:
    """The leaves (l0.., tokens) with `share`, the tokens each one gets. Weights are whole numbers; shares round down.

    Children saturate in order of room over weight: child k does if the room of those before it and, at its
    own rate, the weights from it on fit the parent's share.
    """
    names = [f"l{i}" for i in range(levels)]
    now = leaves.select(*names, "tokens", (F.col("tokens") * epochs).alias("room"))
    now = now.crossJoin(F.broadcast(now.agg(F.least(budget, F.sum("room")).alias("share"))))
    for depth in range(levels):
        parent, key = names[:depth], names[: depth + 1]
        nodes = now.groupBy(*key).agg(F.sum("room").alias("node_room"), F.first("share").alias("family_share")).withColumn("weight", _weight(F.col(names[depth]), weights[depth], default))
        family = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
        order = family.orderBy(F.col("node_room") / F.col("weight"), names[depth])
        before = order.rowsBetween(Window.unboundedPreceding, -1)
        nodes = nodes.withColumn("room_before", F.coalesce(F.sum("node_room").over(before), F.lit(0))).withColumn("weight_from", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
        nodes = nodes.withColumn("full", F.col("room_before") * F.col("weight") + F.col("node_room") * F.col("weight_from") <= F.col("family_share") * F.col("weight"))
        spare = F.col("family_share") - F.coalesce(F.sum(F.when(F.col("full"), F.col("node_room"))).over(family), F.lit(0))
        open_weight = F.sum(F.when(~F.col("full"), F.col("weight"))).over(family)
        nodes = nodes.withColumn("spare", spare).withColumn("open_weight", open_weight)
        nodes = nodes.select(*key, F.when(F.col("full"), F.col("node_room")).otherwise(F.expr("(spare * weight) div open_weight")).alias("share"))
        now = now.drop("share").join(nodes, key)
    return now.drop("room")


def _order(seed: int, epoch: Column, id_column: Column) -> Column:
    return F.md5(F.concat_ws("-", F.lit(str(seed)), epoch.cast("string"), F.coalesce(id_column.cast("string"), F.lit(""))))


def _high(order: Column) -> Column:
    """The order's first 20 bits."""
    return F.conv(F.substring(order, 1, 5), 16, 10).cast("int")


def _boundary(sums: DataFrame, key: Sequence[str], bucket: str) -> DataFrame:
    """For each leaf, the bucket in which its remainder ends, and the remainder left for that bucket."""
    upto = Window.partitionBy(*key).orderBy(bucket).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = sums.withColumn("upto", F.sum("bucket_tokens").over(upto)).filter(F.col("upto") > F.col("rest"))
    first = summed.groupBy(*key).agg(F.min(F.struct(bucket, (F.col("rest") - F.col("upto") + F.col("bucket_tokens")).alias("rest"))).alias("at"))
    return first.select(*key, F.col(f"at.{bucket}").alias(bucket), F.col("at.rest").alias("rest"))


def mix(
    docs: DataFrame,
    levels: Sequence[Column],
    weights: Sequence[Mapping[str, int]],
    budget_percent: int,
    epochs: int,
    seed: int = 1,
    id_column: str = "doc_id",
    text: str = "text",
    leaves_broadcast: int = LEAVES_BROADCAST,
) -> DataFrame:
    """docs with `n_tokens` and `copies`: how often each document is in the mixture (0: not).

    The budget is a percentage of all tokens.
    """
    n_tokens, copies = fresh(docs, "n_tokens", "copies")
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    names = [f"l{i}" for i in range(len(levels))]
    # No name of docs can clash with those used here.
    rows = docs.select(*(F.coalesce(level.cast("string"), F.lit("")).alias(n) for level, n in zip(levels, names)), *(docs[f"`{c}`"].alias(at[c]) for c in docs.columns))
    rows = rows.withColumns({"id": F.col(at[id_column]), "tokens": token_count(F.col(at[text]))})
    slim = checkpointed(rows.select(*names, "id", "tokens"))
    leaves = checkpointed(slim.groupBy(*names).agg(F.sum("tokens").alias("tokens")))
    total = slim.agg(F.sum("tokens")).first()[0] or 0
    shared = allocate(leaves, len(levels), weights, F.lit(total * budget_percent // 100).cast("long"), epochs)
    shared = checkpointed(
        shared.withColumn("epochs_full", F.when(F.col("tokens") > 0, F.expr("share div tokens")).otherwise(0))
        .withColumn("rest", F.col("share") - F.col("epochs_full") * F.col("tokens"))
        .select(*names, "epochs_full", "rest")
    )
    few = shared.count() <= leaves_broadcast
    hint = F.broadcast if few else lambda df: df

    ordered = slim.join(hint(shared.filter("rest > 0")), names).withColumn("order", _order(seed, F.col("epochs_full"), F.col("id"))).withColumn("high", _high(F.col("order"))).withColumns({"b1": F.expr("high >> 10"), "b2": F.expr("high & 1023")})
    first = _boundary(ordered.groupBy(*names, "b1").agg(F.first("rest").alias("rest"), F.sum("tokens").alias("bucket_tokens")), names, "b1")
    inside = ordered.drop("rest").join(hint(first), [*names, "b1"])
    second = _boundary(inside.groupBy(*names, "b1", "b2").agg(F.first("rest").alias("rest"), F.sum("tokens").alias("bucket_tokens")), [*names, "b1"], "b2")
    last = inside.drop("rest").join(hint(second), [*names, "b1", "b2"]).groupBy(*names, "high", "order").agg(F.first("rest").alias("rest"), F.sum("tokens").alias("tokens"))
    upto = Window.partitionBy(*names, "high").orderBy("order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    taken = last.withColumn("upto", F.sum("tokens").over(upto)).filter("upto <= rest").groupBy(*names).agg(F.max("order").alias("end"))
    ends = second.select(*names, (F.col("b1") * 1024 + F.col("b2")).alias("end_high")).join(taken, names, "left")
    decided = checkpointed(shared.join(ends, names, "left"))

    order = _order(seed, F.col("epochs_full"), F.col("id"))
    part = F.coalesce((_high(order) < F.col("end_high")) | ((_high(order) == F.col("end_high")) & (order <= F.col("end"))), F.lit(False))
    out = rows.join(hint(decided), names).withColumn("copies", F.col("epochs_full") + part.cast("long"))
    return out.select(*at.values(), "tokens", "copies").toDF(*docs.columns, n_tokens, copies)


DOMAIN = "concat('d', cast(ascii(right(coalesce(source, ''), 1)) % 3 as string))"
WEIGHTS = ({"d0": 50, "d1": 30, "d2": 20}, {"en": 55, "de": 20, "fr": 15, "es": 10}, {"src0": 3})
BUDGET_PERCENT, EPOCHS, SEED = 80, 2, 1


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document is in a mixture of 80 percent of all tokens, at most two epochs of any source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    mixed = mix(docs, [F.expr(DOMAIN), F.col("lang"), F.col("source")], WEIGHTS, BUDGET_PERCENT, EPOCHS, SEED)
    return mixed.select("doc_id", F.expr(DOMAIN).alias("domain"), "lang", "source", "n_tokens", "copies")


def _level_sql(depth: int) -> str:
    names = ["domain", "lang", "source"]
    parent, key = ", ".join(names[:depth]) or "1", ", ".join(names[: depth + 1])
    cases = " ".join(f"WHEN '{v}' THEN {w}" for v, w in WEIGHTS[depth].items())
    return f"""
n{depth} AS (SELECT {key}, sum(room)::BIGINT AS node_room, min(share) AS family, (CASE {names[depth]} {cases} ELSE 1 END)::BIGINT AS weight FROM s{depth} GROUP BY {key}),
f{depth} AS (SELECT *, node_room * sum(weight) OVER (PARTITION BY {parent} ORDER BY node_room / weight, {names[depth]} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
    + weight * coalesce(sum(node_room) OVER (PARTITION BY {parent} ORDER BY node_room / weight, {names[depth]} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) <= family * weight AS filled FROM n{depth}),
g{depth} AS (SELECT *, family - coalesce(sum(CASE WHEN filled THEN node_room END) OVER (PARTITION BY {parent}), 0) AS spare, sum(CASE WHEN NOT filled THEN weight END) OVER (PARTITION BY {parent}) AS open_weight FROM f{depth}),
s{depth + 1} AS (SELECT s.* EXCLUDE (share), (CASE WHEN filled THEN node_room ELSE (spare * weight)::BIGINT // open_weight::BIGINT END)::BIGINT AS share FROM s{depth} s JOIN g{depth} g USING ({key}))"""


ORACLE = f"""
WITH d AS (SELECT doc_id, 'd' || (ascii(right(coalesce(source, ''), 1)) % 3) AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source, lang AS lang0, source AS source0,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens FROM documents),
leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens, sum(n_tokens)::BIGINT * {EPOCHS} AS room FROM d GROUP BY domain, lang, source),
s0 AS (SELECT *, (SELECT least(sum(tokens)::BIGINT * {BUDGET_PERCENT} // 100, sum(room)::BIGINT) FROM leaves) AS share FROM leaves),
{_level_sql(0)},
{_level_sql(1)},
{_level_sql(2)},
q AS (SELECT *, CASE WHEN tokens > 0 THEN share // tokens ELSE 0 END AS whole FROM s3),
r AS (SELECT d.*, q.whole, q.share - q.whole * q.tokens AS rest, md5('{SEED}-' || q.whole || '-' || coalesce(d.doc_id::VARCHAR, '')) AS ord FROM d JOIN q USING (domain, lang, source))
SELECT doc_id, domain, lang0 AS lang, source0 AS source, n_tokens,
    (whole + CASE WHEN rest > 0 AND sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY ord RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= rest THEN 1 ELSE 0 END)::BIGINT AS copies FROM r
"""
