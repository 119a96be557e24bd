"""Bounded labelled samples: labels are chosen first, and only the chosen ids travel to the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_sample, checkpointed

SAMPLE_ROWS = 20_000
"""Most labelled rows a classifier is fitted on."""


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, keep, rows: int = SAMPLE_ROWS, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text, label) of at most `rows` labelled documents for which the condition `keep` on their id holds.

    Null labels and ids do not count; a document with several labels has the largest one, and of several documents with
    one id the text that comes first counts. The ids broadcast are at most `rows`.
    """
    chosen = labels.filter(F.col(id_column).isNotNull() & F.col(label).isNotNull() & keep).groupBy(F.col(id_column).alias("id")).agg(F.max(F.col(label)).cast("int").alias("label"))
    chosen = bounded_sample(chosen, ["id"], rows, 7)
    texts = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return checkpointed(texts.join(F.broadcast(chosen), "id").groupBy("id", "label").agg(F.min("text").alias("text")).select("id", "text", "label"))


def parts(sample: DataFrame, shares: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """The sample but one share, to fit on, and that share, chosen by a hash of the ids, to calibrate on.

    If one of them lacks a class, there are too few labels to split: both are then the whole sample.
    """
    part = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(shares))
    fitted, rest = sample.filter(part > 0), sample.filter(part == 0)
    seen = {(r.rest, r.label) for r in sample.select((part == 0).alias("rest"), "label").distinct().collect()}
    return (fitted, rest) if len(seen) == 4 else (sample, sample)
