"""A corpus pipeline: toxic documents go, near copies go, secrets are masked, sources are mixed, texts become tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows of its predecessor; all but the last return the columns of
documents. Null and empty texts pass every filter but count as copies of each other; rows without doc_id, which no
decision can name, are kept by the second stage. Empty tables give empty ones.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, mixing, secrets, simhash, toxicity
from tidemark.llm.common import bounded_batches, checkpointed, fold, fresh, shared_folder, table

MIX_PERCENT, MIX_EPOCHS = 90, 1


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below 0.5; labels are learnt where crc32(doc_id) mod 5 is not 0."""
    bounded_batches(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), "toxic", fold("doc_id", 5) != 0)
    (score,) = fresh(docs, "toxicity")
    return model.score(docs, to=score).filter(F.col(score) < 0.5).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of SimHash near duplicates, one row of it.

    Near duplicates are op4's: fingerprints of 4-word shingles within 4 of 64 bits. That finds copies and lightly edited
    ones, and leaves in most texts whose shingles agree to 0.8 only, whose fingerprints differ in some 10 bits. Of
    rows with one id and different texts, each is judged by its own text; of equal ones the first in order stays.
    """
    bounded_batches(spark)
    found = checkpointed(simhash.near_duplicates(docs.select("doc_id", "text")))
    kept = found.filter("id = component and fp = root").select(F.col("id").alias("doc_id"), "fp").distinct()
    # Only ids that come with several fingerprints need their rows told apart; there are few or none.
    twice = found.groupBy("id").agg(F.min("fp").alias("least"), F.max("fp").alias("most")).filter("least <> most and id is not null").select(F.col("id").alias("doc_id"))
    once = docs.join(kept.join(twice, "doc_id", "left_anti"), "doc_id", "left_semi")
    out = [_first(once, ["doc_id"]), docs.filter("doc_id is null")]
    if not twice.isEmpty():
        text, fp = fresh(docs, "text_copy", "fp")
        marked = simhash.with_fingerprint(docs.join(twice, "doc_id", "left_semi").withColumn(text, F.col("text")), text, fp)
        out.append(_first(marked.join(kept.withColumnRenamed("fp", fp), ["doc_id", fp], "left_semi"), ["doc_id", fp]))
    return reduce(DataFrame.unionByName, (df.select(*docs.columns) for df in out))


def _first(docs: DataFrame, keys: list[str]) -> DataFrame:
    """The row of each key whose text comes first; rows of a key are merged before they are shuffled."""
    rest = [c for c in docs.columns if c not in keys]
    (row,) = fresh(docs, "row")
    return docs.groupBy(*keys).agg(F.min_by(F.struct(*(F.col(f"`{c}`") for c in rest)), F.struct("text", F.xxhash64(*(F.col(f"`{c}`").cast("string") for c in rest)))).alias(row)).select(*keys, f"{row}.*")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced by a mark."""
    bounded_batches(spark)
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents chosen for a mixture of the target weights, as often as it takes them."""
    bounded_batches(spark)
    mixed = mixing.mix(docs, [F.expr(mixing.DOMAIN), F.col("lang"), F.col("source")], mixing.WEIGHTS, MIX_PERCENT, MIX_EPOCHS, mixing.SEED)
    copies = mixed.columns[-1]
    (copy,) = fresh(mixed, "copy")
    return mixed.filter(F.col(copies) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).select(*docs.columns)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, packed, with their count, their hash and that of what they decode to."""
    bounded_batches(spark)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = bpe.encode(docs.select("doc_id", "lang", "source", "text"), "text", path, public_tokenizers.PATTERN, segment=bpe.SEGMENT, replace=True, decoded="decoded", lean=True)
    return bpe.digests(encoded.withColumn("token_ids", F.col("ids")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("tokens", tokenise),
]

#: SQL can express neither the trees nor the fingerprints; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; between stages the rows are written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
