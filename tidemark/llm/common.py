"""Shared helpers: tables, checkpoints and the choice of bounded training samples."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder the session names in spark.checkpoint.dir, which all executors share.

    Only where that setting is unset in a local session (tests) a folder of this machine is used.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tidemark-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores appended until none of them is a column of df (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


BATCH = "4m"
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
READ_ROWS = "512"
READ_SETTING = "spark.sql.parquet.columnarReaderBatchSize"


def bounded_batches(spark: SparkSession) -> None:
    """Read whole texts READ_ROWS rows at a time and hand them to Python in batches of some BATCH bytes, unless the session
    sets its own bounds.

    Spark's defaults, 4,096 rows and 64 MB, make columns of tens of MB that grow by copying, and batches that are a whole
    partition of texts, held by the executor and its worker at once. A batch takes one row at least. The settings
    stay, as they count when a plan runs.
    """
    for setting, bound in ((READ_SETTING, READ_ROWS), (BATCH_SETTING, BATCH)):
        if spark.conf.get(setting, None) is None:
            spark.conf.set(setting, bound)


def fold(id_column: str, folds: int) -> Column:
    return F.crc32(F.col(id_column).cast("string")) % folds


def bounded_sample(df: DataFrame, keys: Sequence[str], rows: int, seed: int) -> DataFrame:
    """At most `rows` rows, the same ones on every run: those with the smallest seeded hashes of the keys."""
    (order,) = fresh(df, "order")
    return df.withColumn(order, F.xxhash64(F.lit(seed), *keys)).orderBy(order, *keys).limit(rows).drop(order)


HOT_KEYS = 10_000


def joined_by_weight(rows: DataFrame, known: DataFrame, keys: Sequence[str], weight: str, total: int) -> DataFrame:
    """rows joined with known, which has each key once and in `weight` how many rows have it; no task gets a hot key whole.

    Fewer than HOT_KEYS keys can each have more than the total's share of one in HOT_KEYS: those are broadcast, the
    others, none of which is large, are shuffled.
    """
    hot = F.col(weight) * HOT_KEYS > total
    frequent = known.filter(hot).drop(weight)
    rare = known.filter(~hot).drop(weight)
    keys = list(keys)
    direct = rows.join(F.broadcast(frequent), keys)
    return direct.unionByName(rows.join(F.broadcast(frequent.select(*keys)), keys, "left_anti").join(rare, keys))
