"""Quality by compression: how much better a text packs with a dictionary of bad texts than with one of good texts.

Two zstandard dictionaries are built from labelled good and bad texts. A text is cut into blocks, and each block is
packed with either dictionary; the difference of the sizes over their sum is the text's raw score. Logistic
regression turns it into a probability, together with how far the text packs at all: text that repeats itself packs
to almost nothing with both dictionaries, and so shows no difference. The dictionaries and the calibration see a bounded
sample of labelled rows, different ones each if there are rows enough of both classes; scoring reads whole texts and shuffles nothing.

Null texts count as empty ones, which have no difference. Repeated rows get equal scores. Labels of only one
class give a constant score, that class; no labels give 1 (nothing is known against any text). Empty tables give
empty ones; extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from math import log

import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import fold, fresh, table
from tidemark.llm.labelled import SAMPLE_ROWS, labelled_sample, parts

DICTIONARY_PARTS = 4_000
"""Most blocks of the labelled texts of a class that a dictionary is built from, chosen by their hashes."""
TEXT_PARTS = 40
"""Most blocks of one text among them."""
DICTIONARY_BYTES = 64 * 1024
BLOCK = 512
LEVEL = 3


def dictionary_parts(sample: DataFrame) -> DataFrame:
    """(label, part): blocks of a labelled sample (text, label) for the dictionaries, cut and chosen in tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1)):
                # A repeated block has the same hash each time and is taken once.
                found = sorted({(xxh64_intdigest(p, 5) >> 1, p) for p in _blocks(text.as_py().encode())})[:TEXT_PARTS]
                yield pa.RecordBatch.from_arrays([pa.array([label.as_py()] * len(found), pa.int32()), pa.array([h for h, _ in found], pa.int64()), pa.array([p for _, p in found], pa.binary())], names=["label", "mark", "part"])

    cut = sample.select("text", "label").mapInArrow(run, "label int, mark long, part binary").distinct()
    chosen = None
    for label in (0, 1):
        one = cut.filter(F.col("label") == label).orderBy("mark", "part").limit(DICTIONARY_PARTS)
        chosen = one if chosen is None else chosen.union(one)
    return chosen.select("label", "part")


def build_dictionary(parts: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A zstandard dictionary of blocks; the blocks themselves if they are too few to train on."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, parts, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(parts)[-size:]


def _blocks(data: bytes) -> list[bytes]:
    return [data[k : k + BLOCK] for k in range(0, len(data), BLOCK)]


def packed_sizes(dictionaries: tuple[bytes, ...]):
    """A function from a text to its blocks' packed size with each dictionary."""
    import zstandard

    packers = [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d), level=LEVEL, write_content_size=False, write_dict_id=False) for d in dictionaries]

    def sizes(text: str) -> list[int]:
        parts = _blocks(text.encode())
        return [sum(len(packer.compress(p)) for p in parts) for packer in packers]

    return sizes


def with_sizes(df: DataFrame, text: str, good: bytes, bad: bytes, drop_text: bool = False) -> tuple[DataFrame, list[str]]:
    """df with two columns: (size by the bad dictionary - size by the good one) / their sum, above 0 where a text is
    like the good ones; and the logarithm of the smaller size over the text's."""
    at = df.columns.index(text)
    kept = [i for i in range(len(df.columns)) if not (drop_text and i == at)]
    names = fresh(df, "difference", "ratio")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        sizes = packed_sizes((good, bad))
        for batch in batches:
            made = []
            for v in batch.column(at):
                text = v.as_py()
                g, b = sizes(text) if text else (0, 0)
                made.append(((b - g) / (b + g), log(min(g, b) / len(text.encode()))) if text else (0.0, 0.0))
            columns = [pa.array([m[i] for m in made], pa.float64()) for i in range(2)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), *columns], names=[*(batch.schema.names[i] for i in kept), *names])

    return df.mapInArrow(run, T.StructType([*(df.schema.fields[i] for i in kept), *(T.StructField(n, T.DoubleType()) for n in names)])), names


@dataclass
class Quality:
    """A fitted scorer: probability = 1 / (1 + exp(-(slopes . (difference, ratio) + offset))), or a constant."""

    good: bytes
    bad: bytes
    slopes: tuple[float, float]
    offset: float
    constant: float | None = None

    def score(self, df: DataFrame, text: str = "text", to: str = "score", drop_text: bool = False) -> DataFrame:
        (to,) = fresh(df, to)
        kept = [c for c in df.columns if not (drop_text and c == text)]
        if self.constant is not None:
            return df.select(*kept, F.lit(self.constant).alias(to))
        made, names = with_sizes(df, text, self.good, self.bad, drop_text)
        raw = self.slopes[0] * F.col(names[0]) + self.slopes[1] * F.col(names[1]) + self.offset
        return made.withColumn(to, 1.0 / (1.0 + F.exp(-raw))).select(*kept, to)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", keep: Column | None = None, rows: int = SAMPLE_ROWS) -> Quality:
    """Fit on at most `rows` labelled documents whose ids meet `keep`."""
    sample = labelled_sample(docs, labels, label, F.lit(True) if keep is None else keep, rows)
    seen = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
    if not seen.get(0) or not seen.get(1):
        return Quality(b"", b"", (0.0, 0.0), 0.0, 0.0 if seen.get(0) else 1.0)
    built, rest = parts(sample, 2, 2)
    found: dict[int, list[bytes]] = {0: [], 1: []}
    for r in dictionary_parts(built).collect():  # 8,000 blocks of 512 bytes at most
        found[r.label].append(bytes(r.part))
    good, bad = build_dictionary(sorted(found[1])), build_dictionary(sorted(found[0]))
    measured, names = with_sizes(rest, "text", good, bad, True)
    data = VectorAssembler(inputCols=names, outputCol="features").transform(measured.withColumn("weight", F.when(F.col("label") == 0, max(1.0, min(8.0, seen[1] / seen[0]))).otherwise(1.0)))
    fitted = LogisticRegression(labelCol="label", weightCol="weight", regParam=1e-4, maxIter=50).fit(data)
    return Quality(good, bad, tuple(map(float, fitted.coefficients)), float(fitted.intercept))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; labels are learnt only where crc32(doc_id) mod 3 is not 1."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"), "quality", fold("doc_id", 3) != 1)
    return model.score(docs, drop_text=True).select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
