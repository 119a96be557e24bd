"""SimHash near-duplicates by bit-sliced comparison.

A text's fingerprint has bit i set where over half of its shingles' hashes have it. Fingerprints at most
`radius` bits apart agree on one of radius+1 bands at least, so each distinct fingerprint goes once into a bucket of
each band; when buckets would be large, bands are cut finer and all choices of the agreeing ones are keys. Inside
a bucket fingerprints are compared in blocks of bounded size: 64 bit planes hold a block vertically, 64 fingerprints
a machine word, and differing bits are counted for a whole word at once by carry-save adders. A query leaves the
block as soon as all of its lanes are over the radius. A block returns no more links than hold its groups together.

Null and empty texts, and those without words, have fingerprint zero, which links like any other. Repeated rows
are copies of each other; further columns are not returned; an empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import checkpointed, fresh, joined_by_weight, table
from tidemark.llm.components import components

WORDS = 4
RADIUS = 4
BLOCK = 1024
SHARED = 512
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
SEPARATED = re.compile(rb"[^\x20\x09-\x0D]+")
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
NO_ID = (1 << 63) - 1


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The fingerprint as an unsigned 64-bit integer."""
    import xxhash

    found = SEPARATED.findall((text or "").encode().translate(LOWER))
    if not found:
        return 0
    join, digest = b" ".join, xxhash.xxh64_intdigest
    if len(found) < words:
        return digest(join(found), 42)
    shingles = map(join, zip(*(found[k:] for k in range(words))))
    hashes = np.fromiter((digest(s, 42) for s in shingles), np.uint64, len(found) - words + 1)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        counts += np.unpackbits(hashes[at : at + 8192].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def with_fingerprint(df: DataFrame, text: str = "text", to: str = "fingerprint", words: int = WORDS) -> DataFrame:
    """Add the fingerprint as a signed 64-bit integer in place of the text column."""
    at = df.columns.index(text)
    kept = [f for i, f in enumerate(df.schema.fields) if i != at]
    (to,) = fresh(df.drop(text), to)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            made = np.array([fingerprint(v.as_py(), words) for v in batch.column(at)], np.uint64).view(np.int64)
            rest = [c for i, c in enumerate(batch.columns) if i != at]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(made)], names=[*(f.name for f in kept), to])

    return df.mapInArrow(run, T.StructType([*kept, T.StructField(to, T.LongType())]))


def bands_for(rows: int, radius: int = RADIUS, bucket: int = 2048) -> int:
    """How many bands to cut the 64 bits into, so that buckets of evenly spread fingerprints hold about `bucket`."""
    bands = radius + 1
    while bands < 12 and rows >> (64 * (bands - radius) // bands) > bucket:
        bands += 1
    return bands


def _masks(bands: int, radius: int) -> list[int]:
    edges = [64 * k // bands for k in range(bands + 1)]
    each = [((1 << high) - 1) ^ ((1 << low) - 1) for low, high in zip(edges, edges[1:])]
    return [sum(chosen) for chosen in combinations(each, bands - radius)]


def planes(fingerprints: np.ndarray) -> np.ndarray:
    """(64, words): word w of plane i has bit i of 64 fingerprints. The last word's unused lanes repeat its first."""
    padded = np.concatenate([fingerprints, np.repeat(fingerprints[:1], -len(fingerprints) % 64)])
    bits = np.unpackbits(padded.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8")


def close(queries: np.ndarray, block: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Indices (into queries, into block) of all pairs at most `radius` bits apart."""
    sliced = planes(block)
    size = int(radius + 1).bit_length()
    found_q, found_b = [], []
    for at in range(0, len(queries), 256):
        chosen = np.arange(at, min(at + 256, len(queries)))
        asked = queries[chosen]
        # A counter starts so that its overflow says "over the radius".
        start = (1 << size) - 1 - radius
        sums = [np.full((len(chosen), sliced.shape[1]), ALL if start >> k & 1 else 0, np.uint64) for k in range(size)]
        over = np.zeros((len(chosen), sliced.shape[1]), np.uint64)
        for i in range(64):
            flip = (np.uint64(0) - (asked >> np.uint64(i) & np.uint64(1)))[:, None]
            carry = sliced[i][None, :] ^ flip
            for k in range(size):
                sums[k], carry = sums[k] ^ carry, sums[k] & carry
            over |= carry
            if i % 8 == 7 and i >= 15:
                alive = (over != ALL).any(axis=1)
                if not alive.all():
                    chosen, asked, over, sums = chosen[alive], asked[alive], over[alive], [s[alive] for s in sums]
                    if not len(chosen):
                        break
        if len(chosen):
            lanes = np.unpackbits(np.ascontiguousarray(~over).view(np.uint8).reshape(len(chosen), -1), axis=1, bitorder="little")[:, : len(block)]
            q, b = np.nonzero(lanes)
            found_q.append(chosen[q])
            found_b.append(b)
    if not found_q:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(found_q), np.concatenate(found_b)


def spanning(left: np.ndarray, right: np.ndarray) -> list[int]:
    """Indices of those links that join two groups not joined by earlier ones."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(up, up)
        return x

    kept = []
    for i, (a, b) in enumerate(zip(left.tolist(), right.tolist())):
        a, b = root(a), root(b)
        if a != b:
            parent[a] = b
            kept.append(i)
    return kept


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(key, (fingerprint, smallest id) rows, whether of the second part) of each meeting, from rows sorted by meeting."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def drain(last: bool) -> Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        keys, nodes, second = (np.concatenate(x) for x in zip(*held))
        changes = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        bounds = [0, *changes.tolist(), *([len(keys)] if last else [])]
        for a, b in zip(bounds, bounds[1:]):
            yield keys[a], nodes[a:b], second[a:b]
        held[:] = [(keys[bounds[-1] :], nodes[bounds[-1] :], second[bounds[-1] :])]

    for batch in batches:
        if batch.num_rows:
            keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4)], axis=1)
            nodes = np.stack([batch.column(k).to_numpy() for k in (5, 6)], axis=1)
            held.append((keys, nodes, batch.column(4).to_numpy(zero_copy_only=False)))
            yield from drain(False)
    if held:
        yield from drain(True)


def links(distinct: DataFrame, rows: int, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) that hold together all groups of distinct fingerprints within the radius.

    A fingerprint comes with its smallest id (columns `fp`, `least`), and a link's ends are both, as structs.
    """
    masks = _masks(bands_for(rows, radius), radius)
    keyed = distinct.select("fp", "least", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)) for m in masks))).alias("band", "key"))
    sizes = keyed.groupBy("band", "key").agg(F.count("*").alias("n")).filter("n > 1")
    # Buckets over the bound are dealt out in parts, and every two parts meet in a task of their own.
    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    placed = keyed.join(sizes, ["band", "key"]).withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    meeting = placed.select("band", "key", "fp", "least", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")).select(
        "band", "key", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), (F.col("part") > F.col("other")).alias("second"), "fp", "least"
    )
    # Rows are sorted by meeting. Small whole buckets share a block: a link across them is a link all the same.
    dealt = meeting.repartition("band", "key", "low", "high").sortWithinPartitions("band", "key", "low", "high", "second")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        def answer(asked: np.ndarray, block: np.ndarray) -> pa.RecordBatch:
            q, b = close(asked[:, 0].copy().view(np.uint64), block[:, 0].copy().view(np.uint64), radius)
            kept = spanning(asked[q, 0], block[b, 0])
            left, right = asked[q[kept]], block[b[kept]]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in (left[:, 0], left[:, 1], right[:, 0], right[:, 1])], names=["fp", "least", "other_fp", "other_least"])

        gathered: list[np.ndarray] = []
        for keys, nodes, second in _meetings(batches):
            if keys[2] != keys[3]:
                if second.any() and not second.all():
                    yield answer(nodes[second], nodes[~second])
            else:
                gathered.append(nodes)
                if sum(map(len, gathered)) >= SHARED:
                    block = np.concatenate(gathered)
                    yield answer(block, block)
                    gathered = []
        if gathered:
            block = np.concatenate(gathered)
            yield answer(block, block)

    found = dealt.mapInArrow(compare, "fp long, least long, other_fp long, other_least long")
    return found.select(F.struct("least", "fp").alias("a"), F.struct(F.col("other_least").alias("least"), F.col("other_fp").alias("fp")).alias("b"))


def groups(df: DataFrame, id_column: str, fp: str, radius: int = RADIUS) -> DataFrame:
    """(id, fingerprint, component, root) of every row with a fingerprint column, component being the smallest id reachable
    and root that row's fingerprint.

    Ids are whole numbers; null ones name a component only if it has no other. Equal fingerprints are one node of the
    graph, named by its smallest id, so large groups of copies cost no links and the smallest node names the component.
    """
    rows = checkpointed(df.select(F.col(id_column).cast("long").alias("id"), F.col(fp).alias("fp")))
    nodes = checkpointed(rows.groupBy("fp").agg(F.min(F.coalesce("id", F.lit(NO_ID))).alias("least"), F.count("*").alias("many")))
    reached = components(links(nodes, nodes.count(), radius)).select("node.fp", "component")
    labelled = nodes.join(reached, "fp", "left").select("fp", F.nullif(F.coalesce("component.least", "least"), F.lit(NO_ID)).alias("component"), F.coalesce("component.fp", "fp").alias("root"), "many")
    return joined_by_weight(rows, labelled, ["fp"], "many", rows.count()).select("id", "fp", "component", "root")


def near_duplicates(df: DataFrame, id_column: str = "doc_id", text: str = "text", words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """(id, fingerprint as a signed integer, component, the component's own fingerprint) of every row; rows with a null id keep it and link by text alone."""
    return groups(with_fingerprint(df.select(F.col(id_column).alias("id"), F.col(text).alias("text")), "text", "fp", words), "id", "fp", radius)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return near_duplicates(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id")
    )
