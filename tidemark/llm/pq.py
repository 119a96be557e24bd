"""Near-duplicate vectors by product quantisation.

Coarse centroids make inverted lists, and lists that lie together make cells; what remains of a vector after its
centroid is coded by subspaces. Every vector asks the lists nearest to it: a table of its products with the codes gives
an approximate cosine of each stored vector by look-ups, and the stored code's own error bounds how far that can be
off, so that no pair is lost between look-up and the exact cosine in double precision that decides. A vector travels
once to each cell that holds lists it asks. Cells, lists and codes are fitted in tasks on a bounded sample chosen by a
hash of the vectors, so that results do not depend on the partitioning; every vector is indexed. How many lists a vector
asks is measured for each input: as many as find the share RECALL of the links in the sample, and of pairs made at the
threshold and above. Ties between lists go to the first one.

Equal vectors are one stored entry with its number, so copies cost nothing. Cells of any size are dealt out in parts
of bounded size that meet in tasks of their own. A task returns counts for its vectors and only those links that
hold groups together, so a large group of near copies is not written out in pairs.

Vectors that are null, empty, zero, or hold null or infinite or NaN components link with nothing, and those of
different length are never compared. Ids are whole numbers; repeated ids are separate vectors, and null ids are named by
a component only if it has no other. Further columns of the table are not returned. Empty tables give empty ones.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import checkpointed, joined_by_weight, table
from tidemark.llm.components import components
from tidemark.llm.simhash import spanning

SAMPLE_VECTORS = 20_000
"""About as many vectors at most are cells and codes fitted on, and the number of lists to ask measured."""
LIST_SIZE = 512
LISTS = 65_536
"""Most lists, as long as their centroids take LIST_BYTES at most. They are fitted on some 8 vectors each."""
LIST_BYTES = 32 << 20
PROBES = 4
"""Fewest lists that a vector asks; more where RECALL takes more."""
RECALL = 0.99
HELD_OUT = 2_000
"""Most vectors of the sample that lists are not fitted on, but their number to ask is measured on."""
SUBSPACES = 16
CODES = 64
PART = 2_048
PART_BYTES = 16 << 20
"""A part of a cell holds PART vectors, or twice a cell's mean where that is more, within these bytes."""
NO_ID = (1 << 63) - 1
SAMPLED = "h1 long, h2 long, v array<{0}>"


def kmeans(points: np.ndarray, k: int, rounds: int = 8, seed: int = 1) -> np.ndarray:
    """Centroids of the points; empty ones are set on the points farthest from theirs."""
    rng = np.random.default_rng(seed)
    centres = points[rng.choice(len(points), k, replace=False)].astype(np.float64)
    for _ in range(rounds):
        near, gap = nearest(points, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        counts = np.bincount(near, minlength=k)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
        if (counts == 0).any():
            centres[counts == 0] = points[np.argsort(-gap, kind="stable")[: (counts == 0).sum()]]
    return centres


def nearest(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of and squared distance to the nearest centre, in portions of bounded memory."""
    norms = (centres**2).sum(1)
    index, gap = np.empty(len(points), np.int64), np.empty(len(points))
    for at in range(0, len(points), 4096):
        part = points[at : at + 4096]
        distance = norms - 2 * part @ centres.T
        index[at : at + 4096] = distance.argmin(1)
        gap[at : at + 4096] = distance.min(1) + (part**2).sum(1)
    return index, gap


def asked_lists(centres: np.ndarray, held: np.ndarray, others: np.ndarray, threshold: float, recall: float = RECALL) -> int:
    """How many nearest lists vectors must ask so that one of a pair's two finds the other, for that share of pairs.

    Counted for the links that held-out vectors have in the sample, for those of as many others, and for pairs made of
    the held-out ones in random directions at the threshold and nearer; the kind that takes most decides.
    """
    norms = (centres**2).sum(1) / 2
    rng = np.random.default_rng(5)

    def needed(left: np.ndarray, right: np.ndarray) -> int:
        ranks = np.empty(len(left), np.int64)
        for at in range(0, len(left), 512):
            a, b = (x[at : at + 512] @ centres.T - norms for x in (left, right))
            each = np.arange(len(a))
            ranks[at : at + 512] = np.minimum((a > a[each, b.argmax(1)][:, None]).sum(1), (b > b[each, a.argmax(1)][:, None]).sum(1))
        return int(np.sort(ranks)[int(np.ceil(recall * len(ranks))) - 1]) + 1

    every, most = np.concatenate([held, others]), 1
    for first in (0, len(held)):
        found = []
        for at in range(first, min(first + len(held), len(every)), 256):
            a, b = np.nonzero(every[at : min(at + 256, first + len(held))] @ every.T >= threshold)
            kept = np.flatnonzero(b != a + at)
            kept = rng.choice(kept, min(len(kept), 10_000), replace=False)
            found.append(np.stack([a[kept] + at, b[kept]]))
        left, right = np.concatenate(found, axis=1)
        if len(left):
            taken = rng.choice(len(left), min(len(left), 10 * HELD_OUT), replace=False)
            most = max(most, needed(every[left[taken]], every[right[taken]]))
    for near in (threshold, (1 + threshold) / 2, (9 + threshold) / 10):
        aside = rng.normal(size=held.shape)
        aside -= (aside * held).sum(1)[:, None] * held
        aside /= np.maximum(np.linalg.norm(aside, axis=1), 1e-300)[:, None]
        most = max(most, needed(held, near * held + np.sqrt(max(0.0, 1 - near**2)) * aside))
    return most


@dataclass
class Quantiser:
    centres: np.ndarray  # (lists, size)
    cell_of: np.ndarray  # (lists,)
    codes: np.ndarray  # (subspaces, codes, size of a subspace)
    probes: int

    def place(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(probed lists, nearest first; codes) of unit vectors."""
        closeness = vectors @ self.centres.T - (self.centres**2).sum(1) / 2
        order = np.argsort(-closeness, axis=1, kind="stable")[:, : self.probes]
        rest = (vectors - self.centres[order[:, 0]]).reshape(len(vectors), len(self.codes), -1)
        made = np.stack([nearest(rest[:, m], self.codes[m])[0] for m in range(len(self.codes))], axis=1)
        return order, made.astype(np.uint8)

    def rebuilt(self, listed: int, codes: np.ndarray) -> np.ndarray:
        parts = [self.codes[m][codes[:, m]] for m in range(len(self.codes))]
        return self.centres[listed] + np.concatenate(parts, axis=1)

    def approximate(self, asked: np.ndarray, listed: int, codes: np.ndarray) -> np.ndarray:
        """(asked, stored) inner products by table look-up."""
        pieces = asked.reshape(len(asked), len(self.codes), -1)
        out = np.repeat((asked @ self.centres[listed])[:, None], len(codes), axis=1)
        for m in range(len(self.codes)):
            out += (pieces[:, m] @ self.codes[m].T)[:, codes[:, m]]
        return out


def unit(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The vectors of a list column, in double precision and of length 1."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    out = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    out = out / np.abs(out).max(axis=1)[:, None]
    return out / np.linalg.norm(out, axis=1)[:, None]


# --- fitting, in tasks


def _once(sample: DataFrame, function: Callable[[np.ndarray, np.ndarray], object]):
    """The function's result for all of a bounded sample (hashes, unit vectors; in the order of the hashes), made in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches))
        hashes, vectors = rows["h1"].to_numpy(), unit(rows["v"])
        order = np.lexsort((rows["h2"].to_numpy(), hashes))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(function(hashes[order], vectors[order]))])], names=["made"])

    return pickle.loads(sample.select("h1", "h2", "v").coalesce(1).mapInArrow(run, "made binary").first()[0])


def _sampled(stored: DataFrame, rows: int, wanted: int) -> DataFrame:
    """About `wanted` of the vectors, chosen by their hashes."""
    return stored if rows <= wanted else stored.filter(F.pmod(F.xxhash64(F.lit(3), "h1", "h2"), F.lit(rows)) < wanted)


def fit(stored: DataFrame, rows: int, size: int, threshold: float, probes: int | None = None) -> Quantiser:
    """Cells, then lists inside each cell, codes of what remains, and the number of lists to ask."""
    lists = max(1, min(LISTS, LIST_BYTES // (8 * size), -(-rows // LIST_SIZE)))
    n_cells = int(np.ceil(np.sqrt(lists)))
    sample = checkpointed(_sampled(stored, rows, max(SAMPLE_VECTORS, 8 * lists)).select("h1", "h2", "v"))
    seen = sample.count()
    if not seen:  # chance has chosen none of few
        sample, seen = stored.select("h1", "h2", "v"), rows
    small = _sampled(sample, seen, SAMPLE_VECTORS)
    measure = probes is None and lists > PROBES

    def held_out(hashes: np.ndarray) -> np.ndarray:
        return (hashes % 10 == 0) & measure

    cells = _once(small, lambda hashes, vectors: kmeans(vectors, min(n_cells, len(vectors))))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(nearest(unit(batch.column(2)), cells)[0].astype(np.int32)), *batch.columns], names=["cell", *batch.schema.names])

    kind = sample.schema["v"].dataType.elementType.simpleString()
    mean = -(-lists // len(cells))

    def lists_of(key: tuple, rows: pa.Table) -> pa.Table:
        order = np.lexsort((rows["h2"].to_numpy(), rows["h1"].to_numpy()))
        hashes, vectors = rows["h1"].to_numpy()[order], unit(rows["v"])[order]
        vectors = vectors[~held_out(hashes)] if (~held_out(hashes)).any() else vectors
        # A crowded cell gets more lists, up to four times the mean.
        wanted = max(1, min(round(lists * rows["n"][0].as_py() / seen), 4 * mean, len(vectors)))
        centres = kmeans(vectors[: 16 * wanted], wanted)
        return pa.table({"cell": pa.array([key[0].as_py()] * len(centres), pa.int32()), "place": pa.array(range(len(centres)), pa.int32()), "centre": pa.array([c.tobytes() for c in centres], pa.binary())})

    # A crowded cell needs no more of the sample than its lists do.
    assigned = checkpointed(sample.mapInArrow(assign, "cell int, " + SAMPLED.format(kind)))
    crowds = assigned.groupBy("cell").agg(F.count("*").alias("n"))  # as many rows as cells
    assigned = assigned.join(F.broadcast(crowds), "cell").filter((F.col("n") <= 80 * mean) | (F.pmod(F.xxhash64(F.lit(7), "h1", "h2"), F.col("n")) < 80 * mean))
    found = assigned.groupBy("cell").applyInArrow(lists_of, "cell int, place int, centre binary")
    found = sorted((r.cell, r.place, bytes(r.centre)) for r in found.collect())  # at most LIST_BYTES, and as much again for crowded cells
    centres, cell_of = np.array([np.frombuffer(c) for _, _, c in found]), np.array([c for c, _, _ in found])

    def finish(hashes: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, int]:
        rest = vectors - centres[nearest(vectors, centres)[0]]
        subspaces = next(m for m in range(min(SUBSPACES, size), 0, -1) if size % m == 0)
        pieces = rest.reshape(len(rest), subspaces, -1)
        codes = np.stack([kmeans(pieces[:, m], min(CODES, len(rest)), seed=m) for m in range(subspaces)])
        aside = held_out(hashes)
        asked = probes or len(centres)
        if measure and aside.any():
            asked = max(PROBES, asked_lists(centres, vectors[aside][:HELD_OUT], vectors[~aside], threshold))
        return codes, min(asked, len(centres))

    return Quantiser(centres, cell_of, *_once(small, finish))


# --- searching


def _meet(quantiser: Quantiser, threshold: float, cell: int, asked: pa.Table, stored: pa.Table) -> pa.Table:
    """Counts and holding links between vectors that ask lists of a cell and a part of what the cell stores."""
    q, s = unit(asked["v"]), unit(stored["v"])
    q_lists, s_lists = (np.array(t["probes"].to_pylist()) for t in (asked, stored))
    q_home, s_home = q_lists[:, 0], s_lists[:, 0]
    # The vectors of both sides get common numbers, so that one does not meet itself.
    ids = np.concatenate([np.stack([t["least"].to_numpy(), t["h1"].to_numpy()], axis=1) for t in (asked, stored)])
    ids, number = np.unique(ids, axis=0, return_inverse=True)
    number = number.reshape(-1)
    q_id, s_id = number[: len(q)], number[len(q) :]
    s_many, q_many = stored["many"].to_numpy(), asked["many"].to_numpy()
    codes = np.frombuffer(b"".join(stored["codes"].to_pylist()), np.uint8).reshape(len(s), -1)
    counts = np.zeros(len(ids), np.int64)
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    pairs = max(1, (4 << 20) // s.shape[1])
    for listed in np.unique(s_home):
        here = np.flatnonzero(s_home == listed)
        asking = np.flatnonzero((q_lists == listed).any(axis=1))
        if not len(asking):
            continue
        slack = np.linalg.norm(s[here] - quantiser.rebuilt(listed, codes[here]), axis=1) + 1e-9
        for at in range(0, len(here), 4096):
            block = here[at : at + 4096]
            for start in range(0, len(asking), 256):
                some = asking[start : start + 256]
                a, b = np.nonzero(quantiser.approximate(q[some], listed, codes[block]) + slack[at : at + 4096] >= threshold)
                a, b = some[a], block[b]
                exact = [np.einsum("ij,ij->i", q[a[k : k + pairs]], s[b[k : k + pairs]]) >= threshold for k in range(0, len(a), pairs)]
                near = (np.concatenate(exact) if exact else np.empty(0, bool)) & (q_id[a] != s_id[b])
                a, b = a[near], b[near]
                np.add.at(counts, q_id[a], s_many[b])
                # The stored one finds the asking one by itself if it asks that one's list.
                alone = ~(s_lists[b] == q_home[a][:, None]).any(axis=1)
                np.add.at(counts, s_id[b[alone]], q_many[a[alone]])
                kept = spanning(q_id[a], s_id[b])
                left.append(q_id[a][kept])
                right.append(s_id[b][kept])
    left, right = np.concatenate(left), np.concatenate(right)
    kept = spanning(left, right)
    left, right, counted = left[kept], right[kept], np.flatnonzero(counts)
    return pa.table({
        "least": pa.array(np.concatenate([ids[counted, 0], ids[left, 0]])),
        "h1": pa.array(np.concatenate([ids[counted, 1], ids[left, 1]])),
        "n": pa.array(np.concatenate([counts[counted], np.zeros(len(left), np.int64)])),
        "other_least": pa.array([None] * len(counted) + ids[right, 0].tolist(), pa.int64()),
        "other_h1": pa.array([None] * len(counted) + ids[right, 1].tolist(), pa.int64()),
    })


def near_duplicates(df: DataFrame, id_column: str = "vec_id", vector: str = "embedding", threshold: float = 0.9, probes: int | None = None) -> DataFrame:
    """(id, n_links, component) of every vector: others linked directly, and the smallest id reachable.

    A vector asks as many lists as the measured recall takes, or `probes` where that is given.
    """
    kind = "float" if isinstance(df.schema[vector].dataType.elementType, T.FloatType) else "double"
    rows = df.select(F.col(id_column).cast("long").alias("id"), F.col(vector).cast(f"array<{kind}>").alias("v"))
    fine = F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("v", F.when(fine, F.col("v")))
    linked = rows.filter("v is not null").withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), "v")})
    # An entry of the index is a distinct vector, told by 128 bits of hashes; its name is its smallest id and a hash.
    classes = linked.groupBy("h1", "h2").agg(F.min(F.coalesce("id", F.lit(NO_ID))).alias("least"), F.count("*").alias("many"), F.first("v").alias("v"))
    stored = checkpointed(classes.withColumn("size", F.size("v")))
    nothing = rows.filter("v is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    out = None
    for size, count in sorted((r["size"], r["count"]) for r in stored.groupBy("size").count().collect()):
        found = _search(stored.filter(F.col("size") == size), count, size, threshold, probes)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return nothing
    out = checkpointed(out)
    counts = out.filter("other_h1 is null").groupBy("least", "h1").agg(F.sum("n").alias("n"))
    # The smallest node of a component is named by the smallest id in it.
    reached = components(out.filter("other_h1 is not null").select(F.struct("least", "h1").alias("a"), F.struct(F.col("other_least").alias("least"), F.col("other_h1").alias("h1")).alias("b")))
    reached = reached.select("node.least", "node.h1", F.col("component.least").alias("component"))
    labelled = stored.select("h1", "h2", "least", "many").join(counts, ["least", "h1"], "left").join(reached, ["least", "h1"], "left")
    known = labelled.select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("many") - 1).alias("n_links"), F.nullif(F.coalesce("component", "least"), F.lit(NO_ID)).alias("component"), "many")
    total = stored.agg(F.sum("many")).first()[0]
    return joined_by_weight(linked.select("id", "h1", "h2"), known, ["h1", "h2"], "many", total).select("id", "n_links", "component").unionByName(nothing)


def _search(stored: DataFrame, rows: int, size: int, threshold: float, probes: int | None) -> DataFrame:
    """(least, h1, n, other_least, other_h1): links counted (no other), or links that hold groups together."""
    quantiser = fit(stored, rows, size, threshold, probes)
    kind = stored.schema["v"].dataType.elementType.simpleString()
    slice_rows = max(16, min(2048, (4 << 20) // len(quantiser.centres)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, slice_rows):
                batch = whole.slice(start, slice_rows)
                order, codes = quantiser.place(unit(batch.column(3)))
                cells = [list(dict.fromkeys(c)) for c in quantiser.cell_of[order].tolist()]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(order.tolist(), pa.list_(pa.int32())), pa.array(cells, pa.list_(pa.int32())), pa.array([c.tobytes() for c in codes], pa.binary())],
                    names=[*batch.schema.names, "probes", "cells", "codes"],
                )

    placed = stored.select("least", "h1", "many", "v").mapInArrow(place, f"least long, h1 long, many long, v array<{kind}>, probes array<int>, cells array<int>, codes binary")
    placed = checkpointed(placed)
    asking = placed.withColumn("cell", F.explode("cells"))
    part_rows = max(1, min(max(PART, 2 * rows // len(set(quantiser.cell_of.tolist()))), PART_BYTES // (8 * size)))
    # Both tables have a row for each cell at most, and cells are bounded as lists are.
    sizes = placed.groupBy(F.col("cells")[0].alias("cell")).agg(F.ceil(F.count("*") / part_rows).cast("int").alias("parts"))
    asked = asking.groupBy("cell").agg(F.ceil(F.count("*") / (2 * part_rows)).cast("int").alias("ways"))
    plan = F.broadcast(checkpointed(sizes.join(asked, "cell")))
    salt = F.xxhash64(F.lit(9), "h1", "least")
    left = asking.join(plan, "cell").withColumn("way", F.pmod(salt, "ways").cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    right = placed.withColumn("cell", F.col("cells")[0]).join(plan, "cell").withColumn("part", F.pmod(salt, "parts").cast("int")).withColumn("way", F.explode(F.sequence(F.lit(0), F.col("ways") - 1)))
    # Aliases make the columns of the two sides different ones.
    left = left.select(*(F.col(c).alias(c) for c in ("cell", "part", "way", "least", "h1", "many", "v", "probes")))
    right = right.select(*(F.col(c).alias(c) for c in ("cell", "part", "way", "least", "h1", "many", "v", "probes", "codes")))

    def compare(key: tuple, asked: pa.Table, kept: pa.Table) -> pa.Table:
        if not len(asked) or not len(kept):
            return pa.table({n: pa.array([], pa.int64()) for n in ("least", "h1", "n", "other_least", "other_h1")})
        return _meet(quantiser, threshold, key[0].as_py(), asked, kept)

    grouped = left.groupBy("cell", "part", "way").cogroup(right.groupBy("cell", "part", "way"))
    return grouped.applyInArrow(compare, "least long, h1 long, n long, other_least long, other_h1 long")


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, component and whether it is kept, of every embedding."""
    found = near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept"))
