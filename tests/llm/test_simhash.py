import numpy as np
import pyarrow.parquet as pq

from tidemark.llm import simhash
from tidemark.llm.components import components


def plain(text, words=4):
    """The definition, word by word."""
    import re

    import xxhash

    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    found = re.findall("[^\x20\x09-\x0d]+", text)
    if not found:
        return 0
    shingles = [" ".join(found[k : k + words]) for k in range(max(1, len(found) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def brute(rows, radius=4):
    """{id: (fingerprint, component)} by union over all pairs."""
    prints = {i: plain(t) for i, t in rows}
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    array = np.array([prints[i] for i in ids], np.uint64)
    for k, i in enumerate(ids):
        for j in np.flatnonzero(np.bitwise_count(array[k + 1 :] ^ array[k]) <= radius):
            a, b = sorted((find(i), find(ids[k + 1 + j])))
            root[b] = a
    return {i: (f"{prints[i]:016x}", find(i)) for i in ids}


def test_query_against_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table("/root/testdata/sf0.01/documents.parquet").to_pylist()]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op4_simhash(spark, "/root/testdata/sf0.01").collect()}
    assert got == brute(rows)


def test_close_finds_all_pairs():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    near = base.copy()
    for k in range(300):
        for bit in rng.choice(64, k % 8, replace=False):
            near[k] ^= np.uint64(1) << np.uint64(bit)
    everything = np.concatenate([base, near, base[:50]])
    for block in (everything, everything[:1], everything[:64], everything[:65]):
        q, b = simhash.close(everything, block)
        expected = np.bitwise_count(everything[:, None] ^ block[None, :]) <= 4
        found = np.zeros_like(expected)
        found[q, b] = True
        assert (found == expected).all()


def test_bands_keep_every_link():
    for rows in (10, 10**8, 10**10, 10**12):
        bands = simhash.bands_for(rows)
        masks = simhash._masks(bands, 4)
        rng = np.random.default_rng(rows % 97)
        for _ in range(200):
            flipped = sum(1 << int(i) for i in rng.choice(64, 4, replace=False))
            assert any(flipped & m == 0 for m in masks)


def test_hot_groups(spark, monkeypatch):
    """Buckets beyond the block bound are dealt out without losing links."""
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rng = np.random.default_rng(5)
    centre = int(rng.integers(0, 1 << 63))
    prints = [centre ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 30, (200, 2))] + [centre] * 50 + [int(x) for x in rng.integers(0, 1 << 63, 100)]
    df = spark.createDataFrame([(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(prints)], "id long, fp long")
    got = {r.id: r.component for r in simhash.groups(df, "id", "fp").collect()}
    assert all(got[i] == 0 for i in range(250))
    assert all(got[i] == i for i in range(250, 350))


def test_edges(spark):
    rows = [(7, None), (3, ""), (5, " \t "), (9, "one"), (8, "ONE"), (2, "w " * 50_000), (2, "w " * 50_000), (4, "a b c d e f\x0bg"), (6, "É é")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fp string")
    got = [(r.id, r.fp, r.component) for r in simhash.near_duplicates(df).collect()]
    assert len(got) == len(rows)
    signed = {i: (plain(t) ^ (1 << 63)) - (1 << 63) for i, t in rows}
    assert all(fp == signed[i] for i, fp, _ in got)
    found = {i: c for i, _, c in got}
    assert found[7] == found[3] == found[5] == 3 and found[8] == found[9] == 8
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(100, 160)] + [(5, 300 + i) for i in range(100)] + [(9, 9), (20, 21), (21, 20)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 100 for i in range(100, 161)) and all(got[300 + i] == 5 for i in range(100)) and got[21] == got[20] == 20
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
