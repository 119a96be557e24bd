import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq_file
import pytest

from tidemark.llm import pq


def brute(ids, vectors, threshold=0.9):
    """{id: (links, component)} over all pairs."""
    x = np.array(vectors, np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    link = x @ x.T >= threshold
    np.fill_diagonal(link, False)
    label = np.array(ids)
    while True:
        new = np.minimum(label, np.where(link, label[None, :], np.iinfo(np.int64).max).min(1))
        if (new == label).all():
            return {i: (int(n), int(c)) for i, n, c in zip(ids, link.sum(1), label)}
        label = new


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_against_brute_force(spark, sf):
    rows = pq_file.read_table(f"/root/testdata/{sf}/embeddings.parquet").to_pylist()
    expected = brute([r["vec_id"] for r in rows], [r["embedding"] for r in rows])
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in pq.op10_embeddings(spark, f"/root/testdata/{sf}").collect()}
    assert got.keys() == expected.keys()
    assert all(got[i][0] <= expected[i][0] for i in got)  # none below the threshold
    assert sum(g[0] for g in got.values()) >= 0.98 * sum(e[0] for e in expected.values())
    assert sum(got[i][1] == expected[i][1] for i in got) >= 0.99 * len(got)
    assert all(k == (i == c) for i, (_, c, k) in got.items())


def test_lists_in_parts(spark, monkeypatch):
    """Groups far beyond the bounds of lists and parts: every link is counted once."""
    monkeypatch.setattr(pq, "PART", 32)
    monkeypatch.setattr(pq, "LIST_SIZE", 40)
    rng = np.random.default_rng(2)
    centre = rng.normal(size=16)
    vectors = [centre + rng.normal(size=16) * 0.05 for _ in range(150)] + [rng.normal(size=16) for _ in range(100)] + [centre] * 30
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    expected = brute(list(range(280)), vectors)
    got = {r.id: (r.n_links, r.component) for r in pq.near_duplicates(df, probes=100).collect()}
    assert got == expected


def planted(pairs, alone, size, seed):
    """Vectors in pairs at a cosine from 0.9 to 0.95, and others, none of which is near to any."""
    rng = np.random.default_rng(seed)
    one = rng.normal(size=(pairs, size))
    one /= np.linalg.norm(one, axis=1)[:, None]
    aside = rng.normal(size=one.shape)
    aside -= (aside * one).sum(1)[:, None] * one
    aside /= np.linalg.norm(aside, axis=1)[:, None]
    cosine = rng.uniform(0.9001, 0.95, pairs)[:, None]
    return np.concatenate([one, cosine * one + np.sqrt(1 - cosine**2) * aside, rng.normal(size=(alone, size))])


def test_planted_pairs_over_a_hundred_lists(spark):
    """Production parameters, 60,000 vectors of 64 components in 118 lists: nearly all planted links, and the same under another partitioning."""
    vectors = planted(8_000, 44_000, 64, 11)
    columns = pa.table({"vec_id": pa.array(range(len(vectors)), pa.int64()), "embedding": pa.array(vectors.tolist(), pa.list_(pa.float64()))})
    results = []
    for parts in (3, 11):
        df = spark.createDataFrame(columns).repartition(parts)
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        results.append({r.id: (r.n_links, r.component) for r in pq.near_duplicates(df).collect()})
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    found = sum(results[0][i][0] for i in range(16_000))
    assert results[0] == results[1]
    assert 0.98 * 16_000 <= found <= 16_000 and not any(results[0][i][0] for i in range(16_000, 60_000))
    assert sum(results[0][i + 8_000][1] == i for i in range(8_000)) == found // 2


def test_recall_with_many_lists(spark, monkeypatch):
    """Far more lists than PROBES, with near copies spread over several of them; probes as they are by default."""
    monkeypatch.setattr(pq, "LIST_SIZE", 4)
    rng = np.random.default_rng(3)
    groups = rng.normal(size=(60, 32))
    vectors = np.concatenate([np.repeat(groups, 80, axis=0) + rng.normal(size=(4800, 32)) * 0.2, rng.normal(size=(1200, 32))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    expected = brute(list(range(6000)), vectors)
    got = {r.id: r.n_links for r in pq.near_duplicates(df).collect()}
    links = sum(n for n, _ in expected.values())
    assert links > 100_000 and all(got[i] <= expected[i][0] for i in got)
    assert sum(got.values()) >= 0.98 * links, sum(got.values()) / links


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 0.0]), (8, [2.0, 0.0]), (8, [2.0, 0.0]), (9, [1.0, 0.0, 0.0]), (10, [1.0]), (11, [0.0, 1.0]), (12, [-0.0, 1.0])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, n_links int, v string")
    got = sorted((r.id, r.n_links, r.component) for r in pq.near_duplicates(df).collect())
    assert got == [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 0, 6), (7, 2, 7), (8, 2, 7), (8, 2, 7), (9, 0, 9), (10, 0, 10), (11, 1, 11), (12, 1, 11)]
    assert pq.near_duplicates(df.limit(0)).count() == 0
