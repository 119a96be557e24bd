import hashlib
import re
from collections import defaultdict

import public_tokenizers as P
import pyarrow as pa
import pyarrow.parquet as pq
import tiktoken

import corpus_pipeline as pipeline
from tests.llm.test_mixing import fill
from tests.llm.test_simhash import brute
from tidemark.llm import bpe, mixing, secrets, toxicity
from tidemark.llm.common import BATCH_SETTING, READ_ROWS, READ_SETTING

D = "/root/testdata/sf0.001"


def mixed_by_definition(leaves, budget):
    """Ids taken: shares level by level, then the longest prefix in the seeded order; for at most one epoch."""
    shares = {(): min(budget, sum(n for docs in leaves.values() for _, n in docs))}
    for depth in range(3):
        for parent in {k[:depth] for k in leaves}:
            rooms = defaultdict(int)
            for k, docs in leaves.items():
                if k[:depth] == parent:
                    rooms[k[depth]] += sum(n for _, n in docs)
            found = fill(shares[parent], {c: (mixing.WEIGHTS[depth].get(c, 1), room) for c, room in rooms.items()})
            shares |= {(*parent, c): n for c, n in found.items()}
    taken = set()
    for leaf, docs in leaves.items():
        total = sum(n for _, n in docs)
        if total and shares[leaf] >= total:
            taken |= {i for i, _ in docs}
            continue
        used = 0
        for i, n in sorted(docs, key=lambda d: hashlib.md5(f"{mixing.SEED}-0-{d[0]}".encode()).hexdigest()):
            used += n
            if used > shares[leaf] or not shares[leaf]:
                break
            taken.add(i)
    return taken


def test_stages_against_brute_force(spark):
    """Each stage on what its predecessor kept, compared row by row."""
    docs = spark.read.parquet(f"{D}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    model = toxicity.fit(docs, spark.read.parquet(f"{D}/labels.parquet"), "toxic", toxicity.fold("doc_id", 5) != 0)
    toxic = {r.doc_id for r in model.score(docs).filter("score >= 0.5").collect()}
    calm = pipeline.drop_toxic(spark, docs, D)
    assert calm.columns == docs.columns and {r.doc_id for r in calm.collect()} == rows.keys() - toxic
    lone = pipeline.drop_near_copies(spark, calm, D)
    groups = brute([(i, t) for i, t in rows.items() if i not in toxic])
    assert sorted(r.doc_id for r in lone.collect()) == sorted({c for _, c in groups.values()})
    masked = pipeline.mask_secrets(spark, lone, D)
    found = {r.doc_id: [s.text for s in r.secrets] for r in secrets.fit(spark).scan(lone).collect()}
    for r in masked.collect():
        text = rows[r.doc_id]
        for s in found[r.doc_id]:
            text = text.replace(s, "[SECRET]", 1)
        assert r.text == text and r.n_chars == len(text)
    mixed = pipeline.mix_sources(spark, masked, D)
    have, kept = ({r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in df.collect()} for df in (masked, mixed))
    leaves = defaultdict(list)
    for r in masked.collect():
        leaves[f"d{ord((r.source or chr(0))[-1]) % 3}", r.lang or "", r.source or ""].append((r.doc_id, have[r.doc_id]))
    assert kept.keys() == mixed_by_definition(leaves, sum(have.values()) * pipeline.MIX_PERCENT // 100)
    ranks = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    known = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r.doc_id: r.text for r in mixed.collect()}
    for r in pipeline.tokenise(spark, mixed, D).collect():
        ids = known.encode_ordinary(texts[r.doc_id])
        assert bytes(r.token_ids) == b"".join(i.to_bytes(4, "little") for i in ids) and r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_run_and_edges(spark, tmp_path):
    d = str(tmp_path)
    rows = [(1, "a plain text of some words", "en", "s", 5), (1, "a plain text of some words", "en", "s", 5), (2, None, None, None, None), (3, "", "en", "s", 0), (None, "no id here at all", "en", "s", 1), (4, "w " * 30_000, "en", "t", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, d)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert pipeline.run(spark, d).count() <= 5
    assert pq.read_table("/root/testdata/sf0.001/documents.parquet").num_rows >= pipeline.run(spark, D).count() > 50
    empty = str(tmp_path / "empty")
    for name in ("documents", "labels"):
        spark.read.parquet(f"{d}/{name}.parquet").limit(0).write.parquet(f"{empty}/{name}.parquet")
    assert pipeline.run(spark, empty).count() == 0


def test_near_copies_with_repeated_ids_and_clashing_names(spark):
    """Different texts of one id are judged apart, equal ones are one; columns named like the stage's own pass through."""
    one, two, three = ("alpha beta gamma delta epsilon zeta eta theta", "one two three four five six seven eight nine", "un deux trois quatre cinq six sept huit neuf dix")
    rows = [(1, one), (2, two), (2, three), (2, three), (3, two), (4, three), (5, "quite another text of its own with words"), (None, one)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), 7, -1, 1.0, "x", 0, 9) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, fp long, root int, toxicity double, row string, copies int, copy int")
    got = pipeline.drop_near_copies(spark, docs, D)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id or 0), r.text) for r in got.collect()) == sorted([(0, one), (1, one), (2, two), (2, three), (5, rows[6][1])])
    assert pipeline.drop_toxic(spark, docs, D).columns == docs.columns
    mixed = pipeline.mix_sources(spark, docs, D)
    assert mixed.columns == docs.columns and {r.copies for r in mixed.collect()} <= {0} and {r.copy for r in mixed.collect()} <= {9}


def test_texts_reach_workers_in_bounded_batches(spark):
    """No stage hands a worker a whole partition of texts at once; a bound that the session sets itself stays."""
    docs = spark.read.parquet(f"{D}/documents.parquet")
    large = spark.range(0, 24, 1, 1).selectExpr("repeat('x', 1000000) text")

    def most():
        def sizes(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["size"])

        found = [r.size for r in large.mapInArrow(sizes, "size long").collect()]
        assert sum(found) > 24_000_000
        return max(found)

    try:
        for stage in (pipeline.drop_toxic, pipeline.drop_near_copies, pipeline.tokenise):
            spark.conf.unset(BATCH_SETTING)
            stage(spark, docs, D)
            assert most() < 6_000_000, stage
        spark.conf.set(BATCH_SETTING, "16m")
        pipeline.tokenise(spark, docs, D)
        assert 12_000_000 < most() < 18_000_000
    finally:
        spark.conf.unset(BATCH_SETTING)


def test_stages_read_few_rows_at_a_time(spark):
    """All stages bound the rows of a column batch; a bound that the session sets itself stays."""
    docs = spark.read.parquet(f"{D}/documents.parquet").limit(20)
    try:
        for _, stage in pipeline.STAGES:
            spark.conf.unset(READ_SETTING)
            stage(spark, docs, D)
            assert spark.conf.get(READ_SETTING) == READ_ROWS, stage
        spark.conf.set(READ_SETTING, "2048")
        pipeline.tokenise(spark, docs, D)
        assert spark.conf.get(READ_SETTING) == "2048"
    finally:
        spark.conf.unset(READ_SETTING)
        spark.conf.unset(BATCH_SETTING)
