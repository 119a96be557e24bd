import gc
import hashlib
import sys

import public_tokenizers as P
import pyarrow.parquet as pq
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")
RANKS = bpe.read_ranks(PATH)
KNOWN = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
FST = bpe.Transducer(RANKS)
SEGMENTED = bpe.Encoder(RANKS, P.PATTERN, bpe.SEGMENT)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=40), st.text(alphabet="abetn ", max_size=60), st.text(alphabet="a \n", max_size=80)))
def test_pieces_like_tiktoken(text):
    import regex

    got = [i for piece in regex.findall(P.PATTERN, text) for i in FST.encode(piece.encode())]
    assert got == KNOWN.encode_ordinary(text)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=40), st.text(alphabet="a1.' \n\t\x1c\x85\xa0\u2003\u3000\u200b", max_size=40)))
def test_segments_keep_the_pieces(text):
    assert SEGMENTED.packed(text) == b"".join(i.to_bytes(4, "little") for i in KNOWN.encode_ordinary(text))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aZ\u00e9\u024f\u0250\u0301\u00b2\u00aa\u00d7\u4e2d\u0378'st.,[`{\x7f_1 \n\x00\x1c\u2003", max_size=40))
def test_segments_end_behind_words_where_pieces_do(text):
    assert SEGMENTED.packed(text) == b"".join(i.to_bytes(4, "little") for i in KNOWN.encode_ordinary(text))


def test_words_are_encoded_twice_at_most(monkeypatch):
    """Whatever mark follows a word, and in whatever task of a worker it is met: it is made until its second use only."""
    made = []
    encoded = bpe.Encoder.segment
    monkeypatch.setattr(bpe.Encoder, "segment", lambda self, segment: made.append(segment) or encoded(self, segment))
    monkeypatch.setattr(bpe, "_made", {})
    monkeypatch.setattr(bpe, "_with", lambda df, column, function, made, replace: function)
    worker = bpe.encode(None, "text", PATH, P.PATTERN, segment=bpe.SEGMENT)
    text = "A zanthorble, zanthorble. zanthorble; zanthorble's zanthorble\n zanthorble) zanthorble"
    ids = b"".join(i.to_bytes(4, "little") for i in KNOWN.encode_ordinary(text))
    for _ in range(3):
        one, release = worker()
        assert one(text) == (ids,)
        release()
    assert sum("zanthorble" in segment for segment in made) == 2


def test_words_of_the_documents():
    words = {w for t in pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist() if t for w in t.split(" ")}
    for w in words:
        import regex

        assert [i for piece in regex.findall(P.PATTERN, " " + w) for i in FST.encode(piece.encode())] == KNOWN.encode_ordinary(" " + w)


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=60), st.lists(st.integers(0, 60), max_size=8))
def test_stream_decoding_in_any_portions(data, cuts):
    edges = [0, *sorted({min(c, len(data)) for c in cuts}), len(data)]
    tokens = {i: data[a:b] for i, (a, b) in enumerate(zip(edges, edges[1:]))}
    stream = bpe.StreamDecoder(tokens)
    out = "".join(stream.feed([i]) for i in tokens) + stream.finish()
    assert out == data.decode("utf-8", "replace")
    whole = bpe.StreamDecoder(tokens)
    assert whole.feed(list(tokens)) + whole.finish() == out


def test_forgetting_changes_no_ids(monkeypatch):
    """Bounds far below what the texts need: all is forgotten again and again, and ids stay the same."""
    for name, bound in (("STATES", 40), ("PAIRS", 60), ("SEGMENTS", 5), ("MET", 1 << 8), ("LOOKAHEAD", 200)):
        monkeypatch.setattr(bpe, name, bound)
    small = bpe.Encoder(RANKS, P.PATTERN, bpe.SEGMENT)
    for text in pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()[:60]:
        text = (text or "")[::-1][:4000]
        assert small.packed(text) == b"".join(i.to_bytes(4, "little") for i in KNOWN.encode_ordinary(text))
        assert len(small.transducer.packed) <= 40 and len(small.known.young) <= 5
    small.release()
    assert not small.known.young and not small.known.old
    lean = bpe.Encoder(RANKS, P.PATTERN, bpe.SEGMENT, lean=True)
    assert lean.packed("unbelievably odd") == small.packed("unbelievably odd")
    lean.release()
    assert len(lean.transducer.packed) == 1


def test_lean_workers_keep_the_vocabulary_alone():
    texts = [t for t in pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()[:60] if t]
    lean = bpe.Encoder(RANKS, P.PATTERN, bpe.SEGMENT, lean=True)
    gc.collect()
    blocks = sys.getallocatedblocks()
    for text in texts:
        lean.packed(text[::-1])
    assert sys.getallocatedblocks() - blocks > 20_000
    lean.release()
    gc.collect()
    assert sys.getallocatedblocks() - blocks < 500


def test_long_pieces_emit_before_their_end(monkeypatch):
    monkeypatch.setattr(bpe, "LOOKAHEAD", 64 + max(map(len, RANKS)))
    for piece in ("ab" * 3_000, "".join(sorted("thequickbrownfox" * 300)), "\u00e9\u4e2d" * 900, "a" * 5_000):
        assert FST.encode(piece.encode()) == KNOWN.encode_ordinary(piece)


def test_frame(spark):
    texts = [(1, None, "x"), (2, "", "x"), (3, "<|endoftext|> it's 100 \U0001f600 éé  \n\n end ", "x"), (3, "the " * 30_000, "x"), (4, " 　 a\x00b", None)]
    df = spark.createDataFrame(texts, "doc_id long, text string, ids string")
    got = bpe.decode(bpe.encode(df, "text", PATH, P.PATTERN), "ids_", PATH).collect()
    assert sorted(r.doc_id for r in got) == [1, 2, 3, 3, 4]
    for r in got:
        ids = KNOWN.encode_ordinary(r.text or "")
        assert bytes(r.ids_) == b"".join(i.to_bytes(4, "little") for i in ids)
        assert r.decoded == (r.text or "")
    assert bpe.encode(df.limit(0), "text", PATH, P.PATTERN).count() == 0


def test_query(spark):
    rows = {r["doc_id"]: r["text"] or "" for r in pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()}
    got = bpe.op1_byte_bpe(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(rows)
    for r in got:
        ids = KNOWN.encode_ordinary(rows[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(rows[r.doc_id].encode()).hexdigest()
