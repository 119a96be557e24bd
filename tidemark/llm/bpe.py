"""Byte-level BPE as a lazily determinised finite-state transducer, and streaming decoding.

A sequence of tokens is the encoding of its bytes exactly when every adjacent pair of its tokens is the
encoding of the pair's bytes. That local condition makes encoding a finite-state transduction: a
configuration is (last complete token, bytes of the unfinished token). Reading a byte extends every unfinished token
that still is a prefix of some token, and also closes it where it is a token that may follow the last one. The
determinised state is the set of configurations; the token closed in it is the last one of the input so far, so tokens
are read off backwards. In long inputs those that all configurations share are emitted after a bounded lookahead.
States and transitions are built when needed, kept from their second use and forgotten when there are too many. Pieces
that are tokens are not walked through, and the ids of recent short segments are kept beside the transducer.

Decoding is a stream as well: every byte is read by a state machine of well-formed UTF-8.

Null texts encode as empty ones: no tokens. Repeated rows and extra columns pass through unchanged; an empty
table gives an empty table with the same columns. Lengths of text are bounded by memory of one row only.
"""

from __future__ import annotations

import base64
import re
import struct
import sys
from array import array
from collections.abc import Callable, Iterable, Iterator, Mapping
from itertools import accumulate
from operator import getitem

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import fresh, table

STATES = 200_000
PAIRS = 400_000
SEGMENTS = 120_000
"""Bounds of a worker's memory (about 180 MB in all): what is beyond them is forgotten and made again when needed."""
LEAN = 0.65
"""Share of these bounds for a worker whose memory other stages need too."""
MET = 1 << 20
NODE = 24
LOW = (1 << NODE) - 1
LOOKAHEAD = 1_024
"""Bytes after which the tokens are emitted that are certain by then; far more than the longest token."""
SLICE = 256
DECODE_CHUNK = 1 << 16
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
"""Unicode's white space, as a character class."""
WORD = " ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]++(?=[\\x00-@\\[-`{-\\x7f]|\\Z)"
"""A run of Latin letters that ends where the text does or before an ASCII character that is no letter."""
SEGMENT = f"{WORD}| ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
"""Cuts text only where a pattern cuts it whose matches have white space at most as one leading space or alone, and end behind a run of letters."""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines) if token}


class Transducer:
    """From bytes to token ids, for one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], share: float = 1.0):
        self.most_states, self.most_pairs = int(STATES * share), int(PAIRS * share)
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        # The trie of the tokens: node * 256 + byte to node, root 0; by node the token that ends there (or -1), its depth, and whether it has children.
        self.child: dict[int, int] = {}
        self.token_at, self.depth = [-1], bytearray(1)
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                following = self.child.setdefault(node * 256 + byte, len(self.token_at))
                if following == len(self.token_at):
                    self.token_at.append(-1)
                    self.depth.append(min(255, self.depth[node] + 1))
                node = following
            self.token_at[node] = rank
        self.inner = bytearray(len(self.token_at))
        for key in self.child:
            self.inner[key >> 8] = 1
        # By a token's place: its halves as (left + 1) << 32 | right; 0: not split yet, 1: a single byte. An array, as small objects that stay would hold forgotten ones' memory.
        self.place = {token: place for place, token in enumerate(self.tokens)}
        self.halves = array("Q", bytes(8 * len(self.place)))
        self.packed: dict[bytes, State] = {}
        self.forget()

    def forget(self) -> None:
        """Drop all states, transitions and known pairs; the vocabulary stays."""
        for state in self.packed.values():
            state.clear()
        # The kept states by their packed configurations, oldest first: (last complete token + 1) << NODE | node of the unfinished one.
        self.start = State(self, pack([0]), 0)
        self.packed = {self.start.configs: self.start}
        self.pairs: dict[int, bool] = {}
        self.met = bytearray(MET)

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes a token last; None for a single byte."""
        place = self.place[token]
        known = self.halves[place]
        if not known:
            text = self.tokens[token]
            parts = [text[i : i + 1] for i in range(len(text))]
            while len(parts) > 2:
                at = min(range(len(parts) - 1), key=lambda i: (self.ranks.get(parts[i] + parts[i + 1], 1 << 60) if len(parts[i]) + len(parts[i + 1]) < len(text) else 1 << 60, i))
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            known = self.halves[place] = self.ranks[parts[0]] + 1 << 32 | self.ranks[parts[1]] if len(parts) == 2 else 1
        return None if known == 1 else ((known >> 32) - 1, known & 0xFFFFFFFF)

    def may_follow(self, left: int, right: int) -> bool:
        """Whether the two tokens stay apart when their bytes stand together.

        Their merges are undone at the seam, the latest first. A merge across the seam would have come
        before one of those undone if its rank is lower (on the right side: as low, as pairs go from the left).
        """
        if left < 0:
            return True
        known = self.pairs.get(left << 32 | right)
        if known is not None:
            return known
        a, b, limit = left, right, 1 << 60
        apart = True
        while True:
            across = self.ranks.get(self.tokens[a] + self.tokens[b])
            if across is not None and across < limit:
                apart = False
                break
            halves_a, halves_b = self.split(a), self.split(b)
            if halves_a is None and halves_b is None:
                break
            if halves_b is None or halves_a is not None and a > b:
                a, limit = halves_a[1], a
            else:
                b, limit = halves_b[0], b + 1
        self.pairs[left << 32 | right] = apart
        return apart

    def step(self, configs: bytes, byte: int) -> bytes:
        """The configurations after one more byte. The last of them has the token that ends here, and a new one begun."""
        found = []
        closed = -1
        child, inner, token_at, pairs = self.child.get, self.inner, self.token_at, self.pairs.get
        for c in unpack(configs):
            node = child((c & LOW) << 8 | byte)
            if node is None:
                continue
            if inner[node]:
                found.append(c & ~LOW | node)
            if closed < 0:
                token = token_at[node]
                if token >= 0:
                    last = (c >> NODE) - 1
                    apart = pairs(last << 32 | token)
                    if self.may_follow(last, token) if apart is None else apart:
                        closed = token
        if closed < 0:
            raise ValueError("the vocabulary lacks single bytes of this text")
        found.append(closed + 1 << NODE)
        return pack(found)

    def move(self, state: State, byte: int) -> State:
        """The next state. It and the transition are kept from the second use on."""
        configs = self.step(state.configs, byte)
        known = self.packed.get(configs)
        if state.number < 0:
            return State(self, configs) if known is None else known
        if known is None:
            # Most are met once only. Two keys may share a mark; one is then kept early.
            mark = (state.number << 8 | byte) % MET
            if not self.met[mark]:
                self.met[mark] = 1
                return State(self, configs)
            if len(self.packed) >= self.most_states or len(self.pairs) >= self.most_pairs:
                self.forget()
                return State(self, configs)
            known = self.packed[configs] = State(self, configs, len(self.packed))
        state[byte] = known
        return known

    def encode(self, piece: bytes) -> list[int]:
        """Token ids of one piece; a piece that is a token is that token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        out: list[int] = []
        states = [self.start]  # behind each byte since the last emission
        for start in range(0, len(piece), LOOKAHEAD):
            if start:
                cut = self.agreed(states)
                out += self.trace(states, cut)
                del states[:cut]
            states = [*states[:-1], *accumulate(piece[start : start + LOOKAHEAD], getitem, initial=states[-1])]
        return out + self.trace(states, len(states) - 1)

    def trace(self, states: list[State], at: int) -> list[int]:
        """The tokens up to a place, read from the last one back."""
        out, tokens = [], self.tokens
        while at:
            token = states[at].closed
            out.append(token)
            at -= len(tokens[token])
        return out[::-1]

    def agreed(self, states: list[State]) -> int:
        """How far all configurations of the last state have the same tokens."""
        shared: set[int] | None = None
        for c in unpack(states[-1].configs):
            at = len(states) - 1 - self.depth[c & LOW]
            places = {at}
            while at:
                at -= len(self.tokens[states[at].closed])
                places.add(at)
            shared = places if shared is None else shared & places
        return max(shared)


class State(dict):
    """A determinised state with its known transitions, by byte; those that are missing are made."""

    __slots__ = ("transducer", "configs", "number", "closed")

    def __init__(self, transducer: Transducer, configs: bytes, number: int = -1):
        self.transducer, self.configs, self.number = transducer, configs, number  # -1: not kept
        self.closed = closed_in(configs)  # the token that is complete where the input ends here

    def __missing__(self, byte: int) -> State:
        return self.transducer.move(self, byte)


def pack(configs: list[int]) -> bytes:
    return array("Q", configs).tobytes()


def unpack(configs: bytes) -> list[int]:
    return memoryview(configs).cast("Q").tolist()


def closed_in(configs: bytes) -> int:
    return (int.from_bytes(configs[-8:], sys.byteorder) >> NODE) - 1


class Asking(dict):
    """A dictionary that asks a function for the keys it does not hold."""

    def __init__(self, ask: Callable):
        self.ask = ask

    def __missing__(self, key):
        return self.ask(key)


class Recent:
    """Results by key, made when asked for and kept from a key's second use on. When full, what was not used since the last time goes."""

    def __init__(self, bound: int, make: Callable[[str], bytes]):
        self.bound, self.make = bound, make
        self.young = Asking(self.find)
        self.clear()

    def clear(self) -> None:
        self.young.clear()
        self.old: dict = {}
        self.met = bytearray(MET)

    def find(self, key: str) -> bytes:
        """What the young ones lack. Long keys are not kept."""
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        if len(key) <= 64:
            self.put(key, found)
        return found

    def put(self, key: str, value: bytes) -> None:
        # Two keys may share a mark; one is then kept from its first use.
        mark = hash(key) % MET
        if not self.met[mark]:
            self.met[mark] = 1
        else:
            if len(self.young) >= self.bound:
                self.old = dict(self.young)
                self.young.clear()
                self.met = bytearray(MET)
            self.young[key] = value


class Encoder:
    """Whole texts to their packed ids: by known segments, or by their pieces and the transducer."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, segment: str | None, lean: bool = False):
        import regex

        self.lean = lean
        share = LEAN if lean else 1.0
        self.transducer = Transducer(ranks, share)
        self.split = regex.compile(pattern).findall
        self.segments = re.compile(segment).findall if segment else lambda text: [text]
        self.known = Recent(int(SEGMENTS * share), self.segment)

    def segment(self, segment: str) -> bytes:
        ids = [i for piece in self.split(segment) for i in self.transducer.encode(piece.encode())]
        return struct.pack(f"<{len(ids)}I", *ids)

    def packed(self, text: str) -> bytes:
        return b"".join(map(self.known.young.__getitem__, self.segments(text)))

    def release(self) -> None:
        """Drop the known segments; what the transducer has learnt stays, unless it is lean, which also gives back memory of past batches."""
        self.known.clear()
        if self.lean:
            self.transducer.forget()
            pa.default_memory_pool().release_unused()


# --- UTF-8: byte classes and transitions, from the table of well-formed sequences in the Unicode standard

ACCEPT, REJECT = 0, 1


def _utf8_machine() -> list[list[int]]:
    """machine[state][byte]: 0 accepts, 1 rejects; the others wait for continuation bytes of a given range."""
    states: dict[tuple, int] = {}
    machine = [[REJECT] * 256, [REJECT] * 256]

    def state(*ranges: tuple[int, int]) -> int:
        if not ranges:
            return ACCEPT
        if ranges not in states:
            states[ranges] = len(machine)
            machine.append([REJECT] * 256)
            row = machine[states[ranges]]
            low, high = ranges[0]
            following = state(*ranges[1:])
            for b in range(low, high + 1):
                row[b] = following
        return states[ranges]

    tail = (0x80, 0xBF)
    for first, last, *ranges in (
        (0x00, 0x7F), (0xC2, 0xDF, tail), (0xE0, 0xE0, (0xA0, 0xBF), tail), (0xE1, 0xEC, tail, tail), (0xED, 0xED, (0x80, 0x9F), tail), (0xEE, 0xEF, tail, tail),
        (0xF0, 0xF0, (0x90, 0xBF), tail, tail), (0xF1, 0xF3, tail, tail, tail), (0xF4, 0xF4, (0x80, 0x8F), tail, tail),
    ):
        for b in range(first, last + 1):
            machine[ACCEPT][b] = state(*ranges)
    return machine


UTF8 = _utf8_machine()


def utf8_run(data: bytes) -> tuple[str, bytes]:
    """Text of the bytes, each of them read by the machine, and what is left of an unfinished character at the end.

    Each longest beginning of a character that goes on wrongly gives one U+FFFD, as does each byte that begins none.
    """
    out: list[str] = []
    state, whole, start = ACCEPT, 0, 0  # well-formed text from `whole` to `start`, where the character being read begins
    for at, byte in enumerate(data):
        following = UTF8[state][byte]
        if following == REJECT:
            out += (data[whole:start].decode(), "\ufffd")
            whole = start = at
            following = UTF8[ACCEPT][byte] if state != ACCEPT else REJECT
            if following == REJECT:
                if state != ACCEPT:
                    out.append("\ufffd")
                whole, following = at + 1, ACCEPT
        state = following
        if state == ACCEPT:
            start = at + 1
    return "".join([*out, data[whole:start].decode()]), data[start:]


class StreamDecoder:
    """Feed token ids in any portions, get text as soon as its bytes are complete; malformed bytes give U+FFFD.

    All bytes go through the state machine. What it makes of a token that begins between two characters is
    always the same and kept; a token that begins inside a character is read with what is held of that one.
    """

    def __init__(self, tokens: Mapping[int, bytes], known: tuple[dict[int, tuple[str, bytes]], dict[int, str]] | None = None) -> None:
        self.tokens, self.held = tokens, b""
        self.known, self.whole = ({}, {}) if known is None else known

    def feed(self, ids: Iterable[int]) -> str:
        out, held, known = [], self.held, self.known
        if not held:
            try:  # tokens that are whole characters, all of them met before
                return "".join(map(self.whole.__getitem__, ids))
            except KeyError:
                pass
        for i in ids:
            if held:
                text, held = utf8_run(held + self.tokens[i])
            else:
                made = known.get(i)
                if made is None:
                    made = known[i] = utf8_run(self.tokens[i])
                    if not made[1]:
                        self.whole[i] = made[0]
                text, held = made
            out.append(text)
        self.held = held
        return "".join(out)

    def finish(self) -> str:
        rest, self.held = self.held, b""
        return "\ufffd" if rest else ""


# --- Spark

_made: dict[tuple, object] = {}


def _encoder(path: str, pattern: str, segment: str | None, lean: bool = False) -> Encoder:
    key = ("encoder", path, pattern, segment, lean)
    if key not in _made:
        _made[key] = Encoder(read_ranks(path), pattern, segment, lean)
    return _made[key]


def _with(df: DataFrame, column: str, function, made: dict[str, T.DataType], replace: bool) -> DataFrame:
    """df with columns made from another by mapInArrow, beside or in place of that one."""
    at = df.columns.index(column)
    kept = [i for i in range(len(df.columns)) if not (replace and i == at)]
    fields = [df.schema.fields[i] for i in kept]
    names = fresh(df.select(*(df[f"`{f.name}`"] for f in fields)) if replace else df, *made)
    kinds = [pa.binary() if isinstance(kind, T.BinaryType) else pa.string() for kind in made.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        one, release = function()
        for whole in batches:
            for start in range(0, whole.num_rows, SLICE):
                batch = whole.slice(start, SLICE)
                values = [one(v.as_py()) for v in batch.column(at)]
                columns = [pa.array([v[k] for v in values], kind) for k, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), *columns], names=[*(f.name for f in fields), *names])
        release()

    return df.mapInArrow(run, T.StructType([*fields, *(T.StructField(n, k) for n, k in zip(names, made.values()))]))


def _decoded(packed: bytes, tokens: Mapping[int, bytes], known: tuple[dict[int, tuple[str, bytes]], dict[int, str]]) -> str:
    found = memoryview(packed).cast("I")
    stream, out = StreamDecoder(tokens, known), []
    for at in range(0, len(found), DECODE_CHUNK):
        out.append(stream.feed(found[at : at + DECODE_CHUNK]))
    out.append(stream.finish())
    return "".join(out)


def encode(
    df: DataFrame, text: str, ranks_path: str, pattern: str, to: str = "ids", segment: str | None = None, replace: bool = False, decoded: str | None = None, lean: bool = False
) -> DataFrame:
    """Add `to`: the token ids of every whole text, packed as little-endian unsigned 32-bit integers (null: no ids).

    `segment` may name a cheaper pattern that cuts only where `pattern` cuts too. `replace` drops the texts. `decoded`
    names a further column for what the ids decode to, made in the same worker with the same vocabulary. `lean` bounds
    what a worker keeps more tightly, and lets it keep the vocabulary alone between tasks; else what one task has learnt
    serves the worker's next one. Ids are the same.
    """

    def worker():
        encoder = _encoder(ranks_path, pattern, segment, lean)
        tokens, known = encoder.transducer.tokens, ({}, {})

        def one(value: str | None) -> tuple:
            packed = encoder.packed(value) if value else b""
            return (packed,) if decoded is None else (packed, _decoded(packed, tokens, known))

        return one, encoder.release if lean else lambda: None

    made = {to: T.BinaryType()} | ({} if decoded is None else {decoded: T.StringType()})
    return _with(df, text, worker, made, replace)


def decode(df: DataFrame, ids: str, ranks_path: str, to: str = "decoded", replace: bool = False) -> DataFrame:
    """Add `to`: the text of packed token ids (null: empty text), decoded as a stream of bounded portions."""

    def worker():
        if ("tokens", ranks_path) not in _made:
            _made["tokens", ranks_path] = {i: t for t, i in read_ranks(ranks_path).items()}
        tokens, known = _made["tokens", ranks_path], ({}, {})
        return lambda packed: (_decoded(packed or b"", tokens, known),), lambda: None

    return _with(df, ids, worker, {to: T.StringType()}, replace)


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and what they decode to, as digests. Null texts count as empty."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return digests(encode(docs, "text", path, public_tokenizers.PATTERN, segment=SEGMENT, replace=True, decoded="decoded"))


def digests(encoded: DataFrame, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """The other columns, with count and hash of the packed ids, and hash of the bytes they decode to."""
    kept = [c for c in encoded.columns if c not in (ids, decoded)]
    return encoded.select(*kept, (F.octet_length(ids) / 4).cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2(F.col(decoded).cast("binary"), 256).alias("decoded_sha256"))
