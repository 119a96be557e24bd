"""Progressive JPEG: bytes as coefficients, scans decoded into coefficient arrays, and RGB tensors.

A payload is stored losslessly in a JPEG of its own, one byte a coefficient (value + 2, quantised by 1), in zigzag order,
block after block: luma at full, chroma at half resolution. The file is progressive: scans for DC and for two
spectral bands bring the upper bits (successive approximation), refinement scans the last one. Reading goes scan
by scan into coefficient arrays; numpy then inverts the transform, doubles chroma and converts to RGB.

Two decoders share that: a plain one for any progressive Huffman file, and one that takes all blocks of a batch of
files in step, for files whose scans restart at every block (as written here); it hands others to the plain one.
The transform is done with whole numbers in double precision, so that a text's values don't depend on its batch.

Null texts are empty ones; an empty text is a payload of padding. Repeated rows give equal files; extra columns
pass through; an empty table gives an empty one. A file holds up to 65535 x 65535 pixels, about 6 GB of payload.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import fresh, table

UNIT = 576
SHIFT = 2
BANDS = ((1, 31), (32, 63))
SIZES = ((2, 2), (1, 1), (1, 1))  # sampling factors of Y, Cb, Cr
BATCH_BYTES = 1 << 20


def _zigzag() -> np.ndarray:
    """Natural position of each coefficient in scan order: diagonals, turning at each end."""
    order = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return np.array([8 * r + c for r, c in order])


ZIGZAG = _zigzag()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


# Tables of the writer: a size of 0 to 9 bits has itself as its code of 4 bits; an ended band is one bit, zero.
def _head(width: int, height: int) -> bytes:
    """Everything before the first scan."""
    quant = _segment(0xDB, b"\0" + b"\1" * 64)
    frame = _segment(0xC2, struct.pack(">BHHB", 8, height, width, 3) + b"".join(bytes((i + 1, h << 4 | v, 0)) for i, (h, v) in enumerate(SIZES)))
    lengths = bytes(10 if i == 3 else 0 for i in range(16))
    tables = _segment(0xC4, b"\x00" + lengths + bytes(range(10))) + _segment(0xC4, b"\x10" + lengths + bytes(range(10))) + _segment(0xC4, b"\x11" + bytes((1, *[0] * 15)) + b"\0")
    return b"\xff\xd8" + quant + frame + tables


def _scan(component: int, low: int, high: int, up: int, down: int, table: int) -> bytes:
    return _segment(0xDA, bytes((1, component + 1, (table if low else 0), low, high, up << 4 | down)))


#: The scans of a file: (component, first, last coefficient, previous and own bit position, table, restarts).
SCANS = [(c, 0, 0, 0, 1, 0, 1) for c in range(3)] + [(c, a, b, 0, 1, 0, 1) for c in range(3) for a, b in BANDS] + [(c, 0, 0, 1, 0, 0, 0) for c in range(3)] + [(c, 1, 63, 1, 0, 1, 0) for c in range(3)]


def shape(blocks: int) -> tuple[int, int]:
    """(width, height) in units of 16 pixels that hold so many blocks, six a unit."""
    units = max(1, -(-blocks // 6))
    width = math.isqrt(units - 1) + 1
    return width, -(-units // width)


BIT_LENGTH = np.array([i.bit_length() for i in range(512)], np.uint16)
USED = np.arange(16)[None, :] < np.arange(17)[:, None]  # of 16 bits, those that a code of each length fills


def _stuffed(data: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Entropy-coded bytes with a zero after each 0xFF that is no marker; marks tells the markers' bytes."""
    plain = (data == 0xFF) & ~marks
    return np.insert(data, np.flatnonzero(plain) + 1, 0) if plain.any() else data


def _first_scan(values: np.ndarray, owners: np.ndarray) -> list[bytes]:
    """One restarted interval a block for rows of positive values; owners are file numbers, sorted. Bytes of each file."""
    counts = np.bincount(owners)
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    nth = np.arange(len(owners)) - starts[owners]
    ended = nth == counts[owners] - 1
    # Each row is its codes, ones up to the next byte, and the restart marker: codes of up to 16 bits all of them.
    sizes = BIT_LENGTH[values]
    width = values.shape[1]
    codes, lengths = np.empty((len(values), width + 2), np.uint16), np.empty((len(values), width + 2), np.uint16)
    codes[:, :width] = (sizes << sizes) | values.astype(np.uint16)
    lengths[:, :width] = sizes + 4
    total = lengths[:, :width].sum(1)
    lengths[:, width] = -total.astype(np.int64) % 8
    codes[:, width] = (1 << lengths[:, width]) - 1
    lengths[:, width + 1] = np.where(ended, 0, 16)
    codes[:, width + 1] = 0xFFD0 + nth % 8
    aligned = (codes.astype(np.uint32) << (16 - lengths)).astype(">u2")
    bits = np.unpackbits(aligned.view(np.uint8).reshape(len(values), -1), axis=1)
    flat = np.packbits(bits[USED[lengths].reshape(len(values), -1)])
    size = lengths.sum(1, dtype=np.int64) // 8
    ends = np.cumsum(size)
    is_mark = np.zeros(len(flat), bool)
    for back in (1, 2):
        is_mark[ends[~ended] - back] = True
    stuffed = np.concatenate([[0], np.cumsum((flat == 0xFF) & ~is_mark)])
    last = ends[starts + counts - 1]
    bounds = [0, *(last + stuffed[last]).tolist()]
    data = _stuffed(flat, is_mark).tobytes()
    return [data[a:b] for a, b in zip(bounds, bounds[1:])]


def encode(payloads: list[bytes]) -> list[bytes]:
    """A progressive JPEG for each payload, all blocks of the batch at once."""
    shapes = [shape(len(p) // 64) for p in payloads]
    parts: list[list[np.ndarray]] = [[], [], []]
    owners: list[list[int]] = [[], [], []]
    for p, (w, h) in zip(payloads, shapes):
        units = w * h
        filled = np.frombuffer(p + b"\xff" * (384 * units - len(p)), np.uint8).astype(np.int64).reshape(-1, 64) + SHIFT
        for c, (a, b) in enumerate(((0, 4 * units), (4 * units, 5 * units), (5 * units, 6 * units))):
            parts[c].append(filled[a:b])
            owners[c].append(b - a)
    pieces: list[list[bytes]] = [[_head(16 * w, 16 * h), _segment(0xDD, b"\0\1")] for w, h in shapes]
    planes = [np.concatenate(x) for x in parts]
    owner = [np.repeat(np.arange(len(payloads)), n) for n in owners]
    restarts = 1
    for c, low, high, up, down, table_id, every in SCANS:
        if every != restarts:
            restarts = every
            for p in pieces:
                p.append(_segment(0xDD, b"\0\0"))
        head = _scan(c, low, high, up, down, table_id)
        if up == 0:
            made = _first_scan(planes[c][:, low : high + 1] >> down, owner[c])
        else:
            made = []
            last = (planes[c][:, low : high + 1] & 1).astype(np.uint8)
            if low:  # the code of an ended band, one bit, before the bits of its coefficients
                last = np.concatenate([np.zeros((len(last), 1), np.uint8), last], axis=1)
            at = 0
            for n in owners[c]:
                bits = last[at : at + n].ravel()
                at += n
                fill = np.ones(-len(bits) % 8, np.uint8)
                made.append(np.packbits(np.concatenate([bits, fill])).tobytes().replace(b"\xff", b"\xff\0"))
        for p, data in zip(pieces, made):
            p += (head, data)
    return [b"".join(p) + b"\xff\xd9" for p in pieces]


# --- reading


class Frame:
    """A file's headers and scans: what both decoders start from."""

    def __init__(self, data: bytes):
        self.scans: list[tuple] = []
        tables: dict[int, tuple[bytes, bytes]] = {}
        self.quant: dict[int, np.ndarray] = {}
        restart, at = 0, 2
        if data[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG")
        while at + 4 <= len(data):
            marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xDB:
                k = 0
                while k < len(body):
                    wide = body[k] >> 4
                    values = np.frombuffer(body, ">u2" if wide else np.uint8, 64, k + 1).astype(np.int64)
                    self.quant[body[k] & 15] = values
                    k += 1 + 64 * (1 + wide)
            elif marker == 0xC2:
                _, self.height, self.width, n = struct.unpack_from(">BHHB", body)
                self.components = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                raise ValueError("only progressive Huffman files are read")
            elif marker == 0xC4:
                k = 0
                while k < len(body):
                    counts = body[k + 1 : k + 17]
                    tables[body[k]] = (counts, body[k + 17 : k + 17 + sum(counts)])
                    k += 17 + sum(counts)
            elif marker == 0xDD:
                restart = struct.unpack(">H", body)[0]
            elif marker == 0xDA:
                n = body[0]
                chosen = [([c[0] for c in self.components].index(body[1 + 2 * i]), body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(n)]
                low, high, bits = body[1 + 2 * n : 4 + 2 * n]
                end = at
                while True:
                    end = data.find(b"\xff", end)
                    if end < 0 or end + 1 >= len(data):
                        end = len(data)
                        break
                    if data[end + 1] == 0 or 0xD0 <= data[end + 1] <= 0xD7:
                        end += 2
                        continue
                    break
                self.scans.append((chosen, low, high, bits >> 4, bits & 15, restart, dict(tables), data[at:end]))
                at = end
                if data[at + 1 : at + 2] == b"\xd9":
                    break
        self.hmax, self.vmax = max(c[1] for c in self.components), max(c[2] for c in self.components)
        mcus = -(-self.width // (8 * self.hmax)), -(-self.height // (8 * self.vmax))
        self.grid = [(mcus[0] * h, mcus[1] * v) for _, h, v, _ in self.components]  # blocks stored, by component
        self.own = [(-(-(-(-self.width * h // self.hmax)) // 8), -(-(-(-self.height * v // self.vmax)) // 8)) for _, h, v, _ in self.components]
        self.mcus = mcus


def _codes(table: tuple[bytes, bytes]) -> dict[tuple[int, int], int]:
    """(length, code) to symbol."""
    out, code, k = {}, 0, 0
    for length, n in enumerate(table[0], 1):
        for _ in range(n):
            out[length, code] = table[1][k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


class Bits:
    def __init__(self, data: bytes):
        self.data, self.at = data.replace(b"\xff\0", b"\xff"), 0

    def bit(self) -> int:
        byte = self.data[self.at >> 3] if self.at >> 3 < len(self.data) else 0xFF
        self.at += 1
        return byte >> (7 - (self.at - 1) % 8) & 1

    def take(self, n: int) -> int:
        value = 0
        for _ in range(n):
            value = value << 1 | self.bit()
        return value

    def symbol(self, codes: dict) -> int:
        code = length = 0
        while length < 16:
            code, length = code << 1 | self.bit(), length + 1
            if (length, code) in codes:
                return codes[length, code]
        raise ValueError("a code is not in the table")


def _extended(value: int, size: int) -> int:
    return value if size == 0 or value >> (size - 1) else value - (1 << size) + 1


def _intervals(data: bytes) -> list[bytes]:
    out, start, at = [], 0, 0
    while (at := data.find(b"\xff", at)) >= 0 and at + 1 < len(data):
        if 0xD0 <= data[at + 1] <= 0xD7:
            out.append(data[start:at])
            start = at + 2
        at += 2
    return [*out, data[start:]]


def _plain_scan(frame: Frame, scan: tuple, planes: list[np.ndarray]) -> None:
    """One scan of any kind into the coefficient arrays (blocks, 64 in scan order)."""
    chosen, low, high, up, down, restart, tables, data = scan
    if len(chosen) == 1:
        c = chosen[0][0]
        units = [[(c, y * frame.grid[c][0] + x)] for y in range(frame.own[c][1]) for x in range(frame.own[c][0])]
    else:
        units = [[(c, (my * v + y) * frame.grid[c][0] + mx * h + x) for c, _, _ in chosen for h, v in [frame.components[c][1:3]] for y in range(v) for x in range(h)] for my in range(frame.mcus[1]) for mx in range(frame.mcus[0])]
    dc = {c: _codes(tables[d]) for c, d, _ in chosen if d in tables}
    ac = {c: _codes(tables[0x10 | a]) for c, _, a in chosen if 0x10 | a in tables}
    parts = _intervals(data) if restart else [data]
    step = restart or len(units)
    for k, part in enumerate(parts):
        bits, before, ended = Bits(part), {c: 0 for c, *_ in chosen}, 0
        for unit in units[k * step : (k + 1) * step]:
            for c, block in unit:
                z = planes[c][block]
                if low == 0:
                    if up:
                        z[0] |= bits.bit() << down
                    else:
                        size = bits.symbol(dc[c])
                        before[c] += _extended(bits.take(size), size)
                        z[0] = before[c] << down
                elif up == 0:
                    if ended:
                        ended -= 1
                        continue
                    i = low
                    while i <= high:
                        run, size = divmod(bits.symbol(ac[c]), 16)
                        if size:
                            i += run
                            z[i] = _extended(bits.take(size), size) * (1 << down)
                            i += 1
                        elif run == 15:
                            i += 16
                        else:
                            ended = (1 << run) + bits.take(run) - 1
                            break
                else:
                    plus, i = 1 << down, low

                    def refine(i: int) -> None:
                        if bits.bit() and not abs(int(z[i])) & plus:
                            z[i] += plus if z[i] > 0 else -plus

                    if not ended:
                        while i <= high:
                            run, size = divmod(bits.symbol(ac[c]), 16)
                            if size:
                                new = plus if bits.bit() else -plus
                            elif run < 15:
                                ended = (1 << run) + bits.take(run)
                                break
                            else:
                                new = 0
                            while i <= high:
                                if z[i]:
                                    refine(i)
                                elif run == 0:
                                    if new:
                                        z[i] = new
                                    i += 1
                                    break
                                else:
                                    run -= 1
                                i += 1
                    if ended:
                        while i <= high:
                            if z[i]:
                                refine(i)
                            i += 1
                        ended -= 1


def decode_plain(data: bytes) -> tuple[Frame, list[np.ndarray]]:
    """Coefficient arrays of a file, in scan order and not yet multiplied by the quantisation."""
    frame = Frame(data)
    planes = [np.zeros((w * h, 64), np.int64) for w, h in frame.grid]
    for scan in frame.scans:
        _plain_scan(frame, scan, planes)
    return frame, planes


def _stepwise(parts: list[bytes], low: int, high: int, table: tuple[bytes, bytes]) -> np.ndarray | None:
    """A first scan whose intervals are one block each, all blocks in step. None where bands end early (then read plainly)."""
    raw = np.frombuffer(b"".join(parts) + b"\0\0\0\0\0\0\0\0", np.uint8)
    before_ff = np.concatenate([[False], raw[:-1] == 0xFF])
    restart = before_ff & (raw >= 0xD0) & (raw <= 0xD7)
    # Intervals start after restart markers and where a file's part starts; stuffing and markers are taken out.
    gone = restart | np.concatenate([restart[1:], [False]]) | (before_ff & (raw == 0))
    starts = np.zeros(len(raw), bool)
    starts[np.cumsum([0, *(len(p) for p in parts[:-1])])] = True
    starts[1:] |= restart[:-1]
    kept = np.flatnonzero(~gone)
    data = raw[kept].astype(np.int64)
    at = np.searchsorted(kept, np.flatnonzero(starts)) * 8
    # 16 bits of look-ahead: symbol and length of its code.
    symbol, length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    for (n, code), s in _codes(table).items():
        symbol[code << (16 - n) : (code + 1) << (16 - n)] = s
        length[code << (16 - n) : (code + 1) << (16 - n)] = n
    words = (data[:-4] << 32) | (data[1:-3] << 24) | (data[2:-2] << 16) | (data[3:-1] << 8) | data[4:]
    out = np.zeros((len(at), high - low + 1), np.int64)
    for k in range(high - low + 1):
        word = words[at >> 3] << (at & 7) & 0xFFFFFFFFFF
        top = word >> 24
        size, n = symbol[top], length[top]
        if (size == 0).any() and low or (size > 15).any() or (n == 0).any():
            return None
        value = (word >> (40 - n - size)) & ((1 << size) - 1)
        out[:, k] = np.where((size > 0) & (value >> np.maximum(size - 1, 0) == 0), value - (1 << size) + 1, value)
        at = at + n + size
    return out


def decode(files: list[bytes]) -> list[tuple[Frame, list[np.ndarray]]]:
    """Coefficient arrays of each file; files with the scans that are written here are read together."""
    frames = [Frame(f) for f in files]
    wanted = [(c, a, b, u, d, r) for c, a, b, u, d, _, r in SCANS]
    alike = [i for i, f in enumerate(frames) if len(f.components) == 3 and [(s[0][0][0] if len(s[0]) == 1 else -1, *s[1:6]) for s in f.scans] == wanted and all(own == grid for own, grid in zip(f.own, f.grid))]
    found: dict[int, list[np.ndarray]] = {i: [np.zeros((w * h, 64), np.int64) for w, h in frames[i].grid] for i in alike}
    if alike:
        first = frames[alike[0]].scans
        if any([s[6] for s in frames[i].scans] != [s[6] for s in first] for i in alike):
            alike, found = [], {}
    planes = [np.concatenate([found[i][c] for i in alike]) if alike else None for c in range(3)]
    counts = [[len(found[i][c]) for i in alike] for c in range(3)]
    whole = bool(alike)
    for k, (c, low, high, up, down, _, _) in enumerate(SCANS):
        if not whole:
            break
        parts = [frames[i].scans[k][7] for i in alike]
        (_, d, a), tables = first[k][0][0], first[k][6]
        if up == 0:
            made = _stepwise(parts, low, high, tables[0x10 | a if low else d])
            whole = made is not None and len(made) == len(planes[c])
            if whole:
                planes[c][:, low : high + 1] = made * (1 << down)
        else:
            # All coefficients have their upper bits: a band is the code of its end, and a bit for each.
            width = high - low + 1 + (low > 0)
            whole = not low or _codes(tables[0x10 | a]) == {(1, 0): 0} and bool((planes[c][:, low : high + 1] != 0).all())
            if whole:
                rows = []
                for part, n in zip(parts, counts[c]):
                    bits = np.unpackbits(np.frombuffer(part.replace(b"\xff\0", b"\xff"), np.uint8), count=n * width)
                    rows.append(bits.reshape(n, width)[:, width - (high - low + 1) :])
                more = np.concatenate(rows).astype(np.int64) << down
                values = planes[c][:, low : high + 1]
                planes[c][:, low : high + 1] = np.where(values >= 0, values + more, values - more) if low else values | more
    out = []
    offsets = [np.concatenate([[0], np.cumsum(n)]) for n in counts]
    place = {i: k for k, i in enumerate(alike)}
    for i, frame in enumerate(frames):
        if whole and i in place:
            k = place[i]
            out.append((frame, [planes[c][offsets[c][k] : offsets[c][k + 1]] for c in range(3)]))
        else:
            out.append(decode_plain(files[i]))
    return out


def payload(planes: list[np.ndarray], size: int) -> bytes:
    """The bytes that coefficient arrays hold."""
    return (np.concatenate([p.ravel() for p in planes]) - SHIFT).astype(np.uint8).tobytes()[:size]


def _inverse() -> np.ndarray:
    """64 coefficients in scan order to 64 pixels, in units of 2**-20, as whole numbers."""
    k, x = np.arange(8)[:, None], np.arange(8)[None, :]
    one = np.cos((2 * x + 1) * k * np.pi / 16) * np.where(k == 0, math.sqrt(1 / 8), 0.5)
    return np.round(np.kron(one, one)[ZIGZAG] * (1 << 20))


INVERSE = _inverse()


def tensor(frame: Frame, planes: list[np.ndarray]) -> np.ndarray:
    """(height, width, 3) bytes: inverse transform, chroma repeated to full resolution, and conversion to RGB."""
    full = []
    for (w, h), z, (_, hs, vs, q) in zip(frame.grid, planes, frame.components):
        pixels = np.floor((z * frame.quant[q]).astype(np.float64) @ INVERSE / (1 << 20) + 128.5)
        image = np.clip(pixels, 0, 255).astype(np.int64).reshape(h, w, 8, 8).transpose(0, 2, 1, 3).reshape(8 * h, 8 * w)
        image = image.repeat(frame.vmax // vs, 0).repeat(frame.hmax // hs, 1)
        full.append(image[: frame.height, : frame.width])
    if len(full) == 1:
        return np.repeat(full[0][:, :, None], 3, 2).astype(np.uint8)
    y, cb, cr = full[0] << 16, full[1] - 128, full[2] - 128
    half = 1 << 15
    rgb = np.stack([y + 91881 * cr, y - 22554 * cb - 46802 * cr, y + 116130 * cb], axis=2) + half >> 16
    return np.clip(rgb, 0, 255).astype(np.uint8)


def padded(text: bytes) -> bytes:
    return text + b"\xff" * (UNIT * max(1, -(-len(text) // UNIT)) - len(text))


def with_media(df: DataFrame, text: str = "text", tensors: bool = True, replace: bool = False) -> DataFrame:
    """Add media (the JPEG), width, height, n_bytes, and read back from the JPEG: payload, and rgb (the tensor's bytes).

    `tensors=False` leaves rgb null; its sums by channel, `channel_sums`, are always there.
    """
    at = df.columns.index(text)
    kept = [i for i in range(len(df.columns)) if not (replace and i == at)]
    names = fresh(df.drop(text) if replace else df, "media", "width", "height", "n_bytes", "payload", "rgb", "channel_sums")
    kinds = [pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for whole in batches:
            start = size = 0
            lengths = [len(v.as_py().encode()) if v.is_valid else 0 for v in whole.column(at)]
            for i, n in enumerate(lengths):
                size += n + UNIT
                if size >= BATCH_BYTES or i + 1 == len(lengths):
                    yield answer(whole.slice(start, i + 1 - start))
                    start, size = i + 1, 0

    def answer(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [(v.as_py() or "").encode() for v in batch.column(at)]
        sent = [padded(t) for t in texts]
        media = encode(sent)
        rows = []
        for t, p, m, (frame, planes) in zip(texts, sent, media, decode(media)):
            rgb = tensor(frame, planes)
            rows.append((m, frame.width, frame.height, len(t), payload(planes, len(p)), rgb.tobytes() if tensors else None, rgb.sum((0, 1), dtype=np.int64).tolist()))
        columns = zip(*rows) if rows else [[] for _ in kinds]
        return pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), *(pa.array(list(c), k) for c, k in zip(columns, kinds))], names=[*(batch.schema.names[i] for i in kept), *names])

    types = [T.BinaryType(), T.IntegerType(), T.IntegerType(), T.LongType(), T.BinaryType(), T.BinaryType(), T.ArrayType(T.LongType())]
    return df.mapInArrow(run, T.StructType([*(df.schema.fields[i] for i in kept), *(T.StructField(n, k) for n, k in zip(names, types))]))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a progressive JPEG: digests of what is stored and read back, and of the tensor with its mean colours."""
    made = with_media(table(spark, sf_dir, "documents").select("doc_id", "text"), replace=True)
    size = F.octet_length("payload")
    return made.select(
        "doc_id",
        "n_bytes",
        size.cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", size - 31, F.lit(32))).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat(F.col("width"), F.lit("x"), F.col("height"), F.lit(":"), F.array_join(F.transform("channel_sums", lambda s: F.round(s / (F.col("width") * F.col("height")), 3).cast("string")), ",")).alias("feature"),
        F.sha2("rgb", 256).alias("rgb_sha256"),
    )
