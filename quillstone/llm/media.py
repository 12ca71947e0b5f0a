"""Media columns: payloads stored losslessly as baseline JPEG, read back in numpy.

Baseline JPEG loses samples in the transform but keeps quantised coefficients
exactly, so a payload byte b becomes the coefficient b - 128: 64 bytes make a
block in zigzag order and three blocks (Y, Cb, Cr) a 192-byte MCU.  Each MCU is a
restart interval, so the decoder walks all MCUs of many images in lockstep.  The
luminance DC coefficients alone give the thumbnail.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesops import arrow_map

MCU = 192
WIDEST = 8191  # MCUs in a row: 65535 samples at most
#: Marker codes.
SOI, EOI, SOF0, DHT, SOS, DQT, DRI, COM = 0xD8, 0xD9, 0xC0, 0xC4, 0xDA, 0xDB, 0xDD, 0xFE


def segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def code_table(counts: list[int], symbols: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Canonical Huffman code and its length for each symbol."""
    code, size, k, value = np.zeros(256, np.int64), np.zeros(256, np.int64), 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            code[symbols[k]], size[symbols[k]] = value, length
            value += 1
            k += 1
        value <<= 1
    return code, size


def lookup(counts: list[int], symbols: list[int]) -> np.ndarray:
    """For each 16 leading bits: symbol + 256 * code length; 0 where no code fits."""
    code, size = code_table(counts, symbols)
    out = np.zeros(1 << 16, np.int32)
    for s in symbols:
        lo = int(code[s]) << (16 - int(size[s]))
        out[lo:lo + (1 << (16 - int(size[s])))] = s + 256 * int(size[s])
    return out


#: DC sizes 0-11 take 4 bits each.  AC: sizes 1-8 without a run take 4 bits, all other symbols 9.
DC_SYMBOLS = list(range(12))
DC_COUNTS = [0, 0, 0, 12] + [0] * 12
AC_SHORT = list(range(1, 9))
AC_SYMBOLS = AC_SHORT + [0x00, 0xF0] + [16 * run + size for run in range(16) for size in range(1, 11) if run or size > 8]
AC_COUNTS = [0, 0, 0, 8, 0, 0, 0, 0, len(AC_SYMBOLS) - 8] + [0] * 7


def frame(n_mcu: int, n_bytes: int) -> tuple[bytes, int, int]:
    """All bytes before the scan's data, and the image's width and height in MCUs."""
    high = -(-n_mcu // WIDEST)
    wide = -(-n_mcu // high)
    if high > WIDEST:
        raise ValueError("the payload is too long for one image")
    tables = b"".join(bytes([kind]) + bytes(c) + bytes(s) for kind, c, s in ((0x00, DC_COUNTS, DC_SYMBOLS), (0x10, AC_COUNTS, AC_SYMBOLS)))
    parts = b"".join(bytes([i, 0x11, 0]) for i in (1, 2, 3))
    return (bytes([0xFF, SOI]) + segment(COM, b"payload %d mcus %d" % (n_bytes, n_mcu)) + segment(DQT, bytes([0, 8] + [1] * 63))
            + segment(SOF0, bytes([8]) + (8 * high).to_bytes(2, "big") + (8 * wide).to_bytes(2, "big") + b"\x03" + parts)
            + segment(DHT, tables) + segment(DRI, (1).to_bytes(2, "big"))
            + segment(SOS, b"\x03" + b"".join(bytes([i, 0]) for i in (1, 2, 3)) + bytes([0, 63, 0]))), wide, high


def scan_bytes(payload: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded data of MCUs (rows of 192 bytes), byte-stuffed and padded with ones; and each MCU's end in it."""
    n = len(payload)
    value = payload.astype(np.int16) - 128
    size = np.zeros(256, np.int64)
    size[:] = [abs(v - 128).bit_length() for v in range(256)]
    extra_bits = size[payload]
    extra = np.where(value < 0, value + (1 << extra_bits) - 1, value).astype(np.int64)
    dc, ac = code_table(DC_COUNTS, DC_SYMBOLS), code_table(AC_COUNTS, AC_SYMBOLS)
    at = np.arange(MCU) % 64
    is_dc = np.broadcast_to(at == 0, payload.shape)
    emit = is_dc | (value != 0)
    # Zeros before an emitted AC coefficient in its block: the position less that of the last emitted one.
    place = np.where(emit, at, -1)
    last = np.maximum.accumulate(np.where(emit, np.arange(MCU), 0), axis=1)
    before = np.concatenate([np.zeros((n, 1), last.dtype), last[:, :-1]], axis=1)
    run = np.where(emit & ~is_dc, np.arange(MCU) - before - 1, 0)
    symbol = np.where(is_dc, extra_bits, (run % 16) * 16 + extra_bits)
    code = np.where(is_dc, dc[0][symbol], ac[0][symbol])
    bits = np.where(is_dc, dc[1][symbol], ac[1][symbol])
    code = (code << extra_bits) | extra
    bits = np.where(emit, bits + extra_bits, 0)
    skips = run // 16  # ZRL symbols before the coefficient
    zrl, zrl_bits = int(ac[0][0xF0]), int(ac[1][0xF0])
    ends = (at == 63) & ~emit  # the block ends in zeros: EOB
    code = np.where(ends, int(ac[0][0]), code)
    bits = np.where(ends, int(ac[1][0]), bits)
    total = bits + skips * zrl_bits
    length = total.sum(1)
    mcu_bytes = -(-length // 8)
    first_bit = 8 * (np.cumsum(mcu_bytes) - mcu_bytes)
    out = np.ones(int(8 * mcu_bytes.sum()), np.uint8)
    start = first_bit[:, None] + np.cumsum(total, 1) - total
    for k in range(int(skips.max(initial=0))):
        i = np.nonzero(skips > k)
        for j in range(zrl_bits):
            out[start[i] + k * zrl_bits + j] = zrl >> (zrl_bits - 1 - j) & 1
    start, code, bits = (start + skips * zrl_bits).ravel(), code.ravel(), bits.ravel()
    live = np.flatnonzero(bits)
    start, code, bits = start[live], code[live], bits[live]
    for j in range(int(bits.max(initial=0))):
        i = np.flatnonzero(bits > j) if j >= 4 else slice(None)
        out[start[i] + j] = code[i] >> (bits[i] - 1 - j) & 1
    del place
    raw = np.packbits(out)
    full = np.flatnonzero(raw == 0xFF)
    stuffed = np.insert(raw, full + 1, 0)
    end = np.cumsum(mcu_bytes)
    return stuffed, end + np.searchsorted(full, end)


def encode_payloads(payloads: list[bytes], sizes: list[int]) -> list[bytes]:
    """A JPEG file for each payload (a positive multiple of 192 bytes)."""
    counts = [len(p) // MCU for p in payloads]
    data, end = scan_bytes(np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, MCU))
    blank, blank_end = scan_bytes(np.full((1, MCU), 32, np.uint8))
    out, mcu, flat = [], 0, data.tobytes()
    for n, size in zip(counts, sizes, strict=True):
        head, wide, high = frame(n, size)
        stops = end[mcu:mcu + n].tolist()
        start = int(end[mcu - 1]) if mcu else 0
        parts = [head]
        for k, stop in enumerate(stops):
            if k:
                parts.append(b"\xff" + bytes([0xD0 + (k - 1) % 8]))
            parts.append(flat[start:stop])
            start = stop
        for k in range(n, wide * high):
            parts += [b"\xff" + bytes([0xD0 + (k - 1) % 8]), blank[:int(blank_end[0])].tobytes()]
        parts.append(bytes([0xFF, EOI]))
        out.append(b"".join(parts))
        mcu += n
    return out


class Image(NamedTuple):
    """What the markers of one file say (restart: MCUs an interval; dc, ac: a Huffman table for each component), and its scan data."""

    width: int
    height: int
    mcus: int
    payload_mcus: int
    quant0: int
    restart: int
    dc: tuple
    ac: tuple
    scan: np.ndarray


def parse(blob: bytes) -> Image:
    """Walk the markers of a baseline file with one scan of three unsampled 8-bit components; others raise ValueError."""
    if blob[:2] != bytes([0xFF, SOI]) or blob[-2:] != bytes([0xFF, EOI]):
        raise ValueError("not a JPEG file")
    at, tables, steps, restart, note = 2, {}, {}, 0, b""
    width = height = 0
    parts: list[tuple[int, int]] = []
    while True:
        if blob[at] != 0xFF:
            raise ValueError("a marker is missing")
        marker, size = blob[at + 1], int.from_bytes(blob[at + 2:at + 4], "big")
        body = blob[at + 4:at + 2 + size]
        at += 2 + size
        if marker == COM:
            note = body
        elif marker == DQT:
            while body:
                wide = body[0] >> 4
                steps[body[0] & 15] = int.from_bytes(body[1:2 + wide], "big")
                body = body[1 + 64 * (1 + wide):]
        elif marker == SOF0:
            height, width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            if body[0] != 8 or body[5] != 3 or any(body[7 + 3 * i] != 0x11 for i in range(3)):
                raise ValueError("only three unsampled 8-bit components are read")
            parts = [(body[6 + 3 * i], body[8 + 3 * i]) for i in range(3)]
        elif marker == DHT:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = (tuple(body[1:17]), tuple(body[17:17 + n]))
                body = body[17 + n:]
        elif marker == DRI:
            restart = int.from_bytes(body[:2], "big")
        elif marker == SOS:
            break
        elif marker not in range(0xE0, 0xF0):
            raise ValueError(f"marker {marker:02x} isn't baseline")
    if len(body) != 10 or body[0] != 3 or [body[1 + 2 * i] for i in range(3)] != [i for i, _ in parts] or body[7:] != bytes([0, 63, 0]):
        raise ValueError("only one scan of all components is read")
    chosen = [body[2 + 2 * i] for i in range(3)]
    try:
        dc, ac = (tuple(tables[kind + part] for part in each) for kind, each in ((0x00, [c >> 4 for c in chosen]), (0x10, [c & 15 for c in chosen])))
        step = steps[parts[0][1]]
    except KeyError as missing:
        raise ValueError(f"table {missing} isn't given") from missing
    mcus = -(-width // 8) * -(-height // 8)
    stored = int(note.split()[3]) if note.startswith(b"payload ") else mcus
    return Image(width, height, mcus, stored, step, restart or mcus, dc, ac, np.frombuffer(blob, np.uint8)[at:-2])


def table_stack(images: list[Image]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The images' distinct Huffman tables as lookups, and each image's DC and AC table numbers by component."""
    names = list(dict.fromkeys(t for i in images for t in (*i.dc, *i.ac)))
    number = {t: n for n, t in enumerate(names)}
    stack = np.stack([lookup(list(counts), list(symbols)) for counts, symbols in names])
    return stack, *(np.array([[number[t] for t in kind] for kind in each]) for each in ([i.dc for i in images], [i.ac for i in images]))


def decode_scans(images: list[Image]) -> list[np.ndarray]:
    """Coefficients of each image, shape (MCUs, 192); the restart intervals of all images are decoded side by side."""
    stack, dc_of, ac_of = table_stack(images)
    data = np.concatenate([*(i.scan for i in images), np.zeros(1, np.uint8)])
    lengths = np.array([len(i.scan) for i in images])
    starts_of = np.cumsum(lengths) - lengths
    escape = np.flatnonzero(data[:-1] == 0xFF)
    after = data[escape + 1]
    restart = escape[(after >= 0xD0) & (after <= 0xD7)]
    drop = np.zeros(len(data), bool)
    drop[escape[after == 0] + 1] = True
    drop[restart] = drop[restart + 1] = True
    mcus, per = (np.array([getattr(i, f) for i in images]) for f in ("mcus", "restart"))
    intervals = -(-mcus // per)
    if (np.searchsorted(restart, starts_of + lengths) - np.searchsorted(restart, starts_of) != intervals - 1).any():
        raise ValueError("the scan has other restart intervals than its header says")
    begin = np.sort(np.concatenate([starts_of, restart + 2]))
    kept_before = np.concatenate([[0], np.cumsum(~drop)])
    begin = kept_before[begin]
    clean = np.concatenate([data[:-1][~drop[:-1]], np.full(16, 0xFF, np.uint8)])
    wide = (clean[:-3].astype(np.uint32) << 24) | (clean[1:-2].astype(np.uint32) << 16) | (clean[2:-1].astype(np.uint32) << 8) | clean[3:]
    image = np.repeat(np.arange(len(images)), intervals)
    nth = np.arange(len(image)) - (np.cumsum(intervals) - intervals)[image]
    first = (np.cumsum(mcus) - mcus)[image] + nth * per[image]
    count = np.minimum(per[image], mcus[image] - nth * per[image])
    out = np.zeros((int(mcus.sum()), MCU), np.int16)
    flat, base, limit = out.reshape(-1), first * MCU, count * MCU
    # As a rule all images and components have one table of each kind.
    alike = (dc_of == dc_of[0, 0]).all() and (ac_of == ac_of[0, 0]).all()
    tables = stack.reshape(-1)
    bit = begin.astype(np.int64) * 8
    place = np.zeros(len(begin), np.int64)  # next coefficient of each interval
    rows = np.arange(len(begin))
    while len(rows):
        p, k = bit[rows], place[rows]
        word = wide[p >> 3].astype(np.uint64) << np.uint64(8) | clean[(p >> 3) + 4]
        word = (word << (p & 7).astype(np.uint64)) & np.uint64(0xFFFFFFFFFF)  # 33 bits or more of the stream, left-aligned in 40
        top = (word >> np.uint64(24)).astype(np.int64)
        is_dc = (k & 63) == 0
        if alike:
            entry = tables[np.where(is_dc, dc_of[0, 0] << 16, ac_of[0, 0] << 16) + top]
        else:
            of, part = image[rows], k // 64 % 3
            entry = tables[(np.where(is_dc, dc_of[of, part], ac_of[of, part]) << 16) + top]
        if (entry == 0).any():
            raise ValueError("the scan has a code that no table holds")
        used, symbol = entry >> 8, entry & 255
        run, size = np.where(is_dc, 0, symbol >> 4), np.where(is_dc, symbol, symbol & 15)
        raw = ((word << used.astype(np.uint64) & np.uint64(0xFFFFFFFFFF)) >> (np.uint64(40) - size.astype(np.uint64))).astype(np.int64)
        value = np.where((size > 0) & (raw < (1 << np.maximum(size - 1, 0))), raw - (1 << size) + 1, raw)
        eob = ~is_dc & (symbol == 0)
        zrl = ~is_dc & (symbol == 0xF0)
        to = k + run
        if (~eob & ((to ^ k) > 63)).any():
            raise ValueError("a run leaves its block")
        put = ~eob & ~zrl & (size > 0)
        flat[base[rows[put]] + to[put]] = value[put]
        p, k = p + used + size, np.where(eob, (k | 63) + 1, to + 1)
        bit[rows], place[rows] = p, k
        rows = rows[(k < limit[rows]) & (p >> 3 < len(clean) - 15)]
    if (place < limit).any() or (-(-bit // 8) > np.append(begin[1:], len(clean) - 16)).any():
        raise ValueError("the scan ends early")
    # A DC coefficient is stored as its difference from the one before in its interval.
    total = np.cumsum(out[:, ::64], axis=0, dtype=np.int64)
    before = np.concatenate([np.zeros((1, 3), np.int64), total])[first]
    out[:, ::64] = total - np.repeat(before, count, axis=0)
    ends = np.cumsum(mcus)
    return [out[e - i.mcus:e] for i, e in zip(images, ends, strict=True)]


def thumbnail(image: Image, coefficients: np.ndarray) -> np.ndarray:
    """DC-only luminance: one sample per MCU."""
    y = np.clip((coefficients[:, 0].astype(np.int64) * image.quant0 + 4) // 8 + 128, 0, 255)
    return y.reshape(-(-image.height // 8), -(-image.width // 8)).astype(np.uint8)


def average_hash(thumb: np.ndarray) -> str:
    """64-bit average hash of the samples laid out in a row and cut into 64 near-equal parts."""
    flat = thumb.ravel().astype(np.int64)
    cut = np.linspace(0, len(flat), 65).astype(np.int64)
    total = np.concatenate([[0], np.cumsum(flat)])
    lo, hi = np.minimum(cut[:-1], len(flat) - 1), np.maximum(cut[1:], np.minimum(cut[:-1], len(flat) - 1) + 1)
    mean = (total[hi] - total[lo]) / (hi - lo)
    return f"{int(np.packbits(mean > mean.mean()).view('>u8')[0]):016x}"


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, media (a JPEG file).

    The payload is the text in UTF-8 (null: empty) with bytes 32 appended up to a
    positive multiple of 192.  Null ids and repeated rows are stored like any other
    row; other columns aren't read.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            raw = [(t or "").encode() for t in batch.column("text").to_pylist()]
            for lo, hi in slices([len(b) for b in raw]):
                part = raw[lo:hi]
                media = encode_payloads([b + b" " * (max(MCU, -(-len(b) // MCU) * MCU) - len(b)) for b in part], [len(b) for b in part])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array([len(b) for b in part], pa.int64()), pa.array(media, pa.binary())],
                                                 names=["doc_id", "n_bytes", "media"])

    return arrow_map(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, f"doc_id {kind}, n_bytes bigint, media binary")


def slices(sizes: list[int], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of rows of about `limit` bytes."""
    lo = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield lo, i
            lo, total = i, 0
        total += max(MCU, n)
    if lo < len(sizes):
        yield lo, len(sizes)


def features(media: DataFrame) -> DataFrame:
    """One row per input row (doc_id, n_bytes, media): the payload read back, as digests, and the image's features.

    feature is `width x height : average hash : CRC-32 of the thumbnail`.  Null ids and
    repeated rows are read like any other row.
    """
    kind = media.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            blobs = batch.column("media").to_pylist()
            found = []
            for lo, hi in slices([len(b) for b in blobs]):
                images = [parse(b) for b in blobs[lo:hi]]
                for blob, image, c in zip(blobs[lo:hi], images, decode_scans(images), strict=True):
                    payload = (c[:image.payload_mcus] + 128).astype(np.uint8).tobytes()
                    thumb = thumbnail(image, c)
                    found.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(blob), hashlib.sha256(blob).hexdigest(),
                                  f"{image.width}x{image.height}:{average_hash(thumb)}:{zlib.crc32(thumb.tobytes()):08x}"))
            if found:
                n, sha, tail, size, media_sha, feature = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64()), pa.array(sha), pa.array(tail, pa.int64()), pa.array(size, pa.int64()),
                     pa.array(media_sha), pa.array(feature)], names=names)

    schema = (f"doc_id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, "
              "media_sha256 string, feature string")
    return arrow_map(media, run, schema)
