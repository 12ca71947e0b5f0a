"""The JPEG reader on streams written by hand: restart intervals of any length, DC prediction, tables by component, refusals."""

from __future__ import annotations

import numpy as np
import pytest

from quillstone.llm import media


def codes(lengths: dict[int, int]) -> tuple[bytes, dict[int, str]]:
    """A DHT body (without its class byte) for symbols of these code lengths, and each symbol's bits."""
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    bits, value, last = {}, 0, 0
    for s in order:
        value <<= lengths[s] - last
        last = lengths[s]
        bits[s] = format(value, f"0{last}b")
        value += 1
    return bytes(sum(n == k for n in lengths.values()) for k in range(1, 17)) + bytes(order), bits


DC = [codes({s: 4 for s in range(12)}), codes({s: 3 + s // 2 if s < 10 else 9 for s in range(12)})]
SYMBOLS = [0x00, 0xF0, *(16 * r + n for r in range(16) for n in range(1, 9))]
AC = [codes({s: 8 for s in SYMBOLS}), codes({s: 5 if s < 16 else 10 for s in SYMBOLS})]


def amount(v: int) -> tuple[int, str]:
    n = abs(v).bit_length()
    return n, format(v if v > 0 else v + (1 << n) - 1, f"0{n}b") if n else ""


def block(values: list[int], before: int, dc: dict[int, str], ac: dict[int, str]) -> str:
    n, extra = amount(values[0] - before)
    out, run = dc[n] + extra, 0
    for v in values[1:]:
        if v == 0:
            run += 1
            continue
        while run > 15:
            out, run = out + ac[0xF0], run - 16
        n, extra = amount(v)
        out, run = out + ac[16 * run + n] + extra, 0
    return out + (ac[0x00] if run else "")


def write(mcus: np.ndarray, width: int, height: int, restart: int, tables: list[int], sampling: int = 0x11, cut: int = 0) -> bytes:
    """A baseline file; tables says for each component which of the two DC and AC tables it takes."""
    def segment(marker: int, body: bytes) -> bytes:
        return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body

    head = b"\xff\xd8" + segment(0xE0, b"JFIF\0") + segment(0xDB, bytes([1]) + bytes([3] * 64) + bytes([0x10]) + (16).to_bytes(2, "big") + bytes([0, 1] * 63))
    head += segment(0xC0, bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([3, 1, sampling, 0, 2, 0x11, 1, 3, 0x11, 1]))
    head += b"".join(segment(0xC4, bytes([kind + i]) + each[i][0]) for kind, each in ((0x00, DC), (0x10, AC)) for i in (0, 1))
    head += segment(0xDD, restart.to_bytes(2, "big")) if restart else b""
    head += segment(0xDA, bytes([3, 1, tables[0] * 17, 2, tables[1] * 17, 3, tables[2] * 17, 0, 63, 0]))
    scan, per = [], restart or len(mcus)
    for lo in range(0, len(mcus), per):
        before, bits = [0, 0, 0], ""
        for mcu in mcus[lo:lo + per].tolist():
            for c in range(3):
                values = mcu[64 * c:64 * c + 64]
                bits += block(values, before[c], DC[tables[c]][1], AC[tables[c]][1])
                before[c] = values[0]
        bits += "1" * (-len(bits) % 8)
        scan.append(int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\0"))
    body = b"".join(part + (bytes([0xFF, 0xD0 + i % 8]) if i < len(scan) - 1 else b"") for i, part in enumerate(scan))
    return head + body[:len(body) - cut] + b"\xff\xd9"


def coefficients(n: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    out = np.where(rng.random((n, 192)) < 0.08, rng.integers(-120, 121, (n, 192)), 0)
    out[:, ::64] = rng.integers(-300, 301, (n, 3))
    return out


CASES = [(24, 16, 1, [0, 0, 0]), (24, 16, 0, [0, 1, 1]), (40, 33, 4, [1, 0, 1]), (64, 64, 7, [1, 1, 0]), (8, 8, 0, [0, 1, 0]), (13, 21, 200, [0, 0, 1])]


def test_intervals_prediction_and_tables():
    """All files at once, so that none takes another's tables or intervals."""
    want = [coefficients(-(-w // 8) * -(-h // 8), i) for i, (w, h, _, _) in enumerate(CASES)]
    images = [media.parse(write(c, w, h, r, t)) for c, (w, h, r, t) in zip(want, CASES, strict=True)]
    for c, got, image in zip(want, media.decode_scans(images), images, strict=True):
        assert np.array_equal(c, got)
        thumb = media.thumbnail(image, got)
        assert thumb.shape == (-(-image.height // 8), -(-image.width // 8))
        assert np.array_equal(thumb.ravel(), np.clip((c[:, 0] * 16 + 4) // 8 + 128, 0, 255))


def test_what_is_not_read_raises():
    c = coefficients(6, 9)
    plain = write(c, 24, 16, 2, [0, 1, 0])
    with pytest.raises(ValueError, match="unsampled"):
        media.parse(write(c, 24, 16, 2, [0, 0, 0], sampling=0x22))
    with pytest.raises(ValueError, match="isn't baseline"):
        media.parse(plain.replace(b"\xff\xc0", b"\xff\xc2", 1))
    with pytest.raises(ValueError, match="isn't given"):
        media.parse(plain.replace(bytes([3, 1, 0, 2, 17, 3, 0, 0, 63, 0]), bytes([3, 1, 0, 2, 0x22, 3, 0, 0, 63, 0])))
    with pytest.raises(ValueError, match="one scan"):
        media.parse(plain.replace(bytes([0, 63, 0]), bytes([1, 63, 0])))
    with pytest.raises(ValueError, match="restart intervals"):
        media.decode_scans([media.parse(plain.replace(b"\xff\xdd\x00\x04\x00\x02", b"\xff\xdd\x00\x04\x00\x03"))])
    with pytest.raises(ValueError, match="ends early|no table|leaves its block"):
        media.decode_scans([media.parse(write(c, 24, 16, 0, [0, 0, 0], cut=40))])
