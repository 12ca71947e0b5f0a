"""Pre-tokens to ids: pattern matches are encoded once each and remembered in a bounded cache."""

from __future__ import annotations

import base64
import functools
import os
import re
from array import array
from operator import itemgetter
from pathlib import Path

import numpy as np
import pyarrow as pa

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import regex  # noqa: E402
from tokenizers import Tokenizer, models  # noqa: E402

#: Texts of these characters only are split alike by `re` (faster) and by `regex` with Unicode properties.
PLAIN = re.compile("[\x00-\x1b\x20-\x7f\xa1-\xa9\xab-\xb1\xb4\xb6-\xb8\xbb\xbf-ɏ‐-‧‰-⁞€]*")


def byte_to_char() -> list[str]:
    """The printable stand-in of each byte: printable Latin-1 bytes stand for themselves, the others for U+0100 onwards."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    hidden = (b for b in range(256) if b not in set(shown))
    table = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [table[b] for b in range(256)]


def splitters(pattern: str) -> tuple[re.Pattern | None, regex.Pattern]:
    r"""The pattern for plain texts (None if it can't be put that way) and for all texts; \s means Unicode White_Space."""
    full = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
    letters, digits, rest = r"\p{L}+", r"\p{N}+", r"[^\s\p{L}\p{N}]+"
    if all(x in pattern for x in (letters, digits, rest)):
        plain = pattern.replace(rest, r"(?:[^\s\w]|_)+").replace(letters, r"[^\W\d_]+").replace(digits, r"\d+")
        if r"\p" not in plain:
            return re.compile(plain), full
    return None, full


def ranks_tokenizer(path: str) -> Tokenizer:
    """A byte-level BPE tokenizer over mapped characters from a file of ranks.

    Any two tokens whose concatenation is a token may merge, by the rank of what
    they become; a piece that is itself a token is taken whole.
    """
    chars = byte_to_char()
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in Path(path).read_bytes().splitlines() if line)}
    name = {t: "".join(map(chars.__getitem__, t)) for t in ranks}
    merges = [(name[t[:i]], name[t[i:]])
              for t in sorted(ranks, key=ranks.__getitem__) for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
    return Tokenizer(models.BPE(vocab={name[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True))


#: The pattern whose matches `starts` finds from the classes of characters.
CLASSED = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACE, LETTER, NUMBER, OTHER = range(4)


@functools.lru_cache(1)
def classes() -> np.ndarray:
    """The class of each code point."""
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((SPACE, r"\p{White_Space}"), (LETTER, r"\p{L}"), (NUMBER, r"\p{N}")):
        out[np.frombuffer("".join(regex.findall(pattern, every)).encode("utf-32-le"), "<u4")] = kind
    return out


def starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where in the UTF-8 bytes of these texts the matches of CLASSED begin; they cover every byte.

    A match is a run of one class, with two exceptions.  The last space of a run
    before another character stands alone or, if it is U+0020, begins the next match.
    An apostrophe that begins a match takes a contraction's letters along.
    """
    if not len(data):
        return np.zeros(0, np.int64)
    at = None
    code, first = data, offsets
    if data.max() >= 128:
        code = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4")
        at = np.flatnonzero((data & 0xC0) != 0x80)
        first = np.searchsorted(at, offsets)
    kind = classes()[code]
    head = np.zeros(len(code) + 1, bool)
    head[first] = True
    new = head.copy()
    new[1:-1] |= kind[1:] != kind[:-1]
    then = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~head[1:-1]) + 1
    new[then - 1] = True
    joined = then[code[then - 1] == 32]
    new[joined] = False
    quote = np.flatnonzero((code == 39) & new[:-1])
    if len(quote):
        padded = np.append(code, np.zeros(2, code.dtype))
        a, b = padded[quote + 1], padded[quote + 2]
        takes = np.isin(a, np.frombuffer(b"stmd", np.uint8)).astype(np.int64)
        takes[((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))] = 2
        takes[head[quote + 1] | (takes == 2) & head[np.minimum(quote + 2, len(code))]] = 0
        quote, takes = quote[takes > 0], takes[takes > 0]
        new[quote + 1] = False
        new[quote + 1 + takes] = True
    found = np.flatnonzero(new[:-1])
    return found if at is None else at[found]


class Pieces(dict):
    """Maps a piece of text to its ids as little-endian uint32 bytes; misses go to the tokenizer's model."""

    def __init__(self, tokenizer: Tokenizer, pattern: str, most: int = 800_000) -> None:
        super().__init__()
        self.model = tokenizer.model  # pieces are mapped here, so the model alone is asked
        self.vocab = tokenizer.get_vocab(with_added_tokens=False)
        self.plain, self.full = splitters(pattern)
        self.table = dict(enumerate(byte_to_char()))
        self.most = most
        self.classed = pattern == CLASSED

    def __missing__(self, piece: str) -> bytes:
        if piece.isascii() and piece.isalnum():
            shown = piece  # its bytes are their own stand-ins
        else:
            shown = piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.table)
        ids = array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()
        if len(piece) <= 128:
            if len(self) >= self.most:
                self.clear()
            self[piece] = ids
        return ids

    def all_ids(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, each pattern match encoded separately."""
        out = []
        for text in texts:
            pieces = self.split(text)
            found = itemgetter(*pieces)(self) if len(pieces) > 1 else [self[p] for p in pieces]
            out.append(np.frombuffer(b"".join(found), "<u4"))
        return out

    def chunk_ids(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """Ids of each text of a chunk of UTF-8 bytes; each distinct match is looked up once."""
        if not self.classed or len(data) >= 1 << 31:
            return self.all_ids([data[lo:hi].tobytes().decode() for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)])
        start = starts(data, offsets)
        ends = np.append(start, len(data)).astype(np.int32)
        found = pa.StringArray.from_buffers(len(start), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
        each = list(map(self.__getitem__, found.dictionary.to_pylist()))
        size = np.fromiter(map(len, each), np.int64, len(each)) // 4
        first, which = np.cumsum(size) - size, found.indices.to_numpy()
        count = size[which]
        to = np.concatenate([[0], np.cumsum(count)])
        ids = np.frombuffer(b"".join(each), "<u4")[np.repeat(first[which] - to[:-1], count) + np.arange(to[-1])]
        cut = to[np.searchsorted(start, offsets)].tolist()
        return [ids[lo:hi] for lo, hi in zip(cut[:-1], cut[1:], strict=True)]

    def split(self, text: str) -> list[str]:
        if self.plain is not None and PLAIN.fullmatch(text):
            return self.plain.findall(text)
        return self.full.findall(text)

    def ids(self, text: str) -> np.ndarray:
        """Ids of one text."""
        return self.all_ids([text])[0]

    def lengths(self) -> np.ndarray:
        """UTF-8 bytes of each id."""
        out = np.zeros(max(self.vocab.values()) + 1, np.int64)
        for token, i in self.vocab.items():
            out[i] = len(token)
        return out
