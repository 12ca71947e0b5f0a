"""Pre-tokens found by classes of characters."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import public_tokenizers
from tokenizers import Tokenizer

from quillstone.llm import packing, pieces
from quillstone.llm.bytesops import text_chunks

ALPHABET = ["'", "'", "s", "t", "re", "ve", "ll", "l", "m", "d", "r", "v", "S", " ", " ", "\n", "\t", "　", " ", "\u0085", "\x1c", "\x1f", "​", "1", "²", "Ⅷ", "é",
            "é", "漢", "\U0001f600", ".", "!?", "_", "\r\n", "€", "’", "the", "of"]


def test_matches_begin_where_the_pattern_finds_them():
    assert pieces.CLASSED == public_tokenizers.PATTERN
    draw = random.Random(3)
    texts = ["".join(draw.choice(ALPHABET) for _ in range(draw.randrange(14))) for _ in range(20_000)]
    full = pieces.splitters(pieces.CLASSED)[1]
    for column in (texts, [t for t in texts if t.isascii()]):
        for chunk in text_chunks(pa.array(column), 1 << 14):
            begin = pieces.starts(chunk.data, chunk.offsets)
            end, first, raw = np.append(begin, len(chunk.data)), np.searchsorted(begin, chunk.offsets), chunk.data.tobytes()
            for i, text in enumerate(column[chunk.lo:chunk.hi]):
                assert [raw[end[j]:end[j + 1]].decode() for j in range(first[i], first[i + 1])] == full.findall(text), text


def test_each_distinct_match_of_a_chunk_is_looked_up_once():
    asked = []

    class Counted(pieces.Pieces):
        def __getitem__(self, piece):
            asked.append(piece)
            return super().__getitem__(piece)

    tokenizer = Tokenizer.from_file(packing.TOKENIZER)
    texts = ["to be or not to be, " * 300, "", "it's it's\n\n it's", "café to be"]
    (chunk,) = text_chunks(pa.array(texts))
    got = Counted(tokenizer, packing.PATTERN).chunk_ids(chunk.data, chunk.offsets)
    assert [x.tolist() for x in got] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(asked) == len(set(asked)) <= 16


def test_another_pattern_is_matched_as_it_is():
    texts = ["one two, three", ""]
    (chunk,) = text_chunks(pa.array(texts))
    some = pieces.Pieces(Tokenizer.from_file(packing.TOKENIZER), r"\w+|\W")
    assert [x.tolist() for x in some.chunk_ids(chunk.data, chunk.offsets)] == [x.tolist() for x in some.all_ids(texts)]
