"""Ids from remembered pieces against the library's own, and how much text the library is given."""

import random

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from tankline.llm import vocab
from tankline.llm.vocab import Encoder, Vocabulary

JSON = P.path("byte_bpe_50k.json")
#: What the pattern treats alike or apart: contractions, runs of white space, digits, marks, letters beyond ASCII, controls.
BITS = ["a", "It", "word", "s", "t", "re", "ll", "'", "'s", "'ll", "''", ".", ",", "...", "&&&", "\n", "\n", "\n\n", "\r\n", "\t", "\x0b", "\x1c", "\x00", "\x85", " ", "　", "1", "23", "é", "ñx", "ß", "字", "🙂", "é", "²", "_", "<|endoftext|>", " ", " ", " ", " ", "  "]


@pytest.mark.parametrize(("most", "parts"), [(150_000_000, 1_000_000), (3_000, 7), (0, 1)])
def test_ids_of_pieces_are_those_of_the_library(monkeypatch, most, parts):
    monkeypatch.setattr(vocab, "PARTS", parts)
    library, work, rng = Tokenizer.from_file(JSON), Encoder(Vocabulary(JSON), False, most=most), random.Random(11)
    for _ in range(30):
        texts = ["".join(rng.choices(BITS, k=rng.randint(0, 30))) for _ in range(60)] + ["", " ", "x" * 700 + ".", ("y" * 300 + ",\nz ") * 3 + "end"]
        wanted = [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]
        assert work(texts) == wanted
        ids, bounds = work.flat(texts)
        assert [ids[a:b].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)] == wanted
        assert work.store.held <= most  # the bound holds between calls
    assert all(len(ids) == 0 and bounds.tolist() == [0] * (n + 1) for n in (0, 3) for ids, bounds in [work.flat([""] * n)])


def test_pieces_end_where_letters_do():
    chunks = pa.array(["left out", "plain", "aioi.\nCh", "it's,", "x\r\nY", "a\n\nB", ".\nThen", "é.b1é", "é"], pa.large_string())[1:]
    found, first = vocab.pieces(chunks)
    rows = found.to_pylist()
    assert [rows[a:b] for a, b in zip(first, first[1:], strict=False)] == [["plain"], ["aioi", ".\n", "Ch"], ["it's", ","], ["x", "\r\nY"], ["a", "\n\nB"], [".\n", "Then"], ["é.b", "1é"], ["é"]]


def test_the_library_sees_a_word_once_whatever_stands_behind_it():
    work, rng = Encoder(Vocabulary(JSON), False), random.Random(5)
    library, given = work.library, []
    work.library = lambda texts: given.extend(texts) or library(texts)
    words = ["".join(rng.choices("abcdefghij", k=12)) for _ in range(100)]
    texts = [" ".join(["-", *(w + end for w in words)]) for end in ("", ".", ",", ";", "!", "?", ":", "&&&", "###", ".\nThen")]
    assert work(texts) == [np.array(ids, "<u4").tobytes() for ids in library(texts)]
    assert sum(map(len, given)) < 2 * sum(len(w) + 1 for w in words)
