"""Encoding with the tokenizers and sentencepiece libraries inside tasks, remembering space-led chunks."""

from __future__ import annotations

import hashlib
import json
import os
from array import array
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tankline.llm.chunks import cuttable
from tankline.llm.memory import ENTRY, LONG, working_set
from tankline.llm.words import numbered

#: How byte-level vocabularies write a space.
SPACE = "\u0120"

#: Bytes that are ASCII letters, those that end a run of letters (the apostrophe is left out, so that "it's" stays one), and visible ASCII.
LETTER, STOP, VISIBLE = np.zeros((3, 256), bool)
LETTER[[c for c in range(128) if chr(c).isalpha()]] = True
STOP[:128] = ~LETTER[:128]
STOP[ord("'")] = False
VISIBLE[33:127] = True
#: Parts whose ids are gathered at once.
PARTS = 200_000


class Vocabulary:
    """A tokenizer file as the driver read it; what is broadcast is its contents, never a path."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.raw = f.read()
        self.kind = "sentencepiece" if path.endswith(".model") else "tokenizers"
        self.specials: tuple[str, ...] = ()
        self.cut = False
        if self.kind == "tokenizers":
            spec = json.loads(self.raw)
            pre = spec.get("pre_tokenizer") or {}
            self.specials = tuple(x["content"] for x in spec.get("added_tokens") or ())
            # only a byte-level splitter without a normalizer starts a pre-token at each lone space
            self.cut = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
        self.key = hashlib.sha256(self.raw).hexdigest()


def pieces(chunks: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Chunks (large_string) cut again where an ASCII letter meets an ASCII character that is none, and where a lone
    line break behind a visible character meets an ASCII letter; and the number of each chunk's first piece, and of all.

    No match of the byte-level pattern goes beyond the end of a run of letters, and white space before a letter is looked at
    as a run, here of one, so that each piece has the tokens that it has within the text."""
    _, raw_ends, raw = chunks.buffers()
    borders = np.frombuffer(raw_ends, np.int64)[chunks.offset : chunks.offset + len(chunks) + 1]
    if not borders[-1]:
        return chunks, np.arange(len(chunks) + 1)
    data = np.frombuffer(raw, np.uint8, borders[-1])
    breaks = np.flatnonzero(data[1:-1] == 10) + 1
    begins = np.zeros(len(data) + 1, bool)
    begins[1:-1] = LETTER[data[:-1]] & STOP[data[1:]]
    begins[breaks[VISIBLE[data[breaks - 1]] & LETTER[data[breaks + 1]]] + 1] = True
    begins[: borders[0]] = False
    begins[borders] = True
    ends = np.flatnonzero(begins)
    return pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), raw), np.searchsorted(ends, borders)


def gathered(ids: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The given spans of `ids`, one after the other."""
    out, at = np.empty(int(sizes.sum()), ids.dtype), 0
    for k in range(0, len(sizes), PARTS):
        some = sizes[k : k + PARTS]
        ends = np.cumsum(some)
        out[at : at + ends[-1]] = ids[np.repeat(begins[k : k + PARTS] - ends + some, some) + np.arange(ends[-1])]
        at += int(ends[-1])
    return out


class Store:
    """Ids of numbered pieces in one array, and the numbers of pieces: of those that follow a space and of those within chunks."""

    def __init__(self):
        self.ids, self.ends, self.n, self.held = np.zeros(1 << 16, "<u4"), np.zeros(1 << 14, np.int64), 0, 0
        self.led: dict[str, int] = {}
        self.inner: dict[str, int] = {}

    def add(self, numbers: dict[str, int], keys: list[str], ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Numbers of new pieces; long ones are forgotten with the store."""
        begin, n = int(self.ends[self.n]), self.n
        if begin + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids[:begin], np.zeros(begin + 2 * len(ids), "<u4")))
        if n + len(keys) >= len(self.ends):
            self.ends = np.concatenate((self.ends[: n + 1], np.zeros(n + 2 * len(keys), np.int64)))
        self.ids[begin : begin + len(ids)] = ids
        self.ends[n + 1 : n + len(keys) + 1] = begin + np.cumsum(sizes)
        self.n = n + len(keys)
        numbers.update(zip(keys, range(n, self.n), strict=True))
        for k in keys:
            if len(k) > LONG:
                del numbers[k]
        self.held += sum(map(len, keys)) + ENTRY * len(keys)
        return np.arange(n, self.n)

    def spans(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begins = self.ends[numbers]
        return begins, self.ends[numbers + 1] - begins


class Encoder:
    """Ids (as little-endian unsigned 32-bit bytes) or counts of whole texts.

    Chunks that a worker has not met are encoded together, as one text: each begins with a space, so each of its
    tokens that begins with one begins a chunk.  `pinned` chunks are always known to counts.  For ids, chunks are cut
    into :func:`pieces`, of which there are fewer distinct ones.
    """

    def __init__(self, vocabulary: Vocabulary, lengths: bool, pinned: dict | None = None, most: int = 150_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.v, self.lengths, self.pinned, self.most = vocabulary, lengths, pinned or {}, most
        self.cache, self.held = dict(self.pinned), 0
        self.store = Store()
        if vocabulary.kind == "sentencepiece":
            import sentencepiece

            processor = sentencepiece.SentencePieceProcessor(model_proto=vocabulary.raw)
            self.library = lambda texts: processor.encode(texts, num_threads=1)
        else:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_str(vocabulary.raw.decode("utf-8"))
            tokenizer.no_truncation()
            tokenizer.no_padding()
            self.library = lambda texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            self.leads = np.zeros(tokenizer.get_vocab_size(with_added_tokens=True), bool)
            self.leads[[i for token, i in tokenizer.get_vocab(with_added_tokens=False).items() if token.startswith(SPACE)]] = True

    def whole(self, texts: list[str]) -> list:
        """By the library alone."""
        ids = self.library(texts) if texts else []
        return [len(x) for x in ids] if self.lengths else [array("I", x).tobytes() for x in ids]

    def joined(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks (without their leading space), one after the other, and how many each has."""
        if not chunks:
            return self.alone(chunks)
        ids = np.array(self.library([" " + " ".join(chunks)])[0], "<u4")
        begin = np.flatnonzero(self.leads[ids])
        if len(begin) != len(chunks):  # a vocabulary that doesn't keep the space at a token's head
            return self.alone([" " + c for c in chunks])
        return ids, np.diff(np.append(begin, len(ids)))

    def alone(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts by the library alone, one after the other, and how many each has."""
        found = self.library(texts) if texts else []
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), "<u4", int(sizes.sum())), sizes

    def chunks(self, chunks: list[str]) -> list:
        """Of chunks without their leading space."""
        ids, sizes = self.joined(chunks)
        if self.lengths:
            return sizes.tolist()
        raw, ends = ids.tobytes(), 4 * np.cumsum(sizes)
        return [raw[a:b] for a, b in zip((ends - 4 * sizes).tolist(), ends.tolist(), strict=True)]

    def __call__(self, texts: list[str]) -> list:
        """One value for each text, from the library or from chunks that it has encoded."""
        if not self.lengths:
            ids, bounds = self.flat(texts)
            raw, bounds = ids.tobytes(), (4 * bounds).tolist()
            return [raw[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
        if not self.v.cut:
            return self.whole(texts)
        even = [i for i, t in enumerate(texts) if cuttable(t, self.v.specials)]
        odd = sorted(set(range(len(texts))).difference(even))
        out: list = [None] * len(texts)
        for i, v in zip(odd, self.whole([texts[i] for i in odd]), strict=True):
            out[i] = v
        for i, v in zip(even, self._cut([texts[i] for i in even]), strict=True):
            out[i] = v
        return out

    def flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text begins and the last one ends."""
        even = [self.v.cut and cuttable(t, self.v.specials) for t in texts]
        # what stands before a text's first space, and texts that aren't cut
        head_ids, head_sizes = self.alone([t.partition(" ")[0] if e else t for t, e in zip(texts, even, strict=True)])
        if not any(even):
            return head_ids, np.concatenate(([0], np.cumsum(head_sizes)))
        distinct, numbers, offsets = numbered([t if e else "" for t, e in zip(texts, even, strict=True)], lambda a: pc.split_pattern(a, " "))
        heads, rest = offsets[:-1], np.ones(len(numbers), bool)
        rest[heads] = False
        used = np.flatnonzero(np.bincount(numbers[rest], minlength=len(distinct)))
        ids, ends = self._chunk_ids(distinct.take(pa.array(used)))
        place = np.zeros(len(distinct), np.int64)
        place[used] = np.arange(len(used))
        numbers = place[numbers]
        begins, sizes = np.append(ends, 0)[numbers], np.append(np.diff(ends), 0)[numbers]
        begins[heads], sizes[heads] = len(ids) + np.cumsum(head_sizes) - head_sizes, head_sizes
        return gathered(np.concatenate((ids, head_ids)), begins, sizes), np.concatenate(([0], np.cumsum(sizes)))[offsets]

    def _chunk_ids(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct chunks (without their leading space) one after the other, and where each begins and the last one ends."""
        if not len(chunks):
            return np.zeros(0, "<u4"), np.zeros(1, np.int64)
        parts, first = pieces(chunks)
        led = np.zeros(len(parts), bool)
        led[first[:-1]] = True
        numbers, at_hand = np.empty(len(parts), np.int64), []
        for mask, known, encode in ((led, self.store.led, self.joined), (~led, self.store.inner, self.alone)):
            coded = parts.filter(pa.array(mask)).dictionary_encode()
            keys = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
            found = np.fromiter(map(known.get, keys, repeat(-1)), np.int64, len(keys))
            missing = np.flatnonzero(found < 0)
            need = [keys[k] for k in missing.tolist()]
            found[missing] = self.store.add(known, need, *encode(need))
            numbers[mask] = found[np.asarray(coded.indices)]
            at_hand.append((keys, found))
        begins, sizes = self.store.spans(numbers)
        ids, ends = gathered(self.store.ids, begins, sizes), np.concatenate(([0], np.cumsum(sizes)))[first]
        if self.store.held > self.most:
            self._renew(*at_hand)
        return ids, ends

    def _renew(self, led: tuple[list[str], np.ndarray], inner: tuple[list[str], np.ndarray]) -> None:
        """A new store.  The pieces at hand stay if they take half of the bound at most, as frequent ones are always among them."""
        old, self.store = self.store, Store()
        if sum(len(k) + ENTRY for keys, _ in (led, inner) for k in keys) <= self.most // 2:
            for known, (keys, found) in ((self.store.led, led), (self.store.inner, inner)):
                begins, sizes = old.spans(found)
                self.store.add(known, keys, gathered(old.ids, begins, sizes), sizes)

    def _cut(self, texts: list[str]) -> list:
        """Of texts that may be cut at their spaces; each distinct chunk is looked up once."""
        distinct, numbers, offsets = numbered(texts, lambda a: pc.split_pattern(a, " "))
        rest = np.ones(len(numbers), bool)
        rest[offsets[:-1]] = False  # what stands before a text's first space
        numbers, offsets = numbers[rest], offsets - np.arange(len(offsets))
        used = np.flatnonzero(np.bincount(numbers, minlength=len(distinct)))
        values = self._values(distinct.take(pa.array(used)).to_pylist())
        heads = self.whole([t.partition(" ")[0] for t in texts])
        place = np.zeros(len(distinct), np.int64)
        place[used] = np.arange(len(used))
        numbers = place[numbers]
        if self.lengths:
            ends = np.concatenate(([0], np.cumsum(np.array(values, np.int64)[numbers])))[offsets]
            return [h + n for h, n in zip(heads, np.diff(ends).tolist(), strict=True)]
        parts = np.empty(len(values), object)
        parts[:] = values
        parts, bounds = parts[numbers].tolist(), offsets.tolist()
        return [h + b"".join(parts[a:b]) for h, a, b in zip(heads, bounds, bounds[1:], strict=False)]

    def _values(self, chunks: list[str]) -> list:
        """What distinct chunks encode to, remembered within the bound."""
        values = list(map(self.cache.get, chunks))
        missing = [k for k, v in enumerate(values) if v is None]
        need = [chunks[k] for k in missing]
        self.held += sum(map(len, need)) + ENTRY * len(need)
        if self.held > self.most:
            # the chunks at hand stay, as frequent ones are always among them
            stay = {c: v for c, v in zip(chunks, values, strict=True) if v is not None}
            self.cache = self.pinned | stay
            self.held = sum(map(len, need)) + sum(map(len, stay)) + ENTRY * (len(stay) + len(need))
        made = self.chunks(need)
        self.cache.update((c, v) for c, v in zip(need, made, strict=True) if len(c) <= LONG)
        for k, v in zip(missing, made, strict=True):
            values[k] = v
        return values


def encoder(shared, lengths: bool, table=None) -> Encoder:
    """One encoder in a worker for each vocabulary and use, so that its cache outlives a task."""
    key = ("vocabulary", shared.value.key, lengths, table.value.key if table is not None else None)
    return working_set(key, lambda: Encoder(shared.value, lengths, table.value.lengths() if table is not None else None))
