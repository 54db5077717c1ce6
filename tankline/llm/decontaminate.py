"""Benchmark decontamination under edit distance (operator 4).

A passage of a document leaks an item if it turns into the item's words with at most
a fifth as many word edits (insertions, deletions, replacements) as the item has words.

0. *Pieces.*  The walks below drift apart with an item's length, so items of more than `PIECE` words are searched by
   pieces of like size, of `PIECE` words at most.  The edits of a match fall on the pieces, so one of them at least has no more
   than a fifth of its own words edited: to find each piece at its own bound loses no item.
1. *Windows.*  With at most a fifth of n words edited, some run of three words of a piece stays whole (two of five words, all of
   fewer).  So a window is worth a look only if such a run stands in it where a piece of its size has it; the windows that come from a run
   are those of each size and offset, however many pieces share it.
2. *CGK embedding.*  A window and a piece are walked along by the same random bits: at each step the word
   at the pointer is written down and a bit that depends on step and word moves the pointer on.  Few
   edits give few differing places.
3. *Bit sampling.*  `WALKS` walks with `DRAWS` draws of `SAMPLE` places each; a window and a piece of one length
   are candidates if they agree on all places of any draw.  Draws of one walk hang together, so the recall is measured:
   the target is 0.99 at the bound, for every length.
4. *Exact.*  A candidate is kept if the semi-global edit distance between the whole item and the words
   around the place where it would begin is within the bound.

Words are what stands between white space and ASCII punctuation; each character of a script that is written without spaces is a
word.  Items are taken in blocks of at most `BLOCK_BYTES` of text, whose index (sorted keys in numpy) takes some eight times as much, so what
is broadcast is bounded; documents are never shuffled.

Defined results: null and empty texts leak nothing; items without words are in no text; items of fewer than five words must stand
word for word; equal items, and items without an id, each give a row; repeated rows are independent; long texts are searched whole.
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tankline.llm.common import append_columns

WALKS, DRAWS, SAMPLE = 16, 12, 4
GRAM = 3
PIECE = 50
BLOCK_BYTES = 8_000_000
#: Windows that are walked at once, keys of pieces that are looked at at once.
WINDOWS, PAIRS = 10_000, 2_000_000
#: Thai, Lao, Myanmar, Khmer, kana and Han characters.
ALONE = re.compile("([\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff])")
#: ASCII punctuation and controls become spaces, capitals small.
TO_WORDS = bytes(ord(chr(b).lower()) if chr(b).isalnum() or b > 127 else 32 for b in range(256))

LEAKS = T.ArrayType(
    T.StructType([T.StructField("item_id", T.LongType()), T.StructField("distance", T.IntegerType()), T.StructField("item_words", T.IntegerType()), T.StructField("at_word", T.IntegerType())])
)


def words_of(text: str) -> list[bytes]:
    if not text.isascii():
        text = ALONE.sub(r" \1 ", text)
    return text.lower().encode("utf-8", "surrogatepass").translate(TO_WORDS).split()


def most_edits(n: int) -> int:
    """A fifth of the words."""
    return n // 5


def whole_run(n: int) -> int:
    """Words that stand together in n words whatever is edited within the bound, three at most."""
    edits = most_edits(n)
    return min(GRAM, -(-(n - edits) // (edits + 1)))


def _ranges(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of several ranges, and which range each is of."""
    many = last - first
    owner = np.repeat(np.arange(len(many)), many)
    return np.repeat(first - (np.cumsum(many) - many), many) + np.arange(int(many.sum())), owner


class Items:
    """A block of items: their words as numbers, where runs of words stand in pieces of each size, and the pieces' sampled embeddings."""

    def __init__(self, ids: list[int | None], texts: list[str], seed: int = 7):
        self.vocab: dict[bytes, int] = {}
        self.ids, self.words = [], []
        for i, text in zip(ids, texts, strict=True):
            if w := words_of(text or ""):
                self.ids.append(i)
                self.words.append(np.array([self.vocab.setdefault(x, len(self.vocab) + 1) for x in w], np.int64))
        self.base = len(self.vocab) + 1
        self.lengths = np.array([len(w) for w in self.words], np.int64)
        pieces, self.item_of, self.piece_at = [], [], []
        for k, w in enumerate(self.words):
            at = 0
            for piece in np.array_split(w, -(-len(w) // PIECE)):
                pieces.append(piece)
                self.item_of.append(k)
                self.piece_at.append(at)
                at += len(piece)
        self.item_of, self.piece_at = np.array(self.item_of, np.int64), np.array(self.piece_at, np.int64)
        sizes = np.array([len(w) for w in pieces], np.int64)
        # distinct (code of a run, size, offset), by the run's length
        self.runs: dict[int, tuple[np.ndarray, ...]] = {}
        for gram in range(1, GRAM + 1):
            rows = [np.stack((self.codes(w, gram), np.full(len(w) - gram + 1, len(w)), np.arange(len(w) - gram + 1))) for w in pieces if whole_run(len(w)) == gram]
            if rows:
                code, size, offset = np.unique(np.concatenate(rows, axis=1), axis=1)
                codes, first = np.unique(code, return_index=True)
                self.runs[gram] = codes, first, np.append(first[1:], len(code)), size, offset
        steps = 2 * int(sizes.max()) if len(sizes) else 0
        self.bits = np.random.default_rng(seed).integers(1, 1 << 62, (WALKS, max(1, steps)), np.int64) | 1
        self.places = {int(n): np.sort(np.random.default_rng(seed + int(n)).integers(0, max(1, 3 * int(n) // 2), (WALKS, DRAWS, SAMPLE)), axis=2) for n in np.unique(sizes)}
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in self.places:
            own = np.flatnonzero(sizes == n)
            keys = self.sketch(np.stack([pieces[k] for k in own]), n)
            order = np.argsort(keys, axis=None, kind="stable")
            self.tables[n] = keys.ravel()[order], own[order // keys.shape[1]].astype(np.int32)

    def codes(self, words: np.ndarray, gram: int) -> np.ndarray:
        """One number for each run of so many words."""
        out = words[: len(words) - gram + 1].copy()
        for k in range(1, gram):
            out = out * self.base + words[k : len(words) - gram + 1 + k]
        return out

    def sketch(self, windows: np.ndarray, n: int) -> np.ndarray:
        """Keys (windows, draws) of windows of n words; keys of different draws are never equal but by chance."""
        keys = np.zeros((len(windows), WALKS, DRAWS), np.uint64)
        draws = np.arange(WALKS * DRAWS, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        places = self.places[n]
        steps = int(places.max()) + 1
        walks = np.arange(WALKS)
        for lo in range(0, len(windows), 2000):
            part = windows[lo : lo + 2000]
            padded = np.concatenate((part, np.full((len(part), 1), -1, np.int64)), axis=1)
            rows = np.arange(len(part))[:, None]
            at = np.zeros((len(part), WALKS), np.int64)
            written = np.empty((steps, len(part), WALKS), np.int64)
            for step in range(steps):
                word = padded[rows, at]
                written[step] = word
                at += (((word + 2) * self.bits[:, step]) >> 33) & 1
                np.minimum(at, n, out=at)
            for draw in range(DRAWS):
                key = np.zeros((len(part), WALKS), np.uint64)
                for k in range(SAMPLE):
                    word = written[places[:, draw, k], :, walks].T
                    key = (key ^ (word + 2).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(k + 1)) * np.uint64(0xBF58476D1CE4E5B9)
                keys[lo : lo + 2000, :, draw] = key
        return keys.reshape(len(windows), -1) + draws

    def _windows(self, seq: np.ndarray, begin: np.ndarray) -> dict[int, np.ndarray]:
        """Of each size the windows (text, start) that hold a whole run where a piece has it; a start may lie before its text."""
        span = len(seq) + 2 * PIECE
        out: dict[int, list[np.ndarray]] = {}
        for gram, (codes, first, last, size, offset) in self.runs.items():
            known = seq > 0
            live = known[: len(seq) - gram + 1].copy()
            for k in range(1, gram):
                live &= known[k : len(seq) - gram + 1 + k]
            place = np.flatnonzero(live)
            code = self.codes(seq, gram)[place]
            k = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
            place, k = place[codes[k] == code], k[codes[k] == code]
            ends = np.cumsum(last[k] - first[k])
            lo = 0
            while lo < len(place):  # a bounded number at once
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIRS)))
                rows, owner = _ranges(first[k[lo:hi]], last[k[lo:hi]])
                at, n = place[lo:hi][owner], size[rows]
                window = (np.searchsorted(begin, at, "right") - 1) * span + at - offset[rows] + PIECE
                for s in np.unique(n):
                    out.setdefault(int(s), []).append(np.unique(window[n == s]))
                lo = hi
        merged = {n: np.unique(np.concatenate(w)) for n, w in out.items()}
        return {n: np.stack((w // span, w % span - PIECE)) for n, w in merged.items()}

    def leaks(self, texts: list[str]) -> list[list[dict]]:
        """Leaks of each text."""
        out: list[list[dict]] = [[] for _ in texts]
        if not self.ids:
            return out
        parts = []
        for text in texts:
            w = words_of(text)
            parts.append(np.fromiter(map(self.vocab.get, w, repeat(0)), np.int64, len(w)))
        begin = np.cumsum([0] + [len(p) + GRAM for p in parts])
        seq = np.zeros(int(begin[-1]), np.int64)
        for b, p in zip(begin, parts, strict=False):
            seq[b : b + len(p)] = p
        found: dict[tuple[int, int], set[int]] = {}
        for size, windows in self._windows(seq, begin).items():
            keys, owners = self.tables[size]
            for lo in range(0, windows.shape[1], WINDOWS):
                d, s = windows[:, lo : lo + WINDOWS]
                places = s[:, None] + np.arange(size)[None, :]
                inside = (places >= begin[d][:, None]) & (places < begin[d + 1][:, None] - GRAM)
                sketch = self.sketch(np.where(inside, seq[np.clip(places, 0, len(seq) - 1)], 0), size)
                first, last = np.searchsorted(keys, sketch.ravel(), "left"), np.searchsorted(keys, sketch.ravel(), "right")
                hit = np.flatnonzero(last > first)
                ends = np.cumsum(last[hit] - first[hit])
                at = 0
                while at < len(hit):
                    to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS)))
                    rows, owner = _ranges(first[hit[at:to]], last[hit[at:to]])
                    pairs = np.unique(np.stack((hit[at:to][owner] // sketch.shape[1], owners[rows])), axis=1)
                    for r, k in pairs.T.tolist():
                        found.setdefault((int(d[r]), int(self.item_of[k])), set()).add(int(s[r]) - int(self.piece_at[k]))
                    at = to
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for (d, k_item), starts in found.items():
            size, most = int(self.lengths[k_item]), most_edits(int(self.lengths[k_item]))
            first, last = int(begin[d]), int(begin[d + 1]) - GRAM
            group: list[int] = []
            for s in [*sorted(starts), None]:
                # starts whose words overlap are measured together first: none of them is nearer than all
                if group and (s is None or s - most > group[-1] + size + most):
                    least = semi_global(self.words[k_item], seq[max(first, group[0] - most) : min(last, group[-1] + size + most)])
                    for own in group if least <= most else ():
                        if best.get((d, k_item), (most + 1,))[0] <= least:
                            break
                        distance = least if len(group) == 1 else semi_global(self.words[k_item], seq[max(first, own - most) : min(last, own + size + most)])
                        if distance <= most and (distance, own) < best.get((d, k_item), (1 << 30, 0)):
                            best[d, k_item] = (distance, own)
                    group = []
                group.append(s)
        for (d, k_item), (distance, s) in sorted(best.items()):
            out[d].append({"item_id": self.ids[k_item], "distance": distance, "item_words": int(self.lengths[k_item]), "at_word": max(0, s - int(begin[d]))})
        return out


def semi_global(item: np.ndarray, words: np.ndarray) -> int:
    """Fewest edits that turn some stretch of `words` into `item`; number 0 equals nothing."""
    row = np.zeros(len(words) + 1, np.int64)
    steps = np.arange(len(words) + 1)
    for i, w in enumerate(item):
        new = np.empty_like(row)
        new[0] = i + 1
        new[1:] = np.minimum(row[:-1] + (words != w), row[1:] + 1)
        row = np.minimum.accumulate(new - steps) + steps
    return int(row.min())


def item_blocks(benchmark: DataFrame, most_bytes: int = BLOCK_BYTES):
    """Items (ids, texts) in blocks of about `most_bytes`; each is collected alone."""
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string").alias("text")).where("text is not null")
    size = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = int(size // most_bytes) + 1
    for b in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        rows = part.toArrow()
        yield rows.column(0).to_pylist(), rows.column(1).to_pylist()


def with_leaks(docs: DataFrame, benchmark: DataFrame, name: str = "leaks") -> DataFrame:
    """All columns and the array of leaks as `name`, empty for clean documents; one narrow pass for each block of items.

    A column of `docs` with that name is replaced; no other is touched, whatever its name."""
    block = f"{name}_of_block"
    while block in docs.columns:
        block = f"_{block}"
    out = docs.withColumn(name, F.array().cast(LEAKS))
    for ids, texts in item_blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(Items(ids, texts))

        def kernel(shared=shared):
            return lambda texts: [pa.array(shared.value.leaks(texts), pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("item_words", pa.int32()), ("at_word", pa.int32())])))]

        out = append_columns(out, kernel, [T.StructField(block, LEAKS)]).withColumn(name, F.concat(name, block)).drop(block)
    return out


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, distance, item_words, at_word of every leak."""
    found = with_leaks(docs.select("doc_id", F.col("text").cast("string").alias("text")), benchmark)
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")
