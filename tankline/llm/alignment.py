"""Alignment of the tokens that two tokenizers make of a text (operator 12).

The byte offsets where a token of A and a token of B both end cut the tokens into groups.  The ends of all texts of a
slice form two ascending arrays.  Merge-path partitioning divides their merge: a binary search on each diagonal of the
(A, B) grid finds the point where the merge crosses it, so that pieces between neighbouring diagonals hold equal work and
are independent of each other (an end that stands in both arrays is never parted).  A piece emits its overlaps (the common
ends); tokens after its last one belong to the first group of the next piece, which is stitched by a running count.

Which pairs of ids can be linked at all follows from the vocabularies: the shorter token must be a suffix of the longer.
These pairs are numbered beforehand (at most one for each suffix of each token, some hundred thousands, whatever the
corpus), so corpus-wide counts are an array of a proven size.  The first pass writes each document's links as pair
numbers, tasks sum them by pair, and the second pass reads the links again with the counts.

Chunks between lone spaces are encoded once and remembered: no token of A or B continues over a space that follows another character.

Defined results: null, empty and unfaithful texts (whose tokens' bytes differ from space + text) have zeros and an empty digest;
repeated rows are independent but count for the corpus each; a null doc_id stays null; columns other than doc_id and text are ignored, whatever
their names; an empty table gives no rows.  Very long texts are encoded whole; digests are made in blocks.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tankline.llm.chunks import ODD
from tankline.llm.common import bound_batches, materialize, slices
from tankline.llm.memory import releasing, working_set
from tankline.llm.vocab import SPACE, Encoder, Vocabulary

#: Tokens of A and B together that a piece of the merge holds, and codes that a digest takes at once.
WORK, BLOCK = 65_536, 1_000_000
#: Texts that the piece tokenizer must see whole: white-space runs, a space at the end, its own mark of a space.
ODD_PIECES = re.compile("  | \\Z|\u2581")
#: Bytes of what one side's worker cache may hold.
CACHE = 60_000_000


class _Plain(Encoder):
    """Ids of space + text, special tokens' strings being ordinary text."""

    def __init__(self, vocabulary: Vocabulary, most: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.v, self.lengths, self.pinned, self.most, self.cache, self.held = vocabulary, False, {}, most, {}, 0
        if vocabulary.kind == "sentencepiece":
            import sentencepiece

            processor = sentencepiece.SentencePieceProcessor(model_proto=vocabulary.raw)
            pieces = [processor.id_to_piece(i) for i in range(processor.get_piece_size())]
            self.odd, self.cut = ODD_PIECES, not any("\u2581" in p.lstrip("\u2581") for p in pieces)
            self.library = lambda texts: processor.encode(texts, num_threads=1)
            self.bytes = [bytes([int(p[3:5], 16)]) if processor.is_byte(i) else p.replace("\u2581", " ").encode() for i, p in enumerate(pieces)]
            self.chunks = lambda chunks: [array("I", x).tobytes() for x in self.library(chunks)]
        else:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_str(vocabulary.raw.decode("utf-8"))
            tokenizer.no_truncation()
            tokenizer.no_padding()
            tokenizer.encode_special_tokens = True
            self.odd, self.cut = ODD, vocabulary.cut
            self.library = lambda texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            names = {i: t for t, i in tokenizer.get_vocab(with_added_tokens=True).items()}
            own = {i: t for t, i in tokenizer.get_vocab(with_added_tokens=False).items()}
            byte = byte_alphabet()
            self.bytes = [bytes(byte[c] for c in own[i]) if i in own and all(c in byte for c in own[i]) else names.get(i, "").encode() for i in range(max(names) + 1)]
            self.leads = np.array([own.get(i, "").startswith(SPACE) for i in range(len(self.bytes))])
        self.sizes = np.array([len(b) for b in self.bytes], np.int64)

    def whole(self, texts: list[str]) -> list[bytes]:
        own = [t[1:] for t in texts] if self.v.kind == "sentencepiece" else texts  # the piece tokenizer adds the space itself
        return [array("I", x).tobytes() for x in self.library(own)] if own else []

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Of texts that begin with the added space."""
        even = [i for i, t in enumerate(texts) if self.cut and not self.odd.search(t)]
        odd = sorted(set(range(len(texts))).difference(even))
        out: list = [None] * len(texts)
        for places, ids in ((odd, self.whole([texts[i] for i in odd])), (even, self._cut([texts[i] for i in even]) if even else [])):
            for i, x in zip(places, ids, strict=True):
                out[i] = x
        return out


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: itself if it is printable Latin-1, else those from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Pairs:
    """All pairs of an A and a B id that can be linked, in ascending order, and their numbers."""

    def __init__(self, a: list[bytes], b: list[bytes]):
        self.width = len(b)
        codes = set()
        for ours, theirs, code in ((a, b, lambda i, j: i * self.width + j), (b, a, lambda i, j: j * self.width + i)):
            by: dict[bytes, list[int]] = {}
            for j, t in enumerate(theirs):
                by.setdefault(t, []).append(j)
            for i, t in enumerate(ours):
                for k in range(len(t)):
                    codes.update(code(i, j) for j in by.get(t[k:], ()))
        self.codes = np.array(sorted(codes), np.int64)

    def number(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.codes, a.astype(np.int64) * self.width + b)

    def ids(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.codes[numbers] // self.width, self.codes[numbers] % self.width

    def best(self, counts: np.ndarray) -> np.ndarray:
        """Which pairs have the highest count of their B id."""
        most = np.zeros(self.width, np.int64)
        np.maximum.at(most, self.codes % self.width, counts)
        return counts == most[self.codes % self.width]


def crossings(a: np.ndarray, b: np.ndarray, work: int = WORK) -> list[tuple[int, int]]:
    """Points (i, j) where the merge of two ascending arrays crosses every `work`-th diagonal, from (0, 0) to the ends.

    All diagonals are searched at once.  Equal ends stay on one side, so a diagonal may be passed by one."""
    d = np.arange(work, len(a) + len(b), work)
    low, high = np.maximum(0, d - len(b)), np.minimum(d, len(a))
    while (going := low < high).any():
        mid = (low + high) // 2
        first = going & (a[np.minimum(mid, len(a) - 1)] <= b[np.clip(d - 1 - mid, 0, len(b) - 1)])
        low, high = np.where(first, mid + 1, low), np.where(going & ~first, mid, high)
    i, j = low, d - low
    apart = (i > 0) & (j < len(b))
    apart[apart] = a[i[apart] - 1] == b[j[apart]]
    return [(0, 0), *zip(i.tolist(), (j + apart).tolist(), strict=True), (len(a), len(b))]


def overlaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places in `a` and in `b` (two rows) of what a piece's arrays have in common."""
    if not len(a) or not len(b):
        return np.zeros((2, 0), np.int64)
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    hit = np.flatnonzero(b[at] == a)
    return np.stack([hit, at[hit]])


def common_ends(a: np.ndarray, b: np.ndarray, work: int = WORK) -> np.ndarray:
    """Places of all common ends, piece by piece: the k-th ends group k, so what pieces leave open goes on in the next one."""
    points = crossings(a, b, work)
    found = [overlaps(a[i:k], b[j:m]) + np.array([[i], [j]]) for (i, j), (k, m) in zip(points, points[1:], strict=False)]
    return np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)


class Aligner:
    """What a worker keeps: both encoders, the pairs' numbers and the decimal texts of ids with their separators."""

    def __init__(self, a: Vocabulary, b: Vocabulary, pairs: Pairs | None = None):
        self.a, self.b = _Plain(a), _Plain(b)
        self.pairs = pairs or Pairs(self.a.bytes, self.b.bytes)
        na, nb = len(self.a.bytes), len(self.b.bytes)
        self.texts = [b"%d%c" % (i, sep) for n, sep in ((na, b","), (na, b"|"), (nb, b","), (nb, b";")) for i in range(n)]

    def _faithful(self, side: _Plain, ids: np.ndarray, raw: bytes) -> bool:
        return int(side.sizes[ids].sum()) == len(raw) and b"".join(map(side.bytes.__getitem__, ids.tolist())) == raw

    def __call__(self, texts: list[str]) -> list[tuple[int, int, bytes, np.ndarray, np.ndarray, np.ndarray]]:
        """For each text: tokens of A and of B, digest, pair numbers of the links, tokens of A and of B in each group."""
        empty = (0, 0, b"", *[np.zeros(0, np.int32)] * 3)
        out = [empty] * len(texts)
        some = [k for k, t in enumerate(texts) if t]
        spaced = [" " + texts[k] for k in some]
        ids = [[np.frombuffer(x, "<u4") for x in side(spaced)] for side in (self.a, self.b)]
        kept = []
        for n, text in enumerate(spaced):
            raw = text.encode("utf-8", "replace")
            if all(self._faithful(side, own[n], raw) for side, own in zip((self.a, self.b), ids, strict=True)):
                kept.append(n)
        if not kept:
            return out
        each = [[own[n] for n in kept] for own in ids]
        a, b = (np.concatenate(x).astype(np.int64) for x in each)
        to_a, to_b = (np.concatenate(([0], np.cumsum([len(x) for x in own]))) for own in each)
        hits = common_ends(np.cumsum(self.a.sizes[a]), np.cumsum(self.b.sizes[b]))
        numbers = self.pairs.number(a[hits[0]], b[hits[1]]).astype("<i4")
        n_a, n_b = (np.diff(h, prepend=-1) for h in hits)
        # the text of groups: A's ids of a group come before B's, which moves each by the tokens of the other side before it
        codes = np.empty(len(a) + len(b), np.int64)
        codes[np.arange(len(a)) + np.repeat(hits[1] + 1 - n_b, n_a)] = a
        codes[np.arange(len(b)) + np.repeat(hits[0] + 1, n_b)] = b + 2 * len(self.a.bytes)
        codes[hits[0] + hits[1] + 1 - n_b] += len(self.a.bytes)
        codes[hits[0] + hits[1] + 1] += len(self.b.bytes)
        first = np.searchsorted(hits[0], to_a)
        for k, n in enumerate(kept):
            lo, hi = int(to_a[k] + to_b[k]), int(to_a[k + 1] + to_b[k + 1])
            digest = hashlib.sha256()
            for x in range(lo, hi, BLOCK):
                part = b"".join(map(self.texts.__getitem__, codes[x : min(x + BLOCK, hi)].tolist()))
                digest.update(part if x + BLOCK < hi else part[:-1])
            own = slice(int(first[k]), int(first[k + 1]))
            out[some[n]] = (len(each[0][k]), len(each[1][k]), digest.hexdigest().encode(), numbers[own], n_a[own], n_b[own])
        return out


def linked(docs: DataFrame, a: Vocabulary, b: Vocabulary, pairs: Pairs, spans: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, groups_sha256, links (pair numbers, little-endian 32-bit); with `spans` also the
    tokens of A and of B in each group, as arrays."""
    context = docs.sparkSession.sparkContext
    shared = context.broadcast((a, b, pairs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, pairs = shared.value
        work = working_set(("alignment", a.key, b.key), lambda: Aligner(a, b, pairs))
        for batch in batches:
            for begin, texts in slices(batch.column(1)):
                n_a, n_b, digest, links, in_a, in_b = zip(*work(texts), strict=True)
                columns = [batch.column(0).slice(begin, len(texts)), pa.array(n_a, pa.int64()), pa.array(n_b, pa.int64()), pa.array([len(x) for x in links], pa.int64()), pa.array([x.decode() for x in digest]), pa.array([x.tobytes() for x in links], pa.binary())]
                names = ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links"]
                if spans:
                    columns += [pa.array([x.tolist() for x in own], pa.list_(pa.int32())) for own in (in_a, in_b)]
                    names += ["group_a", "group_b"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    bound_batches(docs.sparkSession)
    kind = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_a long, n_b long, n_groups long, groups_sha256 string, links binary"
    return rows.mapInArrow(releasing(run), kind + (", group_a array<int>, group_b array<int>" if spans else ""))


def pair_counts(links: DataFrame, pairs: Pairs) -> np.ndarray:
    """How often each pair is linked in the whole table: summed in tasks, then by pair."""
    size = len(pairs.codes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int64)
        for batch in batches:
            if batch.num_rows:
                counts += np.bincount(np.concatenate([np.frombuffer(x.as_buffer(), "<i4") for x in batch.column(0)]), minlength=size)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(counts[used])], names=["pair", "n"])

    rows = links.select("links").mapInArrow(releasing(run), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()  # at most one row a pair
    counts = np.zeros(size, np.int64)
    counts[np.asarray(rows.column("pair"))] = np.asarray(rows.column("n"))
    return counts


def align(docs: DataFrame, a_path: str, b_path: str, spans: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256; with `spans` also group_a and group_b."""
    a, b = Vocabulary(a_path), Vocabulary(b_path)
    pairs = Pairs(_Plain(a).bytes, _Plain(b).bytes)
    table = materialize(linked(docs, a, b, pairs, spans), "alignment")
    counts = pair_counts(table, pairs)
    shared = docs.sparkSession.sparkContext.broadcast((counts, pairs.best(counts)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, best = shared.value
        for batch in batches:
            at = batch.schema.names.index("links")
            links = [np.frombuffer(x.as_buffer(), "<i4") for x in batch.column(at)]
            made = [[int(best[x].sum()) for x in links], [int(counts[x].sum()) for x in links]]
            rest = [k for k in range(batch.num_columns) if k != at]
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in rest] + [pa.array(x, pa.int64()) for x in made], names=[batch.schema.names[k] for k in rest] + ["n_best", "count_sum"])

    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.schema if f.name != "links") + ", n_best long, count_sum long"
    out = table.mapInArrow(releasing(run), kind)
    return out.select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256", *(["group_a", "group_b"] if spans else []))
