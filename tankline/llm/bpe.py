"""Byte-level BPE encoding and decoding (operator 10).

Tier one: a minimal perfect hash over the vocabulary (buckets with displacements)
resolves a whole pre-token that is itself a vocabulary entry.  Tier two: all other
pre-tokens start as single bytes in a doubly linked list, and a heap yields the
lowest-ranked neighbouring pair until none can be merged.  Workers remember chunks
within a bounded cache, so that both tiers see each chunk about once.

The tables are made from the vocabulary file on the driver and broadcast; their
size is that of the vocabulary (about 1 MB), whatever the data.

Defined results: null is the empty text and gives no ids; any text round-trips to
its UTF-8 bytes; repeated rows are independent; extra columns are kept, but for those with the name of a new one, which are replaced.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tankline.llm.chunks import cuttable
from tankline.llm.common import append_columns
from tankline.llm.memory import ENTRY, LONG, Remembered, working_set
from tankline.llm.words import numbered

MASK = (1 << 64) - 1
#: Bytes of remembered space-led chunks.
SPACED_BYTES = 60_000_000
#: Odd 64-bit multipliers that spread a bucket's displacement over the slots.
STEP, MIX = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9


def load_ranks(path: str) -> list[bytes]:
    """The vocabulary's entries in the order of their ranks."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


def _two_hashes(key: bytes) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(key)
    return h >> 64, h & MASK


class PerfectHash:
    """A minimal perfect hash: n keys in n slots, a displacement for each bucket of about four keys.

    A bucket with one key stores its slot itself, as -slot - 1.  `find` compares the
    key's bytes, so that strangers are told from members.
    """

    def __init__(self, keys: list[bytes]):
        self.n, self.m = len(keys), max(1, len(keys) // 4)
        self.shift = np.zeros(self.m, np.int64)
        self.slots = np.zeros(self.n, np.int64)
        hashes = np.array([_two_hashes(k) for k in keys], np.uint64).reshape(-1, 2)
        bucket = (hashes[:, 0] % np.uint64(self.m)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=self.m)
        ends = np.cumsum(sizes)
        taken = np.zeros(self.n, bool)
        free: list[int] = []
        for b in np.argsort(-sizes, kind="stable"):
            own = order[ends[b] - sizes[b] : ends[b]]
            if len(own) == 0:
                break
            if len(own) == 1:
                if not free:
                    free = np.flatnonzero(~taken).tolist()
                slot = free.pop()
                self.shift[b], self.slots[slot], taken[slot] = -slot - 1, own[0], True
                continue
            d = 0
            while True:
                x = hashes[own, 1] + np.arange(d, d + 256, dtype=np.uint64)[:, None] * np.uint64(STEP)
                x = (x ^ (x >> np.uint64(29))) * np.uint64(MIX)
                tries = ((x >> np.uint64(16)) % np.uint64(self.n)).astype(np.int64)
                fits = ~taken[tries].any(axis=1)
                for k in np.flatnonzero(fits):
                    if len(set(tries[k].tolist())) == len(own):
                        break
                else:
                    d += 256
                    continue
                self.shift[b] = d + k
                self.slots[tries[k]] = own
                taken[tries[k]] = True
                break
        self._lists()

    def _lists(self) -> None:
        self.shifts, self.ids = self.shift.tolist(), self.slots.tolist()

    def __getstate__(self):
        return {"n": self.n, "m": self.m, "shift": self.shift.astype(np.int32), "slots": self.slots.astype(np.int32)}

    def __setstate__(self, state):
        self.__dict__ |= state
        self._lists()

    def find(self, key: bytes, keys: list[bytes]) -> int:
        """The number of `key` among `keys`, or -1."""
        if not self.n:
            return -1
        h = xxhash.xxh3_128_intdigest(key)
        a, b = h >> 64, h & MASK
        d = self.shifts[a % self.m]
        if d < 0:
            slot = -d - 1
        else:
            x = (b + d * STEP) & MASK
            slot = (((x ^ (x >> 29)) * MIX & MASK) >> 16) % self.n
        found = self.ids[slot]
        return found if keys[found] == key else -1


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a pre-token: linked bytes, a heap of neighbouring pairs by (rank, place)."""
    n = len(piece)
    end = list(range(1, n + 1))  # end of the token that begins here; 0: none begins here
    before = list(range(-1, n - 1))  # where the token before this one begins
    heap = []
    for i in range(n - 1):
        r = ranks.get(piece[i : i + 2])
        if r is not None:
            heap.append((r, i, i + 2))
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i]
        if not j or j >= n or end[j] != stop:
            continue  # one of the two has been merged meanwhile
        end[i], end[j] = stop, 0
        if stop < n:
            before[stop] = i
            r = ranks.get(piece[i : end[stop]])
            if r is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        k = before[i]
        if k >= 0:
            r = ranks.get(piece[k:stop])
            if r is not None:
                heapq.heappush(heap, (r, k, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Codec:
    """Encodes and decodes with one vocabulary; `tables` is what the driver broadcasts."""

    def __init__(self, tables: tuple[list[bytes], PerfectHash, str, str]):
        self.tokens, self.hash, pattern, _ = tables
        self.ranks = {t: i for i, t in enumerate(self.tokens)}
        self.split = regex.compile(pattern).findall
        self.pieces = Remembered(self._piece, 24_000_000)
        self.spaced: dict[str, bytes] = {}
        self.held = 0

    def _piece(self, piece: str) -> bytes:
        raw = piece.encode("utf-8", "surrogatepass")
        found = self.hash.find(raw, self.tokens)
        ids = [found] if found >= 0 else merge(raw, self.ranks)
        return np.array(ids, "<u4").tobytes()

    def _chunk(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.split(text)))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; each distinct space-led chunk of the texts is looked up once."""
        out = [b""] * len(texts)
        even = [i for i, t in enumerate(texts) if cuttable(t)]
        for i in set(range(len(texts))).difference(even):
            out[i] = self._chunk(texts[i])
        distinct, numbers, offsets = numbered([texts[i] for i in even], lambda a: pc.split_pattern(a, " "))
        rest = np.ones(len(numbers), bool)
        rest[offsets[:-1]] = False  # what stands before a text's first space
        numbers, offsets = numbers[rest], offsets - np.arange(len(offsets))
        used = np.flatnonzero(np.bincount(numbers, minlength=len(distinct)))
        values = np.empty(len(distinct), object)
        values[used] = self._spaced(distinct.take(pa.array(used)).to_pylist())
        parts = values[numbers]
        for i, a, b in zip(even, offsets.tolist(), offsets[1:].tolist(), strict=False):
            out[i] = self._chunk(texts[i].partition(" ")[0]) + b"".join(parts[a:b])
        return out

    def _spaced(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks with a space before them, remembered within the bound."""
        values = list(map(self.spaced.get, chunks))
        for k, v in enumerate(values):
            if v is None:
                c = chunks[k]
                values[k] = v = self._chunk(" " + c)
                if len(c) <= LONG:
                    self.spaced[c] = v
                    self.held += len(c) + len(v) + ENTRY
        if self.held > SPACED_BYTES:
            self.spaced = {c: v for c, v in zip(chunks, values, strict=True) if len(c) <= LONG}
            self.held = sum(len(c) + len(v) + ENTRY for c, v in self.spaced.items())
        return values

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def tables(path: str, pattern: str) -> tuple[list[bytes], PerfectHash, str, str]:
    """Entries, their hash, the pattern, and a digest that tells vocabularies apart."""
    tokens = load_ranks(path)
    digest = hashlib.sha256(repr((tokens, pattern)).encode()).hexdigest()
    return tokens, PerfectHash(tokens), pattern, digest


def _codec(shared) -> Codec:
    """One codec in a worker, so that its caches outlive a task."""
    return working_set(("bpe", shared.value[3]), lambda: Codec(shared.value))


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """All columns and `ids` (binary, little-endian unsigned 32-bit) and `n_tokens`."""
    shared = docs.sparkSession.sparkContext.broadcast(tables(path, pattern))

    def kernel():
        codec = _codec(shared)

        def work(texts):
            ids = codec.encode(texts)
            return [pa.array(ids, pa.binary()), [len(x) // 4 for x in ids]]

        return work

    return append_columns(docs, kernel, [T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType())], text)


def round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """As :func:`encode`, and `decoded`: the bytes that the ids stand for."""
    shared = docs.sparkSession.sparkContext.broadcast(tables(path, pattern))

    def kernel():
        codec = _codec(shared)

        def work(texts):
            ids = codec.encode(texts)
            back = [codec.decode(x) for x in ids]
            return [pa.array(ids, pa.binary()), [len(x) // 4 for x in ids], pa.array(back, pa.binary())]

        return work

    fields = [T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType()), T.StructField("decoded", T.BinaryType())]
    return append_columns(docs, kernel, fields, text)


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of the ids and of the decoded bytes."""
    return round_trip(docs.select("doc_id", F.col("text").cast("string").alias("text")), path, pattern).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
