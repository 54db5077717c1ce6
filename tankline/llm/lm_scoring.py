"""Cross-entropy difference of matched language models (operator 6).

Two interpolated bigram models share one vocabulary: every word of the corpus.  The target model is estimated from the
rows marked as target, the background model from all rows, and each document is scored by both without its own part in them
(its counts are taken off, so no document vouches for itself).  The score is the mean over its tokens of

    -log P_target(w | h)  -  -log P_background(w | h)
    P(w | h) = WEIGHT * c(h, w) / c(h) + (1 - WEIGHT) * (c(w) + ADDED) / (tokens + ADDED * vocabulary)

so lower means closer to the target.  A history that was not seen leaves the unigram part alone; with the end of a text as one more thing
that can follow a word, the probabilities after any history sum to one.

All counts are of all words and pairs as they stand, none is capped, cut off or made unknown; words and pairs are known by
64-bit fingerprints.  Texts lie in blocks of about `BLOCK_BYTES`, and blocks ask for the counts of what they hold:

1. *Asking.*  A block sums its own words and pairs and sends each once, with its numbers, sorted and packed, to the bucket of its fingerprint.
2. *Answering.*  A bucket sums its fingerprints over all blocks and answers each block in the order in which it asked, so an answer
   needs no fingerprints.  Bucket totals (tokens, distinct words) are rows of their own.
3. *Scoring.*  A block meets its answers and scores its documents.

A fingerprint comes at most once from each block, so a frequent word is no hot key, and blocks and buckets grow in number with the corpus,
not in size.  Beyond `DIRECT` buckets a block asks *relays* instead: one for each range of fingerprints, about the square root of the
buckets in number.  A relay of as many blocks sums what they ask, asks the buckets of its range, and hands the answers on.  So
what a block sends shrinks with the square root of the corpus only, and requests are as many as blocks times that root.

Defined results: texts without words have 0 tokens and null losses; with no target rows the target model is the uniform one;
repeated rows count each time, and only one of them is taken off; they are one row with a number until they are given out; a document longer than a block is a block of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tankline.llm.common import materialize
from tankline.llm.memory import release, releasing
from tankline.llm.words import hashed

#: Text of a block; at about six bytes a word, a bucket gets some two million fingerprints for BUCKET_BYTES of text.
BLOCK_BYTES, BUCKET_BYTES = 16_000_000, 16_000_000
#: Buckets that blocks ask themselves; some 10 KB a request at that number.
DIRECT = 1024
#: Target ids are broadcast up to this many (8 bytes each), and joined by exchange beyond it.
BROADCAST_IDS = 4_000_000
#: Weight of the bigram estimate beside the unigram one, and added counts.
WEIGHT, ADDED = 0.6, 0.5
#: Odd multipliers that make fingerprints of words and pairs from hashes of words.
FIRST, SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Hash of what stands before the first word.
START = np.uint64(0x165667B19E3779F9)
ASKED = "block long, bucket long, w_size int, w_keys binary, w_n binary, w_target binary, p_size int, p_keys binary, p_n binary, p_target binary"
ANSWERED = "block long, bucket long, w_size int, w_n binary, w_target binary, p_size int, p_n binary, p_target binary, tokens long, target_tokens long, vocabulary long"
#: Tokens whose losses are worked out at once.
STEP = 1 << 18
#: Where the totals of a bucket go.
TOTALS = -1


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * SECOND
    return x ^ (x >> np.uint64(32))


def fingerprints(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a text's word hashes: those of its histories (the start, then its words), and those of its pairs."""
    before = np.concatenate((np.array([START], np.uint64), own))
    return _mixed(before * FIRST), _mixed((before[:-1] * SECOND + np.uint64(1)) ^ (own * FIRST + np.uint64(3)))


def _pack(values: np.ndarray) -> bytes:
    """Numbers as planes of their bytes, so that the high ones, mostly zero, take no room."""
    kind = np.min_scalar_type(int(values.max())) if len(values) else np.dtype(np.uint8)
    planes = np.ascontiguousarray(values.astype(kind)).view(np.uint8).reshape(len(values), kind.itemsize).T
    return bytes([kind.itemsize]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _unpack(raw: bytes, size: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[1:]), np.uint8).reshape(raw[0], size)
    return np.ascontiguousarray(planes.T).view(f"<u{raw[0]}").ravel()


def _pack_sorted(keys: np.ndarray) -> bytes:
    return _pack(np.diff(keys, prepend=np.uint64(0)))


def _unpack_sorted(raw: bytes, size: int) -> np.ndarray:
    return np.cumsum(_unpack(raw, size).astype(np.uint64), dtype=np.uint64)


class Block:
    """Fingerprints of all places of some texts: histories (one more than words for each text with any) and pairs, text by text."""

    def __init__(self, texts: list[str]):
        words, offsets = hashed(texts, xxhash.xxh3_64_intdigest, pc.utf8_lower)
        self.lengths = np.diff(offsets)
        full = np.flatnonzero(self.lengths)
        begin = offsets[full] + np.arange(len(full))  # of each text among the histories
        before = np.empty(len(words) + len(full), np.uint64)
        at = np.ones(len(before), bool)
        at[begin] = False
        before[at], before[begin] = words, START
        last = np.zeros(len(before), bool)
        last[begin + self.lengths[full]] = True
        self.history, self.pair = _mixed(before * FIRST), _mixed((before[~last] * SECOND + np.uint64(1)) ^ (words * FIRST + np.uint64(3)))
        #: The history of each pair; its word is the next one.
        self.place = np.flatnonzero(~last).astype(np.int32)
        self.doc, self.history_doc = np.repeat(np.arange(len(texts), dtype=np.int32), self.lengths), np.repeat(full.astype(np.int32), self.lengths[full] + 1)


def _sums(keys: np.ndarray, target: np.ndarray, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct fingerprints, how often each is there, and how often in target texts."""
    if (copies > 1).any():
        distinct, where = np.unique(keys, return_inverse=True)
        return distinct, *(np.bincount(where, w, len(distinct)).astype(np.int64) for w in (copies, copies * target))
    distinct, n = np.unique(keys, return_counts=True)
    some, k = np.unique(keys[target], return_counts=True)
    in_target = np.zeros(len(distinct), np.int64)
    in_target[np.searchsorted(distinct, some)] = k
    return distinct, n, in_target


def _within(keys: np.ndarray, doc: np.ndarray, texts: int) -> np.ndarray:
    """How often the text of each place has its fingerprint."""
    out, bounds = np.empty(len(keys), np.int32), np.searchsorted(doc, np.arange(texts + 1))
    for a, b in zip(bounds.tolist(), bounds[1:].tolist(), strict=False):
        if b > a:
            _, back, times = np.unique(keys[a:b], return_inverse=True, return_counts=True)
            out[a:b] = times[back]
    return out


def ask(batches: Iterator[pa.RecordBatch], ranges: int) -> Iterator[pa.RecordBatch]:
    """What each block holds, range by range, words and pairs apart; rows block, is_target, copies, text come sorted by block."""
    borders = _borders(ranges)
    for number, rows in _blocks(batches):
        texts, target, copies = _texts(rows)
        block = Block(texts)
        del texts, rows
        found = [_sums(keys, target[doc], copies[doc]) for keys, doc in ((block.history, block.history_doc), (block.pair, block.doc))]
        out = list(_requests(number, found, borders, range(ranges)))
        if out:
            yield _batch(out, ASKED)


def _requests(asker: int, found: list[tuple], borders: np.ndarray, names: Iterable[int]) -> Iterator[tuple]:
    """Rows of ASKED for the ranges in which there is anything to ask."""
    cuts = [np.searchsorted(part[0], borders).tolist() for part in found]
    for k, name in enumerate(names):
        if any(c[k + 1] > c[k] for c in cuts):
            row = [asker, name]
            for part, c in zip(found, cuts, strict=True):
                own = slice(c[k], c[k + 1])
                row += [c[k + 1] - c[k], _pack_sorted(part[0][own]), _pack(part[1][own]), _pack(part[2][own])]
            yield tuple(row)


def _borders(ranges: int, of: int = 1, at: int = 0) -> np.ndarray:
    """Where the fingerprints of each range begin, and the end of the last; of the range `at` of `of` equal ones."""
    last = (1 << 64) - 1
    wide = (1 << 64) // of + 1
    step = wide // ranges + 1
    return np.array([min(at * wide + min(k * step, wide), last) for k in range(ranges + 1)], np.uint64)


def _texts(rows: pa.Table) -> tuple[list[str], np.ndarray, np.ndarray]:
    return [t or "" for t in rows.column("text").to_pylist()], np.array(rows.column("is_target").to_pylist(), bool), rows.column("copies").to_numpy()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    number, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        own = np.asarray(batch.column(0))
        cuts = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), batch.num_rows]
        for s, e in zip(cuts, cuts[1:], strict=False):
            if held and own[s] != number:
                yield number, pa.Table.from_batches(held)
                held = []
            number = int(own[s])
            held.append(batch.slice(s, e - s))
    if held:
        yield number, pa.Table.from_batches(held)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields, strict=True)], names=[name for name, _ in fields])


def _summed(asked: list[dict], kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct fingerprints of all requests, their counts, and where those of each request are."""
    sizes = [r[f"{kind}_size"] for r in asked]
    keys, where = np.unique(np.concatenate([_unpack_sorted(r[f"{kind}_keys"], r[f"{kind}_size"]) for r in asked]), return_inverse=True)
    n, in_target = (np.bincount(where, np.concatenate([_unpack(r[f"{kind}_{c}"], r[f"{kind}_size"]) for r in asked]), len(keys)).astype(np.int64) for c in ("n", "target"))
    return keys, n, in_target, np.split(where, np.cumsum(sizes)[:-1])


def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts over all askers for what each asked, and the totals of the bucket; rows come sorted by bucket."""
    start = _mixed(np.array([START], np.uint64) * FIRST)[0]
    for bucket, rows in _blocks(b.select(["bucket", *[c for c in b.schema.names if c != "bucket"]]) for b in batches):
        asked = rows.to_pylist()
        found = [_summed(asked, kind) for kind in ("w", "p")]
        keys, n, in_target, _ = found[0]
        word = keys != start
        yield _batch([(TOTALS, bucket, 0, b"", b"", 0, b"", b"", int(n[word].sum()), int(in_target[word].sum()), int(word.sum()))], ANSWERED)
        for i, r in enumerate(asked):
            yield _batch([_answered(r["block"], bucket, [(n[where[i]], k[where[i]]) for _, n, k, where in found])], ANSWERED)


def _answered(asker: int, bucket: int, counts: list[tuple]) -> tuple:
    row = [asker, bucket]
    for n, in_target in counts:
        row += [len(n), _pack(n), _pack(in_target)]
    return *row, 0, 0, 0


def relay_ask(batches: Iterator[pa.RecordBatch], ranges: int, groups: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """The sums of a relay's blocks for the buckets of its range; rows of ASKED with the relay's number before them come sorted by that."""
    for relay, rows in _blocks(batches):
        at = relay // groups
        found = [_summed(rows.to_pylist(), kind)[:3] for kind in ("w", "p")]
        out = list(_requests(relay, found, _borders(buckets, ranges, at), range(at * buckets, (at + 1) * buckets)))
        yield _batch(out, ASKED)


def relay_answer(asked: pa.Table, answers: pa.Table) -> pa.Table:
    """Answers of a relay's buckets for each of its blocks."""
    got, blocks = sorted(answers.to_pylist(), key=lambda r: r["bucket"]), asked.to_pylist()
    counts = []
    for kind in ("w", "p"):
        keys = [_unpack_sorted(r[f"{kind}_keys"], r[f"{kind}_size"]) for r in blocks]
        distinct = np.unique(np.concatenate(keys))
        counts.append((distinct, keys, *(_whole(got, f"{kind}_{c}", f"{kind}_size") for c in ("n", "target"))))
    out = []
    for i, r in enumerate(blocks):
        own = [(np.searchsorted(distinct, keys[i]), n, k) for distinct, keys, n, k in counts]
        out.append(_answered(r["block"], r["bucket"], [(n[where], k[where]) for where, n, k in own]))
    return pa.Table.from_batches([_batch(out, ANSWERED)])


def _whole(got: list[dict], column: str, size: str) -> np.ndarray:
    """A column of all answers together, which come sorted by bucket, in numbers no wider than they need."""
    return np.concatenate([np.zeros(0, np.uint8), *(_unpack(r[column], r[size]) for r in got)])


def _losses(pair: np.ndarray, history: np.ndarray, word: np.ndarray, tokens: np.ndarray, vocabulary: int) -> np.ndarray:
    """-log P of each token from the counts of its pair, history and word and of all tokens."""
    unigram = (word + ADDED) / (tokens + ADDED * vocabulary)
    seen = history > 0
    return -np.log(np.where(seen, WEIGHT * pair / np.maximum(history, 1), 0) + np.where(seen, 1 - WEIGHT, 1) * unigram)


def score(rows: pa.Table, answers: pa.Table, total: int, in_target: int, vocabulary: int) -> pa.Table:
    """doc_id, n_tokens and mean losses of a block's documents, and how many copies there are."""
    texts, target, copies = _texts(rows)
    block = Block(texts)
    del texts
    got = sorted(answers.to_pylist(), key=lambda r: r["bucket"])
    found = {}
    for kind, keys, doc in (("w", block.history, block.history_doc), ("p", block.pair, block.doc)):
        where = np.searchsorted(np.unique(keys), keys).astype(np.int32)
        found[kind] = *(_whole(got, f"{kind}_{c}", f"{kind}_size")[where] for c in ("n", "target")), _within(keys, doc, len(copies))
    del got, where, keys, doc, block.history, block.pair
    sums = []
    for k, tokens, off in ((1, in_target, target.astype(np.int64)), (0, total, np.ones(len(copies), np.int64))):
        losses = np.empty(len(block.doc))
        for s in range(0, len(losses), STEP):
            own = slice(s, s + STEP)
            doc, at = block.doc[own], block.place[own]
            pair, history, word = found["p"][k][own] - found["p"][2][own] * off[doc], *(found["w"][k][i] - found["w"][2][i] * off[doc] for i in (at, at + 1))
            losses[own] = _losses(pair, history, word, (tokens - block.lengths * off)[doc], vocabulary)
        sums.append(np.bincount(block.doc, losses, len(copies)))
    some = block.lengths > 0
    means = [pa.array(s / np.maximum(block.lengths, 1), mask=~some) for s in (*sums, sums[0] - sums[1])]
    del losses, found, block.doc, block.history_doc, block.place
    release()
    return pa.table([rows.column("doc_id"), pa.array(block.lengths), *means, pa.array(copies)], names=["doc_id", "n_tokens", "target_loss", "background_loss", "difference", "copies"])


def _marked(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """doc_id, text, is_target."""
    marks = targets.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct().withColumn("is_target", F.lit(True))
    few = marks.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.join(F.broadcast(marks) if few else marks, "doc_id", "left").withColumn("is_target", F.coalesce("is_target", F.lit(False)))


def _answers(asked: DataFrame, ranges: int, buckets: int) -> tuple[DataFrame, DataFrame]:
    """Counts for what blocks asked of ranges, beyond `DIRECT` buckets through relays; and the totals of all buckets."""
    if ranges == buckets:
        got = materialize(asked.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(releasing(answer), ANSWERED), "answers")
        return got.where(F.col("block") != TOTALS), got.where(F.col("block") == TOTALS)
    each = -(-buckets // ranges)
    relayed = asked.withColumn("relay", F.col("bucket") * ranges + F.pmod(F.xxhash64("block"), F.lit(ranges)))
    relayed = materialize(relayed.select("relay", *asked.columns), "relayed")
    relays = relayed.repartition(ranges * ranges, "relay").sortWithinPartitions("relay").mapInArrow(releasing(lambda batches: relay_ask(batches, ranges, ranges, each)), ASKED)
    got = materialize(relays.repartition(ranges * each, "bucket").sortWithinPartitions("bucket").mapInArrow(releasing(answer), ANSWERED), "answers")
    back = relayed.groupBy("relay").cogroup(got.where(F.col("block") != TOTALS).withColumn("relay", F.col("block")).groupBy("relay")).applyInArrow(relay_answer, ANSWERED)
    return back, got.where(F.col("block") == TOTALS)


def cross_entropy_difference(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """doc_id and losses of every document; `targets` lists the doc_ids of the target corpus."""
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    blocks, buckets = int(size // BLOCK_BYTES) + 1, int(size // BUCKET_BYTES) + 1
    ranges = buckets if buckets <= DIRECT else math.isqrt(buckets - 1) + 1
    rows = _marked(docs, targets)
    repeated = not rows.groupBy(F.xxhash64("doc_id", "text")).count().where("count > 1").isEmpty()
    rows = rows.groupBy("doc_id", "text", "is_target").agg(F.count("*").alias("copies")) if repeated else rows.withColumn("copies", F.lit(1).cast("long"))
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).alias("block")
    rows = rows.select(block, "doc_id", "text", "is_target", "copies").repartition(blocks, "block")
    asked = rows.sortWithinPartitions("block").mapInArrow(releasing(lambda batches: ask(batches, ranges)), ASKED)
    given, totals = _answers(asked, ranges, buckets)
    totals = totals.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "target_tokens", "vocabulary")]).first()
    kind = "doc_id long, n_tokens long, target_loss double, background_loss double, difference double, copies long"
    scored = rows.groupBy("block").cogroup(given.groupBy("block")).applyInArrow(lambda own, answers: score(own, answers, *totals), kind)
    if repeated:
        scored = scored.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return scored.select("doc_id", "n_tokens", "target_loss", "background_loss", "difference")
