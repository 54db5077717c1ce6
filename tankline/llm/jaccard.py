"""N-gram Jaccard join: exact components of documents whose five-word shingle sets are alike (operator 3).

Two documents link when 100 * |A and B| >= 80 * |A or B|.  The work is done by *tiles*: groups of documents that share a
shingle or a component and lie in one band of sizes.  All pairs of a tile meet in numpy blocks:

* hashed bitmap signatures first: |A xor B| of the bit counts (folded to the narrower of the two) bounds the overlap from above;
* documents of pairs that pass bring their sorted arrays of 64-bit shingles, whose exact intersection decides.

A tile gives out only which of its components links have joined, so what leaves it is linear in its documents, and pairs that
are in one component already are not looked at.  No link between components is lost:

1. *Classes.*  Documents with the same set (128-bit digest) become one class, which its smallest doc_id stands for from here on,
   so r copies of a text cost r rows and no pair.
2. *Postings.*  Under any one order of all shingles, two linked sets share one of the first n - ceil(0.8 n) + 1 of each.  The
   order puts shingles that are frequent in the corpus last (`frequent_shingles`, a bounded summary), so that shared passages make no
   postings except for documents that consist of them.  Only postings go on whose class another one of the shingle can still link with,
   judged by both sizes and places in the order; so pages that share most of their words, but not enough to link, make none.
   Shingles that more than `TILE` documents hold skip the exchange by shingle: their reaches are folded by bins of sizes instead.
3. *Anchor tiles.*  Each class goes to the tile of one of its shared shingles, the one with the smallest hash, and its band; a tile with too
   many documents is cut at random.  Two alike sets mostly choose alike, and random cuts of a large group join within.  Each
   class is in one tile, so the components of tiles are those of all links so far.
4. *Hub tiles.*  Under each shingle whose classes lie in different components, the classes outside the one with most of them
   meet `HUBS` members of that one.  Both steps are linear and join nearly all of a large group.
5. *Full tiles.*  What is left is done exactly.  Under each such shingle let M be the component with most of its classes.  Classes
   outside M meet each other in tiles of the shingle and band (cut into a grid of blocks if large), and they meet all of M in tiles of M, to which M's
   classes come once however many shingles they share.

Defined results: texts without words (null, empty, blank) have no shingles and link with nothing; texts with fewer than five
words have one shingle, the whole sequence; repeated rows each give a row, and rows with one doc_id count as one document that
has the links of all of them; a null doc_id takes part with its text, and its component_id is null only if no linked row has an id;
long texts are taken whole; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tankline.llm.common import materialize, slices
from tankline.llm.components import components
from tankline.llm.memory import releasing
from tankline.llm.words import hashed

WIDTH = 5
#: Percent of the union that must be shared.
PERCENT = 80
FREQUENT, SUMMARY, LEAST = 65_536, 65_536, 8
#: Documents and shingles of a tile before it is cut; members of a component that strays meet first.
TILE, TILE_SHINGLES, HUBS = 1024, 1 << 20, 4
#: A band of sizes is this wide; documents near its upper end are also in the next one.
BAND = 1.25**4
#: Bins of sizes within which reaches of frequent shingles are folded; rows of another shingle that are held at once.
BIN, RUN = 1.05, 1 << 22
#: Bits of a signature for each shingle: the one that moves, and the one that is made from arrays.
THIN, WIDE = 2, 8
#: Bits of the filter before joins.
FILTER_BITS = 23
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Rows without doc_id are known by their text, above all ids.
NAMELESS = 1 << 62
TILE_ROWS = "key long, side int, node long, n int, comp long"


def shingles(texts: list[str]) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the shingles of each text."""
    words, offsets = hashed(texts, xxhash.xxh3_64_intdigest, pc.ascii_lower)
    return [_shingles(words[a:b]) for a, b in zip(offsets, offsets[1:], strict=False)]


def _shingles(h: np.ndarray) -> np.ndarray:
    if not len(h):
        return h
    if len(h) < WIDTH:
        return np.array([xxhash.xxh3_64_intdigest(h.tobytes(), seed=len(h))], np.uint64)
    out = h[: len(h) - WIDTH + 1].copy()
    for k in range(1, WIDTH):
        out *= MULTIPLIER
        out += h[k : len(h) - WIDTH + 1 + k]
    out ^= out >> np.uint64(31)
    out *= MULTIPLIER
    out.sort()
    return out[np.concatenate(([True], out[1:] != out[:-1]))]


def bitmap(hashes: np.ndarray, density: int) -> np.ndarray:
    """A hashed bitmap of at least `density` bits a shingle: 2^k bits, k from 6 to 17."""
    width = 1 << min(17, max(6, int(density * len(hashes) - 1).bit_length()))
    bits = np.zeros(width, np.uint8)
    bits[((hashes >> np.uint64(7)) & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view(np.uint64)


def fold(rows: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps of a wider signature at the width of a narrower one."""
    while rows.shape[1] > words:
        half = rows.shape[1] // 2
        rows = rows[:, :half] | rows[:, half:]
    return rows


def needed(n: int) -> int:
    """Fewest shingles that a set of n shares with any set it links with."""
    return -(-PERCENT * n // 100)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets link."""
    if len(a) > len(b):
        a, b = b, a
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum()) if len(a) else 0
    return both > 0 and 100 * both >= PERCENT * (len(a) + len(b) - both)


def _alike(a, b):
    """Sizes that can link; of numbers, arrays or columns."""
    return (100 * a >= PERCENT * b) & (100 * b >= PERCENT * a)


def frequent_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles, rarest first, and the least number of documents of each; every task sums its own in a bounded summary."""

    def summarize(batches):
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            for _, texts in slices(batch.column(0)):
                own = np.concatenate(shingles(texts))
                own.sort()
                at = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))) if len(own) else np.zeros(0, np.int64)
                n = np.diff(np.append(at, len(own)))
                own = own[at]
                keep = (n > 1) | np.isin(own, keys)
                both, sums = np.concatenate((keys, own[keep])), np.concatenate((counts, n[keep]))
                keys, where = np.unique(both, return_inverse=True)
                counts = np.bincount(where, sums, len(keys)).astype(np.int64)
                if len(keys) > SUMMARY:
                    top = np.sort(np.argpartition(-counts, SUMMARY)[:SUMMARY])
                    keys, counts = keys[top], counts[top]
        some = counts >= LEAST
        yield pa.RecordBatch.from_arrays([pa.array(keys[some]).view(pa.int64()), pa.array(counts[some])], names=["h", "n"])

    sums = docs.select("text").mapInArrow(releasing(summarize), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    top = sums.orderBy(F.desc("n"), "h").limit(FREQUENT).toArrow()
    return top.column("h").to_numpy()[::-1].view(np.uint64), top.column("n").to_numpy()[::-1]


def sets(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """node, doc_id, set size, digest, signature and prefix of every row; shingles of the prefix that many documents hold apart from the others."""
    keys, counts = frequent
    order = np.argsort(keys)
    shared = docs.sparkSession.sparkContext.broadcast((keys[order], order, counts[order] > TILE))

    def run(batches):
        known, ranks, many = shared.value
        for batch in batches:
            for begin, texts in slices(batch.column(1)):
                n, h1, h2, rare, hot, bits = [], [], [], [], [], []
                for s in shingles(texts):
                    digest = xxhash.xxh3_128_intdigest(s.tobytes())
                    n.append(len(s))
                    h1.append((digest >> 64) - (1 << 63))
                    h2.append((digest & ((1 << 64) - 1)) - (1 << 63))
                    size = len(s) - needed(len(s)) + 1 if len(s) else 0
                    first, late = s, s[:0]
                    if len(known) and len(s):
                        at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                        common = known[at] == s
                        first, at = s[~common], np.sort(ranks[at[common]])
                        late = keys[at[: max(0, size - len(first))]]
                    big = many[np.searchsorted(known, late)] if len(late) else np.zeros(0, bool)
                    rare.append(np.concatenate((first[:size], late[~big])).view(np.int64))
                    hot.append(late[big].view(np.int64))
                    bits.append(bitmap(s, THIN).tobytes() if len(s) else b"")
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(begin, len(texts)), pa.array(n, pa.int32()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), _lists(rare), _lists(hot), pa.array(bits, pa.binary())],
                    names=["doc_id", "n", "h1", "h2", "rare", "hot", "bits"],
                )

    found = docs.mapInArrow(releasing(run), "doc_id long, n int, h1 long, h2 long, rare array<long>, hot array<long>, bits binary")
    return found.withColumn("node", node("h1"))


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(p) for p in parts]).astype(np.int32)), pa.array(np.concatenate(parts)))


def node(digest: str) -> Column:
    """What a row is known by: its doc_id, or its text."""
    return F.coalesce("doc_id", F.lit(NAMELESS) + F.shiftrightunsigned(digest, 2))


def classes_of(found: DataFrame) -> DataFrame:
    """node (the smallest), n, digest, signature and prefix of each distinct set; copies meet within tasks before the exchange."""
    best = F.min_by(F.struct("rare", "hot", "bits"), "node")
    return found.where("n > 0").groupBy("n", "h1", "h2").agg(F.min("node").alias("node"), best.alias("_s")).select("node", "n", "h1", "h2", "_s.*")


def reach(place: Column) -> Column:
    """Largest set that a set of n shares enough with if what they share begins at this place of its order."""
    return (F.floor((100 + PERCENT) * (F.col("n") - place) / PERCENT) - F.col("n")).cast("int")


def shared_postings(reps: DataFrame) -> DataFrame:
    """token, node, n of shingles that two classes or more hold at places from which they can still link.

    If two linked sets share a token first in the order of all, what they share lies from there on in both, so the size of each is within the `reach` of the other."""
    rows = reps.select(F.posexplode("rare").alias("place", "token"), "node", "n")
    rows = rows.select("token", (F.shiftleft(F.col("n").cast("long"), 32) + reach(F.col("place"))).alias("size"), "node")
    runs = rows.repartition("token").sortWithinPartitions("token", "size").mapInArrow(releasing(_runs), "token long, node long, n int")
    return runs.unionByName(reached(reps.select(F.posexplode("hot").alias("place", "token"), F.size("rare").alias("before"), "node", "n")))


def reached(hot: DataFrame) -> DataFrame:
    """Postings of tokens that are known to be shared by many, without those that no other class reaches.

    Of two classes that reach each other the smaller reaches its own size too.  Such postings stay, and their largest reach by token
    and bin of sizes tells which others do; these bins are few whatever the number of documents."""
    rows = hot.withColumn("reach", reach(F.col("before") + F.col("place")))
    place = lambda c: F.floor(F.log(F.col(c).cast("double")) / F.log(F.lit(BIN))).cast("int")
    strong = rows.where("reach >= n")
    tops = strong.groupBy("token", place("n").alias("least")).agg(F.max("reach").alias("top"))
    tops = tops.select("token", "top", F.explode(F.sequence("least", place("top"))).alias("bin")).groupBy("token", "bin").agg(F.max("top").alias("top"))
    weak = rows.where("reach < n and reach > 0").withColumn("bin", place("reach")).join(tops, ["token", "bin"]).where("top >= n")
    return strong.select("token", "node", "n").unionByName(weak.select("token", "node", "n"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by token and size (n and reach) those that another row of their token reaches and is reached by.

    A batch is in memory, and the rows of one token that have a neighbour of like size; beyond `RUN` of these they go on as they are."""
    token = np.zeros((3, 0), np.int64)
    for rows in _neighbours(batches):
        rows = np.concatenate((token, rows), axis=1)
        cut = int(np.searchsorted(rows[0], rows[0, -1])) if rows.shape[1] else 0
        done, token = rows[:, :cut], rows[:, cut:]
        if done.shape[1]:
            yield _posting_batch(done[:, met(*_sizes(done))])
        if token.shape[1] > RUN:
            yield _posting_batch(token)
            token = token[:, :0]
    if token.shape[1]:
        yield _posting_batch(token[:, met(*_sizes(token))])


def _sizes(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return rows[0], rows[1] >> 32, rows[1] & 0xFFFFFFFF


def met(token: np.ndarray, n: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """Whether another row of the token has a size within the reach of each, and reaches its size; rows come sorted by token and n."""
    base = np.cumsum(np.concatenate(([0], token[1:] != token[:-1]))) << 32
    far = base + reach
    most = np.maximum.accumulate(far)
    before = np.where(np.concatenate(([True], token[1:] != token[:-1])), base, np.concatenate(([0], most[:-1])))
    second = np.maximum.accumulate(np.minimum(before, far))
    last = np.searchsorted(base + n, far, "right") - 1
    return (last >= 0) & (np.where(n <= reach, second[last], most[last]) >= base + n)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Of rows sorted by token and size those with a neighbour of the same token and like size."""
    held = np.zeros((3, 0), np.int64)
    near = np.zeros(0, bool)  # whether a held row has such a neighbour before it
    for batch in batches:
        rows = np.stack([np.asarray(c) for c in batch.columns])
        rows, before = np.concatenate((held, rows), axis=1), np.concatenate((near, np.zeros(rows.shape[1], bool)))
        if not rows.shape[1]:
            continue
        n = rows[1] >> 32
        pair = (rows[0, 1:] == rows[0, :-1]) & _alike(n[1:], n[:-1])
        before[1:] |= pair
        keep = before[:-1] | pair
        held, near = rows[:, -1:], before[-1:]
        yield rows[:, :-1][:, keep]
    yield held[:, near]


def _posting_batch(rows: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows[0]), pa.array(rows[2]), pa.array((rows[1] >> 32).astype(np.int32))], names=["token", "node", "n"])


# Tiles


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The tiles of rows sorted by key, one at a time."""
    key, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.asarray(batch.column(0))
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), batch.num_rows]
        for s, e in zip(cuts, cuts[1:], strict=False):
            if held and keys[s] != key:
                yield pa.Table.from_batches(held)
                held = []
            key = keys[s]
            held.append(batch.slice(s, e - s))
    if held:
        yield pa.Table.from_batches(held)


def near_pairs(n: np.ndarray, side: np.ndarray, label: np.ndarray, bits: list[np.ndarray]):
    """Blocks (i, j, bits that differ) of pairs of a tile that lie in one size band, on different sides and under different labels,
    and whose bit counts allow a link.  Documents come sorted by size; `label` may change between blocks."""
    widths = np.array([len(b) for b in bits])
    for width in np.unique(widths):
        for wide in (width, 2 * width):
            left, right = np.flatnonzero(widths == width), np.flatnonzero(widths == wide)
            if not len(left) or not len(right):
                continue
            x = np.stack([bits[i] for i in left])
            y = fold(np.stack([bits[i] for i in right]), int(width))
            first, last = np.searchsorted(n[right], -(-PERCENT * n[left] // 100), "left"), np.searchsorted(n[right], 100 * n[left] // PERCENT, "right")
            step = max(1, 1_000_000 // max(1, 256 * int(width)))
            for s in range(0, len(left), step):
                part = slice(s, min(len(left), s + step))
                for t in range(int(first[part].min()), int(last[part].max()), 256):
                    there = slice(t, t + 256)
                    i, j = left[part][:, None], right[there][None, :]
                    ok = (label[i] != label[j]) & ((side[i] < 0) | (side[i] != side[j])) & _alike(n[i], n[j])
                    if width == wide:
                        ok &= i < j
                    if not ok.any():
                        continue
                    away = np.bitwise_count(x[part, None, :] ^ y[None, there, :]).sum(axis=2, dtype=np.int64)
                    p, q = np.nonzero(ok & (n[i] + n[j] >= 9 * away))
                    if len(p):
                        yield left[part][p], right[there][q], away[p, q]


def _columns(tile: pa.Table) -> tuple[np.ndarray, ...]:
    return tuple(tile.column(c).to_numpy().astype(np.int64) for c in ("n", "side", "comp", "node"))


def _flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of each tile that have a partner by their signatures."""
    for tile in _grouped(batches):
        n, side, comp, _ = _columns(tile)
        some = np.zeros(len(n), bool)
        if (comp != comp[0]).any():
            bits = [np.frombuffer(b.as_buffer(), np.uint64) for b in tile.column("bits").combine_chunks()]
            for i, j, _ in near_pairs(n, side, comp, bits):
                some[i] = some[j] = True
        if some.any():
            yield from tile.filter(pa.array(some)).drop_columns(["bits"]).combine_chunks().to_batches()


def tile_labels(n: np.ndarray, side: np.ndarray, comp: np.ndarray, arrays: list[np.ndarray]) -> np.ndarray:
    """Components of a tile's documents, where links have joined those that came in; the smallest of them stands for all."""
    label = comp.copy()
    for i, j, away in near_pairs(n, side, label, [bitmap(a, WIDE) for a in arrays]):
        order = np.argsort(away, kind="stable")
        i, j = i[order], j[order]
        at = 0
        while at < len(i):
            p, q = int(i[at]), int(j[at])
            at += 1
            if label[p] == label[q] or not linked(arrays[p], arrays[q]):
                continue
            least, most = sorted((label[p], label[q]))
            label[label == most] = least
            live = label[i[at:]] != label[j[at:]]
            i, j, at = i[at:][live], j[at:][live], 0
    return label


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, b: components that links of a tile join, and the one that they become."""
    for tile in _grouped(batches):
        n, side, comp, _ = _columns(tile)
        label = tile_labels(n, side, comp, [np.frombuffer(b.as_buffer(), np.uint64) for b in tile.column("s").combine_chunks()])
        a, first = np.unique(comp[label != comp], return_index=True)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(label[label != comp][first])], names=["a", "b"])


def _in_tiles(rows: DataFrame, work: Callable, schema: str) -> DataFrame:
    return rows.repartition("key").sortWithinPartitions("key", "n", "node").mapInArrow(releasing(work), schema)


def arrays_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, s (sorted shingles) of the rows that `wanted` may name, once for each task.

    A bitmap of fixed size holds the hashed nodes of `wanted`.  It only spares work before the join: a full one filters nothing."""
    place = F.pmod(F.xxhash64("node"), F.lit(1 << FILTER_BITS))
    marks = wanted.select((place + 1).alias("p")).groupBy(F.bitmap_bucket_number("p").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("b"))
    packed = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    for k, part in marks.collect():  # 4096 bytes a row, 2^FILTER_BITS bits in all
        packed[(k - 1) * 4096 : k * 4096] = np.frombuffer(part, np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(packed)

    def run(batches):
        marks, seen = shared.value, set()
        for batch in batches:
            place = np.asarray(batch.column(2))
            kept = batch.filter(pa.array(((marks[place >> 3] >> (place & 7)) & 1).astype(bool)))
            for begin, texts in slices(kept.column(1)):
                nodes, out = kept.column(0).slice(begin, len(texts)).to_pylist(), []
                for k, s in zip(nodes, map(np.ndarray.tobytes, shingles(texts)), strict=True):
                    mark = (k, xxhash.xxh3_64_intdigest(s))
                    if mark not in seen:
                        seen.add(mark)
                        out.append((k, s))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int64()), pa.array([s for _, s in out], pa.binary())], names=["node", "s"])

    return docs.withColumn("place", place).select("node", "text", "place").mapInArrow(releasing(run), "node long, s binary")


class Tiles:
    """Tiles over one corpus: nodes with their signatures, and texts for the arrays."""

    def __init__(self, texts: DataFrame, bits: DataFrame):
        self.texts, self.bits = texts, bits

    def joined(self, members: DataFrame, label: str) -> DataFrame:
        """a, b: components that links join, of members key, side, node, n, comp."""
        rows = members.join(self.bits.hint("merge"), "node").select(*[c.split()[0] for c in TILE_ROWS.split(", ")], "bits")
        passed = materialize(_in_tiles(rows, _flag, TILE_ROWS), f"{label}-flagged")
        arrays = arrays_of(self.texts, passed.select("node").distinct())
        both = passed.join(arrays.hint("merge"), "node").select("key", "side", "node", "n", "comp", "s")
        return materialize(_in_tiles(both, _join, "a long, b long"), f"{label}-links")


def band() -> Column:
    return F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(BAND))).cast("int")


def _pieces(count: str = "m", size: str = "w") -> Column:
    """Into how many a tile is cut, by its documents and their shingles."""
    return F.greatest(F.ceil(F.col(count) / TILE), F.ceil(F.col(size) / TILE_SHINGLES)).cast("int")


def _part(column: str, pieces: str, salt: int) -> Column:
    return F.pmod(F.xxhash64(column, F.lit(salt)), F.col(pieces).cast("long")).cast("int")


def anchor_tiles(anchors: DataFrame) -> DataFrame:
    """Each class of rows node, n, token under its token."""
    picked = anchors.withColumn("band", band())
    sums = picked.groupBy("token", "band").agg(F.count("*").alias("m"), F.sum("n").alias("w")).where("m > 1").withColumn("pieces", _pieces())
    rows = picked.join(sums.hint("merge"), ["token", "band"])
    return rows.select(F.xxhash64("token", "band", _part("node", "pieces", 1)).alias("key"), F.lit(-1).alias("side"), "node", "n", F.col("node").alias("comp"))


def _labelled(rows: DataFrame, joined: DataFrame, of: str) -> DataFrame:
    """Rows with the component of what is in the column `of`, that itself if it has joined none; from joined node, component."""
    found = rows.join(joined.withColumnsRenamed({"node": "_of", "component": "_c"}).hint("merge"), F.col(of) == F.col("_of"), "left")
    return found.withColumn("comp", F.coalesce("_c", of)).drop("_of", "_c")


def split_tokens(rows: DataFrame) -> DataFrame:
    """token, node, n, comp of tokens that lie in two components or more, with how many, and the one with most of their classes."""
    most = rows.groupBy("token", "comp").agg(F.count("*").alias("m")).groupBy("token").agg(F.max_by("comp", F.struct("m", -F.col("comp"))).alias("major"), F.count("*").alias("kinds"))
    return rows.join(most.where("kinds > 1").hint("merge"), "token")


def hub_tiles(strays: DataFrame, nodes: DataFrame) -> DataFrame:
    """Classes outside the major component of a token together with a few of its members."""
    outside = strays.select("node", "n", "comp", "major").distinct()
    sums = outside.groupBy("major").agg(F.count("*").alias("m"), F.sum("n").alias("w")).withColumn("pieces", _pieces())
    picks = nodes.groupBy("comp").agg(*[F.min_by(F.struct("node", "n"), F.xxhash64("node", F.lit(k))).alias(f"_{k}") for k in range(HUBS)])
    hubs = picks.select(F.col("comp").alias("major"), F.explode(F.array_distinct(F.array(*[f"_{k}" for k in range(HUBS)]))).alias("_h"))
    hubs = hubs.join(sums.hint("merge"), "major").select("_h.*", F.col("major").alias("comp"), "major", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("part"))
    rows = outside.join(sums.hint("merge"), "major").withColumn("part", _part("node", "pieces", 2)).select("node", "n", "comp", "major", "part")
    return rows.unionByName(hubs).select(F.xxhash64(F.lit(2), "major", "part").alias("key"), F.lit(-1).alias("side"), "node", "n", "comp")


def shingle_tiles(strays: DataFrame) -> DataFrame:
    """Classes outside the major component of their token by token and band, in a grid of blocks if they are many."""
    rows = strays.where("kinds > 2").withColumn("_own", band())
    up = F.floor(F.log(F.col("n") * (100 / PERCENT) + 1) / F.log(F.lit(BAND))).cast("int")
    rows = rows.withColumn("band", F.explode(F.array_distinct(F.array("_own", up))))
    sums = rows.groupBy("token", "band").agg(F.count("*").alias("m"), F.sum("n").alias("w"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    rows = rows.join(sums.where("lo < hi").withColumn("pieces", _pieces()).hint("merge"), ["token", "band"])
    rows = rows.withColumn("block", _part("node", "pieces", 3)).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    side = F.when(F.col("pieces") == 1, -1).when(F.col("block") == F.col("other"), -1).when(F.col("block") < F.col("other"), 0).otherwise(1)
    return rows.select(F.xxhash64("token", "band", F.least("block", "other"), F.greatest("block", "other")).alias("key"), side.cast("int").alias("side"), "node", "n", "comp")


def component_tiles(strays: DataFrame, nodes: DataFrame) -> DataFrame:
    """All classes of a component with the classes that share a shingle with it: blocks of the one by blocks of the others."""
    inside = nodes.groupBy("comp").agg(F.count("*").alias("m"), F.sum("n").alias("w"), F.min("n").alias("lo"), F.max("n").alias("hi")).withColumn("pieces", _pieces()).withColumnRenamed("comp", "major")
    outside = strays.select("node", "n", "comp", "major").distinct().join(inside.hint("merge"), "major").where((100 * F.col("n") >= PERCENT * F.col("lo")) & (PERCENT * F.col("n") <= 100 * F.col("hi")))
    sums = outside.groupBy("major").agg(F.count("*").alias("sm"), F.sum("n").alias("sw")).withColumn("cuts", _pieces("sm", "sw"))
    members = nodes.withColumn("major", F.col("comp")).join(sums.hint("merge"), "major").join(inside.select("major", "pieces").hint("merge"), "major")
    members = members.select("major", _part("node", "pieces", 4).alias("block"), F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("cut"), F.lit(0).alias("side"), "node", "n", "comp")
    others = outside.join(sums.hint("merge"), "major").select("major", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("block"), _part("node", "cuts", 5).alias("cut"), F.lit(1).alias("side"), "node", "n", "comp")
    return members.unionByName(others).select(F.xxhash64(F.lit(6), "major", "block", "cut").alias("key"), "side", "node", "n", "comp")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = materialize(sets(docs, frequent_shingles(docs)), "sets")
    reps = materialize(classes_of(found), "classes")
    postings = materialize(shared_postings(reps), "postings")
    nameless = reps.agg(F.max("node")).first()[0]
    texts = docs.where("doc_id is not null").withColumnRenamed("doc_id", "node")
    if nameless is not None and nameless >= NAMELESS:
        texts = texts.unionByName(_nameless(docs))
    tiles = Tiles(texts, reps.select("node", "bits"))
    anchors = materialize(postings.groupBy("node", "n").agg(F.min_by("token", F.xxhash64("token")).alias("token")), "anchors")
    joined = tiles.joined(anchor_tiles(anchors), "anchor")
    if reps.groupBy("node").count().where("count > 1").isEmpty():
        joined = joined.withColumnsRenamed({"a": "node", "b": "component"})
    else:  # ids with two texts can be in two tiles
        joined = components(joined)
    nodes = materialize(_labelled(anchors.select("node", "n"), joined, "node"), "nodes")
    rows = materialize(split_tokens(_labelled(postings, joined, "node")), "hub-rows")
    joined = components(tiles.joined(hub_tiles(rows.where("comp <> major"), nodes), "hub"))
    nodes = materialize(_labelled(nodes, joined, "comp"), "nodes")
    rows = materialize(split_tokens(_labelled(rows.select("token", "node", "n", "comp"), joined, "comp")), "full-rows")
    strays = rows.where("comp <> major")
    joined = components(tiles.joined(shingle_tiles(strays).unionByName(component_tiles(strays, nodes)), "full"))
    final = _labelled(nodes, joined, "comp").select("node", "comp").distinct()
    whole = found.select("doc_id", "n", "h1", "h2", F.col("node").alias("own")).join(reps.select("n", "h1", "h2", "node").hint("merge"), ["n", "h1", "h2"], "left").join(final.hint("merge"), "node", "left")
    least = F.coalesce("comp", "node", "own")
    return whole.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(least < NAMELESS, least).alias("component_id"))


def _nameless(docs: DataFrame) -> DataFrame:
    """node, text of rows without doc_id; their digest is made again."""

    def run(batches):
        for batch in batches:
            for begin, texts in slices(batch.column(0)):
                digests = [(xxhash.xxh3_128_intdigest(s.tobytes()) >> 64) - (1 << 63) for s in shingles(texts)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, len(texts)), pa.array(digests, pa.int64())], names=["text", "h1"])

    rows = docs.where("doc_id is null").select("text").mapInArrow(run, "text string, h1 long").withColumn("doc_id", F.lit(None).cast("long"))
    return rows.select(node("h1").alias("node"), "text")
