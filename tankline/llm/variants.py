"""Grouping of spelling variants: words one edit apart and the frequent form of each (operator 13).

Two words are near if one inserted, deleted or replaced code point makes one of the other: their common prefix and
common suffix together reach the longer length less one.  Words (all of Latin-1, so one byte a code point) are compared
by dense tiles: blocks of neighbouring rows as padded code-point matrices, each block against itself and the blocks
after it that share a group, prefix and suffix lengths of all pairs at once.

Which rows are neighbours follows from the same bound.  For pairs whose longer word has m code points, prefix + suffix
reach m - 1; so with f = m - 1 the prefix reaches ceil(f / 2) or the suffix reaches floor(f / 2) + 1.  A word therefore
stands in two groups for m = its length and two for m = its length + 1.  A group of more than `TILE` words is halved
again in the same way (what it shares grows, f shrinks), until groups are small; at f = 0 all its words agree but at one place, so it has
no more words than the alphabet and one.  Hence no group, hot or not, is compared all with all beyond a fixed size, and
no pair is lost.  `below` tells which of two groups gives a pair out that both hold: right halves only give pairs whose
common prefix is too short for the left half.

Runs are counted in tasks (a bounded table, given on when full) and summed by word.

Defined results: null and empty texts have no words; a null doc_id is the empty string in the hashed text; repeated rows
count each; ties of the largest count go to the first word in code-point order; columns other than doc_id and text are ignored,
whatever their names; an empty table gives no rows.  Very long texts and words are taken whole.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tankline.llm.common import bound_batches, materialize, slices
from tankline.llm.memory import releasing
from tankline.llm.words import numbered

#: What separates runs; shortest word and least count; how much more frequent a form is; one in so many runs loses a code point.
GAPS, SHORTEST, LEAST, TIMES, ONE_IN = "[^A-Za-zÀ-ÿ]+", 7, 2, 10, 31
#: Words that a task counts before it gives them on, words in a group that is compared, rows of a block, cells of a tile.
HELD, TILE, ROWS, CELLS = 300_000, 512, 128, 2_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def run_counts(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """word, n: partial counts of each task."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush():
            made = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
            counts.clear()
            return made

        for batch in batches:
            for begin, texts in slices(batch.column(1)):
                distinct, numbers, offsets = numbered(texts, lambda a: pc.split_pattern_regex(pc.ascii_lower(a), GAPS))
                runs = distinct.to_pylist()
                raw = [x.encode() for x in runs]
                ids = batch.column(0).slice(begin, len(texts)).to_pylist()
                whole = np.zeros(len(runs), np.int64)
                for i, a, b in zip(ids, offsets.tolist(), offsets[1:].tolist(), strict=False):
                    kinds, times = np.unique(numbers[a:b], return_counts=True)
                    start, kinds = zlib.crc32(b"%s:" % ("" if i is None else str(i)).encode()), kinds.tolist()
                    hashes = np.fromiter((zlib.crc32(raw[k], start) for k in kinds), np.int64, len(kinds))
                    cut = hashes % ONE_IN == 0
                    whole[np.asarray(kinds, np.int64)[~cut]] += times[~cut]
                    for k, h, n in zip(np.asarray(kinds, np.int64)[cut].tolist(), hashes[cut].tolist(), times[cut].tolist(), strict=True):
                        if run := runs[k]:
                            at = h % len(run)
                            if len(run) > shortest:
                                counts[run[:at] + run[at + 1 :]] += n
                for k in np.flatnonzero(whole).tolist():
                    if len(runs[k]) >= shortest:
                        counts[runs[k]] += int(whole[k])
                if len(counts) > HELD:
                    yield flush()
        if counts:
            yield flush()

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    bound_batches(docs.sparkSession)
    return rows.mapInArrow(releasing(words), "word string, n long")


def word_table(docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST) -> DataFrame:
    """word, n of all words that are long and frequent enough."""
    return run_counts(docs, shortest).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _halves(rows: DataFrame) -> DataFrame:
    """Each row in the groups of its two halves: those that share half of the free part at its head, or more than half at its end."""
    f = F.col("m") - 1 - F.col("p") - F.col("s")
    more = F.ceil(f / 2).cast("int")
    left = F.struct((F.col("p") + more).alias("p"), F.col("s").alias("s"), F.col("below").alias("below"))
    right = F.struct(F.col("p").alias("p"), (F.col("s") + F.floor(f / 2).cast("int") + 1).alias("s"), F.least(F.col("below"), F.col("p") + more).alias("below"))
    halved = rows.select("word", "n", "m", F.explode(F.array(left, right)).alias("h")).select("word", "n", "m", "h.*")
    # `tag` is the group: its class, what it shares and how much of it
    shared = F.concat_ws("/", "m", "p", "s", "below", F.substring("word", F.lit(1), F.col("p")), F.when(F.col("s") > 0, F.expr("right(word, s)")).otherwise(""))
    return halved.withColumn("tag", shared)


def groups(words: DataFrame, tile: int = TILE) -> DataFrame:
    """tag, word, n, m, below: words by what near ones would share; groups of one are left out, large ones are halved."""
    n = F.length("word")
    rows = words.select("word", "n", F.explode(F.array(n, n + 1)).alias("m")).withColumns({"p": F.lit(0), "s": F.lit(0), "below": F.lit(2_000_000_000)})
    small = []
    while True:
        rows = materialize(_halves(rows), "variant-groups")
        sizes = rows.groupBy("tag").agg(F.count("*").alias("size"), F.max(F.length("word")).alias("longest"), F.max(F.col("m") - 1 - F.col("p") - F.col("s")).alias("free"))
        sizes = materialize(sizes.where("size > 1"), "variant-sizes").where(F.col("longest") == F.substring_index("tag", "/", 1).cast("int"))
        hot = (F.col("size") > tile) & (F.col("free") > 0)
        small.append(rows.join(sizes.where(~hot).select("tag"), "tag", "left_semi").select("tag", "word", "n", "m", "below"))
        if sizes.where(hot).isEmpty():
            break
        rows = rows.join(sizes.where(hot).select("tag"), "tag", "left_semi")
    out = small[0]
    for more in small[1:]:
        out = out.unionByName(more)
    return out


def _matrix(words: list[bytes], width: int, pad: int, backwards: bool) -> np.ndarray:
    """One row of code points for each word, filled up with `pad`."""
    step = -1 if backwards else 1
    return np.frombuffer(b"".join([w[::step].ljust(width, bytes([pad])) for w in words]), np.uint8).reshape(len(words), width)


def tile_pairs(left: tuple, right: tuple, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows of two blocks (words, group numbers, m, below) that are near, in one group, of its class, and this group's to give out."""
    (a, ga, m, below), (b, gb, _, _) = left, right
    width = max(map(len, a + b)) + 1
    alike = [(_matrix(a, width, 0, back)[:, None, :] == _matrix(b, width, 1, back)[None, :, :]).argmin(axis=2) for back in (False, True)]
    la, lb = np.array(list(map(len, a))), np.array(list(map(len, b)))
    longer = np.maximum(la[:, None], lb[None, :])
    m = m[:, None]
    near = (ga[:, None] == gb[None, :]) & (longer == m) & (alike[0] + alike[1] >= longer - 1) & (alike[0] < below[:, None])
    near &= (alike[0] < longer) & (np.minimum(la[:, None], lb[None, :]) >= m - 1)
    if same:
        near &= np.arange(len(a))[:, None] < np.arange(len(b))[None, :]
    return np.nonzero(near)


def near_pairs(grouped: DataFrame) -> DataFrame:
    """word, other, other_n: both directions of every near pair, each once."""

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # blocks whose last group may go on

        def block(rows: pa.RecordBatch):
            words = rows.column(1).to_pylist()
            return [w.encode("latin-1") for w in words], np.asarray(rows.column(0).dictionary_encode().indices), np.asarray(rows.column(3)), np.asarray(rows.column(4)), rows

        def given(x, y, i, j):
            (ax, bx), (ay, by) = ((r.column(1), r.column(2)) for r in (x, y))
            i, j = pa.array(i), pa.array(j)
            return [
                pa.RecordBatch.from_arrays([ax.take(i), ay.take(j), by.take(j)], names=["word", "other", "other_n"]),
                pa.RecordBatch.from_arrays([ay.take(j), ax.take(i), bx.take(i)], names=["word", "other", "other_n"]),
            ]

        for batch in batches:
            at = 0
            longest = np.maximum.accumulate(np.asarray(pc.utf8_length(batch.column(1)))) if batch.num_rows else []
            while at < batch.num_rows:
                # as many rows as keep rows * rows * width within bounds
                width = int(longest[min(at + ROWS, batch.num_rows) - 1]) + 1
                step = max(1, min(ROWS, int((CELLS / width) ** 0.5)))
                rows = batch.slice(at, step)
                at += rows.num_rows
                first, final = rows.column(0)[0].as_py(), rows.column(0)[rows.num_rows - 1].as_py()
                held = [h for h in held if h[1] == first]
                own = block(rows)
                i, j = tile_pairs(own[:4], own[:4], True)
                if len(i):
                    yield from given(rows, rows, i, j)
                for before, tag in held:
                    words, _, m, below, theirs = before
                    numbers = np.asarray(pc.equal(theirs.column(0), tag)).astype(int) - 1
                    mine = -np.asarray(pc.equal(rows.column(0), tag)).astype(int) + 1  # rows of the shared group are 0 on both sides
                    keep_l, keep_r = np.flatnonzero(numbers == 0), np.flatnonzero(mine == 0)
                    i, j = tile_pairs(([words[k] for k in keep_l], numbers[keep_l], m[keep_l], below[keep_l]), ([own[0][k] for k in keep_r], mine[keep_r], None, None), False)
                    if len(i):
                        yield from given(theirs, rows, keep_l[i], keep_r[j])
                held = [h for h in held if h[1] == final]
                held.append((own, final))

    spread = grouped.repartition(F.col("tag")).sortWithinPartitions("tag", "word")
    bound_batches(grouped.sparkSession)
    return spread.select("tag", "word", "n", "m", "below").mapInArrow(releasing(tiles), "word string, other string, other_n long")


def roots(forms: DataFrame) -> DataFrame:
    """word, root of all words with a form: pointers are doubled until none moves (each step is TIMES times as frequent, so a chain has at most 19)."""
    at = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(6):
        step = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        on = materialize(at.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        at = on.select("word", "root")
        if on.where("moved").isEmpty():
            break
    return at


def variants(docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST, times: int = TIMES, tile: int = TILE) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the table."""
    words = materialize(word_table(docs, shortest, least), "words")
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form"))).alias("best")
    near = near_pairs(groups(words, tile)).groupBy("word").agg(F.count("*").alias("n_near"), best)
    joined = words.join(near, "word", "left").withColumn("form_n", -F.col("best.less"))
    is_form = F.coalesce(F.col("form_n") >= times * F.col("n"), F.lit(False))
    formed = materialize(
        joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best.form")).alias("form"), F.when(is_form, F.col("form_n")).alias("form_n")), "forms"
    )
    ends = roots(formed.where("form is not null"))
    return formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
