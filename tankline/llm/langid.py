"""Language identification by rank-order n-gram profiles (operator 9).

A profile lists a language's most frequent letter n-grams (one to three letters,
words padded with one space) by rank.  A document's own list is compared to each
profile by out-of-place distance: how far each n-gram stands from its rank in the
profile, at most the profile's length where it is missing.  The nearest profile wins;
ties go to the language that comes first in code-point order.

Learning counts all n-grams of all training rows: tasks add up their own counts, one
exchange sums them by language and n-gram.  Profiles are a fixed number of rows for each
language, so broadcasting them is bounded by the set of languages.

Defined results: a text that is null or holds no letter is ``und`` with score 0; with no
training rows every text is ``und``; repeated rows are independent.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tankline.llm.common import append_columns, held_out, slices

#: N-grams in a profile and in a document's list.
PROFILE = 400
UNKNOWN = "und"
#: Counting by dense trigram table needs at most this many different letters in a slice.
DENSE_LETTERS = 200
#: N-grams that a task holds before it gives their counts on.
HELD = 400_000


@cache
def letters() -> np.ndarray:
    """For each code point the code point of its lower-case letter, or that of a space."""
    table = np.full(0x110000, 32, np.int64)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def normal(text: str) -> np.ndarray:
    """Lower-case letters with single spaces around words; empty if the text holds no letter."""
    codes = letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
    padded = np.concatenate(([32], codes, [32]))
    space = padded == 32
    keep = np.ones(len(padded), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    out = padded[keep]
    return out if len(out) > 1 else out[:0]


def grams(x: np.ndarray) -> np.ndarray:
    """All n-grams as integers: 21 bits a letter, shorter ones smaller; none with a space inside or alone."""
    one = x[x != 32]
    two = (x[:-1] << 21) | x[1:]
    inner = x[1:-1] != 32
    three = ((x[:-2] << 42) | (x[1:-1] << 21) | x[2:])[inner]
    return np.concatenate((one, two, three))


def counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(values):
        return values, values
    s = np.sort(values)
    at = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
    return s[at], np.diff(np.append(at, len(s)))


def totals(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As counted(grams(x)), by a dense table where the alphabet is small."""
    alphabet = np.flatnonzero(np.bincount(x)) if len(x) and x.max() < 1 << 17 else np.zeros(0, np.int64)
    v = len(alphabet)
    if not v or v > DENSE_LETTERS or alphabet[0] != 32:
        return counted(grams(x))
    number = np.zeros(alphabet[-1] + 1, np.int64)
    number[alphabet] = np.arange(v)
    y = number[x]
    one = np.bincount(y, minlength=v)
    one[0] = 0
    two = np.bincount(y[:-1] * v + y[1:], minlength=v * v)
    three = np.bincount((y[:-2] * v + y[1:-1]) * v + y[2:], minlength=v**3).reshape(v, v, v)
    three[:, 0, :] = 0
    three = three.ravel()
    a, b, c = np.flatnonzero(one), np.flatnonzero(two), np.flatnonzero(three)
    keys = (alphabet[a], (alphabet[b // v] << 21) | alphabet[b % v], (alphabet[c // v // v] << 42) | (alphabet[c // v % v] << 21) | alphabet[c % v])
    return np.concatenate(keys), np.concatenate((one[a], two[b], three[c]))


def learn(docs: DataFrame, size: int = PROFILE) -> DataFrame:
    """lang, gram, rank: each language's profile, from all rows of `docs` with a language and a text."""

    def count(batches):
        sums: dict[str, dict] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for begin, texts in slices(batch.column(1)):
                by: dict[str, list] = {}
                for lang, text in zip(langs[begin : begin + len(texts)], texts, strict=True):
                    by.setdefault(lang, []).append(normal(text))
                for lang, parts in by.items():
                    # every part begins and ends with a space; the doubled space between two parts is cut
                    x = np.concatenate(parts)
                    doubled = np.zeros(len(x), bool)
                    doubled[1:] = (x[1:] == 32) & (x[:-1] == 32)
                    keys, n = totals(x[~doubled])
                    mine = sums.setdefault(lang, {})
                    for k, c in zip(keys.tolist(), n.tolist(), strict=True):
                        mine[k] = mine.get(k, 0) + c
                if sum(map(len, sums.values())) > HELD:
                    yield from give(sums)
                    sums = {}
        yield from give(sums)

    def give(sums):
        for lang, mine in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(mine), pa.string()), pa.array(list(mine), pa.int64()), pa.array(list(mine.values()), pa.int64())], names=["lang", "gram", "n"])

    sums = (
        docs.where("lang is not null and text is not null").select(F.col("lang").cast("string"), F.col("text").cast("string")).mapInArrow(count, "lang string, gram long, n long")
        .groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    )
    order = [F.col("n").desc(), F.col("gram")]
    # a language may hold most of the n-grams: the first ranking is over parts of it
    few = sums.withColumn("part", F.pmod(F.hash("gram"), F.lit(16)))
    few = few.withColumn("r", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("r") <= size)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)) - 1).where(F.col("rank") < size)
    return ranked.select("lang", "gram", "rank")


class Profiles:
    """Ranks of every profile n-gram in every language, `size` where it is missing."""

    def __init__(self, langs: list[str], gram: np.ndarray, rank: np.ndarray, size: int):
        self.names = sorted(set(langs))
        self.size = size
        self.grams = np.unique(gram)
        self.ranks = np.full((len(self.grams), len(self.names)), size, np.int64)
        at = {n: i for i, n in enumerate(self.names)}
        self.ranks[np.searchsorted(self.grams, gram), [at[x] for x in langs]] = rank

    def nearest(self, text: str) -> tuple[str, float]:
        x = normal(text)
        if not len(x) or not self.names:
            return UNKNOWN, 0.0
        keys, n = counted(grams(x))
        top = keys[np.argsort(-n, kind="stable")[: self.size]]
        at = np.minimum(np.searchsorted(self.grams, top), len(self.grams) - 1)
        ranks = np.where((self.grams[at] == top)[:, None], self.ranks[at], self.size)
        away = np.abs(ranks - np.arange(len(top))[:, None])
        away[ranks == self.size] = self.size
        far = np.minimum(away, self.size).sum(axis=0)
        best = int(far.argmin())
        return self.names[best], 1.0 - float(far[best]) / (len(top) * self.size)


def with_language(docs: DataFrame, profiles: DataFrame, size: int = PROFILE) -> DataFrame:
    """All columns, `lang_pred` and `score` (1 - distance / largest distance)."""
    rows = profiles.toArrow()
    shared = docs.sparkSession.sparkContext.broadcast(Profiles(rows.column("lang").to_pylist(), rows.column("gram").to_numpy(), rows.column("rank").to_numpy(), size))

    def kernel():
        nearest = shared.value.nearest

        def work(texts):
            found = [nearest(t) for t in texts]
            return [[n for n, _ in found], [s for _, s in found]]

        return work

    return append_columns(docs, kernel, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: profiles from the rows that aren't held out, applied to all."""
    profiles = learn(docs.where(~held_out()).select("lang", "text"))
    return with_language(docs.select("doc_id", held_out().alias("held_out"), F.col("text").cast("string").alias("text")), profiles).drop("text")
