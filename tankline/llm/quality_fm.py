"""Quality classifier: a factorisation machine (operator 1).

A document's features are its words (hashed, by their share of all words), statistics
of its structure and its recorded length (each as one of a few bins).  The score is

    sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2))

so all pairs of features interact through `FACTORS` numbers each and scoring takes time
linear in the document.  Labels, language, source and id are never features.

The model is fitted on at most `TRAIN_DOCS` labelled rows, those whose hashed ids come first;
the features of these rows, made by tasks, are all that reaches the driver.  The model is a
fixed 2.4 MB and is broadcast.

Defined results: null and empty texts have structure features only; a document with several labels
takes the largest; with no labelled rows every score is 0.5; repeated rows are scored alike, and of repeated labelled rows as many are
fitted on as the bound leaves room for, in the order of id and text; extra columns are kept by :func:`with_scores`, but for one with the
score's name, which is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tankline.llm.common import append_columns, held_out, materialize
from tankline.llm.words import hashed

BITS, FACTORS = 16, 8
TRAIN_DOCS, EPOCHS, BATCH, RATE, DECAY = 12_000, 8, 256, 0.1, 1e-5
#: Features of the sample that come to the driver at most, eight bytes each.
TRAIN_FEATURES = 20_000_000
#: A document of label 1 is likelier than not kept at this score.
KEEP_AT = 0.3
#: Word shares are scaled so that words and structure weigh alike.
WORD_SCALE = 4.0

BINS = 16
#: Structure statistics: name and whether it is a share (binned by square root) or a size (binned by logarithm).
STATS = [
    ("words", 0), ("bytes", 0), ("lines", 0), ("longest_word", 0), ("mean_word", 0), ("upper", 1), ("digits", 1), ("symbols", 1), ("punctuation", 1), ("bangs", 1),
    ("distinct", 1), ("doubled", 1), ("repeated_lines", 1), ("commonest", 1), ("wide", 1), ("blanks", 1), ("recorded_length", 0),
]
WIDTH = (1 << BITS) + BINS * len(STATS)


def _bin(value: float, share: int) -> int:
    return min(BINS - 1, int((value**0.5) * BINS) if share else int(np.log2(value + 1)))


def _number(word: bytes) -> int:
    """A word's feature, and above it its length."""
    return len(word) << 32 | xxhash.xxh32_intdigest(word) & ((1 << BITS) - 1)


class Features:
    """Index and value lists of texts."""

    def __call__(self, texts: list[str], recorded: list | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Indexes and values of all documents one after the other, and where each begins."""
        ids, docs, structure = [], [], []
        numbers, offsets = hashed(texts, _number)
        for k, text in enumerate(texts):
            found = numbers[offsets[k] : offsets[k + 1]].astype(np.int64)
            n, own = len(found), found & 0xFFFFFFFF
            ids.append(own)
            docs.append(n)
            raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
            hist = np.bincount(raw, minlength=256)
            size = max(1, len(raw))
            lines = text.split("\n")
            full = [x for x in lines if x.strip()]
            kinds = np.sort(own)
            heads = np.flatnonzero(np.concatenate(([True], kinds[1:] != kinds[:-1]))) if n else np.zeros(0, np.int64)
            most = int(np.diff(np.append(heads, n)).max()) if n else 0
            structure.append([
                n, len(raw), len(lines), int((found >> 32).max(initial=0)), size / max(1, n), hist[65:91].sum() / size, hist[48:58].sum() / size,
                hist[[35, 42, 36, 37, 38, 124, 60, 62]].sum() / size, hist[[44, 46, 58, 59, 63]].sum() / size, hist[33] / size,
                len(heads) / max(1, n), int((own[1:] == own[:-1]).sum()) / max(1, n), 1 - len(set(full)) / max(1, len(full)), most / max(1, n), hist[128:].sum() / size, hist[[9, 10, 11, 12, 13, 32]].sum() / size,
                0 if recorded is None or recorded[k] is None else max(0, recorded[k]),
            ])
        lengths = np.array(docs, np.int64)
        doc = np.repeat(np.arange(len(texts)), lengths)
        key = np.sort((doc << BITS) | (np.concatenate(ids) if ids else np.zeros(0, np.int64)))
        head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        count = np.diff(np.append(head, len(key)))
        key = key[head]
        doc, word = key >> BITS, key & ((1 << BITS) - 1)
        share = WORD_SCALE * count / np.maximum(1, lengths[doc])
        bins = np.array([[(1 << BITS) + BINS * j + _bin(float(v), STATS[j][1]) for j, v in enumerate(row)] for row in structure], np.int64).reshape(len(texts), len(STATS))
        index = np.concatenate((word, bins.ravel()))
        value = np.concatenate((share, np.full(bins.size, 1.0 / len(STATS) ** 0.5)))
        owner = np.concatenate((doc, np.repeat(np.arange(len(texts)), len(STATS))))
        order = np.argsort(owner, kind="stable")
        begin = np.searchsorted(owner[order], np.arange(len(texts)))
        return index[order], value[order], begin


class Machine:
    """w0, w and V."""

    def __init__(self, seed: int = 17):
        rng = np.random.default_rng(seed)
        self.w0, self.w = 0.0, np.zeros(WIDTH, np.float32)
        self.v = rng.normal(0, 0.05, (WIDTH, FACTORS)).astype(np.float32)

    def scores(self, index: np.ndarray, value: np.ndarray, begin: np.ndarray):
        """Probabilities, and sum v_if x_i of each document."""
        x = value[:, None] * self.v[index]
        inner = np.add.reduceat(x, begin, axis=0)
        squares = np.add.reduceat(x * x, begin, axis=0)
        z = self.w0 + np.add.reduceat(value * self.w[index], begin) + 0.5 * (inner * inner - squares).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30))), inner

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 17) -> Machine:
        """Logistic loss by AdaGrad over small batches, in a fixed order."""
        if not len(rows):
            return self
        rng = np.random.default_rng(seed)
        rate = float(np.clip(labels.mean(), 0.01, 0.99))
        self.w0 = float(np.log(rate / (1 - rate)))
        gw, gv, g0 = np.full(WIDTH, 1e-6), np.full((WIDTH, FACTORS), 1e-6), 1e-6
        for _ in range(EPOCHS):
            order = rng.permutation(len(rows))
            for at in range(0, len(rows), BATCH):
                part = [rows[i] for i in order[at : at + BATCH]]
                index = np.concatenate([r[0] for r in part])
                value = np.concatenate([r[1] for r in part])
                begin = np.cumsum([0] + [len(r[0]) for r in part[:-1]])
                p, inner = self.scores(index, value, begin)
                error = (p - labels[order[at : at + BATCH]]) / len(part)
                owner = np.repeat(np.arange(len(part)), [len(r[0]) for r in part])
                e = error[owner] * value
                used, where = np.unique(index, return_inverse=True)
                dw = np.bincount(where, e, len(used)) + DECAY * self.w[used]
                slope = e[:, None] * (inner[owner] - value[:, None] * self.v[index])
                dv = np.stack([np.bincount(where, slope[:, f], len(used)) for f in range(FACTORS)], axis=1) + DECAY * self.v[used]
                gw[used] += dw * dw
                gv[used] += dv * dv
                g0 += error.sum() ** 2
                self.w[used] -= (RATE * dw / np.sqrt(gw[used])).astype(np.float32)
                self.v[used] -= (RATE * dv / np.sqrt(gv[used])).astype(np.float32)
                self.w0 -= RATE * float(error.sum()) / g0**0.5
        return self


def _inputs(docs: DataFrame) -> DataFrame:
    length = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), length.alias("recorded"))


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> Machine:
    """A machine fitted on at most `most` labelled documents that aren't held out, one row of each.

    They are chosen in Spark, in the order of their hashed ids, before anything comes to the driver: an id that stands in many rows
    gives the one whose hash is smallest, and documents are taken while they have at most `TRAIN_FEATURES` features together."""
    chosen = (
        labels.where("quality is not null and doc_id is not null").where(~held_out()).groupBy("doc_id").agg(F.max("quality").cast("double").alias("label"))
        .join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    )
    rows = _inputs(docs).join(F.broadcast(chosen), "doc_id")  # at most `most` rows of two numbers

    def vectors(batches):
        make = Features()
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                index, value, begin = make([t or "" for t in part.column(0).to_pylist()], part.column(1).to_pylist())
                bounds = pa.array(np.append(begin, len(index)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [part.column(2), part.column(3), part.column(4), pa.ListArray.from_arrays(bounds, pa.array(index.astype(np.int32))), pa.ListArray.from_arrays(bounds, pa.array(value.astype(np.float32)))],
                    names=["doc_id", "label", "mark", "index", "value"],
                )

    kind = "doc_id long, label double, mark long, index array<int>, value array<float>"
    one = rows.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.struct(F.xxhash64("text", "recorded").alias("mark"), "text", "recorded", "label")).alias("r"))
    inputs = one.select("r.text", "r.recorded", "doc_id", "r.label", "r.mark")
    made = materialize(inputs.mapInArrow(vectors, kind), "training-rows")
    before = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)  # two numbers of at most `most` rows
    taken = made.select("doc_id", F.sum(F.size("index").cast("long")).over(before).alias("total")).where(F.col("total") <= TRAIN_FEATURES).select("doc_id")
    found = made.join(taken, "doc_id", "left_semi").toArrow().sort_by([("doc_id", "ascending"), ("mark", "ascending")])
    pairs = [(np.array(i.values), np.array(v.values)) for i, v in zip(found.column("index"), found.column("value"), strict=True)]
    return Machine().fit(pairs, found.column("label").to_numpy())


def with_scores(docs: DataFrame, machine: Machine, name: str = "score") -> DataFrame:
    """All columns and the score as `name`; one narrow pass.  n_chars is the recorded length, if there is one."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    recorded = "n_chars" if "n_chars" in docs.columns else None

    def kernel():
        make, model = Features(), shared.value

        def work(texts, lengths=None):
            out = [np.zeros(0)]
            for lo in range(0, len(texts), 500):
                known = lengths[lo : lo + 500] if lengths is not None else None
                out.append(model.scores(*make(texts[lo : lo + 500], known))[0].astype(np.float64))
            return [np.concatenate(out)]

        return work

    return append_columns(docs, kernel, [T.StructField(name, T.DoubleType())], also=recorded)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    inputs = _inputs(docs).withColumnRenamed("recorded", "n_chars").withColumn("held_out", held_out())
    return with_scores(inputs, train(docs, labels)).select(
        "doc_id", "held_out", "score", (F.col("score") >= KEEP_AT).cast("int").alias("predicted")
    )
