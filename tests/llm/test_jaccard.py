"""Jaccard components against a brute-force join, with settings that force every path."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tankline.llm import jaccard


def brute(rows):
    sets = {}
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = set(zip(*[words[k:] for k in range(5)], strict=False)) if len(words) >= 5 else ({tuple(words)} if words else set())
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(s), root(i)) for i, s in sets.items()}


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choices(words, k=rng.randint(6, 90))) for _ in range(8)]
    shared = " ".join(rng.choices(words, k=12))
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "A b c"), (4, "a B\tc"), (5, "a b"), (6, "x y z v w"), (7, "X y z v w")]
    for i in range(8, 240):
        text = rng.choice(base).split()
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            text[rng.randrange(len(text))] = rng.choice(words)
        if rng.random() < 0.3:
            text = shared.split() + text
        rows.append((i, " ".join(text)))
    return rows


@pytest.fixture
def counted(monkeypatch):
    """Rows of every table that the join writes."""
    rows, write = {}, jaccard.materialize

    def counting(df, label):
        out = write(df, label)
        rows[label] = out.count()
        return out

    monkeypatch.setattr(jaccard, "materialize", counting)
    return rows


@pytest.mark.parametrize(("seed", "hubs", "tile", "frequent"), [(7, 3, 1024, 65536), (1, 1, 3, 4), (2, 1, 7, 65536), (3, 2, 2, 65536)])
def test_components(spark, monkeypatch, counted, seed, hubs, tile, frequent):
    for name, value in (("HUBS", hubs), ("TILE", tile), ("FREQUENT", frequent), ("LEAST", 2)):
        monkeypatch.setattr(jaccard, name, value)
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, "x", i) for i, t in rows], "doc_id long, text string, component_id string, n long").repartition(5)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs).collect()}
    assert found == brute(rows)
    assert counted["anchor-links"] > 0
    assert tile > 3 or counted["hub-links"] > 0


def test_full_tiles_alone(spark, monkeypatch, counted):
    """Without links from anchors and hubs the full tiles find all."""
    join = jaccard.Tiles.joined
    monkeypatch.setattr(jaccard.Tiles, "joined", lambda self, members, label: join(self, members if label == "full" else members.limit(0), label))
    monkeypatch.setattr(jaccard, "TILE", 5)
    monkeypatch.setattr(jaccard, "LEAST", 2)
    rows = corpus(5)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs).collect()} == brute(rows)
    assert counted["full-links"] > 0


def test_copies_cost_no_more_than_their_number(spark, counted):
    rows = corpus(4)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    once = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs).collect()}
    before = dict(counted)
    copies = spark.createDataFrame([r for r in rows for _ in range(12)], "doc_id long, text string").repartition(3)
    found = jaccard.jaccard_components(copies).collect()
    assert len(found) == 12 * len(rows)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in found} == once
    assert counted.pop("sets") == 12 * before.pop("sets")
    # counts of shingles, and with them their order, are others; the work is the same
    assert {k: (n, before[k]) for k, n in counted.items() if n > 1.5 * before[k] + 20} == {}


def template_pages(n, own, of=100):
    """Pages of one template with so many words of their own, sizes a little apart."""
    shared = [f"t{k}" for k in range(of - own)]
    return [(i, " ".join([f"p{i}w{k}" for k in range(own + i % 3)] + shared)) for i in range(n)]


@pytest.mark.parametrize("tile", [8, 1024])
def test_template_pages_under_the_threshold_make_no_tiles(spark, monkeypatch, counted, tile):
    """Pages that share 85 of 100 words and don't link: neither as frequent nor as other shingles do they meet."""
    monkeypatch.setattr(jaccard, "TILE", tile)
    rows = template_pages(400, 15)
    found = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert all(r.component_id == r.doc_id for r in found)
    assert {k: n for k, n in counted.items() if n > 0 and k not in ("sets", "classes")} == {}


@pytest.mark.parametrize("tile", [8, 1024])
def test_template_pages_around_the_threshold(spark, monkeypatch, tile):
    monkeypatch.setattr(jaccard, "TILE", tile)
    monkeypatch.setattr(jaccard, "LEAST", 2)
    rows = [(1000 * own + i, f"{t} e{i % 5}") for own in (4, 6, 7, 8, 15) for i, t in template_pages(30, own)]
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert found == brute(rows)


@pytest.mark.parametrize("seed", range(4))
def test_met_is_what_pairs_say(seed):
    rng = np.random.default_rng(seed)
    token, n = np.sort(rng.integers(0, 12, 150)), rng.integers(1, 60, 150)
    reach = (9 * (n - (n * rng.random(150) * 0.3).astype(int))) // 4 - n
    order = np.lexsort((n, token))
    token, n, reach = token[order], n[order], np.maximum(reach[order], 0)
    wanted = [any(i != j and token[i] == token[j] and n[i] <= reach[j] and n[j] <= reach[i] for j in range(150)) for i in range(150)]
    assert jaccard.met(token, n, reach).tolist() == wanted
    # held from batch to batch
    rows = [token, (n << 32) + reach, np.arange(150)]
    size = np.lexsort((rows[1], token))
    batch = pa.RecordBatch.from_arrays([pa.array(c[size]) for c in rows], names=["token", "size", "node"])
    found = {x.as_py() for b in jaccard._runs(batch.slice(k, 7) for k in range(0, 150, 7)) for x in b.column(1)}
    assert found == {i for i, w in enumerate(wanted) if w}


def test_rows_without_id(spark):
    text = " ".join(f"w{i}" for i in range(60))
    near = text.replace("w59", "x")
    alone = [(None, "a b c d e f g"), (None, "a b c d e f g h i j k"), (None, "a b c d e f g h i j k l")]
    rows = [(None, text), (9, near), (None, text), (4, "other words"), (None, None), *alone]
    found = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=str) == sorted(
        [(None, 56, 9), (9, 56, 9), (None, 56, 9), (4, 1, 4), (None, 0, None), (None, 3, None), (None, 7, None), (None, 8, None)], key=str
    )


def test_one_id_for_two_texts(spark):
    """Rows with one doc_id are one document with the links of both."""
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(5, a), (5, b), (7, a.replace("a39", "x")), (6, b.replace("b39", "x"))]
    found = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id) for r in found} == {(5, 5), (6, 5), (7, 5)}


def test_empty_table(spark):
    assert jaccard.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
