"""The other training-data operators against brute force, exact round trips and held-out accuracy."""

import base64
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tankline.llm import bpe, decontaminate, langid, lm_scoring, quality_fm, repetition, token_counts, token_files, warc
from tankline.llm.common import fresh_path

ODD = [None, "", " ", "\n\t ", "a", "a  b \n c", "it's 12.5 <|endoftext|> ok", "x" * 5000, "é 字 🙂 ²½ \x1c\x85　z", ("lorem ipsum dolor " * 400).strip(), "of.\nThen, so.\n\nNext, 'twas"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, i % 3, "c") for i, t in enumerate(ODD + ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words long, score string").repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


def test_bpe_is_what_the_library_gives(docs, none):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {t: i for i, t in enumerate(bpe.load_ranks(path))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    found = {r.doc_id: r for r in bpe.digests(docs, path, P.PATTERN).collect()}
    for i, t in texts(docs).items():
        ids = library.encode_ordinary(t)
        assert (found[i].n_tokens, found[i].ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert found[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    assert bpe.digests(none, path, P.PATTERN).count() == 0


def test_perfect_hash_is_minimal():
    keys = [str(i).encode() for i in range(3000)]
    h = bpe.PerfectHash(keys)
    assert sorted(h.ids) == list(range(3000)) and all(h.find(k, keys) == i for i, k in enumerate(keys)) and h.find(b"no", keys) == -1


def test_counts_and_files(spark, docs, none):
    path = P.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    counts = {r.doc_id: r for r in token_counts.token_counts(docs, path).collect()}
    back = {r.doc_id: r for r in token_files.round_trip(docs, path).collect()}
    start = 0
    for i, t in sorted(texts(docs).items()):
        ids = library.encode(t, add_special_tokens=False).ids
        assert (counts[i].n_bytes, counts[i].n_tokens, counts[i].over_limit) == (len(t.encode()), len(ids), len(ids) > 512)
        raw = np.array([*ids, 2], "<u4").tobytes()
        assert (back[i].start, back[i].n_tokens, back[i].ids_crc32) == (start, len(ids) + 1, zlib.crc32(raw))
        start += len(ids) + 1
    assert token_counts.token_counts(none, path).count() == 0 and token_files.round_trip(none, path).count() == 0
    model = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, P.path("piece_bpe_32k.model")).collect()}
    assert model[0] == 0 and model[4] > 0


def test_token_files_keep_null_ids(spark):
    rows = [(None, "abc"), (-1, "x y"), (3, None), (None, "abc def"), (3, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    found = token_files.round_trip(docs, P.path("byte_bpe_50k.json")).collect()
    counts = sorted((str(i), len(library.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in rows)
    assert sorted((str(r.doc_id), r.n_tokens) for r in found) == counts
    order = sorted(found, key=lambda r: r.start)
    assert [r.doc_id for r in order] == [None, None, -1, 3, 3]
    assert [r.start for r in order] == [sum(x.n_tokens for x in order[:k]) for k in range(5)]


def test_frequent_chunks_by_a_tree(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "FAN", 2)
    rows = [(i, f"a b{i % 3} b{i % 3} c d{i}") for i in range(90)]
    texts = spark.createDataFrame(rows, "i int, text string").repartition(7).select("text")
    assert token_counts.frequent_chunks(texts) == ["b0", "b1", "b2", "c"]
    assert token_counts.frequent_chunks(texts.limit(0)) == []


def test_two_vocabularies_in_one_worker(spark, tmp_path):
    """Equal in size, last entry and pattern, and still not mixed up."""
    letters = [bytes([b]) for b in range(256)]
    out = []
    for name, pair in (("one", b"ab"), ("two", b"cd")):
        path = tmp_path / name
        path.write_text("".join(f"{base64.b64encode(t).decode()} {i}\n" for i, t in enumerate([*letters, pair, b"zz"])))
        rows = bpe.encode(spark.createDataFrame([("abcd",)], "text string").coalesce(1), str(path), P.PATTERN).collect()
        out.append(np.frombuffer(rows[0].ids, "<u4").tolist())
    assert out == [[256, 99, 100], [97, 98, 256]]


def test_one_document_by_its_index(spark, docs):
    out = fresh_path(spark, "one-document")
    manifest = token_files.write(docs, P.path("byte_bpe_50k.json"), 2, out, 2).collect()
    found = [token_files.read_document(out, m.path, 9) for m in manifest]
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert [x.tolist() for x in found if x is not None] == [library.encode(ODD[9], add_special_tokens=False).ids + [2]]


def test_repetition_against_brute_force():
    rng = random.Random(5)

    def brute(words, least):
        n = len(words)
        best = [0] * n
        for i in range(n):
            for j in range(n):
                k = 0
                while i != j and max(i, j) + k < n and words[i + k] == words[j + k]:
                    k += 1
                best[i] = max(best[i], k)
        covered, repeated = set(), set()
        for i, b in enumerate(best):
            if b >= least:
                covered |= set(range(i, i + b))
            if b >= 5:
                repeated |= set(range(i, i + 5))
        return len(repeated), len(covered) / max(1, n), max([b for b in best if b >= least], default=0)

    for _ in range(60):
        part = [" ".join(rng.choice("abcd"[: rng.randint(1, 4)]) for _ in range(rng.randint(0, 35))) for _ in range(4)]
        found = repetition.measure(part, 6)
        for k, t in enumerate(part):
            assert (found[4][k], found[5][k], found[6][k]) == brute(t.split(), 6)


def test_rules(docs, none):
    found = {r.doc_id: r for r in repetition.quality_rules(docs).collect()}
    assert len(found) == len(ODD) * 2 and not found[0].kept and found[0].n_words == 0
    assert found[9].base_failed and found[9].n_repeat_words == found[9].n_words == 1200
    assert repetition.quality_rules(none).count() == 0
    assert repetition.with_verdicts(docs, prefix="_r_").columns[:5] == docs.columns
    line = repetition.measure(["a #b\n\na #b\n$c|"])
    assert [x[0] for x in line[:4]] == [5, 9, 4, 1]


def test_each_limit_of_the_method_decides():
    """Documents that the base rules keep: one limit alone rejects the second and the third, the method keeps the others."""
    rng = random.Random(8)
    fresh = lambda n: [f"w{rng.randrange(10**12)}" for _ in range(n)]
    short, lines, passage = fresh(11), [fresh(10) for _ in range(12)], fresh(110)
    texts = [
        fresh(400) + short + fresh(3) + short,  # one repeated line
        fresh(1100) + [w for line in lines for w in line + line[::-1][:1]] + fresh(5) + [w for line in lines for w in line],  # twelve lines: a sixth
        fresh(3000) + passage + fresh(2) + passage,  # 110 words of 3222 are more than a fortieth
        fresh(6000) + passage + fresh(2) + passage,  # and of 6222 are less
    ]
    found = repetition.measure([" ".join(t) for t in texts])
    covered, longest, failed, kept = found[5], found[6], found[7], found[8]
    assert not failed.any() and kept.tolist() == [True, False, False, True]
    assert covered[1] > repetition.MAX_COVERED and longest[1] == 11 and covered[2] < repetition.MAX_COVERED and longest[2] == 110


def test_language(spark, docs, none):
    rng = random.Random(1)
    words = {"aa": ["kala", "talo", "puu", "vesi"], "bb": ["haus", "baum", "strasse", "und"]}
    rows = [(i, " ".join(rng.choices(words[lang], k=30)), lang) for i in range(300) for lang in [rng.choice(["aa", "bb"])]]
    rows += [(900, None, "aa"), (901, "12 !", "bb"), (902, "kala", None)]
    found = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(found[i].lang_pred == lang for i, _, lang in rows[:300])
    assert (found[900].lang_pred, found[901].lang_pred, found[901].score, found[902].lang_pred) == ("und", "und", 0.0, "aa")
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in found.values())
    assert langid.identify(none).count() == 0 and {r.lang_pred for r in langid.identify(docs.where("lang is null")).collect()} == {"und"}
    x = langid.normal("Abc, ab! É")
    a, b = langid.counted(langid.grams(x)), langid.totals(x)
    assert sorted(zip(*map(list, a), strict=True)) == sorted(zip(*map(list, b), strict=True))


def test_language_against_plain_counting(spark):
    """Profiles and out-of-place distances made again with strings and dictionaries."""
    rng = random.Random(12)
    letters = {"aa": "abcdeéf", "bb": "efghijß", "cc": "abxyzя日"}
    rows = [(i, " ".join("".join(rng.choices(letters[lang], k=rng.randint(1, 7))) for _ in range(rng.randint(1, 20))) + rng.choice(["", " 12!", "."]), lang) for i in range(200) for lang in [rng.choice(list(letters))]]

    def grams(text):
        words = "".join(c.lower() if c.isalpha() else " " for c in text).split()
        x = " " + " ".join(words) + " "
        out = Counter(c for c in x if c != " ") + Counter(x[i : i + 2] for i in range(len(x) - 1)) + Counter(x[i : i + 3] for i in range(len(x) - 2) if x[i + 1] != " ")
        return sorted(out.items(), key=lambda g: (-g[1], sum(ord(c) << 21 * (len(g[0]) - 1 - k) for k, c in enumerate(g[0]))))

    size = 60
    train = {lang: " ".join(t for i, t, x in rows if x == lang and zlib.crc32(str(i).encode()) % 5) for lang in letters}
    ranks = {lang: {g: r for r, (g, _) in enumerate(grams(t)[:size])} for lang, t in train.items()}
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    profiles = langid.learn(table.where(~langid.held_out()), size)
    found = {r.doc_id: (r.lang_pred, r.score) for r in langid.with_language(table, profiles, size).collect()}
    for i, text, _ in rows:
        own = [g for g, _ in grams(text)[:size]]
        far = {lang: sum(abs(known[g] - r) if g in known else size for r, g in enumerate(own)) for lang, known in ranks.items()}
        best = min(sorted(far), key=far.get)
        assert found[i][0] == best and found[i][1] == pytest.approx(1 - far[best] / (len(own) * size))


def test_quality(spark, docs, none):
    rng = random.Random(2)
    good, bad = ["river", "stone", "window", "garden"], ["###", "$$$", "BUY!!", "|"]
    rows = [(i, " ".join(rng.choices(good if i % 3 else bad, k=40))) for i in range(600)]
    labels = spark.createDataFrame([(i, int(bool(i % 3))) for i in range(600)], "doc_id long, quality int")
    found = quality_fm.quality(spark.createDataFrame(rows, "doc_id long, text string"), labels).where("held_out").collect()
    assert len(found) > 80 and all(r.predicted == int(bool(r.doc_id % 3)) for r in found)
    unlabelled = quality_fm.quality(docs, labels.where("doc_id < 0")).collect()
    assert len(unlabelled) == len(ODD) * 2 and {r.score for r in unlabelled} == {0.5} or all(0 <= r.score <= 1 for r in unlabelled)
    assert quality_fm.quality(none, labels).count() == 0


def test_machine_equals_the_sum_over_pairs():
    m = quality_fm.Machine()
    m.w0, m.w = 0.1, np.random.default_rng(0).normal(0, 1, quality_fm.WIDTH).astype(np.float32)
    i, x = np.array([3, 9, 70, 65536]), np.array([0.5, 1.0, 0.2, 0.7])
    z = 0.1 + (m.w[i] * x).sum() + sum((m.v[i[a]] @ m.v[i[b]]) * x[a] * x[b] for a in range(4) for b in range(a))
    assert m.scores(i, x, np.array([0]))[0][0] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-6)


def test_training_sample_is_bounded_before_the_driver(spark, monkeypatch):
    """Ids of a thousand rows each bring one row; documents are taken while their features fit."""
    rows = [(i, f"{'river stone' if i % 2 else '### $$$'} {k % 3}") for i in range(20) for k in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)] * 3, "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality_fm.Machine, "fit", lambda self, rows, *a, **k: seen.append(len(rows)) or self)
    quality_fm.train(docs, labels, 10)
    monkeypatch.setattr(quality_fm, "TRAIN_FEATURES", 40)
    quality_fm.train(docs, labels, 10)
    assert seen[0] == 10 and 0 < seen[1] < 10


def test_leaks_leave_other_columns_alone(spark):
    docs = spark.createDataFrame([(1, "a b c", "mine", "also")], "doc_id long, text string, leaks_of_block string, _leaks_of_block string")
    items = spark.createDataFrame([(1, "x y z")], "item_id long, text string")
    found = decontaminate.with_leaks(docs, items)
    assert found.columns == [*docs.columns, "leaks"] and tuple(found.first())[2:] == ("mine", "also", [])


def test_leaks(spark, docs, none):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(2000)]
    items = [(k, " ".join(rng.sample(words, rng.randint(5, 60)))) for k in range(30)] + [(91, None), (92, ""), (None, " ".join(words[:20]))]
    rows, wanted = [(0, None), (1, "")], set()
    for i in range(2, 300):
        text = rng.choices(words, k=rng.randint(0, 120))
        if i % 2:
            k, item = rng.choice(items[:30])
            w = item.split()
            for _ in range(rng.randint(0, decontaminate.most_edits(len(w)))):
                at = rng.randrange(len(w))
                w[at : at + 1] = rng.choice([[], [rng.choice(words)], [w[at], rng.choice(words)]])
            text[rng.randint(0, len(text)) : 0] = w
            wanted.add((i, k))
        rows.append((i, " ".join(text).upper()))
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert len(found & wanted) >= 0.97 * len(wanted) and not found - wanted
    assert decontaminate.leaks(none, bench).count() == 0 and decontaminate.leaks(docs, bench.where("item_id < 0")).count() == 0


def test_leaks_against_all_windows_and_items():
    """Items of every length from one word on, edits within and beyond the bound, edges of texts, shared runs; against the edit distance of
    each item and text."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(700)]
    common = words[:6]
    items = [" ".join(rng.choices(words, k=n)) for n in [*range(1, 13), *range(13, 60, 3)] for _ in range(3)] + [" ".join([*common, *rng.choices(words, k=9)]) for _ in range(20)]
    block = decontaminate.Items(list(range(len(items))), items)
    texts = ["", "w1", " ".join(common)]
    for i in range(400):
        w = list(rng.choice(items).split())
        for _ in range(rng.randint(0, len(w) // 4 + 1)):
            at = rng.randrange(len(w) or 1)
            w[at : at + 1] = rng.choice([[], [rng.choice(words)], [*w[at : at + 1], rng.choice(words)]])
        texts.append(" ".join(rng.choices(words, k=rng.choice([0, 0, 3, 40])) + w + rng.choices(words, k=rng.choice([0, 0, 3, 40]))))
    found = {(d, x["item_id"], x["distance"]) for d, leaks in enumerate(block.leaks(texts)) for x in leaks}
    wanted = set()
    for d, t in enumerate(texts):
        seq = np.array([block.vocab.get(x, 0) for x in decontaminate.words_of(t)], np.int64)
        for k, item in enumerate(block.words):
            best = decontaminate.semi_global(item, seq)
            if best <= len(item) // 5 and best < len(item):
                wanted.add((d, k, best))
    assert found <= wanted and len(found) >= 0.97 * len(wanted) > 300
    short = {x for x in wanted if len(block.words[x[1]]) <= 12}
    assert short <= found and {len(block.words[k]) for _, k, _ in short} == set(range(1, 13))
    one = decontaminate.Items([1, 2], ["alpha beta gamma delta epsilon", "\u6771\u4eac\u90fd\u5e81"])
    got = one.leaks(["x alpha beta CHANGED delta epsilon", "alpha beta gamma, more delta epsilon!", "\u3053\u308c\u306f\u6771\u4eac\u90fd\u5e81\u3067\u3059", "alpha beta"])
    assert [[x["item_id"] for x in g] for g in got] == [[1], [1], [2], []]


def test_long_items_are_found_at_the_edit_bound():
    rng = random.Random(6)
    words = [f"w{i}" for i in range(3000)]
    for n in (51, 60, 200, 400, 1000):
        items = [rng.choices(words, k=n) for _ in range(6)]
        block = decontaminate.Items(list(range(6)), [" ".join(w) for w in items])
        texts, wanted = [], []
        for i in range(24):
            w = list(items[i % 6])
            for at in sorted(rng.sample(range(n), n // 5), reverse=True):
                w[at : at + 1] = rng.choice([[], [rng.choice(words)], [w[at], rng.choice(words)]])
            texts.append(" ".join(rng.choices(words, k=rng.randint(0, 300)) + w + rng.choices(words, k=rng.randint(0, 300))))
            wanted.append((i, i % 6))
        found = [(i, x["item_id"]) for i, leaks in enumerate(block.leaks(texts)) for x in leaks]
        assert set(found) <= set(wanted) and len(found) >= 0.99 * len(wanted), (n, len(found))


def test_edit_distance():
    def plain(item, words):
        row = [0] * (len(words) + 1)
        for i, a in enumerate(item):
            new = [i + 1]
            for j, b in enumerate(words):
                new.append(min(row[j] + (a != b), row[j + 1] + 1, new[j] + 1))
            row = new
        return min(row)

    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = rng.integers(1, 6, rng.integers(1, 9)), rng.integers(0, 6, rng.integers(0, 14))
        assert decontaminate.semi_global(a, b) == plain(a.tolist(), b.tolist())


def test_cross_entropy_difference(spark, docs, none):
    rng = random.Random(4)
    near, far = ["river", "stone", "water"], ["stock", "price", "share"]
    rows = [(i, " ".join(rng.choices(near if i % 2 else far, k=30))) for i in range(100)] + [(100, None), (101, " ")]
    targets = spark.createDataFrame([(i,) for i in range(1, 50, 2)], "doc_id long")
    found = {r.doc_id: r for r in lm_scoring.cross_entropy_difference(spark.createDataFrame(rows, "doc_id long, text string"), targets).collect()}
    assert max(found[i].difference for i in range(51, 100, 2)) < min(found[i].difference for i in range(0, 100, 2))
    assert (found[100].n_tokens, found[100].difference) == (0, None)
    assert lm_scoring.cross_entropy_difference(none, targets).count() == 0
    assert lm_scoring.cross_entropy_difference(docs, targets.limit(0)).count() == len(ODD) * 2


@pytest.mark.parametrize("direct", [1024, 1])
def test_cross_entropy_difference_counts_every_word_and_pair(spark, monkeypatch, direct):
    """Asked directly and through relays.  More words than any fixed vocabulary, hot, rare and repeated pairs, and many blocks and buckets, against plain counting."""
    monkeypatch.setattr(lm_scoring, "BLOCK_BYTES", 70_000)
    monkeypatch.setattr(lm_scoring, "BUCKET_BYTES", 150_000 if direct > 1 else 60_000)
    monkeypatch.setattr(lm_scoring, "DIRECT", direct)
    rng = random.Random(8)
    texts = [" ".join(["The"] * rng.randint(0, 3) + [f"w{int(60_000 * rng.random() ** 2)}" for _ in range(rng.randint(0, 60))] + ["the end"] * rng.randint(0, 2)) for _ in range(2600)] + [None, "", "x", "x"]
    rows = [(None if i % 97 == 0 else i // 2 if i % 50 == 1 else i, t) for i, t in enumerate(texts)]
    if direct == 1:
        rows += 40 * [rows[14]] + 3 * [rows[97]] + 25 * [rows[15]] + 2 * [(7000, "")]
    marked = {i for i in range(0, 2600, 7)}
    words, pairs, total, vocabulary = ({}, {}), ({}, {}), [0, 0], set()
    for i, t in rows:
        w = (t or "").lower().split()
        vocabulary |= set(w)
        for k in [0, 1] if i in marked else [0]:
            total[k] += len(w)
            for h, x in zip(["", *w], w, strict=False):
                pairs[k][h, x] = pairs[k].get((h, x), 0) + 1
                words[k][x] = words[k].get(x, 0) + 1
            words[k][""] = words[k].get("", 0) + bool(w)
    wanted = []
    for i, t in rows:
        w = (t or "").lower().split()
        loss = [0.0, 0.0]
        own_pairs, own_words = Counter(zip(["", *w], w, strict=False)), Counter(["", *w])
        for k in (0, 1):
            off = k == 0 or i in marked
            for h, x in zip(["", *w], w, strict=False):
                uni = (words[k].get(x, 0) - off * own_words[x] + 0.5) / (total[k] - off * len(w) + 0.5 * len(vocabulary))
                before = words[k].get(h, 0) - off * own_words[h]
                loss[k] -= np.log(0.6 * (pairs[k].get((h, x), 0) - off * own_pairs[h, x]) / before + 0.4 * uni if before else uni) / len(w)
        wanted.append((-1 if i is None else i, len(w), round(loss[1], 7), round(loss[0], 7)) if w else (-1 if i is None else i, 0, 99.0, 99.0))
    assert len(vocabulary) > 32_768
    targets = spark.createDataFrame([(i,) for i in marked], "doc_id long")
    found = lm_scoring.cross_entropy_difference(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), targets).fillna({"doc_id": -1, "target_loss": 99.0, "background_loss": 99.0}).collect()
    found = sorted((r.doc_id, r.n_tokens, r.target_loss, r.background_loss) for r in found)
    assert np.allclose(np.array(found), np.array(sorted(wanted)), atol=1e-6)


def test_warc(spark):
    rows = [(5, "http://a/", "<p>é</p>"), (2, "http://b/\nX", "<p>é</p>"), (9, None, None), (7, "http://c/", ""), (8, "http://d/", "y" * 70000), (None, "http://e/", "<p>é</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r.page_id: r for r in warc.round_trip(pages).collect()}
    assert {k: (r.record_type, r.refers_to) for k, r in found.items()} == {5: ("revisit", 2), 2: ("response", None), 9: ("revisit", 7), 7: ("response", None), 8: ("response", None), None: ("revisit", 2)}
    for r in found.values():
        html = next(h or "" for p, _, h in rows if p == r.page_id).encode()
        assert (r.payload_bytes, r.payload_digest) == (len(html), base64.b32encode(hashlib.sha1(html).digest()).decode())
    assert warc.round_trip(pages.limit(0)).count() == 0
    small = {r.page_id: r.record_type for r in warc.round_trip(pages, min_revisit_bytes=5).collect()}
    assert small[9] == "response" and small[5] == "revisit"


def hand_made(n):
    """Records as other tools write them."""
    out = ["WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:0>\r\nContent-Type: application/warc-fields\r\nContent-Length: 12\r\n\r\nsoftware: x\n\r\n\r\n".encode()]
    for i in range(n):
        body = f"<p>{i} WARC/1.0 \r\n\r\n é</p>".encode() * (1 + i % 40)
        http = b"HTTP/1.1 200 OK\r\nServer: a\r\n\r\n" + body
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        request = b"GET / HTTP/1.1\r\nHost: a\r\n\r\n"
        out.append(f"WARC/1.0\r\nwarc-type: request\r\nWARC-Record-ID: <urn:uuid:q{i}>\r\nContent-Type: application/http; msgtype=request\r\nContent-Length: {len(request)}\r\n\r\n".encode() + request + b"\r\n\r\n")
        out.append(
            f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: http://h/{i}\r\nWARC-Record-ID: <urn:uuid:{i + 1}>\r\nX-Long: a\r\n  b\r\nContent-Type: application/http; msgtype=response\r\nWARC-Payload-Digest: sha1:{digest}\r\nContent-Length: {len(http)}\r\n\r\n".encode()
            + http + b"\r\n\r\n"
        )
    return out


def test_warc_of_other_tools(spark, tmp_path):
    import gzip

    records = hand_made(60)
    for name, raw in {"a.warc": b"".join(records), "b.warc.gz": b"".join(map(gzip.compress, records)), "sub/c.warc.gz": gzip.compress(b"".join(records)), "notes.txt": b"no archive"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(raw)
    wanted = sorted((f"http://h/{i}", f"<p>{i} WARC/1.0 \r\n\r\n é</p>".encode() * (1 + i % 40)) for i in range(60))
    for path in (tmp_path / "a.warc", tmp_path / "b.warc.gz", tmp_path / "sub" / "c.warc.gz", f"file://{tmp_path}/b*.gz", f"{tmp_path}/sub/?.warc.gz"):
        rows = warc.read(spark, str(path), verify=True).where("record_type = 'response'").collect()
        assert sorted((r.target_uri, bytes(r.payload)) for r in rows) == wanted
        assert all(r.payload_bytes == len(r.payload) and r.page_id is None for r in rows)
    everything = warc.read(spark, str(tmp_path), payload=False)
    assert {r.record_type: r["count"] for r in everything.groupBy("record_type").count().collect()} == {"warcinfo": 3, "request": 180, "response": 180}
    assert everything.where("record_id = '<urn:uuid:q7>'").count() == 3
    split = spark.read.format(warc.NAME).option("path", str(tmp_path / "b.warc.gz")).option("split_bytes", 3000).load()
    assert split.rdd.getNumPartitions() > 4 and sorted((r.target_uri, bytes(r.payload)) for r in split.where("record_type = 'response'").collect()) == wanted
    (tmp_path / "bad.warc").write_bytes(b"".join(records).replace(b"<p>7 ", b"<p>8 "))
    with pytest.raises(Exception, match="damaged"):
        warc.read(spark, str(tmp_path / "bad.warc"), verify=True).collect()


def test_warc_revisits_name_their_response(spark):
    pages = spark.createDataFrame([(5, "http://a/", "x" * 9), (2, "http://b/", "x" * 9), (None, "http://c/", "x" * 9)], "page_id long, url string, html string")
    out = fresh_path(spark, "named")
    warc.write(pages, out)
    rows = {r.target_uri: r for r in warc.read(spark, out).collect()}
    assert rows["http://a/"].refers_to_id == rows["http://c/"].refers_to_id == rows["http://b/"].record_id and rows["http://b/"].refers_to_id is None


def test_warc_pushes_filters_down(spark):
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<p>{i % 7}</p>") for i in range(50)], "page_id long, url string, html string")
    out = fresh_path(spark, "pushed")
    warc.write(pages, out)
    rows = warc.read(spark, out).where((F.col("record_type") == "response") & (F.col("page_id") > 3))
    assert sorted((r.page_id, bytes(r.payload)) for r in rows.collect()) == [(i, f"<p>{i}</p>".encode()) for i in (4, 5, 6)]
    reader = warc.WarcReader({"path": out})
    from pyspark.sql.datasource import EqualTo, IsNull

    assert len(list(reader.pushFilters([EqualTo(("record_type",), "revisit"), IsNull(("target_uri",))]))) == 1
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 43


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    out = corpus_pipeline.run(spark, d)
    rows = out.collect()
    assert 20 < len(rows) and len({r.doc_id for r in rows}) == len(rows)
    docs = spark.read.parquet(f"{d}/documents.parquet").withColumns({"kept": F.lit("x"), "leaks": F.lit(1), "score": F.lit(2)})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, d)
        assert after.columns == docs.columns and after.schema == docs.schema
        assert stage(spark, docs.limit(0), d).count() == 0


def test_near_duplicates_of_rows_without_id(spark):
    import corpus_pipeline

    text = " ".join(f"w{i}" for i in range(60))
    rows = [(None, text, 1), (9, text + " x", 2), (None, text, 3), (4, "other words here", 4), (4, "other words here", 5), (None, None, 6), (7, "", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, k int")
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    found = sorted(r.k for r in kept.collect())
    assert found in ([2, 4, 6, 7], [2, 5, 6, 7])


def test_stages_return_what_came_whatever_its_names(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(4)
    names = ["_rules_kept", "_quality_score", "_leaks", "_row"]
    rows = [(i, " ".join(f"w{rng.randrange(500)}" for _ in range(60)), *[f"{n}{i}" for n in names]) for i in range(40)]
    rows += [(7, *rows[3][1:])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    spark.createDataFrame([(i, 1) for i in range(40)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "no such words here at all")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        found = {tuple(r) for r in out.collect()}
        assert found and found <= set(rows), name
