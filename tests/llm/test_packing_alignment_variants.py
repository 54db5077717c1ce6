"""Packing, alignment and spelling variants against brute force."""

import functools
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tankline.llm import alignment, packing, variants
from tankline.llm.vocab import Vocabulary

JSON, MODEL = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
ODD = [None, "", " ", "\n\t ", "a", "a  b \n c", "it's 12.5 <|endoftext|> ok <s> </s> <0x41>", "x" * 5000, "é 字 🙂 ²½ \x1c\x85　z", ("lorem ipsum dolor " * 900).strip(), "of.\nThen, so.", "a▁b c", "ends in a space ", " two"]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdeéñ", k=rng.randint(1, 9))) for _ in range(300)]
    more = [" ".join(rng.choices(words, k=rng.randint(1, 1200))) for _ in range(60)]
    rows = [(i, t, i, "n", 1.5) for i, t in enumerate(ODD + more)] + [(None, "no id", 0, "n", 0.0), (3, "twice", 0, "n", 0.0), (3, "twice", 0, "n", 0.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, sequence_id long, links string, n double").repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")


@pytest.mark.parametrize("n", [1, 2, 31, 63, 64, 65, 500, 682, 683, 700, 1023, 1024, 1025, 1500, 2047, 2048, 2049, 100_000])
def test_cut_keeps_all_and_wastes_little(n):
    pieces = packing.cut(n)
    assert sum(pieces) == n and all(0 < x <= 2048 for x in pieces)
    assert all(2048 - 2048 // x * x <= 32 for x in pieces if x > 64)
    assert len(pieces) - n // 2048 <= 5


def test_best_fit():
    bins, offsets = packing.best_fit([1500, 1000, 900, 500, 100, 48], 2048)
    assert bins == [0, 1, 1, 0, 1, 0] and offsets == [0, 0, 1000, 1500, 1900, 2000]


@pytest.mark.parametrize("capacity", [2048, 64])
def test_packing_places_every_id_once(docs, none, capacity):
    library = Tokenizer.from_file(JSON)
    wanted = Counter()
    for r in docs.collect():
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 1]
        wanted[r.doc_id, np.array(ids, "<u4").tobytes()] += 1
    packed = packing.pack(docs, JSON, 1, capacity)
    rows, checked = packed.collect(), {(r.doc_id, r.start, r.sequence_id, r.offset): r for r in packing.digests(packed).collect()}
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        assert len(r.ids) == 4 * r.length and checked[r.doc_id, r.start, r.sequence_id, r.offset].ids_crc32 == zlib.crc32(r.ids)
        by_sequence[r.sequence_id].append((r.offset, r.length, bytes(r.ids)))
        by_doc[r.doc_id, r.doc_tokens].append((r.start, bytes(r.ids)))
    for own in by_sequence.values():
        at = 0
        for offset, length, _ in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    # a document's pieces lie one after the other; equal (id, length) documents here are equal
    found = Counter()
    for (i, total), own in by_doc.items():
        copies = sum(1 for s, _ in own if s == 0)
        starts = sorted(set(own))
        assert len(own) == copies * len(starts)
        ids = b"".join(x for _, x in starts)
        assert len(ids) == 4 * total
        found[i, ids] += copies
    assert found == wanted
    if capacity == 2048:
        lengths = [sum(x for _, x, _ in own) for own in by_sequence.values()]
        assert sum(0 if n & (n - 1) == 0 else capacity - n for n in lengths) < 0.03 * sum(lengths) + capacity
    whole = {r.sequence_id: r for r in packing.sequences(packed, 7, capacity).collect()}
    for s, own in by_sequence.items():
        ids = b"".join(x for _, _, x in sorted(own))
        n = len(ids) // 4
        pad = 0 if n & (n - 1) == 0 else capacity - n
        assert (whole[s].n_tokens, bytes(whole[s].ids)) == (n, ids + np.full(pad, 7, "<u4").tobytes())
    assert packing.digests(packing.pack(none, JSON)).count() == 0


def test_crossings_divide_the_work_and_part_no_equal_ends():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = (np.unique(rng.integers(1, 400, rng.integers(0, 200))) for _ in range(2))
        points = alignment.crossings(a, b, 16) if len(a) and len(b) else []
        for (i, j), (k, m) in zip(points, points[1:], strict=False):
            assert 0 <= (k - i) + (m - j) <= 17 and k >= i and m >= j
            assert not set(a[:k]) & set(b[m:]) and not set(a[k:]) & set(b[:m])
            assert k == 0 or m == len(b) or a[k - 1] <= b[m]
        hits = alignment.common_ends(a, b, 16) if len(a) and len(b) else np.zeros((2, 0), int)
        assert a[hits[0]].tolist() == b[hits[1]].tolist() == sorted(set(a.tolist()) & set(b.tolist()))


@functools.cache
def libraries():
    a = Tokenizer.from_file(JSON)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=MODEL)


def plain_alignment(text):
    """Groups of (A ids, B ids) and the linked pairs of one text."""
    a_lib, b_lib = libraries()
    if not text:
        return [], []
    byte = alignment.byte_alphabet()
    a = [(i, bytes(byte[c] for c in a_lib.id_to_token(i))) for i in a_lib.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, bytes([int(p[3:5], 16)]) if b_lib.is_byte(i) else p.replace("▁", " ").encode()) for i in b_lib.encode(text) for p in [b_lib.id_to_piece(i)]]
    if not b"".join(x for _, x in a) == b"".join(x for _, x in b) == (" " + text).encode():
        return [], []
    ends = [{}, {}]
    for side, own in enumerate((a, b)):
        at = 0
        for i, x in own:
            at += len(x)
            ends[side][at] = i
    both = sorted(set(ends[0]) & set(ends[1]))
    groups, before = [], 0
    for e in both:
        groups.append(tuple([i for x, i in own.items() if before < x <= e] for own in ends))
        before = e
    return groups, [(ends[0][e], ends[1][e]) for e in both]


def test_alignment_is_what_plain_sets_give(docs, none):
    rows = docs.collect()
    plain = [plain_alignment(r.text) for r in rows]
    counts = Counter(p for _, links in plain for p in links)
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    wanted = []
    for r, (groups, links) in zip(rows, plain, strict=True):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        wanted.append((str(r.doc_id), sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links), sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    found = alignment.align(docs, JSON, MODEL, spans=True).collect()
    assert sorted((str(r.doc_id), *r[1:8]) for r in found) == sorted(wanted)
    assert all((sum(r.group_a), sum(r.group_b), len(r.group_a)) == (r.n_a, r.n_b, r.n_groups) for r in found)
    assert any(r.n_a == 0 and (r.doc_id or 0) == 11 for r in found)  # a mark of a space in the text is read as one
    assert alignment.align(none, JSON, MODEL).count() == 0


def test_pieces_of_any_size_give_the_same_groups():
    work = alignment.Aligner(Vocabulary(JSON), Vocabulary(MODEL))
    text = "some words, anotherwordhere and naïve façades " * 40
    a, b = (np.frombuffer(side([" " + text.strip()])[0], "<u4") for side in (work.a, work.b))
    ends = [np.cumsum(side.sizes[x]) for side, x in ((work.a, a), (work.b, b))]
    whole = alignment.common_ends(*ends, 10**9)
    assert all((alignment.common_ends(*ends, w) == whole).all() for w in (1, 2, 3, 7, 100))


def edits(word, alphabet):
    for i in range(len(word) + 1):
        yield from (word[:i] + c + word[i:] for c in alphabet)
        if i < len(word):
            yield word[:i] + word[i + 1 :]
            yield from (word[:i] + c + word[i + 1 :] for c in alphabet)


def plain_variants(rows):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    n = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}
    alphabet = sorted({c for w in n for c in w})
    out, form = {}, {}
    for w in n:
        near = {x for x in edits(w, alphabet) if x != w and x in n}
        best = min(near, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
        out[w] = len(near)
    found = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        found.append((w, form[w], root, n[w], out[w], n[form[w]] if form[w] else None))
    return sorted(found)


@pytest.mark.parametrize("tile", [512, 4])
def test_variants_are_what_edits_give(spark, none, tile):
    rng = random.Random(9)
    base = ["".join(rng.choices("abcÀé×", k=rng.randint(7, 12))) for _ in range(60)] + ["a" * k for k in range(7, 13)] + ["q" * 3000, "q" * 2999 + "r"]
    for w in base[:20] * 3:
        base.append("".join(rng.choices("ab", k=8)) if rng.random() < 0.2 else rng.choice([x for x in edits(w, "abÀ") if x]))
    often = {w: rng.choice([1, 2, 3, 25, 300]) for w in set(base)}
    pool = [w for w, k in often.items() for _ in range(k if len(w) < 100 else 2)]
    rng.shuffle(pool)
    rows = [(i, ", ".join(w.upper() if rng.random() < 0.1 and w.isascii() else w for w in pool[i * 40 : i * 40 + 40])) for i in range(-(-len(pool) // 40))]
    rows += [(None, pool[0] + " " + pool[1]), (0, None), (1, ""), (5, " 12 - short"), (7, rows[0][1]), (7, rows[0][1])]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n long, form string").repartition(3)
    found = variants.variants(docs, tile=tile).collect()
    assert sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in found) == plain_variants(rows)
    assert any(r.form for r in found) and any(r.n_near > 4 for r in found)
    assert variants.variants(none).count() == 0


def test_blocks_of_any_size_give_each_pair_once(spark, monkeypatch):
    words = spark.createDataFrame([("abcdefg" + a + b, 2) for a in "abcdefghijklmnop" for b in "abcdefghijklmnop"], "word string, n long")
    grouped = variants.groups(words, 40)
    assert grouped.groupBy("tag").count().agg({"count": "max"}).first()[0] <= 40
    pairs = [(r.word, r.other) for r in variants.near_pairs(grouped).collect()]
    assert len(pairs) == len(set(pairs)) == 256 * 30
