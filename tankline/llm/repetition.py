"""Quality rules: repeated substrings found with a suffix array (operator 8).

A document is a sequence of words.  The suffix array of a batch of documents is
built by prefix doubling over word numbers, where each document has numbers of
its own so that no repeat crosses documents.  Only suffixes that still
share their rank are sorted again.  Longest common prefixes of neighbours come
from the rank arrays of the doublings.  An LCP interval of at least ``min_words`` holds the occurrences of
a maximal repeated substring.  Intervals are nested, and the innermost one of a suffix has the
larger of its LCPs with both neighbours, so the span of that length covers those of all intervals around it: the union over all
suffixes is the union over all maximal repeats.  A document fails if it covers too much of it or if one repeat is too long.

Both limits can fire where the base rule (a fifth of the words in repeated five-word windows) does not, because they look at longer
repeats and at less of the document: repeats of ten words or more may cover a tenth of it, the limit that is published for
duplicate ten-word sequences (Rae et al. 2021), and one repeat may have fifty words or a fortieth of the document, whichever is more.  Two copies of a
passage of a fortieth to a twentieth of the document break only the second limit, several short ones only the first.

Each doubling keeps one array of 32-bit ranks of the batch: some 4 bytes a word and doubling, so that a text of a million words that
repeats itself throughout takes about 200 MB.

Defined results: null and empty texts have no words and fail the base rules;
repeated rows and ties are independent rows; very long texts form a batch of
their own; extra columns are kept by :func:`with_verdicts`, but for those with the name of a new one, which are replaced.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tankline.llm.common import WORD_PATTERN, append_columns

WORDS = re.compile(WORD_PATTERN)
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\v\f\r"
#: Base rules: fewest words, and most hundredths of words in repeated five-word windows.
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
#: The method's own limits: repeats of at least so many words count; a kept document has at most this fraction
#: covered, and no single repeat longer than this many words or, if that is more, this fraction of the document.
MIN_REPEAT, MAX_COVERED, MAX_LONGEST, MAX_LONGEST_SHARE = 10, 0.10, 50, 0.025

FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("word_chars", T.LongType()),
    T.StructField("n_symbols", T.LongType()),
    T.StructField("n_dup_lines", T.LongType()),
    T.StructField("n_repeat_words", T.LongType()),
    T.StructField("repeat_covered", T.DoubleType()),
    T.StructField("longest_repeat", T.LongType()),
    T.StructField("base_failed", T.BooleanType()),
    T.StructField("kept", T.BooleanType()),
]


class _Numbers(dict):
    """Numbers words in order of first sight."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


def _dense(keys: np.ndarray) -> np.ndarray:
    """Ranks of keys, equal for equal keys, in their order."""
    order = np.argsort(keys)
    s = keys[order]
    new = np.empty(len(s), np.int64)
    new[:1] = 0
    np.cumsum(s[1:] != s[:-1], out=new[1:])
    ranks = np.empty(len(s), np.int64)
    ranks[order] = new
    return ranks


def _shared(ranks: np.ndarray) -> np.ndarray:
    """True at positions whose rank occurs more than once."""
    return np.bincount(ranks, minlength=1)[ranks] > 1


def _covered(starts: np.ndarray, lengths: np.ndarray, total: int) -> np.ndarray:
    """True at positions inside any span."""
    edge = np.zeros(total + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths, -1)
    return np.cumsum(edge[:-1]) > 0


def repeats(seq: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """For each position of a number sequence: whether a five-word window that occurs twice covers it, and the
    length of the longest repeat of at least `min_words` that starts there (else 0)."""
    n = len(seq)
    levels: list[np.ndarray] = [_dense(seq).astype(np.int32)]
    step, live = 1, np.flatnonzero(_shared(levels[0]))
    window = np.zeros(n, bool)
    while len(live):
        prev = levels[-1]
        if step == 4:  # five-word windows: four words and the next one
            five = live[live + 4 < n]
            shared = _shared(_dense(prev[five].astype(np.int64) * (n + 1) + levels[0][five + 4])) if len(five) else np.zeros(0, bool)
            window = _covered(five[shared], np.full(int(shared.sum()), WINDOW), n) if shared.any() else window
        # A suffix whose rank is unique keeps it: ranks are spread so that a refined group stays inside its gap.
        follow = np.where(live + step < n, prev[np.minimum(live + step, n - 1)] + 1, 0)
        order = np.lexsort((follow, prev[live]))
        a, b, p = prev[live][order], follow[order], live[order]
        head = np.ones(len(p), bool)
        head[1:] = a[1:] != a[:-1]
        differs = head.copy()
        differs[1:] |= b[1:] != b[:-1]
        at = np.arange(len(p))
        group_at = np.maximum.accumulate(np.where(head, at, 0))
        sub_at = np.maximum.accumulate(np.where(differs, at, 0))
        if not levels[1:]:  # first ranks are dense; make room between groups once
            sizes = np.bincount(prev)
            base = np.cumsum(sizes) - sizes
            levels[0] = prev = base[prev].astype(np.int32)
            a = prev[p]
            follow = np.where(p + step < n, prev[np.minimum(p + step, n - 1)] + 1, 0)
        nxt = prev.copy()
        nxt[p] = a + (sub_at - group_at)
        levels.append(nxt)
        step *= 2
        last = np.ones(len(p), bool)
        last[:-1] = differs[1:]
        alone = differs & last
        live = np.sort(p[~alone])
    # Neighbours in suffix order: the final ranks are a permutation.
    final = levels[-1]
    if len(levels) == 1:
        return window, np.zeros(n, np.int64)
    sa = np.empty(n, np.int64)
    sa[final] = np.arange(n)
    i, j = sa[:-1], sa[1:]
    near = np.flatnonzero(levels[0][i] == levels[0][j])
    x, y = i[near].copy(), j[near].copy()
    common = np.zeros(len(near), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        ok = (x < n) & (y < n)
        same = np.zeros(len(x), bool)
        same[ok] = levels[k][x[ok]] == levels[k][y[ok]]
        gain = same.astype(np.int64) << k
        x += gain
        y += gain
        common += gain
    lcp = np.zeros(n, np.int64)
    lcp[near + 1] = common
    longest = np.zeros(n, np.int64)
    longest[sa] = np.maximum(lcp, np.append(lcp[1:], 0))
    longest[longest < min_words] = 0
    return window, longest


def measure(texts: list[str], min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST) -> list:
    """The columns of FIELDS for a list of texts."""
    numbers = _Numbers()
    counts, chars, symbols, dup_lines, parts = [], [], [], [], []
    for text in texts:
        words = WORDS.findall(text)
        counts.append(len(words))
        chars.append(sum(map(len, words)))
        symbols.append(sum(map(text.count, SYMBOLS)))
        lines = [x for x in text.split("\n") if x.strip(BLANKS)]
        dup_lines.append(len(lines) - len(set(lines)))
        parts.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
    n_words = np.array(counts, np.int64)
    # each document has numbers of its own, so nothing repeats across documents
    seq = np.empty(int(n_words.sum()) + len(texts), np.int64)
    begin = np.concatenate(([0], np.cumsum(n_words + 1)[:-1])) if len(texts) else np.zeros(0, np.int64)
    for k, (b, p) in enumerate(zip(begin, parts, strict=True)):
        seq[b : b + len(p)] = p + k * (len(numbers) + 1)
        seq[b + len(p)] = len(numbers) + k * (len(numbers) + 1)
    window, longest = repeats(seq, min_repeat) if len(seq) else (np.zeros(0, bool), np.zeros(0, np.int64))
    hit = np.flatnonzero(longest)
    spans = _covered(hit, longest[hit], len(seq)) if len(hit) else np.zeros(len(seq), bool)
    if len(texts):
        n_repeat = np.add.reduceat(window.astype(np.int64), begin)
        n_covered = np.add.reduceat(spans.astype(np.int64), begin)
        most = np.maximum.reduceat(longest, begin)
    else:
        n_repeat = n_covered = most = np.zeros(0, np.int64)
    covered = n_covered / np.maximum(n_words, 1)
    failed = (n_words < MIN_WORDS) | (100 * n_repeat > MAX_REPEAT_PERCENT * n_words)
    kept = ~failed & (covered <= max_covered) & (most <= np.maximum(max_longest, MAX_LONGEST_SHARE * n_words))
    return [n_words, chars, symbols, dup_lines, n_repeat, covered, most, failed, kept]


def with_verdicts(docs: DataFrame, min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST, prefix: str = "") -> DataFrame:
    """All columns of `docs` and those of FIELDS under `prefix`; one narrow pass, no shuffle."""
    fields = [T.StructField(prefix + f.name, f.dataType) for f in FIELDS]
    return append_columns(docs, lambda: lambda texts: measure(texts, min_repeat, max_covered, max_longest), fields)


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id and the columns of FIELDS for every document."""
    return with_verdicts(docs.select("doc_id", F.col("text").cast("string").alias("text"))).drop("text")
