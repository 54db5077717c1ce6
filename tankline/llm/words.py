"""Words of many texts at once: split and numbered by Arrow, so that Python sees each distinct word of a slice once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def numbered(texts: list[str], split: Callable[[pa.Array], pa.Array]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct parts of all texts, the number of each part among them in order, and the offsets of the texts' parts."""
    try:
        column = pa.array(texts, pa.large_string())
    except UnicodeEncodeError:  # lone surrogates, which no column of Spark holds
        column = pa.array([t.encode("utf-8", "replace").decode() for t in texts], pa.large_string())
    lists = split(column)
    coded = lists.flatten().dictionary_encode()
    return coded.dictionary, np.asarray(coded.indices), np.concatenate(([0], np.cumsum(np.asarray(lists.value_lengths()))))


def hashed(texts: list[str], make: Callable[[bytes], int], lower: Callable[[pa.Array], pa.Array] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words between ASCII white space of all texts one after the other, and the offsets of the texts."""
    words, numbers, offsets = numbered(texts, lambda a: pc.ascii_split_whitespace(lower(a) if lower else a))
    distinct = words.cast(pa.large_binary()).to_pylist()
    hashes = np.fromiter(map(make, distinct), np.uint64, len(distinct))[numbers] if distinct else np.zeros(0, np.uint64)
    full = np.fromiter(map(bool, distinct), bool, len(distinct))[numbers] if distinct else np.zeros(0, bool)
    if full.all():
        return hashes, offsets
    # white space at the ends of a text leaves empty parts
    return hashes[full], np.concatenate(([0], np.cumsum(full)))[offsets]
