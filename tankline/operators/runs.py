"""Arrow batches of rows that are sorted by keys, taken key by key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def key_runs(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Places at which a run of equal keys begins; rows are sorted by them and no key is null."""
    new = np.zeros(max(0, len(table) - 1), bool)
    for k in keys:
        column = table[k].combine_chunks()
        new |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
    return np.concatenate((np.zeros(min(1, len(table)), np.int64), np.flatnonzero(new) + 1))


def whole_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows again, cut so that no key lies in two tables."""
    held: list[pa.RecordBatch] = []  # rows of a key that may go on
    for batch in batches:
        if not len(batch):
            continue
        if held and len(key_runs(pa.Table.from_batches([held[-1].slice(len(held[-1]) - 1), batch.slice(0, 1)]), keys)) > 1:
            yield pa.Table.from_batches(held)
            held = []
        cut = int(key_runs(pa.Table.from_batches([batch]), keys)[-1])
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def whole_keys(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of one key at a time."""
    for table in whole_runs(batches, keys):
        starts = key_runs(table, keys)
        for begin, end in zip(starts.tolist(), [*starts[1:].tolist(), len(table)], strict=True):
            yield table.slice(begin, end - begin)
