"""Groups of rows out of a sorted stream of Arrow batches.

``repartition`` by key and ``sortWithinPartitions`` bring the rows of a key
together; one task then walks over many small groups without a per-group call
from the JVM. Only one group is held at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The maximal runs of equal ``keys`` (integers, not null), in order."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        cols = [table.column(k).to_numpy() for k in keys]
        cut = np.zeros(table.num_rows, dtype=bool)
        for c in cols:
            cut[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(cut).tolist(), table.num_rows]
        for i, (lo, hi) in enumerate(zip(starts, starts[1:])):
            key = tuple(c[lo] for c in cols)
            if i == 0 and held and key == last:
                held.append(table.slice(lo, hi - lo))
                continue
            if held:
                yield pa.concat_tables(held)
            held, last = [table.slice(lo, hi - lo)], key
    if held:
        yield pa.concat_tables(held)
