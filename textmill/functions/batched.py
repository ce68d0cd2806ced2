"""Arrow-batched UDFs that need no session until they are used."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Rows of a batch that stand as Python values at a time; the rest of it, and what is made of it, are Arrow buffers.
AT_ONCE = 256


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _by_slices(kind: str, f: Callable, null_safe: bool) -> Callable:
    """A function of one or two Arrow arrays out of one of plain values, a slice of the rows at a time."""

    def column(*cols: Column | str) -> Column:
        out = to_arrow_type(T.DataType.fromDDL(kind))
        pairs = pa.types.is_map(out)

        def run(*args: pa.Array) -> pa.Array:
            parts = []
            for at in range(0, len(args[0]), AT_ONCE):
                rows = zip(*(a.slice(at, AT_ONCE).to_pylist() for a in args))
                made = [None if null_safe and row[0] is None else f(*row) for row in rows]
                parts.append(pa.array([m if m is None else list(m.items()) for m in made] if pairs else made, out))
            return pa.concat_arrays(parts) if parts else pa.array([], out)

        def one(a: pa.Array) -> pa.Array:
            return run(a)

        def two(a: pa.Array, b: pa.Array) -> pa.Array:
            return run(a, b)

        return F.arrow_udf(one if len(cols) == 1 else two, T.DataType.fromDDL(kind))(*[_col(c) for c in cols])

    column.__name__, column.__doc__ = f.__name__, f.__doc__
    return column


def per_value(kind: str, f: Callable) -> Callable[..., Column]:
    """Columns out of a function of plain values; a null first argument gives null."""
    return _by_slices(kind, f, True)


def per_record(kind: str, fields: list[str], f: Callable) -> Callable[..., Column]:
    """A struct column out of a function of plain values that returns a dictionary (or None: all fields null)."""

    def record(*values) -> dict:
        found = f(*values) or {}
        return {k: found.get(k) for k in fields}

    record.__name__, record.__doc__ = f.__name__, f.__doc__
    return _by_slices(kind, record, False)
