"""Arrow batches with their text as one flat byte buffer.

Row-wise operators run in ``mapInArrow``: the input columns pass through
unchanged and new columns are appended. A new column replaces an input column
of the same name (compared without case, as Spark resolves names), so clashing
names never make a batch ambiguous.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Text bytes handled at once inside a task; one longer document is a slice alone.
SLICE_BYTES = 4 << 20


def flat_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offs = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each row; a null counts as empty."""
    data, offs = flat_text(column)
    buf, at = data.tobytes(), offs.tolist()
    return [buf[a:b] for a, b in zip(at, at[1:])]


def slices(batch: pa.RecordBatch, text_col: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch cut into runs of rows whose text has at most ``limit`` bytes."""
    _, offs = flat_text(batch.column(text_col))
    start, n = 0, batch.num_rows
    while start < n:
        end = int(np.searchsorted(offs, offs[start] + limit, side="right")) - 1
        end = min(max(end, start + 1), n)
        yield batch.slice(start, end - start)
        start = end


def append_columns(
    df: DataFrame,
    text_col: str,
    fields: list[T.StructField],
    make: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]],
    limit: int = SLICE_BYTES,
) -> DataFrame:
    """Append ``fields`` to df; ``make()`` runs once a task and gives the function from a slice to the new arrays."""
    new = {f.name.lower() for f in fields}
    keep = [f for f in df.schema.fields if f.name.lower() not in new or f.name == text_col]
    if text_col.lower() in new:
        raise ValueError(f"{text_col} is an input and an output")
    schema = T.StructType([*keep, *fields])
    arrow_new = [x.type for x in to_arrow_schema(T.StructType(fields))]
    names = [f.name for f in keep]

    def run(batches):
        fn = make()
        for batch in batches:
            for part in slices(batch, text_col, limit):
                made = [a if isinstance(a, pa.Array) else pa.array(a) for a in fn(part)]
                made = [a.cast(t) if a.type != t else a for a, t in zip(made, arrow_new)]
                yield pa.RecordBatch.from_arrays([part.column(n) for n in names] + made, names=names + [f.name for f in fields])

    return df.select(*[f"`{n}`" for n in names]).mapInArrow(run, schema)
