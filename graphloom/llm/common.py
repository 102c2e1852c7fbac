"""Small helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import gc
import itertools
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Word split on the ASCII white space that the contracts name; bytes.split() cuts at just these bytes.
WORD = r"[^\x20\x09-\x0D]+"


def fold(id_col: str, n: int) -> Column:
    """``crc32(id as text) mod n``; null for a null id."""
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(n))


def texts(column: pa.Array, rows: int = 256) -> Iterator[bytes]:
    """UTF-8 bytes of a string column, null as empty; a few rows of a batch are held at a time."""
    for i in range(0, len(column), rows):
        yield from (x or b"" for x in column.slice(i, rows).cast(pa.binary()).to_pylist())


def strings(column: pa.Array, rows: int = 256) -> Iterator[str | None]:
    """A string column's values; a few rows of a batch are held at a time."""
    for i in range(0, len(column), rows):
        yield from column.slice(i, rows).to_pylist()


def append_columns(
    df: DataFrame,
    inputs: list[str],
    outputs: str,
    make: Callable[[], Callable[..., list]],
) -> DataFrame:
    """Add columns computed in Arrow batches.

    ``outputs`` is a DDL string.  Input columns of the same name (without regard to case) are
    replaced; all others pass through.  ``make`` is called once per task and returns a function
    from the input arrays to one list per output.  Only ``inputs`` go to the Python worker and only
    the new columns come back; the other columns wait in the JVM, in a queue that spills.
    """
    added = T.StructType.fromDDL(outputs)
    new = {f.name.lower() for f in added}
    if clash := [c for c in inputs if c.lower() in new]:
        raise ValueError(f"input columns {clash} are also outputs")
    slim = [c for c in df.columns if c.lower() not in new]
    kind = pa.struct([pa.field(f.name, _arrow(f.dataType)) for f in added])

    def run(batches: Iterator) -> Iterator[pa.Array]:
        compute = make()
        try:
            for batch in batches:
                columns = [batch] if isinstance(batch, pa.Array) else list(batch)
                rows = len(columns[0])
                got = compute(*columns) if rows else [[]] * len(kind)
                del batch, columns
                out = pa.StructArray.from_arrays([pa.array(x, type=f.type) for x, f in zip(got, kind, strict=True)], fields=list(kind))
                del got
                yield out
                del out
        finally:
            del compute
            release_memory()

    # the hints choose the iterator form; without determinism no filter on the result runs it twice
    run.__annotations__ = {"batches": Iterator[pa.Array] if len(inputs) == 1 else Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
    call = F.arrow_udf(run, added).asNondeterministic()
    result = free_name(df, "_added")
    rows = df.select(*[F.col(f"`{c}`") for c in slim], call(*[F.col(f"`{c}`") for c in inputs]).alias(result))
    return rows.select(*[F.col(f"`{c}`") for c in slim], *[F.col(f"{result}.`{f.name}`").alias(f.name) for f in added])


def apart(columns: list[str]) -> dict[str, str]:
    """A name for each column that no operator uses for its own columns."""
    return {c: f"_c{i}" for i, c in enumerate(columns)}


def free_name(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def release_memory() -> None:
    """Give freed memory back to the system: workers stay alive between tasks and stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def _arrow(kind: T.DataType) -> pa.DataType:
    simple = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary()}
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow(kind.elementType))
    if isinstance(kind, T.StructType):
        return pa.struct([pa.field(f.name, _arrow(f.dataType)) for f in kind])
    return simple[kind.simpleString()]


def emit(df: DataFrame, columns: list[str], schema: str, make: Callable[[], Callable[..., Iterable[dict]]], flush: Callable[[], None] | None = None) -> DataFrame:
    """Map Arrow batches of ``columns`` to other rows: ``make()`` gives a function from the arrays,
    or from nothing at the end of the task, to dicts of columns."""
    out = T.StructType.fromDDL(schema)
    kind = pa.schema([pa.field(f.name, _arrow(f.dataType)) for f in out])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for args in itertools.chain((b.columns for b in batches if b.num_rows), [()]):
            for got in step(*args):
                yield pa.RecordBatch.from_arrays([pa.array(got[f.name], type=f.type) for f in kind], schema=kind)
                del got
        del step
        release_memory()

    return df.select(*[F.col(f"`{c}`") for c in columns]).mapInArrow(run, out)
