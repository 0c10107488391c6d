"""Sequential decisions by key: one pass over a key's rows in order, where each decision depends on those before.

The rows are shuffled by key and sorted within partitions by Spark, which spills; a task then reads them as a stream of
Arrow batches and carries one state at a time from batch to batch. Memory is a batch and one key's state, never a key's rows.
A key's rows are one task's work, as each needs the state that the row before left.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: step(state, row) -> what the row adds; row is a dict of the columns that were asked for.
Step = Callable[[Any, dict], Iterable[tuple]]


def _keyed(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    return rows.repartition(*key).sortWithinPartitions(*key, *order)


def _values(array: pa.Array) -> list:
    """What to_pylist() gives, several times as fast for lists of structures: their fields are read as columns."""
    kind, n = array.type, len(array)
    if n and array.null_count == n:
        return [None] * n
    if pa.types.is_struct(kind) and kind.num_fields:
        names = [kind.field(i).name for i in range(kind.num_fields)]
        out = [dict(zip(names, v)) for v in zip(*[_values(array.field(i)) for i in range(kind.num_fields)])]  # noqa: B905
    elif pa.types.is_list(kind):
        inner, at, out = _values(array.flatten()), 0, []
        for size in array.value_lengths().fill_null(0).to_numpy().tolist():
            out.append(inner[at : at + size])
            at += size
    elif pa.types.is_integer(kind) or pa.types.is_floating(kind):
        out = (array.fill_null(0) if array.null_count else array).to_numpy().tolist()
    elif pa.types.is_string(kind):
        codes = array.dictionary_encode()
        words = codes.dictionary.to_pylist()
        out = [words[i] for i in codes.indices.fill_null(0).to_numpy().tolist()]
    else:
        return array.to_pylist()
    if array.null_count:
        for i in np.flatnonzero(array.is_null().to_numpy(zero_copy_only=False)).tolist():
            out[i] = None
    return out


def _walk(batch: pa.RecordBatch, key: list[str], reads: list[str]) -> Iterator[tuple[tuple, dict]]:
    names = list(dict.fromkeys([*key, *reads]))
    columns = [_values(batch.column(c)) for c in names]
    for values in zip(*columns, strict=True):
        row = dict(zip(names, values, strict=True))
        yield tuple(row[k] for k in key), row


def scan(rows: DataFrame, key: list[str], order: list[str], reads: list[str], begin: Callable[[], Any], step: Callable[[Any, dict], tuple], adds: str) -> DataFrame:
    """rows with the columns of `adds` (DDL), which step(state, row) gives for each row in its key's order; begin() makes a key's state.

    Null keys are keys, rows that tie in `order` come in any order, columns of the rows that `adds` names are replaced.
    """
    more = T.StructType.fromDDL(adds).fields
    fields = [f for f in rows.schema.fields if f.name not in {m.name for m in more}]
    schema = T.StructType([*fields, *more])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, kinds = None, None, None
        for batch in batches:
            out = []
            for k, row in _walk(batch, key, reads):
                if k != now:
                    now, state = k, begin()
                out.append(step(state, row))
            kinds = kinds or [arrow(m.dataType) for m in more]
            added = [pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * len(more), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in fields), *added], names=schema.names)

    return _keyed(rows, key, order).mapInArrow(run, schema)


def emit(rows: DataFrame, key: list[str], order: list[str], reads: list[str], begin: Callable[[], Any], step: Step, schema: str, finish: Callable[[Any], Iterable[tuple]] | None = None) -> DataFrame:
    """(key, schema): what step(state, row) gives, any number of rows, for each row in its key's order, and finish(state) after the last."""
    wanted = T.StructType.fromDDL(schema)
    full = T.StructType([*(rows.schema[k] for k in key), *wanted.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        kinds = [arrow(f.dataType) for f in full.fields]

        def record(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=full.names)

        for batch in batches:
            out = []
            for k, row in _walk(batch, key, reads):
                if k != now:
                    if finish and now is not None:
                        out += [(*now, *values) for values in finish(state)]
                    now, state = k, begin()
                out += [(*k, *values) for values in step(state, row)]
            if out:
                yield record(out)
        if finish and now is not None and (out := [(*now, *values) for values in finish(state)]):
            yield record(out)

    return _keyed(rows, key, order).mapInArrow(run, full)


def arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
