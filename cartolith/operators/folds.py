"""Folds over a key's rows in order: sorted partitions, one pass, and one state at a time however many rows a key has."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from cartolith.functions import geometry as G


def folded(rows: DataFrame, key: str, order: list[str], needs: list[str], step: Callable, added: str) -> DataFrame:
    """rows with the columns added (as DDL): step takes a key's state (None at first) and a row's values of needs, and gives the new state and the values added.

    Rows of one key and order come as they happen to. A null key is a key. Other columns pass through untouched."""
    more = T.StructType.fromDDL(added)
    schema = T.StructType([*rows.schema.fields, *more.fields])
    kinds = [to_arrow_type(f.dataType) for f in more.fields]
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, begun = None, None, False
        for b in batches:
            out = []
            for k, *values in zip(b.column(key).to_pylist(), *(b.column(c).to_pylist() for c in needs), strict=True):
                if not begun or k != now:
                    now, state, begun = k, None, True
                state, found = step(state, *values)
                out.append(found)
            cols = list(zip(*out, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names)

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def limited_headings(rows: DataFrame, key: str, order: list[str], raw: str, most: float) -> DataFrame:
    """rows with heading: the raw one, but none more than most radians from that of the row before; nulls are passed over and have none."""

    def step(last: float | None, raw: float | None) -> tuple[float | None, tuple]:
        if raw is None:
            return last, (None,)
        now = raw if last is None else last + max(-most, min(most, G.wrapped_number(raw - last)))
        return now, (now,)

    return folded(rows, key, order, [raw], step, "heading double")
