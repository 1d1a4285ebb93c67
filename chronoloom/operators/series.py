"""What a series is made of: its key, the order of its rows, its value."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StructField, StructType
from pyspark.sql.window import Window, WindowSpec


@dataclass(frozen=True)
class SeriesSpec:
    key: tuple[str, ...] = ("series_id",)
    order: tuple[str, ...] = ("ts", "event_id")
    value: str = "x"

    @property
    def w(self) -> WindowSpec:
        return Window.partitionBy(*self.key).orderBy(*self.order)

    def frame(self, n: int) -> WindowSpec:
        """The current row and the n - 1 before it."""
        return self.w.rowsBetween(-(n - 1), Window.currentRow)

    @property
    def all(self) -> WindowSpec:
        return self.w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


EVENTS = SeriesSpec()


def over_series(df: DataFrame, schema: StructType, f: Callable[[tuple, pd.DataFrame], dict[str, np.ndarray]], spec: SeriesSpec = EVENTS) -> DataFrame:
    """df with the columns of doubles that f(key, rows) gives for each series; f gets the rows in order (NaN for null, as it may give), without the columns of key and
    order; schema is df's with the new columns at the end.

    One shuffle by the key and one sort; many series travel in one Arrow batch, which for short ones is much faster than a group each.
    A series that spans several batches is held until it ends.
    """
    keys = list(spec.key)
    names = schema.names[len(df.columns) :]
    values = [c for c in df.columns if c not in (*spec.key, *spec.order)]

    def starts(rows: pa.Table) -> list[int]:
        """Where series begin, after the first."""
        changed = np.zeros(rows.num_rows - 1, bool)
        for k in keys:
            a, b = rows[k].slice(1), rows[k].slice(0, rows.num_rows - 1)
            differ = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.not_equal(pc.is_null(a), pc.is_null(b)))
            changed |= np.asarray(differ)
        return (np.flatnonzero(changed) + 1).tolist()

    def whole(parts: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        rows = pa.concat_tables(parts).combine_chunks()
        pdf, bounds = rows.select(values).to_pandas(), [0, *starts(rows), rows.num_rows]
        made = [f(tuple(rows[k][a].as_py() for k in keys), pdf.iloc[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]
        for c in names:
            rows = rows.append_column(c, pa.array(np.concatenate([m[c] for m in made]).astype(float), from_pandas=True))
        yield from rows.to_batches()

    def key(rows: pa.Table, at: int) -> tuple:
        return tuple(rows[k][at].as_py() for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            if not rows.num_rows:
                continue
            if held and key(held[-1], -1) != key(rows, 0):
                yield from whole(held)
                held = []
            if found := starts(rows):
                yield from whole([*held, rows.slice(0, found[-1])])
                held, rows = [], rows.slice(found[-1])
            held.append(rows)
        if held:
            yield from whole(held)

    return df.repartition(*keys).sortWithinPartitions(*keys, *spec.order).mapInArrow(run, StructType([StructField(x.name, x.dataType) for x in schema]))
