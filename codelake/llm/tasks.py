"""How the per-row helpers of this subpackage run inside Spark tasks."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows a helper sees at once: bounds what a Python worker holds beside the Arrow batch.
SLICE = 256
#: Counts a task holds before it passes them on.
HELD = 200_000

Totals = defaultdict[str, Counter]


def spread(df: DataFrame) -> DataFrame:
    """Deals the rows out evenly where the input has fewer files than the cluster has cores; large inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores * 2) if len(df.inputFiles()) < cores else df


def per_slice(df: DataFrame, work: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table]], schema: str) -> DataFrame:
    """Applies the function that ``work`` sets up once a task to small slices of rows, through Arrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = work()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                out = apply(batch.slice(at, SLICE))
                yield from out.to_batches() if isinstance(out, pa.Table) else [out]

    return df.mapInArrow(run, schema)


def tally(df: DataFrame, work: Callable[[], Callable[..., None]], schema: str, values: int) -> DataFrame:
    """Counts by group and item, added up within each task before they are shuffled; ``schema`` is the group, the item and the counts.

    The function that ``work`` sets up adds a slice of rows to as many totals as there are counts.
    """
    names = [column.split()[0] for column in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        add = work()

        def fresh() -> list[Totals]:
            return [defaultdict(Counter) for _ in range(values)]

        def rows(totals: list[Totals]) -> pa.RecordBatch:
            keys = [(group, item) for group, own in totals[0].items() for item in own]
            counts = [pa.array([t[group][item] for group, item in keys], pa.int64()) for t in totals]
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), *counts], names=names)

        totals = fresh()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                add(batch.slice(at, SLICE), *totals)
                if sum(map(len, totals[0].values())) > HELD:
                    yield rows(totals)
                    totals = fresh()
        yield rows(totals)

    return df.mapInArrow(run, schema)
