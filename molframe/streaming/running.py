"""Streams with state: files in step, running molecule numbers, and the ladder of duplicates. An addition to the batch operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def zip_streams(inputs: list[DataFrame], ordinal: str = "ord", name: str = "qname", ts: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Records of the same ordinal of all inputs, side by side as r1, r2, ...; an error if names differ. With an event time, state is dropped once it is `late` behind."""
    keyed = []
    for i, df in enumerate(inputs):
        df = df.withWatermark(ts, late) if ts and df.isStreaming else df
        keyed.append(df.select(F.col(ordinal).alias("o_"), *([F.col(ts).alias(f"t{i + 1}")] if ts else []), F.struct("*").alias(f"r{i + 1}")))
    both = reduce(lambda a, b: a.join(b, "o_"), keyed)
    names = [F.col(f"r{i + 1}.{name}") for i in range(len(inputs))]
    same = reduce(lambda a, b: a & b, [n.eqNullSafe(names[0]) for n in names])
    return both.select(F.when(same, F.col("o_")).otherwise(F.raise_error(F.lit("inputs differ in reads"))).alias(ordinal), names[0].alias(name), *[f"r{i + 1}" for i in range(len(inputs))])


class Numbering:
    """Molecule numbers that go on from micro-batch to micro-batch: a function for foreachBatch. Each batch's groups must be whole, as sorted input or closed families give them.

    assign(batch) gives the batch's rows with `molecule` from 0; sink(rows, batch_id) stores them. What has been numbered is in `path` (a row for each batch), so a batch that is run again gets the same numbers."""

    def __init__(self, path: str, assign: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], Any], molecule: str = "molecule"):
        self.path, self.assign, self.sink, self.molecule = path, assign, sink, molecule

    def base(self, batch: DataFrame, batch_id: int) -> int:
        if batch_id == 0:
            return 0
        done = batch.sparkSession.read.parquet(self.path).filter(F.col("batch") < batch_id)
        return done.groupBy("batch").agg(F.max("molecules").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        base = self.base(batch, batch_id)
        rows = self.assign(batch).persist()
        try:
            count = rows.agg(F.coalesce(F.max(self.molecule) + 1, F.lit(0)).cast("long").alias("molecules")).withColumn("batch", F.lit(batch_id).cast("long"))
            count.write.mode("append").parquet(self.path)
            self.sink(rows.withColumn(self.molecule, F.col(self.molecule) + F.lit(base)), batch_id)
        finally:
            rows.unpersist()


def running_ladder(groups: DataFrame, interval: int, library: str = "library") -> DataFrame:
    """(library, templates_seen, duplicate_fraction): of a stream of position groups (library, templates, duplicates) a row whenever a library's running templates pass a multiple of the interval. State is two totals a library; groups count in the order
    in which they arrive."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, duplicates = state.get if state.exists else (0, 0)
        rows = []
        for pdf in frames:
            for n, d in zip(pdf["templates"].tolist(), pdf["duplicates"].tolist(), strict=True):
                before, seen, duplicates = seen, seen + n, duplicates + d
                if seen // interval > before // interval:
                    rows.append((key[0], seen, duplicates / seen))
        state.update((seen, duplicates))
        yield pd.DataFrame(rows, columns=[library, "templates_seen", "duplicate_fraction"])

    rows = groups.select(library, F.col("templates").cast("long").alias("templates"), F.col("duplicates").cast("long").alias("duplicates"))
    return rows.groupBy(library).applyInPandasWithState(step, f"{library} string, templates_seen long, duplicate_fraction double", "seen long, duplicates long", "append", GroupStateTimeout.NoTimeout)
