"""Groups of a stream that close when the watermark reaches their end, and what comes too late for them.

Spark drops rows behind the watermark in silence. Here a group (a node's hour, a day's notice, a frame) has an
end of its own, known from its key. Until the watermark reaches it, rows count, in whatever order they come,
and every change emits a new version of the group. Rows of a group that was closed when their batch began come
out in a second table, so that both tables account for every row.

One stateful operator decides this, where the state is: it sees the watermark of its own batch. The column that
carries the watermark is left out before it, because Spark would filter late rows by that column first.
"""

from __future__ import annotations

import contextlib
import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from plumewatch.session import scratch_path, ship_package

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Rule:
    """What a group keeps and shows. State must survive JSON."""

    #: Fields of a version's rows, the key first.
    result: str
    #: Columns of the input rows that the rule reads and that late rows come out with.
    reads: Sequence[str]

    def fold(self, held, rows: pd.DataFrame):
        """The state after some more rows, in any order; `held` is None at first."""
        raise NotImplementedError

    def shown(self, key: tuple, held) -> list[tuple]:
        """The rows of a version."""
        raise NotImplementedError


class _Closing(StatefulProcessor):
    def __init__(self, rule: Rule, fields: int, columns: list[str]):
        self.rule, self.fields, self.columns = rule, fields, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "value string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        reached = timerValues.getCurrentWatermarkInMs()
        known = self.held.exists()
        before = self.held.get()[0] if known else None
        held, end = json.loads(before) if known else None, None
        for chunk in rows:
            if not len(chunk):
                continue
            end = int(chunk["end_ms"].iloc[0])
            if end <= reached:
                yield self._frame([(True, *[None] * self.fields, *row) for row in zip(
                    *(chunk[c].astype(object).where(chunk[c].notna(), None) for c in self.rule.reads))])
            else:
                held = self.rule.fold(held, chunk)
        after = None if held is None else json.dumps(held)
        if after != before:
            self.held.update((after,))
            if not known:
                self.handle.registerTimer(end)
            blank = [None] * len(self.rule.reads)
            yield self._frame([(False, *row, *blank) for row in self.rule.shown(key, held)])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.clear()
        return iter(())

    def close(self) -> None:
        pass

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame({c: pd.Series(v, dtype=object) for c, v in zip(self.columns, zip(*rows))}, columns=self.columns)


def closing(rows: DataFrame, keys: Sequence[str], rule: Rule, end: Column, delay: str, ts: str = "ts") -> DataFrame:
    """Stream of versions and late rows: `late`, the rule's result and its input columns as `row_...`.

    `end` is the time a group closes, in epoch milliseconds, the same for all rows of a key. Filter rows before
    this operator: the watermark follows the newest `ts` that comes in.
    """
    ship_package(rows.sparkSession)
    source = rows.withWatermark(ts, delay).select(
        *dict.fromkeys([*keys, *rule.reads]), end.cast("long").alias("end_ms"))
    result = T.StructType.fromDDL(rule.result)
    out = T.StructType([
        T.StructField("late", T.BooleanType()), *result.fields,
        *(T.StructField(f"row_{c}", source.schema[c].dataType) for c in rule.reads)])
    return source.groupBy(*keys).transformWithStateInPandas(
        _Closing(rule, len(result), out.names), out, "Update", "EventTime")


@contextlib.contextmanager
def _rocksdb(spark: SparkSession):
    """State stores of the queries started inside are RocksDB, which timers need."""
    old = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, old)


def drain_closing(stream: DataFrame, keys: Sequence[str], label: str, folder: str | None = None,
                  ) -> tuple[DataFrame, DataFrame]:
    """Process everything available; the newest version of every group, and the late rows.

    Each batch overwrites its own folders, so a replayed batch leaves nothing twice. A later call with the same
    folder goes on where this one stopped.
    """
    spark = stream.sparkSession
    folder = folder or scratch_path(spark, label)
    shown, late = f"{folder}/versions", f"{folder}/late"
    fields = [c for c in stream.columns if c != "late" and not c.startswith("row_")]
    row = [c for c in stream.columns if c.startswith("row_")]

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()  # the state is read and written once for both tables
        try:
            batch.where(~F.col("late")).select(*fields).write.mode("overwrite").parquet(f"{shown}/batch={batch_id}")
            batch.where("late").select(*[F.col(c).alias(c[4:]) for c in row]).write.mode("overwrite").parquet(
                f"{late}/batch={batch_id}")
        finally:
            batch.unpersist()

    with _rocksdb(spark):
        query = (
            stream.writeStream.foreachBatch(write).outputMode("update")
            .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start())
        query.awaitTermination()
    newest = F.max("batch").over(W.partitionBy(*keys))
    versions = spark.read.parquet(shown).withColumn("_newest", newest).where("batch = _newest").select(*fields)
    return versions, spark.read.parquet(late).drop("batch")
