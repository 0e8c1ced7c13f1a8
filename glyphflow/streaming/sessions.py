"""Session state from a log of operations: create overwrites, delete is idempotent, get reads what is there.

``replay`` is the batch form (one window over a session's log); ``stream`` keeps the same state across micro-batches. There
is no expiry: a session lives until it is deleted. ``run_arriving`` puts files that arrive through an engine into a table, each once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType

SEEN = "session_id long, event_id long, op string, found boolean, value string"


def replay(log: DataFrame) -> DataFrame:
    """``log`` (session_id, ts, event_id, op, payload) with found and value: what each operation sees. A get of a session that
    was never created, or was deleted, is not found (404); create and delete always succeed."""
    before = Window.partitionBy("session_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    change = F.when(F.col("op") != "get", F.struct((F.col("op") == "create").alias("alive"), "payload"))
    last = F.last(change, ignorenulls=True).over(before)
    d = log.withColumn("__last", last)
    alive = F.coalesce(F.col("__last.alive"), F.lit(False))
    found = F.when(F.col("op") == "get", alive).otherwise(F.lit(True))
    return d.withColumn("found", found).withColumn("value", F.when(alive & (F.col("op") != "delete"), F.col("__last.payload"))).drop("__last")


def current(log: DataFrame) -> DataFrame:
    """session_id, payload of the sessions that live after the whole log."""
    last = log.where("op <> 'get'").groupBy("session_id").agg(F.max_by(F.struct("op", "payload"), F.struct("ts", "event_id")).alias("x"))
    return last.where("x.op = 'create'").select("session_id", "x.payload")


def stream(log: DataFrame) -> DataFrame:
    """``replay`` over a streaming log, in the order of ts and event_id inside each micro-batch."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        f = pd.concat(list(frames)).sort_values(["ts", "event_id"], kind="stable")
        value, rows = (state.get[0] if state.exists else None), []
        for r in f.itertuples():
            if r.op == "create":
                value = r.payload
            elif r.op == "delete":
                value = None
            rows.append((key[0], r.event_id, r.op, r.op != "get" or value is not None, value))
        if value is None:
            state.remove() if state.exists else None
        else:
            state.update((value,))
        yield pd.DataFrame(rows, columns=["session_id", "event_id", "op", "found", "value"])

    out = "session_id long, event_id long, op string, found boolean, value string"
    return log.groupBy("session_id").applyInPandasWithState(step, out, "payload string", "append", GroupStateTimeout.NoTimeout)


class LiveValue(StatefulProcessor):
    """One typed value a session, no timer: its payload while it lives."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._value = handle.getValueState("value", StructType([StructField("payload", StringType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self._value.get()
        value, alive, out = (held[0] if held else None), bool(held), []
        for r in pd.concat(list(rows)).sort_values(["ts", "event_id"], kind="stable").itertuples():
            if r.op != "get":
                alive, value = r.op == "create", (r.payload if r.op == "create" else None)
            out.append((key[0], r.event_id, r.op, r.op != "get" or alive, value))
        if alive:
            self._value.update((value,))
        else:
            self._value.clear()
        yield pd.DataFrame(out, columns=["session_id", "event_id", "op", "found", "value"])

    def close(self) -> None:
        pass


#: What a session that runs ``stateful`` must have set.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def stateful(log: DataFrame) -> DataFrame:
    """``stream`` by typed value state, kept on disk by the state store of STATE_STORE, so that sessions need not fit memory."""
    return log.groupBy("session_id").transformWithStateInPandas(LiveValue(), SEEN, "append", "none")


def run_arriving(spark: SparkSession, engine, folder: str, sink: str, checkpoint: str, pattern: str = "*", once: bool = True):
    """Starts the stream of files in ``folder`` through ``engine`` into ``sink``, a folder a batch. A batch that runs again after a
    failure replaces its own folder, so with the checkpoint every file gives its lines once."""

    def put(batch: DataFrame, number: int) -> None:
        engine.transform(batch, "path").write.mode("overwrite").parquet(f"{sink}/batch={number}")

    w = arriving(spark, folder, pattern).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def arriving(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Files that arrive in a folder, as a stream of path and content for the same per-row pipeline as in batch."""
    s = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    return s.option("pathGlobFilter", pattern).load(folder).select("path", "content")
