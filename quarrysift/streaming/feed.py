"""A stream of results: first arrivals of each key within a watermark, scored as they come; merged first rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructField, StructType

from ..operators import ranking, results
from ..session import scratch

#: State with timers needs this store.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def first_arrivals(stream: DataFrame, delay: str = "1 hour", key: Column | None = None) -> DataFrame:
    """Rows whose key has not come within ``delay``; the order is that of arrival."""
    keyed = stream.withColumn("dedup_key", results.dedup_key() if key is None else key)
    return keyed.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["dedup_key"])


def scored_stream(stream: DataFrame, query: str, as_of: Column, delay: str = "1 hour") -> DataFrame:
    return ranking.scored(first_arrivals(stream, delay), query, as_of)


class FirstWins(StatefulProcessor):
    """State of one key: its row of least ``ord``, and by name each metadata entry of greatest ``ord`` and each source's least.

    So the outcome does not depend on the order of arrival. Each batch puts out the key's row as
    it stands; ``keep`` milliseconds after the latest event of the key it is put out as final, and
    its state is dropped.
    """

    def __init__(self, row: StructType, keep: int):
        self.row, self.keep = row, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # One value, read and written once for a key and batch: each call to the store is a message to the JVM.
        self.kept = handle.getValueState("kept", "latest long, state binary")

    def _row(self, key: tuple, state: tuple, final: bool) -> Row:
        _, copies, row, entries, sources = state
        names = [n for _, n in sorted((at, n) for n, at in sources.items())]
        metadata = {name: entries[name][1] for name in sorted(entries)}
        fields = dict(zip(self.row.names, row, strict=True))
        return Row(key=key[0], **fields, metadata=metadata or None, sources=names if copies > 1 else None, copies=copies, final=final)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        import pickle

        held = self.kept.get()
        old, state = (held[0], pickle.loads(bytes(held[1]))) if held is not None else (0, (None, 0, None, {}, {}))
        (ord_, copies, row, entries, sources), latest = state, old
        for r in rows:
            copies += 1
            if ord_ is None or r.ord < ord_:
                ord_, row = r.ord, tuple(r[n] for n in self.row.names)
            latest = max(latest, r.qs_millis)
            sources[r.source] = min(r.ord, sources.get(r.source, r.ord))
            for name, value in dict(r.metadata or {}).items():
                if name not in entries or entries[name][0] <= r.ord:
                    entries[name] = (r.ord, value)
        state = (ord_, copies, row, entries, sources)
        self.kept.update((latest, pickle.dumps(state)))
        if latest != old:
            if old:
                self.handle.deleteTimer(old + self.keep)
            self.handle.registerTimer(latest + self.keep)
        yield self._row(key, state, False)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        import pickle

        out = self._row(key, pickle.loads(bytes(self.kept.get()[1])), True)
        self.kept.clear()
        yield out

    def close(self) -> None:
        pass


def merged_first_wins(stream: DataFrame, delay: str = "1 hour", keep: str = "1 hour", key: Column | None = None) -> DataFrame:
    """Updates of each key of a stream of results: its first row by ``ord`` with the metadata and sources of all its rows.

    An event older than the watermark (``delay`` behind the latest) is dropped. A key's row is final
    ``keep`` after its latest event; a later one of that key begins anew. The session needs ``STORE``
    as its state store.
    """
    fields = [f for f in stream.schema if f.name not in ("metadata", "sources", "copies")]
    row = StructType(fields)
    out = StructType([StructField("key", StructType.fromDDL("key string")["key"].dataType), *fields, *StructType.fromDDL("metadata map<string,string>, sources array<string>, copies long, final boolean")])
    keyed = stream.withColumns({"key": results.dedup_key() if key is None else key, "qs_millis": F.unix_millis("ts")}).withWatermark("ts", delay)
    millis = int(pd.Timedelta(keep).total_seconds() * 1000)
    return keyed.groupBy("key").transformWithState(FirstWins(row, millis), out, "Update", "EventTime")


def run_available(stream: DataFrame, name: str = "updates") -> DataFrame:
    """Run a stream of updates over all that is there, and give each key's last one.

    Batches are written to the shared folder by their number, so that one run again replaces its own rows.
    """
    spark = stream.sparkSession
    path, at = scratch(spark, name), scratch(spark, "offsets")
    kind = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(kind)
    spark.conf.set(kind, STORE)
    try:
        query = stream.writeStream.outputMode("update").option("checkpointLocation", at).trigger(availableNow=True)
        query = query.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{path}/batch={n}")).start()
        query.awaitTermination()
    finally:
        spark.conf.set(kind, before)
    updates = spark.read.schema(StructType([*stream.schema, *StructType.fromDDL("batch long")])).parquet(path)
    last = updates.groupBy("key").agg(F.max_by(F.struct(*stream.columns), F.struct("batch", "final")).alias("r"))
    return last.select("r.*")
