"""One stateful operator between a stream of file events and the import: cooldown of changes, own deletions that explain removals."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .events import cooled

EVENT = "path string, kind string, ts timestamp"
BLOCK = 10_000


class _Gate(StatefulProcessor):
    """Two times for each path (last change let through, last own deletion) and one timer that ends both."""

    def __init__(self, cooldown: float, own: float):
        self.cooldown, self.own = cooldown, own

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.passed = handle.getValueState("passed", "at double")
        self.deleted = handle.getValueState("deleted", "at double")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        last, gone = (s.get()[0] if s.exists() else None for s in (self.passed, self.deleted))
        # a block at a time, so that a path with very many events is never held whole
        while block := sorted(islice(rows, BLOCK), key=lambda r: (r.ts, r.kind != "own")):
            for row in block:
                at = row.ts.timestamp()
                if row.kind == "own":
                    gone = at if gone is None else max(at, gone)
                elif row.kind == "removed":
                    if gone is None or not 0 <= at - gone < self.own:
                        yield Row(path=row.path, kind=row.kind, ts=row.ts)
                elif last is None or at - last >= self.cooldown:
                    last = at
                    yield Row(path=row.path, kind=row.kind, ts=row.ts)
        ends = []
        if last is not None:
            self.passed.update((last,))
            ends.append(last + 2 * self.cooldown)
        if gone is not None:
            self.deleted.update((gone,))
            ends.append(gone + self.own)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if ends:
            self.handle.registerTimer(int(max(ends) * 1000) + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.passed.clear()
        self.deleted.clear()
        yield from ()

    def close(self) -> None:
        pass


def gated(events: DataFrame, cooldown: float = 5.0, own: float = 30.0, late: str = "10 seconds") -> DataFrame:
    """Events (path, kind, ts) that are to be acted on.

    ``changed`` passes at least ``cooldown`` seconds after the last change of
    its path that passed; ``removed`` passes unless an ``own`` deletion of the
    path came less than ``own`` seconds before it; ``own`` itself never does.

    A stream judges in the order of arrival, and by time within a batch. Its
    state is two numbers for each path; a timer of event time drops them once
    the watermark is past twice the cooldown and past ``own``, so results do
    not hang on how fast the stream is read. Rows older than the watermark are
    dropped. It needs the RocksDB provider in
    ``spark.sql.streaming.stateStore.providerClass``. Rows without a time are
    dropped, those without a path are one path.
    """
    events = events.select("path", "kind", "ts").where("ts is not null and kind in ('changed', 'removed', 'own')")
    if events.isStreaming:
        return events.withWatermark("ts", late).groupBy("path").transformWithState(_Gate(cooldown, own), EVENT, "append", "eventTime")
    removed, deletions = events.where("kind = 'removed'"), events.where("kind = 'own'")
    seconds = F.make_interval(secs=F.lit(float(own)))
    explained = removed.alias("r").join(deletions.select(F.col("path").alias("p"), F.col("ts").alias("t")), F.col("path").eqNullSafe(F.col("p")) & (F.col("ts") >= F.col("t")) & (F.col("ts") < F.col("t") + seconds), "left_anti")
    return cooled(events.where("kind = 'changed'"), cooldown).unionByName(explained.select("path", "kind", "ts"))
