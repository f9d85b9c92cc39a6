"""When findings appear and go, over a stream of versions of files: keyed state that timers bound."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..rules.catalogue import CODE, Rule, matched
from ..sql import scan_sql

#: What becomes of a finding (or of a version that comes late), and with which version of its file.
EVENT = "file string, rule_id string, match string, nth int, severity string, line int, event string, version long, ts timestamp, opened long, opened_ts timestamp"
#: The state store that keyed state needs: ``spark.sql.streaming.stateStore.providerClass``.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def versions_with_findings(versions: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """file, version, ts, found: of a stream of file, version (a growing number), ts, language, text the findings of each version as an array, which is empty if there are none.

    The text goes no further, so that what is shuffled is findings.
    """
    found = F.coalesce(F.expr(scan_sql(rules or matched(*CODE), hidden=True)), F.array())
    kept = "transform(found, f -> struct(f.rule_id, f.match, f.severity, f.line))"
    return versions.withColumn("found", found).select("file", "version", "ts", F.expr(kept).alias("found"))


class _Lifecycle(StatefulProcessor):
    """Of one file: the last version seen, and its open findings by rule, match and number among equal ones."""

    def __init__(self, idle_ms: int) -> None:
        self.idle_ms = idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "version long, ts timestamp")
        self.open = handle.getMapState("open", "rule_id string, match string, nth int", "severity string, line int, opened long, opened_ts timestamp")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        file = key[0]
        state = {tuple(k): tuple(v) for k, v in self.open.iterator()} if self.open.exists() else {}
        before, last, heard = dict(state), tuple(self.last.get()) if self.last.exists() else None, 0
        for row in sorted(rows, key=lambda r: (r.version, r.ts)):  # the versions of one file in one batch
            if last is not None and row.version <= last[0]:
                if row.version < last[0]:
                    yield self._event(file, (None, None, None), (None, None, None, None), "late", row.version, row.ts)
                continue  # a version that is sent again changes nothing
            now, times = {}, {}
            for f in row.found:
                same = (f["rule_id"], f["match"])
                times[same] = times.get(same, 0) + 1
                now[*same, times[same]] = (f["severity"], f["line"])
            for k in sorted(state.keys() - now.keys()):
                yield self._event(file, k, state.pop(k), "closed", row.version, row.ts)
            for k in sorted(now):
                since = state[k][2:] if k in state else (row.version, row.ts)
                if k not in state:
                    yield self._event(file, k, (*now[k], *since), "opened", row.version, row.ts)
                state[k] = (*now[k], *since)
            last, heard = (row.version, row.ts), row.ms
        for k in before.keys() - state.keys():
            self.open.removeKey(k)
        for k, v in state.items():
            if before.get(k) != v:
                self.open.updateValue(k, v)
        if not heard:  # no version that is new
            return
        self.last.update(last)
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.handle.registerTimer(max(heard, timerValues.getCurrentWatermarkInMs()) + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        version, ts = self.last.get()
        if self.open.exists():
            for k, v in sorted((tuple(k), tuple(v)) for k, v in self.open.iterator()):
                yield self._event(key[0], k, v, "expired", version, ts)
            self.open.clear()
        self.last.clear()

    def close(self) -> None:
        pass

    @staticmethod
    def _event(file, key, value, event, version, ts) -> Row:
        return Row(file=file, rule_id=key[0], match=key[1], nth=key[2], severity=value[0], line=value[1], event=event, version=version, ts=ts, opened=value[2], opened_ts=value[3])


def lifecycle(versions: DataFrame, late: str = "1 hour", idle_seconds: int = 7 * 24 * 3600) -> DataFrame:
    """EVENT: what happens to findings over a stream of ``versions_with_findings``.

    A finding is its rule, what it shows, and its number among equal ones of its file, so one that only moves to another line stays open.  ``opened`` and ``closed`` come with the
    version that brings or lacks it.  A version older than the last one of its file changes nothing and is told as ``late``; one that comes again changes nothing and
    is not told.  Versions whose ts is behind the watermark (``late``) are dropped by Spark.  A file of which nothing is heard for ``idle_seconds`` of event time
    after its last version has its findings ``expired`` and its state removed, so state grows with the files in use, a file's with its open findings.  A null file,
    version or ts is left out.  Output mode: append or update; set STORE.
    """
    whole = versions.where("file IS NOT NULL AND version IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", late).withColumn("ms", F.unix_millis("ts"))
    return whole.groupBy("file").transformWithState(_Lifecycle(idle_seconds * 1000), EVENT, "Append", "EventTime")
