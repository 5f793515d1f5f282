"""Alert lifecycle as keyed state on a stream.

One small state per fingerprint. A suppressed alert is woken by a timer when its
suppression ends. Needs the RocksDB state store:
spark.sql.streaming.stateStore.providerClass =
org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Fixed values.
RANK = {"CRITICAL": 3, "HIGH": 2, "MEDIUM": 1}
STATE = T.StructType([
    T.StructField("life", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("seen", T.LongType()),
    T.StructField("until_ms", T.LongType()),
])
OUT = T.StructType([
    T.StructField("fingerprint", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("event", T.StringType()),
    T.StructField("from_value", T.StringType()),
    T.StructField("to_value", T.StringType()),
    T.StructField("seen", T.LongType()),
])


class AlertLifecycle(StatefulProcessor):
    """Rows: fingerprint, ts, severity (NULL: condition absent), suppress_hours (NULL: no suppression asked).

    An alert that stays resolved for ``retention_days`` of event time is
    forgotten; should it come back later, it is a new one.
    """

    def __init__(self, retention_days: int = 365) -> None:
        self.retention_ms = retention_days * 86_400_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("alert", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        life, severity, seen, until = self.value.get() if self.value.exists() else (None, None, 0, 0)
        # A key's rows come in chunks; they are put in order of time over all of them.
        for batch in [pd.concat(list(rows))]:
            out = []
            for r in batch.sort_values("ts", kind="stable").itertuples(index=False):
                at = int(r.ts.timestamp() * 1000)
                emit = lambda event, a, b: out.append((key[0], r.ts, event, a, b, seen))  # noqa: E731, B023
                if life == "SUPPRESSED" and until and at > until:
                    emit("SUPPRESSION_EXPIRED", life, "OPEN")
                    life, until = "OPEN", 0
                if r.severity is None or r.severity != r.severity:
                    if life in ("OPEN", "REOPENED"):
                        emit("AUTO_RESOLVE", life, "RESOLVED")
                        life, until = "RESOLVED", at + self.retention_ms
                        self.handle.registerTimer(until)
                    continue
                seen += 1
                if life is None:
                    life = "OPEN"
                    emit("CREATE", None, "OPEN")
                else:
                    if life == "RESOLVED":
                        emit("REOPEN", life, "REOPENED")
                        life, until = "REOPENED", 0
                    step = RANK.get(r.severity, 0) - RANK.get(severity, 0)
                    if step:
                        emit("ESCALATE" if step > 0 else "DEESCALATE", severity, r.severity)
                severity = r.severity
                if r.suppress_hours is not None and r.suppress_hours == r.suppress_hours and r.suppress_hours > 0:
                    emit("SUPPRESS", life, "SUPPRESSED")
                    life, until = "SUPPRESSED", at + int(r.suppress_hours * 3_600_000)
                    self.handle.registerTimer(until)
            if out:
                yield pd.DataFrame(out, columns=OUT.names)
        self.value.update((life, severity, seen, until))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        life, severity, seen, until = self.value.get() if self.value.exists() else (None, None, 0, 0)
        due = expiredTimerInfo.getExpiryTimeInMs()
        if life == "RESOLVED" and until and due >= until:
            self.value.clear()
        if life == "SUPPRESSED" and until and due >= until:
            self.value.update(("OPEN", severity, seen, 0))
            at = pd.Timestamp(due, unit="ms")
            yield pd.DataFrame([(key[0], at, "SUPPRESSION_EXPIRED", "SUPPRESSED", "OPEN", seen)], columns=OUT.names)

    def close(self) -> None:
        pass


def alert_stream(stream: DataFrame, watermark: str = "1 day", retention_days: int = 365) -> DataFrame:
    """Audit events of alerts. ``stream``: fingerprint, ts, severity, suppress_hours."""
    return (
        stream.select("fingerprint", F.col("ts").cast("timestamp").alias("ts"), "severity", "suppress_hours")
        .withWatermark("ts", watermark)
        .groupBy("fingerprint")
        .transformWithStateInPandas(statefulProcessor=AlertLifecycle(retention_days), outputStructType=OUT, outputMode="Append", timeMode="EventTime")
    )
