"""Findings reported once, and again only when they get worse, however late they come.

Dropping repeats within a watermark forgets a fingerprint as soon as the watermark has passed.
Here the state of a fingerprint is the highest severity that was reported, one number in the
state store, for ever or until a time has passed since it was last reported (``remembered_ms``).
A batch reports at most one finding of a fingerprint: its most severe, if it is more severe than
what was reported.  A fingerprint's rows of one batch pass through its task one by one; none is held.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from credsieve.functions.score import SEVERITY
from credsieve.operators.baseline import with_fingerprint

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: State that expires needs this store.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _rank(finding: Row) -> int:
    return SEVERITY.get((finding["confidence"] or "").lower(), 0)


class _Worse(StatefulProcessor):
    def __init__(self, remembered_ms: int | None):
        self.remembered_ms = remembered_ms

    def init(self, handle) -> None:
        self.reported = handle.getValueState("reported", "severity int", self.remembered_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # A tie goes to the first by place and text, whatever the order of arrival.
        best = min(rows, key=lambda r: (-_rank(r), r["file_path"], r["line_no"], r["line"]))
        known = self.reported.get()
        if known is None or _rank(best) > known[0]:
            self.reported.update((_rank(best),))
            yield best

    def close(self) -> None:
        pass


def worse_findings(findings: DataFrame, *, remembered_ms: int | None = None) -> DataFrame:
    """A stream's findings, with ``fingerprint``, that are new or more severe than reported before."""
    marked = with_fingerprint(findings)
    return marked.groupBy("fingerprint").transformWithState(
        statefulProcessor=_Worse(remembered_ms), outputStructType=marked.schema, outputMode="Append",
        timeMode="ProcessingTime" if remembered_ms else "None",
    )


def write_worse(findings: DataFrame, path: str, checkpoint: str, *, remembered_ms: int | None = None, **trigger) -> StreamingQuery:
    """Append ``worse_findings`` to a Parquet table; of what has arrived, unless another trigger is given.

    With ``remembered_ms`` a trigger that goes on is needed: state that expires by the clock
    never has all of its batches done.
    """
    if remembered_ms and not trigger:
        raise ValueError("state that expires needs a trigger that goes on, as processingTime='1 minute'")
    spark = findings.sparkSession
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        return (
            worse_findings(findings, remembered_ms=remembered_ms).writeStream.format("parquet").outputMode("append")
            .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start(path)
        )
    finally:
        spark.conf.set(PROVIDER, before)
