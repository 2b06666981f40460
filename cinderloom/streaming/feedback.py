"""Feedback as a stream: each arriving cohort's marker summary adds to the counters, once (an extension)."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.state import exists

#: An arriving row: what a cohort's run says of a marker.
SUMMARY = "cohort string, snp_id long, seen long, nocall_raw long, nocall_p long, nocall long"
COUNTERS = "cohorts long, seen long, nocall_raw long, nocall_p long, bad boolean"
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class Counted(StatefulProcessor):
    """Keyed state of a marker: the cohorts that have counted, and the counters.  A cohort that comes again changes nothing.

    ``bad`` is sticky: it is true once any cohort's share of missing calls reached the threshold.
    """

    def __init__(self, threshold: float):
        self.threshold = threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.cohorts = handle.getMapState("cohorts", "cohort string", "counted boolean")
        self.counters = handle.getValueState("counters", COUNTERS)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        n, seen, raw, p, bad = self.counters.get() or (0, 0, 0, 0, False)
        new = False
        for r in rows:
            if r.cohort is None or self.cohorts.containsKey((r.cohort,)):
                continue
            self.cohorts.updateValue((r.cohort,), (True,))
            n, seen, raw, p, new = n + 1, seen + r.seen, raw + r.nocall_raw, p + r.nocall_p, True
            bad = bad or (self.threshold > 0 and r.seen > 0 and r.nocall / r.seen >= self.threshold)
        if new:
            self.counters.update((n, seen, raw, p, bad))
            yield Row(snp_id=key[0], cohorts=n, seen=seen, nocall_raw=raw, nocall_p=p, bad=bad)

    def close(self) -> None:
        pass


def feedback_stream(summaries: DataFrame, threshold: float) -> DataFrame:
    """The counters of each marker that a micro-batch of ``SUMMARY`` rows changes; the state never expires.

    Rows without a cohort are left out: they can't be told from a replay.
    """
    return summaries.groupBy("snp_id").transformWithState(Counted(threshold), f"snp_id long, {COUNTERS}", "Update", "None")


def counted_files(spark: SparkSession, path: str, threshold: float, state_dir: str, files_per_batch: int = 1000) -> DataFrame:
    """The counters after all summary files (Parquet) that lie at ``path`` now; ``state_dir`` keeps what has been counted.

    A later run with the same ``state_dir`` takes the files that came since; a run that was stopped goes on where its last batch ended.
    """
    before = {k: spark.conf.get(k, None) for k in STATE_STORE}
    changes = f"{state_dir}/changes"

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{changes}/batch={number}")

    for k, v in STATE_STORE.items():
        spark.conf.set(k, v)
    try:
        arriving = spark.readStream.schema(SUMMARY).option("maxFilesPerTrigger", files_per_batch).option("maxFileAge", "36500d").parquet(path)
        query = feedback_stream(arriving, threshold).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{state_dir}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    kind = f"snp_id long, {COUNTERS}, batch long"
    rows = spark.read.schema(kind).parquet(changes) if exists(spark, changes) else spark.createDataFrame([], kind)
    names = [c.split()[0] for c in COUNTERS.split(", ")]
    last = rows.groupBy("snp_id").agg(F.max_by(F.struct(*names), "batch").alias("s"))
    return last.select("snp_id", *(F.col(f"s.{c}").alias(c) for c in names))
