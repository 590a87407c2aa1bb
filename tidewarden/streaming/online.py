"""The per-message pipeline as a batch frame and as a stream.

Failures are columns, not exceptions: a scorer's missing probabilities lead to a rule
verdict or UNKNOWN, never to SAFE.  The detector is a function from a frame with
columns text, sender, channel to the same with p_scam, p_safe, det_category.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.vocab import BUILT_IN, Dictionary
from ..operators import messages, rules
from ..sources.keyed import KeyedStore
from ..sources.shared import materialise

STAGES = ("normalize", "perceive", "rules", "detect", "fuse", "explain")
Scorer = Callable[[DataFrame], DataFrame]


def no_detector(df: DataFrame) -> DataFrame:
    none = F.lit(None)
    return df.withColumns({"p_scam": none.cast("double"), "p_safe": none.cast("double"), "det_category": none.cast("string")})


def check_messages(events: DataFrame, scorer: Scorer = no_detector, data: Dictionary = BUILT_IN, thresholds=rules.DEFAULT_THRESHOLDS) -> DataFrame:
    """Events (id, parent_id, created_at, channel, text, sender) with verdict, category, red_flags and signals."""
    own = rules.Rules(data)
    rows = events.withColumn("n", T.normalize_message(F.col("text"), F.col("sender")))
    rows = rows.withColumn("signals", own.evaluate(F.col("n")))
    rows = scorer(rows)
    verdict = rules.fuse(F.col("signals.hard"), F.col("signals.soft"), F.col("p_scam"), F.col("p_safe"), *thresholds)
    rows = rows.withColumn("verdict", F.when(F.coalesce(F.trim("text"), F.lit("")) == "", "UNKNOWN").otherwise(verdict))
    rows = rows.withColumn("category", rules.fused_category(F.col("verdict"), F.col("det_category"), F.col("signals.hard")))
    flags = F.when(F.col("verdict").isin("SCAM", "SUSPICIOUS"), rules.rule_flags(F.col("signals.evidence"), F.col("n.text")))
    return rows.withColumn("red_flags", flags)


def alerts(checked: DataFrame, parents: DataFrame) -> DataFrame:
    """For SCAM only: id and a fixed sentence; never message text."""
    scam = checked.filter("verdict = 'SCAM'").join(parents.select(F.col("id").alias("parent_id"), "name"), "parent_id")
    return scam.select("id", "parent_id", messages.alert_body(F.col("name"), F.col("category"), F.col("created_at")).alias("body"))


def day_counts(checked: DataFrame, watermark: str = "1 day") -> DataFrame:
    """Verdicts per parent and day; on a stream, late events are taken up to the watermark."""
    rows = checked.withWatermark("created_at", watermark) if checked.isStreaming else checked
    return rows.groupBy(F.window("created_at", "1 day").alias("day"), "parent_id", "verdict").count()


def checks_store(spark, store_path: str) -> KeyedStore:
    """The latest check of every event, by when it was made."""
    return KeyedStore(spark, f"{store_path}/checks", "id", "created_at")


class Outbox:
    """Alerts that are to go out and those that went, by event.

    An alert is written down before it is delivered and marked after, so a failure in between
    leaves it due, and the next run delivers what is due and nothing else: not the alerts
    of a repeated batch, nor of an event that comes again in another one.  Should a run fail
    after the delivery and before the mark, the alert goes out again under the same id, by
    which a sink that keeps ids drops it.
    """

    def __init__(self, spark, store_path: str):
        self.alerts = KeyedStore(spark, f"{store_path}/outbox", "id", "sent_at")

    def _known(self) -> DataFrame | None:
        return self.alerts.read() if self.alerts.version() else None

    def add(self, due: DataFrame, number: int) -> None:
        """Alerts of a batch, but for events that have one."""
        known = self._known()
        new = due if known is None else due.join(known.select("id"), "id", "left_anti")
        self.alerts.upsert(new.withColumn("sent_at", F.lit(None).cast("timestamp")), 2 * number)

    def due(self) -> DataFrame:
        return self.alerts.read().filter("sent_at is null").drop("sent_at")

    def flush(self, deliver: Callable[[DataFrame], None], number: int) -> None:
        """Deliver what is due and mark it."""
        if not self.alerts.manifest()["files"]:
            return
        due = materialise(self.due(), "due")
        if not due.isEmpty():
            deliver(due)
            self.alerts.upsert(due.withColumn("sent_at", F.current_timestamp()), 2 * number + 1)


def start(source: DataFrame, store_path: str, checkpoint: str, parents: DataFrame, deliver: Callable[[DataFrame], None], scorer: Scorer = no_detector, data: Dictionary = BUILT_IN, **trigger):
    """Run the stream: each batch is put into the store once, its alerts into the outbox, and what is due is delivered once."""

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        checks, outbox = checks_store(spark, store_path), Outbox(spark, store_path)
        checks.upsert(check_messages(df, scorer, data).drop("n"), number)
        outbox.add(alerts(checks.batch(number), parents), number)
        outbox.flush(deliver, number)

    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def stored(spark, store_path: str) -> DataFrame:
    """The latest check of every event."""
    return checks_store(spark, store_path).read()


def batch_timings(spark, store_path: str) -> DataFrame:
    """batch, part, ms: how long each batch took to be checked and stored, and its alerts to be written down and marked."""
    rows = [(int(n), "checks", ms) for n, ms in checks_store(spark, store_path).manifest()["batches"].items()]
    rows += [(int(n) // 2, ("alerts", "marks")[int(n) % 2], ms) for n, ms in Outbox(spark, store_path).alerts.manifest()["batches"].items()]
    return spark.createDataFrame(rows, "batch long, part string, ms long")
