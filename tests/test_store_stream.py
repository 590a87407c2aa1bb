import json

import pytest
from pyspark.sql import functions as F

from tidewarden.operators import store
from tidewarden.sources import jsonl
from tidewarden.streaming import online


def test_jsonl_batches_labels_and_split(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "1", "text": "x"}\nnot json\n\n{"id": "2", "text": "y"}\n')
    (tmp_path / "review_b.jsonl").write_text('{"id": "3", "text": "z"}\n')
    rows, bad = jsonl.read_batches(spark, str(tmp_path), "id string, text string")
    assert {r.id for r in rows.collect()} == {"1", "2"} and bad.count() == 1
    log = tmp_path / "labels.log"
    log.write_text("\n".join(json.dumps({"id": i, "verdict": v}) for i, v in (("1", "SAFE"), ("2", "SCAM"), ("1", "SCAM"))))
    assert {r.id: r.verdict for r in jsonl.read_label_log(spark, str(log), "id string, verdict string").collect()} == {"1": "SCAM", "2": "SCAM"}
    a = jsonl.write_split(rows.select("id", "text"), str(tmp_path / "out"), "dev")
    assert a == jsonl.digest(rows.select("id", "text").repartition(3), "id")
    with pytest.raises(ValueError):
        jsonl.write_split(rows, str(tmp_path / "out"), "test")
    assert jsonl.lock_with({"test": 1, "dev": 2}, {"dev": 3, "test": 9}) == {"test": 1, "dev": 3}
    with pytest.raises(PermissionError):
        jsonl.guard_split("test")


def test_append_new(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    for _ in range(2):
        jsonl.append_new(df, str(tmp_path / "t"), "id")
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2


def test_tiles_and_pending(spark):
    events = spark.createDataFrame([(1, "mom"), (2, "mom"), (3, "mom"), (4, "dad"), (5, "dad")], "id int, parent_id string").withColumn("created_at", F.expr("timestamp '2026-01-01 00:00:00' + make_interval(0,0,0,id)"))
    verdicts = spark.createDataFrame([(1, "SCAM"), (2, "SCAM"), (3, "SAFE"), (4, "odd"), (5, "SUSPICIOUS")], "event_id int, verdict string")
    parents = spark.createDataFrame([("mom",), ("dad",), ("aunt",)], "id string")
    tiles = {r.parent_id: [r.SCAM, r.SUSPICIOUS, r.SAFE, r.UNKNOWN] for r in store.parent_tiles(parents, store.verdicts_with_parent(verdicts, events)).collect()}
    assert tiles == {"mom": [2, 0, 1, 0], "dad": [0, 1, 0, 1], "aunt": [0, 0, 0, 0]}
    feedback = spark.createDataFrame([(1,), (2,), (4,)], "event_id int")
    assert [r.id for r in store.pending_feedback(events, verdicts, feedback).collect()] == [5, 3]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(1, "p", "2026-01-01 10:00:00", "sms", "share the OTP now", None), (2, "p", "2026-01-01 11:00:00", "sms", "get http://evil.xyz/app.apk", None), (3, "p", "2026-01-02 10:00:00", "sms", None, None)]
    src = tmp_path / "in"
    df = spark.createDataFrame(rows, "id int, parent_id string, created_at string, channel string, text string, sender string").withColumn("created_at", F.to_timestamp("created_at"))
    df.write.parquet(str(src))
    sent, parents = [], spark.createDataFrame([("p", "Ann")], "id string, name string")
    q = online.start(spark.readStream.schema(df.schema).parquet(str(src)), str(tmp_path / "store"), str(tmp_path / "cp"), parents, lambda a: sent.extend(r.body for r in a.collect()))
    q.awaitTermination()
    got = {r.id: r.verdict for r in online.stored(spark, str(tmp_path / "store")).collect()}
    assert got == {r.id: r.verdict for r in online.check_messages(df).collect()} == {1: "SUSPICIOUS", 2: "SCAM", 3: "UNKNOWN"}
    assert len(sent) == 1 and "evil" not in sent[0]
    assert online.day_counts(online.check_messages(df)).count() == 3


def test_entry_and_names(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
