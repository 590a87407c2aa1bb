import json

import pytest
from pyspark.sql import functions as F

from tidewarden.sources import jsonl, predictions

SCHEMA = "id int, verdict string, p double, flags array<string>"


def test_write_and_read_back(spark, tmp_path, monkeypatch):
    rows = [(i, "SCAM" if i % 2 else None, i / 7, ["é", "b"] if i % 3 else []) for i in range(500)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("text", F.lit("secret words")).repartition(4)
    folder = f"file://{tmp_path}/cache"
    assert predictions.read_predictions(spark, folder, SCHEMA).count() == 0
    predictions.write_predictions(df, folder)
    back = predictions.read_predictions(spark, folder, SCHEMA)
    assert sorted(tuple(r)[:4] for r in back.collect()) == sorted(rows)
    assert not any("secret" in p.read_text() for p in (tmp_path / "cache").iterdir())
    (tmp_path / "cache" / "part-stray.jsonl").write_text('{"id": 99999}\n')  # of a task whose write was not committed
    assert back.count() == 500
    predictions.write_predictions(df.filter("id < 10").withColumn("verdict", F.lit("SAFE")), folder)
    last = predictions.last_of(predictions.read_predictions(spark, folder, SCHEMA))
    assert last.count() == 500 and last.filter("verdict = 'SAFE'").count() == 10
    wanted = spark.createDataFrame([(7, 0), (3, 1), (444, 2)], "id int, ordinal int")
    assert [r.id for r in predictions.for_ids(last, wanted).orderBy("ordinal").collect()] == [7, 3, 444]
    with pytest.raises(Exception, match="no prediction for id 5000"):
        predictions.for_ids(last, wanted.unionByName(spark.createDataFrame([(5000, 3)], "id int, ordinal int"))).collect()
    with pytest.raises(Exception, match="folder of its own"):
        df.drop("text").write.format("predictions").mode("overwrite").save(folder)


@pytest.mark.parametrize("split", [1, 7, 64, 1 << 20])
def test_pieces_hold_every_line_once(tmp_path, monkeypatch, split):
    monkeypatch.setattr(predictions, "SPLIT", split)
    lines = [json.dumps({"id": i, "v": "x" * (i % 17)}) for i in range(60)]
    (tmp_path / "a.jsonl").write_text("\n".join(lines[:30]) + "\n\n" + "\n".join(lines[30:]))
    (tmp_path / "_commit-1").write_text('{"files": ["a.jsonl"]}')
    from pyspark.sql.types import StructType

    reader = predictions.PredictionReader(StructType.fromDDL("id int, v string, _line string"), f"file://{tmp_path}")
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    assert [r[0] for r in rows] == list(range(60)) and [r[2] for r in rows] == sorted({r[2] for r in rows})


def test_epoch_items_and_cover(spark, tmp_path):
    for run, epoch, ids in (("run-a", 1, (1, 2)), ("run-a", 2, (1,)), ("run-b", 1, (5,))):
        (tmp_path / run).mkdir(exist_ok=True)
        (tmp_path / run / f"epoch-{epoch}.items.jsonl").write_text("".join(json.dumps({"id": i}) + "\n" for i in ids))
    got = {(r.run, r.epoch, r.id) for r in jsonl.read_epoch_items(spark, str(tmp_path), "id int").collect()}
    assert got == {("run-a", 1, 1), ("run-a", 1, 2), ("run-a", 2, 1), ("run-b", 1, 5)}
    cache, wanted = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string"), spark.createDataFrame([(2, 0), (1, 1)], "id int, ordinal int")
    assert [r.v for r in jsonl.covering(cache, wanted).collect()] == ["b", "a"]
    assert jsonl.covering(cache.filter("id = 1"), wanted) is None
    jsonl.write_results({"n": 2}, cache.withColumn("text", F.lit("private")), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out" / "items")).columns == ["id", "v"]
