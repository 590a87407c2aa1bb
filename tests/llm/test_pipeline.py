"""The corpus pipeline stage by stage against the operators' own decisions, and over odd rows."""

from pyspark.sql import functions as F

import corpus_pipeline as P
from tidewarden.llm import bytecnn, language, secrets, simhash
from tidewarden.llm.storage import materialise


def test_stages(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    odd = docs.limit(3).unionByName(docs.limit(2).withColumn("text", F.lit(None).cast("string"))).unionByName(docs.limit(1).withColumn("doc_id", F.lit(77777).cast("long")).withColumn("text", F.lit("password = hunter2222 " * 20 + "and the of to in is for with")))
    now, columns = materialise(docs.unionByName(odd), "in"), docs.columns
    seen = {}
    for name, stage in P.STAGES[:-1]:
        out = materialise(stage(spark, now, tiny), "out")
        assert out.columns == columns
        seen[name] = (now.collect(), out.collect())
        now = out
    before, after = seen["quality classifier"]
    net = bytecnn.fit(docs, spark.read.parquet(f"{tiny}/labels.parquet"))
    assert len(after) == sum(net.score(r.text) >= bytecnn.THRESHOLD for r in before)
    before, after = seen["language ID"]
    model = language.fit(docs)
    good = lambda t: model.predict(t)[0] != "und" and model.predict(t)[1] >= P.MIN_LANGUAGE_SCORE
    assert len(after) == sum(good(r.text) for r in before)
    before, after = seen["SimHash near-dedup"]
    classes = simhash.near_duplicates(spark.createDataFrame(before, docs.schema)).select("component_id").distinct().collect()
    assert {r.doc_id for r in after} == {r.component_id for r in classes} and len(after) == len(classes), (len(after), len(classes))
    before, after = seen["secret scans"]
    tag = secrets.tagger()
    want = {(r.doc_id, secrets.mask(r.text, secrets.scan(r.text, tag))) for r in before}
    assert {(r.doc_id, r.text) for r in after} == want and all(r.n_chars == len(r.text) for r in after)
    placed = P.STAGES[-1][1](spark, now, tiny)
    assert placed.select("doc_id").distinct().count() == now.count()


def test_run_and_labels(spark, tiny):
    found = P.run(spark, tiny)
    assert found.count() > 0 and P.ORACLE_SQL is None and len(P.STAGES) == 5
    clean = spark.read.parquet(f"{tiny}/labels.parquet").filter("quality = 1 and toxic = 0")
    lost = clean.join(found.select("doc_id").distinct(), "doc_id", "left_anti").count()
    assert lost <= 0.25 * clean.count()  # near copies go, clean documents stay


def test_stages_hand_on_any_columns_and_no_rows(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").limit(60)
    names = ["_id", "_none", "_own", "_n", "_quality", "_probability", "_language", "_read", "row", "whole", "fingerprint", "score", "a.b", "`x`"]
    long = docs.limit(1).withColumns({"doc_id": F.lit(90_001).cast("long"), "text": F.repeat(F.lit("und die der von mit. the of and to in "), 20_000)})
    odd = docs.limit(1).withColumns({"doc_id": F.lit(None).cast("long"), "text": F.lit("")})
    rows = docs.unionByName(long).unionByName(odd).withColumns({n: F.lit(k) for k, n in enumerate(names)})
    for now in (materialise(rows, "wide"), materialise(rows.filter("false"), "none")):
        for _, stage in P.STAGES[:-1]:
            now = materialise(stage(spark, now, tiny), "out")
            assert now.columns == rows.columns
            assert all(tuple(r)[-len(names) :] == tuple(range(len(names))) for r in now.collect())
        assert (now.count() > 0) == (P.STAGES[-1][1](spark, now, tiny).count() > 0)
