"""The keyed store and the outbox under repeats, late batches and failures; look-alike names against plain distances."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tidewarden.operators import lookalike
from tidewarden.sources.keyed import KeyedStore
from tidewarden.streaming import online

ROW = "id string, at int, v string"


def batches():
    rnd = random.Random(3)
    return {n: [(f"k{rnd.randint(0, 40)}", rnd.randint(0, 500), f"{n}-{i}") for i in range(30)] for n in range(6)}


def wanted(given):
    best = {}
    for n, rows in given.items():
        for k, at, v in rows:
            if k not in best or (at, n) > best[k][:2]:
                best[k] = (at, n, {v})
            elif (at, n) == best[k][:2]:
                best[k][2].add(v)
    return best


@pytest.mark.parametrize("most_files", [2, 100])
def test_store_is_the_same_in_any_order(spark, tmp_path, most_files):
    given = batches()
    want = wanted(given)
    for k, order in enumerate(([0, 1, 2, 3, 4, 5], [5, 2, 2, 0, 4, 1, 3, 0])):
        store = KeyedStore(spark, f"file://{tmp_path}/{k}", "id", "at", buckets=3, most_files=most_files)
        put = [store.upsert(spark.createDataFrame(given[n], ROW), n) for n in order]
        assert sum(put) == 6  # a repeated batch changes nothing
        got = {r.id: (r.at, r.v) for r in store.read().collect()}
        assert set(got) == set(want) and all(at == want[i][0] and v in want[i][2] for i, (at, v) in got.items())
        assert store.version() == 6 and store.read(1).count() <= 30
        assert all(len(own) <= most_files + 1 for own in store.manifest()["files"].values())
        before = sorted(store.read().collect())
        assert store.clean(1) >= (1 if most_files == 2 else 0) and sorted(store.read().collect()) == before


def test_store_of_nothing_and_of_null_orders(spark, tmp_path):
    store = KeyedStore(spark, f"file://{tmp_path}/s", "id", "at")
    with pytest.raises(ValueError):
        store.read()
    store.upsert(spark.createDataFrame([("a", None, "x")], ROW), 0)
    store.upsert(spark.createDataFrame([], ROW), 1)
    assert store.read().first().v == "x"
    store.upsert(spark.createDataFrame([("a", 1, "y"), ("a", None, "z"), (None, 1, "n")], ROW), 2)
    assert {r.id: r.v for r in store.read().collect()} == {"a": "y", None: "n"}


def test_a_second_writer_fails(spark, tmp_path, monkeypatch):
    one, two = (KeyedStore(spark, f"file://{tmp_path}/s", "id", "at") for _ in range(2))
    stale = two.manifest()
    one.upsert(spark.createDataFrame([("a", 1, "x")], ROW), 0)
    monkeypatch.setattr(two, "manifest", lambda version=None: stale)
    with pytest.raises(RuntimeError):
        two.upsert(spark.createDataFrame([("b", 1, "y")], ROW), 1)
    assert [r.id for r in one.read().collect()] == ["a"]


EVENT = "id int, parent_id string, created_at timestamp, channel string, text string, sender string"


def test_alerts_go_out_once(spark, tmp_path):
    """A delivery fails after the store; the restarted stream delivers once, and repeats of the event never do."""
    src, path = tmp_path / "in", str(tmp_path / "store")
    events = spark.createDataFrame([(1, "p", "2026-01-01 10:00:00", "sms", "get http://evil.xyz/app.apk", None), (2, "p", "2026-01-01 11:00:00", "sms", "hello", None)], EVENT.replace("timestamp", "string")).withColumn("created_at", F.to_timestamp("created_at"))
    parents, sent = spark.createDataFrame([("p", "Ann")], "id string, name string"), []
    state = {"down": True}

    def deliver(due):
        if state["down"]:
            raise OSError("no way out")
        sent.extend(r.id for r in due.collect())

    def run():
        online.start(spark.readStream.schema(events.schema).parquet(str(src)), f"file://{path}", str(tmp_path / "cp"), parents, deliver).awaitTermination()

    events.write.parquet(str(src))
    with pytest.raises(Exception):  # noqa: B017
        run()
    assert sent == [] and {r.id: r.verdict for r in online.stored(spark, f"file://{path}").collect()}[1] == "SCAM"
    state["down"] = False
    run()
    assert sent == [1]
    events.write.mode("append").parquet(str(src))  # the same events again, in another batch
    run()
    assert sent == [1] and online.stored(spark, f"file://{path}").count() == 2
    parts = {(r.batch, r.part) for r in online.batch_timings(spark, f"file://{path}").collect()}
    assert {(0, "checks"), (0, "alerts"), (0, "marks"), (1, "checks")} <= parts and (1, "marks") not in parts


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_lookalikes_against_plain_distances(spark):
    rnd = random.Random(5)
    domains = sorted({"".join(rnd.choice("abk") for _ in range(rnd.randint(1, 7))) + rnd.choice([".in", ".com", ".co.in"]) for _ in range(120)})
    names = sorted({d[:i] + rnd.choice(["", "a", "x", "."]) + d[i + rnd.randint(0, 2) :] for d in domains for i in [rnd.randint(0, len(d))]} | set(domains[:5]) | {"a", ""})
    got = {(r.name, r.domain): r.distance for r in lookalike.lookalikes(spark.createDataFrame([(n,) for n in [*names, None, names[3]]], "name string"), spark.createDataFrame([(d,) for d in domains], "domain string")).collect()}
    want = {}
    for n, d in itertools.product(names, domains):
        if n and 1 <= (k := distance(n, d)) <= (1 if len(d.split(".")[0]) <= 4 else 2):
            want[n, d] = k
    assert got == want and len(want) > 50
    rows = lookalike.with_lookalikes(spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, name string"), "name", spark.createDataFrame([(d,) for d in domains], "domain string")).collect()
    assert len(rows) == len(names) and all(r.resembles == min(((k, d) for (n, d), k in want.items() if n == r.name), default=(0, None))[1] for r in rows)
