import itertools

from pyspark.sql import functions as F

from tidewarden.operators import dedupe, messages, split


def grams(t):
    t = t.lower()
    return {t[i : i + 5] for i in range(max(1, len(t) - 4))}


def alike(a, b):
    x, y = grams(a), grams(b)
    return 5 * len(x & y) >= 4 * len(x | y)


def test_similarity_against_brute_force(spark, tiny):
    texts = [r.text[:300] for r in spark.read.parquet(f"{tiny}/documents.parquet").orderBy("doc_id").limit(60).collect()]
    texts += [t + " tail" for t in texts[:15]] + texts[:5] + ["", "a", "abcdef"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    ids, pairs = dedupe.similar_sets(df)
    of = {r.id: r.set_id for r in ids.collect()}
    found = {frozenset((r.a, r.b)) for r in pairs.collect()}
    for (i, a), (j, b) in itertools.combinations(enumerate(texts), 2):
        assert (of[i] == of[j] or frozenset((of[i], of[j])) in found) == alike(a, b), (a, b)


def test_sets_meet_by_size_and_parity_without_loss_or_postings(spark, monkeypatch):
    monkeypatch.setattr(dedupe, "CELL_PAIRS", 3)
    base = "".join(chr(97 + (i * i * 7 + i // 3) % 26) for i in range(400))
    texts = [base[:n] for n in range(40, 401, 6)] + [base[:150] + c * 5 + base[150:300] for c in "qxz"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    ids, pairs = dedupe.similar_sets(df)
    of = {r.id: r.set_id for r in ids.collect()}
    found = [(r.a, r.b) for r in pairs.collect()]
    want = {tuple(sorted((of[i], of[j]))) for (i, a), (j, b) in itertools.combinations(enumerate(texts), 2) if of[i] != of[j] and alike(a, b)}
    assert len(found) == len(set(found)) and set(found) == want
    # shingle lists made the written table several times the text; signs of a fixed share of it do not
    assert "keys" not in dedupe._signed(df, F.col("id"), "text", None, (4, 5)).columns
    bounds = dedupe._bounds(10_000, (4, 5))
    assert all(bounds[k + 2] > (bounds[k + 1] - 1) * 5 / 4 for k in range(1, len(bounds) - 2))


def test_cells_lose_no_pair_and_compare_the_bits_of_few(monkeypatch):
    import random

    import numpy as np

    monkeypatch.setattr(dedupe, "TILE", 16)  # several groups and tiles
    draw, texts = random.Random(5), []
    for letters in ("abcdefghijkl", "mnopqrstuvwxyz"):  # as of two languages
        words = ["".join(draw.choices(letters, k=draw.randint(2, 9))) for _ in range(500)]
        for _ in range(70):
            texts.append(own := draw.choices(words, k=draw.randint(135, 165)))
            texts += [[draw.choice(words) if draw.random() < p else w for w in own] for p in (0.01, 0.05, 0.07, 0.1) if draw.random() < 0.3]
    sets = [dedupe.gram_hashes(" ".join(t)) for t in texts]
    for k in range(20):  # at the boundary: 400 of 500 shared, and one less
        base = np.random.default_rng(k).integers(0, 2**63, 501, np.uint64) << np.uint64(1)
        sets += [np.sort(base[:450]), np.sort(np.append(base[:400], base[450:500])), np.sort(np.append(base[:399], base[450:501]))]
    n = np.array([len(x) for x in sets])
    above, known = int(n.max()) + 1, np.unique(np.concatenate(sets))
    holds = np.array([np.isin(known, x) for x in sets], np.float32)
    both = (holds @ holds.T).astype(int)
    words, packed = dedupe._words(above, (4, 5)), np.array([np.frombuffer(dedupe._counts(x, dedupe._buckets(above)), np.uint8) for x in sets])
    bits = np.array([np.frombuffer(dedupe._parity(x, words), np.uint64) for x in sets])
    order, pairs = np.random.default_rng(0).permutation(len(n)), list(itertools.combinations(range(len(n)), 2))
    want = {(i, j) for i, j in pairs if 5 * both[i, j] >= 4 * (n[i] + n[j] - both[i, j])}
    fits = sum(4 * n[i] <= 5 * n[j] and 4 * n[j] <= 5 * n[i] for i, j in pairs)
    compared = []
    for meetings in ([(order, order, True)], [(order[::2], order[::2], True), (order[::2], order[1::2], False), (order[1::2], order[1::2], True)]):
        cell = dedupe._Cell(n, bits, np.stack([packed & 15, packed >> 4], axis=2).reshape(len(n), -1), (4, 5))
        looked = cell.pairs
        cell.pairs = lambda a, b, looked=looked: (compared.append(len(a)), looked(a, b))
        for x in meetings:
            cell.meet(*x)
        found = [tuple(sorted(x)) for a, b in cell.found for x in zip(a.tolist(), b.tolist())]
        assert len(found) == len(set(found)) and want <= set(found) and len(want) > 60
    assert sum(compared) < 2 * 0.1 * fits  # all of them were compared before


def test_long_copies_are_compared_in_a_glance_and_in_parts(monkeypatch):
    import random
    import time

    import numpy as np

    draw = random.Random(2)
    base = draw.choices("abcdefghij ", k=50_000)
    texts = ["".join(draw.choice("abcdefghij ") if draw.random() < p else c for c in base) for p in [0.005, 0.01, 0.02, 0.05] * 10]
    a, b = np.array(list(itertools.combinations(range(len(texts)), 2))).T
    began = time.process_time()
    keep = dedupe._reached(texts, [None] * len(texts), a, b, (4, 5))
    took = time.process_time() - began
    sets = [dedupe.gram_hashes(t) for t in texts]
    assert 0.1 < keep.mean() < 0.9
    began, want = time.process_time(), []
    for i, j in zip(a, b):  # as every pair was compared before
        both = np.sort(np.concatenate([sets[i], sets[j]]))
        shared = int(np.count_nonzero(both[1:] == both[:-1]))
        want.append(5 * shared >= 4 * (len(sets[i]) + len(sets[j]) - shared))
    assert keep.tolist() == want and took < time.process_time() - began
    monkeypatch.setattr(dedupe, "CELL_CHARS", 150_000)  # three texts a part
    assert (dedupe._reached(texts[:12], [None] * 12, a[b < 12], b[b < 12], (4, 5)) == keep[b < 12]).all()


def test_first_kept_is_greedy_in_string_order(spark):
    base = "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf again"
    rows = [("x-2", base), ("x-10", base + "!"), ("b", base + " now"), ("z", "something else entirely here"), ("c", "unrelated words of another kind"), ("d", None)]
    kept = {r.id for r in dedupe.first_kept(spark.createDataFrame(rows, "id string, text string")).collect()}
    want, texts = [], {k: v or "" for k, v in rows}
    for k in sorted(texts):
        if not any(alike(texts[k], texts[o]) for o in want):
            want.append(k)
    assert kept == set(want)


def test_leakage(spark):
    a = spark.createDataFrame([(1, "hello there my good old friend"), (2, "quite another thing")], "id int, text string")
    b = spark.createDataFrame([("hello there my good old friends",)], "text string")
    assert [r.id for r in dedupe.without_similar(a, b).collect()] == [2]


def test_group_split(spark):
    rows = [(f"{s}{g}{i}", f"{s}-{g}", "SCAM", s) for s in ("lottery_prize", "other_scam", "otp_phishing") for g in range(3) for i in range(6)] + [("solo", "alone", "SAFE", "personal")]
    out = split.split_groups(spark.createDataFrame(rows, "id string, seed_group string, verdict string, category string"), 4, 4).collect()
    dev = {r.seed_group for r in out if r.split == "dev"}
    assert len(dev) == 3 and not dev & {r.seed_group for r in out if r.split == "train"} and "alone" not in dev
    assert all(sum(r.seed_group == g and r.split == "dev" for r in out) <= 4 for g in dev)


def test_group_split_sql_drops_near_copies(spark, tmp_path):
    import duckdb

    from tidewarden.plans import dataset

    # every document of a group is a near copy: but for the drawing, one of each group is left
    body = "one long and quite ordinary sentence that many documents of a group share word for word until the very end "
    docs = [(i, f"{body * 3}{i % 3}", f"s{i % 2}") for i in range(120)]
    spark.createDataFrame(docs, "doc_id long, text string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, i // 10 % 2) for i in range(120)], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    got = {(r.id, r.split) for r in dataset.group_split(spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert got == set(con.sql(dataset.ORACLE["group_split"]).fetchall()) and "dev" in {s for _, s in got}


def test_flags_and_placeholders(spark):
    kind = "id int, verdict string, text string, red_flags array<struct<quote: string, reason: string>>"
    rows = [(1, "SCAM", "code <OTP> here", [("code <OTP>", "asks_otp_or_pin")]), (2, "SCAM", "code <OTP> here", [("<OT", "asks_otp_or_pin")]), (3, "SAFE", "x <ACCT>", [])]
    out = {r.id: r for r in split.fill_placeholders(spark.createDataFrame(rows, kind)).collect()}
    assert set(out) == {1, 3} and out[1].red_flags[0].quote in out[1].text and "<" not in out[3].text
    flags = spark.createDataFrame(rows, kind).select("id", messages.clean_flags(F.col("red_flags"), F.col("text")).alias("f")).collect()
    assert flags[2].f is None and len(flags[0].f) == 1


def test_prompt_round_trip_and_scrub(spark):
    df = spark.createDataFrame([("sms", None, "a\nb", {"text": "x", "k": "v"})], "channel string, sender string, text string, m map<string,string>")
    m = df.select(messages.parse_user_message(messages.user_message(F.col("channel"), F.col("sender"), F.lit("unknown"), F.array(F.lit("b"), F.lit("a")), F.col("text"))).alias("m")).first().m
    assert (m.channel, m.sender, m.signals, m.text) == ("sms", None, ["a", "b"], "a\nb")
    clean = messages.scrub(df)
    assert clean.columns == ["channel", "m"] and clean.first().m == {"k": "v"}


def test_dev_groups_are_deduped_before_sampling(spark):
    words = lambda seed: " ".join(f"w{(seed * 7919 + i * i * 31) % 9973}" for i in range(30))
    rows = [(f"{g}{i}", g, "SCAM", "x", words(n) + ("" if i % 2 else " ok")) for n, g in enumerate("abcd") for i in range(6)]  # one message, six copies
    rows += [(f"{g}9", g, "SCAM", "x", words(50 + n)) for n, g in enumerate("abcd")] + [("d8", "d", "SCAM", "x", words(0))]  # a's message in another group
    out = split.split_groups(spark.createDataFrame(rows, "id string, seed_group string, verdict string, category string, text string"), 4, 4).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        by.setdefault(r.seed_group, []).append(r)
    dev = {g for g, rs in by.items() if any(r.split == "dev" for r in rs)}
    assert len(dev) >= 2  # raw sizes would have met the quota of four with one group
    for g, rs in by.items():
        kept = sorted(r.id for r in rs if r.split == "dev")
        assert kept == ([] if g not in dev else [f"{g}0", "d8", "d9"] if g == "d" else [f"{g}0", f"{g}9"])
        assert g in dev or {r.split for r in rs} == {"train"}


def test_splits_are_guarded_by_the_job_that_writes_them(spark, tmp_path):
    import pytest

    from tidewarden.sources import jsonl

    rows = [(i, f"g{i % 5}", "dev" if i % 5 == 0 else "train" if i % 5 < 4 else "dropped", f"text {i}") for i in range(50)] + [(100, None, "train", None), (101, None, "dev", "x")]
    make = lambda more: spark.createDataFrame(rows + more, "id int, seed_group string, split string, text string").repartition(3)
    assert jsonl.write_splits(make([]), f"{tmp_path}/good") == {"train": 31, "dev": 11}
    assert spark.read.json(f"{tmp_path}/good").filter("split = 'dev'").count() == 11
    for k, (bad, said) in enumerate([((7, "g2", "train", "again"), "repeated id 7"), ((200, "g0", "train", "leak"), "both splits: g0"), ((9, "g4", "dropped", "again"), "repeated id 9")]):
        with pytest.raises(Exception, match=said):
            jsonl.write_splits(make([bad]), f"{tmp_path}/bad{k}")
        assert not list((tmp_path / f"bad{k}").rglob("part-*.json"))
    assert jsonl.write_splits(make([(300, "g0", "dropped", "x")]), f"{tmp_path}/also") == {"train": 31, "dev": 11}


def test_phrase_places_in_one_part_and_in_many(spark):
    from tidewarden.operators import phrases

    listed = [f"word{i} end" for i in range(40)] + ["pay now", "Pay*", "न", "", None, "pay now"]
    texts = [(1, "PAY  now, payable word7 end"), (2, None), (3, ""), (4, "न नहीं repay now word39 ends"), (4, "pay now")]
    want = {(1, "pay now", 0, 8), (1, "Pay*", 0, 3), (1, "Pay*", 10, 17), (1, "word7 end", 18, 27), (4, "न", 0, 1), (4, "pay now", 0, 7), (4, "Pay*", 0, 3)}
    for most in (1000, 7):
        got = phrases.phrase_places(spark.createDataFrame(texts, "id int, text string").withColumn("phrase", F.lit(1)), spark.createDataFrame([(p,) for p in listed], "phrase string"), most=most)
        assert got.columns == ["id", "phrase", "start", "end"] and sorted(map(tuple, got.collect())) == sorted(want)
    assert phrases.phrase_places(spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame([], "phrase string")).count() == 0


def test_phrase_places_do_not_depend_on_line_ends(spark):
    """A text with line ends is lowered as the phrases are: as a whole."""
    from tidewarden.operators import phrases

    texts = [(1, "\u039f\u0394\u039f\u03a3 x"), (2, "\u039f\u0394\u039f\u03a3\n\nx"), (3, "\n \u0391 \t\u039f\u0394\u039f\u03a3\u2003.")]
    got = phrases.phrase_places(spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame([("\u039f\u0394\u039f\u03a3",)], "phrase string"))
    assert sorted((r.id, r.start, r.end) for r in got.collect()) == [(1, 0, 4), (2, 0, 4), (3, 5, 9)]


def test_phrase_places_beside_a_sign_that_becomes_two():
    """One such sign anywhere lost the text's final sigmas; places are counted in the text as it was, in time that grows with it."""
    import time

    from tidewarden.functions.phrases import PhraseMatcher

    matcher = PhraseMatcher(["\u039f\u0394\u039f\u03a3", "i\u0307z", "k"])
    assert matcher.find("\u0130\u0130 \n\u039f\u0394\u039f\u03a3\u2003x \u0130Z.") == [(4, 8, 0), (11, 13, 1)] == matcher.find("\u0130\u0130  \u039f\u0394\u039f\u03a3 x \u0130Z.")
    began = time.time()
    assert matcher.find("\u0130-" + "k-" * 50_000) == [(2 + 2 * i, 3 + 2 * i, 2) for i in range(50_000)]
    assert time.time() - began < 5


def test_phrase_places_are_handed_on_in_bounded_batches():
    import pyarrow as pa

    from tidewarden.functions.phrases import PhraseMatcher
    from tidewarden.operators import phrases

    batch = pa.RecordBatch.from_pydict({"id": [5, 6, 7, 8], "text": ["k " * 7, None, "", "k k"]})
    got = list(phrases._placed(batch, PhraseMatcher(["k"]), 3))
    assert [b.num_rows for b in got] == [3, 3, 3, 0] and [r["id"] for b in got for r in b.to_pylist()] == [5] * 7 + [8] * 2
    assert [(r["start"], r["end"]) for b in got for r in b.to_pylist()] == [(2 * i, 2 * i + 1) for i in range(7)] + [(0, 1), (2, 3)]


def test_written_tables_can_be_removed(spark):
    from tidewarden.sources import shared

    shared.remove_written(spark)
    frame = shared.materialise(spark.range(5), "gone")
    assert frame.count() == 5 and shared.remove_written(spark) == 1 and shared.remove_written(spark) == 0
    try:
        spark.read.parquet(frame.inputFiles()[0])
        raise AssertionError("still there")
    except Exception as error:  # noqa: BLE001
        assert "PATH_NOT_FOUND" in str(error) or "does not exist" in str(error)
