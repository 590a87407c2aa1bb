"""Operators 11 to 13 against brute force and held-out accuracy."""

import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewarden.llm import impacts, toxicity, whitening
from tidewarden.llm.oracle import ranked_search_sql
from tidewarden.llm.storage import materialise

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# -- 11 -------------------------------------------------------------------------
@pytest.fixture(scope="module")
def model(spark, documents):
    return toxicity.fit(documents, spark.read.parquet(f"{SF}/labels.parquet"))


def slow_score(model, text):
    """Word by word from the fitted weights."""
    import xxhash

    words = [xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), seed=11) for w in re.findall(r"\w+", (text or "").lower())]
    mask, mix = (1 << 64) - 1, [int(v) for v in toxicity._MIX]
    slot = lambda h: (h * mix[0] & mask) >> (64 - toxicity.SLOT_BITS)
    weight = dict(zip(model.slots.tolist(), model.weights.tolist()))
    singles = {slot(h) for h in words}
    pairs = {slot(((a * mix[g] & mask) ^ ((b + (a >> 29)) & mask)) & mask) for g in toxicity.GAPS for a, b in zip(words, words[g:])}
    logit = model.bias + sum(weight.get(s, 0.0) for s in singles) + toxicity.PAIR * sum(weight.get(s, 0.0) for s in pairs)
    return 1 / (1 + math.exp(-max(-30, min(30, logit))))


def test_toxicity_scores_by_brute_force(documents, model, monkeypatch):
    texts = [r.text for r in documents.orderBy("doc_id").limit(60).collect()] + [None, "", " ", "!!", "idiot", "Idiot, SCUM clown", "x" * 5000, "é idiot ü moron " * 400]
    want = [slow_score(model, t) for t in texts]
    assert np.allclose([model.score(t) for t in texts], want, atol=1e-6)
    monkeypatch.setattr(toxicity, "STRETCH", 97)  # pairs go on across stretches
    assert np.allclose([model.score(t) for t in texts], want, atol=1e-6)
    assert want[60] == want[61] == want[62] == want[63]  # the bias alone


def test_toxicity_weights_are_few(model):
    assert 0 < len(model.slots) < 5000 and (np.diff(model.slots) > 0).all() and model.weights.all()


def test_toxicity_held_out(spark, documents, model):
    rows = {r.doc_id: r for r in toxicity.classify(documents, None, model).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for i, r in rows.items())
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.doc_id in rows and rows[r.doc_id].held_out}
    bad, good = ([rows[i].score for i, y in truth.items() if y == v] for v in (1, 0))
    assert np.mean([[b > g for g in good] for b in bad]) > 0.85 and np.mean([g < 0.3 for g in good]) > 0.97 and np.mean([b >= 0.3 for b in bad]) > 0.6


def test_toxicity_learns_forms_of_every_language():
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice(["er", "an", "lo", "ti", "ße", "ñu"]) for _ in range(rnd.randint(1, 4)))
    rude = ["grunz", "schnark", "vilté", "bobaño"]
    text = lambda y, size: " ".join(rnd.choice(rude) if y and rnd.random() < 0.05 else word() for _ in range(size)) + (" " + rnd.choice(rude) if y else "")
    rows = [(i, text(i % 4 == 0, rnd.choice((3, 30, 300))), int(i % 4 == 0)) for i in range(1200)]
    model = toxicity.train(rows[:900])
    assert np.mean([(model.score(t) >= 0.3) == y for _, t, y in rows[900:]]) > 0.98
    assert model.score(text(0, 30_000)) < 0.3 < model.score(text(0, 30_000) + " schnark vilté")  # a long clean text is no evidence


def test_toxicity_odd_rows(spark, documents, model):
    rows = [(1, None), (2, ""), (None, "idiot scum"), (3, "idiot scum"), (3, "idiot scum"), (4, "z" * 3_000_000), (5, "la " * 1_000_000)]
    odd = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"score": F.lit(1), "toxic": F.lit(0), "a.b": F.lit(2)})
    got = toxicity.classify(odd, None, model)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == len(rows)
    assert all(r.held_out for r in got.filter("doc_id is null").collect())
    empty, labels = documents.filter("false"), spark.read.parquet(f"{SF}/labels.parquet")
    assert toxicity.classify(empty, labels).count() == 0
    assert {r.score for r in toxicity.classify(odd, labels.filter("false")).collect()} == {0.0}
    assert {r.score for r in toxicity.classify(documents, labels.filter("toxic = 1")).collect()} == {1.0}


def test_long_texts_are_learned_from_in_stretches(spark):
    from tidewarden.llm import sampling

    rows = [(i, "ab" * 40 + f"{i:06d}" * 200, "x" if i % 2 else "y") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = sampling.labelled_sample(docs, docs, "lang", 50, 300)
    assert len(found) == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(60))
    assert all(len(t) == 300 and t in rows[i][1] for i, t, _ in found) and len({rows[i][1].index(t) for i, t, _ in found}) > 3
    assert {i for i, *_ in sampling.labelled_sample(docs, docs, "lang", 50, 300, (4, 2))} == {i for i in range(60) if zlib.crc32(str(i).encode()) % 4 != 2}


# -- 12 -------------------------------------------------------------------------
def slow_rank(docs, items, top=10):
    """Whole scores of all documents, in whole numbers."""
    pattern = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = lambda t: pattern.findall((t or "").translate(lower))
    own = [(i, Counter(terms(t))) for i, t in docs]
    own = [(i, c) for i, c in own if c]
    n, size = len(own), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    out = []
    for item, text in items:
        asked, scores = Counter(terms(text)), []
        for i, c in own:
            m = 100 - 75 + (75 * sum(c.values()) * n) // size
            s = sum(k * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, k in asked.items() if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, k, None if none else i, -s) for k, (s, none, i) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=str)


def collected(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


@pytest.fixture(scope="module")
def library(spark):
    """Skewed words, copies, ties, long and odd texts."""
    rnd = random.Random(4)
    words = [w + x for w in ("the", "of", "Straße", "x1", "ñu", "Kern", "zeta", "rare") for x in ("", "a", "B", "7", "É")]
    text = lambda size: " ".join(words[min(int(rnd.expovariate(0.15)), len(words) - 1)] for _ in range(size))
    rows = [(i, text(rnd.choice((1, 3, 20, 80, 400)))) for i in range(400)]
    rows += [(1000 + i, rows[7][1]) for i in range(150)] + [(3, rows[3][1]), (None, rows[3][1]), (2000, None), (2001, ""), (2002, " ..!"), (2003, "the " * 50_000), (2004, "q" * 300_000), (2005, "a_b\x00c`d{e zetaÉ")]
    items = [(i, text(rnd.choice((1, 4, 30)))) for i in range(25)] + [(3, "zeta zeta The the the"), (90, None), (91, ""), (92, "unheardof"), (None, "rareB"), (93, rows[7][1])]
    return rows, items


@pytest.mark.parametrize("limit", [impacts.MAX_TERMS, 0])
def test_search_by_brute_force(spark, library, limit):
    rows, items = library
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"row": F.lit(1), "n": F.lit(2), "terms": F.lit(3), "a.b": F.lit(4)}).repartition(3)
    asks = spark.createDataFrame(items, "item_id long, text string").withColumns({"item": F.lit(1), "term": F.lit("x")}).repartition(2)
    assert collected(impacts.rank(docs, asks, max_terms=limit)) == slow_rank(rows, items)


def test_search_stops_before_the_end_of_the_index(spark, monkeypatch):
    """Items of rare terms close above the lowest border, and lose nothing."""
    rnd = random.Random(9)
    texts = [" ".join(["and"] * rnd.randint(1, 4) + [f"w{min(int(rnd.expovariate(0.02)), 400)}" for _ in range(12)]) for i in range(125)]
    rows = [(i, texts[i % 125]) for i in range(1500)]
    items = [(i, "and " + texts[i * 7]) for i in range(12)]
    seen = []
    real = impacts.materialise
    monkeypatch.setattr(impacts, "materialise", lambda df, name: (seen.append((name, real(df, name))), seen[-1][1])[1])
    docs, asks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert collected(impacts.rank(docs, asks)) == slow_rank(rows, items)
    tables = dict(seen)
    assert sum(r.border > 0 for r in tables["search-state"].collect()) >= 3
    assert tables["search-candidates"].count() < 1500 * 12 / 2
    impact = [r.impact for r in tables["search-index"].select("impact").collect()]
    assert impact == sorted(impact, reverse=True)


def test_search_of_nothing(spark, library):
    rows, items = library
    docs, asks = spark.createDataFrame(rows[:5], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert impacts.rank(docs.filter("false"), asks).count() == 0
    assert impacts.rank(docs, asks.filter("false")).count() == 0
    assert impacts.rank(docs.withColumn("text", F.lit(None).cast("string")), asks).count() == 0


def test_search_equals_its_sql(spark, documents):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = sorted(con.sql(ranked_search_sql()).fetchall(), key=str)
    assert collected(impacts.rank(documents, spark.read.parquet(f"{SF}/benchmark.parquet"))) == want


# -- 13 -------------------------------------------------------------------------
def slow_whiten(rows, k=16):
    """Of (vec_id, vector): by a dense eigendecomposition."""
    good = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = {i: [math.floor(64.0 * c) + 1_000_000 for c in v] for i, v in good}
    fit = np.array(sorted({tuple(v) for v in x.values()}), np.int64)
    n, sums = len(fit), [sum(c) for c in zip(*fit.tolist())]
    centred = np.array([[(n * c - s) / n for c, s in zip(v, sums)] for v in fit.tolist()])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    own = {i: (sum((n * c - s) ** 2 for c, s in zip(v, sums)), np.array([(n * c - s) / n for c, s in zip(v, sums)]) @ vectors / np.sqrt(values)) for i, v in x.items()}
    return n, own, values / np.trace(centred.T @ centred / n)


def held_against(got, rows, k=16):
    n, own, shares = slow_whiten(rows, k)
    assert {r.vec_id for r in got} == set(own) and {r.n for r in got} == {n} and len(got) == len(own) * min(k, len(shares))
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-7
    signs = {}
    for r in got:
        deviation, z = own[r.vec_id]
        assert int(r.deviation) == deviation and r.explained == pytest.approx(shares[r.component - 1], rel=1e-9)
        if abs(z[r.component - 1]) > 1e-3:
            signs.setdefault(r.component, set()).add(r.whitened * z[r.component - 1] > 0)
        assert abs(r.whitened) == pytest.approx(abs(z[r.component - 1]), abs=1e-6)
    assert all(len(s) == 1 for s in signs.values())


def test_whitening_of_the_given_vectors(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    held_against(whitening.digest(whitening.whiten(table)).collect(), [(r.vec_id, r.embedding) for r in table.collect()])


def test_whitening_of_a_falling_spectrum_keeps_its_block(spark):
    """Matrix-free: 24 columns of 120 suffice where eigenvalues fall; the certificate is a pass of its own."""
    rng = np.random.default_rng(2)
    turn = np.linalg.qr(rng.normal(size=(120, 120)))[0]
    x = (rng.normal(size=(3000, 120)) * 3000 * 0.6 ** np.arange(120)) @ turn.T
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    found = whitening.fit(materialise(whitening.usable_rows(table).select("x").distinct(), "fit"))
    assert found.block == 24 and found.passes < 20
    held_against(whitening.whiten(table).collect(), rows)


def test_whitening_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=5) * [9, 5, 3, 2, 1]).tolist()) for i in range(300)]
    rows += [(300 + i, rows[0][1]) for i in range(200)]  # copies count once in the fit
    bad = [(900, None), (901, [1.0, None, 1.0, 1.0, 1.0]), (902, [float("nan")] * 5), (903, [float("inf")] + [0.0] * 4), (904, []), (905, [1.0, 2.0])]
    table = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").withColumns({"x": F.lit(1), "n": F.lit(2), "a.b": F.lit(3), "component": F.lit(4)}).repartition(4)
    held_against(whitening.whiten(table).collect(), rows)
    more = table.unionByName(table.filter("vec_id is not null and vec_id < 2")).unionByName(table.filter("vec_id = 5").withColumn("vec_id", F.lit(None).cast("long")))
    assert whitening.whiten(more).count() == 5 * (len(rows) + 3)


def test_whitening_of_little(spark):
    table = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert whitening.whiten(table([])).count() == 0
    assert whitening.whiten(table([(1, [1.0, 2.0])] * 3)).count() == 0  # one distinct vector
    line = whitening.whiten(table([(i, [float(i), 2.0 * i, 7.0]) for i in range(9)])).collect()  # rank one
    assert {r.component for r in line} == {1} and line[0].explained == pytest.approx(1) and line[0].identity_error < 1e-9


def test_deviations_are_exact_at_every_size():
    rnd = random.Random(5)
    for n, most in ((10, 100), (10**6, 10**6), (10**9, 10**7), (10**12, 10**15)):
        x = np.array([[rnd.randint(-most, most) + 1_000_000 for _ in range(7)] for _ in range(20)], np.int64)
        sums = [rnd.randint(n * (1_000_000 - 5), n * (1_000_000 + 5)) for _ in range(7)]
        centre = whitening.Centre(n, np.array([s // n for s in sums]), np.array([s % n for s in sums]))
        assert whitening.deviations(x, centre) == [sum((n * c - s) ** 2 for c, s in zip(v, sums)) for v in x.tolist()]
        assert np.allclose(centre.centred(x), [[(n * c - s) / n for c, s in zip(v, sums)] for v in x.tolist()], rtol=1e-12)
