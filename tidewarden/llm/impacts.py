"""Operator 12: ranked lexical search, impact-ordered and score-at-a-time.

1. ``forward``: one pass over the documents counts the terms; of each document its length
   and the counts of the terms that any item asks for are written.  N, L and df are sums
   over it.
2. ``index``: a posting's impact is the exact whole number it adds to a score for one
   occurrence of its term in an item.  Postings are range-partitioned and sorted by
   falling impact, then term: those of one impact lie together, and a round that wants
   impacts from a border upwards reads only the files and row groups that hold them.
3. A first round goes down the top ``FIRST_SHARE`` of the index, adds up the impacts of each
   item and document met, and completes the scores of the ``FIRST_DOCS`` documents of
   most: the k-th best of these is the item's floor, since k documents reach it.
4. Below a border no posting of a term exceeds the term's next impact, so a document not
   met above it scores at most ``rest``, the sum of the item's next impacts.  The item stops at the
   highest border (of ``BORDERS``, which end at 0) where ``rest`` is below ``DEPTH`` times its
   floor, or 0: there it is proved that no document not met can come among its top k
   (below its floor proves it; going a little further leaves far fewer candidates).
5. A second round goes down to each item's own border.  A document met scores at most its
   impacts so far + rest - (next impacts of the terms it was met for); those whose bound
   reaches the floor are candidates, their scores are completed from ``forward`` and
   ranked.  Ties at the floor stay candidates, however many copies share a score.

Terms of the items are broadcast where there are at most ``MAX_TERMS`` (item, term) pairs of
``MAX_BYTES`` bytes, counted first; beyond, documents give all their terms and Spark joins them
with the items' terms by shuffle.  Item numbers, states and candidates are tables, never
collected; the driver sees counts and borders only.

Null texts and texts without a term have no rows and do not count in N.  Every row is a
document: repeated rows and rows of one doc_id are ranked apiece (equal scores by doc_id,
null last, then by place of reading); every row of ``items`` is an item, so an item_id
that occurs twice has two rankings.  A very long text is one document with many counts.
An empty table on either side gives no rows.  Other columns, whatever their names, take
no part.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .forced_bpe import release
from .storage import arrow_rows, materialise
from .tokens import slices

TOP = 10
#: Of the first round: share of the postings, and documents completed for each item.
FIRST_SHARE, FIRST_DOCS = 0.02, 50
#: Borders an item may stop at: so many equal shares of the postings.
BORDERS = 25
#: Part of its floor to which an item's bound must fall: 1 proves enough.
DEPTH = 0.6
MAX_TERMS, MAX_BYTES = 1_000_000, 32 << 20
#: Candidate rows whose numbers are sent to the scan of ``forward``: 8 bytes each.
MAX_ROWS = 1_000_000

# bytes of a term as they are, A-Z in lower case, all others a blank
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


def _utf8(text: Column) -> Column:
    return text.cast("string").cast("binary")


def query_terms(items: DataFrame) -> DataFrame:
    """item (a number of its own for every row), item_id, term, times."""

    def run(batches):
        release()
        for batch in slices(batches):
            for item, item_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                own = sorted(Counter(terms_of(text)).items())
                if own:
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(own)), pa.array([item_id] * len(own), pa.int64()), pa.array([t.decode() for t, _ in own]), pa.array([n for _, n in own])], ["item", "item_id", "term", "times"])

    each = materialise(items.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long").alias("item_id"), _utf8(F.col("text")).alias("text")), "search-items")
    return materialise(each.mapInArrow(run, "item long, item_id long, term string, times long"), "search-terms")


def forward_index(docs: DataFrame, wanted: set[bytes] | None) -> DataFrame:
    """row, doc_id, n, terms, counts of every document with a term; of ``wanted`` terms only, where given."""

    def run(batches):
        release()
        for batch in slices(batches):
            ids, sizes, words, counts, ends = [], [], [], [], [0]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = terms_of(text)
                if found:
                    own = Counter(found if wanted is None else filter(wanted.__contains__, found))
                    ids.append(doc_id)
                    sizes.append(len(found))
                    words += own.keys()
                    counts += own.values()
                    ends.append(len(words))
            ends = pa.array(ends, pa.int32())
            terms = pa.ListArray.from_arrays(ends, pa.array(words, pa.binary()).cast(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), terms, pa.ListArray.from_arrays(ends, pa.array(counts, pa.int64()))], ["doc_id", "n", "terms", "counts"])

    arrow_rows(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _utf8(F.col("text")).alias("text")).mapInArrow(run, "doc_id long, n long, terms array<string>, counts array<long>")
    return materialise(own.select(F.monotonically_increasing_id().alias("row"), "*"), "search-forward")


def _postings(forward: DataFrame, *columns: str) -> DataFrame:
    return forward.select(*columns, F.explode(F.arrays_zip("terms", "counts")).alias("p")).select(*columns, F.col("p.terms").alias("term"), F.col("p.counts").alias("tf"))


def _impact(n_docs: int, n_terms: int) -> Column:
    m = F.expr(f"100 - 75 + (75 * n * {n_docs}L) div {n_terms}L")
    return F.call_function("div", 1_000_000_000 * F.col("tf"), 1000 * F.col("tf") + 8 * m)


def rank(docs: DataFrame, items: DataFrame, top: int = TOP, max_terms: int = MAX_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score of the ``top`` best documents of every item."""
    asked = query_terms(items)
    pairs, size = asked.agg(F.count("*"), F.coalesce(F.sum(F.length("term") + 32), F.lit(0))).first()
    small = pairs <= max_terms and size <= MAX_BYTES
    side = F.broadcast if small else (lambda df: df)  # counted above
    vocabulary = asked.select("term").distinct()
    wanted = {r.term.encode() for r in vocabulary.collect()} if small else None
    forward = forward_index(docs, wanted)
    n_docs, n_terms = forward.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not n_docs or not pairs:
        return asked.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).filter("false")
    postings = _postings(forward, "row", "n")
    if not small:
        postings = postings.join(vocabulary, "term", "left_semi")
    weight = F.floor(1000 * F.log(F.lit(float(2 * n_docs + 2)) / (2 * F.col("df") + 1).cast("double"))).cast("long")
    weights = materialise(postings.groupBy("term").agg(F.count("*").alias("df")).select("term", weight.alias("w")), "search-weights")
    scored = postings.join(side(weights), "term").select((F.col("w") * _impact(n_docs, n_terms)).alias("impact"), "term", "row").filter("impact > 0")
    order = [F.desc("impact"), "term", "row"]
    index = materialise(scored.repartitionByRange(*order).sortWithinPartitions(*order), "search-index")
    completed = _scorer(forward, asked, weights, side, _impact(n_docs, n_terms))
    scores = completed(_candidates(index, asked, side, completed, top))
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row"))
    return scores.withColumn("rank", place).filter(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def _borders(index: DataFrame) -> tuple[int, list[int]]:
    """Of the first round; and the falling ones at which an item may stop, the last 0."""
    shares = [FIRST_SHARE, *(i / BORDERS for i in range(1, BORDERS))]
    first, *found = index.agg(F.percentile_approx("impact", F.array(*[F.lit(1.0 - s) for s in shares]), F.lit(10_000))).first()[0] or [0]
    return int(first), sorted({int(b) for b in found} - {0}, reverse=True) + [0]


def _candidates(index: DataFrame, asked: DataFrame, side, completed, top: int) -> DataFrame:
    """item, row of every document that may be among the item's ``top``."""
    first, borders = _borders(index)
    added = F.sum(F.col("times") * F.col("impact")).alias("part")
    met = index.filter(F.col("impact") >= first).join(side(asked), "term").groupBy("item", "row").agg(added)
    most = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("part"), "row"))
    tried = completed(materialise(met.withColumn("place", most).filter(F.col("place") <= FIRST_DOCS).select("item", "row"), "search-first"))
    best = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "row"))
    floors = tried.withColumn("place", best).filter(F.col("place") == top).select("item", F.col("score").alias("floor"))

    below = index.groupBy("term").agg(F.array(*[F.coalesce(F.max(F.when(F.col("impact") < b, F.col("impact"))), F.lit(0)) for b in borders]).alias("next"))
    terms = asked.select("item", "term", "times").join(below, "term", "left")
    rest = terms.groupBy("item").agg(F.array(*[F.coalesce(F.sum(F.col("times") * F.col("next")[i]), F.lit(0)) for i in range(len(borders))]).alias("rests"))
    stop = F.array_position(F.transform("rests", lambda r: (r < F.col("floor") * DEPTH) | (r == 0)), True).cast("int")  # the last one is 0
    state = rest.join(floors, "item", "left").withColumn("floor", F.coalesce("floor", F.lit(0))).withColumn("stop", stop)
    state = materialise(state.select("item", "floor", "stop", F.element_at("rests", F.col("stop")).alias("rest"), F.element_at(F.array(*map(F.lit, borders)), F.col("stop")).cast("long").alias("border")), "search-state")
    own = terms.join(side(state), "item").select("item", "term", "times", "border", (F.col("times") * F.coalesce(F.element_at("next", F.col("stop")), F.lit(0))).alias("next"))
    own = materialise(own, "search-round")

    least = own.agg(F.coalesce(F.min("border"), F.lit(0))).first()[0]
    asks = own.withColumnRenamed("term", "asked")
    down = index.filter(F.col("impact") >= least).join(side(asks), (F.col("term") == F.col("asked")) & (F.col("impact") >= F.col("border")))
    met = down.groupBy("item", "row").agg(added, F.sum("next").alias("met")).join(side(state), "item")
    return materialise(met.filter(F.col("part") + F.col("rest") - F.col("met") >= F.col("floor")).select("item", "row"), "search-candidates")


def _scorer(forward: DataFrame, asked: DataFrame, weights: DataFrame, side, impact: Column):
    """A function from (item, row) to whole scores."""

    def completed(chosen: DataFrame) -> DataFrame:
        rows = chosen.select("row").distinct()
        near = F.broadcast if rows.count() <= MAX_ROWS else (lambda df: df)
        own = forward.join(near(rows), "row", "left_semi").join(chosen, "row").select("item", "row", "doc_id", "n", "terms", "counts")
        each = _postings(own, "item", "row", "doc_id", "n").join(side(asked.join(weights, "term")), ["item", "term"])
        return each.groupBy("item", "item_id", "row", "doc_id").agg(F.sum(F.col("times") * F.col("w") * impact).alias("score")).filter("score > 0")

    return completed
