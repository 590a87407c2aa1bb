"""Dataset building: group split, samples, rates and reports.  No call to a random source: all draws are hashes of ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let
from ..sources.shared import materialise
from . import dedupe


def draw(seed: int, purpose: str, key: Column) -> Column:
    """A fixed number in [0, 1) per seed, purpose and id: 48 bits of SHA-256."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(seed), F.lit(purpose), key.cast("string")), 256), 1, 12), 16, 10).cast("double") / float(1 << 48)


def strata(items: DataFrame) -> DataFrame:
    """seed_group -> stratum: verdict and commonest category (ties alphabetical); SUSPICIOUS is one stratum.

    A group's verdict is that of its first id.
    """
    votes = items.groupBy("seed_group", "category").agg(F.count("*").alias("n"), F.min(F.struct("id", "verdict")).alias("first"))
    groups = votes.groupBy("seed_group").agg(F.min("first").alias("first"), F.min(F.struct((-F.col("n")).alias("n"), "category")).alias("top"))
    return groups.select("seed_group", F.when(F.col("first.verdict") == "SUSPICIOUS", "SUSPICIOUS").otherwise(F.concat_ws("/", "first.verdict", "top.category")).alias("stratum"))


def split_groups(items: DataFrame, dev_per_stratum: int, dev_max_per_group: int, seed: int = 7, text: str = "text") -> DataFrame:
    """Items with column split: dev, train or dropped.

    Per stratum whole groups go to dev, in hashed order, while the items taken so far are
    below the quota, and one group always stays in train; a dev group gives at most
    ``dev_max_per_group`` items, the rest are dropped.  A dev group's items are drawn, and
    the quota is counted, after near copies inside the group are out; only groups that
    the quota can reach are looked at for copies.  Items without the column ``text``
    have no copies.
    """
    by_draw = [draw(seed, "group", F.col("seed_group")), "seed_group"]
    in_stratum = Window.partitionBy("stratum")
    groups = strata(items).withColumns({"place": F.row_number().over(in_stratum.orderBy(*by_draw)), "groups": F.count("*").over(in_stratum)})
    # a group gives one item or more, so the quota is reached within as many groups
    reach = materialise(groups.filter((F.col("place") <= dev_per_stratum) & (F.col("place") < F.col("groups"))).select("seed_group", "stratum"), "reach")
    drawn = items.select("id", "seed_group", *[c for c in (text,) if c in items.columns]).join(reach.select("seed_group"), "seed_group", "left_semi")
    kept = dedupe.first_kept(drawn, "id", text, within="seed_group") if text in items.columns else drawn
    inside = Window.partitionBy("seed_group").orderBy(draw(seed, "item", F.col("id")), "id")
    picked = materialise(kept.select("seed_group", "id").withColumn("_n", F.row_number().over(inside)).filter(F.col("_n") <= dev_max_per_group).select("seed_group", "id"), "picked")
    before = F.coalesce(F.sum("n").over(in_stratum.orderBy(*by_draw).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    dev = picked.groupBy("seed_group").agg(F.count("*").alias("n")).join(reach, "seed_group").withColumn("_before", before).filter(F.col("_before") < dev_per_stratum).select("seed_group")
    chosen = picked.join(dev, "seed_group", "left_semi").select("id", F.lit(True).alias("_picked"))
    rows = items.join(groups.select("seed_group", "stratum"), "seed_group").join(dev.withColumn("_dev", F.lit(True)), "seed_group", "left").join(chosen, "id", "left")
    return rows.withColumn("split", F.when(F.col("_dev").isNull(), "train").when(F.col("_picked"), "dev").otherwise("dropped")).drop("_dev", "_picked")


def shared_groups(train: DataFrame, dev: DataFrame) -> DataFrame:
    """Seed groups in both: must be empty."""
    return train.select("seed_group").intersect(dev.select("seed_group"))


#: Stretches of a hashed order that are sorted apart; each takes rows / BUCKETS of them.
BUCKETS = 4096


def placed(df: DataFrame, u: Column, key: str, buckets: int = BUCKETS) -> DataFrame:
    """Rows with their place (from 0) in the order of a uniform draw and key.

    The draw's stretches are sorted apart; how many rows come before each is summed over
    at most ``buckets`` counts, so no task takes all rows.
    """
    rows = df.withColumn("_u", u).withColumn("_b", F.floor(F.col("_u") * buckets))
    sizes = rows.groupBy("_b").count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(sizes.select("_b", before.alias("_before")))  # ``buckets`` rows at most
    inside = F.row_number().over(Window.partitionBy("_b").orderBy("_u", key)) - 1
    return rows.join(starts, "_b").withColumn("place", F.col("_before") + inside).drop("_u", "_b", "_before")


def shuffled(df: DataFrame, key: str, seed: int, n: int | None = None, batch: int | None = None) -> DataFrame:
    """Rows with their place in a hashed order (the first n) and their batch; the last batch may be short."""
    rows = placed(df, draw(seed, "shuffle", F.col(key)), key)
    rows = rows if n is None else rows.filter(F.col("place") < n)
    return rows if batch is None else rows.withColumn("batch", F.floor(F.col("place") / batch))


def review_sample(df: DataFrame, key: str, share: float = 0.10, seed: int = 7) -> DataFrame:
    """Exactly max(1, round(share * n)) rows."""
    most = max(1, round(df.count() * share))
    return placed(df, draw(seed, "review", F.col(key)), key).filter(F.col("place") < most).drop("place")


def suspects(items: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Per reason for doubt how many of the items have it, and their share; the row of null counts the items with any."""
    named = items.select(F.array_compact(F.array(*[F.when(c, k) for k, c in checks.items()])).alias("reasons"))
    each = named.select(F.explode(F.array_append(F.col("reasons"), F.lit("any"))).alias("reason"), (F.size("reasons") > 0).alias("flagged"))
    counts = each.groupBy("reason").agg(F.count("*").alias("n"), F.count_if("flagged").alias("flagged"))  # a row a reason; of "any": all items, and those flagged
    total = F.max(F.when(F.col("reason") == "any", F.col("n"))).over(Window.partitionBy())
    own = F.when(F.col("reason") == "any", F.col("flagged")).otherwise(F.col("n"))
    return counts.select(F.nullif("reason", F.lit("any")).alias("reason"), own.alias("count"), F.try_divide(own, total).alias("share"))


def leaks(fewshot_rows: DataFrame, items: DataFrame) -> DataFrame:
    """Few-shot rows whose id or seed_group is evaluated, or that have no seed_group: must be empty."""
    by_id = fewshot_rows.join(items.select("id"), "id", "left_semi")
    by_group = fewshot_rows.join(items.select("seed_group"), "seed_group", "left_semi").select(*fewshot_rows.columns)
    return by_id.unionByName(by_group).unionByName(fewshot_rows.filter("seed_group is null")).distinct()


def is_provisional(items: DataFrame) -> DataFrame:
    return items.agg((F.coalesce(F.bool_and(F.col("source") == "synthetic"), F.lit(False)) & (F.count("*") > 0)).alias("provisional"))


# -- variation ---------------------------------------------------------------------
def drop_signals(split: Column, signals: Column, key: Column, rate: float = 0.2, seed: int = 7) -> Column:
    return F.when((split == "train") & (draw(seed, "dropout", key) < rate), F.array().cast("array<string>")).otherwise(signals)


# What stands right before an account's last four digits, and before a reference number.
LAST_FOUR = ("xx", "*", "ending", "ending in", "ending with", "अंतिम")
NUMBERED = ("ref", "id", "no", "no.", "number", "#", "order", "संदर्भ", "संख्या")
_MASK = "<OTP>|<ACCT>"


def _ends_with(words) -> str:
    return "(?iu)(?:" + "|".join(rf"\Q{w}\E" for w in words) + ")"


def placeholder_values(text: Column, key: Column, seed: int = 7) -> Column:
    """A value for each placeholder of a text, by what stands before it: codes of 4 to 6 digits, the last four of an
    account, reference numbers of 6 to 12 digits, else an account half hidden or whole."""
    kinds, before = F.regexp_extract_all(text, F.lit(_MASK), 0), F.split(text, _MASK, -1)

    def value(kind: Column, i: Column) -> Column:
        name = F.concat_ws("|", key.cast("string"), i.cast("string"))
        u = lambda what: draw(seed, what, name)
        size = lambda least, most: F.lit(least) + F.floor(u("size") * (most - least + 1)).cast("int")
        digits = lambda n: F.right(F.lpad(F.floor(u("digits") * 10**12).cast("string"), 12, "0"), n)
        left = F.right(F.get(before, i), F.lit(14))
        account = F.when(u("form") < 1 / 3, F.concat(F.lit("XX"), digits(F.lit(4)))).when(u("form") < 2 / 3, F.concat(F.lit("**"), digits(F.lit(4)))).otherwise(digits(size(6, 12)))
        named = F.when(left.rlike(_ends_with(LAST_FOUR) + r"\s*$"), digits(F.lit(4))).when(left.rlike(_ends_with(NUMBERED) + r"(?U)\W{0,4}$"), digits(size(6, 12)))
        return F.when(kind == "<OTP>", digits(size(4, 6))).otherwise(F.coalesce(named, account))

    return F.transform(kinds, value)


def _filled(text: Column, values: Column) -> Column:
    return F.array_join(F.zip_with(F.split(text, _MASK, -1), values, lambda t, v: F.concat(t, F.coalesce(v, F.lit("")))), "")


def fill_placeholders(items: DataFrame, seed: int = 7) -> DataFrame:
    """<OTP> and <ACCT> become digits that fit what stands before them (``placeholder_values``), the same in text and quotes.

    A quote that cuts a placeholder, or is not in the text, goes; a row that is not SAFE
    and loses all its flags goes too.  Rows without placeholders stay as they are.
    """
    count = lambda c: F.regexp_count(c, F.lit(_MASK))

    def placed_quote(f: Column, text: Column, values: Column) -> Column:
        at = F.instr(text, f["quote"])
        head, tail = F.left(text, at - 1), F.substr(text, at + F.length(f["quote"]))
        whole = (at > 0) & (count(head) + count(f["quote"]) + count(tail) == count(text))
        return F.when(whole, F.struct(_filled(f["quote"], F.slice(values, count(head) + 1, F.greatest(count(f["quote"]), F.lit(0)))).alias("quote"), f["reason"].alias("reason")))

    def new(m: Column) -> Column:
        flags = F.filter(F.transform(m["flags"], lambda f: placed_quote(f, m["text"], m["values"])), lambda f: f.isNotNull())
        return F.struct(_filled(m["text"], m["values"]).alias("text"), flags.alias("flags"))

    both = let(F.struct(F.col("text"), F.col("red_flags").alias("flags"), placeholder_values(F.col("text"), F.col("id"), seed).alias("values")), new)
    rows = items.withColumn("_new", F.when(F.col("text").rlike(_MASK), both).otherwise(F.struct(F.col("text"), F.col("red_flags").alias("flags"))))
    rows = rows.withColumns({"text": F.col("_new.text"), "red_flags": F.col("_new.flags")}).drop("_new")
    return rows.filter((F.col("verdict") == "SAFE") | (F.size("red_flags") > 0))


def planned_jobs(seeds: DataFrame, scenarios: int, variants: int) -> DataFrame:
    """seeds x scenarios x variants, scenario first, with the key that resumes a run."""
    jobs = seeds.select("*", F.explode(F.sequence(F.lit(0), F.lit(scenarios - 1))).alias("scenario")).select("*", F.explode(F.sequence(F.lit(0), F.lit(variants - 1))).alias("variant"))
    return jobs.withColumn("key", F.concat_ws("/", "seed_id", "scenario", "variant"))


def open_jobs(jobs: DataFrame, done: DataFrame) -> DataFrame:
    return jobs.join(done.select("key"), "key", "left_anti")


def with_scenario(variants: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Variants with their scenario's text; those without one have null and are counted, not run."""
    base = scenarios.filter("variant = 0").select("seed_id", "scenario", F.col("text").alias("scenario_text"))
    return variants.join(base, ["seed_id", "scenario"], "left")
