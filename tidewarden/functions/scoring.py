"""Predictors and stages as functions from frame to frame.

A system takes items and returns them with a prediction.  Calls to a model are batches
in a Python worker; a failing one is a state of its rows (verdict UNKNOWN, the error's
type), never a failure of the task and never SAFE.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as t

from ..operators import messages, rules, split
from . import text as T
from .vocab import BUILT_IN, Dictionary

System = Callable[[DataFrame], DataFrame]
Work = Callable[[pd.DataFrame], pd.DataFrame]
SYSTEMS: dict[str, System] = {}


def register(name: str, system: System) -> System:
    SYSTEMS[name] = system
    return system


def node(name: str, work: Work, added: str, fallback: Work | None = None) -> System:
    """A stage: ``work`` on batches of rows, which gains the columns ``added`` (a schema).

    ``timings_ms`` (map) gains the stage's milliseconds a row; a batch that raises gains nulls or what
    ``fallback`` gives, and ``name:ErrorType`` in ``errors`` (array).  Both columns are made where absent.
    """

    def stage(df: DataFrame) -> DataFrame:
        gained = t.StructType.fromDDL(added)
        start = df
        if "timings_ms" not in df.columns:
            start = start.withColumn("timings_ms", F.create_map().cast("map<string,long>"))
        if "errors" not in df.columns:
            start = start.withColumn("errors", F.array().cast("array<string>"))
        kept = [f for f in start.schema.fields if f.name not in gained.fieldNames()]
        schema = t.StructType([*kept, *gained.fields])

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                began, error = time.perf_counter(), None
                own = batch[[f.name for f in kept]]
                try:
                    out = work(batch)[gained.fieldNames()]
                except Exception as raised:  # noqa: BLE001  a state of the rows, not of the task
                    error = f"{name}:{type(raised).__name__}"
                    none = pd.DataFrame({f: [None] * len(batch) for f in gained.fieldNames()}, index=batch.index)
                    out = fallback(batch)[gained.fieldNames()] if fallback else none
                ms = int((time.perf_counter() - began) * 1000 / max(len(batch), 1))
                joined = pd.concat([own, out], axis=1)
                joined["timings_ms"] = [{**dict(m if m is not None else {}), name: ms} for m in own["timings_ms"]]
                if error:
                    joined["errors"] = [[*(e if e is not None else []), error] for e in own["errors"]]
                yield joined[[f.name for f in schema.fields]]

        return start.mapInPandas(run, schema)

    return stage


def model_scorer(score: Work, schema: str, again: Work | None = None) -> System:
    """A model call as mapInPandas; ``again`` is tried once more on the rows without p_scam (a stricter prompt, say)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                out = score(batch)
                open_ = out["p_scam"].isna() if "p_scam" in out else None
                if again is not None and open_ is not None and open_.any():
                    out = pd.concat([out[~open_], again(batch[open_.to_numpy()])]).loc[batch.index]
                yield out
            except Exception as error:  # noqa: BLE001  an unreachable model is a row state, not a task failure
                yield batch.assign(p_scam=None, p_safe=None, det_category=None, error=type(error).__name__)

    return lambda df: df.mapInPandas(run, schema)


# -- the systems that are compared ------------------------------------------------
def rules_only(data: Dictionary = BUILT_IN) -> System:
    """The rules' verdict and evidence, without a model."""

    def run(items: DataFrame) -> DataFrame:
        found = items.withColumn("_s", rules.Rules(data).evaluate(T.normalize_message(F.col("text"), F.col("sender"))))
        quotes = F.flatten(F.transform(F.when(F.size("_s.hard") > 0, F.col("_s.hard")).otherwise(F.col("_s.soft")), lambda k: F.element_at("_s.evidence", k)))
        columns = {"verdict": rules.rules_only(F.col("_s.hard"), F.col("_s.soft")), "category": F.lit(None).cast("string"), "quotes": quotes}
        return found.withColumns({f"pred_{k}": c for k, c in columns.items()}).withColumn("error", F.lit(None).cast("string")).drop("_s")

    return run


def prompted(complete: Callable[[list[list[dict]]], list[str]], system: str, shots: DataFrame | None = None) -> System:
    """A chat model: ``complete`` takes the message lists of a batch and gives its replies.

    ``shots``: items shown as examples, in order of ``position``, each with ``user`` and ``assistant``; refused if
    one of them, by id or seed_group, is among the items.
    """
    few = shots.orderBy("position").select("id", "seed_group", "user", "assistant").collect() if shots is not None else []  # six rows
    turns = [m for r in few for m in ({"role": "user", "content": r.user}, {"role": "assistant", "content": r.assistant})]

    def work(batch: pd.DataFrame) -> pd.DataFrame:
        lists = [[{"role": "system", "content": system}, *turns, {"role": "user", "content": u}] for u in batch["user"]]
        return pd.DataFrame({"reply": complete(lists)}, index=batch.index)

    def run(items: DataFrame) -> DataFrame:
        if shots is not None and not split.leaks(shots.select("id", "seed_group"), items.select("id", "seed_group")).isEmpty():
            raise ValueError("examples overlap the evaluated items")
        asked = items.withColumn("user", messages.user_message(F.col("channel"), F.col("sender"), T.sender_status(F.col("sender")), F.col("signals"), F.col("text")))
        replied = node("predict", work, "reply string")(asked).withColumn("_r", messages.parse_reply(F.coalesce("reply", F.lit(""))))
        failed = F.element_at("errors", -1)
        out = {f"pred_{k}": F.col(f"_r.{k}") for k in ("verdict", "category", "quotes")} | {k: F.when(F.col("reply").isNotNull(), F.col(f"_r.{k}")) for k in ("json_valid", "json_parsed")}
        return replied.withColumns(out | {"error": F.when(F.col("reply").isNull() & (F.size("errors") > 0), F.split_part(failed, F.lit(":"), F.lit(2)))}).drop("_r", "reply", "user")

    return run


register("rules_only", rules_only())
