"""The translation step: cache probe, model calls on the misses, one retry, flags, cache upsert.

A model is a callable of (system, user, temperature) that returns text; it must be picklable and is called in
Arrow batches, a partition at a time. Everything else stays in expressions.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T

# Version and rules of the prompt.
PROMPT_VERSION = "2"
SEVERE = [T.EMPTY, T.SAME, T.ENGLISH_LEFT]
AGENT_MISSING = "Agent chưa dịch đoạn này"
FIRST_HEAT, RETRY_HEAT = 0.2, 0.6

Model = Callable[[str, str, float], str]


class ModelError(RuntimeError):
    """A model call that won't succeed by repeating it."""


class Busy(RuntimeError):
    """A model that asks to wait."""


def persistent(model: Model, attempts: int = 3, pause: Callable[[float], None] = time.sleep) -> Model:
    """The model with repeated calls: after Busy a longer pause, after an empty answer, a timeout or a broken link a short one. ModelError and a refused connection end at once."""

    def call(system: str, user: str, temperature: float) -> str:
        last: Exception | None = None
        for turn in range(1, attempts + 1):
            try:
                answer = model(system, user, temperature)
                if answer.strip():
                    return answer
                last = ModelError("empty answer")
            except (ModelError, ConnectionRefusedError) as e:
                raise ModelError(str(e)) from e
            except Busy as e:
                last = e
                pause(min(60, 10 * turn))
                continue
            except (TimeoutError, ConnectionError) as e:
                last = e
            pause(2 * turn)
        raise ModelError(str(last))

    return call


def stub(system: str, user: str, temperature: float) -> str:
    """A pure stand-in for tests: ASCII words of the source become "từ", terms follow, numbers stay."""
    source = user.split("<SOURCE>\n", 1)[1].rsplit("\n</SOURCE>", 1)[0]
    terms = re.findall(r"^- .*? -> (.*?)(?: \(.*\))?$", user.split("</TERMS>")[0], re.M) if "<TERMS>" in user else []
    return " ".join([re.sub("[A-Za-z]+", "từ", source), *terms])


def answers(rows: DataFrame, model: Model, system: str, temperature: float) -> DataFrame:
    """rows (key, user) with dst: cleaned answers of the model, one call a row, as many at once as there are tasks. A failing call fails the task, and so the job."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = persistent(model)
        for f in frames:
            yield pd.DataFrame({"key": f.key, "raw": [call(system, u, temperature) for u in f.user]})

    return rows.select("key", "user").mapInPandas(run, "key string, raw string").select("key", T.clean_output(F.col("raw")).alias("dst"))


def finished(kind: Column, dst: Column) -> Column:
    """An answer as it is kept: short kinds on one line, references in Vietnamese."""
    return T.fix_references(F.when(kind.isin("heading", "caption", "cell", "label"), F.trim(F.regexp_replace(dst, r"(?U)\s+", " "))).otherwise(dst))


def prompts(segments: DataFrame, identity: str, system: str = "") -> DataFrame:
    """segments with user, the prompt, and key, under which its translation is cached. terms may be absent."""
    terms = F.col("terms") if "terms" in segments.columns else None
    user = T.prompt(F.col("text"), F.col("kind"), F.col("section"), F.col("previous"), terms)
    return segments.withColumn("user", user).withColumn("key", T.cache_key(F.lit(PROMPT_VERSION), F.lit(identity), F.lit(system), F.col("user")))


def _list_lines(answer: Column) -> Column:
    lines = F.filter(F.split(answer, "\n"), lambda x: T.strip(x) != "")
    return F.transform(lines, lambda x: T.strip(F.regexp_replace(x, r"^[-•*·]\s*", "")))


def _whole_lists(segments: DataFrame, first: DataFrame, model: Model, system: str, temperature: float, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """key, dst of lists: the answer's lines where there are as many as in the source, else each item translated alone as a paragraph."""
    lists = segments.where("kind = 'list'").join(first, "key").withColumn("lines", _list_lines(F.col("dst")))
    fits = F.size("lines") == F.size(F.split("text", "\n"))
    items = lists.where(~fits).select("key", "section", *(["terms"] if "terms" in segments.columns else []), F.posexplode(F.split("text", "\n")).alias("pos", "item"))
    terms = F.col("terms") if "terms" in segments.columns else None
    asked = items.select(F.concat_ws("\x1f", "key", F.col("pos").cast("string")).alias("key"), T.prompt(F.col("item"), F.lit("para"), F.col("section"), F.lit(""), terms).alias("user"))
    told = keep(answers(asked, model, system, temperature), "items").select(F.substring_index("key", "\x1f", 1).alias("key"), F.substring_index("key", "\x1f", -1).cast("int").alias("pos"), F.replace("dst", F.lit("\n"), F.lit(" ")).alias("dst"))
    joined = told.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("pos", "dst"))).alias("d")).select("key", F.array_join(F.transform("d", lambda x: x["dst"]), "\n").alias("dst"))  # a list's items
    return lists.where(fits).select("key", F.array_join("lines", "\n").alias("dst")).unionByName(joined)


def translate(segments: DataFrame, cache: DataFrame, model: Model, identity: str, keep: Callable[[DataFrame, str], DataFrame], system: str = "") -> tuple[DataFrame, DataFrame]:
    """(segments with dst, flags and cached; cache rows to add: key, dst).

    Cached prompts cost no call, equal prompts one. A translation with a severe flag is asked for once more at
    a higher temperature, and the second one is taken if it has fewer flags. keep(df, name) writes a table
    and reads it again, so that no model call is made twice.
    """
    asked = prompts(segments, identity, system)
    missing = keep(asked.join(cache.select("key"), "key", "left_anti").dropDuplicates(["key"]), "missing")
    required = F.col("terms") if "terms" in segments.columns else None

    def attempt(rows: DataFrame, temperature: float, name: str) -> DataFrame:
        first = keep(answers(rows, model, system, temperature), f"{name}_answers")
        plain = rows.where("kind <> 'list'").join(first, "key").select("key", "dst")
        whole = plain.unionByName(_whole_lists(rows, first, model, system, temperature, lambda df, n: keep(df, f"{name}_{n}")))
        done = rows.join(whole, "key").withColumn("dst", finished(F.col("kind"), F.col("dst")))
        return keep(done.withColumn("flags", T.flags(F.col("text"), F.col("dst"), F.col("kind"), required)), name)

    one = attempt(missing, FIRST_HEAT, "first")
    severe = F.exists("flags", lambda f: f.isin(SEVERE))
    two = attempt(one.where(severe).select(*missing.columns), RETRY_HEAT, "second").select("key", F.col("dst").alias("dst2"), F.size("flags").alias("n2"))
    fresh = one.join(two, "key", "left").select("key", F.when(F.col("n2") < F.size("flags"), F.col("dst2")).otherwise(F.col("dst")).alias("dst"))
    told = cache.select("key", "dst", F.lit(True).alias("cached")).unionByName(fresh.withColumn("cached", F.lit(False)))
    done = asked.join(told, "key").withColumn("flags", T.flags(F.col("text"), F.col("dst"), F.col("kind"), required))
    return done.drop("user"), fresh


def with_upserts(cache: DataFrame, more: DataFrame) -> DataFrame:
    """key, dst: the cache with rows of more in place of those of equal key; of more's equal keys the greatest dst."""
    both = cache.select("key", "dst", F.lit(0).alias("turn")).unionByName(more.select("key", "dst", F.lit(1).alias("turn")))
    return both.groupBy("key").agg(F.max_by("dst", F.struct("turn", "dst")).alias("dst"))


def with_agent(segments: DataFrame, told: DataFrame) -> DataFrame:
    """segments with dst and flags from agent translations (doc_id, id, dst): references fixed and checked anew; one without a translation has that flag alone."""
    required = F.col("terms") if "terms" in segments.columns else None
    rows = segments.join(told.select("doc_id", "id", F.col("dst").alias("told_")), ["doc_id", "id"], "left")
    rows = rows.withColumn("dst", F.coalesce(T.fix_references(F.col("told_")), F.lit(""))).drop("told_")
    checked = T.flags(F.col("text"), F.col("dst"), F.col("kind"), required)
    return rows.withColumn("flags", F.when(F.col("dst") == "", F.array(F.lit(AGENT_MISSING))).otherwise(checked))


def counters(segments: DataFrame) -> DataFrame:
    """doc_id, segments, done, cached, flagged, missing."""
    empty = F.coalesce("dst", F.lit("")) == ""
    cached = F.col("cached") if "cached" in segments.columns else F.lit(False)
    return segments.groupBy("doc_id").agg(F.count("*").alias("segments"), F.count_if(~empty).alias("done"), F.count_if(cached).alias("cached"), F.count_if(F.size("flags") > 0).alias("flagged"), F.count_if(empty).alias("missing"))


def review_report(segments: DataFrame, most: int = 300) -> DataFrame:
    """The first segments with flags by doc_id and id, as many as the report shows."""
    return segments.where(F.size("flags") > 0).orderBy("doc_id", "id").limit(most)


def job_list(jobs: DataFrame, kind: str | None = None) -> DataFrame:
    """jobs: id, kind, created. Those of a kind, or all, the latest first, then by id."""
    return (jobs if kind is None else jobs.where(F.col("kind") == kind)).orderBy(F.desc("created"), "id")


def cache_size(cache: DataFrame) -> DataFrame:
    """rows: how many translations the cache holds, as told before it is cleared."""
    return cache.agg(F.count("*").alias("rows"))
