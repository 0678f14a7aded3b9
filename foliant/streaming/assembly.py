"""Structured Streaming: batches of pages are let out in order as their segments get done; partial results are assembled at any time."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.query import StreamingQuery

from ..sources import exchange


def release_stream(done: DataFrame, needs: DataFrame) -> DataFrame:
    """done: a stream of doc_id, id; needs: a table of doc_id, batch, id (null for a batch that needs nothing). A row doc_id, batch, done for each batch, once every segment that it needs is done and all earlier batches are out.

    State of a document: its batches' missing segments and the next batch to go out. Segments told twice count
    once; those that no batch needs are ignored.
    """
    packed = needs.groupBy("doc_id", "batch").agg(F.collect_set("id").alias("ids")).groupBy("doc_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("batch", "ids")))).alias("needs"))  # a document's segments
    rows = done.select("doc_id", "id").join(packed, "doc_id")

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, following, needed = (set(json.loads(state.get[0])), state.get[1], None) if state.exists else (set(), 0, None)
        for f in frames:
            needed = needed or json.loads(f.needs.iloc[0])
            seen.update(int(i) for i in f.id)
        out = []
        while following < len(needed) and set(needed[following]["ids"]) <= seen:
            out.append((key[0], needed[following]["batch"], len(needed[following]["ids"])))
            following += 1
        state.update((json.dumps(sorted(seen)), following))
        yield pd.DataFrame(out, columns=["doc_id", "batch", "segments"])

    return rows.groupBy("doc_id").applyInPandasWithState(step, "doc_id long, batch int, segments int", "seen string, following int", "append", GroupStateTimeout.NoTimeout)


def flushed(needs: DataFrame, released: DataFrame) -> DataFrame:
    """doc_id, batch, segments of the batches not let out yet: what a forced end still writes."""
    every = needs.groupBy("doc_id", "batch").agg(F.count("id").cast("int").alias("segments"))
    return every.join(released.select("doc_id", "batch"), ["doc_id", "batch"], "left_anti")


def translation_stream(spark: SparkSession, path: str) -> DataFrame:
    """file, at, value of translation files as they appear under a path."""
    files = spark.readStream.format("text").option("wholetext", True).load(path)
    files = files.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), F.col("value").alias("whole"))
    return files.select("file", F.posexplode(F.split("whole", "\n")).alias("at", "value"))


def collect_translations(lines: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Write id, dst, file, at of every good line to a table as it comes, what is there once; the caller waits for the query."""

    def add(batch: DataFrame, number: int) -> None:
        got = batch.select("file", "at", F.from_json(F.trim("value"), "id string, dst string").alias("r"))
        good = got.select(F.expr("try_cast(trim(r.id) as bigint)").alias("id"), F.col("r.dst").alias("dst"), "file", "at").where("id is not null and dst is not null")
        good.write.mode("overwrite").parquet(f"{table}/batch={number}")  # a batch told again writes the same folder

    return lines.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_translations(spark: SparkSession, table: str) -> DataFrame:
    """id, dst: the last by file name and line of all that has come so far."""
    rows = spark.read.schema("id long, dst string, file string, at int, batch long").parquet(table)
    return rows.groupBy("id").agg(F.max_by("dst", F.struct("file", "at")).alias("dst"))


__all__ = ["collect_translations", "exchange", "flushed", "latest_translations", "release_stream", "translation_stream"]
