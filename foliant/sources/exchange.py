"""JSON lines that go to agents and come back, and saved states."""

from __future__ import annotations

from itertools import chain, count

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T


def lines(spark: SparkSession, path: str) -> DataFrame:
    """file, at, value of the lines of text files under a path; a file is read whole, so that its lines keep their order."""
    files = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), F.col("value").alias("whole"))
    return files.select("file", F.posexplode(F.split("whole", "\n")).alias("at", "value"))


def translations(rows: DataFrame) -> DataFrame:
    """rows: file, at, value, and what else tells jobs apart. id, dst of each segment: the last by file name and line. Lines that aren't a record with a whole id and a dst are left out."""
    more = [c for c in rows.columns if c not in ("file", "at", "value")]
    got = rows.select(*more, "file", "at", F.from_json(T.strip(F.col("value")), "id string, dst string", {"mode": "PERMISSIVE"}).alias("r"))
    good = got.select(*more, "file", "at", F.expr("try_cast(trim(r.id) as bigint)").alias("id"), F.col("r.dst").alias("dst")).where("id is not null and dst is not null")
    return good.groupBy(*more, "id").agg(F.max_by("dst", F.struct("file", "at")).alias("dst"))


_ITEMS = "figure string, items array<struct<en:string,vi:string>>"


def figure_texts(rows: DataFrame) -> DataFrame:
    """figure, pos, en, vi: the last record of each figure by file name and line, items in order; a figure without items has one row with null pos, which tells that it was looked at."""
    more = [c for c in rows.columns if c not in ("file", "at", "value")]
    got = rows.select(*more, "file", "at", F.from_json(T.strip(F.col("value")), _ITEMS, {"mode": "PERMISSIVE"}).alias("r"))
    number = F.expr("try_cast(regexp_extract(r.figure, '([0-9]+)$', 1) as int)")
    good = got.select(*more, "file", "at", number.alias("figure"), F.coalesce("r.items", F.array().cast("array<struct<en:string,vi:string>>")).alias("items")).where("figure is not null")
    last = good.groupBy(*more, "figure").agg(F.max_by("items", F.struct("file", "at")).alias("items"))
    tidy = F.transform(F.filter("items", lambda x: x.isNotNull()), lambda x: F.struct(T.strip(F.coalesce(x["en"], F.lit(""))).alias("en"), T.strip(F.coalesce(x["vi"], F.lit(""))).alias("vi")))
    return last.select(*more, "figure", F.posexplode_outer(F.filter(tidy, lambda x: x["en"] != "")).alias("pos", "x")).select(*more, "figure", "pos", "x.en", "x.vi")


def write_tasks(records: DataFrame, path: str) -> None:
    """Task records (part, id, record) as JSON lines in a folder a part; earlier tasks go, results beside them stay."""
    records.select("part", "id", F.col("record").alias("value")).repartition("part").sortWithinPartitions("part", "id").select("part", "value").write.mode("overwrite").partitionBy("part").text(path)


def save_state(path: str, **tables: DataFrame) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_state(spark: SparkSession, path: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{path}/{n}") for n in names]


def free_name(spark: SparkSession, folder: str, stem: str, endings: tuple[str, ...] = (".vi.md", ".vi.pdf")) -> str:
    """A path in the folder that doesn't exist yet with any ending: the stem, then "stem (2)", "stem (3)" and so on."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    names = chain([stem], (f"{stem} ({n})" for n in count(2)))
    return next(f"{folder}/{x}" for x in names if not any(files.exists(path(f"{folder}/{x}{e}")) for e in endings))
