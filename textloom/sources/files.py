"""Drafts, persona sheets and tone profiles as DataFrames. Paths are always given by the caller.

Null or empty texts have no profiles, sections or items; repeated files give repeated rows, told apart by `path`. Tones or keys that
occur twice in one file keep one of their values. Malformed profiles have no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores, where the scan has fewer splits than those: a small file is one split however long its texts."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.isStreaming or df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def whole(spark: SparkSession, path: str) -> DataFrame:
    """path, text: one row for each whole text file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def drafts(spark: SparkSession, path: str) -> DataFrame:
    return whole(spark, path)


def persona(spark: SparkSession, path: str) -> DataFrame:
    return persona_of(whole(spark, path))


def persona_of(sheets: DataFrame) -> DataFrame:
    """path, section, key, value, position: `- **Key:** value` lines (position null) and numbered items (key null) below `##` headings.
    Sections are found within each sheet, so that several sheets don't mix."""
    heading, item, number = r"^## +(.*?)\s*$", r"^\s*- \*\*(.+?):\*\*\s*(.*)$", r"^\s*(\d+)\. +(.*)$"

    def step(state: Column, line: Column) -> Column:
        section = F.when(line.rlike(heading), F.regexp_extract(line, heading, 1)).otherwise(state["section"])
        field, listed = line.rlike(item), line.rlike(number)
        row = F.struct(
            section.alias("section"), F.when(field, F.regexp_extract(line, item, 1)).alias("key"),
            F.when(field, F.regexp_extract(line, item, 2)).otherwise(F.regexp_extract(line, number, 2)).alias("value"),
            F.when(listed, F.regexp_extract(line, number, 1).try_cast("int")).alias("position"),
        )
        return F.struct(section.alias("section"), F.when(field | listed, F.concat(state["rows"], F.array(row))).otherwise(state["rows"]).alias("rows"))

    start = F.struct(F.lit(None).cast("string").alias("section"), F.array().cast("array<struct<section: string, key: string, value: string, position: int>>").alias("rows"))
    rows = F.aggregate(F.split("text", "\r?\n"), start, step, lambda s: s["rows"])
    return sheets.select("path", F.explode(rows).alias("r")).select("path", "r.*")


def persona_row(items: DataFrame) -> DataFrame:
    """path, and a struct `persona`: fields by key, lists by section in order of position, and what stands in quotes."""
    quotes = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("section", "key", "value"))), lambda x: F.regexp_extract_all(x["value"], F.lit('"([^"]*)"'), F.lit(1))))
    fields = F.map_from_entries(F.collect_list(F.when(F.col("n") == 1, F.struct("key", "value"))))
    lists = items.where("position IS NOT NULL").groupBy("path", "section").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "value"))), lambda x: x["value"]).alias("items"))
    lists = lists.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("section", "items"))).alias("lists"))
    keyed = items.withColumn("n", F.when(F.col("key").isNotNull(), F.row_number().over(_once())))
    rows = keyed.groupBy("path").agg(fields.alias("fields"), quotes.alias("quoted"))
    return rows.join(lists, "path", "left").select("path", F.struct("fields", "lists", "quoted").alias("persona"))


def _once():
    from pyspark.sql import Window

    return Window.partitionBy("path", "key").orderBy("section", "value")


def with_persona(df: DataFrame, persona: DataFrame) -> DataFrame:
    """Every row with the one persona; more than one is an error of the caller's."""
    rows = persona.limit(2).collect()
    if len(rows) > 1:
        raise ValueError("give one persona sheet")
    return df.crossJoin(F.broadcast(persona.select("persona").limit(1)))


def tone_profiles(spark: SparkSession, path: str) -> DataFrame:
    return tones_of(whole(spark, path)).drop("path")


def tones_of(profiles: DataFrame) -> DataFrame:
    """path, tone, label, instructions; lines that start with # are dropped before parsing, custom tones are welcome."""
    text = profiles.select("path", F.regexp_replace("text", r"(?m)^\s*#.*$", "").alias("json"))
    return text.select("path", F.explode(F.from_json("json", "map<string, struct<label: string, instructions: string>>")).alias("tone", "p")).select("path", "tone", "p.*")


def with_tone(df: DataFrame, profiles: DataFrame) -> DataFrame:
    """Each row's profile by its `tone`; rows of unknown tones keep nulls. Catalyst picks the join by the profiles' size."""
    return df.join(profiles, "tone", "left")
