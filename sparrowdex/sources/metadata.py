"""Metadata from databases: JSON payloads with typed fields, enrichment of documents, incremental sync."""

from __future__ import annotations

import json
import re
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

PREFIX = "dbmeta_"
TYPES = ("KEYWORD", "TEXT", "INT", "LONG", "DATE")
SCHEMA = "struct<fields:array<struct<name:string,type:string,value:string,values:array<string>,faceted:boolean,stored:boolean,searchable:boolean>>>"


def parse_fields(payload: Column) -> Column:
    """Array of {name, type, values, faceted, stored, searchable} of a JSON payload.

    Values that do not fit their type fall out; a field with none left is skipped; an unknown type or a missing name skips the field; null for text that is no such JSON.
    """

    def typed(kind: Column, v: Column) -> Column:
        number = F.when(kind.isin("INT"), v.try_cast("int").cast("string")).when(kind == "LONG", v.try_cast("long").cast("string")).when(kind == "DATE", F.date_format(F.coalesce(v.try_cast("timestamp")), "yyyy-MM-dd'T'HH:mm:ss"))
        return F.when(kind.isin("KEYWORD", "TEXT"), v).otherwise(number)

    def one(f: Column) -> Column:
        kind = F.upper(f["type"])
        values = F.array_compact(F.transform(F.coalesce(f["values"], F.array(f["value"])), lambda v: typed(kind, v)))
        flags = [F.coalesce(f[k], F.lit(k != "faceted")).alias(k) for k in ("faceted", "stored", "searchable")]
        return F.struct(F.concat(F.lit(PREFIX), f["name"]).alias("name"), kind.alias("type"), values.alias("values"), *flags)

    fields = F.from_json(payload, SCHEMA)["fields"]
    return F.filter(F.transform(fields, one), lambda f: f["name"].isNotNull() & f["type"].isin(*TYPES) & (F.size(f["values"]) > 0))


def parse_strict(payload: str) -> list[dict]:
    """One payload on the driver, with an error for a broken structure."""
    data = json.loads(payload)
    if not isinstance(data, dict) or not isinstance(data.get("fields"), list):
        raise ValueError("Metadata needs a 'fields' array")
    for f in data["fields"]:
        if not f.get("name"):
            raise ValueError("A metadata field needs a name")
        if str(f.get("type", "")).upper() not in TYPES:
            raise ValueError(f"Unknown type of metadata field '{f['name']}'")
    return data["fields"]


def sql_template(sql: str) -> tuple[str, list[str]]:
    """Named parameters (:name) as question marks, and their names in order; casts (::) and quoted text stay."""
    names: list[str] = []

    def one(m: re.Match) -> str:
        if m[1]:
            names.append(m[1])
            return "?"
        return m[0]

    return re.sub(r"'(?:[^']|'')*'|::\w+|:([A-Za-z_]\w*)", one, sql), names


def jdbc(spark: SparkSession, url: str, query: str, partition: tuple[str, int, int, int] | None = None, **options) -> DataFrame:
    """A query's rows; `partition` = (column, low, high, parts) reads it in parallel."""
    r = spark.read.format("jdbc").option("url", url).options(**options)
    if partition:
        column, low, high, n = partition
        return r.option("dbtable", f"({query}) t").option("partitionColumn", column).option("lowerBound", low).option("upperBound", high).option("numPartitions", n).load()
    return r.option("query", query).load()


def enrich(docs: DataFrame, rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """docs with the first metadata row of their key, by `order`; documents without one stay. Columns that clash keep the document's; others get PREFIX."""
    first = rows.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(*order))).where("_r = 1").drop("_r")
    fresh = [c for c in first.columns if c != key and PREFIX + c not in docs.columns]
    return docs.join(first.select(key, *[F.col(c).alias(PREFIX + c) for c in fresh]), key, "left")


def changed_since(rows: DataFrame, mark: datetime | None, column: str = "updated_at") -> DataFrame:
    """Rows newer than the mark; without one, all."""
    return rows if mark is None else rows.where(F.col(column) > F.lit(mark))


def affected(docs: DataFrame, changed: DataFrame, key: str, doc_key: str = "doc_id", most: int = 1000) -> DataFrame:
    """Documents that changed rows touch, up to `most` per changed value."""
    met = docs.select(doc_key, key).join(changed.select(key).distinct(), key)
    return met.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(doc_key))).where(F.col("_r") <= most).drop("_r")


def sync(docs: DataFrame, rows: DataFrame, mark: datetime | None, key: str, column: str = "updated_at") -> tuple[DataFrame, datetime | None, dict]:
    """(affected documents, new mark, summary). The mark moves only if something changed."""
    new = changed_since(rows, mark, column)
    top = new.agg(F.max(column)).first()[0]
    hit = affected(docs, new, key)
    return hit, top if top is not None else mark, {"changed": new.count(), "documents": hit.select("doc_id").distinct().count()}


def registry(parsed: DataFrame, column: str = "fields") -> DataFrame:
    """name, type, faceted of all dynamic fields: kept with the index."""
    return parsed.select(F.explode(column).alias("f")).groupBy("f.name").agg(F.min("f.type").alias("type"), F.bool_or("f.faceted").alias("faceted"), F.count("*").alias("documents"))
