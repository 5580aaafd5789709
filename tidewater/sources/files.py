"""Reading and writing the file formats of the pipeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions.text import epoch_date, find_date


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_review_csv(spark: SparkSession, path: str) -> DataFrame:
    """A review file: header, quoted line breaks, doubled quotes; a byte order mark is dropped from the first name."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8")
    return df.toDF(*[c.lstrip("﻿") for c in df.columns]).na.fill("")


def write_review_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """Known columns in their order, marked for spreadsheet programs by a byte order mark."""
    present = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in columns]
    marked = df.select(present).withColumnRenamed(columns[0], f"﻿{columns[0]}")
    marked.write.mode("overwrite").csv(path, header=True, quote='"', escape='"', encoding="UTF-8")


def append_metrics(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def jsonp_items(body: Column) -> Column:
    """Items (title, url, releaseDate, description) of a JSONP reply; null if it isn't one."""
    inner = F.nullif(F.regexp_extract(body, r"(?s)\((.*)\)", 1), F.lit(""))
    schema = "success struct<list: array<struct<title:string,url:string,releaseDate:string,description:string>>>"
    return F.from_json(F.replace(inner, F.lit("'"), F.lit('"')), schema, {"allowUnquotedControlChars": "true"})["success"]["list"]


def jsonp_rows(pages: DataFrame) -> DataFrame:
    """Notices of JSONP pages (source, body)."""
    rows = pages.select("source", F.posexplode(jsonp_items(F.col("body"))).alias("pos", "i"))
    rows = rows.where("coalesce(i.title, '') <> '' and coalesce(i.url, '') <> ''")
    url = F.replace(F.col("i.url"), F.lit(":80/"), F.lit("/"))
    return rows.select("source", "pos", F.col("i.title").alias("title"), url.alias("url"), F.coalesce("i.releaseDate", F.lit("")).alias("publish_date"), F.coalesce("i.description", F.lit("")).alias("summary"))


def api_rows(pages: DataFrame, url_prefix: str) -> DataFrame:
    """Notices of a JSON API (source, body); a reply with an error number raises."""
    schema = "errno int, data struct<list: array<struct<id:string,title:string,time:string>>>"
    parsed = pages.select("source", F.from_json("body", schema).alias("b"))
    checked = F.when(F.coalesce(F.col("b.errno"), F.lit(-1)) != 0, F.raise_error(F.concat(F.lit("errno "), F.coalesce(F.col("b.errno").cast("string"), F.lit("?"))))).otherwise(F.col("b.data.list"))
    rows = parsed.select("source", F.posexplode(checked).alias("pos", "i"))
    return rows.select("source", "pos", F.col("i.title").alias("title"), F.concat(F.lit(url_prefix), F.col("i.id")).alias("url"), F.substring("i.time", 1, 10).alias("publish_date"))


def search_rows(pages: DataFrame, keyword: str, site: str) -> DataFrame:
    """Notices of search result pages with `results`: source, title, url, summary, account, publish_date."""
    rows = pages.select(F.explode("results").alias("r"))
    href = F.when(F.col("r.href").startswith("/"), F.concat(F.lit(site), F.col("r.href"))).otherwise(F.col("r.href"))
    when = F.coalesce(F.nullif(epoch_date(F.col("r.time_text")), F.lit("")), find_date(F.col("r.time_text")))
    name = F.coalesce(F.nullif(F.col("r.account"), F.lit("")), F.lit(keyword))
    return rows.select(F.concat(F.lit("微信公众号:"), name).alias("source"), F.col("r.title").alias("title"), href.alias("url"), F.col("r.summary").alias("summary"), F.col("r.account").alias("account"), when.alias("publish_date"))
