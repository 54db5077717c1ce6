"""Supplier price sheets from many files in one plan.

A file is a row (file, content); nothing below reads a path, so the same functions serve batch, streams and tests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tankline.functions import exprs
from tankline.operators.filters import PRICE_COLUMNS, ifta_net, validate_prices

# The header of a sheet, and our names of its columns.
HEADER = ["SITE", "NAME", "CITY", "STATE", "PROD", "COST", "FEDERAL TAX", "STATE TAX", "SALES TAX", "FREIGHT", "OTHER", "TOTAL COST", "RETAIL PRICE", "YOUR PRICE", "SAVINGS"]
COLUMNS = ["site", "name", "city", "state", "prod", *PRICE_COLUMNS]
DATE_LABEL = "EFFECTIVE DATE:"


def read_files(spark: SparkSession, folder: str, pattern: str = "*.csv") -> DataFrame:
    """Whole files of a folder; order doesn't matter."""
    rows = spark.read.text(folder, wholetext=True, pathGlobFilter=pattern)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("content"))


def cells(line: Column) -> Column:
    """The fields of a CSV line: quotes around fields and doubled quotes inside."""
    raw = F.regexp_extract_all(line, F.lit(r'(?:^|,)("(?:[^"]|"")*"|[^,]*)'), F.lit(1))
    quoted = F.transform(raw, lambda c: F.when(c.startswith('"'), F.replace(F.regexp_replace(c, r'^"|"\s*$', ""), F.lit('""'), F.lit('"'))).otherwise(c))
    return F.when(line.contains('"') | line.startswith(","), quoted).otherwise(F.split(line, ",", -1))


def plain_text() -> Column:
    """A file's content without its mark of byte order, and with one kind of line end."""
    return F.regexp_replace(F.regexp_replace("content", "^﻿", ""), r"\r\n?", "\n")


def lines(files: DataFrame) -> DataFrame:
    """Non-blank lines numbered from one, with their fields; a file without any has none."""
    kept = F.filter(F.split(plain_text(), "\n"), lambda x: F.trim(x) != "")
    return files.select("file", F.posexplode(kept).alias("at", "line")).select("file", (F.col("at") + 1).alias("line_number"), cells(F.col("line")).alias("fields"))


def labelled_value(fields: Column, label: str) -> Column:
    """S3: the cell after a label, or null where it is missing or blank."""
    clean = F.transform(fields, exprs.clean_header)
    at = F.array_position(clean, label)
    value = F.trim(F.try_element_at(fields, (at + 1).cast("int")))
    return F.when((at > 0) & (value != ""), value)


def header_matches(fields: Column, expected: list[str], prefix: bool = False) -> Column:
    """The header after trimming, upper case and collapsed spaces; a prefix may match alone."""
    clean = F.transform(fields, exprs.clean_header)
    clean = F.slice(clean, 1, len(expected)) if prefix else clean
    return clean == F.array(*[F.lit(x) for x in expected])


def parse(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(file_status, rows).  A bad file is a status, not an exception: EMPTY_FILE, NO_EFFECTIVE_DATE, BAD_HEADER,
    RAGGED_ROW or OK; rows of bad files are left out."""
    every = lines(files)
    facts = every.groupBy("file").agg(
        F.count("*").alias("n"), F.max(F.when(F.col("line_number") == 1, labelled_value(F.col("fields"), DATE_LABEL))).alias("day"),
        F.max(F.when(F.col("line_number") == 2, header_matches(F.col("fields"), HEADER))).alias("header"),
        F.count_if((F.col("line_number") > 2) & (F.size("fields") != len(HEADER))).alias("ragged"),
    )
    status = (
        F.when(F.coalesce("n", F.lit(0)) == 0, "EMPTY_FILE").when(exprs.iso_day(F.col("day")).isNull(), "NO_EFFECTIVE_DATE").when(~F.coalesce("header", F.lit(False)), "BAD_HEADER")
        .when(F.col("ragged") > 0, "RAGGED_ROW").otherwise("OK")
    )
    state = files.select("file", F.sha2("content", 256).alias("sha256")).join(facts, "file", "left").select("file", "sha256", status.alias("status"), exprs.iso_day(F.col("day")).alias("valid_on"))
    good = every.where("line_number > 2").join(state.where("status = 'OK'").select("file", "valid_on"), "file")
    return state, good.select("file", "valid_on", "line_number", *[F.trim(F.get("fields", F.lit(i))).alias(c) for i, c in enumerate(COLUMNS)])


def first_copies(state: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files whose hash is new; of equal files in a batch the first by name."""
    place = F.row_number().over(Window.partitionBy("sha256").orderBy("file"))
    return state.withColumn("_r", place).where("_r = 1").drop("_r").join(ledger.select("sha256"), "sha256", "left_anti")


def ingest(files: DataFrame, products: DataFrame, ledger: DataFrame) -> dict[str, DataFrame]:
    """Statuses, accepted typed prices (S20: one a station, product and day, the earliest line) and rejections."""
    state, raw = parse(files)
    new = first_copies(state.where("status = 'OK'"), ledger).select("file")
    checked = validate_prices(raw.join(new, "file", "left_semi"), products)
    good = checked.where("rejection is null").select("file", "valid_on", "line_number", "site", "name", "city", "state", "prod", "product_type", *[F.col(f"{c}_n").alias(c) for c in PRICE_COLUMNS])
    place = F.row_number().over(Window.partitionBy("site", "prod", "valid_on").orderBy("file", "line_number"))
    prices = good.withColumn("_r", place).where("_r = 1").drop("_r").withColumns({"price_pump": F.col("your_price"), "price_ifta_net": ifta_net()})
    rejected = checked.where("rejection is not null").select("file", "line_number", "site", "prod", "rejection.*")
    return {"status": state, "prices": prices, "rejections": rejected, "sites": raw.select("file", "site").distinct()}


def upsert_stations(known: DataFrame, seen: DataFrame) -> DataFrame:
    """Stations (site, name, city, state, last_seen): new ones enter, known ones only move last_seen."""
    s = seen.groupBy("site").agg(F.min_by(F.struct("name", "city", "state"), "valid_on").alias("n"), F.max("valid_on").alias("day"))
    out = known.join(s, "site", "full")
    pick = lambda c: F.coalesce(F.col(c), F.col(f"n.{c}")).alias(c)
    return out.select("site", pick("name"), pick("city"), pick("state"), F.greatest("last_seen", "day").alias("last_seen"))


def insert_once(target: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key the target lacks; appended to it by the caller."""
    return new.dropDuplicates(keys).join(target.select(*keys), keys, "left_anti")


def report(result: dict[str, DataFrame]) -> DataFrame:
    """A row for each file: status, accepted, rejected and unmapped codes."""
    ok = result["prices"].groupBy("file").agg(F.count("*").alias("accepted"))
    bad = result["rejections"].groupBy("file").agg(
        F.count("*").alias("rejected"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("code") == "UNMAPPED_PRODUCT", F.col("prod")))), ",").alias("unmapped")
    )
    return result["status"].select("file", "status", "valid_on").join(ok, "file", "left").join(bad, "file", "left").fillna(0, ["accepted", "rejected"]).fillna("", ["unmapped"])
