"""Q2, Q3: stops resolved again after a change of assignments, and the findings of the touched invoices rebuilt or previewed.

An invoice is a billing week.  The days on which two histories of a driver differ (W14) select the stops, these select their weeks, and only
those weeks are read, resolved, checked and written: the folder keeps stops and findings by week, and a write replaces the named weeks alone.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tankline.operators import anomalies, windows


def touched_weeks(stops: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """week_end of every invoice with a stop on a day on which its driver's truck may have changed."""
    span = windows.changed_window(before, after, "driver_id")
    until = F.coalesce("changed_to", F.lit("9999-12-31").cast("date"))
    return stops.join(span, "driver_id").where(F.col("day").between(F.col("changed_from"), until)).select("week_end").distinct()


def resolved(stops: DataFrame, assignments: DataFrame) -> DataFrame:
    """The stops with the trucks that the assignments give them; other columns as they were."""
    return anomalies.resolve_trucks(stops, assignments).select(*stops.columns)


def findings_of(stops: DataFrame, lines: DataFrame, prices: DataFrame, weeks: DataFrame, thresholds: dict[str, dict] | None = None) -> DataFrame:
    """All findings (with their week_end) of the stops of some weeks.  Neighbours in time may lie in the weeks before, which are read too."""
    config = thresholds or anomalies.THRESHOLDS
    reach = math.ceil(config["too_close"]["max_minutes"] / (7 * 24 * 60))
    near = weeks.select(F.explode(F.array(*[F.date_sub("week_end", 7 * k) for k in range(reach + 1)])).alias("week_end")).distinct()
    some = stops.join(near, "week_end", "left_semi")
    found = anomalies.run(some, lines.join(some.select("stop_id"), "stop_id", "left_semi"), prices, config)
    own = stops.join(weeks, "week_end", "left_semi").select(F.col("stop_id").alias("subject_id"), "week_end")
    return found.join(own, "subject_id")


def _write(stops: DataFrame, findings: DataFrame, weeks: DataFrame, folder: str) -> None:
    by_week = stops.join(weeks, "week_end", "left_semi").repartition("week_end")
    by_week.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("week_end").parquet(f"{folder}/stops")
    anomalies.rebuild(findings.withColumnRenamed("week_end", "invoice_id"), weeks.withColumnRenamed("week_end", "invoice_id"), f"{folder}/findings")


def build(stops: DataFrame, lines: DataFrame, prices: DataFrame, assignments: DataFrame, folder: str) -> None:
    """The folder for all weeks."""
    now, weeks = resolved(stops, assignments), stops.select("week_end").distinct()
    _write(now, findings_of(now, lines, prices, weeks), weeks, folder)


def stored(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Stops and findings (with their week_end) of the folder."""
    return spark.read.parquet(f"{folder}/stops"), anomalies.stored_findings(spark, f"{folder}/findings").withColumnRenamed("invoice_id", "week_end")


def moves(old: DataFrame, new: DataFrame) -> DataFrame:
    """Stops whose truck changes: stop_id, before, after."""
    b, a = old.select("stop_id", F.col("truck_id").alias("before")), new.select("stop_id", F.col("truck_id").alias("after"))
    return b.join(a, "stop_id").where(~F.col("before").eqNullSafe(F.col("after")))


def diff_flags(old: DataFrame, new: DataFrame) -> DataFrame:
    """rule, subject_id, change, severity, detail: findings cleared (as they were), appeared and changed (as they are)."""
    side = lambda rows, name: rows.select("rule", "subject_id", F.struct("severity", "detail").alias("f"), F.lit(name).alias("side"))
    own = lambda name: F.max(F.when(F.col("side") == name, F.col("f")))
    both = side(old, "old").unionByName(side(new, "new")).groupBy("rule", "subject_id").agg(own("old").alias("old"), own("new").alias("new"))
    change = F.when(F.col("new").isNull(), "cleared").when(F.col("old").isNull(), "appeared").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    shown = F.coalesce("new", "old")
    return both.withColumn("change", change).where("change is not null").select("rule", "subject_id", "change", shown["severity"].alias("severity"), shown["detail"].alias("detail"))


def preview(folder: str, lines: DataFrame, prices: DataFrame, before: DataFrame, after: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Q3: (moves, flags) that the change would make; nothing is written."""
    stops, findings = stored(lines.sparkSession, folder)
    weeks = touched_weeks(stops, before, after)
    reach = math.ceil(anomalies.THRESHOLDS["too_close"]["max_minutes"] / (7 * 24 * 60))
    near = weeks.select(F.explode(F.array(*[F.date_sub("week_end", 7 * k) for k in range(reach + 1)])).alias("week_end")).distinct()
    now = resolved(stops.join(near, "week_end", "left_semi"), after)
    old = findings.join(weeks, "week_end", "left_semi")
    return moves(stops.join(weeks, "week_end", "left_semi"), now), diff_flags(old, findings_of(now, lines, prices, weeks))


def reresolve(folder: str, lines: DataFrame, prices: DataFrame, before: DataFrame, after: DataFrame, report: str) -> tuple[DataFrame, DataFrame]:
    """Q2: the change made: touched weeks are written again, others keep their files.  What it did is written to the folder `report`
    before (moves, flags), so that it can be read when the old rows are gone.  A second call finds nothing to change."""
    spark = lines.sparkSession
    made = preview(folder, lines, prices, before, after)
    for name, rows in zip(("moves", "flags"), made, strict=True):
        rows.write.mode("overwrite").parquet(f"{report}/{name}")
    stops, _ = stored(spark, folder)
    weeks = touched_weeks(stops, before, after)
    weeks.write.mode("overwrite").parquet(f"{report}/weeks")
    weeks = spark.read.schema(weeks.schema).parquet(f"{report}/weeks")
    # new rows come to the report folder first, as Spark can't write over what it reads
    now = resolved(stops, after)
    now.join(weeks, "week_end", "left_semi").write.mode("overwrite").parquet(f"{report}/stops")
    findings_of(now, lines, prices, weeks).write.mode("overwrite").parquet(f"{report}/findings")
    _write(spark.read.parquet(f"{report}/stops").select(*stops.columns), spark.read.schema("subject_id long, rule string, severity string, detail string, week_end date").parquet(f"{report}/findings"), weeks, folder)
    return tuple(spark.read.schema(rows.schema).parquet(f"{report}/{name}") for name, rows in zip(("moves", "flags"), made, strict=True))
