"""U: gaps, new and vanished keys, differences of snapshots and findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def new_keys(accepted: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Accepted keys that weren't known."""
    return accepted.select(key).distinct().join(known.select(key), key, "left_anti")


def vanished_keys(known: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Known keys that aren't in the file, rejected rows included."""
    return known.select(key).distinct().join(seen.select(key), key, "left_anti")


def gap_ranges(ranges: DataFrame, part: str) -> DataFrame:
    """(part, from_day, to_day) between the first start and the last end of a part's ranges [start_day, end_day] that none covers.

    A sweep over starts with the running latest end.  Ranges are first folded to one for each start, so a part has at most one row a day."""
    one = ranges.where("start_day <= end_day").groupBy(part, "start_day").agg(F.max("end_day").alias("end_day"))
    before = F.max("end_day").over(Window.partitionBy(part).orderBy("start_day").rowsBetween(Window.unboundedPreceding, -1))
    gaps = one.select(part, F.date_add(before, 1).alias("from_day"), F.date_sub("start_day", 1).alias("to_day"))
    return gaps.where("from_day <= to_day")


def days_of(gaps: DataFrame, part: str, day: str) -> DataFrame:
    """The single days of gap ranges."""
    return gaps.select(part, F.explode(F.sequence("from_day", "to_day")).alias(day))


def day_gaps(present: DataFrame, part: str, day: str) -> DataFrame:
    """U4: days between each part's first and last that are missing."""
    return days_of(gap_ranges(present.select(part, F.col(day).alias("start_day"), F.col(day).alias("end_day")), part), part, day)


def coverage_gaps(ranges: DataFrame, part: str) -> DataFrame:
    """Days that no range [start_day, end_day] of a part covers, between its first start and last end."""
    return days_of(gap_ranges(ranges, part), part, "day")


def diff_findings(before: DataFrame, after: DataFrame) -> DataFrame:
    """Findings (rule, subject_id, severity, detail; one for each rule and subject) cleared, appeared or changed: both sides in one exchange."""
    side = lambda rows, name: rows.select("rule", "subject_id", F.struct("severity", "detail").alias("f"), F.lit(name).alias("side"))
    own = lambda name: F.max(F.when(F.col("side") == name, F.col("f")))
    both = side(before, "before").unionByName(side(after, "after")).groupBy("rule", "subject_id").agg(own("before").alias("old"), own("after").alias("new"))
    kind = F.when(F.col("new").isNull(), "cleared").when(F.col("old").isNull(), "appeared").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    return both.withColumn("change", kind).where("change is not null").select("rule", "subject_id", "change")


def diff_snapshots(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Field, before and after (as text) of every field that changed."""
    b = before.select(key, *[F.col(f).cast("string").alias(f"_b_{f}") for f in fields])
    a = after.select(key, *[F.col(f).cast("string").alias(f"_a_{f}") for f in fields])
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"_b_{f}").alias("before"), F.col(f"_a_{f}").alias("after")) for f in fields])
    out = b.join(a, key).select(key, F.explode(cells).alias("c")).select(key, "c.*")
    return out.where(~F.col("before").eqNullSafe(F.col("after")))


def request_hash(*fields: str):
    """One key for one request: the SHA-256 of its canonical JSON."""
    return F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256)


def upsert_routes(known: DataFrame, new: DataFrame, at: str = "computed_at") -> DataFrame:
    """Routes by provider and request; the latest computed of each stays, whether it was known or is new."""
    keyed = known.unionByName(new).withColumn("request_hash", request_hash("provider", "origin", "destination", "via", "truck_spec"))
    keyed = keyed.withColumn("via_hash", F.when(F.size("via") > 0, F.sha2(F.to_json("via"), 256)))
    rest = [c for c in keyed.columns if c not in ("provider", "request_hash")]
    return keyed.groupBy("provider", "request_hash").agg(F.max_by(F.struct(*rest), at).alias("_r")).select("provider", "request_hash", "_r.*")
