"""W: gaps between neighbours, stratified choice, running figures, effective-dated histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ALL_BEFORE = (Window.unboundedPreceding, -1)


def too_close(rows: DataFrame, keys: list[str], at: str, event_id: str, minutes: int) -> DataFrame:
    """The later of two neighbouring events of a key that are at most so many minutes apart."""
    w = Window.partitionBy(*keys).orderBy(at, event_id)
    micros = F.unix_micros(at)
    gap = micros - F.lag(F.unix_micros(at)).over(w)
    out = rows.withColumns({"previous_id": F.lag(event_id).over(w), "_gap": gap}).where(F.col("_gap") <= minutes * 60_000_000)
    return out.withColumn("gap_s", F.floor(F.col("_gap") / 1_000_000).cast("bigint")).drop("_gap")


def stratified_top(rows: DataFrame, lane: str, mile: str, price: str, tie: str, k: int = 40, bucket_miles: float = 50.0) -> DataFrame:
    """Round r takes each bucket's r-th cheapest; the budget is k or one for each occupied bucket, whichever is more."""
    b = rows.withColumn("bucket", F.floor(F.col(mile) / bucket_miles).cast("int"))
    order = [F.asc(price), F.asc(mile), F.asc(tie)]
    b = b.withColumn("round", F.row_number().over(Window.partitionBy(lane, "bucket").orderBy(*order)))
    own = Window.partitionBy(lane)
    b = b.withColumn("budget", F.greatest(F.lit(k), F.sum(F.when(F.col("round") == 1, 1).otherwise(0)).over(own)).cast("int"))
    b = b.withColumn("place", F.row_number().over(own.orderBy("round", *order)))
    return b.where("place <= budget").drop("budget")


def change(rows: DataFrame, part: str, order: str, value: str) -> DataFrame:
    """Percent against the row before in the whole series; null if either is null or the earlier is zero."""
    before = F.lag(value).over(Window.partitionBy(part).orderBy(order))
    return rows.withColumn("change_pct", F.when(before > 0, (F.col(value) - before) * 100.0 / before))


def first_and_latest(rows: DataFrame, part: str, order: str, value: str) -> DataFrame:
    """A series' first and latest values that aren't null."""
    known = rows.where(F.col(value).isNotNull())
    return known.groupBy(part).agg(F.min_by(value, order).alias("first_value"), F.max_by(value, order).alias("latest_value"))


def running(rows: DataFrame, part: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """The sum up to and with each row."""
    w = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.sum(value).over(w))


def realize_fuel(stops: DataFrame, lane: str, order: str, start: Column, leg_gallons: str, planned: str) -> DataFrame:
    """Departure i is the larger of what was planned and what arrives.  In closed form the running maximum of
    planned + burnt so far (the start counts as planned before any leg), less what is burnt so far."""
    w = Window.partitionBy(lane).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    burnt = F.sum(leg_gallons).over(w)
    out = stops.withColumn("burnt", burnt)
    level = F.greatest(start, F.max(F.col(planned) + F.col("burnt")).over(w))
    out = out.withColumn("departure", level - F.col("burnt"))
    before = Window.partitionBy(lane).orderBy(order)
    return out.withColumn("arrival", F.coalesce(F.lag("departure").over(before), start) - F.col(leg_gallons))


def reproject(rows: DataFrame, lane: str, order: str, old: str, anchor: str) -> DataFrame:
    """Positions between anchors moved linearly onto the anchors' new positions, clamped to them.

    Both neighbours are found by windows that grow from a lane's start or its end: one that shrinks would be read anew for every row."""
    back, ahead = (Window.partitionBy(lane).orderBy(o).rangeBetween(Window.unboundedPreceding, 0) for o in (order, F.desc(order)))
    at = F.when(F.col(anchor).isNotNull(), F.col(old))
    lo_old, lo_new = F.last(at, True).over(back), F.last(anchor, True).over(back)
    hi_old, hi_new = F.last(at, True).over(ahead), F.last(anchor, True).over(ahead)
    share = F.when(hi_old > lo_old, (F.col(old) - lo_old) / (hi_old - lo_old)).otherwise(0.0)
    return rows.withColumn("moved", F.coalesce(lo_new + F.least(F.lit(1.0), F.greatest(F.lit(0.0), share)) * (hi_new - lo_new), lo_new, hi_new))


def short_legs(stops: DataFrame, lane: str, mile: str, stop: str, floor_miles: float) -> DataFrame:
    """Legs below the floor, with the stop before."""
    w = Window.partitionBy(lane).orderBy(mile, stop)
    out = stops.withColumns({"previous": F.lag(stop).over(w), "leg": F.col(mile) - F.coalesce(F.lag(mile).over(w), F.lit(0.0))})
    return out.where(F.col("leg") < floor_miles - 1e-6)


def quota_drift(readings: DataFrame, keys: list[str], at: str, remaining: str, ours: str, tie: str) -> DataFrame:
    """How much more a quota fell than our own calls explain; zero after a reset, null if unknown."""
    before = F.lag(remaining).over(Window.partitionBy(*keys).orderBy(at, tie))
    fall = before - F.col(remaining)
    return readings.withColumn("drift", F.when(before.isNull() | F.col(remaining).isNull(), None).when(fall < 0, 0).otherwise(F.greatest(F.lit(0), fall - F.col(ours))))


def admit(calls: DataFrame, keys: list[str], at: str, tie: str, ceiling: int) -> DataFrame:
    """The first calls of a key and UTC day are admitted, the rest are not."""
    day = F.to_date(at)
    place = F.row_number().over(Window.partitionBy(*keys, day).orderBy(at, tie))
    return calls.withColumn("admitted", place <= ceiling)


def changed_window(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """For each key the span of days on which two assignment histories differ; the end is null where it stays open."""
    far = F.lit("9999-12-31").cast("date")
    span = lambda d, name: d.select(key, F.col("valid_from").alias("f"), F.date_add(F.coalesce("valid_to", F.date_sub(far, 1)), 1).alias("t"), F.col("truck_id").alias(name))
    b, a = span(before, "old"), span(after, "new")
    points = b.select(key, F.explode(F.array("f", "t")).alias("d")).unionByName(a.select(key, F.explode(F.array("f", "t")).alias("d"))).distinct()
    runs = points.withColumn("e", F.lead("d").over(Window.partitionBy(key).orderBy("d"))).where("e is not null")
    x = runs.alias("r").join(b.alias("b"), (F.col(f"r.{key}") == F.col(f"b.{key}")) & (F.col("d") >= F.col("b.f")) & (F.col("d") < F.col("b.t")), "left").select(f"r.{key}", "d", "e", "old")
    y = x.alias("r").join(a.alias("a"), (F.col(f"r.{key}") == F.col(f"a.{key}")) & (F.col("d") >= F.col("a.f")) & (F.col("d") < F.col("a.t")), "left").select(f"r.{key}", "d", "e", "old", "new")
    out = y.where(~F.col("old").eqNullSafe(F.col("new"))).groupBy(key).agg(F.min("d").alias("changed_from"), F.max("e").alias("end"))
    return out.select(key, "changed_from", F.when(F.col("end") < far, F.date_sub("end", 1)).alias("changed_to"))


def in_force(assignments: DataFrame, key: str, day: Column) -> DataFrame:
    """Each key's assignment on a day."""
    on = assignments.where((F.col("valid_from") <= day) & (F.coalesce("valid_to", F.lit("9999-12-31").cast("date")) >= day))
    return on.groupBy(key).agg(F.max_by("truck_id", F.struct("valid_from", "truck_id")).alias("truck_id"))


def assignment_history(changes: DataFrame, key: str, day: str, truck: str) -> DataFrame:
    """Day ranges from reassignments; a row ends the day before the next one begins, the last stays open.  A
    reassignment to the same truck, and a second one on a day (the larger truck first), is left out."""
    one = changes.groupBy(key, day).agg(F.max(truck).alias(truck))
    w = Window.partitionBy(key).orderBy(day)
    moved = one.withColumn("_before", F.lag(truck).over(w)).where(~F.col("_before").eqNullSafe(F.col(truck))).drop("_before")
    return moved.select(key, truck, F.col(day).alias("valid_from"), F.date_sub(F.lead(day).over(w), 1).alias("valid_to"))


def page(rows: DataFrame, order: list[Column], size: int, number: int) -> DataFrame:
    """One page of a total order, which must end in a unique key."""
    return rows.orderBy(*order).offset(size * number).limit(size)


def page_numbers(rows: DataFrame, part: str, order: list[Column], size: int) -> DataFrame:
    """Key-set paging: every row with the number of its page, so that any page is a filter."""
    return rows.withColumn("page", F.floor((F.row_number().over(Window.partitionBy(part).orderBy(*order)) - 1) / size).cast("int"))
