"""N: the ten anomaly rules, their runner and the rebuild of findings.

A rule maps stops, lines, published prices and its thresholds to findings (rule, subject_id,
severity, detail).  Quantities and prices are integers: hundredths and ten-thousandths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tankline.functions import exprs
from tankline.operators.joins import effective_dated, first_per
from tankline.operators.windows import too_close as neighbours

# The thresholds that every deployment starts with.
THRESHOLDS: dict[str, dict] = {
    "sub_gallon": {"min_gallons": 1.00, "products": ["TA"]}, "too_close": {"max_minutes": 120}, "charges_no_fuel": {"fuel_products": ["TA", "DF"]},
    "price_above_published": {"max_overage_t": 1000, "product": "TA"}, "unit_mismatch": {}, "no_truck_on_file": {}, "unit_not_entered": {}, "driver_not_entered": {}, "not_on_roster": {}, "def_in_canada": {},
}


def finding(rows: DataFrame, rule: str, severity: str, detail: Column) -> DataFrame:
    return rows.select(F.lit(rule).alias("rule"), F.col("stop_id").alias("subject_id"), F.lit(severity).alias("severity"), detail.alias("detail"))


def sub_gallon(stops, lines, prices, config):
    """A line with some, but less than the least quantity, litres converted first; one finding a stop."""
    own = lines.join(stops.select("stop_id", "currency"), "stop_id").where(F.col("product").isin(*config["products"]))
    gallons = F.when(F.col("currency") == "CAD", exprs.gallons_from_liters(F.col("qty_c") / 100.0)).otherwise(F.col("qty_c") / 100.0)
    small = own.where((F.col("qty_c") > 0) & (gallons < config["min_gallons"]))
    return finding(first_per(small, ["stop_id"], F.asc("product"), F.asc("qty_c")), "sub_gallon", "red", F.col("qty_c").cast("string"))


def unit_mismatch(stops, lines, prices, config):
    """A known truck and an entry that isn't its unit."""
    unit = F.col("truck_id").cast("string")
    return finding(stops.where(F.col("truck_id").isNotNull() & (F.trim("unit_raw") != "") & ~exprs.same_unit(F.col("unit_raw"), unit)), "unit_mismatch", "amber", F.trim("unit_raw"))


def no_truck_on_file(stops, lines, prices, config):
    """N3."""
    return finding(stops.where("truck_id is null"), "no_truck_on_file", "amber", F.when(F.col("driver_id").isNull(), "no_driver").otherwise("no_assignment"))


def unit_not_entered(stops, lines, prices, config):
    """N4."""
    return finding(stops.where(F.trim("unit_raw") == ""), "unit_not_entered", "amber", F.lit(""))


def driver_not_entered(stops, lines, prices, config):
    """N5."""
    return finding(stops.where(F.trim("driver_raw") == ""), "driver_not_entered", "red", F.lit(""))


def not_on_roster(stops, lines, prices, config):
    """The card has no driver."""
    return finding(stops.where("driver_id is null"), "not_on_roster", "red", F.col("card_id").cast("string"))


def too_close(stops, lines, prices, config):
    """Two fills at one station by one card."""
    near = neighbours(stops.where("station_id is not null"), ["card_id", "station_id"], "occurred_at", "stop_id", config["max_minutes"])
    return finding(near, "too_close", "amber", F.concat_ws(":", F.floor(F.col("gap_s") / 60).cast("string"), F.col("previous_id").cast("string")))


def charges_no_fuel(stops, lines, prices, config):
    """Money but no fuel."""
    fuel = F.coalesce(F.sum(F.when(F.col("product").isin(*config["fuel_products"]), F.col("qty_c"))), F.lit(0))
    sums = lines.groupBy("stop_id").agg(fuel.alias("fuel"), F.sum("amount_c").alias("amount"), F.array_join(F.array_sort(F.collect_set("product")), ",").alias("products"))
    return finding(sums.where("fuel <= 0 and amount > 0").join(stops.select("stop_id"), "stop_id", "left_semi"), "charges_no_fuel", "amber", F.col("products"))


def def_in_canada(stops, lines, prices, config):
    """N9."""
    sums = lines.where("product = 'DF'").groupBy("stop_id").agg(F.sum("amount_c").alias("amount"))
    return finding(sums.join(stops.where("currency = 'CAD'").select("stop_id"), "stop_id", "left_semi"), "def_in_canada", "amber", F.col("amount").cast("string"))


def price_audit(stops, lines, prices, config) -> DataFrame:
    """Each stop's dearest diesel line against the station's published price of the day: flagged, clean or why not computable."""
    diesel = lines.where(F.col("product") == config["product"]).groupBy("stop_id").agg(F.max("billed_t").alias("billed_t"))
    own = stops.join(diesel, "stop_id")
    p = prices.select("station_id", F.col("valid_on").alias("day"), "price_t")
    over = F.col("billed_t") - F.col("price_t")
    status = (
        F.when(F.col("currency") == "CAD", "canadian_stop").when(F.col("station_id").isNull(), "unresolved_station").when(F.col("price_t").isNull(), "no_price_that_day")
        .when(over > config["max_overage_t"], "flagged").otherwise("clean")
    )
    return own.join(p, ["station_id", "day"], "left").withColumn("status", status).withColumn("over_t", over)


def price_above_published(stops, lines, prices, config):
    """N10's findings."""
    return finding(price_audit(stops, lines, prices, config).where("status = 'flagged'"), "price_above_published", "red", F.col("over_t").cast("string"))


RULES = {
    "sub_gallon": sub_gallon, "unit_mismatch": unit_mismatch, "no_truck_on_file": no_truck_on_file, "unit_not_entered": unit_not_entered, "driver_not_entered": driver_not_entered,
    "not_on_roster": not_on_roster, "too_close": too_close, "charges_no_fuel": charges_no_fuel, "def_in_canada": def_in_canada, "price_above_published": price_above_published,
}


def load_thresholds(config: DataFrame | None) -> dict[str, dict]:
    """the ten rows rule, settings (JSON); a missing rule is an error."""
    if config is None:
        return THRESHOLDS
    import json

    found = {r["rule"]: json.loads(r["settings"]) for r in config.where(F.col("rule").isin(*RULES)).limit(len(RULES)).collect()}
    if missing := sorted(set(RULES) - set(found)):
        raise ValueError(f"no thresholds for {', '.join(missing)}")
    return found


def run(stops: DataFrame, lines: DataFrame, prices: DataFrame, thresholds: dict[str, dict] | None = None, rules: dict | None = None) -> DataFrame:
    """All findings of all rules: lines are folded once to their stop, each stop yields the array of its findings; only neighbours in
    time need an exchange of their own.  A choice of `rules` runs one by one."""
    config = thresholds or THRESHOLDS
    if rules is not None:
        out = None
        for name, rule in rules.items():
            found = rule(stops, lines, prices, config[name])
            out = found if out is None else out.unionByName(found)
        return out
    small, fuel, dear = config["sub_gallon"], config["charges_no_fuel"]["fuel_products"], config["price_above_published"]
    least = lambda gallons: F.min(F.when(F.col("product").isin(*small["products"]) & (F.col("qty_c") > 0) & (gallons < small["min_gallons"]), F.struct("product", "qty_c")))
    fold = lines.groupBy("stop_id").agg(
        least(F.col("qty_c") / 100.0).alias("_small_us"), least(exprs.gallons_from_liters(F.col("qty_c") / 100.0)).alias("_small_ca"), F.coalesce(F.sum(F.when(F.col("product").isin(*fuel), F.col("qty_c"))), F.lit(0)).alias("_fuel"),
        F.sum("amount_c").alias("_amount"), F.array_join(F.array_sort(F.collect_set("product")), ",").alias("_products"), F.sum(F.when(F.col("product") == "DF", F.col("amount_c"))).alias("_def"),
        F.max(F.when(F.col("product") == dear["product"], F.col("billed_t"))).alias("_billed"),
    )
    p = prices.select("station_id", F.col("valid_on").alias("day"), F.col("price_t").alias("_price"))
    own = stops.join(fold, "stop_id", "left").join(p, ["station_id", "day"], "left")
    c, over, canada = F.col, F.col("_billed") - F.col("_price"), F.col("currency") == "CAD"
    tiny = F.when(canada, c("_small_ca")).otherwise(c("_small_us"))
    found = {
        "sub_gallon": (tiny.isNotNull(), "red", tiny["qty_c"].cast("string")), "not_on_roster": (c("driver_id").isNull(), "red", c("card_id").cast("string")),
        "unit_mismatch": (c("truck_id").isNotNull() & (F.trim("unit_raw") != "") & ~exprs.same_unit(c("unit_raw"), c("truck_id").cast("string")), "amber", F.trim("unit_raw")),
        "no_truck_on_file": (c("truck_id").isNull(), "amber", F.when(c("driver_id").isNull(), "no_driver").otherwise("no_assignment")),
        "unit_not_entered": (F.trim("unit_raw") == "", "amber", F.lit("")), "driver_not_entered": (F.trim("driver_raw") == "", "red", F.lit("")),
        "charges_no_fuel": ((c("_fuel") <= 0) & (c("_amount") > 0), "amber", c("_products")), "def_in_canada": (canada & c("_def").isNotNull(), "amber", c("_def").cast("string")),
        "price_above_published": (~canada & (over > dear["max_overage_t"]), "red", over.cast("string")),
    }
    each = [F.when(when, F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), detail.alias("detail"))) for rule, (when, severity, detail) in found.items()]
    per_stop = own.select(F.col("stop_id").alias("subject_id"), F.explode(F.filter(F.array(*each), lambda x: x.isNotNull())).alias("_f")).select("_f.rule", "subject_id", "_f.severity", "_f.detail")
    return per_stop.unionByName(too_close(stops, lines, prices, config["too_close"]))


def rebuild(findings: DataFrame, invoices: DataFrame, folder: str) -> None:
    """The findings (invoice_id and theirs) of these invoices in place of what they had; others stay.

    A partition is an invoice.  Each gets a row without a rule, so that one whose findings are all gone is written too."""
    marks = invoices.select("invoice_id").distinct()
    rows = findings.join(marks, "invoice_id", "left_semi").unionByName(marks, allowMissingColumns=True)
    rows.repartition("invoice_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("invoice_id").parquet(folder)


def stored_findings(spark, folder: str) -> DataFrame:
    """What :func:`rebuild` keeps."""
    return spark.read.parquet(folder).where("rule is not null")


def not_computable(stops: DataFrame, lines: DataFrame, prices: DataFrame, thresholds: dict[str, dict] | None = None) -> DataFrame:
    """Stops whose price couldn't be audited, and why."""
    audit = price_audit(stops, lines, prices, (thresholds or THRESHOLDS)["price_above_published"])
    return audit.where(~F.col("status").isin("flagged", "clean")).select("stop_id", "status")


def resolve_trucks(stops: DataFrame, assignments: DataFrame) -> DataFrame:
    """Each stop's truck by its driver's assignment that day, and whether the entered unit agrees."""
    found = effective_dated(stops.drop("truck_id"), assignments, "driver_id")
    agrees = F.when(F.col("truck_id").isNotNull() & (F.trim("unit_raw") != ""), exprs.same_unit(F.col("unit_raw"), F.col("truck_id").cast("string")))
    return found.withColumn("agrees", agrees).drop("valid_from", "valid_to")


def preview(stops: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Q3: what a change of assignments would do, without writing it: stops whose truck moves, and whether they gain or lose the finding
    that no truck is on file.  Both histories are resolved in one pass over the stops of each."""
    old = resolve_trucks(stops, before).select("stop_id", F.col("truck_id").alias("_old"))
    new = resolve_trucks(stops, after).select("stop_id", F.col("truck_id").alias("_new"))
    moves = old.join(new, "stop_id").where(~F.col("_old").eqNullSafe(F.col("_new")))
    flag = F.when(F.col("_old").isNull(), "cleared").when(F.col("_new").isNull(), "appeared").otherwise("none")
    return moves.select("stop_id", F.col("_old").cast("string").alias("before"), F.col("_new").cast("string").alias("after"), flag.alias("no_truck_flag"))
