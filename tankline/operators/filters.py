"""F: predicates over stops, row validation and table rules."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tankline.functions import exprs

#: F8 excludes this rule from the anomaly-only filter.
NO_FUEL_RULE = "charges_no_fuel"


def all_of(conditions: list[Column | None]) -> Column:
    """the conjunction of the conditions that are set."""
    return reduce(and_, [c for c in conditions if c is not None], F.lit(True))


def filter_stops(
    stops: DataFrame, *, date_from=None, date_to=None, week=None, week_from=None, week_to=None, currency=None, driver_id=None, truck_id=None, card_id=None, status=None,
    state: tuple[DataFrame, str] | None = None, product: tuple[DataFrame, str] | None = None, anomalies: DataFrame | None = None, flags: list[str] | None = None,
) -> DataFrame:
    """Stops that meet every condition that is set.

    `state` and `product` pair a table with a value: stations by state, lines by product.  `anomalies`
    (stop_id, rule, dismissed) alone keeps stops with an open finding; with `flags`, one of these rules.
    Filters stand before any join, so they reach the scan.
    """
    c = F.col
    out = stops.where(
        all_of([
            c("occurred_at") >= F.lit(date_from) if date_from else None, c("occurred_at") <= F.lit(date_to) if date_to else None, c("week_end") == F.lit(week) if week else None,
            c("week_end") >= F.lit(week_from) if week_from else None, c("week_end") <= F.lit(week_to) if week_to else None, c("currency") == currency if currency else None,
            c("driver_id") == driver_id if driver_id is not None else None, c("truck_id") == truck_id if truck_id is not None else None, c("card_id") == card_id if card_id is not None else None,
            c("status") == status if status else None,
        ])
    )
    if state is not None:
        out = out.join(state[0].where(c("state") == state[1]).select("station_id"), "station_id", "left_semi")
    if product is not None:
        out = out.join(product[0].where(c("product") == product[1]).select("stop_id"), "stop_id", "left_semi")
    if anomalies is not None:
        wanted = c("rule").isin(*flags) if flags else c("rule") != NO_FUEL_RULE
        out = out.join(anomalies.where(~c("dismissed") & wanted).select("stop_id"), "stop_id", "left_semi")
    return out


def queue_scope(stops: DataFrame, *, week=None, currency=None, include_confirmed: bool = False) -> DataFrame:
    """the receipt queue's scope; what isn't given doesn't narrow it, and confirmed stops are left out unless asked for."""
    out = filter_stops(stops, week=week, currency=currency)
    return out if include_confirmed else out.where("status <> 'confirmed'")


def queue_order(spec: str) -> list[Column]:
    """O2: orders of the receipt queue; each ends in the id."""
    oldest = [F.asc("occurred_at"), F.asc("stop_id")]
    return {"oldest": oldest, "newest": [F.desc("occurred_at"), F.asc("stop_id")], "exceptions": [F.desc(F.col("status") == "missing"), *oldest]}[spec]


def overlapping(ranges: DataFrame, day_from, day_to) -> DataFrame:
    """ranges [start_day, end_day] that overlap a span; its bounds are swapped if reversed."""
    lo, hi = sorted([day_from, day_to])
    return ranges.where((F.col("start_day") <= F.lit(hi)) & (F.col("end_day") >= F.lit(lo)))


def last_weeks(weeks: DataFrame, n: int = 4) -> DataFrame:
    """The latest n week ends of a table of distinct weeks."""
    return weeks.orderBy(F.desc("week_end")).limit(n)


def price_basis(basis: str) -> Column:
    """F17."""
    return {"pump": F.col("your_price"), "ifta_net": ifta_net(), "total_cost": F.col("total_cost")}[basis]


def ifta_net() -> Column:
    """what is left without state taxes; missing parts count as zero."""
    return sum((F.coalesce(F.col(c), F.lit(0)) for c in ("cost", "freight", "other", "federal_tax")), F.lit(0))


def dates_differ() -> Column:
    """an actual range that is known and unlike the printed one."""
    known = F.col("actual_start").isNotNull() & F.col("actual_end").isNotNull()
    return known & ((F.col("actual_start") != F.col("printed_start")) | (F.col("actual_end") != F.col("printed_end")))


def missing_fields(*names: str) -> Column:
    """the names of required fields that are null."""
    return F.filter(F.array(*[F.when(F.col(n).isNull(), F.lit(n)) for n in names]), lambda x: x.isNotNull())


def text_contains(needle: str, *names: str) -> Column:
    """a free-text search over several columns."""
    return F.lower(F.concat_ws(" ", *[F.col(n).cast("string") for n in names])).contains(needle.lower())


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """key and rule of every row that breaks one; a rule that is null is not broken."""
    broken = F.filter(F.array(*[F.when(~ok, F.lit(name)) for name, ok in rules.items()]), lambda x: x.isNotNull())
    return df.select(key, F.explode(broken).alias("rule"))


def not_unique(df: DataFrame, keys: list[str], where: Column | None = None) -> DataFrame:
    """keys that occur more than once among the rows of a partial unique index."""
    rows = df if where is None else df.where(where)
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def overlaps(df: DataFrame, key: str, start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """rows whose closed day range overlaps an earlier one of the same key; an open end never ends."""
    w = Window.partitionBy(key).orderBy(start, F.coalesce(end, F.lit("9999-12-31").cast("date")))
    latest = F.max(F.coalesce(F.col(end), F.lit("9999-12-31").cast("date"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("_latest", latest).where(F.col(start) <= F.col("_latest")).drop("_latest")


# The numeric columns of a price sheet in their order, and the price rule's tolerance.
PRICE_COLUMNS = ["cost", "federal_tax", "state_tax", "sales_tax", "freight", "other", "total_cost", "retail_price", "your_price", "savings"]
PRICE_TOLERANCE = "0.0005"


def validate_prices(rows: DataFrame, products: DataFrame) -> DataFrame:
    """typed columns and the first rejection (code, message) of each raw price row, or null.

    `products`: raw_code, product_type; a dimension of a few rows for each supplier.
    """
    typed = rows
    for name in PRICE_COLUMNS:
        typed = typed.withColumn(f"{name}_n", F.when(F.trim(name) != "", F.trim(name).try_cast("double").try_cast("decimal(8,4)")))
    typed = typed.join(F.broadcast(products.select(F.col("raw_code").alias("prod"), "product_type")), "prod", "left")
    problem = lambda code, text: F.struct(F.lit(code).alias("code"), F.lit(text).alias("message"))
    checks = [F.when(F.coalesce(F.trim(n), F.lit("")) == "", problem("SCHEMA_ERROR", f"{n} is blank")) for n in ("site", "name", "city")]
    checks += [F.when(F.col(f"{n}_n").isNull(), problem("NUMERIC_PARSE_ERROR", f"{n} is no number")) for n in PRICE_COLUMNS]
    low = F.least("total_cost_n", "retail_price_n")
    checks += [
        F.when(~F.upper(F.trim("state")).isin(*exprs.STATES), problem("INVALID_STATE", "unknown state")),
        F.when(F.col("product_type").isNull(), problem("UNMAPPED_PRODUCT", "unknown product")),
        F.when(F.abs(F.col("your_price_n") - low) > F.lit(PRICE_TOLERANCE).cast("decimal(8,4)"), problem("PRICE_INVARIANT_VIOLATION", "price is not the lower of cost and retail")),
    ]
    return typed.withColumn("rejection", F.coalesce(*checks))
