"""A: rollups, invoice figures, two-currency panels, trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tankline.functions import exprs


def sum_if(value: str, where: str | Column) -> Column:
    """A2: a conditional sum that is zero, not null, without rows."""
    return F.coalesce(F.sum(F.when(F.expr(where) if isinstance(where, str) else where, F.col(value))), F.lit(0)).cast("bigint")


def stop_sums(lines: DataFrame) -> DataFrame:
    """Lines folded to one row a stop, so that no stop counts twice in a join."""
    return lines.groupBy("stop_id").agg(
        sum_if("qty_c", "product = 'TA'").alias("ta_qty_c"), F.coalesce(F.sum(F.expr("CASE WHEN product = 'TA' THEN qty_c * billed_t END")), F.lit(0)).cast("bigint").alias("ta_weighted"),
        sum_if("qty_c", "product = 'DF'").alias("df_qty_c"),
    )


def rollup(stops: DataFrame, lines: DataFrame, key: str, anomalies: DataFrame | None = None) -> DataFrame:
    """A1: stops, money, diesel and DEF sums, receipts and findings by a key; the null key is a group of its own."""
    flags = stops.select("stop_id").limit(0).withColumn("n_flags", F.lit(0).cast("bigint")) if anomalies is None else anomalies.groupBy("stop_id").agg(F.count("*").alias("n_flags"))
    per_stop = stops.join(stop_sums(lines), "stop_id", "left").join(flags, "stop_id", "left")
    return per_stop.groupBy(key).agg(
        F.count("*").alias("stops"), F.sum("total_c").alias("total_c"), F.coalesce(F.sum("ta_qty_c"), F.lit(0)).alias("ta_qty_c"), F.coalesce(F.sum("ta_weighted"), F.lit(0)).alias("ta_weighted"),
        F.coalesce(F.sum("df_qty_c"), F.lit(0)).alias("df_qty_c"), F.count_if(F.col("status") == "confirmed").alias("confirmed"), F.coalesce(F.sum("n_flags"), F.lit(0)).alias("anomalies"),
    )


def finish_rollup(sums: DataFrame) -> DataFrame:
    """A3, A4: weighted price, DEF ratio and receipt share; null where nothing is divided by."""
    return sums.withColumns({
        "avg_price_t": exprs.ratio(F.col("ta_weighted"), F.col("ta_qty_c")), "def_ratio": exprs.ratio(F.col("df_qty_c"), F.col("ta_qty_c")),
        "receipt_pct": exprs.half_up(exprs.ratio(F.col("confirmed") * 100, F.col("stops")), 2),
    }).drop("ta_weighted")


def with_fleet(stops: DataFrame, key: str) -> DataFrame:
    """A5: groups and the fleet's row, told from the null key by grouping_id."""
    return stops.rollup(key).agg(F.grouping_id().cast("int").alias("is_fleet"), F.count("*").alias("stops"), F.sum("total_c").alias("total_c"))


def favoured_stations(stops: DataFrame, key: str, most: int = 5) -> DataFrame:
    """Each key's most visited stations; stops without a station are counted apart."""
    sums = stops.groupBy(key, "station_id").agg(F.count("*").alias("visits"), F.sum("total_c").alias("total_c"))
    rank = F.row_number().over(Window.partitionBy(key, F.col("station_id").isNull()).orderBy(F.desc("visits"), F.desc("total_c"), F.asc("station_id")))
    return sums.withColumn("place", rank).where(F.col("station_id").isNull() | (F.col("place") <= most))


def versus_fleet(stops: DataFrame, key: str, weeks: int = 8) -> DataFrame:
    """Each key's money and the fleet's over the trailing weeks; weeks without activity stay."""
    last = stops.select("week_end").distinct().orderBy(F.desc("week_end")).limit(weeks)
    per = stops.join(F.broadcast(last), "week_end").groupBy("week_end", key).agg(F.sum("total_c").alias("own_c"), F.count("*").alias("own_stops"))
    fleet = per.groupBy("week_end").agg(F.sum("own_c").alias("fleet_c"), F.sum("own_stops").alias("fleet_stops"))
    keys = per.select(key).where(F.col(key).isNotNull()).distinct()
    grid = keys.join(F.broadcast(fleet))  # `weeks` rows for each key
    return grid.join(per, ["week_end", key], "left").fillna(0, ["own_c", "own_stops"])


def invoice_figures(stops: DataFrame, lines: DataFrame) -> DataFrame:
    """An invoice's (week, currency) totals by product, tax split and averages in exact cents."""
    tax = F.expr("CAST(FLOOR(amount_c * tax_p / 100.0 + 0.5) AS BIGINT)")
    disc = F.expr("CAST(FLOOR(amount_c * disc_p / 100.0 + 0.5) AS BIGINT)")
    per_stop = lines.withColumn("tax_c", tax).withColumn("disc_c", disc).groupBy("stop_id").agg(
        F.sum("amount_c").alias("with_tax_c"), F.sum("tax_c").alias("tax_c"), sum_if("qty_c", "product = 'TA'").alias("diesel_qty_c"), sum_if("amount_c", "product = 'TA'").alias("diesel_c"),
        sum_if("amount_c", "product = 'TA' AND tax_p > 0").alias("taxed_c"), sum_if("tax_c", "product = 'TA' AND tax_p > 0").alias("taxed_tax_c"), sum_if("qty_c", "product = 'TA' AND tax_p > 0").alias("taxed_qty_c"),
        sum_if("qty_c", "product = 'DF'").alias("def_qty_c"), sum_if("amount_c", "product = 'DF'").alias("def_c"), sum_if("amount_c", "product = 'S'").alias("other_c"), F.sum("disc_c").alias("discount_c"),
    )
    names = [c for c in per_stop.columns if c != "stop_id"]
    sums = stops.join(per_stop, "stop_id", "left").groupBy("week_end", "currency").agg(
        F.count("*").alias("stops"), F.count_if(F.col("status") == "confirmed").alias("confirmed"), *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names]
    )
    return sums.withColumns({
        "before_tax_c": F.col("with_tax_c") - F.col("tax_c"), "avg_billed": exprs.ratio(F.col("diesel_c"), F.col("diesel_qty_c")),
        "avg_pretax": exprs.ratio(F.col("taxed_c") - F.col("taxed_tax_c"), F.col("taxed_qty_c")), "avg_discount": exprs.ratio(F.col("discount_c"), F.col("diesel_qty_c")),
    }).drop("taxed_c", "taxed_tax_c", "taxed_qty_c")


def combined_panel(sides: DataFrame, fx: DataFrame, target: str) -> DataFrame:
    """Both currencies of a week in one; each side is converted once, `before` is a difference of
    converted figures; money is null while a needed rate is missing."""
    joined = sides.join(fx, "week_end", "left")
    for name in ("with_tax_c", "tax_c"):
        joined = joined.withColumn(f"{name}_t", exprs.convert_cents(F.col(name), F.col("currency"), target, F.col("rate_micro")))
    pending = F.max(F.col("with_tax_c_t").isNull())
    out = joined.groupBy("week_end").agg(
        pending.alias("rate_pending"), F.when(~pending, F.sum("with_tax_c_t")).alias("with_tax_c"), F.when(~pending, F.sum("tax_c_t")).alias("tax_c"),
        F.when(~pending, F.coalesce(F.sum(F.when(F.col("currency") == "USD", F.col("with_tax_c_t"))), F.lit(0))).alias("us_c"), F.count("*").alias("sides"),
        F.when(F.count("*") < 2, F.when(F.max("currency") == "USD", "CAD").otherwise("USD")).alias("missing_side"),
    )
    share = F.when((F.col("sides") == 2) & (F.col("with_tax_c") > 0), F.floor(F.col("us_c") * 100.0 / F.col("with_tax_c") + 0.5).cast("bigint"))
    return out.withColumns({"before_tax_c": F.col("with_tax_c") - F.col("tax_c"), "us_share": share, "ca_share": 100 - share}).drop("us_c")


def week_scope(weeks: DataFrame) -> DataFrame:
    """Sums, ratios of sums, weekly extremes and rate coverage over a set of weeks, by currency."""
    ratio = exprs.ratio(F.col("diesel_c"), F.col("diesel_qty_c"))
    return weeks.withColumn("_r", ratio).groupBy("currency").agg(
        F.count("*").alias("weeks"), F.sum("with_tax_c").alias("with_tax_c"), exprs.ratio(F.sum("diesel_c"), F.sum("diesel_qty_c")).alias("avg_price"),
        F.min("_r").alias("low"), F.max("_r").alias("high"), F.count("rate_micro").alias("rated_weeks"), F.sum("rate_micro").alias("rate_sum"),
    )


def combined_scope(sides: DataFrame, fx: DataFrame) -> DataFrame:
    """Both currencies of a set of weeks in CAD, one row.  A week counts if its US side has a rate, or if it has a Canadian side alone;
    each week's side is converted once.  Rate coverage is over the weeks with a US side."""
    joined = sides.join(fx, "week_end", "left")
    cad = {f"_{name}": exprs.convert_cents(F.col(name), F.col("currency"), "CAD", F.col("rate_micro")) for name in ("with_tax_c", "diesel_c", "discount_c")}
    us, ca = F.col("currency") == "USD", F.col("currency") == "CAD"
    weeks = joined.withColumns(cad).groupBy("week_end").agg(
        F.max(us).alias("has_us"), F.max(ca).alias("has_ca"), F.max("rate_micro").alias("rate_micro"), *[F.sum(n).alias(n) for n in cad],
        F.sum(F.when(us, F.col("diesel_qty_c"))).alias("gallons_c"), F.sum(F.when(ca, F.col("diesel_qty_c"))).alias("litres_c"), F.sum("stops").alias("stops"),
    )
    rated = F.col("has_us") & F.col("rate_micro").isNotNull()
    counts = rated | (~F.col("has_us") & F.col("has_ca"))
    out = weeks.agg(
        F.count_if(counts).alias("weeks"), F.count_if(counts & F.col("has_us")).alias("us_weeks"), F.count_if(counts & F.col("has_ca")).alias("ca_weeks"),
        *[F.sum(F.when(counts, F.col(n))).alias(n[1:]) for n in cad], F.sum(F.when(counts, F.col("stops"))).alias("stops"),
        F.coalesce(F.sum(F.when(counts, F.col("gallons_c"))), F.lit(0)).alias("gallons_c"), F.coalesce(F.sum(F.when(counts, F.col("litres_c"))), F.lit(0)).alias("litres_c"),
        F.count_if("has_us").alias("need_rate"), F.count_if(rated).alias("rated_weeks"), F.sum(F.when(rated, F.col("rate_micro"))).alias("rate_sum"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("has_us") & ~rated, F.col("week_end").cast("string")))), ",").alias("missing"),
    )
    litres = F.col("gallons_c") / 100.0 * exprs.LITERS_PER_GALLON + F.col("litres_c") / 100.0
    return out.withColumn("price_per_litre", F.when(litres > 0, F.round(F.col("diesel_c") / 100.0 / litres, 8))).withColumn("mean_rate", F.round(F.col("rate_sum") / F.nullif("rated_weeks", F.lit(0)) / 1e6, 8)).drop("rate_sum")


def trend_periods(weeks: DataFrame) -> DataFrame:
    """Calendar months: price in ten-thousandths, weeks with fuel, and the change against the month before
    (null if either is null or the earlier is zero)."""
    months = weeks.groupBy("currency", F.date_format("week_end", "yyyy-MM").alias("period")).agg(
        F.sum("diesel_c").alias("diesel_c"), F.sum("diesel_qty_c").alias("qty_c"), F.count_if(F.col("diesel_qty_c") > 0).alias("weeks_with_fuel")
    )
    price = F.when(F.col("qty_c") > 0, F.floor(F.col("diesel_c") * 10000.0 / F.col("qty_c") + 0.5).cast("bigint"))
    before = F.lag("price_t").over(Window.partitionBy("currency").orderBy("period"))
    return months.withColumn("price_t", price).withColumn("change_pct", F.when(before > 0, (F.col("price_t") - before) * 100.0 / before))


def billed_by_station_day(lines: DataFrame, published: DataFrame) -> DataFrame:
    """Distinct stops, quantity, weighted average, sorted distinct prices, and how far the highest is above the published."""
    sums = lines.where("product = 'TA'").groupBy("station_id", "day").agg(
        F.countDistinct("stop_id").alias("stops"), F.sum("qty_c").alias("qty_c"), exprs.ratio(F.sum(F.col("qty_c") * F.col("billed_t")), F.sum("qty_c")).alias("avg_t"),
        F.array_join(F.transform(F.sort_array(F.collect_set("billed_t")), lambda x: x.cast("string")), ",").alias("prices"), F.max("billed_t").alias("highest_t"),
    )
    p = published.select("station_id", F.col("valid_on").alias("day"), "price_t")
    over = F.col("highest_t") - F.col("price_t")
    return sums.join(p, ["station_id", "day"], "left").withColumn("over_t", over).withColumn("severity", F.when(over > 1000, "red").when(over > 0, "amber"))


def latest_state(events: DataFrame, key: str, state: str, at: str, tie: str) -> DataFrame:
    """The state of each key's last event."""
    return events.groupBy(key).agg(F.max_by(state, F.struct(at, tie)).alias(state), F.max(at).alias(at))


def top_and_rest(sums: DataFrame, part: str, name: str, value: str, most: int = 10) -> DataFrame:
    """The ten largest by part, and all others as one row."""
    place = F.row_number().over(Window.partitionBy(part).orderBy(F.desc(value), F.asc(name)))
    label = F.when(place <= most, F.col(name).cast("string")).otherwise("other")
    return sums.withColumn("label", label).groupBy(part, "label").agg(F.sum(value).alias(value), F.count("*").alias("members"))


def error_metrics(rows: DataFrame, part: str, error: Column) -> DataFrame:
    """Count, mean absolute and signed error, worst under- and over-estimate, floored at zero."""
    return rows.withColumn("_e", error).groupBy(part).agg(
        F.count("_e").alias("n"), (F.sum(F.abs("_e")).cast("double") / F.count("_e")).alias("mae"), (F.sum("_e").cast("double") / F.count("_e")).alias("signed"),
        F.greatest(F.lit(0), F.max(-F.col("_e"))).alias("worst_under"), F.greatest(F.lit(0), F.max("_e")).alias("worst_over"),
    )


def plan_summary(deltas: DataFrame, actual: DataFrame) -> DataFrame:
    """One row: coverage (matched of all actual stops), adherence in percent (null without plans), and what was paid above plan."""
    matched, skipped = F.count_if(F.col("kind") == "matched"), F.count_if(F.col("kind") == "skipped_recommendation")
    own = deltas.agg(matched.alias("covered"), exprs.ratio(matched * 100, matched + skipped).alias("adherence"), F.coalesce(F.sum(F.when(F.col("delta_m") > 0, F.col("delta_m"))), F.lit(0)).alias("left_on_table_m"))
    return own.join(F.broadcast(actual.agg(F.count("*").alias("total"))))  # one row each


def truck_variance(deltas: DataFrame) -> DataFrame:
    """Planned, actual and their difference, matches and skips of each truck with a plan; adherence is zero without either."""
    own = deltas.where("plan_stop_id is not null")
    sums = {c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in ("planned_m", "actual_m", "delta_m")}
    out = own.groupBy("truck_id").agg(F.count_if(F.col("kind") == "matched").alias("matched"), F.count_if(F.col("kind") == "skipped_recommendation").alias("skipped"), *sums.values())
    return out.withColumn("adherence", F.coalesce(exprs.ratio(F.col("matched") * 100, F.col("matched") + F.col("skipped")), F.lit(0.0)))


def truck_days(stops: DataFrame, lines: DataFrame) -> DataFrame:
    """Each truck and UTC day with diesel: its stations in the order of visits, and the diesel cost (quantity by billed price)."""
    diesel = lines.where("product = 'TA'").groupBy("stop_id").agg(F.sum(F.col("qty_c") * F.col("billed_t")).alias("cost_m"))
    own = stops.where("truck_id is not null and station_id is not null").join(diesel, "stop_id").groupBy("truck_id", F.to_date("occurred_at").alias("day"))
    return own.agg(F.transform(F.array_sort(F.collect_list(F.struct("occurred_at", "stop_id", "station_id"))), lambda x: x["station_id"]).alias("stations"), F.sum("cost_m").alias("cost_m"))


def express_week(charges: DataFrame, invoices: DataFrame) -> DataFrame:
    """Count and sums of the express rows of each week and currency; a week without rows has zeros."""
    sums = charges.groupBy("invoice_id").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in ("amount_c", "fee_c", "total_c")])
    return invoices.join(sums, "invoice_id", "left").fillna(0, ["n", "amount_c", "fee_c", "total_c"])


def price_sheets(imports: DataFrame, prices: DataFrame) -> DataFrame:
    """Completed imports with their rows and distinct stations; one without prices has none."""
    counts = prices.groupBy("import_id").agg(F.countDistinct("station_id").alias("stations"))
    return imports.where("status = 'completed'").join(counts, "import_id", "left").fillna(0, ["stations"])


def weeks_with_invoices(invoices: DataFrame) -> DataFrame:
    """Weeks, each with its invoices, CAD after USD and by id."""
    own = F.transform(F.sort_array(F.collect_list(F.struct("currency", F.struct("invoice_id", "currency", "printed_start", "printed_end").alias("i"))), False), lambda x: x["i"])
    return invoices.groupBy("week_end").agg(own.alias("invoices"))
