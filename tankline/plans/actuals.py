"""Registered queries: filters, joins, rollups, panels, trends, windows, pages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tankline.operators import aggregates as A
from tankline.operators import filters, joins, sets, windows
from tankline.plans.registry import query

# DuckDB parts that several twins share.
STOP_SUMS = """ss AS (SELECT stop_id, CAST(SUM(CASE WHEN product='TA' THEN qty_c ELSE 0 END) AS BIGINT) AS ta_qty_c, CAST(SUM(CASE WHEN product='TA' THEN qty_c*billed_t ELSE 0 END) AS BIGINT) AS ta_weighted,
  CAST(SUM(CASE WHEN product='DF' THEN qty_c ELSE 0 END) AS BIGINT) AS df_qty_c FROM line GROUP BY stop_id)"""


def rollup_sql(key: str) -> str:
    return f"""WITH {STOP_SUMS}, g AS (SELECT {key}, COUNT(*) AS stops, CAST(SUM(total_c) AS BIGINT) AS total_c, CAST(COALESCE(SUM(ta_qty_c),0) AS BIGINT) AS ta_qty_c, CAST(COALESCE(SUM(ta_weighted),0) AS BIGINT) AS w,
  CAST(COALESCE(SUM(df_qty_c),0) AS BIGINT) AS df_qty_c, COUNT(*) FILTER (status='confirmed') AS confirmed, CAST(0 AS BIGINT) AS anomalies FROM stop LEFT JOIN ss USING (stop_id) GROUP BY {key})
  SELECT {key}, stops, total_c, ta_qty_c, df_qty_c, confirmed, anomalies, CASE WHEN ta_qty_c>0 THEN CAST(w AS DOUBLE)/ta_qty_c END AS avg_price_t, CASE WHEN ta_qty_c>0 THEN CAST(df_qty_c AS DOUBLE)/ta_qty_c END AS def_ratio,
  FLOOR(CAST(confirmed*100 AS DOUBLE)/stops*100.0+0.5)/100.0 AS receipt_pct FROM g"""


@query("A1_driver_rollup", "stop line", rollup_sql("driver_id"))
def driver_rollup(stop, line):
    return A.finish_rollup(A.rollup(stop, line, "driver_id"))


@query("A1_truck_rollup", "stop line", rollup_sql("truck_id"))
def truck_rollup(stop, line):
    return A.finish_rollup(A.rollup(stop, line, "truck_id"))


@query("A5_fleet_totals", "stop", "SELECT driver_id, CAST(GROUPING(driver_id) AS INT) AS is_fleet, COUNT(*) AS stops, CAST(SUM(total_c) AS BIGINT) AS total_c FROM stop GROUP BY ROLLUP(driver_id)")
def fleet_totals(stop):
    return A.with_fleet(stop, "driver_id")


@query(
    "A6_favoured_stations", "stop",
    """WITH s AS (SELECT driver_id, station_id, COUNT(*) AS visits, CAST(SUM(total_c) AS BIGINT) AS total_c FROM stop GROUP BY ALL),
    r AS (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY driver_id, station_id IS NULL ORDER BY visits DESC, total_c DESC, station_id) AS INT) AS place FROM s) SELECT * FROM r WHERE station_id IS NULL OR place <= 5""",
)
def favoured(stop):
    return A.favoured_stations(stop, "driver_id")


@query(
    "A7_versus_fleet", "stop",
    """WITH lw AS (SELECT DISTINCT week_end FROM stop ORDER BY 1 DESC LIMIT 8), per AS (SELECT week_end, driver_id, CAST(SUM(total_c) AS BIGINT) AS own_c, COUNT(*) AS own_stops FROM stop SEMI JOIN lw USING (week_end) GROUP BY ALL),
    fl AS (SELECT week_end, CAST(SUM(own_c) AS BIGINT) AS fleet_c, CAST(SUM(own_stops) AS BIGINT) AS fleet_stops FROM per GROUP BY 1), k AS (SELECT DISTINCT driver_id FROM per WHERE driver_id IS NOT NULL)
    SELECT week_end, driver_id, fleet_c, fleet_stops, COALESCE(own_c,0) AS own_c, COALESCE(own_stops,0) AS own_stops FROM k CROSS JOIN fl LEFT JOIN per USING (week_end, driver_id)""",
)
def versus_fleet(stop):
    return A.versus_fleet(stop, "driver_id")


SIDES = """lt AS (SELECT *, CAST(FLOOR(amount_c*tax_p/100.0+0.5) AS BIGINT) AS tax_c, CAST(FLOOR(amount_c*disc_p/100.0+0.5) AS BIGINT) AS disc_c FROM line),
  ps AS (SELECT stop_id, SUM(amount_c) AS with_tax_c, SUM(tax_c) AS tax_c, SUM(CASE WHEN product='TA' THEN qty_c ELSE 0 END) AS diesel_qty_c, SUM(CASE WHEN product='TA' THEN amount_c ELSE 0 END) AS diesel_c,
    SUM(CASE WHEN product='TA' AND tax_p>0 THEN amount_c ELSE 0 END) AS taxed_c, SUM(CASE WHEN product='TA' AND tax_p>0 THEN tax_c ELSE 0 END) AS taxed_tax_c, SUM(CASE WHEN product='TA' AND tax_p>0 THEN qty_c ELSE 0 END) AS taxed_qty_c,
    SUM(CASE WHEN product='DF' THEN qty_c ELSE 0 END) AS def_qty_c, SUM(CASE WHEN product='DF' THEN amount_c ELSE 0 END) AS def_c, SUM(CASE WHEN product='S' THEN amount_c ELSE 0 END) AS other_c, SUM(disc_c) AS discount_c FROM lt GROUP BY 1),
  f AS (SELECT week_end, currency, COUNT(*) AS stops, COUNT(*) FILTER (status='confirmed') AS confirmed, CAST(COALESCE(SUM(with_tax_c),0) AS BIGINT) AS with_tax_c, CAST(COALESCE(SUM(tax_c),0) AS BIGINT) AS tax_c,
    CAST(COALESCE(SUM(diesel_qty_c),0) AS BIGINT) AS diesel_qty_c, CAST(COALESCE(SUM(diesel_c),0) AS BIGINT) AS diesel_c, CAST(COALESCE(SUM(taxed_c),0) AS BIGINT) AS taxed_c, CAST(COALESCE(SUM(taxed_tax_c),0) AS BIGINT) AS taxed_tax_c,
    CAST(COALESCE(SUM(taxed_qty_c),0) AS BIGINT) AS taxed_qty_c, CAST(COALESCE(SUM(def_qty_c),0) AS BIGINT) AS def_qty_c, CAST(COALESCE(SUM(def_c),0) AS BIGINT) AS def_c, CAST(COALESCE(SUM(other_c),0) AS BIGINT) AS other_c,
    CAST(COALESCE(SUM(discount_c),0) AS BIGINT) AS discount_c FROM stop LEFT JOIN ps USING (stop_id) GROUP BY 1,2)"""


@query(
    "A8_invoice_figures", "stop line",
    f"""WITH {SIDES} SELECT week_end, currency, stops, confirmed, with_tax_c, tax_c, diesel_qty_c, diesel_c, def_qty_c, def_c, other_c, discount_c, with_tax_c-tax_c AS before_tax_c,
    CASE WHEN diesel_qty_c>0 THEN CAST(diesel_c AS DOUBLE)/diesel_qty_c END AS avg_billed, CASE WHEN taxed_qty_c>0 THEN CAST(taxed_c-taxed_tax_c AS DOUBLE)/taxed_qty_c END AS avg_pretax,
    CASE WHEN diesel_qty_c>0 THEN CAST(discount_c AS DOUBLE)/diesel_qty_c END AS avg_discount FROM f""",
)
def invoice_figures(stop, line):
    return A.invoice_figures(stop, line)


@query(
    "A12_combined_panel", "stop line fx",
    f"""WITH {SIDES}, c AS (SELECT f.*, CASE WHEN currency='CAD' THEN with_tax_c ELSE CAST(ROUND(CAST(with_tax_c AS DECIMAL(20,0))*CAST(rate_micro AS DECIMAL(12,0))/1000000) AS BIGINT) END AS w,
    CASE WHEN currency='CAD' THEN tax_c ELSE CAST(ROUND(CAST(tax_c AS DECIMAL(20,0))*CAST(rate_micro AS DECIMAL(12,0))/1000000) AS BIGINT) END AS t FROM f LEFT JOIN fx USING (week_end)),
    p AS (SELECT week_end, BOOL_OR(w IS NULL) AS rate_pending, CASE WHEN NOT BOOL_OR(w IS NULL) THEN CAST(SUM(w) AS BIGINT) END AS with_tax_c, CASE WHEN NOT BOOL_OR(w IS NULL) THEN CAST(SUM(t) AS BIGINT) END AS tax_c,
    CASE WHEN NOT BOOL_OR(w IS NULL) THEN COALESCE(SUM(w) FILTER (currency='USD'),0) END AS us_c, COUNT(*) AS sides, CASE WHEN COUNT(*)<2 THEN CASE WHEN MAX(currency)='USD' THEN 'CAD' ELSE 'USD' END END AS missing_side FROM c GROUP BY 1),
    q AS (SELECT *, CASE WHEN sides=2 AND with_tax_c>0 THEN CAST(FLOOR(us_c*100.0/with_tax_c+0.5) AS BIGINT) END AS us_share FROM p)
    SELECT week_end, rate_pending, with_tax_c, tax_c, sides, missing_side, with_tax_c-tax_c AS before_tax_c, us_share, 100-us_share AS ca_share FROM q""",
)
def combined_panel(stop, line, fx):
    return A.combined_panel(A.invoice_figures(stop, line), fx, "CAD")


@query(
    "A15_week_scope", "stop line fx",
    f"""WITH {SIDES}, r AS (SELECT f.*, rate_micro, CASE WHEN diesel_qty_c>0 THEN CAST(diesel_c AS DOUBLE)/diesel_qty_c END AS rr FROM f LEFT JOIN fx USING (week_end))
    SELECT currency, COUNT(*) AS weeks, CAST(SUM(with_tax_c) AS BIGINT) AS with_tax_c, CASE WHEN SUM(diesel_qty_c)>0 THEN CAST(SUM(diesel_c) AS DOUBLE)/CAST(SUM(diesel_qty_c) AS DOUBLE) END AS avg_price, MIN(rr) AS low, MAX(rr) AS high,
    COUNT(rate_micro) AS rated_weeks, CAST(SUM(rate_micro) AS BIGINT) AS rate_sum FROM r GROUP BY 1""",
)
def week_scope(stop, line, fx):
    return A.week_scope(A.invoice_figures(stop, line).join(fx, "week_end", "left"))


@query(
    "A15_combined_scope", "stop line fx",
    f"""WITH {SIDES}, v AS (SELECT f.*, rate_micro, {", ".join(f"CASE WHEN currency='CAD' THEN {n} ELSE CAST(ROUND(CAST({n} AS DECIMAL(20,0))*CAST(rate_micro AS DECIMAL(12,0))/1000000) AS BIGINT) END AS {n[0]}x" for n in ("with_tax_c", "diesel_c"))},
      CASE WHEN currency='CAD' THEN discount_c ELSE CAST(ROUND(CAST(discount_c AS DECIMAL(20,0))*CAST(rate_micro AS DECIMAL(12,0))/1000000) AS BIGINT) END AS cx FROM f LEFT JOIN fx USING (week_end)),
    k AS (SELECT week_end, BOOL_OR(currency='USD') AS has_us, BOOL_OR(currency='CAD') AS has_ca, MAX(rate_micro) AS rate, SUM(wx) AS w, SUM(dx) AS d, SUM(cx) AS c, SUM(diesel_qty_c) FILTER (currency='USD') AS g, SUM(diesel_qty_c) FILTER (currency='CAD') AS l, SUM(stops) AS stops FROM v GROUP BY 1),
    n AS (SELECT *, has_us AND rate IS NOT NULL AS rated, (has_us AND rate IS NOT NULL) OR (NOT has_us AND has_ca) AS ok FROM k),
    o AS (SELECT COUNT(*) FILTER (ok) AS weeks, COUNT(*) FILTER (ok AND has_us) AS us_weeks, COUNT(*) FILTER (ok AND has_ca) AS ca_weeks, CAST(SUM(w) FILTER (ok) AS BIGINT) AS with_tax_c, CAST(SUM(d) FILTER (ok) AS BIGINT) AS diesel_c, CAST(SUM(c) FILTER (ok) AS BIGINT) AS discount_c,
      CAST(SUM(stops) FILTER (ok) AS BIGINT) AS stops, CAST(COALESCE(SUM(g) FILTER (ok), 0) AS BIGINT) AS gallons_c, CAST(COALESCE(SUM(l) FILTER (ok), 0) AS BIGINT) AS litres_c, COUNT(*) FILTER (has_us) AS need_rate, COUNT(*) FILTER (rated) AS rated_weeks, CAST(SUM(rate) FILTER (rated) AS BIGINT) AS rs,
      COALESCE(STRING_AGG(CAST(week_end AS VARCHAR), ',' ORDER BY week_end) FILTER (has_us AND NOT rated), '') AS missing FROM n),
    z AS (SELECT *, gallons_c/100.0::DOUBLE*3.785411784::DOUBLE+litres_c/100.0::DOUBLE AS litres FROM o)
    SELECT weeks, us_weeks, ca_weeks, with_tax_c, diesel_c, discount_c, stops, gallons_c, litres_c, need_rate, rated_weeks, missing, CASE WHEN litres>0 THEN ROUND(diesel_c/100.0::DOUBLE/litres, 8) END AS price_per_litre, ROUND(CAST(rs AS DOUBLE)/rated_weeks/1e6, 8) AS mean_rate FROM z""",
)
def combined_scope(stop, line, fx):
    return A.combined_scope(A.invoice_figures(stop, line), fx)


TREND = """m AS (SELECT currency, strftime(week_end,'%Y-%m') AS period, CAST(SUM(diesel_c) AS BIGINT) AS diesel_c, CAST(SUM(diesel_qty_c) AS BIGINT) AS qty_c, COUNT(*) FILTER (diesel_qty_c>0) AS weeks_with_fuel FROM f GROUP BY 1,2),
  n AS (SELECT *, CASE WHEN qty_c>0 THEN CAST(FLOOR(diesel_c*10000.0/qty_c+0.5) AS BIGINT) END AS price_t FROM m)"""


@query(
    "A16_trend_periods", "stop line",
    f"""WITH {SIDES}, {TREND}, o AS (SELECT *, LAG(price_t) OVER (PARTITION BY currency ORDER BY period) AS b FROM n)
    SELECT currency, period, diesel_c, qty_c, weeks_with_fuel, price_t, CASE WHEN b>0 THEN CAST((price_t-b)*100 AS DOUBLE)/b END AS change_pct FROM o""",
)
def trend_periods(stop, line):
    return A.trend_periods(A.invoice_figures(stop, line)).withColumn("change_pct", F.col("change_pct").cast("double"))


@query(
    "W4_first_and_latest", "stop line",
    f"WITH {SIDES}, {TREND} SELECT currency, ARG_MIN(price_t, period) FILTER (price_t IS NOT NULL) AS first_value, ARG_MAX(price_t, period) FILTER (price_t IS NOT NULL) AS latest_value FROM n GROUP BY 1",
)
def first_latest(stop, line):
    return windows.first_and_latest(A.trend_periods(A.invoice_figures(stop, line)), "currency", "period", "price_t")


@query(
    "A10_side_trend", "stop line",
    f"""WITH {SIDES}, t AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY currency ORDER BY week_end DESC) AS r FROM f) SELECT currency, week_end, CASE WHEN diesel_qty_c>0 THEN CAST(diesel_c AS DOUBLE)/diesel_qty_c END AS avg_billed FROM t WHERE r<=8""",
)
def side_trend(stop, line):
    f = A.invoice_figures(stop, line).select("currency", "week_end", "avg_billed")
    return f.withColumn("r", F.row_number().over(Window.partitionBy("currency").orderBy(F.desc("week_end")))).where("r <= 8").drop("r")


@query(
    "A11_top_spend", "stop",
    """WITH s AS (SELECT week_end, driver_id, CAST(SUM(total_c) AS BIGINT) AS total_c FROM stop GROUP BY ALL), r AS (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY week_end ORDER BY total_c DESC, driver_id NULLS FIRST) AS INT) AS place FROM s) SELECT * FROM r WHERE place<=10""",
)
def top_spend(stop):
    sums = stop.groupBy("week_end", "driver_id").agg(F.sum("total_c").alias("total_c"))
    return sums.withColumn("place", F.row_number().over(Window.partitionBy("week_end").orderBy(F.desc("total_c"), F.asc_nulls_first("driver_id")))).where("place <= 10")


@query(
    "A14_all_weeks", "stop",
    "SELECT week_end, currency, MIN(day) AS first_day, MAX(day) AS last_day, COUNT(*) AS stops, COUNT(DISTINCT driver_id) AS drivers, CAST(SUM(total_c) AS BIGINT) AS total_c FROM stop GROUP BY 1,2",
)
def all_weeks(stop):
    return stop.groupBy("week_end", "currency").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("stops"), F.count_distinct("driver_id").alias("drivers"), F.sum("total_c").alias("total_c"))


@query(
    "A17_billed_by_station_day", "line published",
    """WITH s AS (SELECT station_id, day, COUNT(DISTINCT stop_id) AS stops, CAST(SUM(qty_c) AS BIGINT) AS qty_c, CASE WHEN SUM(qty_c)>0 THEN CAST(CAST(SUM(qty_c*billed_t) AS BIGINT) AS DOUBLE)/CAST(SUM(qty_c) AS DOUBLE) END AS avg_t,
    ARRAY_TO_STRING(LIST_SORT(LIST(DISTINCT billed_t)), ',') AS prices, MAX(billed_t) AS highest_t FROM line WHERE product='TA' GROUP BY 1,2)
    SELECT s.*, price_t, highest_t-price_t AS over_t, CASE WHEN highest_t-price_t>1000 THEN 'red' WHEN highest_t-price_t>0 THEN 'amber' END AS severity FROM s LEFT JOIN published p ON s.station_id=p.station_id AND s.day=p.valid_on""",
)
def billed_by_day(line, published):
    return A.billed_by_station_day(line, published)


@query(
    "A18_latest_state", "event",
    "SELECT user_id, ARG_MAX(event_type, (happened, event_id)) AS event_type, MAX(happened) AS happened FROM event GROUP BY 1",
)
def latest_state(event):
    return A.latest_state(event, "user_id", "event_type", "happened", "event_id")


@query("A19_queue_progress", "stop", "SELECT week_end, currency, COUNT(*) FILTER (status='confirmed') AS done, COUNT(*) AS total FROM stop GROUP BY 1,2")
def progress(stop):
    return stop.groupBy("week_end", "currency").agg(F.count_if(F.col("status") == "confirmed").alias("done"), F.count("*").alias("total"))


@query("A20_products_per_stop", "line", "SELECT stop_id, ARRAY_TO_STRING(LIST_SORT(LIST(DISTINCT product)), ',') AS products, COUNT(*) AS n FROM line GROUP BY 1")
def products_per_stop(line):
    return line.groupBy("stop_id").agg(F.array_join(F.sort_array(F.collect_set("product")), ",").alias("products"), F.count("*").alias("n"))


@query(
    "A27_price_sheets", "line",
    "SELECT day, COUNT(*) AS n_rows, COUNT(DISTINCT station_id) AS stations FROM line WHERE product='DF' GROUP BY 1",
)
def price_sheets(line):
    return line.where("product = 'DF'").groupBy("day").agg(F.count("*").alias("n_rows"), F.count_distinct("station_id").alias("stations"))


@query(
    "A33_top_and_rest", "stop",
    """WITH s AS (SELECT currency, driver_id, CAST(SUM(total_c) AS BIGINT) AS total_c FROM stop WHERE driver_id IS NOT NULL GROUP BY ALL), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY currency ORDER BY total_c DESC, driver_id) AS p FROM s)
    SELECT currency, CASE WHEN p<=10 THEN CAST(driver_id AS VARCHAR) ELSE 'other' END AS label, CAST(SUM(total_c) AS BIGINT) AS total_c, COUNT(*) AS members FROM r GROUP BY 1,2""",
)
def top_and_rest(stop):
    return A.top_and_rest(stop.where("driver_id is not null").groupBy("currency", "driver_id").agg(F.sum("total_c").alias("total_c")), "currency", "driver_id", "total_c")


@query(
    "A32_error_metrics", "line",
    """WITH e AS (SELECT product, billed_t % 401 - 200 AS e FROM line) SELECT product, COUNT(e) AS n, CAST(CAST(SUM(ABS(e)) AS BIGINT) AS DOUBLE)/COUNT(e) AS mae, CAST(CAST(SUM(e) AS BIGINT) AS DOUBLE)/COUNT(e) AS signed,
    GREATEST(0, MAX(-e)) AS worst_under, GREATEST(0, MAX(e)) AS worst_over FROM e GROUP BY 1""",
)
def error_metrics(line):
    return A.error_metrics(line, "product", F.col("billed_t") % 401 - 200)


@query("A36_filter_options", "stop", "SELECT 'driver' AS kind, CAST(driver_id AS VARCHAR) AS choice FROM stop WHERE driver_id IS NOT NULL UNION SELECT 'truck', CAST(truck_id AS VARCHAR) FROM stop WHERE truck_id IS NOT NULL UNION SELECT 'card', CAST(card_id AS VARCHAR) FROM stop")
def options(stop):
    kind = lambda k, c: stop.where(F.col(c).isNotNull()).select(F.lit(k).alias("kind"), F.col(c).cast("string").alias("choice")).distinct()
    return kind("driver", "driver_id").unionByName(kind("truck", "truck_id")).unionByName(kind("card", "card_id"))


@query(
    "F1_filtered_stops", "stop line station",
    """SELECT s.stop_id, s.driver_id, s.day, s.total_c FROM stop s WHERE occurred_at >= TIMESTAMP '1996-01-01' AND occurred_at <= TIMESTAMP '1999-12-31' AND currency='CAD' AND status='pending'
    AND EXISTS (SELECT 1 FROM station t WHERE t.station_id=s.station_id AND t.country='US') AND EXISTS (SELECT 1 FROM line l WHERE l.stop_id=s.stop_id AND l.product='DF')""",
)
def filtered(stop, line, station):
    from datetime import datetime

    out = filters.filter_stops(stop, date_from=datetime(1996, 1, 1), date_to=datetime(1999, 12, 31), currency="CAD", status="pending", state=(station.withColumnRenamed("country", "state"), "US"), product=(line, "DF"))
    return out.select("stop_id", "driver_id", "day", "total_c")


@query("F3_week_range", "stop", "SELECT stop_id, week_end FROM stop WHERE week_end >= DATE '1997-03-02' AND week_end <= DATE '1998-03-01'")
def week_range(stop):
    from datetime import date

    return filters.filter_stops(stop, week_from=date(1997, 3, 2), week_to=date(1998, 3, 1)).select("stop_id", "week_end")


@query("F11_station_box", "station", "SELECT station_id, lat, lng FROM station WHERE country='US' AND resolution<>'unresolved' AND lat BETWEEN 32 AND 42 AND lng BETWEEN -115 AND -85")
def station_box(station):
    return station.where("country = 'US' and resolution <> 'unresolved'").where(F.col("lat").between(32, 42) & F.col("lng").between(-115, -85)).select("station_id", "lat", "lng")


@query(
    "F12_violations", "line",
    "SELECT stop_id, r.rule AS rule, COUNT(*) AS n FROM (SELECT stop_id, UNNEST(LIST_FILTER([CASE WHEN NOT qty_c>=200 THEN 'qty' END, CASE WHEN NOT billed_t<20000000 THEN 'price' END, CASE WHEN NOT tax_p<8 THEN 'tax' END], lambda x: x IS NOT NULL)) AS rule FROM line) r GROUP BY 1,2",
)
def violations(line):
    return filters.violations(line, "stop_id", {"qty": F.col("qty_c") >= 200, "price": F.col("billed_t") < 20000000, "tax": F.col("tax_p") < 8}).groupBy("stop_id", "rule").agg(F.count("*").alias("n"))


@query("F13_not_unique", "stop", "SELECT week_end, currency, driver_id, COUNT(*) AS n FROM stop WHERE status='confirmed' GROUP BY 1,2,3 HAVING COUNT(*)>1")
def not_unique(stop):
    return filters.not_unique(stop, ["week_end", "currency", "driver_id"], F.col("status") == "confirmed")


@query(
    "F14_overlaps", "stop",
    """WITH r AS (SELECT card_id, stop_id, day AS valid_from, day + 20 AS valid_to FROM stop), x AS (SELECT *, MAX(valid_to) OVER (PARTITION BY card_id ORDER BY valid_from, valid_to, stop_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM r)
    SELECT card_id, COUNT(*) AS n FROM x WHERE valid_from<=m GROUP BY 1""",
)
def overlaps(stop):
    r = stop.select("card_id", "stop_id", F.col("day").alias("valid_from"), F.date_add("day", 20).alias("valid_to"))
    return filters.overlaps(r, "card_id").groupBy("card_id").agg(F.count("*").alias("n"))


@query("F15_text_search", "stop", "SELECT stop_id FROM stop WHERE LOWER(driver_raw||' '||unit_raw||' '||status) LIKE '%0012%pending%' OR LOWER(driver_raw||' '||unit_raw||' '||status) LIKE '%000042%'")
def text_search(stop):
    both = filters.text_contains("000042", "driver_raw", "unit_raw", "status") | F.lower(F.concat_ws(" ", "driver_raw", "unit_raw", "status")).like("%0012%pending%")
    return stop.where(both).select("stop_id")


@query("F16_last_weeks", "stop", "SELECT DISTINCT week_end FROM stop ORDER BY 1 DESC LIMIT 4")
def last_weeks(stop):
    return filters.last_weeks(stop.select("week_end").distinct())


@query(
    "F21_overlapping_weeks", "stop",
    "SELECT week_end, MIN(day) AS start_day, MAX(day) AS end_day FROM stop GROUP BY 1 HAVING MIN(day)<=DATE '1998-06-30' AND MAX(day)>=DATE '1998-05-05'",
)
def overlapping(stop):
    from datetime import date

    return filters.overlapping(stop.groupBy("week_end").agg(F.min("day").alias("start_day"), F.max("day").alias("end_day")), date(1998, 6, 30), date(1998, 5, 5))


@query("F22_missing_fields", "stop", "SELECT stop_id, ARRAY_TO_STRING(LIST_FILTER([CASE WHEN driver_id IS NULL THEN 'driver_id' END, CASE WHEN truck_id IS NULL THEN 'truck_id' END, CASE WHEN station_id IS NULL THEN 'station_id' END], lambda x: x IS NOT NULL), ',') AS missing FROM stop WHERE driver_id IS NULL OR truck_id IS NULL OR station_id IS NULL")
def missing(stop):
    return stop.select("stop_id", F.array_join(filters.missing_fields("driver_id", "truck_id", "station_id"), ",").alias("missing")).where("missing <> ''")


@query(
    "J1_transactions", "stop line driver station fx",
    """SELECT s.stop_id, s.week_end, s.driver_id, driver_name, s.station_id, site_name, city, ta_qty_c, ta_billed_t, rate_micro, total_c FROM stop s LEFT JOIN driver USING (driver_id) LEFT JOIN station USING (station_id)
    LEFT JOIN (SELECT stop_id, CAST(SUM(qty_c) AS BIGINT) AS ta_qty_c, MAX(billed_t) AS ta_billed_t FROM line WHERE product='TA' GROUP BY 1) d USING (stop_id) LEFT JOIN fx USING (week_end)""",
)
def transactions(stop, line, driver, station, fx):
    return joins.transactions(stop, line, driver, station, fx).select("stop_id", "week_end", "driver_id", "driver_name", "station_id", "site_name", "city", "ta_qty_c", "ta_billed_t", "rate_micro", "total_c")


@query(
    "J5_exact_date_prices", "stop published",
    "SELECT stop_id, s.station_id, s.day, price_t, n_prices, CASE WHEN valid_on IS NULL THEN 'no_price_on_date' WHEN price_t IS NULL THEN 'price_basis_null' END AS excluded FROM stop s LEFT JOIN published p ON s.station_id=p.station_id AND s.day=p.valid_on",
)
def exact_prices(stop, published):
    return joins.exact_date_prices(stop.select("stop_id", "station_id", "day"), published)


@query(
    "J9_effective_dated", "stop assignment",
    "SELECT stop_id, s.driver_id, day, a.truck_id, valid_from FROM (SELECT stop_id, driver_id, day FROM stop) s LEFT JOIN assignment a ON s.driver_id=a.driver_id AND day>=valid_from AND day<=COALESCE(valid_to, DATE '9999-12-31')",
)
def effective(stop, assignment):
    return joins.effective_dated(stop.select("stop_id", "driver_id", "day"), assignment, "driver_id").select("stop_id", "driver_id", "day", "truck_id", "valid_from")


@query(
    "J11_match_names", "stop driver",
    """WITH al AS (SELECT UPPER(driver_name) AS alias, MIN(driver_id)+1 AS driver_id FROM driver WHERE driver_id % 3 = 0 GROUP BY 1) SELECT stop_id, CASE WHEN al.driver_id IS NOT NULL THEN al.driver_id ELSE d.driver_id END AS matched_id,
    CASE WHEN al.driver_id IS NOT NULL THEN 'alias' WHEN d.driver_id IS NOT NULL THEN 'roster' ELSE 'unmatched' END AS matched_by FROM stop LEFT JOIN al ON UPPER(driver_raw)=alias LEFT JOIN driver d ON driver_raw=d.driver_name""",
)
def match_names(stop, driver):
    aliases = driver.where("driver_id % 3 = 0").select(F.upper("driver_name").alias("alias"), (F.col("driver_id") + 1).alias("driver_id"))
    return joins.match_names(stop.select("stop_id", "driver_raw"), aliases, driver).select("stop_id", "matched_id", "matched_by")


@query(
    "J12_match_stations", "stop station",
    """WITH r AS (SELECT stop_id, station_id, CASE WHEN stop_id % 2 = 0 THEN CAST(station_id AS VARCHAR)||' ' END AS ref, 'Stop #'||CAST(station_id+5 AS VARCHAR) AS nm FROM stop)
    SELECT stop_id, COALESCE(a.station_id, b.station_id) AS matched_id FROM r LEFT JOIN station a ON TRIM(ref)=CAST(a.station_id AS VARCHAR) LEFT JOIN station b ON r.station_id+5=b.station_id""",
)
def match_stations(stop, station):
    rows = stop.select("stop_id", F.when(F.col("stop_id") % 2 == 0, F.concat(F.col("station_id").cast("string"), F.lit(" "))).alias("site_ref"), F.concat(F.lit("Stop #"), (F.col("station_id") + 5).cast("string")).alias("site_name"))
    known = station.select("station_id", F.col("station_id").cast("string").alias("site_ref"), F.col("station_id").alias("store_number"))
    return joins.match_stations(rows, known).select("stop_id", "matched_id")


@query(
    "J13_match_units", "stop",
    """WITH t AS (SELECT DISTINCT truck_id, CASE WHEN truck_id % 5 = 0 THEN '0'||CAST(truck_id AS VARCHAR) ELSE CAST(truck_id AS VARCHAR) END AS u FROM stop WHERE truck_id IS NOT NULL)
    SELECT stop_id, COALESCE(a.truck_id, b.truck_id) AS matched_id FROM stop s LEFT JOIN t a ON TRIM(unit_raw)=a.u LEFT JOIN t b ON TRY_CAST(TRIM(unit_raw) AS BIGINT)=b.truck_id""",
)
def match_units(stop):
    unit = F.col("truck_id").cast("string")
    trucks = stop.where("truck_id is not null").select("truck_id").distinct().select("truck_id", F.when(F.col("truck_id") % 5 == 0, F.concat(F.lit("0"), unit)).otherwise(unit).alias("unit_number"))
    return joins.match_units(stop.select("stop_id", "unit_raw"), trucks).select("stop_id", "matched_id")


@query(
    "J16_published_prices", "stop published",
    "SELECT station_id, valid_on, price_t FROM published p WHERE EXISTS (SELECT 1 FROM stop s WHERE s.station_id=p.station_id AND s.day=p.valid_on)",
)
def published_present(stop, published):
    return published.join(stop.select("station_id", F.col("day").alias("valid_on")), ["station_id", "valid_on"], "left_semi").select("station_id", "valid_on", "price_t")


@query(
    "J17_latest_plan", "event",
    "SELECT user_id, CAST(happened AS DATE) AS day, event_id, value_c FROM event WHERE event_type='purchase' QUALIFY ROW_NUMBER() OVER (PARTITION BY user_id, CAST(happened AS DATE) ORDER BY happened DESC, event_id DESC)=1",
)
def latest_plan(event):
    own = event.where("event_type = 'purchase'").withColumn("day", F.to_date("happened"))
    return joins.first_per(own, ["user_id", "day"], F.desc("happened"), F.desc("event_id")).select("user_id", "day", "event_id", "value_c")


# A plan is dispatched some minutes around a fill of its truck; its price is the station's lowest of the day.
PLANNED = """a AS (SELECT s.stop_id, truck_id, day, s.station_id, occurred_at, s.stop_id % 23 = 5 AS split_fill, qty_c, billed_t FROM stop s JOIN (SELECT stop_id, CAST(SUM(qty_c) AS BIGINT) AS qty_c, MAX(billed_t) AS billed_t FROM line WHERE product='TA' GROUP BY 1) l ON s.stop_id=l.stop_id),
  p AS (SELECT stop_id + 1000000000 AS plan_stop_id, truck_id, CAST(d AS DATE) AS day, station_id, d AS dispatched_at, 20000 + stop_id % 9000 AS price_t FROM (SELECT *, occurred_at + INTERVAL 1 MINUTE * CAST(stop_id * 7 % 400 - 200 AS INT) AS d FROM stop WHERE stop_id % 3 = 0 AND truck_id IS NOT NULL AND station_id IS NOT NULL)),
  ok AS (SELECT * FROM a WHERE station_id IS NOT NULL AND NOT split_fill), pr AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY truck_id, day, station_id ORDER BY dispatched_at, plan_stop_id) AS k FROM p),
  c AS (SELECT pr.truck_id, pr.day, pr.station_id, plan_stop_id, k, stop_id, (ABS(epoch_us(occurred_at)-epoch_us(dispatched_at)), occurred_at, stop_id) AS o FROM pr JOIN ok ON pr.truck_id=ok.truck_id AND pr.day=ok.day AND pr.station_id=ok.station_id),
  m1 AS (SELECT truck_id, day, station_id, plan_stop_id, ARG_MIN(stop_id, o) AS stop_id FROM c WHERE k=1 GROUP BY ALL), m2 AS (SELECT truck_id, day, station_id, plan_stop_id, ARG_MIN(stop_id, o) AS stop_id FROM c WHERE k=2 AND stop_id NOT IN (SELECT stop_id FROM m1) GROUP BY ALL),
  m AS (SELECT * FROM m1 UNION ALL SELECT * FROM m2), g AS (SELECT truck_id, day, station_id, plan_stop_id, stop_id, 'matched' AS kind FROM m
    UNION ALL SELECT truck_id, day, station_id, plan_stop_id, NULL, 'skipped_recommendation' FROM p WHERE plan_stop_id NOT IN (SELECT plan_stop_id FROM m) UNION ALL SELECT truck_id, day, station_id, NULL, stop_id, 'unplanned_stop' FROM ok WHERE stop_id NOT IN (SELECT stop_id FROM m)),
  x AS (SELECT g.*, CASE WHEN kind='matched' THEN price_t*qty_c END AS planned_m, CASE WHEN kind='matched' THEN billed_t*qty_c END AS actual_m, CASE WHEN kind='matched' THEN (billed_t-price_t)*qty_c END AS delta_m FROM g LEFT JOIN p ON g.plan_stop_id=p.plan_stop_id LEFT JOIN a ON g.stop_id=a.stop_id)"""


def _planned_and_actual(stop: DataFrame, line: DataFrame) -> tuple[DataFrame, DataFrame]:
    diesel = line.where("product = 'TA'").groupBy("stop_id").agg(F.sum("qty_c").alias("qty_c"), F.max("billed_t").alias("billed_t"))
    actual = stop.join(diesel, "stop_id").select("stop_id", "truck_id", "day", "station_id", "occurred_at", (F.col("stop_id") % 23 == 5).alias("split_fill"), "qty_c", "billed_t")
    own = stop.where("stop_id % 3 = 0 and truck_id is not null and station_id is not null")
    at = F.timestamp_add("MINUTE", (F.col("stop_id") * 7 % 400 - 200).cast("int"), F.col("occurred_at"))
    planned = own.select((F.col("stop_id") + 1000000000).alias("plan_stop_id"), "truck_id", F.to_date(at).alias("day"), "station_id", at.alias("dispatched_at"), (20000 + F.col("stop_id") % 9000).alias("price_t"))
    return planned, actual


@query("J20_plan_actual", "stop line", f"WITH {PLANNED} SELECT * FROM g")
def plan_actual(stop, line):
    return joins.plan_actual(*_planned_and_actual(stop, line))


def _deltas(stop: DataFrame, line: DataFrame) -> tuple[DataFrame, DataFrame]:
    planned, actual = _planned_and_actual(stop, line)
    return joins.match_deltas(planned, actual), actual


@query("R10_match_deltas", "stop line", f"WITH {PLANNED} SELECT * FROM x")
def match_deltas(stop, line):
    return _deltas(stop, line)[0]


@query(
    "A30_plan_summary", "stop line",
    f"WITH {PLANNED} SELECT COUNT(*) FILTER (kind='matched') AS covered, 100.0*COUNT(*) FILTER (kind='matched')/COUNT(*) FILTER (kind<>'unplanned_stop') AS adherence, CAST(SUM(GREATEST(delta_m, 0)) AS BIGINT) AS left_on_table_m, (SELECT COUNT(*) FROM a) AS total FROM x",
)
def plan_summary(stop, line):
    return A.plan_summary(*_deltas(stop, line))


@query(
    "A30_truck_variance", "stop line",
    f"""WITH {PLANNED} SELECT truck_id, COUNT(*) FILTER (kind='matched') AS matched, COUNT(*) FILTER (kind<>'matched') AS skipped, CAST(COALESCE(SUM(planned_m),0) AS BIGINT) AS planned_m, CAST(COALESCE(SUM(actual_m),0) AS BIGINT) AS actual_m, CAST(COALESCE(SUM(delta_m),0) AS BIGINT) AS delta_m,
    100.0*COUNT(*) FILTER (kind='matched')/COUNT(*) AS adherence FROM x WHERE plan_stop_id IS NOT NULL GROUP BY 1""",
)
def truck_variance(stop, line):
    return A.truck_variance(_deltas(stop, line)[0])


@query("J20_exclusions", "stop line", f"WITH {PLANNED} SELECT COUNT(*) FILTER (split_fill) AS split_fill, COUNT(*) FILTER (NOT split_fill AND station_id IS NULL) AS unresolved_station FROM a")
def match_exclusions(stop, line):
    return joins.match_exclusions(_planned_and_actual(stop, line)[1])


@query(
    "J23_roster_outer", "stop driver",
    """WITH a AS (SELECT driver_id, COUNT(*) AS stops, CAST(SUM(total_c) AS BIGINT) AS total_c FROM stop GROUP BY 1) SELECT d.driver_id, driver_name, COALESCE(stops,0) AS stops, COALESCE(total_c,0) AS total_c FROM driver d LEFT JOIN a USING (driver_id)
    UNION ALL SELECT NULL, NULL, stops, total_c FROM a WHERE driver_id IS NULL""",
)
def roster(stop, driver):
    activity = stop.groupBy("driver_id").agg(F.count("*").alias("stops"), F.sum("total_c").alias("total_c"))
    return joins.roster_outer(driver.select("driver_id", "driver_name"), activity, "driver_id", ["stops", "total_c"])


@query(
    "J24_merge_sides", "stop",
    """SELECT week_end, driver_id, CAST(COALESCE(SUM(total_c) FILTER (currency='USD'),0) AS BIGINT) AS us_c, CAST(COALESCE(SUM(total_c) FILTER (currency='CAD'),0) AS BIGINT) AS ca_c FROM stop GROUP BY 1,2""",
)
def merge_sides(stop):
    side = lambda c, name: stop.where(F.col("currency") == c).groupBy("week_end", "driver_id").agg(F.sum("total_c").alias(name))
    both = side("USD", "us_c").unionByName(side("CAD", "ca_c"), allowMissingColumns=True)
    return both.groupBy("week_end", "driver_id").agg(F.coalesce(F.sum("us_c"), F.lit(0)).alias("us_c"), F.coalesce(F.sum("ca_c"), F.lit(0)).alias("ca_c"))


@query(
    "W1_too_close", "event",
    """WITH g AS (SELECT user_id, event_id, LAG(event_id) OVER (PARTITION BY user_id, event_type ORDER BY happened, event_id) AS previous_id, epoch_us(happened)-LAG(epoch_us(happened)) OVER (PARTITION BY user_id, event_type ORDER BY happened, event_id) AS gap FROM event)
    SELECT user_id, event_id, previous_id, gap//1000000 AS gap_s FROM g WHERE gap<=7200000000""",
)
def too_close(event):
    return windows.too_close(event, ["user_id", "event_type"], "happened", "event_id", 120).select("user_id", "event_id", "previous_id", "gap_s")


@query(
    "W2_stratified_top", "line",
    """WITH c AS (SELECT station_id AS lane, part_id, stop_id*37 % 1000 AS mile, MIN(billed_t) AS price FROM line GROUP BY ALL), b AS (SELECT *, CAST(mile//50 AS INT) AS bucket FROM c),
    r AS (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY lane, bucket ORDER BY price, mile, part_id) AS INT) AS round FROM b), p AS (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY lane ORDER BY round, price, mile, part_id) AS INT) AS place,
    COUNT(*) FILTER (round=1) OVER (PARTITION BY lane) AS occ FROM r) SELECT lane, part_id, mile, price, bucket, round, place FROM p WHERE place<=GREATEST(40, occ)""",
)
def stratified(line):
    c = line.groupBy(F.col("station_id").alias("lane"), "part_id", (F.col("stop_id") * 37 % 1000).alias("mile")).agg(F.min("billed_t").alias("price"))
    return windows.stratified_top(c, "lane", "mile", "price", "part_id")


@query(
    "W7_trailing_weeks", "stop",
    """WITH w AS (SELECT currency, week_end, CAST(SUM(total_c) AS BIGINT) AS total_c FROM stop GROUP BY 1,2) SELECT currency, week_end, CAST(SUM(total_c) OVER (PARTITION BY currency ORDER BY week_end ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS BIGINT) AS trailing_c FROM w""",
)
def trailing(stop):
    w = stop.groupBy("currency", "week_end").agg(F.sum("total_c").alias("total_c"))
    return w.select("currency", "week_end", F.sum("total_c").over(Window.partitionBy("currency").orderBy("week_end").rowsBetween(-7, 0)).alias("trailing_c"))


@query("W8_running_total", "event", "SELECT event_id, user_id, CAST(SUM(value_c) OVER (PARTITION BY user_id ORDER BY happened, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run_c FROM event")
def running(event):
    return windows.running(event, ["user_id"], ["happened", "event_id"], "value_c", "run_c").select("event_id", "user_id", "run_c")


@query(
    "W9_realized_fuel", "event",
    """WITH RECURSIVE e AS (SELECT user_id, event_id, value_c % 400 AS leg, value_c * 7 % 3000 AS planned, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY happened, event_id) AS k FROM event),
    r AS (SELECT user_id, event_id, k, 3000-leg AS arrival, GREATEST(planned, 3000-leg) AS departure FROM e WHERE k=1
    UNION ALL SELECT e.user_id, e.event_id, e.k, r.departure-leg, GREATEST(planned, r.departure-leg) FROM e JOIN r ON e.user_id=r.user_id AND e.k=r.k+1) SELECT event_id, arrival, departure FROM r""",
)
def realized(event):
    w = Window.partitionBy("user_id").orderBy("happened", "event_id")
    e = event.select("user_id", "event_id", F.row_number().over(w).alias("k"), (F.col("value_c") % 400).alias("leg"), (F.col("value_c") * 7 % 3000).alias("planned"))
    return windows.realize_fuel(e, "user_id", "k", F.lit(3000).cast("bigint"), "leg", "planned").select("event_id", "arrival", "departure")


@query(
    "W11_short_legs", "event",
    """WITH m AS (SELECT user_id, event_id, CAST(SUM(value_c) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS mile FROM event), l AS (SELECT user_id, event_id, LAG(event_id) OVER w AS previous, mile-COALESCE(LAG(mile) OVER w, 0) AS leg FROM m WINDOW w AS (PARTITION BY user_id ORDER BY mile, event_id))
    SELECT user_id, event_id, previous, leg FROM l WHERE leg<2000-1e-6""",
)
def short_legs(event):
    m = windows.running(event, ["user_id"], ["event_id"], "value_c", "mile").withColumn("mile", F.col("mile").cast("double"))
    return windows.short_legs(m, "user_id", "mile", "event_id", 2000).select("user_id", "event_id", "previous", "leg")


@query(
    "W12_quota_drift", "event",
    """WITH q AS (SELECT event_id, user_id, happened, 5000 - value_c % 5000 AS remaining, value_c % 50 AS ours FROM event), d AS (SELECT *, LAG(remaining) OVER (PARTITION BY user_id ORDER BY happened, event_id) AS b FROM q)
    SELECT event_id, CASE WHEN b IS NULL THEN NULL WHEN b-remaining<0 THEN 0 ELSE GREATEST(0, b-remaining-ours) END AS drift FROM d""",
)
def quota(event):
    q = event.select("event_id", "user_id", "happened", (5000 - F.col("value_c") % 5000).alias("remaining"), (F.col("value_c") % 50).alias("ours"))
    return windows.quota_drift(q, ["user_id"], "happened", "remaining", "ours", "event_id").select("event_id", "drift")


@query("W13_admitted_calls", "event", "SELECT event_id, ROW_NUMBER() OVER (PARTITION BY event_type, CAST(happened AS DATE) ORDER BY happened, event_id)<=50 AS admitted FROM event")
def admitted(event):
    return windows.admit(event, ["event_type"], "happened", "event_id", 50).select("event_id", "admitted")


@query(
    "W15_in_force", "assignment",
    "SELECT driver_id, ARG_MAX(truck_id, (valid_from, truck_id)) AS truck_id FROM assignment WHERE valid_from<=DATE '1998-07-01' AND COALESCE(valid_to, DATE '9999-12-31')>=DATE '1998-07-01' GROUP BY 1",
)
def in_force(assignment):
    return windows.in_force(assignment, "driver_id", F.lit("1998-07-01").cast("date"))


@query(
    "W14_changed_window", "assignment",
    """WITH b AS (SELECT driver_id, truck_id, valid_from, COALESCE(valid_to, DATE '9999-12-30') AS e FROM assignment), a AS (SELECT driver_id, CASE WHEN driver_id % 4 = 0 AND valid_from = DATE '1997-01-01' THEN truck_id+1 ELSE truck_id END AS truck_id, valid_from, COALESCE(valid_to, DATE '9999-12-30') AS e FROM assignment)
    SELECT b.driver_id, MIN(b.valid_from) AS changed_from, MAX(b.e) AS changed_to FROM b JOIN a ON b.driver_id=a.driver_id AND b.valid_from=a.valid_from WHERE a.truck_id<>b.truck_id GROUP BY 1""",
)
def changed(assignment):
    moved = F.when((F.col("driver_id") % 4 == 0) & (F.col("valid_from") == F.lit("1997-01-01").cast("date")), F.col("truck_id") + 1).otherwise(F.col("truck_id"))
    return windows.changed_window(assignment, assignment.withColumn("truck_id", moved), "driver_id")


@query(
    "W17_assignment_history", "stop",
    """WITH o AS (SELECT driver_id, day, MAX(truck_id + stop_id % 2) AS truck FROM stop WHERE driver_id IS NOT NULL AND truck_id IS NOT NULL GROUP BY 1,2), m AS (SELECT *, LAG(truck) OVER (PARTITION BY driver_id ORDER BY day) AS b FROM o),
    k AS (SELECT * FROM m WHERE b IS NULL OR b<>truck) SELECT driver_id, truck, day AS valid_from, CAST(LEAD(day) OVER (PARTITION BY driver_id ORDER BY day) - 1 AS DATE) AS valid_to FROM k""",
)
def history(stop):
    c = stop.where("driver_id is not null and truck_id is not null").select("driver_id", "day", (F.col("truck_id") + F.col("stop_id") % 2).alias("truck"))
    return windows.assignment_history(c, "driver_id", "day", "truck")


@query("O1_page", "stop", "SELECT stop_id, total_c, day FROM stop ORDER BY total_c DESC, stop_id LIMIT 50 OFFSET 100")
def page(stop):
    return windows.page(stop.select("stop_id", "total_c", "day"), [F.desc("total_c"), F.asc("stop_id")], 50, 2)


@query("O1_page_numbers", "stop", "SELECT stop_id, currency, CAST((ROW_NUMBER() OVER (PARTITION BY currency, week_end ORDER BY total_c DESC, stop_id)-1)//50 AS INT) AS page FROM stop")
def page_numbers(stop):
    keyed = stop.withColumn("part", F.concat_ws("|", "currency", "week_end"))
    return windows.page_numbers(keyed, "part", [F.desc("total_c"), F.asc("stop_id")], 50).select("stop_id", "currency", "page")


@query(
    "O3_digest", "stop",
    "SELECT stop_id, status, occurred_at FROM stop ORDER BY (status='missing') DESC, occurred_at DESC, stop_id LIMIT 10",
)
def digest(stop):
    return stop.select("stop_id", "status", "occurred_at").orderBy(F.desc(F.col("status") == "missing"), F.desc("occurred_at"), "stop_id").limit(10)


@query("U3_new_keys", "line", "SELECT DISTINCT part_id FROM line a WHERE day>=DATE '2001-01-01' AND NOT EXISTS (SELECT 1 FROM line b WHERE b.part_id=a.part_id AND b.day BETWEEN DATE '2000-06-01' AND DATE '2000-12-31')")
def new_keys(line):
    return sets.new_keys(line.where("day >= DATE '2001-01-01'"), line.where("day between DATE '2000-06-01' and DATE '2000-12-31'"), "part_id")


@query("U3_vanished_keys", "line", "SELECT DISTINCT part_id FROM line a WHERE day BETWEEN DATE '2000-06-01' AND DATE '2000-12-31' AND NOT EXISTS (SELECT 1 FROM line b WHERE b.part_id=a.part_id AND b.day>=DATE '2001-01-01')")
def vanished_keys(line):
    return sets.vanished_keys(line.where("day between DATE '2000-06-01' and DATE '2000-12-31'"), line.where("day >= DATE '2001-01-01'"), "part_id")


@query(
    "U4_day_gaps", "line",
    """WITH s AS (SELECT station_id, MIN(day) AS a, MAX(day) AS b FROM line GROUP BY 1), w AS (SELECT station_id, CAST(UNNEST(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM s) SELECT station_id, day FROM w WHERE NOT EXISTS (SELECT 1 FROM line l WHERE l.station_id=w.station_id AND l.day=w.day)""",
)
def day_gaps(line):
    return sets.day_gaps(line, "station_id", "day")


@query(
    "U5_coverage_gaps", "stop",
    """WITH r AS (SELECT DISTINCT truck_id, CAST(week_end - 6 AS DATE) AS a, week_end AS b FROM stop), c AS (SELECT DISTINCT truck_id, CAST(UNNEST(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM r),
    s AS (SELECT truck_id, MIN(day) AS lo, MAX(day) AS hi FROM c GROUP BY 1), w AS (SELECT truck_id, CAST(UNNEST(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS day FROM s) SELECT w.truck_id, w.day FROM w LEFT JOIN c ON w.truck_id IS NOT DISTINCT FROM c.truck_id AND w.day=c.day WHERE c.day IS NULL""",
)
def coverage_gaps(stop):
    """Days of each truck that no billing week with a stop of it covers."""
    r = stop.select(F.coalesce("truck_id", F.lit(-1)).alias("truck_id"), F.date_sub("week_end", 6).alias("start_day"), F.col("week_end").alias("end_day")).distinct()
    return sets.coverage_gaps(r, "truck_id").withColumn("truck_id", F.when(F.col("truck_id") >= 0, F.col("truck_id")))


@query("U4_gap_ranges", "line", """WITH d AS (SELECT DISTINCT station_id, day FROM line), n AS (SELECT station_id, day, LEAD(day) OVER (PARTITION BY station_id ORDER BY day) AS next FROM d) SELECT station_id, CAST(day+1 AS DATE) AS from_day, CAST(next-1 AS DATE) AS to_day FROM n WHERE next>day+1""")
def day_gap_ranges(line):
    return sets.gap_ranges(line.select("station_id", F.col("day").alias("start_day"), F.col("day").alias("end_day")), "station_id")


@query("U5_gap_ranges", "stop", """WITH r AS (SELECT DISTINCT truck_id, CAST(week_end - 6 AS DATE) AS a, week_end AS b FROM stop), n AS (SELECT truck_id, b, LEAD(a) OVER (PARTITION BY truck_id ORDER BY a) AS next FROM r) SELECT truck_id, CAST(b+1 AS DATE) AS from_day, CAST(next-1 AS DATE) AS to_day FROM n WHERE next>b+1""")
def coverage_gap_ranges(stop):
    return sets.gap_ranges(stop.select("truck_id", F.date_sub("week_end", 6).alias("start_day"), F.col("week_end").alias("end_day")), "truck_id")


@query(
    "U7_snapshot_diff", "stop",
    """WITH a AS (SELECT stop_id, truck_id, CASE WHEN stop_id % 6 = 0 THEN NULL ELSE truck_id END AS t2, station_id, CASE WHEN stop_id % 5 = 0 THEN station_id+1 ELSE station_id END AS s2 FROM stop)
    SELECT stop_id, 'truck_id' AS field, CAST(truck_id AS VARCHAR) AS before, CAST(t2 AS VARCHAR) AS after FROM a WHERE truck_id IS DISTINCT FROM t2 UNION ALL SELECT stop_id, 'station_id', CAST(station_id AS VARCHAR), CAST(s2 AS VARCHAR) FROM a WHERE station_id IS DISTINCT FROM s2""",
)
def snapshot_diff(stop):
    after = stop.withColumns({"truck_id": F.when(F.col("stop_id") % 6 != 0, F.col("truck_id")), "station_id": F.when(F.col("stop_id") % 5 == 0, F.col("station_id") + 1).otherwise(F.col("station_id"))})
    return sets.diff_snapshots(stop, after, "stop_id", ["truck_id", "station_id"])
