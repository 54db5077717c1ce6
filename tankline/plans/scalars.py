"""Registered queries: scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tankline.functions import exprs as C
from tankline.plans.registry import query

L = "3.785411784::DOUBLE"


@query("C1_clean_header", "part", r"SELECT p_partkey, REGEXP_REPLACE(UPPER(TRIM('  '||p_name||'   '||p_type||' ')), '\s+', ' ', 'g') AS header FROM part")
def clean_header(part):
    return part.select("p_partkey", C.clean_header(F.concat(F.lit("  "), "p_name", F.lit("   "), "p_type", F.lit(" "))).alias("header"))


@query(
    "C2_normalized_city", "part",
    r"""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'St. '||UPPER(SPLIT_PART(p_name,' ',1))[1]||LOWER(SPLIT_PART(p_name,' ',1))[2:]||' of '||UPPER(SPLIT_PART(p_name,' ',2))[1]||LOWER(SPLIT_PART(p_name,' ',2))[2:]
    WHEN 1 THEN 'Mount '||p_name WHEN 2 THEN 'North '||UPPER(SPLIT_PART(p_name,' ',1))[1]||LOWER(SPLIT_PART(p_name,' ',1))[2:] ELSE p_name END AS city FROM part""",
)
def city(part):
    raw = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("ST "), F.upper(F.split_part("p_name", F.lit(" "), F.lit(1))), F.lit(" OF "), F.upper(F.split_part("p_name", F.lit(" "), F.lit(2)))))
    raw = raw.when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("Mt "), "p_name")).when(F.col("p_partkey") % 4 == 2, F.concat(F.lit("N "), F.upper(F.split_part("p_name", F.lit(" "), F.lit(1))))).otherwise(F.col("p_name"))
    return part.select("p_partkey", C.normalize_city(raw).alias("city"))


@query("C4_store_name", "station", r"SELECT station_id, REGEXP_EXTRACT(site_name, '^(.*?)\s*#\s*(\d+)\s*$', 1) AS brand, CAST(REGEXP_EXTRACT(site_name, '^(.*?)\s*#\s*(\d+)\s*$', 2) AS BIGINT) AS number FROM station")
def store_name(station):
    return station.select("station_id", C.store_brand(F.col("site_name")).alias("brand"), C.store_number(F.col("site_name")).alias("number"))


@query("C5_display_case", "customer", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN UPPER(c_mktsegment)[1]||LOWER(c_mktsegment)[2:]||' BVD' ELSE LOWER(c_mktsegment)||' BVD' END AS shown FROM customer")
def shown(customer):
    text = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.upper("c_mktsegment"), F.lit(" BVD"))).otherwise(F.concat(F.lower("c_mktsegment"), F.lit(" BVD")))
    return customer.select("c_custkey", C.display_case(text, ("BVD",)).alias("shown"))


@query("C6_same_unit", "stop", "SELECT stop_id, CASE WHEN REGEXP_FULL_MATCH(TRIM(unit_raw), '\\d+') THEN CAST(TRIM(unit_raw) AS BIGINT)=truck_id ELSE TRIM(unit_raw)=CAST(truck_id AS VARCHAR) END AS same FROM stop WHERE truck_id IS NOT NULL")
def same_unit(stop):
    return stop.where("truck_id is not null").select("stop_id", C.same_unit(F.col("unit_raw"), F.col("truck_id").cast("string")).alias("same"))


@query("C9_decimal_text", "line", "SELECT stop_id, SUM(CASE WHEN part_id % 3 = 0 THEN CAST(CAST(qty_c AS DECIMAL(18,0))/100 AS DECIMAL(18,2)) END) AS parsed, COUNT(*) AS n FROM line GROUP BY 1")
def decimal_text(line):
    text = F.when(F.col("part_id") % 3 == 0, C.from_cents(F.col("qty_c")).cast("string")).when(F.col("part_id") % 3 == 1, F.concat(F.col("qty_c").cast("string"), F.lit("e3"))).otherwise(F.concat(F.lit("+"), F.col("qty_c").cast("string")))
    return line.withColumn("d", C.decimal_text(text, 2)).groupBy("stop_id").agg(F.sum("d").cast("decimal(38,2)").alias("parsed"), F.count("*").alias("n"))


@query("C11_units", "line", f"SELECT stop_id, part_id, qty_c*1609.344::DOUBLE AS meters, qty_c/1609.344::DOUBLE AS miles, qty_c/{L} AS gallons, qty_c*{L} AS liters FROM line")
def units(line):
    q = F.col("qty_c")
    return line.select("stop_id", "part_id", C.meters_from_miles(q).alias("meters"), C.miles_from_meters(q).alias("miles"), C.gallons_from_liters(q).alias("gallons"), C.liters_from_gallons(q).alias("liters"))


@query(
    "C12_converted_quantities", "line stop",
    f"""SELECT l.stop_id, part_id, CASE WHEN currency='USD' THEN qty_c/100.0::DOUBLE ELSE FLOOR(qty_c/100.0::DOUBLE/{L}*10000.0+0.5)/10000.0 END AS gallons, CASE WHEN currency='USD' THEN billed_t/10000.0::DOUBLE ELSE FLOOR(billed_t/10000.0::DOUBLE*{L}*1000000.0+0.5)/1000000.0 END AS per_gallon
    FROM line l JOIN stop s ON l.stop_id=s.stop_id""",
)
def converted(line, stop):
    own = line.join(stop.select("stop_id", C.unit_of(F.col("currency")).alias("unit")), "stop_id")
    return own.select("stop_id", "part_id", C.quantity_in(F.col("qty_c") / 100.0, F.col("unit"), "gal").alias("gallons"), C.per_unit_in(F.col("billed_t") / 10000.0, F.col("unit"), "gal").alias("per_gallon"))


@query("C13_converted_money", "stop fx", "SELECT stop_id, CASE WHEN currency='CAD' THEN total_c ELSE CAST(ROUND(CAST(total_c AS DECIMAL(20,0))*CAST(rate_micro AS DECIMAL(12,0))/1000000) AS BIGINT) END AS cad_c FROM stop LEFT JOIN fx USING (week_end)")
def money(stop, fx):
    return stop.join(fx, "week_end", "left").select("stop_id", C.convert_cents(F.col("total_c"), F.col("currency"), "CAD", F.col("rate_micro")).alias("cad_c"))


@query(
    "C15_fx_problems", "event",
    "SELECT event_id, CASE WHEN r IS NULL THEN 'missing' WHEN r<=0 THEN 'not positive' WHEN r<0.5 OR r>3.0 THEN 'out of range' WHEN ABS(r*1e6-ROUND(r*1e6))>1e-6 THEN 'too many decimals' END AS problem FROM (SELECT event_id, CASE WHEN event_type='error' THEN NULL ELSE (value_c-100)/1000.0::DOUBLE END AS r FROM event)",
)
def fx_problems(event):
    return event.select("event_id", C.fx_problem(F.when(F.col("event_type") != "error", (F.col("value_c") - 100) / 1000.0)).alias("problem"))


@query("C17_iso_days", "stop", "SELECT stop_id, CASE WHEN stop_id % 3 = 0 THEN day WHEN stop_id % 3 = 1 THEN NULL ELSE CAST(day + 7 AS DATE) END AS d FROM stop")
def iso_days(stop):
    text = F.when(F.col("stop_id") % 3 == 0, F.date_format("day", "yyyy-MM-dd")).when(F.col("stop_id") % 3 == 1, F.concat(F.date_format("day", "yyyy-"), F.lit("13-45"))).otherwise(F.date_format(F.date_add("day", 7), "yyyy-MM-dd"))
    return stop.select("stop_id", C.iso_day(text).alias("d"))


@query("C18_raw_and_resolved", "stop", "SELECT stop_id, driver_id AS resolved, TRIM(driver_raw) AS raw, CASE WHEN driver_id IS NOT NULL AND TRIM(driver_raw)<>'' THEN driver_raw='Customer#'||LPAD(CAST(driver_id AS VARCHAR),9,'0') END AS agrees FROM stop")
def raw_resolved(stop):
    agrees = F.col("driver_raw") == F.concat(F.lit("Customer#"), F.lpad(F.col("driver_id").cast("string"), 9, "0"))
    return stop.select("stop_id", C.raw_resolved(F.col("driver_id"), F.trim("driver_raw"), agrees).alias("r")).select("stop_id", "r.*")


@query("C20_neutral_keys", "event", "SELECT event_id, CASE WHEN event_type='error' THEN 'maxOverage,quantity' WHEN event_type='view' THEN 'note,quantity' ELSE 'amount,quantity' END AS keys FROM event")
def neutral(event):
    name = F.when(F.col("event_type") == "error", "maxOverageUsdPerGal").when(F.col("event_type") == "view", "note").otherwise("amountUsd")
    m = F.create_map(name, F.col("value_c"), F.lit("gallons"), F.col("value_c"))
    return event.select("event_id", F.array_join(F.array_sort(F.map_keys(C.neutral_keys(m))), ",").alias("keys"))


@query(
    "C22_detours", "line",
    "SELECT stop_id, part_id, CASE WHEN p<0.124 THEN 0.0 ELSE p*2*1.35 END AS estimate, GREATEST(0.0, o-10.0) AS start_mile, LEAST(930.0, o+10.0) AS end_mile, LEAST(930.0, o+10.0)-GREATEST(0.0, o-10.0) AS arc FROM (SELECT stop_id, part_id, qty_c/1000.0::DOUBLE AS p, CAST(stop_id*37 % 931 AS DOUBLE) AS o FROM line)",
)
def detours(line):
    start, end, arc = C.bracket(F.col("o"), F.lit(930.0))
    rows = line.select("stop_id", "part_id", (F.col("qty_c") / 1000.0).alias("p"), (F.col("stop_id") * 37 % 931).cast("double").alias("o"))
    return rows.select("stop_id", "part_id", C.detour_estimate(F.col("p")).alias("estimate"), start.alias("start_mile"), end.alias("end_mile"), arc.alias("arc"))


@query("C27_city_tier", "station", "SELECT station_id, u<5 AND 30-lat*0.5>=u*2 AS eligible, ROUND(SQRT(land/3.141592653589793), 6) AS radius FROM (SELECT station_id, lat, CAST(station_id % 9 AS DOUBLE) AS u, CAST(station_id*3 AS DOUBLE) AS land FROM station)")
def city_tier(station):
    u = (F.col("station_id") % 9).cast("double")
    return station.select("station_id", C.city_tier_eligible(u, 30 - F.col("lat") * 0.5).alias("eligible"), F.round(C.uncertainty_radius((F.col("station_id") * 3).cast("double")), 6).alias("radius"))


@query("C31_disclaimers", "stop", "SELECT stop_id, ARRAY_TO_STRING(LIST_FILTER([CASE WHEN truck_id IS NULL THEN 'no_truck' END, CASE WHEN currency='CAD' THEN 'canadian' END, CASE WHEN total_c>30000000 THEN 'large' END], lambda x: x IS NOT NULL), ',') AS codes, CAST(CEIL(total_c/50.0)*50 AS BIGINT) AS up FROM stop")
def disclaimers(stop):
    codes = C.disclaimers([(F.col("truck_id").isNull(), "no_truck"), (F.col("currency") == "CAD", "canadian"), (F.col("total_c") > 30000000, "large")])
    return stop.select("stop_id", F.array_join(codes, ",").alias("codes"), C.round_up_to(F.col("total_c"), 50).cast("bigint").alias("up"))


@query("C35_nice_step", "line", """SELECT stop_id, part_id, CASE WHEN m<=1 THEN 1.0 WHEN m<=2 THEN 2.0 WHEN m<=2.5 THEN 2.5 WHEN m<=5 THEN 5.0 ELSE 10.0 END*p AS step FROM (SELECT *, x/4/p AS m FROM (SELECT stop_id, part_id, x, POW(10.0::DOUBLE, FLOOR(LOG10(x/4))) AS p FROM (SELECT stop_id, part_id, CAST(amount_c AS DOUBLE) AS x FROM line)))""")
def nice_step(line):
    return line.select("stop_id", "part_id", C.nice_step(F.col("amount_c").cast("double")).alias("step"))


@query("C36_tax_labels", "line", "SELECT stop_id, part_id, CASE WHEN tax_p>0 AND disc_p=0 THEN 'HST' ELSE 'Tax' END AS label FROM line")
def tax_labels(line):
    zero = F.lit(0)
    return line.select("stop_id", "part_id", C.tax_label(F.col("tax_p"), F.col("disc_p"), zero, zero).alias("label"))


@query("C41_printed_parts", "stop", "SELECT stop_id, strftime(occurred_at,'%Y-%m-%d') AS date, strftime(occurred_at,'%H:%M') AS time, strftime(occurred_at,'%Y%m%d') AS day_key, strftime(occurred_at,'%m/%d/%Y') AS slash_date FROM stop")
def printed(stop):
    return stop.select("stop_id", C.printed_parts(F.col("occurred_at")).alias("p")).select("stop_id", "p.*")


@query("C8_addresses", "customer", "SELECT c_custkey, CAST(c_custkey AS VARCHAR)||' n '||LOWER(c_mktsegment)||' ter apt-b ste ste '||CAST(c_custkey % 50 AS VARCHAR)||CASE WHEN c_custkey % 3 = 0 THEN ' springfield wv 90210' WHEN c_custkey % 3 = 1 THEN ' washington st louis' ELSE ' 90210-123' END AS address FROM customer")
def addresses(customer):
    end = F.when(F.col("c_custkey") % 3 == 0, F.lit(", Springfield, West\u00a0Virginia 90210-1234")).when(F.col("c_custkey") % 3 == 1, ", Washington St. Louis").otherwise(" 90210-123")
    raw = F.concat(F.col("c_custkey").cast("string"), F.lit(" \uff2eorth "), "c_mktsegment", F.lit("  Terrace Apt-B, Suite #"), (F.col("c_custkey") % 50).cast("string"), end)
    return customer.select("c_custkey", C.normalize_address(raw).alias("address"))


@query(
    "C33_maps_links", "station",
    """WITH n AS (SELECT lane_id, station_id, CAST(lat AS VARCHAR)||','||CAST(lng AS VARCHAR) AS p, (ROW_NUMBER() OVER (PARTITION BY lane_id ORDER BY station_id)-1)//9 AS part FROM station)
    SELECT lane_id, CAST(part AS INT) AS part, 'https://www.google.com/maps/dir/?api=1&origin=Origin&destination=Destination&waypoints='||REPLACE(STRING_AGG(REPLACE(p, ',', '%2C'), '|' ORDER BY station_id), '|', '%7C')||'&travelmode=driving' AS link FROM n GROUP BY 1,2""",
)
def maps_links(station):
    place = F.row_number().over(Window.partitionBy("lane_id").orderBy("station_id"))
    station = station.withColumn("part", F.floor((place - 1) / 9).cast("int"))
    point = F.concat_ws(",", F.col("lat").cast("string"), F.col("lng").cast("string"))
    stops = F.transform(F.array_sort(F.collect_list(F.struct("station_id", point.alias("p")))), lambda x: x["p"])
    return station.groupBy("lane_id", "part").agg(C.maps_link(F.lit("Origin"), F.lit("Destination"), stops).alias("link"))
