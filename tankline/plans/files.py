"""Registered queries: file scans over sheets and invoices that Spark writes from the given tables as text."""

from __future__ import annotations

import contextlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tankline.plans.registry import query
from tankline.sources import directories, invoices, price_sheets, splits
from tankline.streaming.jobs import shared_folder


#: Cards of an invoice file and stations of a sheet, so that a file's size doesn't grow with the tables.
CARDS, STATIONS = 2000, 1000


def sheet_files(line: DataFrame) -> DataFrame:
    """A price sheet for each ship month and range of stations: a row for each station and product with its lowest price."""
    best = line.groupBy(F.date_trunc("month", "day").cast("date").alias("d"), F.floor(F.col("station_id") / STATIONS).cast("int").alias("part"), "station_id", "product").agg(F.min(F.col("billed_t") % 100000).alias("p"))
    price = (F.col("p").cast("decimal(18,0)") / 10000).cast("decimal(18,4)").cast("string")
    bad = F.when(F.col("p") % 10 == 3, "n/a").otherwise(price)
    state = F.when(F.col("p") % 10 == 4, "XX").otherwise("TX")
    fields = F.concat_ws(",", F.col("station_id").cast("string"), F.lit('"Stop ""A"", East"'), F.lit("AUSTIN"), state, "product", bad, *[F.lit("0")] * 5, price, price, price, F.lit("0"))
    head = F.concat(F.lit('"Company Id: ",7," ",,"Effective Date: ",'), F.date_format("d", "yyyy-MM-dd"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("station_id", "product", fields.alias("f")))), lambda x: x["f"]), "\r\n\r\n")
    return best.groupBy("d", "part").agg(body.alias("body")).select(F.concat(F.lit("sheet-"), F.date_format("d", "yyyyMM"), F.lpad(F.col("part").cast("string"), 6, "0"), F.lit(".csv")).alias("file"), F.concat_ws("\n", head, F.lit(", ".join(price_sheets.HEADER)), "body").alias("content"))


SHEET = "b AS (SELECT CAST(date_trunc('month', day) AS DATE) AS d, LPAD(CAST(station_id//1000 AS VARCHAR), 6, '0') AS part, station_id, product, MIN(billed_t % 100000) AS p FROM line GROUP BY ALL)"


def _products(line: DataFrame) -> DataFrame:
    return line.select(F.col("product").alias("raw_code")).where("raw_code <> 'S'").distinct().withColumn("product_type", F.when(F.col("raw_code") == "TA", "highway_diesel").otherwise("def"))


@query("S1_price_sheet_rows", "line", f"WITH {SHEET} SELECT 'sheet-'||strftime(d,'%Y%m')||part||'.csv' AS file, d AS valid_on, CAST(ROW_NUMBER() OVER (PARTITION BY d, part ORDER BY station_id, product)+2 AS INT) AS line_number, CAST(station_id AS VARCHAR) AS site, 'Stop \"A\", East' AS name, product AS prod FROM b")
def sheet_rows(line):
    return price_sheets.parse(sheet_files(line))[1].select("file", "valid_on", "line_number", "site", "name", "prod")


@query(
    "F10_validated_prices", "line",
    f"""WITH {SHEET} SELECT 'sheet-'||strftime(d,'%Y%m')||part||'.csv' AS file, CASE WHEN p % 10 = 3 THEN 'NUMERIC_PARSE_ERROR' WHEN p % 10 = 4 THEN 'INVALID_STATE' WHEN product='S' THEN 'UNMAPPED_PRODUCT' ELSE 'ok' END AS code, COUNT(*) AS n FROM b GROUP BY 1,2""",
)
def validated(line):
    from tankline.operators.filters import validate_prices

    rows = price_sheets.parse(sheet_files(line))[1]
    return validate_prices(rows, _products(line)).groupBy("file", F.coalesce("rejection.code", F.lit("ok")).alias("code")).agg(F.count("*").alias("n"))


@query(
    "S29_ingest_report", "line",
    f"""WITH {SHEET} SELECT 'sheet-'||strftime(d,'%Y%m')||part||'.csv' AS file, 'OK' AS status, d AS valid_on, COUNT(*) FILTER (p % 10 NOT IN (3,4) AND product<>'S') AS accepted, COUNT(*) FILTER (p % 10 IN (3,4) OR product='S') AS rejected,
    CASE WHEN COUNT(*) FILTER (p % 10 NOT IN (3,4) AND product='S')>0 THEN 'S' ELSE '' END AS unmapped FROM b GROUP BY d, part""",
)
def ingest_report(line):
    files = sheet_files(line)
    ledger = files.select(F.lit("").alias("sha256")).limit(0)
    return price_sheets.report(price_sheets.ingest(files, _products(line), ledger))


@query("S18_first_copies", "line", f"WITH {SHEET} SELECT DISTINCT 'a-sheet-'||strftime(d,'%Y%m')||part||'.csv' AS file FROM b WHERE EXTRACT(YEAR FROM d)<>1997")
def first_copies(line):
    files = sheet_files(line)
    twice = files.select(F.concat(F.lit("a-"), "file").alias("file"), "content").unionByName(files)
    ledger = files.where(F.col("file").like("sheet-1997%")).select(F.sha2("content", 256).alias("sha256"))
    return price_sheets.first_copies(price_sheets.parse(twice)[0], ledger).select("file")


@query(
    "S20_insert_once", "line",
    "SELECT station_id, day, MIN(billed_t) AS billed_t FROM line a WHERE product='TA' AND NOT EXISTS (SELECT 1 FROM line b WHERE b.product='DF' AND a.station_id=b.station_id AND a.day=b.day) GROUP BY 1,2",
)
def insert_once(line):
    new = line.where("product = 'TA'").groupBy("station_id", "day").agg(F.min("billed_t").alias("billed_t"))
    return price_sheets.insert_once(line.where("product = 'DF'"), new, ["station_id", "day"])


@query(
    "S21_station_upsert", "line station",
    """WITH s AS (SELECT CAST(station_id AS VARCHAR) AS site, MAX(day) AS d FROM line WHERE product='TA' GROUP BY 1), k AS (SELECT CAST(station_id AS VARCHAR) AS site, site_name AS name, city, 'TX' AS state, DATE '1996-01-01' AS last_seen FROM station WHERE station_id % 2 = 0)
    SELECT COALESCE(k.site, s.site) AS site, COALESCE(name, 'new') AS name, COALESCE(city, 'New City') AS city, COALESCE(state, 'ON') AS state, GREATEST(last_seen, d) AS last_seen FROM k FULL JOIN s ON k.site=s.site""",
)
def station_upsert(line, station):
    known = station.where("station_id % 2 = 0").select(F.col("station_id").cast("string").alias("site"), F.col("site_name").alias("name"), "city", F.lit("TX").alias("state"), F.lit("1996-01-01").cast("date").alias("last_seen"))
    seen = line.where("product = 'TA'").select(F.col("station_id").cast("string").alias("site"), F.lit("new").alias("name"), F.lit("New City").alias("city"), F.lit("ON").alias("state"), F.col("day").alias("valid_on"))
    return price_sheets.upsert_stations(known, seen)


def invoice_files(stop: DataFrame, line: DataFrame) -> DataFrame:
    """A sectioned invoice for each week, currency and range of cards.  Lines of a stop name one site in weeks of kind 0 and 1.  Some weeks have something wrong: a cent in a printed total (kind 2),
    discount rates of single lines (3), a tax in a printed total (4); every week has an express row, and a manual credit nets with it."""
    own = line.join(stop.select("stop_id", "card_id", "driver_raw", "occurred_at", "week_end", "currency"), "stop_id")
    own = own.withColumns({"part": F.floor(F.col("card_id") / CARDS).cast("int"), "wrong": F.weekofyear("week_end") % 5})
    keys = ["week_end", "currency", "part", "wrong"]
    money = lambda c: (c.cast("decimal(18,0)") / 100).cast("decimal(18,2)").cast("string")
    cur = F.when(F.col("currency") == "USD", "US").otherwise("CN")
    price = (F.col("billed_t").cast("decimal(18,0)") / 10000).cast("decimal(18,4)").cast("string")
    site = F.when(F.col("wrong") < 2, F.col("stop_id") % 100).otherwise(F.col("station_id")).cast("string")
    rate = F.when((F.col("wrong") == 3) & (F.col("stop_id") % 4 == 1), "0.0001").otherwise("0.0000")
    row = F.concat_ws(
        ",", F.concat(F.col("stop_id").cast("string"), F.lit("-1")), "driver_raw", F.lit("12"), F.date_format("occurred_at", "yyyy-MM-dd HH:mm:ss"), site, F.lit("Stop"), F.lit("Austin"), F.lit("TX"), "product",
        money(F.col("qty_c")), price, price, money(F.col("amount_c")), *[F.lit("0.00")] * 4, rate, F.lit("0.00"), money(F.col("amount_c")), cur,
    )
    rows = F.array_sort(F.collect_list(F.struct("card_id", "stop_id", "row")))
    sums = {f"{p}_{c}": F.sum(F.when(F.col("product") == p, F.col(c))) for p in ("DF", "S", "TA") for c in ("qty_c", "amount_c")}
    both = own.select(*keys, "card_id", "stop_id", "product", "qty_c", "amount_c", row.alias("row")).groupBy(*keys).agg(rows.alias("rows"), F.sum("amount_c").alias("g"), *[v.alias(k) for k, v in sums.items()])
    card = lambda k: F.get("rows", k)["card_id"]
    head = lambda x: F.concat(F.lit("Transactions for Card # "), x["card_id"].cast("string"), F.lit("\n" + ", ".join(invoices.FUEL_HEADER) + "\n"))
    block = lambda x, k: F.concat(F.when((k == 0) | (card(k - 1) != x["card_id"]), head(x)).otherwise(""), x["row"], F.when((k == F.size("rows") - 1) | (card(k + 1) != x["card_id"]), "\n,,subtotal").otherwise(""))
    body = F.array_join(F.transform("rows", block), "\n")
    totals = []
    for p in ("DF", "S", "TA"):
        qty, amount = F.col(f"{p}_qty_c"), F.col(f"{p}_amount_c")
        printed = amount + (F.when(F.col("wrong") == 2, 1).otherwise(0) if p == "DF" else F.lit(0))
        hst = F.when(F.col("wrong") == 4, "0.01").otherwise("0.00") if p == "TA" else F.lit("0.00")
        totals.append(F.when(amount.isNotNull(), F.concat_ws(",", F.lit(p), money(qty), money(amount), hst, *[F.lit("0.00")] * 4, F.lit("0.00"), money(printed), cur)))
    both = both.withColumns({"body": body, "t": F.array_join(F.array_sort(F.array_compact(F.array(*totals))), "\n")})
    grand = F.concat_ws(",", F.lit("Grand Total"), F.lit(""), money(F.col("g")), *[F.lit("0.00")] * 5, F.lit("0.00"), money(F.col("g") + 13100 - 5000), cur)
    both = both.withColumn("g_row", grand)
    day = F.date_format("week_end", "yyyy-MM-dd")
    manual = F.concat_ws(",", day, F.lit("-51.00"), F.lit("1.00"), F.lit("-50.00"), cur, F.lit("credit"))
    express = F.concat_ws(",", day, F.lit("9"), F.lit("77"), F.lit("130.00"), F.lit("1.00"), F.lit("131.00"), cur, F.lit(" "), F.lit("note"))
    text = F.concat_ws(
        "\n", F.lit("Fuel Card Transactions"), "body", F.lit("Manual Transactions"), F.lit(", ".join(invoices.MANUAL_HEADER)), manual, F.lit("Express Codes"), F.lit(", ".join(invoices.EXPRESS_HEADER)), express,
        F.lit("Grand Totals"), F.lit(", ".join(invoices.TOTALS_HEADER)), "t", F.concat_ws(",", F.lit("EXPRESS"), *[F.lit("")] * 8, F.lit("81.00"), cur), "g_row",
    )
    number = F.concat(F.date_format("week_end", "yyyyMMdd"), F.when(F.col("currency") == "USD", "1").otherwise("2"), F.lpad(F.col("part").cast("string"), 6, "0"))
    return both.select(F.concat(F.lit("invoice-"), number, F.lit(".csv")).alias("file"), text.alias("content"))


def kept(rows: DataFrame) -> DataFrame:
    """The rows as written once to a shared folder: what reads them again doesn't make them again."""
    spark, folder = rows.sparkSession, shared_folder(rows.sparkSession)
    rows.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(rows.schema).parquet(folder)


def parsed(files: DataFrame, line: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """(files, parts, fuel, cash, totals) for what needs the fuel rows several times: files and typed fuel rows are written once."""
    sheets = kept(files)
    parts = invoices.sections(sheets)
    return sheets, parts, kept(invoices.fuel_lines(parts, _codes(line))), invoices.cash_rows(parts), invoices.printed_totals(parts)


INVOICE = """o AS (SELECT 'invoice-'||strftime(week_end,'%Y%m%d')||CASE WHEN currency='USD' THEN '1' ELSE '2' END||LPAD(CAST(card_id//2000 AS VARCHAR), 6, '0')||'.csv' AS file, l.stop_id, l.product, qty_c, amount_c, currency, card_id, occurred_at, week_end, CASE WHEN EXTRACT(WEEK FROM week_end) % 5 < 2 THEN l.stop_id % 100 ELSE station_id END AS station_id, EXTRACT(WEEK FROM week_end) % 5 AS wrong
  FROM (SELECT stop_id, product, qty_c, amount_c, station_id FROM line) l JOIN (SELECT stop_id, card_id, occurred_at, week_end, currency FROM stop) s ON l.stop_id=s.stop_id)"""


def _codes(line: DataFrame) -> DataFrame:
    return line.select(F.col("product").alias("raw_code")).distinct().withColumn("product_type", F.lower("raw_code"))


@query("S7_invoice_lines", "stop line", f"WITH {INVOICE} SELECT file, CAST(card_id AS VARCHAR) AS card, CAST(stop_id AS VARCHAR) AS base_auth, product AS raw_code, occurred_at, currency, COUNT(*) AS n, CAST(SUM(qty_c) AS BIGINT) AS qty_c, CAST(SUM(amount_c) AS BIGINT) AS final_c FROM o GROUP BY ALL")
def invoice_lines(stop, line):
    fuel = invoices.fuel_lines(invoices.sections(invoice_files(stop, line)), _codes(line)).where("rejection is null")
    cents = lambda c: F.sum((F.col(c) * 100).cast("bigint"))
    return fuel.groupBy("file", "card", "base_auth", "raw_code", "occurred_at", "currency").agg(F.count("*").alias("n"), cents("qty").alias("qty_c"), cents("final").alias("final_c"))


@query("A21_grouped_stops", "stop line", f"WITH {INVOICE} SELECT file, CAST(stop_id AS VARCHAR) AS base_auth, COUNT(DISTINCT station_id)=1 AS consistent, CAST(SUM(amount_c) AS BIGINT) AS final_c, COUNT(*) AS lines FROM o GROUP BY 1,2")
def grouped(stop, line):
    fuel = invoices.fuel_lines(invoices.sections(invoice_files(stop, line)), _codes(line))
    return invoices.group_stops(fuel).select("file", "base_auth", "consistent", (F.col("final") * 100).cast("bigint").alias("final_c"), "lines")


@query(
    "A22_reconciliation", "stop line",
    f"""WITH {INVOICE} SELECT file, product, CAST(SUM(amount_c) AS BIGINT) AS parsed_c, CAST(SUM(amount_c)+MAX(CASE WHEN wrong=2 AND product='DF' THEN 1 ELSE 0 END) AS BIGINT) AS printed_c, CAST(-MAX(CASE WHEN wrong=2 AND product='DF' THEN 1 ELSE 0 END) AS BIGINT) AS delta_c, CAST(0 AS BIGINT) AS delta_qty_c FROM o GROUP BY 1,2
    UNION ALL SELECT DISTINCT file, 'EXPRESS', 8100, 8100, 0, NULL FROM o
    UNION ALL SELECT file, 'GRAND TOTAL', CAST(SUM(amount_c)+8100 AS BIGINT), CAST(SUM(amount_c)+8100 AS BIGINT), 0, NULL FROM o GROUP BY 1""",
)
def reconciliation(stop, line):
    parts = invoices.sections(kept(invoice_files(stop, line)))
    return invoices.reconcile(invoices.fuel_lines(parts, _codes(line)), invoices.cash_rows(parts), invoices.printed_totals(parts)).select("file", "product", "parsed_c", "printed_c", "delta_c", "delta_qty_c")


@query("S6_invoice_headers", "stop line", f"WITH {INVOICE} SELECT file, regexp_extract(file, '(\\d+)', 1) AS invoice_number, CAST(MIN(occurred_at) AS DATE) AS period_start, MAX(week_end) AS period_end, CAST(MAX(week_end)+1 AS DATE) AS invoice_day, MAX(currency) AS currency FROM o GROUP BY 1")
def headers(stop, line):
    return invoices.header_facts(invoices.sections(invoice_files(stop, line))).select("file", "invoice_number", "period_start", "period_end", "invoice_day", "currency")


@query(
    "S23_invoice_outcomes", "stop line",
    f"""WITH {INVOICE}, g AS (SELECT file, stop_id, COUNT(DISTINCT station_id) AS d FROM o GROUP BY 1,2), w AS (SELECT file, MAX(wrong) AS wrong, BOOL_OR(product='DF') AS df, BOOL_OR(product='TA') AS ta, BOOL_OR(stop_id % 4 = 1) AS odd FROM o GROUP BY 1)
    SELECT file, CASE WHEN MAX(d)>1 OR MAX(CASE WHEN wrong=2 AND df OR wrong=3 AND odd OR wrong=4 AND ta THEN 1 ELSE 0 END)=1 THEN 'quarantined' ELSE 'imported' END AS status FROM g JOIN w USING (file) GROUP BY 1""",
)
def outcomes(stop, line):
    files, parts, fuel, cash, totals = parsed(invoice_files(stop, line), line)
    ledger = files.select(F.lit("").alias("sha256"), F.lit("").alias("invoice_number"), F.lit("1900-01-01").cast("date").alias("week_end"), F.lit("USD").alias("currency")).limit(0)
    return invoices.decide(files, parts, fuel, cash, totals, ledger).select("file", "status")


@query(
    "S19_conflicts", "stop line",
    f"""WITH {INVOICE}, g AS (SELECT file, stop_id, COUNT(DISTINCT station_id) AS d FROM o GROUP BY 1,2), w AS (SELECT file, MAX(week_end) AS week_end, MAX(currency) AS currency, MAX(wrong) AS wrong, BOOL_OR(product='DF') AS df, BOOL_OR(product='TA') AS ta, BOOL_OR(stop_id % 4 = 1) AS odd FROM o GROUP BY 1),
    j AS (SELECT file, week_end, currency, MAX(d)>1 OR MAX(CASE WHEN wrong=2 AND df OR wrong=3 AND odd OR wrong=4 AND ta THEN 1 ELSE 0 END)=1 AS bad FROM g JOIN w USING (file) GROUP BY 1,2,3),
    a AS (SELECT *, FALSE AS again FROM j UNION ALL SELECT 'z-'||file, week_end, currency, bad, TRUE FROM j WHERE EXTRACT(DAY FROM week_end) % 4 = 0),
    r AS (SELECT *, CASE WHEN EXTRACT(YEAR FROM week_end)=1997 THEN 'invoice_number' WHEN EXTRACT(YEAR FROM week_end)=1996 AND NOT bad THEN 'billing_week' WHEN again THEN 'invoice_number' END AS held FROM a),
    k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY week_end, currency, held IS NULL AND NOT bad ORDER BY file) AS place FROM r)
    SELECT file, CASE WHEN held IS NOT NULL OR (NOT bad AND place>1) THEN 'conflict' WHEN bad THEN 'quarantined' ELSE 'imported' END AS status, CASE WHEN held IS NOT NULL THEN held WHEN NOT bad AND place>1 THEN 'billing_week' END AS reason FROM k""",
)
def conflicts(stop, line):
    """Files of every fourth day come twice with other bytes, numbers of 1997 and weeks of 1996 are held by older invoices."""
    files = kept(invoice_files(stop, line))
    week = F.to_date(F.regexp_extract("file", r"invoice-(\d{8})", 1), "yyyyMMdd")
    again = files.where(F.dayofmonth(week) % 4 == 0).select(F.concat(F.lit("z-"), "file").alias("file"), F.concat("content", F.lit("\n")).alias("content"))
    number, cur = F.regexp_extract("file", r"(\d+)[^/\d]*$", 1), F.when(F.substring(F.regexp_extract("file", r"(\d+)", 1), 9, 1) == "1", "USD").otherwise("CAD")
    held = files.select("file", week.alias("week_end")).where("year(week_end) in (1996, 1997)")
    late = F.year("week_end") == 1997
    ledger = held.select(F.lit("older").alias("sha256"), F.when(late, number).otherwise("none").alias("invoice_number"), F.when(late, F.lit("1900-01-01").cast("date")).otherwise(F.col("week_end")).alias("week_end"), cur.alias("currency"))
    both = files.unionByName(again)
    parts = invoices.sections(both)
    fuel = kept(invoices.fuel_lines(parts, _codes(line)))
    return invoices.decide(both, parts, fuel, invoices.cash_rows(parts), invoices.printed_totals(parts), ledger, in_batch=True).select("file", "status", "reason")


@query(
    "S10_S11_file_facts", "stop line",
    f"""WITH {INVOICE}, f AS (SELECT file, MAX(week_end) AS week_end, MAX(currency) AS currency, MAX(wrong) AS wrong FROM o GROUP BY 1), m AS (SELECT *, currency='USD' AND EXTRACT(DAY FROM week_end) % 3 = 0 AS mixed FROM f)
    SELECT file, EXTRACT(DAY FROM week_end) % 5 <> 0 AS has_grand, mixed AS mixed_currency, CASE WHEN NOT mixed THEN currency END AS currency, CASE WHEN EXTRACT(DAY FROM week_end) % 5 = 0 OR mixed THEN FALSE END AS good FROM m""",
)
def file_facts(stop, line):
    """Some files with an express row in the other currency, some without their last row."""
    files = invoice_files(stop, line)
    day = F.dayofmonth(F.to_date(F.regexp_extract("file", r"invoice-(\d{8})", 1), "yyyyMMdd"))
    text = F.when(day % 3 == 0, F.replace("content", F.lit("131.00,US"), F.lit("131.00,CN"))).otherwise(F.col("content"))
    text = F.when(day % 5 == 0, F.regexp_replace(text, "\nGrand Total,[^\n]*$", "")).otherwise(text)
    both, parts, fuel, cash, totals = parsed(files.select("file", text.alias("content")), line)
    ledger = both.select("file").limit(0).select(F.col("file").alias("sha256"), F.col("file").alias("invoice_number"), F.current_date().alias("week_end"), F.col("file").alias("currency"))
    status = invoices.decide(both, parts, fuel, cash, totals, ledger).select("file", F.when(F.col("status").isin("failed", "quarantined"), False).alias("good"))
    ends = totals.groupBy("file").agg(F.max("is_grand").alias("has_grand"))
    facts = invoices.header_facts(parts).join(ends, "file", "left").join(status, "file")
    return facts.select("file", "has_grand", "mixed_currency", "currency", F.when(~F.col("has_grand") | F.col("mixed_currency"), F.col("good")).alias("good"))


@query("A25_actual_range", "stop line", f"WITH {INVOICE} SELECT file, CAST(MIN(occurred_at) AS DATE) AS actual_start, MAX(week_end) AS actual_end FROM o GROUP BY 1")
def actual_range(stop, line):
    parts = invoices.sections(kept(invoice_files(stop, line)))
    return invoices.actual_range(invoices.fuel_lines(parts, _codes(line)), invoices.cash_rows(parts))


@query("S16_preferred_files", "stop", "SELECT CAST(card_id AS VARCHAR)||CASE WHEN stop_id % 2 = 0 THEN '.csv' ELSE '.txt' END AS file, COUNT(*) AS n FROM stop GROUP BY 1")
def preferred(stop):
    names = stop.select(F.concat(F.col("card_id").cast("string"), F.when(F.col("stop_id") % 2 == 0, ".csv").otherwise(".txt")).alias("file"))
    counts = names.groupBy("file").agg(F.count("*").alias("n"))
    return invoices.preferred(counts).select("file", "n")


@query(
    "Q5_picked_geocodes", "event",
    """WITH c AS (SELECT user_id AS request_id, event_id, CAST(value_c % 100 AS DOUBLE)/100 AS conf, event_type AS region FROM event), t AS (SELECT *, MAX(conf) OVER (PARTITION BY request_id) AS m FROM c)
    SELECT request_id, m AS confidence, ARG_MAX(event_id, (conf, -event_id)) AS candidate_id, CASE WHEN COUNT(DISTINCT region) FILTER (conf=m)>1 THEN 'ambiguous' WHEN m<0.9 THEN 'low_confidence' ELSE 'matched' END AS status FROM t GROUP BY 1,2""",
)
def picked(event):
    c = event.select(F.col("user_id").alias("request_id"), F.col("event_id").alias("candidate_id"), ((F.col("value_c") % 100).cast("double") / 100).alias("confidence"), F.col("event_type").alias("region"))
    return directories.pick_geocode(c)


#: Bytes of a range in the query below, so that the files of the given tables are cut too; a session's own setting holds elsewhere.
RANGE = 1 << 18


@contextlib.contextmanager
def range_size(spark: SparkSession, size: int):
    """Byte ranges of this size while files are read."""
    wanted = {"spark.sql.files.maxPartitionBytes": size, "spark.sql.files.openCostInBytes": 1}
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def year_lines(stop: DataFrame, line: DataFrame) -> DataFrame:
    """An invoice of a whole year and currency as its lines in order (file, at, value); the notes of every fifth stop hold quotes, a comma and a line break."""
    own = line.join(stop.select("stop_id", "card_id", "occurred_at", "week_end", "currency"), "stop_id")
    file = F.concat(F.lit("year-"), F.year("week_end").cast("string"), F.lit("-"), F.col("currency"))
    cur = F.when(F.col("currency") == "USD", "US").otherwise("CN")
    name = F.when(F.col("stop_id") % 5 == 0, F.concat(F.lit('"Stop ""A"",\nFuel Card Transactions '), F.col("stop_id").cast("string"), F.lit('"'))).otherwise("Stop")
    money = (F.col("amount_c").cast("decimal(18,0)") / 100).cast("decimal(18,2)").cast("string")
    none = F.lit(0).cast("bigint")
    at = lambda part, card, step, stop_id, text, amount=none: F.struct(F.lit(part).alias("part"), card.alias("card"), F.lit(step).alias("step"), stop_id.alias("stop_id"), amount.alias("amount_c"), text.alias("text"))
    fuel = F.concat_ws(",", F.concat(F.col("stop_id").cast("string"), F.lit("-1")), F.lit(""), F.lit("12"), F.date_format("occurred_at", "yyyy-MM-dd HH:mm:ss"), F.lit("1"), name, F.lit("Austin"), F.lit("TX"), "product", *[F.lit("1.00")] * 10, money, cur)
    cash = F.concat_ws(",", F.date_format("week_end", "yyyy-MM-dd"), F.lit("9"), F.lit("77"), money, F.lit("0.00"), money, cur, F.lit(" "), F.lit("note"))
    keyed = own.select(file.alias("file"), "card_id", "stop_id", "amount_c", fuel.alias("fuel"), F.when(F.col("stop_id") % 10 == 0, cash).alias("cash"))
    cards, files = keyed.select("file", "card_id").distinct(), keyed.select("file").distinct()
    card = F.concat(F.lit("Transactions for Card # "), F.col("card_id").cast("string"))
    text = lambda values: F.lit(", ".join(values))
    out = [
        files.select("file", F.explode(F.array(*[at(p, none, s, none, t) for p, s, t in ((0, 0, F.lit("Fuel Card Transactions")), (2, 0, F.lit("Express Codes")), (2, 1, text(invoices.EXPRESS_HEADER)))])).alias("at")),
        cards.select("file", F.explode(F.array(at(1, F.col("card_id"), 0, none, card), at(1, F.col("card_id"), 1, none, text(invoices.FUEL_HEADER)))).alias("at")),
        keyed.select("file", at(1, F.col("card_id"), 2, F.col("stop_id"), F.col("fuel"), F.col("amount_c")).alias("at")), keyed.where("cash is not null").select("file", at(3, none, 0, F.col("stop_id"), F.col("cash"), F.col("amount_c")).alias("at")),
    ]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3]).select("file", "at", F.col("at.text").alias("value"))


@query(
    "W16_split_sections", "stop line",
    """WITH o AS (SELECT 'year-'||EXTRACT(YEAR FROM week_end)||'-'||currency AS file, card_id, l.stop_id, amount_c FROM (SELECT stop_id, amount_c FROM line) l JOIN (SELECT stop_id, card_id, week_end, currency FROM stop) s ON l.stop_id=s.stop_id),
    r AS (SELECT DISTINCT file, 0 AS part, 0 AS card_id, 0 AS step, 0 AS stop_id, NULL::BIGINT AS amount_c FROM o UNION ALL SELECT DISTINCT file, 1, card_id, step, 0, NULL FROM o, (VALUES (0), (1)) t(step) UNION ALL SELECT file, 1, card_id, 2, stop_id, amount_c FROM o
      UNION ALL SELECT DISTINCT file, 2, 0, step, 0, NULL FROM o, (VALUES (0), (1)) t(step) UNION ALL SELECT file, 3, 0, 0, stop_id, amount_c FROM o WHERE stop_id % 10 = 0),
    n AS (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY file ORDER BY part, card_id, step, stop_id, amount_c)+1 AS INT) AS line_number, MAX(card_id) OVER (PARTITION BY file) AS last_card FROM r)
    SELECT file, line_number, CASE WHEN part=1 THEN 'fuel' ELSE 'express' END AS section, CAST(CASE WHEN part=1 THEN card_id ELSE last_card END AS VARCHAR) AS card,
      CASE WHEN part=1 AND stop_id % 5 = 0 THEN 'Stop "A",|Fuel Card Transactions '||stop_id WHEN part=1 THEN 'Stop' END AS name, amount_c FROM n WHERE amount_c IS NOT NULL""",
)
def split_sections(stop, line):
    spark, folder = stop.sparkSession, shared_folder(stop.sparkSession)
    year_lines(stop, line).repartition("file").sortWithinPartitions("file", "at").select("file", "value").write.partitionBy("file").text(f"{folder}/in")
    with range_size(spark, RANGE):
        parts = splits.sections(spark, f"{folder}/in/file=*", f"{folder}/records", "*.txt").where("kind = 'row'")
    number = F.when(F.col("section") == "fuel", F.get("fields", F.lit(19))).otherwise(F.get("fields", F.lit(3)))
    name = F.when(F.col("section") == "fuel", F.get("fields", F.lit(5)))
    return parts.select(F.regexp_extract("file", "file=([^/]+)/", 1).alias("file"), "line_number", "section", "card", F.regexp_replace(name, "\n", "|").alias("name"), (number.cast("decimal(18,2)") * 100).cast("bigint").alias("amount_c"))
