"""Price sheets and invoices from small literal files."""

from datetime import date

from pyspark.sql import functions as F

from tankline.sources import directories, invoices, price_sheets

HEAD = '"Company Id: ",7," ",,"Effective Date: ",2025-08-01\n'
NAMES = ",".join(price_sheets.HEADER) + "\n"
ROW = "101,STOP A,AUSTIN,TX,ULSD,3.1000,0.24,0.2,0,0,0,3.5000,3.9000,3.5000,0.4\n"


def files(spark, **named):
    return spark.createDataFrame([(k, v) for k, v in named.items()], "file string, content string")


def products(spark):
    return spark.createDataFrame([("ULSD", "highway_diesel")], "raw_code string, product_type string")


def test_file_statuses(spark):
    f = files(
        spark, good=HEAD + "\n" + NAMES.replace("SITE", " Site ").replace("FEDERAL TAX", "FEDERAL   TAX") + "\n" + ROW, empty="\n \n", header=HEAD + NAMES.replace("PROD", "PRODUCT") + ROW,
        undated=HEAD.replace("Effective", "Other") + NAMES + ROW, ragged=HEAD + NAMES + ROW.replace("101,", ""), copy=HEAD + "\n" + NAMES.replace("SITE", " Site ").replace("FEDERAL TAX", "FEDERAL   TAX") + "\n" + ROW,
    )
    state, rows = price_sheets.parse(f)
    got = {r.file: r.status for r in state.collect()}
    assert got == {"good": "OK", "copy": "OK", "empty": "EMPTY_FILE", "header": "BAD_HEADER", "undated": "NO_EFFECTIVE_DATE", "ragged": "RAGGED_ROW"}
    first = rows.where("file = 'good'").first()
    assert (first.valid_on, first.line_number, first.site, first.savings) == (date(2025, 8, 1), 3, "101", "0.4")
    new = price_sheets.first_copies(state.where("status = 'OK'"), state.limit(0)).collect()
    assert [r.file for r in new] == ["copy"]


def test_first_rejection_only(spark):
    bad = [
        ROW.replace("ULSD", "DYED"), ROW.replace("TX", "XX"), ROW.replace("3.5000,3.9000", "n/a,3.9000"), ROW.replace("3.5000,0.4", "5.3000,0.4"), ROW.replace("STOP A", " "), ROW.replace("TX,ULSD", "XX,DYED"),
        ROW.replace("3.5000,0.4", "3.5005,0.4"), ROW.replace("3.5000,0.4", "3.5006,0.4"), ROW.replace("0.24", "1e-1"),
    ]
    result = price_sheets.ingest(files(spark, a=HEAD + NAMES + "".join(bad) + ROW), products(spark), spark.createDataFrame([], "sha256 string"))
    codes = {r.line_number: r.code for r in result["rejections"].collect()}
    assert codes == {3: "UNMAPPED_PRODUCT", 4: "INVALID_STATE", 5: "NUMERIC_PARSE_ERROR", 6: "PRICE_INVARIANT_VIOLATION", 7: "SCHEMA_ERROR", 8: "INVALID_STATE", 10: "PRICE_INVARIANT_VIOLATION"}
    assert result["prices"].count() == 1  # one row for a site, product and day
    line = price_sheets.report(result).first()
    assert (line.accepted, line.rejected, line.unmapped) == (1, 7, "DYED")


FUEL = ",".join(invoices.FUEL_HEADER)


def fuel(auth, product, qty, price, amount, unit="12"):
    return f"{auth},ANN LEE,{unit},2025-08-01 10:00:00,101,Stop,Austin,TX,{product},{qty},{price},{price},{amount},0.00,0.00,0.00,0.00,0.0000,0.00,{amount},US,\n"


def invoice(printed="672.10", grand="803.10"):
    return (
        "Fuel Card Transactions\nTransactions for Card # 555\n" + FUEL + "\n" + fuel("77-1", "TA", "130.00", "5.1700", "672.10") + ",,,subtotal\n"
        + "Express Codes\n" + ",".join(invoices.EXPRESS_HEADER) + "\n2025-08-02,9,77,130.00,1.00,131.00,US,,note\n"
        + "Grand Totals\n" + ",".join(invoices.TOTALS_HEADER) + f"\nTA,130.00,672.10,,,,,,0.00,{printed},US\nEXPRESS,,,,,,,,,131.00,US\nGrand Total,,672.10,,,,,,0.00,{grand},US\n"
    )


def decide(spark, f, ledger=None):
    codes = spark.createDataFrame([("TA", "diesel"), ("DF", "def")], "raw_code string, product_type string")
    parts = invoices.sections(f)
    lines = invoices.fuel_lines(parts, codes)
    empty = spark.createDataFrame([], "sha256 string, invoice_number string, week_end date, currency string")
    out = invoices.decide(f, parts, lines, invoices.cash_rows(parts), invoices.printed_totals(parts), ledger or empty)
    return {r.file: r.status for r in out.collect()}, parts, lines


def test_invoice_outcomes(spark):
    f = files(
        spark, a1=invoice(), a2=invoice(), b3=invoice("672.11"), c4=invoice().replace("Grand Total,", "Total,"), d5=invoice().replace("130.00,1.00,131.00", "130.00,1.00,132.00"),
        e6="stray\n" + invoice(), f7=invoice().replace(",TA,130.00", ",ZZ,130.00"), g8=invoice().replace("672.10,US,", "672.10,CN,"),
    )
    status, parts, lines = decide(spark, f)
    assert status == {"a1": "imported", "a2": "duplicate", "b3": "quarantined", "c4": "failed", "d5": "failed", "e6": "failed", "f7": "quarantined", "g8": "quarantined"}
    wrong_line = invoice().replace("672.10,0.00,0.00,0.00,0.00,0.0000", "672.00,0.00,0.00,0.00,0.00,0.0000")
    wrong_total = invoice().replace("TA,130.00,672.10,,,,,,0.00", "TA,130.00,672.10,0.10,,,,,0.00")
    assert wrong_line != invoice() != wrong_total
    assert decide(spark, files(spark, h9=wrong_line, i10=wrong_total))[0] == {"h9": "quarantined", "i10": "quarantined"}
    head = invoices.header_facts(parts).where("file = 'a1'").first()
    assert (head.invoice_number, head.period_start, head.period_end, head.currency) == ("1", date(2025, 8, 1), date(2025, 8, 2), "USD")
    first = lines.where("file = 'a1'").first()
    assert (first.line_number, first.card, first.base_auth, str(first.qty)) == (5, "555", "77", "130.00")
    ledger = spark.createDataFrame([("x", "1", date(2020, 1, 1), "USD")], "sha256 string, invoice_number string, week_end date, currency string")
    assert decide(spark, files(spark, a1=invoice()), ledger)[0] == {"a1": "conflict"}


def test_conflicts_within_a_batch_and_with_the_ledger(spark):
    """Numbers are held by whatever was kept, weeks only against files that would be imported; names give the order."""

    def found(f, *ledger):
        codes = spark.createDataFrame([("TA", "diesel"), ("DF", "def")], "raw_code string, product_type string")
        parts, old = invoices.sections(f), spark.createDataFrame(list(ledger), "sha256 string, invoice_number string, week_end date, currency string")
        out = invoices.decide(f, parts, invoices.fuel_lines(parts, codes), invoices.cash_rows(parts), invoices.printed_totals(parts), old, in_batch=True)
        return {r.file: (r.status, r.reason) for r in out.collect()}

    week, wrong = date(2025, 8, 2), invoice("672.11")
    batch = files(spark, a1=invoice(), b1=invoice() + "\n", c2=invoice() + "\n\n", d3=wrong, e3=wrong + "\n", f4=invoice(), g5="stray\n" + invoice())
    want = {"a1": ("imported", None), "b1": ("conflict", "invoice_number"), "c2": ("conflict", "billing_week"), "d3": ("quarantined", None), "e3": ("conflict", "invoice_number"), "f4": ("duplicate", None), "g5": ("failed", None)}
    assert found(batch) == want
    week_held = {"a1": ("conflict", "billing_week"), "b1": ("conflict", "billing_week")}
    assert found(batch, ("x", "9", week, "USD"), ("y", "9", week, "USD")) == want | week_held
    assert found(batch, ("x", "1", date(2020, 1, 1), "USD")) == want | {"a1": ("conflict", "invoice_number"), "c2": ("imported", None)}


def test_line_checks(spark):
    f = files(spark, a1=invoice().replace("5.1700,5.1700,672.10", "5.1700,5.1700,672.00"))
    lines = decide(spark, f)[2]
    assert [r.check for r in invoices.line_checks(lines).collect()] == ["tax_sum"]


def test_gazetteer_precedence(spark):
    kind = "USPS string, GEOID string, NAME string, ALAND_SQMI double, INTPTLAT double, INTPTLONG double"
    places = spark.createDataFrame([("TX", "1", "Austin city", 10.0, 30.0, -97.0), ("PR", "2", "Ponce city", 1.0, 18.0, -66.0)], kind)
    subs = spark.createDataFrame([("TX", "3", "Austin township", 99.0, 31.0, -98.0), ("TX", "4", "Waco town", 0.0, 31.0, -97.0)], kind)
    got = directories.gazetteer(places, subs).collect()
    assert [(r.state, r.name_normalized, r.geoid, r.collisions) for r in got] == [("TX", "Austin", "1", 1)]


def test_location_problems(spark):
    rows = [("a st", None, None), (None, 1.0, 2.0), ("a st", 1.0, 2.0), (None, None, None), (None, 1.0, None), (" ", 91.0, 0.0)]
    d = spark.createDataFrame(rows, "address string, lat double, lng double").select(directories.location_problem().alias("p"))
    assert [r.p for r in d.collect()] == [None, None, "both", "neither", "half", "range"]


def test_directory_gates(spark):
    names = ["Site #", "Site Name", "City", "Province", "Country", "Latitude", "Longitude", "DEF at Pump", "Truck Parking"]
    rows = [("1", "A", "X", "Ontario", "CA", "44", "-80", "Yes", "12"), ("", "B", "X", "Ontario", "CA", "44", "-80", "", ""), ("3", "C", "X", "Ontario", "CA", "x", "-80", "No", "Yes"), ("4", "D", "X", "Quebec", "CA", "44", "-80", "", ""), ("4", "E", "X", "Quebec", "CA", "44", "-80", "", "")]
    good, bad = directories.directory_stations(spark.createDataFrame(rows, names))
    assert [(r.site_ref, r.state, r.def_at_pump, r.parking_spaces, r.has_parking) for r in good.collect()] == [("1", "ON", True, 12, True)]
    assert sorted(r.excluded for r in bad.collect()) == ["bad_coordinates", "blank_site", "site_twice", "site_twice"]
    assert good.select(F.count("*")).first()[0] == 1
