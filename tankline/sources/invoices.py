"""Sectioned fuel invoices from many files in one plan.

A file is a row, cut before the lines that begin something; what holds for the lines of such a block is found among the
blocks' first lines, within the row, so no line is shuffled or sorted.  Files are small; :mod:`tankline.sources.splits` reads files of any size by byte ranges.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tankline.functions import exprs
from tankline.sources.price_sheets import cells, header_matches, plain_text

# Section titles and headers of an invoice, and the decimals that each number may have.
SECTIONS = {"FUEL CARD TRANSACTIONS": "fuel", "MANUAL TRANSACTIONS": "manual", "EXPRESS CODES": "express", "GRAND TOTALS": "totals"}
CARD = r"^Transactions for Card #\s*(\S+)"
FUEL_HEADER = [
    "AUTH CODE", "DRIVER NAME", "UNIT #", "DATE", "SITE #", "SITE NAME", "SITE CITY", "PROV/ST", "PROD", "QTY", "RETAIL", "BILLED", "PRE TAX AMT", "HST", "GST", "PST", "QST", "DISC RATE", "DISC AMT",
    "FINAL AMT", "CUR",
]
MANUAL_HEADER = ["DATE", "AMOUNT", "FEE", "TOTAL AMOUNT", "CUR", "DESCRIPTION"]
EXPRESS_HEADER = ["DATE", "EXPRESS CODE NUMBER", "AUTH CODES", "AMOUNT CASHED", "FEE", "TOTAL", "CUR", "PAYEE", "NOTES"]
EXPRESS_WIDE = ["DATE", "EXPRESS CODE NUMBER", "AUTH CODES", "AMOUNT CASHED", "FEE", "TOTAL", "CUR", "TRACTOR", "TRAILER", "DRIVER NAME/ID", "CDL", "TRIP #", "PAYEE", "NOTES"]
TOTALS_HEADER = ["PRODUCT", "QTY", "PRE TAX AMT", "HST", "GST", "PST", "QST", "DISC RATE", "DISC AMT", "FINAL AMOUNT", "CUR"]
FUEL_NUMBERS = {
    "qty": (9, 2), "retail": (10, 4), "billed": (11, 4), "pre_tax": (12, 2), "hst": (13, 2), "gst": (14, 2), "pst": (15, 2), "qst": (16, 2), "disc_rate": (17, 4), "disc_amt": (18, 2), "final": (19, 2),
}


def _cell(i: int) -> Column:
    return F.trim(F.get("fields", F.lit(i)))


def sections(files: DataFrame) -> DataFrame:
    """File, line_number (the header that a file is given counts as line one), section, card, kind and fields.

    kind: title, card, header, subtotal (first cell blank), row or unexpected."""
    start = "|".join([*(k.lower() for k in SECTIONS), "transactions for card #", r'date[^\S\n]*"?[^\S\n]*,'])
    blocks = F.transform(F.split(plain_text(), rf'\n(?=[^\S\n]*"?[^\S\n]*(?iu:{start}))', -1), lambda b: F.filter(F.split(b, "\n"), lambda x: F.trim(x) != ""))
    out = files.select("file", F.filter(blocks, lambda b: F.size(b) > 0).alias("_blocks")).withColumn("_heads", F.transform("_blocks", lambda b: cells(F.get(b, F.lit(0)))))
    first = lambda h: F.trim(F.get(h, F.lit(0)))
    out = out.withColumns({"_titles": F.transform("_heads", lambda h: _title(first(h))), "_cards": F.transform("_heads", lambda h: _card(first(h))), "_sizes": F.transform("_blocks", F.size)})
    last = lambda seen: F.try_element_at(seen, F.lit(-1))
    down = lambda marks, kind: F.aggregate(marks, F.array().cast(f"array<{kind}>"), lambda seen, m: F.array_append(seen, F.coalesce(m, last(seen))))
    before = F.aggregate("_sizes", F.array(F.lit(0)), lambda seen, n: F.array_append(seen, last(seen) + n))
    out = out.withColumns({"_sections": down("_titles", "string"), "_cards": down("_cards", "string"), "_before": F.slice(before, F.lit(1), F.size("_sizes"))})
    express = lambda h: header_matches(h, EXPRESS_HEADER, True) | header_matches(h, EXPRESS_WIDE, True)
    # arrays side by side: one that a function names only once would be made anew for each block
    wide = F.transform(F.arrays_zip("_heads", "_sections", "_titles"), lambda z: F.when((z["_sections"] == "express") & z["_titles"].isNull() & express(z["_heads"]), F.size(z["_heads"]) >= len(EXPRESS_WIDE)))
    out = out.withColumn("_wides", wide).withColumn("_wides", down("_wides", "boolean"))
    out = out.select("file", F.explode(F.arrays_zip("_blocks", "_sections", "_cards", "_wides", "_before")).alias("_b"))
    out = out.select("file", *[F.col(f"_b.{c}").alias(n) for c, n in (("_blocks", "lines"), ("_sections", "section"), ("_cards", "card"), ("_wides", "wide"), ("_before", "before"))])
    every = out.select("file", "section", "card", "wide", "before", F.posexplode("lines").alias("at", "line"))
    every = every.select("file", (F.col("before") + F.col("at") + 2).alias("line_number"), cells(F.col("line")).alias("fields"), "section", "card", "wide")
    return mark_sections(every, lambda rows, marks: rows)


def _title(first: Column) -> Column:
    return F.coalesce(*[F.when(F.upper(first) == k, F.lit(v)) for k, v in SECTIONS.items()])


def _card(first: Column) -> Column:
    return F.when(first.rlike(CARD), F.regexp_extract(first, CARD, 1))


def mark_sections(every: DataFrame, carry: Callable[[DataFrame, dict[str, Column]], DataFrame]) -> DataFrame:
    """Sections, cards and kinds of lines with their fields; `carry` gives the last non-null mark at or above each line."""
    out = every.withColumns({"_title": _title(_cell(0)), "_card": _card(_cell(0))})
    out = carry(out, {"section": F.col("_title"), "card": F.col("_card")})
    matches = lambda expected: (exprs.clean_header(_cell(0)) == expected[0]) & header_matches(F.col("fields"), expected, True)
    header = (
        F.when(F.col("section") == "fuel", matches(FUEL_HEADER)).when(F.col("section") == "manual", matches(MANUAL_HEADER))
        .when(F.col("section") == "express", matches(EXPRESS_HEADER) | matches(EXPRESS_WIDE)).when(F.col("section") == "totals", matches(TOTALS_HEADER))
    )
    kind = (
        F.when(F.col("_title").isNotNull(), "title").when(F.col("_card").isNotNull(), "card").when(header, "header").when(F.col("section").isNull(), "unexpected")
        .when(_cell(0) == "", "subtotal").otherwise("row")
    )
    wide = F.when((F.col("kind") == "header") & (F.col("section") == "express"), F.size("fields") >= len(EXPRESS_WIDE))
    return carry(out.withColumn("kind", kind), {"wide": wide}).drop("_title", "_card")


def illegal_order(parts: DataFrame) -> DataFrame:
    """Files whose sections don't come in their order."""
    rank = F.create_map(*[F.lit(x) for i, v in enumerate(SECTIONS.values()) for x in (v, i)])
    titles = parts.where("kind = 'title'").withColumn("rank", F.element_at(rank, F.col("section")))
    before = F.lag("rank").over(Window.partitionBy("file").orderBy("line_number"))
    return titles.withColumn("_b", before).where("rank <= _b").select("file").distinct()


def header_facts(parts: DataFrame) -> DataFrame:
    """Number, period, invoice and due days, and the currency of each file (null if mixed)."""
    dated = lambda c: F.when(F.substring(c, 5, 1) == "-", exprs.iso_day(F.substring(c, 1, 10)))
    days = F.filter(F.transform("fields", lambda c: dated(F.trim(c))), lambda d: d.isNotNull())
    code = F.when(F.col("section") == "fuel", _cell(20)).when(F.col("section") == "manual", _cell(4)).when(F.col("section") == "express", _cell(6)).when(F.col("section") == "totals", _cell(10))
    out = parts.where("kind = 'row'").groupBy("file").agg(
        F.min(F.array_min(days)).alias("period_start"), F.max(F.array_max(days)).alias("period_end"), F.collect_set(F.when(code != "", exprs.currency_of(code))).alias("_c")
    )
    name = F.regexp_extract("file", r"(\d+)[^/\d]*$", 1)
    return out.select(
        "file", F.when(name != "", name).alias("invoice_number"), "period_start", "period_end", F.date_add("period_end", 1).alias("invoice_day"), F.date_add("period_end", 2).alias("due_day"),
        F.when(F.size("_c") == 1, F.get("_c", F.lit(0))).alias("currency"), (F.size("_c") > 1).alias("mixed_currency"),
    )


def fuel_lines(parts: DataFrame, products: DataFrame) -> DataFrame:
    """Typed fuel rows and the first failing check of each, or null."""
    rows = parts.where("section = 'fuel' and kind = 'row'")
    out = rows.select(
        "file", "line_number", "card", F.regexp_replace(_cell(0), r"-[^-]*$", "").alias("base_auth"), _cell(0).alias("auth"), _cell(1).alias("driver_raw"), _cell(2).alias("unit_raw"),
        F.when(_cell(3).rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"), F.try_to_timestamp(_cell(3), F.lit("yyyy-MM-dd HH:mm:ss"))).alias("occurred_at"), _cell(4).alias("site_ref"), _cell(5).alias("site_name"),
        _cell(6).alias("site_city"), _cell(7).alias("state"), _cell(8).alias("raw_code"), exprs.currency_of(_cell(20)).alias("currency"), *[exprs.decimal_text(_cell(i), p).alias(n) for n, (i, p) in FUEL_NUMBERS.items()],
    )
    out = out.join(F.broadcast(products.select("raw_code", F.col("product_type").alias("product_type"))), "raw_code", "left")  # a supplier's few codes
    checks = [F.when(F.col("auth") == "", "SCHEMA_ERROR"), F.when(F.col("product_type").isNull(), "UNMAPPED_PRODUCT"), F.when(F.col("occurred_at").isNull(), "BAD_TIMESTAMP"), F.when(F.col("currency").isNull(), "BAD_CURRENCY")]
    return out.withColumn("rejection", F.coalesce(*checks, *[F.when(F.col(n).isNull(), "NUMERIC_PARSE_ERROR") for n in FUEL_NUMBERS]))


def cash_rows(parts: DataFrame) -> DataFrame:
    """Express rows of both layouts and manual rows; `bad` where amount and fee don't make the total or a fee is negative."""
    e = parts.where("section = 'express' and kind = 'row'")
    wide = lambda narrow, broad: F.when(F.col("wide"), _cell(broad)).otherwise(_cell(narrow))
    money = lambda c: exprs.decimal_text(c, 2)
    blank = lambda c: F.when(c != "", c)
    express = e.select(
        "file", "line_number", F.lit("express").alias("source"), exprs.iso_day(F.substring(_cell(0), 1, 10)).alias("day"), money(_cell(3)).alias("amount"), money(_cell(4)).alias("fee"), money(_cell(5)).alias("total"),
        exprs.currency_of(_cell(6)).alias("currency"), blank(wide(7, 12)).alias("payee"), blank(wide(8, 13)).alias("notes"), F.when(F.col("wide"), blank(_cell(9))).alias("driver_raw"),
    )
    manual = parts.where("section = 'manual' and kind = 'row'").select(
        "file", "line_number", F.lit("manual").alias("source"), exprs.iso_day(F.substring(_cell(0), 1, 10)).alias("day"), money(_cell(1)).alias("amount"), money(_cell(2)).alias("fee"), money(_cell(3)).alias("total"),
        exprs.currency_of(_cell(4)).alias("currency"), F.lit(None).cast("string").alias("payee"), blank(_cell(5)).alias("notes"), F.lit(None).cast("string").alias("driver_raw"),
    )
    both = express.unionByName(manual)
    wrong = (F.col("amount") + F.col("fee") != F.col("total")) | ((F.col("source") == "express") & (F.col("fee") < 0))
    return both.withColumn("bad", F.coalesce(wrong, F.lit(True)))


def printed_totals(parts: DataFrame) -> DataFrame:
    """Printed rows by product; blank taxes are zero, other blanks null; `Grand Total` is the last row."""
    rows = parts.where("section = 'totals' and kind = 'row'")
    tax = lambda i: F.coalesce(exprs.decimal_text(_cell(i), 2), F.lit(0).cast("decimal(18,2)"))
    return rows.select(
        "file", "line_number", _cell(0).alias("product"), exprs.decimal_text(_cell(1), 2).alias("qty"), exprs.decimal_text(_cell(2), 2).alias("pre_tax"), tax(3).alias("hst"), tax(4).alias("gst"), tax(5).alias("pst"),
        tax(6).alias("qst"), exprs.decimal_text(_cell(8), 2).alias("disc_amt"), exprs.decimal_text(_cell(9), 2).alias("final"), (F.upper(_cell(0)) == "GRAND TOTAL").alias("is_grand"),
    )


def group_stops(fuel: DataFrame) -> DataFrame:
    """Lines of one authorisation as one stop, its sums, and whether card, unit, driver, site and time agree."""
    same = F.struct("card", "unit_raw", "driver_raw", "site_ref", "occurred_at")
    return fuel.where("rejection is null").groupBy("file", "base_auth").agg(
        (F.count_distinct(same) == 1).alias("consistent"), F.min_by(same, "line_number").alias("head"), F.sum("final").cast("decimal(18,2)").alias("final"), F.sum("qty").cast("decimal(18,2)").alias("qty"), F.count("*").alias("lines")
    ).select("file", "base_auth", "consistent", "head.*", "final", "qty", "lines")


def split_stops(fuel: DataFrame) -> DataFrame:
    """Files with a stop whose lines don't agree, by two hashes of what must be the same."""
    names = ("card", "unit_raw", "driver_raw", "site_ref", "occurred_at")
    same = [x for n in names for x in (F.col(n).isNull(), F.col(n))]
    ends = fuel.where("rejection is null").select("file", "base_auth", *[F.xxhash64(F.lit(k), *same).alias(f"_h{k}") for k in (1, 2)]).groupBy("file", "base_auth").agg(*[f(f"_h{k}").alias(f"{f.__name__}{k}") for k in (1, 2) for f in (F.min, F.max)])
    return ends.groupBy("file").agg(F.max((F.col("min1") != F.col("max1")) | (F.col("min2") != F.col("max2"))).alias("inconsistent"))


def line_checks(fuel: DataFrame) -> DataFrame:
    """Checks that a line's own figures fail, in exact integers; quantity checks skip zero quantities."""
    t = lambda c: (F.col(c) * 10000).cast("bigint")
    c = lambda x: (F.col(x) * 100).cast("bigint")
    off = lambda p, money: F.abs(c("qty") * t(p) - c(money) * 10000) * 2 > 10000 + F.abs(t(p)) + F.abs(c("qty"))
    checks = {
        "tax_sum": c("pre_tax") + c("hst") + c("gst") + c("pst") + c("qst") != c("final"), "discount_rate": t("retail") - t("billed") != t("disc_rate"),
        "amount": (F.col("qty") != 0) & off("billed", "final"), "discount": (F.col("qty") != 0) & off("disc_rate", "disc_amt"),
    }
    failed = F.filter(F.array(*[F.when(v, F.lit(k)) for k, v in checks.items()]), lambda x: x.isNotNull())
    return fuel.where("rejection is null").select("file", "line_number", F.explode(failed).alias("check"))


def reconcile(fuel: DataFrame, cash: DataFrame, totals: DataFrame) -> DataFrame:
    """Parsed against printed cents and quantities of every product, of cash and of the grand total; the lines that count."""
    cents = lambda x: (F.col(x) * 100).cast("bigint")
    by_product = fuel.where("rejection is null").groupBy("file", F.col("raw_code").alias("product")).agg(F.sum(cents("final")).alias("parsed_c"), F.sum(cents("qty")).alias("parsed_qty_c"), F.sort_array(F.collect_list("line_number")).alias("lines"))
    by_cash = cash.groupBy("file").agg(F.lit("EXPRESS").alias("product"), F.sum(cents("total")).alias("parsed_c"), F.lit(None).cast("bigint").alias("parsed_qty_c"), F.sort_array(F.collect_list("line_number")).alias("lines"))
    parsed = by_product.unionByName(by_cash)
    grand = parsed.groupBy("file").agg(F.sum("parsed_c").alias("parsed_c")).select("file", F.lit("GRAND TOTAL").alias("product"), "parsed_c", F.lit(None).cast("bigint").alias("parsed_qty_c"), F.lit(None).cast("array<int>").alias("lines"))
    printed = totals.groupBy("file", F.upper("product").alias("product")).agg(F.sum(cents("final")).alias("printed_c"), F.sum(cents("qty")).alias("printed_qty_c"))
    both = parsed.unionByName(grand).withColumn("product", F.upper("product")).join(printed, ["file", "product"], "full")
    return both.withColumns({
        "delta_c": F.coalesce("parsed_c", F.lit(0)) - F.coalesce("printed_c", F.lit(0)),
        "delta_qty_c": F.when(F.col("parsed_qty_c").isNotNull() & F.col("printed_qty_c").isNotNull(), F.col("parsed_qty_c") - F.col("printed_qty_c")),
    })


def totals_checks(totals: DataFrame) -> DataFrame:
    """Printed product rows whose taxes don't add up, and grand totals unlike the sum of their products, tax by tax (pre-tax only
    where the grand row prints one).  The grand row has no sum of its own to check, as it holds cash without tax."""
    cents = lambda x: (F.col(x) * 100).cast("bigint")
    taxes = ["hst", "gst", "pst", "qst"]
    own = totals.where("pre_tax is not null and not is_grand").where(sum((cents(n) for n in taxes), cents("pre_tax")) != cents("final")).select("file", F.col("product").alias("subject"), F.lit("tax_sum").alias("check"))
    side = lambda n, grand: F.coalesce(F.sum(F.when(F.col("is_grand") == grand, cents(n))), F.lit(0))
    delta = {n: side(n, False) - side(n, True) for n in taxes}
    delta["pre_tax"] = F.when(F.max(F.col("is_grand") & F.col("pre_tax").isNotNull()), side("pre_tax", False) - side("pre_tax", True))
    sums = totals.groupBy("file").agg(*[v.alias(n) for n, v in delta.items()])
    grand = sums.unpivot("file", list(delta), "check", "delta").where("delta <> 0").select("file", F.lit("Grand Total").alias("subject"), "check")
    return own.unionByName(grand)


def child_tables(outcomes: DataFrame, fuel: DataFrame, cash: DataFrame, totals: DataFrame, cards: DataFrame) -> dict[str, DataFrame]:
    """The rows of imported files for each child table, and cards that aren't known yet, to be kept as inactive ones."""
    good = outcomes.where("status = 'imported'").select("file", F.col("period_end").alias("billing_week_end"))
    own = lambda rows: rows.join(good, "file")
    lines = own(fuel)
    new = lines.select("card").distinct().join(cards.select("card"), "card", "left_anti").withColumn("status", F.lit("inactive"))
    return {"totals": own(totals), "stops": own(group_stops(fuel)), "lines": lines, "express": own(cash.where("source = 'express'")), "manual": own(cash.where("source = 'manual'")), "cards": new}


def write_children(tables: dict[str, DataFrame], folder: str) -> None:
    """One folder a table, by billing week; a week that is written again replaces what it had."""
    for name, rows in tables.items():
        if "billing_week_end" in rows.columns:  # one file a week
            rows.repartition("billing_week_end").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("billing_week_end").parquet(f"{folder}/{name}")
        else:
            rows.write.mode("append").parquet(f"{folder}/{name}")


def decide(files: DataFrame, parts: DataFrame, fuel: DataFrame, cash: DataFrame, totals: DataFrame, ledger: DataFrame, in_batch: bool = False) -> DataFrame:
    """Each file's outcome: duplicate, failed, conflict, quarantined or imported, and its facts.  A file is imported only if
    its sums, its lines' own figures and its printed totals all agree.

    A number that another file holds is a conflict for any file; a billing week and currency that another holds only for one that would be
    imported, so what is quarantined stays so.  `reason` says which: invoice_number or billing_week.  With `in_batch` the files hold numbers
    and weeks against each other too, in the order of their names; a file that loses its week to another of its batch still holds its number.

    ledger: sha256, invoice_number, week_end, currency of invoices that were imported."""
    head = header_facts(parts)
    odd = parts.where("kind = 'unexpected'").select("file").unionByName(illegal_order(parts)).unionByName(cash.where("bad").select("file")).distinct().withColumn("odd", F.lit(True))
    end = totals.groupBy("file").agg(F.max("is_grand").alias("has_grand"))
    deltas = reconcile(fuel, cash, totals).groupBy("file").agg(F.max((F.col("delta_c") != 0) | F.coalesce(F.col("delta_qty_c") != 0, F.lit(False))).alias("unbalanced"))
    bad = fuel.groupBy("file").agg(F.max(F.col("rejection").isNotNull()).alias("rejected"))
    off = line_checks(fuel).select("file").unionByName(totals_checks(totals).select("file")).distinct().withColumn("checks_fail", F.lit(True))
    split = split_stops(fuel)
    out = files.select("file", F.sha2("content", 256).alias("sha256"))
    for more in (head, odd, end, deltas, bad, off, split):
        out = out.join(more, "file", "left")
    place = F.row_number().over(Window.partitionBy("sha256").orderBy("file"))
    out = out.withColumn("_copy", place).join(ledger.select("sha256").distinct().withColumn("_old", F.lit(True)), "sha256", "left")
    numbers = ledger.select("invoice_number").distinct().withColumn("_number", F.lit(True))
    weeks = ledger.select(F.col("week_end").alias("period_end"), "currency").distinct().withColumn("_week", F.lit(True))
    out = out.join(numbers, "invoice_number", "left").join(weeks, ["period_end", "currency"], "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    bad = yes("mixed_currency") | yes("rejected") | yes("inconsistent") | yes("unbalanced") | yes("checks_fail")
    early = F.when(yes("_old") | (F.col("_copy") > 1), "duplicate").when(yes("odd") | ~yes("has_grand"), "failed")
    out = out.withColumns({"_early": early, "_bad": bad, "reason": F.when(early.isNull(), F.when(yes("_number"), "invoice_number").when(yes("_week") & ~bad, "billing_week"))})
    if in_batch:
        first = lambda of: F.row_number().over(Window.partitionBy(*of, "_rival").orderBy("file"))
        out = out.withColumn("_rival", F.col("_early").isNull() & F.col("reason").isNull() & F.col("invoice_number").isNotNull())
        out = out.withColumn("reason", F.when(F.col("_rival") & (first(["invoice_number"]) > 1), "invoice_number").otherwise(F.col("reason")))
        out = out.withColumn("_rival", F.col("_early").isNull() & F.col("reason").isNull() & ~F.col("_bad"))
        out = out.withColumn("reason", F.when(F.col("_rival") & (first(["period_end", "currency"]) > 1), "billing_week").otherwise(F.col("reason")))
    status = F.coalesce("_early", F.when(F.col("reason").isNotNull(), "conflict").when(F.col("_bad"), "quarantined").otherwise("imported"))
    return out.select("file", "sha256", status.alias("status"), "invoice_number", "period_start", "period_end", "invoice_day", "due_day", "currency", "reason")


def detect_format(files: DataFrame) -> DataFrame:
    """By the first bytes, then by extension; rows path, content (binary)."""
    kind = F.when(F.substring("content", 1, 5) == F.lit(b"%PDF-"), "pdf").when(F.lower("path").endswith(".csv"), "csv").when(F.lower("path").endswith(".pdf"), "pdf").otherwise("unknown")
    return files.withColumn("format", kind)


def preferred(files: DataFrame) -> DataFrame:
    """Of files with the same trailing digits the text of a PDF goes before a CSV; files without digits stand alone."""
    digits = F.regexp_extract("file", r"(\d+)[^/\d]*$", 1)
    key = F.when(digits != "", digits).otherwise(F.col("file"))
    rank = F.when(F.lower("file").endswith(".csv"), 1).otherwise(0)
    place = F.row_number().over(Window.partitionBy(key).orderBy(rank, "file"))
    return files.withColumn("outcome", F.when(place == 1, "used").otherwise("skipped"))


def actual_range(fuel: DataFrame, cash: DataFrame) -> DataFrame:
    """First and last day of fuel and express rows; manual rows don't count."""
    days = fuel.select("file", F.to_date("occurred_at").alias("day")).unionByName(cash.where("source = 'express'").select("file", "day"))
    return days.groupBy("file").agg(F.min("day").alias("actual_start"), F.max("day").alias("actual_end"))
