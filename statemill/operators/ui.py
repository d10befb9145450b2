"""What the editor shows: row and page mappings, filters, hit tests and regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import rules

BOX = "struct<x:double,y:double,w:double,h:double>"


def pixels(bbox: Column) -> Column:
    """A box in points [x0, y0, x1, y1] as x, y, w, h in pixels of 300 to the inch; zeros for anything else."""
    k = rules.POINTS_TO_PIXELS
    at = lambda i: F.element_at(bbox, i)
    box = F.struct((at(1) * k).alias("x"), (at(2) * k).alias("y"), ((at(3) - at(1)) * k).alias("w"), ((at(4) - at(2)) * k).alias("h")).cast(BOX)
    none = F.struct(*(F.lit(0.0).alias(c) for c in "xywh")).cast(BOX)
    return F.when(F.size(bbox) == 4, box).otherwise(none)


def ui_rows(transactions: DataFrame) -> DataFrame:
    """Missing amounts are 0, unknown types follow the sign (0 is a credit), pages count from one."""
    amount = F.coalesce(F.col("amount").cast("double"), F.lit(0.0))
    kind = F.when(F.col("type").isin("credit", "debit"), F.col("type")).when(amount < 0, "debit").otherwise("credit")
    return transactions.withColumns({"amount": amount, "type": kind, "page": F.col("page") + 1})


def ui_reconciliation(reconciled: DataFrame) -> DataFrame:
    """Credits and debits of the grid: deposits or payments, and withdrawals or purchases alone."""
    credit = F.coalesce(F.col("components")["deposits_credits"], F.col("components")["payments_and_credits"], F.lit(0))
    debit = F.coalesce(F.col("components")["withdrawals_debits"], F.col("components")["purchases_and_charges"], F.lit(0))
    return reconciled.select("doc_id", credit.cast("double").alias("total_credits"), debit.cast("double").alias("total_debits"), (F.col("status") == "BALANCED").alias("reconciled"))


def console_totals(rows: DataFrame, components: DataFrame | None = None) -> DataFrame:
    """Credits and debits of the console summary: the reported components (doc_id, components) where any of them counts,
    else sums by sign."""
    amount, zero = F.col("amount"), F.lit(0).cast("decimal(28,2)")
    signs = rows.groupBy("doc_id").agg(F.coalesce(F.sum(F.when(amount > 0, amount)), zero).cast("double").alias("credits"), F.coalesce(F.sum(F.when(amount < 0, -amount)), zero).cast("double").alias("debits"), F.count("*").alias("transactions"))
    if components is None:
        return signs
    total = lambda *names: sum((F.coalesce(F.col("components")[n].cast("double"), F.lit(0.0)) for n in names), F.lit(0.0))
    told = components.select("doc_id", F.round(total("deposits_credits", "payments_and_credits"), 2).alias("c"), F.round(total("withdrawals_debits", "purchases_and_charges", "fees_charged", "interest_charged"), 2).alias("d"))
    full = told.join(signs, "doc_id", "left").fillna(0)
    none = (F.col("c") == 0) & (F.col("d") == 0)
    return full.select("doc_id", F.when(none, F.col("credits")).otherwise(F.col("c")).alias("credits"), F.when(none, F.col("debits")).otherwise(F.col("d")).alias("debits"), "transactions")


def grid_filter(rows: DataFrame, needle: str) -> DataFrame:
    return rows.where(F.contains(F.lower(F.concat_ws(" ", F.col("date").cast("string"), "description", F.col("amount").cast("string"), "type")), F.lit(needle.lower())))


def on_page(rows: DataFrame, page: int) -> DataFrame:
    return rows.where(F.col("page") == page)


def page_type(mode: Column) -> Column:
    return F.when(mode.isin("DIGITAL_VECTOR", "DIGITAL"), "vector").otherwise("scanned")


def preview(text: Column, n: int = 200) -> Column:
    return F.substring(text, 1, n)


def crop(box: Column, width: Column, height: Column) -> Column:
    """A pixel region clamped to its image; degenerate regions become 10 x 10 at their corner."""
    edge = lambda v, top: F.greatest(F.lit(0), F.least(F.bround(v, 0).cast("int"), top))
    x0, y0 = edge(box["x"], width), edge(box["y"], height)
    x1, y1 = edge(box["x"] + box["w"], width), edge(box["y"] + box["h"], height)
    ok = (x1 > x0) & (y1 > y0)
    return F.struct(x0.alias("x0"), y0.alias("y0"), F.when(ok, x1).otherwise(x0 + 10).alias("x1"), F.when(ok, y1).otherwise(y0 + 10).alias("y1"), (~ok).alias("blank"))


def region_text(tokens: DataFrame, regions: DataFrame) -> DataFrame:
    """(region_id, text): the tokens of a page whose centre lies in a region (doc_id, page, x0, y0, x1, y1), in reading order."""
    x, y = (F.col("t.x0") + F.col("t.x1")) / 2, (F.col("t.y0") + F.col("t.y1")) / 2
    inside = (F.col("t.doc_id") == F.col("r.doc_id")) & (F.col("t.page") == F.col("r.page")) & x.between(F.col("r.x0"), F.col("r.x1")) & y.between(F.col("r.y0"), F.col("r.y1"))
    words = F.array_sort(F.collect_list(F.struct(y.alias("y"), F.col("t.x0").alias("x"), "t.ord", "t.text")))
    hit = regions.alias("r").join(tokens.alias("t"), inside, "left").groupBy("r.region_id").agg(words.alias("w"))
    return hit.select("region_id", F.array_join(F.transform("w", lambda w: w["text"]), " ").alias("text"))


def hit_test(rows: DataFrame, points: DataFrame) -> DataFrame:
    """The first row box of a page that holds a point, and its cell by priority date, description, amount, whole row."""
    holds = lambda b: F.coalesce((F.col("px") >= b["x"]) & (F.col("px") <= b["x"] + b["w"]) & (F.col("py") >= b["y"]) & (F.col("py") <= b["y"] + b["h"]), F.lit(False))
    found = points.join(rows, ["doc_id", "page"]).where(holds(F.col("row_box")))
    part = F.when(holds(F.col("date_box")), "date").when(holds(F.col("description_box")), "description").when(holds(F.col("amount_box")), "amount").otherwise("all")
    first = F.row_number().over(Window.partitionBy("point_id").orderBy("idx"))
    return found.withColumns({"part": part, "__r": first}).where("__r = 1").select("point_id", "idx", "part")


def snip_fields(hint: Column, date: Column, amount: Column, cleaned: Column) -> Column:
    """What a snip with this hint writes, as a map: fields that it names and that were read; other hints write nothing."""
    whole = F.trim(F.coalesce(cleaned, F.lit("")))
    wants = lambda n: F.coalesce(hint.isin("all", n), F.lit(False))
    entry = lambda n, v, given: F.when(wants(n) & given, F.struct(F.lit(n).alias("key"), v.cast("string").alias("value")))
    found = F.array(entry("date", date, F.coalesce(date, F.lit("")) != ""), entry("amount", amount, amount.isNotNull()), entry("description", whole, whole != ""))
    return F.map_from_entries(F.filter(found, lambda e: e.isNotNull()))
