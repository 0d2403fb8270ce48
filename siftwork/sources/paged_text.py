"""Documents given as pages of text to chunks.

Input has one row a document: pages is an array of struct(page_no, text) in order, blank pages already gone; all other columns
stay. Splitting is by columns: item starts come from the pieces between matches, page numbers from running lengths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import rules
from ..functions import text as T

# Line starts of agenda items and of budget projects, the gate of the latter, and sizes.
ITEM = r"(?im)^(?:Item\s+\d|[A-Z]\d[A-Z]?|Agenda\s+Item|CONSENT\s+AGENDA|PUBLIC\s+HEARING|DISCUSSION\s+ITEM|ORDINANCE|RESOLUTION|R\d[A-Z]|C\d[A-Z])"
PROJECT = r"(?im)^(?:Project\s+(?:Name|No|#|ID)|[A-Z][A-Z\s]{5,40}(?:IMPROVEMENT|PROGRAM|PROJECT|REPLACEMENT|REHABILITATION))"
BUDGET = r"(?i)capital|budget|CIP|appropriat"
PACKED = 4000


def pages_of(rows: DataFrame, document: str = "document", page: str = "page_no", text: str = "text") -> DataFrame:
    """Rows of pages to one row a document; blank pages are dropped."""
    kept = rows.where(F.coalesce(T.strip(F.col(text)), F.lit("")) != "")
    return kept.groupBy(document).agg(F.array_sort(F.collect_list(F.struct(F.col(page).cast("int").alias("page_no"), F.col(text).alias("text")))).alias("pages"))


def page_at(pages: Column, offset: Column) -> Column:
    """The first page whose running length (2 more a page) reaches the offset, else the last, 1 without pages."""
    start = F.struct(F.lit(0).alias("n"), F.lit(None).cast("int").alias("page"))
    walked = F.aggregate(pages, start, lambda acc, p: F.struct(
        (acc["n"] + F.length(p["text"]) + 2).alias("n"), F.coalesce(acc["page"], F.when(acc["n"] + F.length(p["text"]) + 2 >= offset, p["page_no"])).alias("page")), lambda acc: acc["page"])
    return F.coalesce(walked, F.when(F.size(pages) > 0, F.element_at(pages, -1)["page_no"]), F.lit(1))


def _blocks(full: Column, p: str, last: int | None) -> Column:
    """array of struct(start, block): from each match to the next; the last block is at most `last` long."""
    u = f"(?U){p}"
    heads = F.regexp_extract_all(full, F.lit(u), F.lit(0))
    gaps = F.split(full, u, -1)
    # the text is gap 0, head 0, gap 1, head 1, ...: offsets are running lengths
    first = F.struct(F.length(F.get(gaps, F.lit(0))).alias("at"), F.array().cast("array<struct<start:int,size:int>>").alias("found"))

    def step(acc: Column, i: Column) -> Column:
        size = F.length(F.get(heads, i)) + F.length(F.get(gaps, i + 1))
        return F.struct((acc["at"] + size).alias("at"), F.concat(acc["found"], F.array(F.struct(acc["at"].alias("start"), size.alias("size")))).alias("found"))

    numbers = F.when(F.size(heads) > 0, F.sequence(F.lit(0), F.size(heads) - 1)).otherwise(F.array().cast("array<int>"))
    placed = F.aggregate(numbers, first, step, lambda acc: acc["found"])
    cut = F.transform(placed, lambda b, i: F.struct(b["start"].alias("start"), T.strip(full.substr(b["start"] + 1, F.when((i == F.size(heads) - 1) & F.lit(last is not None), F.least(b["size"], F.lit(last or 0))).otherwise(b["size"]))).alias("block")))
    return F.when(F.size(heads) >= 2, cut).otherwise(F.array().cast("array<struct<start:int,block:string>>"))


def _rows(blocks: Column, pages: Column, least: int, kind: str, category: Column) -> Column:
    kept = F.filter(blocks, lambda b: F.length(b["block"]) >= least)
    return F.transform(kept, lambda b: F.struct(
        T.prefix(b["block"], 8000).alias("text"), T.prefix(F.get(F.split(b["block"], "\n"), F.lit(0)), 200).alias("title"), rules.first_date(b["block"]).alias("date"),
        page_at(pages, b["start"]).cast("string").alias("page_number"), F.lit(kind).alias("chunk_type"), category.alias("category")))


def agenda(pages: Column, category: Column) -> Column:
    """T5: items from their line starts; two at least."""
    full = F.array_join(F.transform(pages, lambda p: p["text"]), "\n\n")
    return _rows(_blocks(full, ITEM, None), pages, 30, "agenda_item", F.when(category == "", "meetings").otherwise(category))


def budget(pages: Column, category: Column) -> Column:
    """Projects from their headers; two at least, in a document that speaks of budgets."""
    full = F.array_join(F.transform(pages, lambda p: p["text"]), "\n\n")
    found = _rows(_blocks(full, PROJECT, 5000), pages, 40, "budget_line", F.when(category == "", "budget").otherwise(category))
    return F.when(full.rlike(f"(?U){BUDGET}"), found).otherwise(F.slice(found, 1, 0))


def packed(pages: Column, category: Column) -> Column:
    """Pages gathered until the next one would pass 4000 characters; the first buffer starts with the page joint."""
    empty = F.array().cast("array<struct<text:string,first:int,last:int>>")
    start = F.struct(F.lit("").alias("buffer"), F.lit(1).alias("first"), empty.alias("done"))

    def step(acc: Column, p: Column) -> Column:
        full = (F.length(acc["buffer"]) + F.length(p["text"]) > PACKED) & (acc["buffer"] != "")
        closed = F.struct(acc["buffer"].alias("text"), acc["first"].alias("first"), (p["page_no"] - 1).alias("last"))
        return F.struct(F.when(full, p["text"]).otherwise(F.concat(acc["buffer"], F.lit("\n\n"), p["text"])).alias("buffer"), F.when(full, p["page_no"]).otherwise(acc["first"]).alias("first"),
                        F.when(full, F.concat(acc["done"], F.array(closed))).otherwise(acc["done"]).alias("done"))

    def close(acc: Column) -> Column:
        rest = F.struct(acc["buffer"].alias("text"), acc["first"].alias("first"), F.coalesce(F.get(pages, F.size(pages) - 1)["page_no"], acc["first"]).alias("last"))
        return F.when(T.strip(acc["buffer"]) != "", F.concat(acc["done"], F.array(rest))).otherwise(acc["done"])

    return F.transform(F.aggregate(pages, start, step, close), lambda b: F.struct(
        b["text"].alias("text"), T.prefix(F.get(F.split(b["text"], "\n"), F.lit(0)), 200).alias("title"), rules.first_date(b["text"]).alias("date"),
        F.concat(b["first"].cast("string"), F.lit("-"), b["last"].cast("string")).alias("page_number"), F.lit("section").alias("chunk_type"), category.alias("category")))


def parsed(documents: DataFrame) -> DataFrame:
    """documents(pages, category, ...) to chunks with chunk_no: agenda items, else budget lines, else packed pages."""
    category = F.coalesce("category", F.lit(""))
    rows = documents.withColumn("__a", agenda(F.col("pages"), category)).withColumn("__b", F.when(F.size("__a") == 0, budget(F.col("pages"), category)))
    found = F.when(F.size("__a") > 0, F.col("__a")).when(F.size("__b") > 0, F.col("__b")).otherwise(packed(F.col("pages"), category))
    each = rows.withColumn("__c", found).drop("__a", "__b", "pages", "category").select("*", F.posexplode("__c").alias("chunk_no", "__one"))
    return each.select("*", "__one.*", F.lit("pdf").alias("doc_type")).drop("__c", "__one")


def running_pages(rows: DataFrame, document: str = "document") -> DataFrame:
    """T8 over page rows: each page's end offset as a running sum."""
    order = Window.partitionBy(document).orderBy("page_no").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("end_offset", F.sum(F.length("text") + 2).over(order))
