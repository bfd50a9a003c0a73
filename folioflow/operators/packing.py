"""Ordered units into batches, and ranges of units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ALL_BEFORE = (Window.unboundedPreceding, Window.currentRow)


def merge_groups(units: DataFrame, limit: int, enabled: bool = True, pages_once: bool = False) -> DataFrame:
    """units(book, page, ord, original) with group_start: the ord of the first unit of its batch.

    A batch holds neighbouring units of one page, at most `limit` code points in
    all; a unit over the limit is a batch of its own. The packing is greedy, so
    it runs along a page; pages are packed side by side. pages_once: a page's
    units all follow each other, which spares looking for pages that don't.
    """
    if not enabled or limit <= 0:
        return units.withColumn("group_start", F.col("ord"))
    size = F.struct("ord", F.length("original").cast("long").alias("size"), F.lit(False).alias("first"))
    pages = units.groupBy("book", "page").agg(F.sort_array(F.collect_list(size)).alias("u"))
    state = F.struct(F.lit(0).cast("long").alias("held"), F.array().cast("array<bigint>").alias("starts"))

    def step(s: Column, x: Column) -> Column:
        new = x["first"] | (F.size(s["starts"]) == 0) | (s["held"] + x["size"] > limit)
        return F.struct(F.when(new, x["size"]).otherwise(s["held"] + x["size"]).alias("held"), F.when(new, F.concat(s["starts"], F.array(x["ord"]))).otherwise(s["starts"]).alias("starts"))

    # a page's batch starts go back to its units, each of which takes the last one that isn't after it
    starts = (pages if pages_once else _interrupted(pages)).select("book", "page", F.aggregate("u", state, step)["starts"].alias("__starts"))
    joined = _left(units, starts, ["book", "page"])
    return joined.withColumn("group_start", F.array_max(F.filter("__starts", lambda s: s <= F.col("ord")))).drop("__starts")


def _interrupted(pages: DataFrame) -> DataFrame:
    """pages(book, page, u) with `first` set in the units that another page's units stand before, amid the page.

    Which pages others reach into is told by where each begins and ends, a row a
    page; only the units of these are put in order along their book.
    """
    spans = pages.select("book", "page", F.col("u")[0]["ord"].alias("from"), F.element_at("u", -1)["ord"].alias("to"))
    along = Window.partitionBy("book").orderBy("from", "to")
    reaches = F.coalesce(F.max("to").over(along.rowsBetween(Window.unboundedPreceding, -1)) >= F.col("from"), F.lit(False))
    reached = F.coalesce(F.lead("from").over(along) <= F.col("to"), F.lit(False))
    mixed = spans.withColumn("__mixed", reaches | reached).filter("__mixed").select("book", "page", "__mixed")
    told = _left(pages, mixed, ["book", "page"])
    rows = told.filter("__mixed").select("book", "page", F.explode("u").alias("x")).select("book", "page", "x.ord", "x.size")
    before = F.lag(F.struct("page")).over(Window.partitionBy("book").orderBy("ord"))
    first = ~(before.isNull() | before["page"].eqNullSafe(F.col("page")))
    again = rows.withColumn("first", first).groupBy("book", "page").agg(F.sort_array(F.collect_list(F.struct("ord", "size", "first"))).alias("u"))
    return told.filter("__mixed is null").select("book", "page", "u").unionByName(again)


def _left(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on keys that may be null."""
    renamed = right.select(*(F.col(k).alias(f"__{k}") for k in keys), *(c for c in right.columns if c not in keys))
    on = [left[k].eqNullSafe(renamed[f"__{k}"]) for k in keys]
    return left.join(renamed, on, "left").drop(*(f"__{k}" for k in keys))


def group_rows(packed: DataFrame) -> DataFrame:
    """(book, page, group_start, n_units, chars, members) of merge_groups' rows."""
    return packed.groupBy("book", "page", "group_start").agg(
        F.count("*").alias("n_units"), F.sum(F.length("original")).cast("long").alias("chars"),
        F.sort_array(F.collect_list(F.struct("ord", "id", F.col("original").alias("text")))).alias("members"),
    )


def page_matches(page: Column, wanted: str) -> Column:
    """The page itself or its last part; a null page never."""
    return F.coalesce((page == wanted) | (F.substring_index(page, "/", -1) == wanted), F.lit(False))


def range_selection(units: DataFrame, start: str, end: str = "", page: str = "") -> DataFrame:
    """The units of each book from the first that contains `start` to the first at or after it that contains `end`.

    Without `end`, or where none follows, the range runs to the book's last
    unit. `page` limits it to one page. Ignored units count like others. The two
    bounds are minima, made before the shuffle; no book is sorted.
    """
    here = units if not page else units.filter(page_matches(F.col("page"), page))
    first = here.filter(F.contains("original", F.lit(start))).groupBy("book").agg(F.min("ord").alias("__from"))
    from_start = here.join(first, "book").filter(F.col("ord") >= F.col("__from")).drop("__from")
    if not end:
        return from_start
    last = from_start.filter(F.contains("original", F.lit(end))).groupBy("book").agg(F.min("ord").alias("__to"))
    return from_start.join(last, "book", "left").filter(F.col("__to").isNull() | (F.col("ord") <= F.col("__to"))).drop("__to")


def occurrence_number(rows: DataFrame, by: list[str], order: list[str]) -> Column:
    """0-based number of a row among those of its key."""
    return F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1


def consecutive_failures(outcomes: DataFrame, by: list[str], order: list[str], limit: int) -> DataFrame:
    """outcomes(ok) with `failures`, the run of failures that ends here, and `tripped`, whether any run so far has reached the limit."""
    along = Window.partitionBy(*by).orderBy(*order)
    islands = outcomes.withColumn("__island", F.sum(F.col("ok").cast("int")).over(along.rowsBetween(*ALL_BEFORE)))
    run = Window.partitionBy(*by, "__island").orderBy(*order).rowsBetween(*ALL_BEFORE)
    counted = islands.withColumn("failures", F.sum((~F.col("ok")).cast("int")).over(run).cast("int"))
    return counted.withColumn("tripped", F.max("failures").over(along.rowsBetween(*ALL_BEFORE)) >= limit).drop("__island")
