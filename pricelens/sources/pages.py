"""Paged JSON feeds that were landed as files: read, parsed, and scanned to a proven end.

A page is a JSON object with info (currentPage, nextPage, and on the first page counts.total) and results, rows
with an id. A scan follows a feed from page 1 on, takes each id once, and says why it ended. It is a few grouped
passes over pages and ids, not a loop: what a page adds is what no earlier page had.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..registry import query
from .tables import table

PAGE = "info struct<currentPage: int, nextPage: int, counts: struct<total: bigint>>, results array<struct<id: string, status: string, soldAt: string, price: double>>"
#: Ends after which a feed counts as read to its end.
COMPLETE = ("declared total", "empty page", "short page", "no next page")


def landed(spark: SparkSession, path: str) -> DataFrame:
    """feed (the folder's name), page and body of files <path>/<feed>/<page>.json, on any file system that Spark reads."""
    files = spark.read.option("wholetext", True).text(f"{path.rstrip('/')}/*/*.json").withColumn("file", F.input_file_name())
    at = lambda k: F.regexp_extract("file", r"([^/]+)/([0-9]+)\.json$", k)
    return files.select(at(1).alias("feed"), at(2).cast("int").alias("page"), F.col("value").alias("body"))


def rows_of(pages: DataFrame) -> DataFrame:
    """feed, page, place and the fields of every row that has an id."""
    parsed = pages.select("feed", "page", F.from_json("body", PAGE).alias("p"))
    rows = parsed.select("feed", "page", F.posexplode("p.results").alias("place", "row"))
    return rows.select("feed", "page", "place", F.trim("row.id").alias("id"), "row.status", "row.soldAt", "row.price").where("id <> ''")


def scanned(pages: DataFrame, page_size: int, most: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """How the scan of each feed ended (feed, reason, pages, listings, total, complete), and the rows it took (each id from its first page)."""
    p = pages.select("feed", "page", F.from_json("body", PAGE).alias("p"))
    first = rows_of(pages).withColumn("_k", F.row_number().over(Window.partitionBy("feed", "id").orderBy("page", "place"))).where("_k = 1").drop("_k")
    new = first.groupBy("feed", "page").agg(F.count("id").alias("new"))
    ids = F.array_join(F.transform("p.results", lambda r: F.coalesce(F.trim(r["id"]), F.lit(""))), "|")
    at = Window.partitionBy("feed").orderBy("page")  # one row a page
    bad = F.col("p.info").isNull() | F.col("p.results").isNull() | ~F.col("p.info.currentPage").eqNullSafe(F.col("page"))
    bad = bad | ((F.col("page") == 1) & ~F.coalesce(F.col("p.info.counts.total") >= 0, F.lit(False)))
    q = p.join(new, ["feed", "page"], "left").select(
        "feed", "page", F.coalesce("new", F.lit(0)).alias("new"), F.size("p.results").alias("n"), F.col("p.info.nextPage").alias("next"), bad.alias("bad"), F.sha2(ids, 256).alias("ids"),
        F.when(F.col("page") == 1, F.col("p.info.counts.total")).alias("total"),
    )
    q = q.withColumns({
        "total": F.max("total").over(Window.partitionBy("feed")), "unique": F.sum("new").over(at), "following": F.lead("page").over(at), "before": F.lag("page").over(at),
        "again": F.row_number().over(Window.partitionBy("feed", "ids").orderBy("page")) > 1,
    })
    last = F.when(F.col("unique") != F.col("total"), "total not reached").when(F.col("n") == 0, "empty page").when(F.col("n") < page_size, "short page").otherwise("no next page")
    reason = (
        F.when(F.col("before").isNull() & (F.col("page") != 1), "page failed").when(F.col("bad"), "malformed").when(F.col("again") & (F.col("n") > 0), "repeated page")
        .when((F.col("n") > 0) & (F.col("new") == 0), "no progress").when(F.col("unique") == F.col("total"), "declared total").when(F.col("next").isNull(), last)
        .when(F.col("next") <= F.col("page"), "malformed").when(~F.col("next").eqNullSafe(F.col("following")), "page failed").when(F.col("page") >= most, "safety limit")
    )
    q = q.withColumn("reason", reason).where("reason is not null")
    end = q.groupBy("feed").agg(F.min_by(F.struct("page", "reason", "unique", "new", "total"), "page").alias("e")).select("feed", "e.*")
    whole = ~F.col("reason").isin("malformed") | F.col("new").isNull()
    listings = F.when(whole, F.col("unique")).otherwise(F.col("unique") - F.col("new"))
    end = end.select("feed", "reason", F.col("page").alias("pages"), listings.alias("listings"), "total", F.col("reason").isin(*COMPLETE).alias("complete"))
    upto = F.when(F.col("reason") == "malformed", F.col("pages") - 1).otherwise(F.col("pages"))
    taken = first.join(end.select("feed", upto.alias("_upto")), "feed").where("page <= _upto").drop("_upto")
    return end, taken


SIZE = 20


def landed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as landed pages of seven feeds of 20 rows a page: feed 0 is whole, the others each have a fault."""
    e = table(spark, sf_dir, "events").select((F.col("event_id") % 7).alias("feed"), F.floor(F.col("event_id") / 7).alias("rn"), F.col("event_id").cast("string").alias("id"), "event_type", "value")
    total = e.groupBy("feed").agg(F.count("id").alias("n"))
    page = (F.floor(F.col("rn") / SIZE) + 1).cast("int")
    sheets = e.groupBy("feed", page.alias("page")).agg(F.sort_array(F.collect_list(F.struct("rn", "id", F.col("event_type").alias("status"), F.col("value").alias("price")))).alias("rows"))  # 20 rows each
    again = sheets.where("feed in (2, 5) and page <= 2")
    copied = again.where("feed = 2 and page = 2").select("feed", F.lit(3).alias("page"), "rows")
    mixed = again.where("feed = 5").groupBy("feed").agg(F.flatten(F.collect_list(F.slice("rows", 1, 10))).alias("rows")).select("feed", F.lit(3).alias("page"), "rows")
    sheets = sheets.where("not (feed in (2, 5) and page = 3) and not (feed = 4 and page = 3)").unionByName(copied).unionByName(mixed)
    rows = sheets.join(total, "feed").withColumn("last", F.ceil(F.col("n") / SIZE))
    declared = F.when(F.col("feed") == 1, F.col("n") + 5).when(F.col("feed") != 6, F.col("n"))
    counts = F.when(F.col("page") == 1, F.struct(declared.alias("total")))
    info = F.struct(F.col("page").alias("currentPage"), F.when(F.col("page") < F.col("last"), F.col("page") + 1).alias("nextPage"), counts.alias("counts"))
    body = F.when((F.col("feed") == 3) & (F.col("page") == 2), F.to_json(F.struct(F.col("rows").alias("results")))).otherwise(F.to_json(F.struct(info.alias("info"), F.col("rows").alias("results"))))
    return rows.select(F.col("feed").cast("string").alias("feed"), "page", body.alias("body"))


@query("SRC-01", "SRC-05", sql=f"""
select feed::varchar as feed, ['declared total', 'total not reached', 'repeated page', 'malformed', 'page failed', 'no progress', 'malformed'][feed + 1] as reason,
  case when feed < 2 then ceil(n / {SIZE}) when feed in (2, 5) then 3 when feed in (3, 4) then 2 else 1 end::int as pages,
  case when feed < 2 then n when feed in (2, 4, 5) then 40 when feed = 3 then 20 else 0 end::bigint as listings, case when feed = 1 then n + 5 when feed <> 6 then n end::bigint as total, feed = 0 as complete
from (select event_id % 7 as feed, count(*) as n from events group by all)""")
def page_scans(spark, sf_dir):
    return scanned(landed_events(spark, sf_dir), SIZE)[0]


@query("SRC-02", sql=f"""
select feed::varchar as feed, count(*) as listings, round(sum(value), 2) as value from (select event_id % 7 as feed, event_id // 7 as rn, value from events)
where feed < 2 or (feed in (2, 4, 5) and rn < 40) or (feed = 3 and rn < 20) group by all""")
def scanned_listings(spark, sf_dir):
    """What the scans took: each id once, with its price, up to the page where the feed ended."""
    return scanned(landed_events(spark, sf_dir), SIZE)[1].groupBy("feed").agg(F.count("id").alias("listings"), F.round(F.sum("price"), 2).alias("value"))
