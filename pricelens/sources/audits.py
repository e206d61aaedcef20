"""Coverage of paged scans, counted while the rows are written: no second pass over what was read."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..registry import query
from .pages import PAGE, SIZE, landed_events
from .state import save, shared_folder

AUDIT = "feed string, pages long, malformed long, repeated long, rows long, unkeyed long, duplicates long, declared long, ended boolean"


def audited_rows(pages: DataFrame) -> DataFrame:
    """Rows of landed pages with what the audit counts: page_start (once a page), malformed and repeated (pages), unkeyed and again (rows).

    A page without info or results, or whose number is not its own, is malformed, and its rows are not taken. A page that holds the ids of
    an earlier one of its feed in the same order is repeated. An id counts where it comes first.
    """
    p = pages.select("feed", "page", F.from_json("body", PAGE).alias("p"))
    bad = F.col("p.info").isNull() | F.col("p.results").isNull() | ~F.col("p.info.currentPage").eqNullSafe(F.col("page"))
    ids = F.transform("p.results", lambda r: F.coalesce(F.trim(r["id"]), F.lit("")))
    p = p.select("feed", "page", bad.alias("malformed"), F.sha2(F.to_json(ids), 256).alias("_print"), F.when(~bad, F.col("p.results")).alias("_rows"), F.when(F.col("page") == 1, F.col("p.info.counts.total")).alias("declared"), (~bad & F.col("p.info.nextPage").isNull()).alias("ended"))
    same = Window.partitionBy("feed", "_print").orderBy("page")
    p = p.withColumn("repeated", ~F.col("malformed") & (F.size("_rows") > 0) & (F.row_number().over(same) > 1))
    rows = p.select("feed", "page", "malformed", "repeated", "declared", "ended", F.posexplode_outer("_rows").alias("place", "r"))
    rows = rows.withColumn("id", F.when(F.trim("r.id") != "", F.trim("r.id")))
    first = Window.partitionBy("feed", "id").orderBy("page", "place")
    return rows.select(
        "feed", "page", "place", "id", F.col("r.status").alias("status"), F.col("r.price").alias("price"), "malformed", "repeated", "declared", "ended", F.coalesce(F.col("place") == 0, F.lit(True)).alias("page_start"),
        (F.col("place").isNotNull() & F.col("id").isNull()).alias("unkeyed"), (F.col("id").isNotNull() & (F.row_number().over(first) > 1)).alias("again"),
    )


def audited_scan(pages: DataFrame, feeds: list[str], folder: str) -> DataFrame:
    """Write the rows that the feeds' pages hold (each id once) below a folder and return the audit of each feed, as counted on the way.

    feeds are the scans that were asked for, so that one without a page is audited too.
    """
    rows = audited_rows(pages)
    start = F.col("page_start")
    counts = {"pages": start & ~F.col("malformed"), "malformed": start & F.col("malformed"), "repeated": start & F.col("repeated"), "rows": F.col("place").isNotNull(), "unkeyed": F.col("unkeyed"), "duplicates": F.col("again")}
    of = lambda i: F.col("feed") == feeds[i]
    metrics = [F.count_if(of(i) & c).alias(f"{i}:{name}") for i in range(len(feeds)) for name, c in counts.items()]
    metrics += [m for i in range(len(feeds)) for m in (F.max(F.when(of(i), F.col("declared"))).alias(f"{i}:declared"), F.coalesce(F.max(F.when(of(i), F.col("ended"))), F.lit(False)).alias(f"{i}:ended"))]
    seen = Observation("coverage")
    save(rows.observe(seen, *metrics).where("id is not null and not again").select("feed", "page", "id", "status", "price"), folder)
    got = seen.get
    names = [*counts, "declared", "ended"]
    return pages.sparkSession.createDataFrame([(feed, *[got[f"{i}:{n}"] for n in names]) for i, feed in enumerate(feeds)], AUDIT)


def coverage(audit: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """An audit with listings (different ids), missing (of the declared), ratio (percent of the declared, null if none was) and status.

    INCOMPLETE: a page failed, is malformed or repeated, a row has no id, or the declared total is not met. COMPLETE: the declared total is met, or there is
    none and the last page says that it is the last. Else UNKNOWN. wanted (feed, requested) tells how many pages were asked for; those
    that did not come have failed.
    """
    listings = F.col("rows") - F.col("unkeyed") - F.col("duplicates")
    rows = audit.withColumn("listings", listings)
    if wanted is not None:
        rows = rows.join(wanted.select(F.col("feed").alias("_feed"), "requested"), F.col("feed") == F.col("_feed"), "left").drop("_feed")
    failed = F.greatest(F.lit(0), F.coalesce(F.col("requested"), F.lit(0)) - F.col("pages") - F.col("malformed")) if wanted is not None else F.lit(0)
    declared = F.col("declared")
    ratio = F.when(declared == 0, F.when(F.col("listings") == 0, 100.0).otherwise(0.0)).otherwise(F.col("listings") / F.when(declared != 0, declared) * 100)
    broken = (failed > 0) | (F.col("malformed") > 0) | (F.col("repeated") > 0) | (F.col("unkeyed") > 0) | F.coalesce(declared != F.col("listings"), F.lit(False))
    status = F.when(broken, "INCOMPLETE").when(declared.isNotNull() | F.col("ended"), "COMPLETE").otherwise("UNKNOWN")
    return rows.select(*audit.columns, failed.cast("long").alias("failed"), "listings", F.greatest(F.lit(0), declared - F.col("listings")).alias("missing"), ratio.alias("ratio"), status.alias("status"))


@query("AUD-01", "AUD-02", "AUD-03", "AUD-04", sql=f"""
with f as (select event_id % 7 as feed, count(*) as n from events group by all),
a as (select feed::varchar as feed, ceil(n / {SIZE}.0)::bigint - case when feed in (3, 4) then 1 else 0 end as pages, (feed = 3)::bigint as malformed, (feed = 2)::bigint as repeated, n - case when feed in (3, 4) then {SIZE} else 0 end as rows,
  case when feed in (2, 5) then {SIZE} else 0 end::bigint as duplicates, case when feed = 1 then n + 5 when feed <> 6 then n end::bigint as declared, (feed = 4)::bigint as failed from f)
select *, rows - duplicates as listings, greatest(0, declared - (rows - duplicates)) as missing, round((rows - duplicates) / declared::double * 100, 6) as ratio, case when feed in ('0', '6') then 'COMPLETE' else 'INCOMPLETE' end as status from a""")
def observed_coverage(spark, sf_dir):
    """Seven landed feeds, written once and audited by what was observed: whole, short of its total, a page repeated, a page malformed, a page missing, rows repeated, no total."""
    pages = landed_events(spark, sf_dir)
    feeds = [str(i) for i in range(7)]
    audit = audited_scan(pages, feeds, shared_folder(spark))
    asked = pages.groupBy("feed").agg(F.max("page").cast("long").alias("requested"))
    rows = coverage(audit, asked)
    return rows.select("feed", "pages", "malformed", "repeated", "rows", "duplicates", "declared", "failed", "listings", "missing", F.round("ratio", 6).alias("ratio"), "status")
