"""Fair value by exact sales and aggregates, currency, offer ranking and arbitration between sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..registry import query
from ..sources.tables import LISTINGS_SQL, listings, sales, table, with_sales

#: Units of a currency per euro.
RATES = {"EUR": 1.0, "USD": 1.1, "JPY": 170.0, "CHF": 0.94}
CURRENCIES = ["EUR", "USD", "JPY", "CHF", "GBP"]
RATES_SQL = "rates as (select * from (values ('EUR', 1.0::double), ('USD', 1.1::double), ('JPY', 170.0::double), ('CHF', 0.94::double)) t(currency, per_eur))"
OFFERS_SQL = """offers as (select listing_id, identity, price, seller, minutes_to_end, ['EUR', 'USD', 'JPY', 'CHF', 'GBP'][listing_id % 5 + 1] as currency,
  case when listing_id % 4 = 0 then null else (listing_id % 4) / 100.0::double end as fee_rate, (listing_id % 3)::double as flat,
  case when listing_id % 3 = 0 then 'fixed' when minutes_to_end <= 5 then 'ending auction' else 'open auction' end as evidence from listings)"""


def rates(spark):
    return spark.createDataFrame(list(RATES.items()), "currency string, per_eur double")


def offers(spark, sf_dir):
    """Listings as offers: currency, fees (unknown for every fourth) and kind of evidence."""
    d = listings(spark, sf_dir)
    i = F.col("listing_id")
    kind = F.when(i % 3 == 0, "fixed").when(F.col("minutes_to_end") <= 5, "ending auction").otherwise("open auction")
    return d.select(
        "listing_id", "identity", "price", "seller", "minutes_to_end", F.element_at(F.array(*map(F.lit, CURRENCIES)), (i % 5 + 1).cast("int")).alias("currency"),
        F.when(i % 4 != 0, (i % 4) / 100.0).alias("fee_rate"), (i % 3).cast("double").alias("flat"), kind.alias("evidence"),
    )


def to_eur(amount: Column, per_eur: Column) -> Column:
    """Euros; null for an unknown or non-positive rate."""
    return F.when(per_eur > 0, amount / per_eur)


def all_in(price: Column, fee_rate: Column, flat: Column, per_eur: Column) -> Column:
    """Price with fees in euros; null if a fee or the rate is unknown."""
    return to_eur(price * (1 + fee_rate) + flat, per_eur)


@query("NUM-07", "NUM-08", "NUM-06", "NUM-12", "UDF-01", "UDF-02", sql=with_sales("""
select listing_id, currency, round(price / per_eur, 6) as eur, round((price * (1 + fee_rate) + flat) / per_eur, 6) as all_in from offers left join rates using (currency)""", LISTINGS_SQL, OFFERS_SQL, RATES_SQL))
def offers_in_eur(spark, sf_dir):
    rows = offers(spark, sf_dir).join(rates(spark), "currency", "left")
    return rows.select("listing_id", "currency", F.round(to_eur(F.col("price"), F.col("per_eur")), 6).alias("eur"), F.round(all_in(F.col("price"), F.col("fee_rate"), F.col("flat"), F.col("per_eur")), 6).alias("all_in"))


def rate_rows(documents: DataFrame, xml: str) -> DataFrame:
    """documents with rate_date, currency and per_eur: a row for each currency of a document of reference rates (elements with currency and rate below one with time).

    A document without a valid date, a currency without a rate above zero, or no document gives no row; the last rate of a currency counts.
    """
    tag = F.regexp_extract_all(xml, F.lit(r"(?s)<[^>]*\bcurrency\s*=[^>]*>"), F.lit(0))
    value = lambda e, name: F.trim(F.regexp_extract(e, rf"(?s)\b{name}\s*=\s*[\"']([^\"']*)[\"']", 1))
    day = F.try_to_date(F.regexp_extract(xml, r"\btime\s*=\s*[\"'](\d{4}-\d{2}-\d{2})[\"']", 1), "yyyy-MM-dd")
    keys = [c for c in documents.columns if c != xml]
    rows = documents.select(*keys, day.alias("rate_date"), F.posexplode(tag).alias("_at", "_e")).where("rate_date is not null")
    rows = rows.select(*keys, "rate_date", "_at", F.upper(value(F.col("_e"), "currency")).alias("currency"), value(F.col("_e"), "rate").try_cast("double").alias("per_eur")).where("currency <> '' and per_eur > 0")
    return rows.groupBy(*keys, "rate_date", "currency").agg(F.max_by("per_eur", "_at").alias("per_eur"))


def converted(amounts: DataFrame, rates: DataFrame) -> DataFrame:
    """amounts (amount, source, target) with rate and converted: over the euro, null where a rate is unknown; equal currencies need none. rates: currency, per_eur."""
    code = lambda c: F.upper(F.trim(c))
    side = lambda name: rates.where("per_eur > 0").select(F.col("currency").alias(f"_{name}"), F.col("per_eur").alias(f"_{name}_rate"))
    rows = amounts.join(side("source"), code(F.col("source")) == F.col("_source"), "left").join(side("target"), code(F.col("target")) == F.col("_target"), "left")
    of = lambda name: F.when(code(F.col(name)) == "EUR", 1.0).otherwise(F.col(f"_{name}_rate"))
    rate = F.when(code(F.col("source")) == code(F.col("target")), 1.0).otherwise(of("target") / of("source"))
    return rows.select(*amounts.columns, rate.alias("rate"), (F.col("amount") * rate).alias("converted"))


NATION_RATES_SQL = """n as (select n_nationkey as k, n_regionkey as region, 'C' || lpad(n_nationkey::varchar, 2, '0') as currency, (n_nationkey * 7 % 23) / 4.0::double as per_eur from nation), good as (select * from n where per_eur > 0 and k % 8 <> 5)"""


def rate_documents(spark, sf_dir) -> DataFrame:
    """A document of rates for each region, with the currencies of its nations; some rates are zero, one in eight is no number, and every currency stands there twice."""
    n, k = table(spark, sf_dir, "nation"), F.col("n_nationkey")
    code = F.concat(F.lit("c"), F.lpad(k.cast("string"), 2, "0"))
    element = lambda rate: F.concat(F.lit('<Cube currency="'), code, F.lit("\" rate='"), rate, F.lit("'/>"))
    rate = F.when(k % 8 == 5, "n/a").otherwise(((k * 7 % 23) / 4).cast("string"))
    old = F.when((k % 8 == 5) | (k * 7 % 23 == 0), "0").otherwise("99.5")
    body = F.array_join(F.sort_array(F.collect_list(F.struct(k, F.concat(element(old), element(rate)).alias("e"))))["e"], "\n")  # a region's nations
    return n.groupBy(F.col("n_regionkey").alias("region")).agg(F.concat(F.lit("<Envelope><Cube><Cube time='2026-08-0"), (F.col("region") + 1).cast("string"), F.lit("'>"), body, F.lit("</Cube></Cube></Envelope>")).alias("xml"))


@query("SRC-22", sql=f"with {NATION_RATES_SQL} select region, '2026-08-0' || (region + 1) as rate_date, currency, per_eur from good")
def reference_rates(spark, sf_dir):
    return rate_rows(rate_documents(spark, sf_dir), "xml").select("region", F.col("rate_date").cast("string").alias("rate_date"), "currency", "per_eur")


@query("NUM-10", "NUM-11", sql=f"""
with {NATION_RATES_SQL}, a as (select s_suppkey, s_acctbal as amount, 'C' || lpad(s_nationkey::varchar, 2, '0') as s, case s_suppkey % 4 when 0 then 'EUR' when 1 then 'C03' when 2 then 'C' || lpad(s_nationkey::varchar, 2, '0') else 'XXX' end as t from supplier),
j as (select a.*, case when s = t then 1 when t = 'EUR' then 1 / x.per_eur else y.per_eur / x.per_eur end as rate from a left join good x on x.currency = s left join good y on y.currency = t)
select s_suppkey, round(rate, 8) as rate, round(amount * rate, 6) as converted from j""")
def converted_balances(spark, sf_dir):
    """Balances of suppliers from their nation's currency into the euro, another currency, the same one, and one without a rate."""
    code = F.concat(F.lit("c"), F.lpad(F.col("s_nationkey").cast("string"), 2, "0"))
    target = F.element_at(F.array(F.lit(" eur"), F.lit("C03"), F.upper(code), F.lit("XXX")), (F.col("s_suppkey") % 4 + 1).cast("int"))
    amounts = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").alias("amount"), code.alias("source"), target.alias("target"))
    rows = converted(amounts, rate_rows(rate_documents(spark, sf_dir), "xml").select("currency", "per_eur"))
    return rows.select("s_suppkey", F.round("rate", 8).alias("rate"), F.round("converted", 6).alias("converted"))


FAIR = """
ex as (select part_id as identity, age, price, source, case when order_id % 7 = 0 then 2.5::double when order_id % 5 > 0 then 0.9::double + (order_id % 4) / 10.0::double end as factor,
         row_number() over (partition by part_id order by age, price desc, source, order_id) as k from sales where age >= 0 and age <= 365 and price > 0),
ag0 as (select listing_id as identity, 'a' as source, 'x' as family, listing_id % 45 as agg_age, listing_id % 7 as n, price as central, case when listing_id % 3 > 0 then price * 0.9::double end as lo, case when listing_id % 4 > 0 then price * 1.1::double end as hi from listings
  union all select listing_id, 'b', case when listing_id % 2 = 0 then 'x' else 'y' end, (listing_id * 2) % 45, (listing_id + 3) % 7, price * 1.05::double, null, null from listings),
ag as (select * from (select *, row_number() over (partition by identity order by agg_age, n desc, source) as r from ag0 where n > 0 and agg_age <= 30) where r = 1),
top as (select identity, count(*) filter (age <= 90) as n90, median(price) filter (age <= 90) as recent, min(price) filter (age <= 90) as lo90, max(price) filter (age <= 90) as hi90,
          count(*) filter (factor between 0.5 and 2) as nf, median(price * factor) filter (factor between 0.5 and 2) as late, min(price * factor) filter (factor between 0.5 and 2) as lof, max(price * factor) filter (factor between 0.5 and 2) as hif
        from ex where k <= 10 group by identity),
fv as (select coalesce(t.identity, ag.identity) as identity, coalesce(n90, 0) as n90, recent, lo90, hi90, coalesce(nf, 0) as nf, late, lof, hif, ag.n, ag.n // 2 as agg90, central, coalesce(lo, central) as lo, coalesce(hi, central) as hi from top t full join ag on t.identity = ag.identity),
how as (select *, case when n90 >= 2 then 'recent sales' when n90 = 1 and n >= 3 and greatest(recent, central) / least(recent, central) <= 1.25 then 'sale and aggregate'
    when central is not null then 'aggregate' when nf >= 3 then 'adjusted older sales' end as method from fv),
fair as (select identity, method, case method when 'recent sales' then recent when 'sale and aggregate' then (recent + central) / 2 when 'aggregate' then central when 'adjusted older sales' then late end as value,
  case method when 'recent sales' then lo90 when 'sale and aggregate' then least(recent, lo) when 'aggregate' then least(lo, central) when 'adjusted older sales' then lof end as low,
  case method when 'recent sales' then hi90 when 'sale and aggregate' then greatest(recent, hi) when 'aggregate' then greatest(hi, central) when 'adjusted older sales' then hif end as high,
  case method when 'recent sales' then n90 when 'sale and aggregate' then 1 + n when 'aggregate' then n when 'adjusted older sales' then nf end as evidence,
  case method when 'recent sales' then n90 when 'sale and aggregate' then 1 + greatest(agg90, least(n, 1)) when 'aggregate' then agg90 when 'adjusted older sales' then 0 end as recent,
  case method when 'aggregate' then case when n >= 3 then 'strong' else 'weak' end when 'adjusted older sales' then 'moderate' when 'recent sales' then 'strong' when 'sale and aggregate' then 'strong' end as quality,
  method <> 'aggregate' or n >= 3 as safe from how where method is not null)"""


def aggregates(spark, sf_dir):
    """Two provider aggregates of each listing, of one correlated family for every second: source, age, sales, central and, where known, range."""
    p = listings(spark, sf_dir)
    i, price, none = F.col("listing_id"), F.col("price"), F.lit(None).cast("double")
    first = p.select(i.alias("identity"), F.lit("a").alias("source"), F.lit("x").alias("family"), (i % 45).alias("agg_age"), (i % 7).alias("n"), price.alias("central"), F.when(i % 3 > 0, price * 0.9).alias("lo"), F.when(i % 4 > 0, price * 1.1).alias("hi"))
    second = p.select(i.alias("identity"), F.lit("b").alias("source"), F.when(i % 2 == 0, "x").otherwise("y").alias("family"), (i * 2 % 45).alias("agg_age"), ((i + 3) % 7).alias("n"), (price * 1.05).alias("central"), none.alias("lo"), none.alias("hi"))
    return first.unionByName(second).withColumn("agg90", F.floor(F.col("n") / 2))


def best_aggregate(rows: DataFrame, within: float = 30.0) -> DataFrame:
    """The aggregate to trust of each identity: newest, then with most sales. One of each correlated family speaks for it,
    and the newest of all is the newest of its family, so one ranking serves both."""
    good = rows.where((F.col("n") > 0) & (F.col("agg_age") <= within) & (F.least("central", F.coalesce("lo", "central"), F.coalesce("hi", "central")) > 0))
    order = Window.partitionBy("identity").orderBy("agg_age", F.col("n").desc(), "source")
    return good.withColumn("k", F.row_number().over(order)).where("k = 1").drop("k")


def fair_values_of(sold: DataFrame, known: DataFrame, recent: float = 90, history: float = 365, most: int = 10) -> DataFrame:
    """Fair value of each identity from exact sales (identity, age, price, source, order_id, factor) and provider aggregates.

    The newest `most` sales decide, so an identity's rows are cut to these before they meet: two recent sales give
    their median; one that agrees with an aggregate of three sales within a quarter is averaged with it; else an
    aggregate stands alone; else three sales with a proven time factor in [0.5, 2]. No evidence, no row.
    """
    order = Window.partitionBy("identity").orderBy("age", F.col("price").desc(), "source", "order_id")
    newest = sold.where((F.col("age") >= 0) & (F.col("age") <= history) & (F.col("price") > 0)).withColumn("k", F.row_number().over(order)).where(F.col("k") <= most)
    now, old = F.col("age") <= recent, F.col("factor").between(0.5, 2)
    price, moved = F.when(now, F.col("price")), F.when(old, F.col("price") * F.col("factor"))
    top = newest.groupBy("identity").agg(
        F.count_if(now).alias("n90"), F.median(price).alias("sold"), F.min(price).alias("lo90"), F.max(price).alias("hi90"),
        F.count_if(old).alias("nf"), F.median(moved).alias("late"), F.min(moved).alias("lof"), F.max(moved).alias("hif"),
    )
    rows = top.join(best_aggregate(known).drop("source"), "identity", "full_outer").fillna(0, ["n90", "nf"])
    c = F.col
    rows = rows.withColumns({"lo": F.coalesce("lo", "central"), "hi": F.coalesce("hi", "central")})
    paired = (c("n90") == 1) & (c("n") >= 3) & (F.greatest("sold", "central") / F.least("sold", "central") <= 1.25)
    method = F.when(c("n90") >= 2, "recent sales").when(paired, "sale and aggregate").when(c("central").isNotNull(), "aggregate").when(c("nf") >= 3, "adjusted older sales")
    rows = rows.withColumn("method", method).where("method is not null")

    def by(sales, pair, aggregate, older):
        m = c("method")
        return F.when(m == "recent sales", sales).when(m == "sale and aggregate", pair).when(m == "aggregate", aggregate).otherwise(older)

    return rows.select(
        "identity", "method", by(c("sold"), (c("sold") + c("central")) / 2, c("central"), c("late")).alias("value"),
        by(c("lo90"), F.least("sold", "lo"), F.least("lo", "central"), c("lof")).alias("low"), by(c("hi90"), F.greatest("sold", "hi"), F.greatest("hi", "central"), c("hif")).alias("high"),
        by(c("n90"), 1 + c("n"), c("n"), c("nf")).cast("long").alias("evidence"), by(c("n90"), 1 + F.greatest(c("agg90"), F.least(c("n"), F.lit(1))), c("agg90"), F.lit(0)).cast("long").alias("recent"),
        by(F.lit("strong"), F.lit("strong"), F.when(c("n") >= 3, "strong").otherwise("weak"), F.lit("moderate")).alias("quality"), ((c("method") != "aggregate") | (c("n") >= 3)).alias("safe"),
    )


def fair_values(spark, sf_dir):
    o = F.col("order_id")
    factor = F.when(o % 7 == 0, 2.5).when(o % 5 > 0, 0.9 + (o % 4) / 10.0)
    sold = sales(spark, sf_dir).select(F.col("part_id").alias("identity"), "age", "price", "source", "order_id", factor.alias("factor"))
    return fair_values_of(sold, aggregates(spark, sf_dir))


@query("AGG-38", "JOI-07", "DAT-13", "FLT-08", "FLT-10", sql=with_sales("""
select identity, method, round(value + 1e-9, 4) as value, round(low + 1e-9, 4) as low, round(high + 1e-9, 4) as high, evidence::bigint as evidence, recent::bigint as recent, quality, safe from fair""", LISTINGS_SQL, FAIR))
def fair_value(spark, sf_dir):
    near = lambda x: F.round(F.col(x) + 1e-9, 4).alias(x)
    return fair_values(spark, sf_dir).select("identity", "method", near("value"), near("low"), near("high"), "evidence", "recent", "quality", "safe")


@query("AGG-37", sql=with_sales("\nselect identity, source, family, round(central + 1e-9, 4) as central, n, agg_age as age from ag", LISTINGS_SQL, FAIR))
def best_aggregates(spark, sf_dir):
    return best_aggregate(aggregates(spark, sf_dir)).select("identity", "source", "family", F.round(F.col("central") + 1e-9, 4).alias("central"), "n", F.col("agg_age").alias("age"))


@query("WIN-01", "JOI-08", "FLT-09", "TOP-09", "TOP-14", sql=with_sales("""
select identity, listing_id, rank, round((all_in / first_value(all_in) over (partition by identity order by rank) - 1) * 100 + 1e-9, 4) as gap, round((value - all_in) / value * 100 + 1e-9, 4) as discount, safe and (value - all_in) / value * 100 + 1e-9 >= 30 as notify
from (select o.identity, o.listing_id, all_in, value, safe, row_number() over (partition by o.identity order by all_in, seller, listing_id) as rank
      from (select * replace ((listing_id // 3)::bigint as identity), (price * (1 + fee_rate) + flat) / per_eur as all_in from offers join rates using (currency)) o join fair f on o.identity = f.identity
      where evidence in ('fixed', 'ending auction') and all_in is not null and value > 0)""", LISTINGS_SQL, FAIR.replace(" as evidence", " as evidence_count"), OFFERS_SQL, RATES_SQL))
def ranked_offers(spark, sf_dir):
    """Offers of an identity (three listings each) by price with fees, against its fair value."""
    o = offers(spark, sf_dir).withColumn("identity", F.floor(F.col("listing_id") / 3))
    o = o.join(rates(spark), "currency").withColumn("all_in", all_in(F.col("price"), F.col("fee_rate"), F.col("flat"), F.col("per_eur")))
    fair = fair_values(spark, sf_dir).where("value > 0").select("identity", "value", "safe")
    rows = o.where("evidence in ('fixed', 'ending auction') and all_in is not null").join(fair, "identity")
    order = Window.partitionBy("identity").orderBy("all_in", "seller", "listing_id")
    discount = (F.col("value") - F.col("all_in")) / F.col("value") * 100
    gap = (F.col("all_in") / F.first("all_in").over(order) - 1) * 100
    return rows.select("identity", "listing_id", F.row_number().over(order).cast("long").alias("rank"), F.round(gap + 1e-9, 4).alias("gap"), F.round(discount + 1e-9, 4).alias("discount"), (F.col("safe") & (discount + 1e-9 >= 30)).alias("notify"))


@query("NUM-16", "NUM-17", "NUM-18", "NUM-19", "NUM-20", sql=with_sales("""
select part_id, case when f is null then 'pending' when nf < 3 then 'home only' when no < 3 then case when x.f > 0 then 'rescue' else 'home only' end when agree then 'confirmed' else 'conflict' end as path,
  round(case when nf >= 3 and no >= 3 and agree then least(o, f) end, 6) as combined
from (select *, least(hf, ho) >= greatest(lf, lo) and f / o between 0.80 and 1.25 as agree from s) x""", """
s as (select part_id, count(*) filter (source = 'O') as no, count(*) filter (source = 'F') as nf, median(price) filter (source = 'O') as o, median(price) filter (source = 'F') as f,
   quantile_cont(price, 0.25) filter (source = 'O') as lo, quantile_cont(price, 0.75) filter (source = 'O') as ho, quantile_cont(price, 0.25) filter (source = 'F') as lf, quantile_cont(price, 0.75) filter (source = 'F') as hf from sales group by part_id)"""))
def arbitration(spark, sf_dir):
    def q(source, at):
        return F.percentile(F.when(F.col("source") == source, F.col("price")), at)

    g = sales(spark, sf_dir).groupBy("part_id").agg(
        F.count_if(F.col("source") == "O").alias("no"), F.count_if(F.col("source") == "F").alias("nf"), q("O", 0.5).alias("o"), q("F", 0.5).alias("f"),
        q("O", 0.25).alias("lo"), q("O", 0.75).alias("ho"), q("F", 0.25).alias("lf"), q("F", 0.75).alias("hf"),
    )
    agree = (F.least("hf", "ho") >= F.greatest("lf", "lo")) & (F.col("f") / F.col("o")).between(0.80, 1.25)
    path = F.when(F.col("f").isNull(), "pending").when(F.col("nf") < 3, "home only").when(F.col("no") < 3, F.when(F.col("f") > 0, "rescue").otherwise("home only")).when(agree, "confirmed").otherwise("conflict")
    return g.select("part_id", path.alias("path"), F.round(F.when((F.col("nf") >= 3) & (F.col("no") >= 3) & agree, F.least("o", "f")), 6).alias("combined"))


@query("NUM-21", "UDF-09", sql="""
select event_id, case when gap <= 3 then 1 when gap <= 6 then 2 when gap <= 10 then 3 when gap <= 15 then 6 else 24 end as ttl_hours,
  case when age_h < case when gap <= 3 then 1 when gap <= 6 then 2 when gap <= 10 then 3 when gap <= 15 then 6 else 24 end then 'hit' else 'stale' end as cache
from (select event_id, abs(value - 30) as gap, date_diff('second', ts, timestamp '2024-01-31') / 3600.0::double as age_h from events)""")
def cache_states(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    gap = F.abs(F.col("value") - 30)
    ttl = F.when(gap <= 3, 1).when(gap <= 6, 2).when(gap <= 10, 3).when(gap <= 15, 6).otherwise(24)
    age = (F.unix_timestamp(F.lit("2024-01-31").cast("timestamp")) - F.unix_timestamp("ts")) / F.lit(3600.0)
    return e.select("event_id", ttl.alias("ttl_hours"), F.when(age < ttl, "hit").otherwise("stale").alias("cache"))
