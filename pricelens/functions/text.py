"""Text and identity columns: normal forms, keys, parsing by pattern."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..registry import query
from ..sources.tables import table

#: Letters with marks of the driver's texts and what they become, in order (for the SQL alone).
MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿšž"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyysz"


@cache
def decomposed() -> tuple[str, str, dict[str, str]]:
    """Characters that compatibility decomposition turns into one ASCII character, those, and the ones that become several."""
    one, many = {}, {}
    for i in range(0x80, sys.maxunicode + 1):
        c = chr(i)
        if 0xD800 <= i < 0xE000 or unicodedata.decomposition(c) == "":
            continue
        left = unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode()
        if len(left) == 1:
            one[c] = left
        elif left:
            many[c] = left
    return "".join(one), "".join(one.values()), many


def let(value: Column, f) -> Column:
    """f of a value that is computed once, wherever f uses it often (nothing is shared within a lambda)."""
    return F.transform(F.array(value), f)[0]


def undecorated(text: Column) -> Column:
    """ASCII: what compatibility decomposition leaves of each character, nothing of those without a decomposition."""
    marked, bare, many = decomposed()
    becomes = F.create_map(*[F.lit(x) for kv in many.items() for x in kv])
    several = F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(F.try_element_at(becomes, c), c)), "")
    foreign = F.regexp_replace(text, r"[\x00-\x7F]+", "")
    rare = F.length(F.translate(foreign, "".join(many), "")) < F.length(foreign)  # a look-up a character, and only of those beyond ASCII
    return F.regexp_replace(F.translate(F.when(rare, several).otherwise(text), marked, bare), r"[^\x00-\x7F]+", "")


def plain(text: Column) -> Column:
    """undecorated() in lower case."""
    return F.lower(undecorated(text))


def normal(text: Column) -> Column:
    """plain() with everything but letters and digits as single spaces, trimmed."""
    return F.trim(F.regexp_replace(plain(text), "[^a-z0-9]+", " "))


def card_number(text: Column) -> Column:
    """Number without # and spaces, upper case, no leading zeros on either side of a slash."""
    bare = F.upper(F.regexp_replace(text, r"[#\s]", ""))
    return F.array_join(F.transform(F.split(bare, "/"), lambda p: F.when(p.rlike("^0+[0-9]"), F.regexp_replace(p, "^0+(?=[0-9])", "")).otherwise(p)), "/")


def alias(text: Column, table: dict[str, list[str]], otherwise: Column | None = None) -> Column:
    """The entry whose list has the text."""
    whens = reduce(lambda c, kv: c.when(text.isin(kv[1]), kv[0]), table.items(), F)
    return whens.otherwise(F.lit(None) if otherwise is None else otherwise)


#: Language aliases.
LANGUAGES = {"en": ["en", "english", "anglais"], "fr": ["fr", "french", "francais"], "de": ["de", "german"], "es": ["es", "spanish"], "ja": ["ja", "jp", "japanese"]}


def grade_text(grade: Column) -> Column:
    return F.when(grade == F.floor(grade), F.floor(grade).cast("string")).otherwise(grade.cast("string"))


def key_of(*parts: Column) -> Column:
    """Parts joined by bars; null if any is empty."""
    full = reduce(lambda a, b: a & b, [F.length(F.trim(F.coalesce(p, F.lit("")))) > 0 for p in parts])
    return F.when(full, F.concat_ws("|", *parts))


@query("STR-01", "STR-02", "STR-03", "STR-04", "STR-46", sql=rf"""
select doc_id, len(n) as length, sha256(n) as digest from (select doc_id, trim(regexp_replace(lower(regexp_replace(translate(lower(text), '{MARKED}', '{PLAIN}'), '[^\x00-\x7F]', '', 'g')), '[^a-z0-9]+', ' ', 'g')) as n from documents where text is not null)""")
def normal_texts(spark, sf_dir):
    """The normal forms of whole texts, by length and digest."""
    rows = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", normal(F.col("text")).alias("n"))
    return rows.select("doc_id", F.length("n").cast("long").alias("length"), F.sha2("n", 256).alias("digest"))


@query("STR-05", "STR-25", "STR-26", "STR-42", "STR-49", sql="""
select p_partkey, case when p_partkey % 9 = 0 then p_size::varchar || '/' || p_partkey::varchar else (p_size::varchar || '/' || p_partkey::varchar) end as number, p_size = p_partkey % 60 as same from part""")
def card_numbers(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    raw = F.concat(F.lit("# 0"), F.col("p_size"), F.lit(" /00"), F.col("p_partkey"))
    number = card_number(raw)
    return p.select("p_partkey", number.alias("number"), (F.split(number, "/")[0] == (F.col("p_partkey") % 60).cast("string")).alias("same"))


@query("STR-07", "STR-08", "STR-09", "STR-50", sql="""
select distinct l_linenumber as n, case when l_linenumber % 3 = 0 then null else (case when l_linenumber % 2 = 0 then (l_linenumber // 2)::varchar else (l_linenumber // 2)::varchar || '.5' end) || '|' || l_returnflag end as key,
  l_returnflag || '_' || case when l_linenumber % 2 = 0 then (l_linenumber // 2)::varchar else (l_linenumber // 2)::varchar || '_5' end as tier from lineitem""")
def strict_keys(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select("l_linenumber", "l_returnflag").distinct()
    grade = F.col("l_linenumber") / 2
    shown = F.when(F.col("l_linenumber") % 3 != 0, grade_text(grade))
    return line.select(F.col("l_linenumber").alias("n"), key_of(shown, F.col("l_returnflag")).alias("key"), F.concat("l_returnflag", F.lit("_"), F.replace(grade_text(grade), F.lit("."), F.lit("_"))).alias("tier"))


@query("STR-10", "STR-11", "STR-12", sql="""
select p_partkey, sha256(p_brand || '|' || p_name || '|' || p_size::varchar || '|' || p_type) as identity from part""")
def identity_hashes(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", F.sha2(key_of(F.col("p_brand"), F.col("p_name"), F.col("p_size").cast("string"), F.col("p_type")), 256).alias("identity"))


@query("STR-20", sql=r"""
select event_id, regexp_extract(t, '#([0-9]+)', 1) as number, regexp_extract(t, '(PSX|BGX|CGX)', 1) as grader, try_cast(regexp_extract(t, '(?:PSX|BGX|CGX) ([0-9]+(?:\.[0-9])?)', 1) as double) as grade, regexp_extract(t, '((?:19|20)[0-9]{2})', 1) as year
from (select event_id, 'Card #' || user_id || ' ' || (1990 + user_id % 30) || ' ' || ['PSX', 'BGX', 'CGX'][user_id % 3 + 1] || ' ' || (event_id % 11) || case when event_id % 2 = 0 then '.5' else '' end as t from events)""")
def parsed_titles(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    grader = F.element_at(F.array(F.lit("PSX"), F.lit("BGX"), F.lit("CGX")), (F.col("user_id") % 3 + 1).cast("int"))
    t = F.concat(F.lit("Card #"), "user_id", F.lit(" "), (1990 + F.col("user_id") % 30).cast("string"), F.lit(" "), grader, F.lit(" "), (F.col("event_id") % 11).cast("string"), F.when(F.col("event_id") % 2 == 0, ".5").otherwise(""))
    grade = F.regexp_extract(t, r"(?:PSX|BGX|CGX) ([0-9]+(?:\.[0-9])?)", 1)
    return e.select("event_id", F.regexp_extract(t, "#([0-9]+)", 1).alias("number"), F.regexp_extract(t, "(PSX|BGX|CGX)", 1).alias("grader"), grade.try_cast("double").alias("grade"), F.regexp_extract(t, "((?:19|20)[0-9]{2})", 1).alias("year"))


@query(sql=r"""
select doc_id, len(n) as numbers, case when len(list_distinct(n)) = 1 then n[1] end as only_one from (select doc_id, regexp_extract_all(text, '[0-9]+') as n from documents where text is not null)""")
def numbers_in_texts(spark, sf_dir):
    n = F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0))
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", n.alias("n"))
    return d.select("doc_id", F.size("n").cast("long").alias("numbers"), F.when(F.size(F.array_distinct("n")) == 1, F.col("n")[0]).alias("only_one"))


@query(sql="""
select a, b, score from (select x.p_partkey as a, y.p_partkey as b, 100 * len(list_intersect(string_split(x.p_name, ' '), string_split(y.p_name, ' '))) // greatest(len(list_distinct(string_split(x.p_name, ' '))), 1) as score
  from part x join part y on x.p_brand = y.p_brand and x.p_type = y.p_type and x.p_partkey < y.p_partkey and x.p_size = y.p_size)""")
def token_overlap(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    x = p.select(F.col("p_partkey").alias("a"), F.split("p_name", " ").alias("s"), "p_brand", "p_type", "p_size")
    y = p.select(F.col("p_partkey").alias("b"), F.split("p_name", " ").alias("t"), "p_brand", "p_type", "p_size")
    rows = x.join(y, ["p_brand", "p_type", "p_size"]).where("a < b")
    return rows.select("a", "b", F.expr("cast(100 * size(array_intersect(s, t)) as bigint) div greatest(size(array_distinct(s)), 1)").alias("score"))


#: Words that tell dimensions of an item.
DIMENSIONS = {"color": "(red|blue|green|hot|cold)", "kind": "(ring|widget|bolt|gear|gizmo)", "size": "(small|large|big)"}


@query(sql="""
select p_partkey, nullif(regexp_extract(p_name, '(red|blue|green|hot|cold)', 1), '') as color, nullif(regexp_extract(p_name, '(ring|widget|bolt|gear|gizmo)', 1), '') as kind, nullif(regexp_extract(p_name, '(small|large|big)', 1), '') as size,
  (case when regexp_matches(p_name, '(red|blue|green|hot|cold)') then 0 else 1 end + case when regexp_matches(p_name, '(ring|widget|bolt|gear|gizmo)') then 0 else 1 end + case when regexp_matches(p_name, '(small|large|big)') then 0 else 1 end)::int as unknown from part""")
def item_dimensions(spark, sf_dir):
    found = F.map_filter(F.create_map(*[x for k, v in DIMENSIONS.items() for x in (F.lit(k), F.regexp_extract("p_name", v, 1))]), lambda k, v: v != "")
    d = table(spark, sf_dir, "part").select("p_partkey", found.alias("d"))
    unknown = F.size(F.filter(F.array(*[F.lit(k) for k in DIMENSIONS]), lambda k: ~F.map_contains_key("d", k)))
    return d.select("p_partkey", *[F.col("d")[k].alias(k) for k in DIMENSIONS], unknown.alias("unknown"))


@query("STR-39", sql="""
select p_partkey, case when flags = 1 then 'proven' when flags = 0 then 'none' else 'ambiguous' end as variant from (select p_partkey, (p_size % 2 = 0)::int + (p_size % 3 = 0)::int + (p_size % 5 = 0)::int as flags from part)""")
def proven_variants(spark, sf_dir):
    flags = F.create_map(F.lit("normal"), F.col("p_size") % 2 == 0, F.lit("reverse"), F.col("p_size") % 3 == 0, F.lit("holo"), F.col("p_size") % 5 == 0)
    n = F.size(F.map_filter(flags, lambda k, v: v))
    return table(spark, sf_dir, "part").select("p_partkey", F.when(n == 1, "proven").when(n == 0, "none").otherwise("ambiguous").alias("variant"))


@query("STR-48", "JOI-29", sql="""
select a.p_partkey as a, b.p_partkey as b from part a join part b on a.p_brand = b.p_brand and a.p_size = b.p_size and a.p_partkey <> b.p_partkey and (a.p_name = b.p_name or b.p_name = a.p_name || ' ex' or string_split(a.p_name, ' ')[1] = b.p_name)""")
def equivalent_names(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    x = p.select(F.col("p_partkey").alias("a"), F.split("p_name", " ").alias("s"), "p_brand", "p_size")
    y = p.select(F.col("p_partkey").alias("b"), F.split("p_name", " ").alias("t"), "p_brand", "p_size")
    same = (F.col("s") == F.col("t")) | (F.col("t") == F.concat("s", F.array(F.lit("ex")))) | (F.slice("s", 1, 1) == F.col("t"))
    return x.join(y, ["p_brand", "p_size"]).where((F.col("a") != F.col("b")) & same).select("a", "b")


@query(sql="select p_partkey, unnest(range(greatest(p_size - 2, 1), p_size + 1))::int as candidate from part")
def coordinate_candidates(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", F.explode(F.sequence(F.greatest(F.col("p_size") - 2, F.lit(1)), "p_size")).alias("candidate"))


@query("STR-54", sql="select o_orderkey, case when o_custkey % 4 = 0 then 'unknown' when o_custkey % 10 = o_orderkey % 10 then 'equal' when o_custkey % 10 > o_orderkey % 10 then 'certified higher' else 'certified lower' end as mismatch from orders")
def grade_mismatches(spark, sf_dir):
    declared, proven = F.col("o_orderkey") % 10, F.when(F.col("o_custkey") % 4 != 0, F.col("o_custkey") % 10)
    label = F.when(proven.isNull(), "unknown").when(proven == declared, "equal").when(proven > declared, "certified higher").otherwise("certified lower")
    return table(spark, sf_dir, "orders").select("o_orderkey", label.alias("mismatch"))


@query("STR-55", sql=r"""
select page_id, len(list_filter(string_split(regexp_replace(regexp_replace(html, '<[^>]+>', chr(10), 'g'), '[ \t\r]+', ' ', 'g'), chr(10)), lambda x: trim(x) <> '')) as lines from pages""")
def html_lines(spark, sf_dir):
    lines = F.split(F.regexp_replace(F.regexp_replace("html", "<[^>]+>", "\n"), r"[ \t\r]+", " "), "\n")
    return table(spark, sf_dir, "pages").select("page_id", F.size(F.filter(lines, lambda x: F.trim(x) != "")).cast("long").alias("lines"))


@query("SRC-04", sql=r"""
select page_id, len(l) as links, len(list_distinct(l)) as different, regexp_matches(html, 'class="ad"') and not regexp_matches(html, 'nofollow') as valid from (select page_id, html, regexp_extract_all(html, 'href="([^"]+)"', 1) as l from pages)""")
def page_links(spark, sf_dir):
    links = F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.size(links).cast("long").alias("links"), F.size(F.array_distinct(links)).cast("long").alias("different"), (F.col("html").rlike('class="ad"') & ~F.col("html").rlike("nofollow")).alias("valid"))


@query("WIN-14", sql=r"select page_id, regexp_extract(url, '^https?://([^/]+)/', 1) as host, regexp_extract(url, '/([a-z]{2})/', 1) as lang, regexp_extract(url, 'page=([0-9]+)', 1) as page from pages")
def url_keys(spark, sf_dir):
    u = lambda p: F.regexp_extract("url", p, 1)
    return table(spark, sf_dir, "pages").select("page_id", u("^https?://([^/]+)/").alias("host"), u("/([a-z]{2})/").alias("lang"), u("page=([0-9]+)").alias("page"))
