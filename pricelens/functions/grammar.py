"""What whole titles say: a card's identity, the coordinate that a fixed form of title gives, and the readings that a loose form allows.

A title is cut at what is certain - language, grade, collector number - and what is left over is kept and divided in every way
that the grammar allows, in a fixed order and up to a bound. Nothing is guessed: without the certain parts there is no reading.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..registry import query
from ..sources.tables import spread, table
from .history import every
from .parsing import HOUSES, found
from .text import MARKED, PLAIN

#: The words and forms of titles.
GRADE = r"(10(?:\.0)?|9(?:\.0)?|8\.5|8(?:\.0)?)"
PSA = rf"(?iU)\bPSA\s*(?:GEM\s*MT\s*)?{GRADE}\b"
STRICT = rf"(?iU)^\s*(\d{{4}})\s+Pok[eé]mon\s+(Japanese|English)\s+(.+?)\s+#0*([A-Za-z0-9-]+)\s+PSA\s*(?:GEM\s*MT\s*)?{GRADE}\b"
SHELL = rf"(?iU)^\s*(?:(?:Pok[eé]mon)\s+(\d{{4}})|(\d{{4}})\s+(?:Pok[eé]mon))\s+(Japanese|English)\s+(.+?)\s+PSA\s*(?:GEM\s*MT\s*)?{GRADE}\b"
RARITY = (
    r"(?iU)\b(?:SPECIAL\s+ILLUSTRATION\s+RARE|ILLUSTRATION\s+RARE|HYPER\s+RARE|ULTRA\s+RARE|DOUBLE\s+RARE|ACE\s+SPEC\s+RARE|HOLO\s+RARE|REVERSE\s+HOLO|"
    r"SAR|CSR|CHR|SSR|RRR|AR|SR|UR|HR|RR|PROMO|HOLO|REVERSE)\b"
)
SET_CODE = r"(?i)^(?:SV|SWSH|SM|XY|BW|HGSS|DP)[A-Z0-9-]*\s+"
ERA = r"(?i)^(?:Scarlet\s*&\s*Violet|Sword\s*&\s*Shield|Sun\s*&\s*Moon|Black\s*&\s*White|Diamond\s*&\s*Pearl|Platinum|XY)\s+"
MARKER = r"(?i)(?<![A-Za-z0-9])#0*([A-Za-z0-9-]+)(?![A-Za-z0-9-])"
POKEMON, LANGUAGE, YEAR = r"(?iU)\bPok[eé]mon\b", r"(?iU)\b(Japanese|English|JPN|ENG)\b", r"(?U)\b((?:19|20)\d{2})\b"
FRACTION = r"(?i)(?<![A-Za-z0-9])([A-Za-z0-9-]+)\s*/\s*([A-Za-z0-9-]+)(?![A-Za-z0-9])"
NUMBERS = [r"(?<![A-Za-z0-9])#0*(\d{1,4})(?![A-Za-z0-9])", r"(?iU)\bNo\.?\s*0*(\d{1,4})\b", r"(?<![A-Za-z0-9])0*(\d{1,4})\s*$"]
DESCRIPTOR = r"(?i)^(?:FA|SAR|AR|SR|UR|HR|RRR|RR|CHR|CSR|SSR|HOLO|REVERSE)\s*[/|:-]\s*"
DESCRIPTOR_LAST = r"(?i)(?:^|\s[-|:]\s*)(?:FA|SAR|AR|SR|UR|HR|RRR|RR|CHR|CSR|SSR|HOLO|REVERSE)\s*$"
FINISH_LAST = r"(?i)\s+(?:MASTER\s*BALL|MASTERBALL|POK[EÉ]\s*BALL|POKEBALL|REVERSE\s+HOLO|REVERSE|HOLO)\s*$"
REFERENCES = [
    r"(?iU)(?:Réf[ée]rence|Reference|Num[ée]ro|Number)\s*:?\s*#?\s*([A-Z0-9-]{1,10}(?:/[A-Z0-9-]{1,10})?)", r"(?i)#\s*([A-Z0-9-]{1,10}(?:/[A-Z0-9-]{1,10})?)", r"(?iU)\b([A-Z0-9-]{1,10}/[A-Z0-9-]{1,10})\b",
]
SERIES = [r"(?iu)(?:Série|Serie|Set|Extension)\s*:?\s*([^\n\r]{2,80})", r"(?i)Collection\s*:?\s*([^\n\r]{2,80})"]
NEXT_FIELD = r"(?iu)\s{2,}|(?:Langue|Language|Année|Year|Référence|Reference|Grade|Gradation|Catégorie|Category)\s*:?"
SPOKEN = {"French": "French|Français|Francais", "Japanese": "Japanese|Japonais", "English": "English|Anglais", "German": "German|Allemand", "Spanish": "Spanish|Espagnol", "Italian": "Italian|Italien"}

READING = "struct<set:string,name:string,local_id:string>"


def strip(text: Column, characters: str = " -|:") -> Column:
    return F.regexp_replace(text, f"^[{characters}]+|[{characters}]+$".replace("-", "\\-"), "")


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def local_number(text: Column) -> Column:
    """A collector number in upper case, a whole number without leading zeros."""
    up = F.upper(text)
    return F.when(up.rlike("^[0-9]+$"), F.regexp_replace(up, "^0+(?=[0-9])", "")).otherwise(up)


def shown_grade(raw: Column) -> Column:
    return F.regexp_replace(raw, r"\.0$", "")


def dimensions(title: Column, balls: bool = False) -> dict[str, Column]:
    """Edition, finish and variant that a title names; empty without one."""
    has = lambda p: title.rlike("(?iU)" + p)
    finish = F.when(has(r"\bREVERSE\s+HOLO(?:FOIL)?\b"), "Reverse Holo").when(has(r"\bNON[-\s]?HOLO\b"), "Non-Holo").when(has(r"\bHOLO(?:FOIL)?\b"), "Holo").otherwise("")
    if balls:
        finish = F.when(has(r"\bMASTER\s*BALL\b|\bMASTERBALL\b"), "Master Ball").when(has(r"\bPOK[EÉ]\s*BALL\b|\bPOKEBALL\b"), "Poke Ball").otherwise(finish)
    return {
        "edition": F.when(has(r"\b1ST\s+EDITION\b|\bFIRST\s+EDITION\b"), "First Edition").when(has(r"\bUNLIMITED\b"), "Unlimited").otherwise(""),
        "finish": finish, "variant": F.when(has(r"\bSHADOWLESS\b"), "Shadowless").otherwise(""),
    }


def clean_set(text: Column) -> Column:
    """A set's name without its code, its era and the game's name."""
    out = strip(text)
    for p in (SET_CODE, ERA, r"(?i)^Pok[eé]mon\s+"):
        out = F.trim(F.regexp_replace(out, p, ""))
    return out


def card_identity(title: Column, body: Column, grader: Column, grade: Column, language: Column) -> dict[str, Column]:
    """core (the title without its grading), ref, year, language and series of a card; empty where nothing tells them.

    body is the text of the item alone; grader, grade and language are what is known beside the texts (null: nothing).
    """
    title, body = F.coalesce(title, F.lit("")), F.coalesce(body, F.lit(""))
    both = F.concat_ws("\n", title, body)
    own = F.concat(F.lower(grader), F.lit(" ?"), F.regexp_replace(grade, r"([.+])", r"\\$1"), F.lit(r"\+?\s*"))
    known = (F.coalesce(grader, F.lit("")) != "") & (F.coalesce(grade, F.lit("")) != "")
    core = F.when(known, F.regexp_replace(title, F.concat(F.lit(r"(?i)^\s*"), F.coalesce(own, F.lit(r"\b\B"))), F.lit(""))).otherwise(title)
    core = squeezed(F.regexp_replace(core, rf"(?i)^\s*(?:{HOUSES})\s*\d+(?:[.,]\d)?\+?\s*", ""))
    ref = F.upper(F.coalesce(*[found(both, p) for p in REFERENCES], F.lit("")))
    year = F.coalesce(found(body, r"(?iU)(?:Année|Year)\s*:?\s*(19\d{2}|20\d{2})\b"), found(both, YEAR), F.lit(""))
    spoken = reduce(lambda c, kv: c.when(title.rlike(rf"(?iU)\b(?:{kv[1]})\b"), kv[0]), SPOKEN.items(), F).otherwise("")
    cut = lambda s: strip(F.split(F.trim(s), NEXT_FIELD, 2)[0])
    series = F.coalesce(*[F.when(F.length(cut(found(body, p))) >= 2, cut(found(body, p))) for p in SERIES], F.lit(""))
    return {"core": core, "ref": ref, "year": year, "language": F.when(F.coalesce(language, F.lit("")) != "", language).otherwise(spoken), "series": series}


def coordinates(df: DataFrame, title: str) -> DataFrame:
    """df with state (PARSED or the reason against) and year, language, set, name, local_id, grade, edition, finish and variant of titles of the fixed form.

    year Pokemon language [set] rarity [name] #number PSA grade: one rarity divides set from name.
    """
    t = df.withColumn("_n", squeezed(F.col(title))).withColumn("_middle", F.regexp_extract("_n", STRICT, 3))
    t = t.withColumns({"_cuts": F.split("_middle", RARITY), "_n_cuts": F.size(every(F.col("_middle"), RARITY, 0))})
    t = t.withColumns({"_set": clean_set(F.get("_cuts", 0)), "_name": strip(F.coalesce(F.get("_cuts", 1), F.lit("")))})
    state = F.when(F.col("_middle") == "", "schema unproven").when(F.col("_n_cuts") == 0, "rarity missing").when(F.col("_n_cuts") > 1, "rarity ambiguous").when((F.col("_set") == "") | (F.col("_name") == ""), "set or name unproven").otherwise("PARSED")
    ok = lambda c: F.when(state == "PARSED", c)
    got = lambda k: F.regexp_extract("_n", STRICT, k)
    made = {"year": got(1).try_cast("int"), "language": F.when(F.lower(got(2)) == "japanese", "ja").otherwise("en"), "set": F.col("_set"), "name": F.col("_name"), "local_id": local_number(got(4)), "grade": shown_grade(got(5)), **dimensions(F.col("_n"))}
    return t.select(*df.columns, state.alias("state"), *[ok(c).alias(k) for k, c in made.items()])


def reading(set_: Column, name: Column, local: Column) -> Column:
    return F.struct(set_.alias("set"), name.alias("name"), local.alias("local_id"))


def simple(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(F.lower(text), MARKED, PLAIN), "[^a-z0-9]+", " "))


def different(readings: Column, most: int) -> Column:
    """The first `most` readings that differ in set, name or number; those without a name are none."""
    named = F.filter(readings, lambda r: r["name"] != "")
    same = lambda a, b: (a["k"] == b["k"]) & (a["r"]["local_id"] == b["r"]["local_id"])
    keyed = F.transform(named, lambda r: F.struct(r.alias("r"), F.concat_ws("|", simple(r["set"]), simple(r["name"])).alias("k")))
    first = F.transform(F.array(keyed), lambda all_: F.filter(all_, lambda x, i: ~F.exists(F.slice(all_, 1, i), lambda y: same(x, y))))[0]
    return F.slice(F.transform(first, lambda x: x["r"]), 1, most)


def divisions(text: Column, most: int, name_last: bool) -> list[Column]:
    """(set, name) with a name of 1 to `most` words at the end or the beginning of a text, a word at least left for the set."""
    w = F.split(text, " ")
    out = []
    for n in range(1, most + 1):
        head, tail = F.array_join(F.slice(w, 1, F.greatest(F.size(w) - n, F.lit(0))), " "), F.array_join(F.slice(w, F.greatest(F.size(w) - n + 1, F.lit(1)), n), " ")
        lead, rest = F.array_join(F.slice(w, 1, n), " "), F.array_join(F.slice(w, n + 1, F.size(w)), " ")
        pair = (head, tail) if name_last else (rest, lead)
        out.append(F.when(F.size(w) > n, F.struct(pair[0].alias("set"), pair[1].alias("name"))))
    return out


PAIR = "array<struct<set:string,name:string>>"


def pairs(items: list[Column]) -> Column:
    return F.filter(F.array(*items).cast(PAIR), lambda p: p.isNotNull())


def pair(set_: Column, name: Column, when: Column | None = None) -> Column:
    made = F.struct(set_.alias("set"), name.alias("name"))
    return made if when is None else F.when(when, made)


def with_readings(df: DataFrame, title: str, most: int = 10) -> DataFrame:
    """df with readings (up to `most` of set, name and local_id, the likeliest first), reason (null with readings), year, language, grade, edition, finish and variant.

    Titles of the known form are divided at a rarity, before their last one to four words and at what follows the number. Any other title
    must name the game, one language, a grade and one collector number; what stands beside the number is divided with the name last,
    the name first, or after a slash. A whole fraction may do without a set.
    """
    last = lambda text: F.try_element_at(F.split(text, "/"), F.lit(-1))
    cut_last = lambda text: F.regexp_replace(text, "/[^/]*$", "")
    t = df.withColumn("_n", squeezed(F.col(title)))
    # the known form
    got = lambda k: F.regexp_extract("_n", SHELL, k)
    t = t.withColumns({"_body": got(4), "_shell_year": F.concat(got(1), got(2)), "_shell_language": F.lower(got(3)), "_shell_grade": got(5)})
    t = t.withColumns({"_marks": every(F.col("_body"), MARKER, 1), "_sides": F.split("_body", MARKER)})
    one = F.size("_marks") == 1
    t = t.withColumns({"_l": F.when(one, strip(F.get("_sides", 0))), "_r": F.when(one, strip(F.get("_sides", 1)))})
    rare = F.split("_l", RARITY)
    strict = [
        pair(F.get(rare, 0), F.get(rare, 1), F.size(rare) == 2), *divisions(F.col("_l"), 4, True),
        pair(F.col("_l"), F.trim(F.regexp_replace("_r", DESCRIPTOR, "")), F.col("_r") != ""), pair(F.col("_l"), F.trim(last(F.col("_r"))), F.col("_r").contains("/")),
    ]
    number = local_number(F.get("_marks", 0))
    known = F.transform(pairs(strict), lambda p: F.struct(clean_set(p["set"]).alias("set"), strip(squeezed(p["name"])).alias("name")))
    known = F.transform(F.filter(known, lambda p: p["set"] != ""), lambda p: reading(p["set"], p["name"], number))
    t = t.withColumn("_strict", F.when(one & (number != ""), different(known, 6)).otherwise(F.array().cast(f"array<{READING}>")))
    # any other form
    tongues = F.array_distinct(F.transform(every(F.upper("_n"), LANGUAGE, 1), lambda w: F.substring(w, 1, 1)))
    t = t.withColumns({"_tongues": tongues, "_psa": F.regexp_extract("_n", PSA, 1), "_prefix": F.trim(F.split("_n", PSA, 2)[0])})
    lefts = every(F.col("_prefix"), FRACTION, 1)
    t = t.withColumns({"_digits": F.transform(lefts, lambda x: x.rlike("[0-9]")), "_lefts": lefts, "_wholes": every(F.col("_prefix"), FRACTION, 0), "_gaps": F.split("_prefix", FRACTION)})
    at = F.array_position("_digits", True).cast("int")  # from 1; 0 without one
    n_fractions = F.size(F.filter("_digits", lambda x: x))
    before = F.concat(F.array_join(F.flatten(F.zip_with(F.slice("_gaps", 1, F.greatest(at - 1, F.lit(0))), F.slice("_wholes", 1, F.greatest(at - 1, F.lit(0))), lambda g, w: F.array(g, w))), ""), F.get("_gaps", at - 1))
    whole, local = F.when(n_fractions == 1, F.get("_wholes", at - 1)), F.when(n_fractions == 1, F.get("_lefts", at - 1))
    lead = F.when(n_fractions == 1, before)
    settled = n_fractions > 0  # several fractions, or several numbers of a kind, prove none
    for p in NUMBERS:
        n = F.size(every(F.col("_prefix"), p, 0))
        whole = F.coalesce(whole, F.when(~settled & (n == 1), F.regexp_extract("_prefix", p, 0)))
        local = F.coalesce(local, F.when(~settled & (n == 1), F.regexp_extract("_prefix", p, 1)))
        lead = F.coalesce(lead, F.when(~settled & (n == 1), F.split("_prefix", p)[0]))
        settled = settled | (n > 0)
    bare = lambda c: strip(squeezed(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, POKEMON, " "), LANGUAGE, " "), YEAR, " "), r"^[\s.]+", "")), " -|:./")
    t = t.withColumns({"_whole": whole, "_local": local_number(local), "_lead": lead})
    t = t.withColumns({"_left": bare(F.col("_lead")), "_right": bare(F.expr("substring(_prefix, length(_lead) + length(_whole) + 1)")), "_fraction": n_fractions == 1})
    left, right = F.col("_left"), F.col("_right")
    plain_left = F.trim(F.regexp_replace(left, FINISH_LAST, ""))
    without = F.when((plain_left != "") & (plain_left != left), plain_left)
    short = F.col("_fraction") & (F.size(F.split(left, " ")) <= 4)
    loose = [
        pair(left, F.trim(F.regexp_replace(right, DESCRIPTOR, "")), right != ""), pair(left, F.trim(last(right)), right.contains("/")),
        pair(strip(F.regexp_replace(cut_last(left), DESCRIPTOR_LAST, "")), last(left), left.contains("/")),
        *divisions(without, 4, True), *divisions(without, 3, False), pair(F.lit(""), without, F.col("_fraction") & (F.size(F.split(without, " ")) <= 4)), *divisions(left, 4, True), *divisions(left, 3, False), pair(F.lit(""), left, short),
    ]
    free = F.transform(pairs(loose), lambda p: reading(strip(squeezed(p["set"])), strip(squeezed(p["name"])), F.col("_local")))
    reason = (
        F.when(~F.col("_n").rlike(POKEMON), "not the game").when(F.size("_tongues") != 1, "language unproven").when(F.col("_psa") == "", "grade unproven").when(F.coalesce(F.col("_local"), F.lit("")) == "", "number unproven")
    )
    t = t.withColumn("_why", reason).withColumn("_free", F.when(reason.isNull(), different(free, 10)).otherwise(F.array().cast(f"array<{READING}>")))
    t = t.withColumn("readings", different(F.concat("_strict", "_free"), most))
    some, strict_first = F.size("readings") > 0, F.size("_strict") > 0
    language = F.when(strict_first, F.when(F.col("_shell_language") == "japanese", "ja").otherwise("en")).otherwise(F.when(F.get("_tongues", 0) == "J", "ja").otherwise("en"))
    year = F.when(strict_first, F.col("_shell_year")).otherwise(F.regexp_extract("_n", YEAR, 1)).try_cast("int")
    grade = shown_grade(F.when(strict_first, F.col("_shell_grade")).otherwise(F.col("_psa")))
    values = {"year": F.coalesce(year, F.lit(0)), "language": language, "grade": grade, **dimensions(F.col("_n"), balls=True)}
    return t.select(*df.columns, "readings", F.when(~some, F.coalesce("_why", F.lit("set or name unproven"))).alias("reason"), *[F.when(some, c).alias(k) for k, c in values.items()])


@query("STR-18", sql="""
select p_partkey as k, p_name as core, case p_partkey % 3 when 0 then p_size || '/' || (p_partkey % 900) when 1 then 'SV-' || p_size else p_size || '/99' end as ref, case when p_partkey % 5 > 0 then (1990 + p_size % 30)::varchar else '' end as year,
  case p_partkey % 4 when 0 then 'French' when 1 then 'Japanese' when 2 then 'German' else '' end as language, case when p_partkey % 7 > 0 then 'Legend ' || replace(p_brand, '#', ' ') else '' end as series from part""")
def whole_title_identities(spark, sf_dir):
    """Identities from titles and item texts: a labelled, a marked or a bare reference, a labelled or a bare year, a language said or known."""
    p, k, s = table(spark, sf_dir, "part"), F.col("p_partkey"), F.col("p_size").cast("string")
    ref = F.when(k % 3 == 0, F.concat(s, F.lit("/"), (k % 900).cast("string"))).when(k % 3 == 1, F.concat(F.lit("sv-"), s)).otherwise(F.concat(s, F.lit("/99")))
    year = F.when(k % 5 > 0, (1990 + F.col("p_size") % 30).cast("string"))
    language = F.when(k % 4 == 0, "Français").when(k % 4 == 1, "japonais")
    grading = F.when(k % 2 == 0, "PSA 9 ").otherwise("CGC 9.5 ")
    title = F.concat(grading, F.replace("p_name", F.lit(" "), F.lit("  ")))
    fields = F.concat_ws("\n", F.lit("Article"), F.when(k % 3 == 0, F.concat(F.lit("Référence: #"), ref)).when(k % 3 == 1, F.concat(F.lit("card #"), ref)).otherwise(F.concat(F.lit("card "), ref)), F.when(k % 10 > 5, F.concat(F.lit("Année : "), year)).otherwise(F.concat(F.lit("of "), year)), F.when(k % 7 > 0, F.concat(F.lit("Série: Legend "), F.replace("p_brand", F.lit("#"), F.lit(" ")), F.lit("  - Langue: x"))))
    rows = p.select(k.alias("k"), title.alias("title"), fields.alias("body"), F.when(k % 2 == 0, "PSA").alias("grader"), F.when(k % 2 == 0, "9").alias("grade"), language.alias("said"), F.when(k % 4 == 2, "German").alias("known"))
    of = card_identity(F.concat_ws(" ", "title"), F.col("body"), F.col("grader"), F.col("grade"), F.col("known"))
    spoken = card_identity(F.concat_ws(" ", "title", "said"), F.col("body"), F.col("grader"), F.col("grade"), F.col("known"))
    return rows.select("k", *[of[c].alias(c) for c in ("core", "ref", "year")], spoken["language"].alias("language"), of["series"].alias("series"))


@query("STR-52", sql="""
select p_partkey as k, case p_partkey % 5 when 3 then 'rarity missing' when 4 then 'schema unproven' else 'PARSED' end as state, case when p_partkey % 5 < 3 then replace(p_brand, '#', ' ') end as "set", case when p_partkey % 5 < 3 then p_name end as name,
  case when p_partkey % 5 < 3 then p_size::varchar end as local_id, case when p_partkey % 5 < 3 then ['10', '9', '8.5'][p_size % 3 + 1] end as grade, case when p_partkey % 5 < 3 then 1990 + p_size % 30 end::int as year,
  case when p_partkey % 5 < 3 then ['ja', 'en'][p_size % 2 + 1] end as language, case when p_partkey % 5 < 3 then case p_partkey % 5 when 1 then 'Reverse Holo' else '' end end as finish from part""")
def title_coordinates(spark, sf_dir):
    """Titles of the fixed form, with a set code or an era before the set, without a rarity, or in another form."""
    k, s = F.col("p_partkey"), F.col("p_size")
    of = lambda n, *xs: F.element_at(F.array(*map(F.lit, xs)), (n + 1).cast("int"))
    rarity = of(k % 5, " AR ", " Reverse Holo ", " Illustration  Rare ", " ", " SR ")
    title = F.concat((1990 + s % 30).cast("string"), of(k % 5, " Pokemon ", " Pokémon ", " POKEMON ", " Pokemon ", " Card "), of(s % 2, "Japanese ", "english "), of(k % 3, "SV2a ", "Scarlet & Violet ", "Pokémon "), F.replace("p_brand", F.lit("#"), F.lit(" ")), rarity, "p_name", F.lit(" #00"), s.cast("string"), of(s % 3, " PSA 10 GEM MINT", " PSA GEM MT 9.0", " PSA 8.5"))
    return coordinates(table(spark, sf_dir, "part").select(k.alias("k"), title.alias("title")), "title").select("k", "state", "set", "name", "local_id", "grade", "year", "language", "finish")


@query("STR-53", "UDF-12", sql="""
with p as (select p_partkey as k, p_size as s, string_split(p_name, ' ')[1] as a, string_split(p_name, ' ')[2] as b, lower(p_type) as t from part where len(string_split(p_name, ' ')) = 2)
select k, unnest(case k % 4 when 0 then ['1:' || t || ' ' || a || ':' || b, '2:' || t || ':' || a || ' ' || b, '3:' || a || ' ' || b || ':' || t, '4:' || b || ':' || t || ' ' || a]
  when 1 then ['1:' || t || ':' || a || ' ' || b] when 2 then ['1:' || a || ':' || b, '2:' || b || ':' || a, '3::' || a || ' ' || b] else ['language unproven'] end) as reading from p""")
def title_readings(spark, sf_dir):
    """Readings of loose titles: the number at the end, a name after it, a fraction without a set, a title without a language."""
    p = spread(table(spark, sf_dir, "part"), "p_partkey").where(F.size(F.split("p_name", " ")) == 2)
    k, s, t = F.col("p_partkey"), F.col("p_size").cast("string"), F.lower("p_type")
    forms = [
        F.concat(F.lit("2023 Japanese Pokemon "), t, F.lit(" "), "p_name", F.lit(" 0"), s, F.lit(" PSA 10")), F.concat(F.lit("Pokemon 2021 JPN "), t, F.lit(" #"), s, F.lit(" FA/"), "p_name", F.lit(" PSA 9")),
        F.concat("p_name", F.lit(" "), s, F.lit("/106 - PSA 10 - English Pokémon")), F.concat(F.lit("Pokemon "), t, F.lit(" "), "p_name", F.lit(" #"), s, F.lit(" PSA 10")),
    ]
    rows = with_readings(p.select(k.alias("k"), F.element_at(F.array(*forms), (k % 4 + 1).cast("int")).alias("title")), "title")
    lines = F.when(F.size("readings") > 0, F.transform("readings", lambda r, i: F.concat_ws(":", (i + 1).cast("string"), r["set"], r["name"]))).otherwise(F.array("reason"))
    return rows.select("k", F.explode(lines).alias("reading"))
