"""Whether a text is a card's, and whether it proves which one: every gate says why it does not open."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..registry import query
from ..sources.tables import spread, table
from .history import every
from .parsing import clean_title
from .text import LANGUAGES, alias, plain

#: Goods that are no cards, words of what may be sold under one title, of auctions, and of a language.
SEALED = ["booster", "pack", "display", "box", "coffret", "blister", "bundle", "elite trainer", "etb", "deck", "tin", "case", "scellé", "sealed", "collection box", "trainer box", "tripack", "3-pack", "duopack"]
AUCTION = ["現在", "入札", "オークション", "auction", "bidding", "current bid"]
SEVERAL = ["2枚", "3枚", "4枚", "5枚", "10枚", "セット販売", "まとめ売り", "連番", "bundle", "lot of", "set of"]
JAPANESE = ["japanese", "japan", "jp", "jpn", "日本語", "日本版", "日本"]
TELLING = ["1st edition", "first edition", "shadowless", "incorrect texture", "error", "stamp", "stamped", "reverse", "master ball", "pokeball"]
FRACTION = r"(?i)(?<![A-Z0-9])#?([A-Z0-9-]{1,16})\s*/\s*([A-Z0-9-]{1,16})(?![A-Z0-9])"
TOP_GRADE = r"(?iU)\bPSA\s*(?:GEM\s*MT\s*)?10(?:\.0)?\b"
OTHER_ITEMS = r"(?i)おすすめ|関連商品|類似商品|この商品を見ている人|Recommended|Related items?|Similar items?"
ACTIONABLE_LANGUAGES = ["en", "ja"]


def any_of(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def is_card_listing(blob: Column) -> Column:
    """Whether a listing names the game and no sealed goods; a null is no listing."""
    text = F.coalesce(blob, F.lit(""))
    return text.rlike(r"(?iU)\bPok[ée]mon\b") & ~any_of(F.lower(text), SEALED)


def item_state(title: Column, body: Column) -> Column:
    """CARD, or the terminal state of an item that is none: PARSE_FAILURE without a title, EXCLUDED_BY_RULES of another category or sealed, UNSUPPORTED without a grading block or a reference."""
    text = F.coalesce(body, F.lit(""))
    card = text.rlike(r"(?iU)Article\s+Gradation\s+Détails") | text.rlike(r"(?iU)(Réf[ée]rence|Reference)\s*:?\s*#?\s*[A-Z0-9]+(?:/[A-Z0-9]+)+")
    excluded = ~text.rlike(r"(?iU)(Catégorie|Category)\s*:?\s*Pok[ée]mon\b") | any_of(F.lower(text), SEALED)
    return F.when(clean_title(F.coalesce(title, F.lit(""))) == "", "PARSE_FAILURE").when(excluded, "EXCLUDED_BY_RULES").when(card, "CARD").otherwise("UNSUPPORTED")


def said(value: Column) -> Column:
    """Whether anything is left of a value once its marks and signs are gone."""
    return F.coalesce(F.regexp_replace(plain(value), "[^a-z0-9]+", "") != "", F.lit(False))


def sufficient(grader: Column, grade: Column, core: Column, ref: Column, year: Column, series: Column, language: Column) -> Column:
    """Whether a card can be searched for elsewhere: house, grade and name, and a reference or all of year, series and language."""
    present = lambda c: F.coalesce(c.cast("string"), F.lit("")) != ""
    return present(grader) & grade.isNotNull() & said(core) & (said(ref) | (present(year) & said(series) & said(language)))


def complete(name: Column, set_: Column, number: Column, language: Column, grader: Column, grade: Column) -> Column:
    """Whether all six parts that tell a market apart are there. A number of signs alone is none."""
    number = F.regexp_replace(F.coalesce(number, F.lit("")), r"[#\s]", "") != ""
    filled = F.trim(F.coalesce(language, F.lit(""))) != ""
    return said(name) & said(set_) & number & filled & said(grader) & (F.trim(F.coalesce(grade.cast("string"), F.lit(""))) != "")


def actionable_language(language: Column) -> Column:
    """Whether a language (by any of its names) is one whose offers are acted on."""
    return F.coalesce(alias(F.lower(F.trim(plain(language))), LANGUAGES).isin(ACTIONABLE_LANGUAGES), F.lit(False))


def fraction(text: Column) -> Column:
    """Number/total of a text in upper case, without leading zeros on either side; empty without one."""
    side = lambda k: F.regexp_replace(F.regexp_extract(F.upper(text), FRACTION, k), "^0+(?=.)", "")
    return F.when(F.upper(text).rlike(FRACTION), F.concat_ws("/", side(1), side(2))).otherwise("")


def fractions(text: Column) -> Column:
    """All numbers/totals of a text."""
    side = lambda k: F.transform(every(F.upper(text), FRACTION, k), lambda x: F.regexp_replace(x, "^0+(?=.)", ""))
    return F.array_distinct(F.zip_with(side(1), side(2), lambda a, b: F.concat_ws("/", a, b)))


def spaced(text: Column) -> Column:
    """A text in lower case, all that is no word, slash, plus, hash, dot or hyphen as one space, with a space on either side."""
    t = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[‐‑‒–—−]", "-")
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(t, r"(?U)[^\w/+#.-]+", " ")), F.lit(" "))


def holds(text: Column, phrase: Column) -> Column:
    """Whether a spaced() text holds a phrase: as whole words, or anywhere if it is written in kana or kanji; an empty one never."""
    p = spaced(phrase)
    inner = F.trim(p)
    return (inner != "") & F.when(inner.rlike(r"[぀-ヿ一-鿿]"), text.contains(inner)).otherwise(text.contains(p))


def holds_any(text: Column, phrases: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [holds(text, F.lit(p)) for p in phrases])


PARTS = ("name", "set", "number", "year", "edition", "attribute", "variety", "rarity")


def with_card(df: DataFrame, card: dict[str, Column]) -> DataFrame:
    """df with the parts of a card as columns _name, _set, ...; parts that are not given are null."""
    return df.select("*", *[card.get(c, F.lit(None).cast("string")).alias(f"_{c}") for c in PARTS])


def ask_proofs(df: DataFrame, title: Column, text: Column, card: dict[str, Column], to: str = "proof") -> DataFrame:
    """df with what an ask's own text (without what it recommends beside) proves of a top-graded Japanese card: proven, or the first thing that it does not.

    card: name, set, number (as fraction() gives it), year, edition, attribute, variety; null parts ask for nothing.
    """
    own = F.split(F.concat_ws("\n", F.when(title != "", title), F.when(text != "", text)), OTHER_ITEMS, 2)[0]
    rows = with_card(df, card).select("*", own.alias("_own")).select("*", spaced(F.col("_own")).alias("_t"), F.trim(spaced(F.col("_edition"))).alias("_ed"))
    t = F.col("_t")
    needs_edition = (F.col("_ed") != "") & ((F.col("_year") <= 2003) | ~F.col("_ed").isin("unlimited", "standard"))
    untold = lambda c: any_of(F.trim(spaced(F.col(c))), TELLING) & ~holds(t, F.col(c))
    state = (
        F.when(holds_any(t, AUCTION), "ongoing auction").when(holds_any(t, SEVERAL), "several items").when(~F.array_contains(fractions(F.col("_own")), F.coalesce("_number", F.lit(""))), "number unproven").when(~F.col("_own").rlike(TOP_GRADE), "grade unproven")
        .when(~holds_any(t, JAPANESE), "language unproven").when(~(holds(t, F.col("_set")) | holds(t, F.col("_name"))), "card or set unproven").when(F.coalesce(needs_edition, F.lit(False)) & ~holds(t, F.col("_edition")), "edition unproven")
        .when(untold("_attribute") | untold("_variety"), "variant unproven").otherwise("proven")
    )
    return rows.select(*df.columns, state.alias(to))


def strict_proofs(df: DataFrame, text: Column, card: dict[str, Column], to: str = "proof") -> DataFrame:
    """df with proven, or the first of empty text, number, grade, language, name, set and telling word that a text does not prove; all parts are needed.

    card: name, set, number, edition, attribute, variety, rarity. Telling words of the last four must be in the text.
    """
    squeeze = lambda c: F.trim(F.regexp_replace(plain(F.coalesce(F.col(c), F.lit(""))), "[^a-z0-9]+", " "))
    rows = with_card(df, card).select("*", F.coalesce(text, F.lit("")).alias("_own"))
    rows = rows.select("*", squeeze("_own").alias("_t"), squeeze("_name").alias("_n"), squeeze("_set").alias("_s"), F.concat_ws("|", *[squeeze(c) for c in ("_edition", "_attribute", "_variety", "_rarity")]).alias("_told"))
    t = F.col("_t")
    first = F.coalesce(*[F.when(F.col("_told").contains(w) & ~t.contains(w), F.lit("variant unproven: " + w)) for w in TELLING])
    state = (
        F.when(t == "", "empty text").when(~F.array_contains(fractions(F.col("_own")), fraction(F.coalesce("_number", F.lit("")))), "number unproven").when(~F.col("_own").rlike(TOP_GRADE), "grade unproven")
        .when(~any_of(t, ["japanese", "japan", "jpn"]), "language unproven").when(~t.contains(F.col("_n")), "name unproven").when((F.col("_s") != "") & ~t.contains(F.col("_s")), "set unproven").when(first.isNotNull(), first).otherwise("proven")
    )
    return rows.select(*df.columns, state.alias(to))


def pick(column: Column, *values: str | None) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (column % len(values) + 1).cast("int"))


@query("FLT-01", "FLT-02", sql="""
select p_partkey as k, case p_partkey % 6 when 0 then 'CARD' when 1 then 'PARSE_FAILURE' when 2 then 'EXCLUDED_BY_RULES' when 3 then 'EXCLUDED_BY_RULES' when 4 then 'CARD' else 'UNSUPPORTED' end as state, p_partkey % 6 not in (2, 3) as listed from part""")
def card_items(spark, sf_dir):
    """Items with a grading block, without a title, of another category, sealed, with a reference, or with neither."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    title = F.when(k % 6 == 1, "PSA 10").otherwise(F.col("p_name"))
    category = pick(k, "Catégorie : Pokémon", "Category: POKEMON", "Category: Baseball", "Category: Pokemon", "catégorie Pokemon", "Category: Pokémon")
    block = pick(k, "Article\n Gradation  Détails", "Reference 4/102", "Reference 4/102", "Booster\nRéférence: #4/102", "Référence: #4/102", "4/102")
    body = F.concat_ws("\n", category, F.col("p_name"), block)
    return p.select(k.alias("k"), item_state(title, body).alias("state"), is_card_listing(body).alias("listed"))


@query("FLT-05", "FLT-06", "FLT-07", sql="""
select l_orderkey, l_linenumber, l_partkey % 7 > 0 and l_linenumber < 7 and (l_suppkey % 3 > 0 or (l_suppkey % 2 = 0 and l_returnflag <> 'R')) as sufficient, l_partkey % 7 > 0 and l_linenumber < 7 and l_suppkey % 3 > 0 and l_returnflag <> 'R' as complete, l_returnflag in ('A', 'N') as actionable from lineitem""")
def identity_gates(spark, sf_dir):
    """Lines as identities that lack a house, a grade, a reference, a year or a language."""
    line = table(spark, sf_dir, "lineitem")
    number, language = F.when(F.col("l_suppkey") % 3 > 0, F.concat(F.lit("#"), F.col("l_partkey").cast("string"), F.lit("/9"))).otherwise("# "), F.when(F.col("l_returnflag") == "A", "Anglais").when(F.col("l_returnflag") == "N", " JP ")
    grader, grade = F.when(F.col("l_partkey") % 7 > 0, "PSA").otherwise(""), F.when(F.col("l_linenumber") < 7, F.col("l_linenumber"))
    year = F.when(F.col("l_suppkey") % 2 == 0, "1999")
    return line.select(
        "l_orderkey", "l_linenumber", sufficient(grader, grade, F.lit("Évoli"), number, year, F.lit("Jungle"), language).alias("sufficient"), complete(F.lit("Évoli"), F.lit("Jungle"), number, language, grader, grade).alias("complete"), actionable_language(language).alias("actionable")
    )


@query("FLT-20", "FLT-21", sql="""
select p_partkey as k, case p_partkey % 10 when 0 then 'ongoing auction' when 1 then 'several items' when 2 then 'number unproven' when 3 then 'grade unproven' when 4 then 'language unproven' when 5 then 'card or set unproven' when 6 then case when p_size % 2 = 0 then 'edition unproven' else 'proven' end
  when 7 then case when p_size % 3 = 0 then 'variant unproven' else 'proven' end else 'proven' end as ask,
  case when p_partkey % 10 = 2 then 'number unproven' when p_partkey % 10 = 3 then 'grade unproven' when p_partkey % 10 = 4 then 'language unproven' when p_partkey % 10 = 5 then 'name unproven' when p_partkey % 10 = 8 then 'set unproven'
  when p_size % 2 = 0 and p_partkey % 10 in (6, 7) then 'variant unproven: 1st edition' when p_size % 3 = 0 and p_partkey % 10 in (6, 7) then 'variant unproven: shadowless' else 'proven' end as strict from part""")
def text_proofs(spark, sf_dir):
    """What an ask's text proves of the card that it is said to be, by the loose and by the strict rule."""
    p, k, s = spread(table(spark, sf_dir, "part"), "p_partkey"), F.col("p_partkey"), F.col("p_size")
    number = F.concat(F.lit("0"), s.cast("string"), F.lit(" / 0"), k.cast("string"))
    asked = F.concat(s.cast("string"), F.lit("/"), k.cast("string"))
    said_name = F.when(k % 10 == 5, "something").otherwise(F.upper("p_name"))
    said_set = F.when((k % 10 == 5) | (k % 10 == 8), "elsewhere").otherwise(F.replace("p_brand", F.lit("#"), F.lit(" ")))
    title = F.concat_ws(" ", F.lit("Pokémon"), said_set, said_name, F.when(k % 10 == 2, F.concat(number, F.lit("7"))).otherwise(number), F.when(k % 10 == 3, "PSA 9").otherwise("psa GEM MT 10"))
    text = F.concat_ws("\n", F.when(k % 10 == 4, "english").otherwise("Japanese"), F.when(k % 10 == 0, "Current bid: 3").when(k % 10 == 1, "lot of 3"), F.when(~(k % 10).isin(6, 7), "1st edition, shadowless"), F.lit("Related items: auction, english"))
    card = {"name": F.col("p_name"), "set": F.replace("p_brand", F.lit("#"), F.lit(" ")), "number": asked, "year": F.lit(1999), "edition": F.when((s % 2 == 0) & (k % 10 != 7), "1st Edition"), "attribute": F.when(s % 3 == 0, "Shadowless"), "rarity": F.when((s % 2 == 0) & (k % 10 == 7), "1st edition")}
    loose = {**card, "attribute": F.when((s % 3 == 0) & (k % 10 == 7), "Shadowless"), "edition": F.when((s % 2 == 0) & (k % 10 == 6), "1st Edition")}
    rows = p.select(k.alias("k"), title.alias("title"), text.alias("text"), *[c.alias(f"card_{n}") for n, c in card.items()], *[loose[n].alias(f"loose_{n}") for n in ("attribute", "edition")])
    told = {n: F.col(f"card_{n}") for n in card}
    rows = ask_proofs(rows, F.col("title"), F.col("text"), {**told, "attribute": F.col("loose_attribute"), "edition": F.col("loose_edition")}, "ask")
    return strict_proofs(rows, F.concat_ws("\n", "title", "text"), told, "strict").select("k", "ask", "strict")
