"""Linking of mentions to master records: a cascade of exact, normalised, alias and fuzzy stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions import columns as c
from faultline.operators import similar
from faultline.operators.connect import cut

# Corporate words, country names and entity types.
CORPORATE = r"\b(inc\.?|incorporated|corp\.?|corporation|llc\.?|ltd\.?|limited|co\.?|company|enterprises|holdings|group|pvt\.?|s\.?a\.?|plc\.?|technologies|industries|logistics|distributor|suppliers?)\b"
CORPORATE_NAME = r"(?i)\b(inc\.?|incorporated|corp\.?|corporation|ltd\.?|limited|llc\.?|gmbh|co\.?|company|pvt\.?|s\.?a\.?|plc\.?)\b"
COUNTRIES = {
    "us": "united states", "usa": "united states", "u.s.": "united states", "u.s.a.": "united states", "united states of america": "united states", "uk": "united kingdom",
    "u.k.": "united kingdom", "great britain": "united kingdom", "prc": "china", "people's republic of china": "china", "uae": "united arab emirates", "u.a.e.": "united arab emirates",
    "korea": "south korea", "rok": "south korea", "republic of korea": "south korea", "in": "india", "de": "germany", "jp": "japan", "sg": "singapore", "nl": "netherlands",
}
ENTITY_TYPES = {
    "ORG": "ORGANIZATION", "ORGANIZATION": "ORGANIZATION", "SUPPLIER": "SUPPLIER", "GPE": "LOCATION", "LOC": "LOCATION", "LOCATION": "LOCATION", "CITY": "CITY", "COUNTRY": "COUNTRY",
    "PORT": "PORT", "FACILITY": "FACILITY", "PRODUCT": "PRODUCT", "FAC": "FACILITY", "NORP": "ORGANIZATION",
}
SUPPLIER_TYPES, LOCATION_TYPES, PRODUCT_TYPES = ("SUPPLIER", "ORG", "ORGANIZATION"), ("LOCATION", "GPE", "LOC", "CITY", "COUNTRY", "PORT", "FACILITY"), ("PRODUCT",)
#: Corporate words are taken away until none is left; names hold no more than this many rounds of them.
ROUNDS = 4


def _named(value: Column, names: dict[str, str], otherwise: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), value), otherwise)


def linking_text(text: Column, corporate: bool = True) -> Column:
    """Lower case, "port of x" as "x port", without corporate words, country names in full, punctuation as spaces."""
    t = F.trim(F.lower(F.coalesce(text, F.lit(""))))
    core = F.regexp_replace(t, r"^port\s+(of\s+)?", "")
    t = F.when(t.rlike(r"^port\s+"), F.concat(F.trim(core), F.lit(" port"))).otherwise(t)
    for _ in range(ROUNDS if corporate else 0):
        t = F.trim(F.regexp_replace(F.regexp_replace(t, CORPORATE, ""), r"[\s,.;:-]+$", ""))
    t = _named(t, COUNTRIES, t)
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"(?U)[^\w\s]", " "), r"(?U)\s+", " "))


def entity_type(raw: Column) -> Column:
    return _named(F.upper(F.trim(F.coalesce(raw, F.lit("")))), ENTITY_TYPES, F.lit("OTHER"))


def entity_name(name: Column, kind: Column) -> Column:
    """The canonical name in upper case; empty is UNKNOWN."""
    raw = F.trim(F.coalesce(name, F.lit("")))
    low = F.lower(raw)
    cut = raw
    for _ in range(ROUNDS):
        cut = F.trim(F.regexp_replace(F.regexp_replace(cut, CORPORATE_NAME, ""), r"[\s,.;:-]+$", ""))
    known = _named(F.upper(F.coalesce(kind, F.lit(""))), ENTITY_TYPES, F.upper(F.coalesce(kind, F.lit(""))))
    plain = F.when(known.isin("ORGANIZATION", "SUPPLIER", "") & (F.length(cut) >= 2), cut).otherwise(raw)
    plain = F.upper(F.trim(F.regexp_replace(plain, r"(?U)\s+", " ")))
    named = F.element_at(F.create_map(*[F.lit(x) for k, v in COUNTRIES.items() if k != "nl" for x in (k, v.upper())]), low)
    port = F.when(low.rlike(r"^port\s+(of\s+)?.+$"), F.concat(F.upper(F.trim(F.regexp_replace(raw, r"(?i)^port\s+(of\s+)?", ""))), F.lit(" PORT"))).when(low.endswith(" port"), F.concat(F.upper(F.trim(F.regexp_replace(raw, r"(?i) port$", ""))), F.lit(" PORT")))
    return F.when(raw == "", "UNKNOWN").otherwise(F.coalesce(named, port, F.when(plain != "", plain), F.lit("UNKNOWN")))


def numbers(text: Column) -> Column:
    """The numbers that stand alone in a text, as written and without leading zeros."""
    n = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\b(\d+)\b"), 1)
    return F.array_distinct(F.concat(n, F.transform(n, lambda x: F.regexp_replace(x, r"^0+(?=\d)", ""))))


def conflict(a: Column, b: Column) -> Column:
    """Whether both number sets hold something and share nothing."""
    return (F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b)


def _master(master: DataFrame, corporate: bool, aliases: tuple[str, ...]) -> DataFrame:
    """(id, name, low, norm, nums, alias_*) of ``master(id, name, ...)``: of rows with equal texts that of the least id, which is the one that every stage takes."""
    more = {f"alias_{a}": linking_text(F.col(a), False) for a in aliases}
    master = master.groupBy("name", *aliases).agg(F.min(F.struct("id"))["id"].alias("id"))
    return master.select("id", "name", F.lower(F.trim("name")).alias("low"), linking_text(F.col("name"), corporate).alias("norm"), numbers(F.col("name")).alias("nums"), *[v.alias(k) for k, v in more.items()])


def link(mentions: DataFrame, master: DataFrame, kind: str, threshold: float = 0.55, fuzzy: bool = True, method: str = "token") -> DataFrame:
    """(mention, entity_type, linked_id, match_method, match_score, confidence), a row per different mention.

    ``master`` holds (id, name), locations also (city, country), products also (category). Stages: the name or the
    id itself; the normalised name (and city); suppliers by containment, locations by country, products by category;
    then the most similar name. The first stage that hits wins, in it the greatest score, then the least id. Numbers
    that conflict rule out the normalised and the contained name. The first two stages and aliases are equality joins.
    Containment and similarity meet all masters in blocks (see ``similar``): similarity is the greater of the
    word-order and the word-set ratio, or with ``method`` "sequence" the sequence ratio, at least 0.92 where a number
    is shared; places count by name, city or country, products by name or 0.85 of the category's.
    """
    supplier = kind == "SUPPLIER"
    alias = {"LOCATION": ("city", "country"), "PRODUCT": ("category",)}.get(kind, ())
    s = cut(_master(master, supplier, alias))
    m = mentions.select(F.trim("mention").alias("mention")).where("mention <> ''").distinct()
    m = cut(m.withColumns({"m_low": F.lower("mention"), "m_id": F.upper("mention"), "m_norm": linking_text(F.col("mention"), supplier), "m_nums": numbers(F.col("mention"))}))
    # Each stage takes the least id of a key, so one row a key is joined: names and categories that many records share are no hot keys.
    by = lambda *keys: s.groupBy(*keys).agg(F.min(F.struct("id"))["id"].alias("id"))
    ids = master.select("id").distinct()
    low, norm = by("low"), by("norm", "nums")

    def hit(j: DataFrame, stage: int, score: Column, method: str) -> DataFrame:
        return j.select("mention", F.lit(stage).alias("stage"), score.cast("double").alias("score"), F.col("id"), F.lit(method).alias("method"))

    one, free = F.lit(1.0), ~conflict(F.col("m_nums"), F.col("nums"))
    found = hit(m.join(low, m["m_low"] == low["low"]), 1, one, "exact").unionByName(hit(m.join(ids, m["m_id"] == ids["id"]), 1, one, "exact"))
    named = m.where("m_norm <> ''")
    found = found.unionByName(hit(named.join(norm, named["m_norm"] == norm["norm"]).where(free), 2, F.lit(0.98), "normalized"))
    if kind == "LOCATION":
        city, land = by("alias_city", "nums"), by("alias_country").where("alias_country <> ''")
        found = found.unionByName(hit(named.join(city, named["m_norm"] == city["alias_city"]).where(free), 2, F.lit(0.98), "normalized"))
        country = m.withColumn("m_country", _named(F.col("m_low"), COUNTRIES, F.col("m_norm")))
        found = found.unionByName(hit(country.join(land, country["m_country"] == land["alias_country"]), 3, F.lit(0.92), "alias"))
    if kind == "PRODUCT":
        sort = by("alias_category").where("alias_category <> ''")
        found = found.unionByName(hit(named.join(sort, named["m_norm"] == sort["alias_category"]), 3, F.lit(0.88), "alias"))
    if supplier or fuzzy:
        found = cut(found)
        open_ = named.join(found.select("mention").distinct(), "mention", "left_anti").select("mention", F.col("m_norm").alias("norm"), F.col("m_nums").alias("nums"))
        text = lambda norm, nums, weight: s.select("id", F.col(norm).alias("norm"), nums.alias("nums"), F.lit(weight).alias("weight"))
        none = F.array().cast("array<string>")
        texts = text("norm", F.col("nums"), 1.0)
        if kind == "LOCATION":
            texts = texts.unionByName(text("alias_city", F.col("nums"), 1.0)).unionByName(text("alias_country", none, 1.0))
        if kind == "PRODUCT":
            texts = texts.unionByName(text("alias_category", none, 0.85))
        near = cut(similar.matches(open_, texts, threshold, method, fuzzy, supplier))
        found = found.unionByName(near.where("stage = 3").select("mention", F.col("stage"), "score", "id", F.lit("alias").alias("method")))
        if fuzzy:
            won = similar.steps(near).select("mention", F.lit(4).alias("stage"), F.col("steps")[0]["score"].alias("score"), F.col("steps")[0]["id"].alias("id"), F.lit("fuzzy").alias("method"))
            found = found.unionByName(won)
    # The first id of the first stage; the similar stage has one row a mention.
    rank = F.struct("stage", "id", "score", "method")
    best = found.groupBy("mention").agg(F.min(rank).alias("b"))
    j = m.select("mention").join(best, "mention", "left")
    method, score = F.coalesce("b.method", F.lit("unresolved")), F.coalesce("b.score", F.lit(0.0))
    return j.select("mention", F.lit(kind).alias("entity_type"), F.coalesce("b.id", F.lit("UNKNOWN")).alias("linked_id"), method.alias("match_method"), F.round(score, 3).alias("match_score"), c.link_confidence(method, score).alias("confidence"))


def link_entities(mentions: DataFrame, suppliers: DataFrame, locations: DataFrame, products: DataFrame, **options) -> DataFrame:
    """Links ``mentions(mention, entity_type)`` by type; other types try suppliers, then locations, then products.

    Each master is linked once, with the mentions that may belong to it.
    """
    kind = F.upper(F.coalesce("entity_type", F.lit("")))
    masters = ((suppliers, "SUPPLIER", SUPPLIER_TYPES), (locations, "LOCATION", LOCATION_TYPES), (products, "PRODUCT", PRODUCT_TYPES))
    own = F.when(F.lit(False), F.array(F.lit(0)))
    for i, (*_, types) in enumerate(masters):
        own = own.when(kind.isin(*types), F.array(F.lit(i)))
    asked = cut(mentions.select(F.trim("mention").alias("mention"), kind.alias("asked"), own.otherwise(F.array(*[F.lit(i) for i in range(3)])).alias("may")).where("mention <> ''").distinct())
    every = None
    for i, (master, name, _) in enumerate(masters):
        got = cut(link(asked.where(F.array_contains("may", i)), master, name, **options)).withColumn("i", F.lit(i))
        every = got if every is None else every.unionByName(got)
    j = asked.withColumn("i", F.explode("may")).drop("may").join(every, ["mention", "i"])
    lost = F.col("linked_id") == "UNKNOWN"
    names = ("entity_type", "linked_id", "match_method", "match_score", "confidence")
    best = j.groupBy("mention", "asked").agg(F.min(F.struct(lost.alias("lost"), F.when(lost, -F.col("i")).otherwise(F.col("i")).alias("turn"), *names)).alias("b"))
    return best.select("mention", *[F.col(f"b.{n}").alias(n) for n in names])


def link_first(asked: DataFrame, master: DataFrame, kind: str, threshold: float | None = None, method: str = "token") -> DataFrame:
    """(key, mention, at, match_score, confidence): the older linker, one record for all mentions of a key, or no row.

    ``asked(key, pos, mention)`` holds the mentions of a key in order, ``master(at, name, ...)`` the records in theirs, with
    (city, country) for places and (category) for products. A mention of two characters or more is compared with every
    text of every record; a later one wins with a greater score only. Products count 0.85 of the category's score. The
    thresholds are 0.55, for places 0.60. The confidence is the score, of suppliers 1.02 times it, at most 1.
    """
    threshold = threshold if threshold is not None else 0.60 if kind == "LOCATION" else 0.55
    bare = lambda x: F.regexp_extract_all(x, F.lit(r"\b(\d+)\b"), 1)
    asked = asked.select("key", "pos", F.trim("mention").alias("mention")).where(F.length("mention") >= 2)
    m = asked.select("mention").distinct().select("mention", c.legacy_linking_text(F.col("mention")).alias("norm"), bare(F.col("mention")).alias("nums"))
    texts = None
    for x, weight in {"LOCATION": (("name", 1.0), ("city", 1.0), ("country", 1.0)), "PRODUCT": (("name", 1.0), ("category", 0.85))}.get(kind, (("name", 1.0),)):
        one = master.select(F.col("at").alias("id"), c.legacy_linking_text(F.col(x)).alias("norm"), bare(F.coalesce(F.col(x), F.lit(""))).alias("nums"), F.lit(weight).alias("weight"))
        texts = one if texts is None else texts.unionByName(one)
    won = similar.scan(asked, cut(similar.matches(m, texts, threshold, method)), threshold)
    sure = F.least(F.lit(1.0), F.col("score") * 1.02) if kind == "SUPPLIER" else F.col("score")
    return won.select("key", "mention", F.col("id").alias("at"), F.round("score", 3).alias("match_score"), F.round(sure, 3).alias("confidence"))


def link_report(links: DataFrame) -> DataFrame:
    """One row: links by method, mean confidence of all, and the unresolved share as text."""
    lost = F.count_if((F.col("linked_id") == "UNKNOWN") | (F.col("match_method") == "unresolved"))
    by = [F.count_if(F.col("match_method") == m).alias(f"{m}_matches") for m in ("exact", "normalized", "alias", "fuzzy")]
    # Confidences have three digits: whole thousandths give a mean that doesn't depend on the order of the rows.
    n = F.count("confidence")
    mean = F.when(n > 0, F.expr("(20 * sum(cast(round(confidence * 1000) as bigint)) + count(confidence)) div (2 * count(confidence))") / 10000).otherwise(0.0)
    share = F.when(F.count("*") > 0, F.round(100.0 * lost / F.greatest(F.count("*"), F.lit(1)), 1)).otherwise(0.0)
    return links.agg(F.count("*").alias("total_entities"), *by, lost.alias("unresolved_entities"), mean.alias("average_confidence"), F.format_string("%.1f%%", share).alias("unresolved_percentage"))
