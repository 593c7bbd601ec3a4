"""The games of the enriched table among the offers and the contrast catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.matching import (
    LEAST,
    LEAST_SHORTENED,
    MOST_EDITS,
    assign,
    company_similarity,
    damaged_similarity,
    day_similarity,
    neighbours,
    overlap_similarity,
    spelling_similarity,
    title_similarity,
    weighted,
)
from millrace.llm.titles import company_of, forms_of
from millrace.operators.skew import join_large_small
from millrace.operators.timestamps import normal_form
from millrace.session import cut

# The types of offers that are the game itself.
GAME_TYPES = ("game", "early access")
FORM = ["skeleton", "marker"]
FIELDS = ["publisher", "developer", "genre", "day", "platform"]


def _first_word(c: str) -> Column:
    return F.substring_index(c, " ", 1)


#: Orders from this one on are by company and day.
BY_MAKER = 4


def _laid_forms(titles: DataFrame) -> DataFrame:
    """``orders``: each distinct form once forwards and backwards, by its longest words, and by company and day.

    A pair agrees on its mark of sequel or reissue, and in the last two orders on the company's first word or the day.
    However many games or records share a form, they take one place in an order, and equal forms stand side by side.
    """
    none = F.lit(None).cast("struct<must:string,text:string>")
    at = lambda must, text: F.struct(must.alias("must"), text.alias("text"))
    s, mark = F.col("skeleton"), F.col("marker")
    once = titles.select(*FORM).distinct().select(F.array(at(mark, s), at(mark, F.reverse(s))).alias("orders"))
    words = titles.where(F.size("tokens") > 0).select(*FORM, "tokens").distinct()
    by_word = words.select(F.concat(F.array(none, none), F.transform("tokens", lambda t: at(mark, F.concat(t, F.lit("/"), s)))).alias("orders"))
    made = titles.select(*FORM, _first_word(F.coalesce("developer", "publisher")).alias("by"), "day").where("by is not null and day is not null").distinct()
    joined = lambda *c: F.concat_ws("/", *c)
    by_maker = made.select(F.array(*[none] * BY_MAKER, at(joined("marker", "by"), joined("day", "skeleton")), at(joined("marker", "day"), joined("by", "skeleton"))).alias("orders"))
    return once.unionByName(by_word).unionByName(by_maker)


def _support_keys(left: bool) -> Column:
    """What the two sides of a match by a shortened title must share: a near day, or where one day is missing, a company's first word."""
    day = F.to_date("day")
    days = F.transform(F.sequence(F.lit(-3), F.lit(3)), lambda k: F.date_add(day, k.cast("int")).cast("string")) if left else F.array(day.cast("string"))
    words = [F.concat(F.lit(f"{c}:"), _first_word(c)) for c in ("publisher", "developer")]
    unknown = lambda n, side: [F.when(day.isNull() | F.lit(side != left), F.concat(F.lit(f"{n}:"), w)) for w in words]
    return F.array_compact(F.concat(F.coalesce(days, F.array().cast("array<string>")), F.array(F.date_format(day, "MM-dd"), *unknown(0, True), *unknown(1, False))))


def games_of(rows: DataFrame) -> DataFrame:
    """One row per game: ``game`` (a number), ``n`` rows, its title forms, the usual value of each field, and known links.

    ``rows`` has a ``form`` for each row; rows without title belong to no game.
    """
    return rows.where(F.col("form.key").isNotNull()).groupBy(F.col("form.key").alias("key")).agg(
        F.min("row_id").alias("game"),
        F.count("*").alias("n"),
        F.first("form.marker").alias("marker"),
        F.first("form.skeleton").alias("skeleton"),
        F.array_distinct(F.flatten(F.collect_set("form.bases"))).alias("bases"),
        F.first("form.tokens").alias("tokens"),
        *(F.mode(c, deterministic=True).alias(c) for c in FIELDS),
        F.min("mmobomb_id").alias("mmobomb_id"),
    )


def _genre(c: Column) -> Column:
    return F.nullif(F.regexp_replace(F.lower(c), r"[^a-z]+", ""), F.lit(""))


def near_forms(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """``skeleton``, ``marker``, ``_skeleton``, ``title``, ``damaged``: forms of both sides that are neighbours and alike.

    Both have ``skeleton``, ``marker``, ``tokens``, ``publisher``, ``developer`` and ``day``. A pair's sequel or reissue
    marks are the same. ``damaged`` ones are less alike than slips explain, and need a day and company that agree.
    """
    met = neighbours(_laid_forms(ours), _laid_forms(theirs))
    # forms hold no "/", so they are what stands behind the last, or before the first
    form = lambda c: F.when(F.col("k") == 1, F.reverse(c)).otherwise(F.substring_index(c, "/", -1))
    met = met.select(F.substring_index("must", "/", 1).alias("marker"), form("l").alias("skeleton"), form("r").alias("_skeleton"), (F.col("k") >= BY_MAKER).alias("by_maker"))
    a, b = F.col("skeleton"), F.col("_skeleton")
    close = (F.abs(F.length(a) - F.length(b)) <= MOST_EDITS) & (F.levenshtein(a, b, MOST_EDITS) >= 0)
    met = met.where(F.col("by_maker") | close)  # most pairs end here, before they move
    near = met.groupBy("skeleton", "marker", "_skeleton").agg(F.max("by_maker").alias("by_maker"))
    slips = F.when(close, title_similarity(a, b))
    near = near.select("skeleton", "marker", "_skeleton", F.coalesce(slips, F.when(F.col("by_maker"), damaged_similarity(a, b))).alias("title"), slips.isNull().alias("damaged"))
    return cut(near.where("title is not null"))


def _sources(offers: DataFrame, contrast: DataFrame) -> DataFrame:
    """Offers of games and contrast records alike: ``kind``, ``id``, title forms and fields; each id once, those without title left out."""
    texts = ["title", "publisher", "developer", "genre", "release_date", "platform"]

    def once(df: DataFrame, kind: str, names: dict[str, str]) -> DataFrame:
        have = {c: F.min(names[c]) if names.get(c) in df.columns else F.lit(None).cast("string") for c in texts}
        return df.where(F.col("id").isNotNull()).groupBy("id").agg(*(v.alias(c) for c, v in have.items())).withColumn("kind", F.lit(kind))

    game_offers = offers.where(F.lower(F.trim("type")).isin(*GAME_TYPES))
    both = once(game_offers, "offer", {"title": "title", "platform": "platforms"}).unionByName(once(contrast, "contrast", {c: c for c in texts}))
    formed = both.select(
        "kind", "id", forms_of("title").alias("form"), company_of("publisher").alias("publisher"), company_of("developer").alias("developer"),
        _genre(F.col("genre")).alias("genre"), F.substring(normal_form("release_date", F.lit("UTC")), 1, 10).alias("day"), "platform",
    )
    return cut(formed.where(F.col("form.key").isNotNull()).select("kind", "id", "form.*", *FIELDS))


def match_games(enriched: DataFrame, offers: DataFrame, contrast: DataFrame) -> DataFrame:
    """``row_id``, ``source_id``, ``confidence``: offers of the game of each row without offer link, contrast records likewise.

    Rows and records are gathered into games by the keys of their titles. Distinct titles of both sides are laid once in
    several composite sort orders (forwards, backwards, by long words, by company and day) and compared within sliding
    windows; pairs get a confidence from weighted field similarities (offers: title, spelling, systems; contrast
    records: title, companies, day, genre). Each offer goes to its best game, contrast records and games are assigned
    one to one with the largest total confidence. Links that rows bear are taken as given for the whole game, with
    confidence 1. Offers of add-ons are left out.

    Rows without title match nothing; null attributes take no part in a confidence; records sent twice count once; empty
    tables give an empty result. A title that a third of all rows or offers bear is one entry in every comparison, and
    its rows are joined salted.
    """
    platform = F.col("platform") if "platform" in enriched.columns else F.lit(None).cast("string")
    rows = cut(
        enriched.select(
            "row_id", "mmobomb_id", "gamerpower_id", forms_of("title").alias("form"),
            company_of("publisher").alias("publisher"), company_of("developer").alias("developer"), _genre(F.col("genre")).alias("genre"),
            F.substring(normal_form("release_date", "feed_zone"), 1, 10).alias("day"), platform.alias("platform"),
        )
    )
    games = cut(games_of(rows))
    n_rows = max(1, games.agg(F.sum("n").alias("n")).first()["n"] or 0)
    keyed = rows.where(F.col("form.key").isNotNull()).select("row_id", "mmobomb_id", "gamerpower_id", F.col("form.key").alias("key"))
    members = cut(join_large_small(keyed, games.select("key", "game"), "key", games, "n", n_rows).drop("key"))
    sources = _sources(offers, contrast)
    known = games.where(F.col("mmobomb_id").isNotNull()).select("game", F.col("mmobomb_id").alias("source"))

    # offers of one title are one target, contrast records one each
    titles = cut(sources.where("kind = 'offer'").groupBy("key").agg(F.min("id").alias("source"), F.count("*").alias("_offers"), *(F.first(c).alias(c) for c in FORM), F.mode("platform", deterministic=True).alias("platform")))
    none = [F.lit(None).cast("string").alias(c) for c in FIELDS[:-1]]
    records = sources.where("kind = 'contrast'").withColumnRenamed("id", "source").join(known, "source", "left_anti")
    wanted = ["kind", "source", "key", *FORM, *FIELDS]
    targets = titles.select(F.lit("offer").alias("kind"), "source", "key", *FORM, *none, "platform").unionByName(records.select(*wanted))
    targets = targets.select("kind", "source", *(F.col(c).alias(f"_{c}") for c in ("key", "skeleton", *FIELDS)), "marker")

    bases = games.where("mmobomb_id is null").select("game", "marker", F.explode("bases").alias("skeleton"), *FIELDS, "key")
    laid = games.select(*FORM, "tokens", *FIELDS).unionByName(bases.select(*FORM, F.array().cast("array<string>").alias("tokens"), *(F.lit(None).cast("string").alias(c) for c in FIELDS)))
    near = near_forms(laid, sources)

    whole = games.select("game", "mmobomb_id", "key", *FORM, *FIELDS).join(near, FORM).join(targets, ["_skeleton", "marker"])
    whole = whole.where("kind = 'offer' and not damaged or kind = 'contrast' and mmobomb_id is null").drop("mmobomb_id")
    ours = bases.withColumn("_support", F.explode(_support_keys(True))).join(near.where("not damaged"), FORM)
    theirs = records.select(*(F.col(c).alias(f"_{c}") for c in ("key", "skeleton", *FIELDS)), "marker", "source", F.explode(_support_keys(False)).alias("_support"))
    short = ours.join(theirs, ["_skeleton", "marker", "_support"]).withColumn("kind", F.lit("contrast"))
    names = ["kind", "game", "source", "key", "_key", "title", "damaged", *FIELDS, *(f"_{c}" for c in FIELDS)]
    pairs = whole.select(*names, F.lit(False).alias("short")).unionByName(short.select(*names, F.lit(True).alias("short")))
    title = F.when(F.col("short"), F.col("title") * 0.85).otherwise(F.col("title"))
    alike = {
        "title": title,
        "publisher": company_similarity(F.col("publisher"), F.col("_publisher")),
        "developer": company_similarity(F.col("developer"), F.col("_developer")),
        "day": day_similarity(F.col("day"), F.col("_day")),
        "genre": F.when(F.col("genre").isNotNull() & F.col("_genre").isNotNull(), F.when(F.col("genre") == F.col("_genre"), 1.0).otherwise(0.4)),
    }
    of_offer = {"title": title, "spelling": spelling_similarity(F.col("key"), F.col("_key")), "platform": overlap_similarity(F.col("platform"), F.col("_platform"))}
    confidence = F.round(F.when(F.col("kind") == "offer", weighted(of_offer)).otherwise(weighted(alike)), 6)
    scored = pairs.select("kind", "game", "source", "title", "short", "damaged", (F.col("key") == F.col("_key")).alias("same"), confidence.alias("confidence"), alike["day"].alias("_day"), F.greatest(alike["publisher"], alike["developer"]).alias("_by"))
    # a shortened title needs the same day, or where a day is missing, the same company; a damaged one both
    supported = (F.col("_day") >= 0.7) | (F.col("_day").isNull() & (F.col("_by") >= 0.8) & (F.col("confidence") >= LEAST_SHORTENED))
    both = (F.col("_day") >= 0.7) & (F.col("_by") >= 0.8)
    good = F.when(F.col("kind") == "offer", True).when(F.col("damaged"), both).when(F.col("short"), supported).otherwise(F.col("confidence") >= LEAST)
    scored = cut(scored.where(F.coalesce(good, F.lit(False))).select("kind", "game", "source", "title", "short", "same", "confidence"))

    # offers: many to one game
    best = scored.where("kind = 'offer'").groupBy("source").agg(F.max(F.struct("same", "title", "confidence", (-F.col("game")).alias("g"))).alias("b"))
    by_title = titles.select("key", "source").join(best, "source").select("key", (-F.col("b.g")).alias("game"), F.col("b.confidence").alias("confidence"))
    offer_rows = sources.where("kind = 'offer'").select("id", "key")
    n_offers = max(1, titles.agg(F.sum("_offers").alias("n")).first()["n"] or 0)
    linked = members.where(F.col("gamerpower_id").isNotNull()).select("game", F.col("gamerpower_id").alias("id")).distinct().join(offer_rows.select("id"), "id", "left_semi")
    found = join_large_small(offer_rows.join(linked.select("id"), "id", "left_anti"), by_title, "key", titles, "_offers", n_offers).select("game", "id", "confidence")
    offer_games = found.unionByName(linked.select("game", "id", F.lit(1.0).alias("confidence")))
    from_offers = join_large_small(members.where("gamerpower_id is null"), offer_games, "game", games, "n", n_rows).select("row_id", F.col("id").alias("source_id"), "confidence")

    # contrast records: one to one; a whole title counts before a shortened one
    edges = scored.where("kind = 'contrast'").groupBy("source", "game").agg(F.max(F.struct((~F.col("short")).alias("whole"), "confidence")).alias("b"))
    matched = assign(edges.select("source", "game", F.col("b.confidence").alias("confidence")), "source", "game", "confidence")
    matched = matched.select("game", "source", "confidence").unionByName(known.select("game", "source", F.lit(1.0).alias("confidence")))
    from_contrast = join_large_small(members.where("mmobomb_id is null"), matched, "game", games, "n", n_rows).select("row_id", F.col("source").alias("source_id"), "confidence")
    return from_offers.unionByName(from_contrast)
