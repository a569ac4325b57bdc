"""Gazetteer resolution and map tables.

A gazetteer is a DataFrame of name, lat, lon, country, population and alt_list. Places
are resolved once per distinct name and joined back.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hopweave.functions import fuzzy
from hopweave.functions import text as T
from hopweave.sources.shared import written


def prepared(gazetteer: DataFrame) -> DataFrame:
    """A gazetteer with its keys: name_norm, and bucket (the key's first letter)."""
    key = T.place_key(F.col("name"))
    return gazetteer.withColumns({"name_norm": key, "bucket": F.substring(key, 1, 1)})


def attach(df: DataFrame, place: str, gazetteer: DataFrame) -> DataFrame:
    """df with lat and lon of the gazetteer's row of the same trimmed lower-case name, the most populous one."""
    w = W.partitionBy("__k").orderBy(F.desc_nulls_last("population"), "lat", "lon")
    best = gazetteer.withColumn("__k", F.lower(F.trim("name"))).withColumn("__n", F.row_number().over(w)).where("__n = 1").select("__k", "lat", "lon")
    return df.withColumn("__k", F.lower(F.trim(place))).join(best, "__k", "left").drop("__k")


def with_uploaded(df: DataFrame, place: str, uploaded: DataFrame) -> DataFrame:
    """lat and lon, from df where it has them, else from an uploaded table of location, lat, lon; the least of several rows of a location."""
    one = uploaded.where("lat IS NOT NULL AND lon IS NOT NULL").groupBy(F.col("location").alias(place)).agg(F.min(F.struct("lat", "lon")).alias("__up"))
    return df.join(one, place, "left").withColumns({"lat": F.coalesce("lat", "__up.lat"), "lon": F.coalesce("lon", "__up.lon")}).drop("__up")


def match_report(df: DataFrame, found: str = "lat") -> DataFrame:
    """One row: total, matched, unmatched and rate."""
    n, m = F.count("*"), F.count(found)
    return df.agg(n.alias("total"), m.alias("matched"), (n - m).alias("unmatched"), F.when(n > 0, m / n).otherwise(0.0).alias("rate"))


def resolve_exact_alias(places: DataFrame, place: str, gazetteer: DataFrame) -> DataFrame:
    """place, lat, lon, how: by the normalised name, else by an alias; ties by population, then name."""
    g = prepared(gazetteer)
    names = places.select(place).where(F.col(place).isNotNull()).distinct().withColumn("k", T.place_key(F.col(place)))
    exact = g.select(F.col("name_norm").alias("k"), F.lit(0).alias("stage"), "name", "lat", "lon", "population")
    alias = g.select(F.explode("alt_list").alias("a"), "name", "lat", "lon", "population").select(T.place_key(F.col("a")).alias("k"), F.lit(1).alias("stage"), "name", "lat", "lon", "population")
    w = W.partitionBy(place).orderBy("stage", F.desc_nulls_last("population"), "name")
    best = names.join(exact.unionAll(alias), "k").withColumn("n", F.row_number().over(w)).where("n = 1")
    return best.select(place, "lat", "lon", F.when(F.col("stage") == 0, "exact").otherwise("alias").alias("how"))


def _grams(key: Column) -> Column:
    """Pairs of adjacent letters of the sorted words of a key, in one pass; a single letter for itself."""
    words = F.array_join(F.array_sort(F.split(key, " ")), " ")
    pairs = F.regexp_extract_all(words, F.lit("(?s)(?=(..))"), F.lit(1))
    return F.when(F.length(key) > 1, F.array_distinct(pairs)).otherwise(F.array(key))


def similar_candidates(left: DataFrame, right: DataFrame, cutoff: float, by: tuple[str, ...] = (), words: bool = True) -> DataFrame:
    """Pairs of rows of left (k, ...) and right (name_norm, ...) that may reach a ratio: they share a word, or one of the rarest letter pairs of either.

    A ratio of c percent changes so few letters that of the distinct letter pairs of a
    text at most 4 (1 - c / 100) / c * 100 in a hundred, and one, can be lost; so of any
    such number and one more, one is shared. Rarest pairs make few candidates. What is
    nearly a part of the other shares the rarest pairs of the shorter text.

    by: columns of both sides that must be equal; they are part of the keys that are
    joined, so texts meet within a country or a first letter only, and how rare a letter
    pair is counts there. Without words, pairs for the plain ratio only: texts that share
    a common word and little else are not paired.
    """
    share = 4 * (1 - cutoff / 100) / (cutoff / 100)
    l, r = left.withColumn("__g", _grams(F.col("k"))), right.withColumn("__g", _grams(F.col("name_norm")))
    often = r.select(*by, "name_norm", F.explode("__g").alias("g")).distinct().groupBy(*by, "g").agg(F.count("*").alias("n"))

    def rarest(rows: DataFrame, key: str) -> DataFrame:
        each = rows.select(*by, key, F.size("__g").alias("s"), F.explode("__g").alias("g")).distinct().join(often, [*by, "g"], "left")
        order = W.partitionBy(*by, key).orderBy(F.coalesce("n", F.lit(0)), "g")
        return each.withColumn("i", F.row_number().over(order)).where(F.col("i") <= F.ceil(F.col("s") * share) + 2).select(*by, key, "g")

    every = lambda rows, key: rows.select(*by, key, F.explode("__g").alias("g")).distinct()
    on = [*by, "g"]
    pairs = rarest(l, "k").join(every(r, "name_norm"), on).unionByName(every(l, "k").join(rarest(r, "name_norm"), on))
    if words:
        parts = lambda rows, key: rows.select(*by, key, F.explode(F.split(key, " ")).alias("g")).distinct()
        pairs = pairs.unionByName(parts(l, "k").join(parts(r, "name_norm"), on))
    return left.join(pairs.select(*by, "k", "name_norm").distinct(), [*by, "k"]).join(right, [*by, "name_norm"])


def best_match(scored: DataFrame, place: str, how: str) -> DataFrame:
    """place, lat, lon, how, score of the best candidate; ties by population, then name."""
    w = W.partitionBy(place).orderBy(F.desc("score"), F.desc_nulls_last("population"), "name", "lat", "lon")
    return scored.withColumn("n", F.row_number().over(w)).where("n = 1").select(place, "lat", "lon", F.lit(how).alias("how"), "score")


def resolve_fuzzy(places: DataFrame, place: str, gazetteer: DataFrame, cutoff: float = 88.0) -> DataFrame:
    """place, lat, lon, how, score: exact, alias, then the most similar name (weighted ratio) of the same first letter, or of all names if the letter has none."""
    g = prepared(gazetteer)
    names = places.select(place).where(F.col(place).isNotNull()).distinct()
    first = resolve_exact_alias(places, place, gazetteer).withColumn("score", F.lit(100.0))
    rest = names.join(first, place, "left_anti").withColumn("k", T.place_key(F.col(place))).withColumn("b", F.substring("k", 1, 1)).where("k <> ''")
    rest = rest.join(g.select(F.col("bucket").alias("b"), F.lit(True).alias("__some")).distinct(), "b", "left")
    rest = rest.select(place, "k", F.when(F.col("__some"), F.col("b")).otherwise("").alias("__by"))
    right = g.select("name_norm", "name", "lat", "lon", "population", F.explode(F.array("bucket", F.lit(""))).alias("__by"))
    cand = similar_candidates(rest, right, cutoff, ("__by",))
    scored = cand.withColumn("score", fuzzy.weighted_ratio("k", "name_norm")).where(F.col("score") >= cutoff)
    return first.unionByName(best_match(scored, place, "fuzzy"))


def resolve_in_country(places: DataFrame, place: str, gazetteer: DataFrame, cutoff: float = 84.0) -> DataFrame:
    """place, lat, lon, score: the most similar name in the country after the comma, with a bonus of min(0.05, population / 5e7)."""
    head = F.regexp_replace(F.col(place), ",[^,]*$", "")
    rows = places.select(place).distinct().withColumn("country_key", T.country_hint(F.col(place))).where("country_key IS NOT NULL").withColumn("k", T.place_key(head))
    g = prepared(gazetteer).withColumn("country_key", T.place_key(F.col("country")))
    bonus = F.least(F.lit(0.05), F.coalesce("population", F.lit(0)) / 5e7) * 100
    cand = similar_candidates(rows, g.select("country_key", "name_norm", "name", "lat", "lon", "population"), cutoff - 5, ("country_key",), words=False)
    scored = cand.withColumn("score", fuzzy.ratio("k", "name_norm") + bonus).where(F.col("score") >= cutoff)
    return best_match(scored, place, "country").drop("how")


def country_code(key: Column, names: dict[str, str] | None = None) -> Column:
    """A two-letter word of a place's key, else the code of a country that the key, or one of its words, names."""
    words = F.split(key, " ")
    code = F.upper(F.try_element_at(F.filter(words, lambda w: (F.length(w) == 2) & w.rlike("^\\p{L}{2}$")), F.lit(1)))
    if not names:
        return code
    table = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    word = F.try_element_at(F.filter(F.transform(words, lambda w: table[w]), lambda x: x.isNotNull()), F.lit(1))
    return F.coalesce(code, table[key], word)


def resolve_locations(places: DataFrame, place: str, gazetteer: DataFrame, tables: list[DataFrame] = (), countries: dict[str, str] | None = None, in_country: float = 84.0, anywhere: float = 90.0) -> DataFrame:
    """place, lat, lon, how: the first stage that finds a place.

    lookup: tables of location, lat, lon, the first that has the name; exact: the
    normalised name; country: the most similar `name country` of the country that the
    text hints at (words as sets, in_country or more); fuzzy: the most similar name of all
    (anywhere or more); centroid: the country's most populous place. Each stage works on
    the distinct places that the stages before left over.
    """
    g = prepared(gazetteer).withColumn("code", F.upper(F.col("country")))
    g = g.withColumn("with_country", F.when(F.coalesce("country", F.lit("")) != "", F.concat_ws(" ", "name_norm", F.lower("country"))).otherwise(F.col("name_norm")))
    left = places.select(place).where(F.col(place).isNotNull()).distinct().withColumn("k", T.place_key(F.col(place))).where("k <> ''")
    left = left.withColumn("cc", country_code(F.col("k"), countries))
    found = []

    def take(rows: DataFrame, how: str) -> None:
        nonlocal left
        rows = written(rows.select(place, "lat", "lon", F.lit(how).alias("how")), how)  # once, for the result and for what is left
        found.append(rows)
        left = left.join(rows.select(place), place, "left_anti")

    if tables:
        named = [t.select(F.col("location").alias("name"), "lat", "lon") for t in tables]
        take(resolve_tables(left, place, named), "lookup")
    names = g.select("name_norm", "with_country", "code", "name", "lat", "lon", "population")
    exact = left.join(names, left["k"] == names["name_norm"]).withColumn("score", F.lit(100.0))
    take(best_match(exact, place, "exact"), "exact")
    here = similar_candidates(left.where("cc IS NOT NULL"), names.withColumn("name_norm", F.col("with_country")).withColumnRenamed("code", "cc"), in_country, ("cc",))
    take(best_match(here.withColumn("score", fuzzy.token_set_ratio("k", "name_norm")).where(F.col("score") >= in_country), place, "country"), "country")
    all_of = similar_candidates(left, names, anywhere).withColumn("score", fuzzy.token_set_ratio("k", "name_norm"))
    take(best_match(all_of.where(F.col("score") >= anywhere), place, "fuzzy"), "fuzzy")
    take(left.join(largest_city(g.withColumn("country", F.col("code"))).withColumnRenamed("country", "cc"), "cc"), "centroid")
    return reduce(DataFrame.unionAll, found)


#: Largest bonus of a populous place, and the ratios by which tokens without a certain best name are looked up, one after the other.
BONUS, RATIOS = 0.05, (75.0, 45.0)


def _best_names(asked: DataFrame, names: DataFrame) -> DataFrame:
    """asked (line, pos, token, k, by) with the best of names (name_norm, by, ...) for each line, by the library's ratio and a bonus.

    Names of a ratio or more are found by letter pairs (the ratio is at most that of the
    longest common subsequence). A best name that no other can beat, since all others lie
    below that ratio, settles its line; other lines are looked up by a lower ratio. Lines
    without any similar name are compared with all names in question.
    """
    bonus = F.least(F.lit(BONUS), F.coalesce("population", F.lit(0)) / 5e7)
    order = W.partitionBy("line").orderBy(F.desc("score"), "pos", "name", "lat", "lon")

    def best(pairs: DataFrame) -> DataFrame:
        rows = pairs.withColumn("score", fuzzy.matcher_ratio("k", "name_norm") / 100 + bonus).where("score > 0")
        return rows.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")

    settled, names = [], written(names, "names")
    for ratio in RATIOS:
        found = written(best(similar_candidates(asked, names, ratio, ("by",), words=False)), "best")
        sure = found.where(F.col("score") > ratio / 100 + BONUS)
        settled.append(sure)
        asked = written(asked.join(sure.select("line"), "line", "left_anti"), "asked")
    return reduce(DataFrame.unionByName, [*settled, best(asked.join(names, "by"))])


def gazetteer_from_tokens(lines: DataFrame, gazetteer: DataFrame, column: str = "value") -> DataFrame:
    """name, lat, lon, country, population, source_tokens, matched_from, score: places of lines such as ['Khartoum' 'Sudan'].

    Tokens that are names of countries restrict the others to these countries. The most
    similar name (the library's ratio and a bonus of min(0.05, population / 5e7)) of any
    token stands for the line; a token is compared with the names of its first letter, or
    with all names (of the line's countries together) where none has it. Of lines with
    the same place and country the first in order of tokens stays.
    """
    inside = F.regexp_extract(F.col(column), "\\[(.*?)\\]", 1)
    quoted = F.regexp_extract_all(inside, F.lit("['\"]([^'\"]+)['\"]"), F.lit(1))
    words = F.when(F.size(quoted) > 0, quoted).otherwise(F.split(inside, "\\s+"))
    tokens = F.filter(F.transform(words, lambda w: F.trim(F.regexp_replace(w, "\\s+", " "))), lambda w: w != "")
    rows = lines.select(tokens.alias("tokens")).where("size(tokens) > 0").distinct().withColumn("line", F.array_join("tokens", " | "))
    g = prepared(gazetteer.where("lat IS NOT NULL AND lon IS NOT NULL")).select("name", "name_norm", "bucket", "lat", "lon", "country", "population")
    each = rows.select("line", F.posexplode("tokens").alias("pos", "token"))
    known = g.select(F.col("country").alias("token"), F.lit(True).alias("is_country")).where("token <> ''").distinct()
    each = written(each.join(known, "token", "left"), "tokens")
    limits = each.where("is_country").select("line", F.col("token").alias("only")).distinct()
    asked = each.where("is_country IS NULL").withColumn("k", T.place_key(F.col("token"))).where("k <> ''").withColumn("first", F.substring("k", 1, 1))
    asked = asked.join(limits, "line", "left").withColumn("only", F.coalesce("only", F.lit("")))  # a row for each country
    letters = g.select(F.explode(F.array(F.col("country"), F.lit(""))).alias("only"), F.col("bucket").alias("first")).where("only IS NOT NULL").distinct()
    here = asked.join(letters.withColumn("__some", F.lit(1)), ["only", "first"], "left")
    some = F.max("__some").over(W.partitionBy("line", "pos")).isNotNull()  # in any of the line's countries
    asked = here.withColumn("some", some).select("line", "pos", "token", "k", F.struct("only", F.when(F.col("some"), F.col("first")).otherwise("").alias("letter")).cast("string").alias("by"))
    keys = [F.struct(c.alias("only"), x.alias("letter")).cast("string") for c in (F.col("country"), F.lit("")) for x in (F.col("bucket"), F.lit(""))]
    names = g.select("*", F.explode(F.array_distinct(F.array(*keys))).alias("by")).join(asked.select("by").distinct(), "by", "left_semi")
    best = _best_names(asked, names)
    once = W.partitionBy("name", "country").orderBy("line")
    best = best.withColumn("n", F.row_number().over(once)).where("n = 1")
    return best.select("name", "lat", "lon", "country", "population", F.col("line").alias("source_tokens"), F.col("token").alias("matched_from"), F.round("score", 3).alias("score"))


def resolve_tables(places: DataFrame, place: str, tables: list[DataFrame]) -> DataFrame:
    """place, lat, lon: from explicit tables of name, lat, lon, the first table that has the name."""
    ranked = reduce(DataFrame.unionAll, [t.select(T.place_key(F.col("name")).alias("k"), "lat", "lon", F.lit(i).alias("r")) for i, t in enumerate(tables)])
    w = W.partitionBy(place).orderBy("r", "lat", "lon")
    found = places.select(place).distinct().withColumn("k", T.place_key(F.col(place))).join(ranked, "k")
    return found.withColumn("n", F.row_number().over(w)).where("n = 1").select(place, "lat", "lon")


def largest_city(gazetteer: DataFrame) -> DataFrame:
    """country, name, lat, lon of the most populous place."""
    best = F.max_by(F.struct("name", "lat", "lon"), F.struct(F.coalesce("population", F.lit(-1)), "name"))
    return gazetteer.groupBy("country").agg(best.alias("b")).select("country", "b.name", "b.lat", "b.lon")


def place_counts(df: DataFrame, places: Column, gazetteer: DataFrame) -> DataFrame:
    """name, n, lat, lon: occurrences of places in lists."""
    n = df.select(F.explode(places).alias("name")).where(F.trim("name") != "").groupBy("name").agg(F.count("*").alias("n"))
    return attach(n.withColumnRenamed("name", "place"), "place", gazetteer).withColumnRenamed("place", "name")


def place_edges(df: DataFrame, subject: str, place: str, order: str) -> DataFrame:
    """place, incoming, outgoing: moves to and from each place."""
    w = W.partitionBy(subject).orderBy(order)
    steps = df.select(F.col(place).alias("b"), F.lag(place).over(w).alias("a")).where("a IS NOT NULL AND b IS NOT NULL")
    ends = steps.select(F.col("b").alias("place"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionAll(steps.select("a", F.lit(0), F.lit(1)))
    return ends.groupBy("place").agg(F.sum("i").alias("incoming"), F.sum("o").alias("outgoing"))


def timed_segments(df: DataFrame, subject: str, place: str, order: str, days: Column, gazetteer: DataFrame, start: Column, default: float = 1.0) -> DataFrame:
    """subject, a, b, t0, t1: segments with start and end times.

    The clock of a subject runs on by the days of the departing row, but only over
    segments of which both ends are in the gazetteer; others are left out.
    """
    w = W.partitionBy(subject).orderBy(order)
    rows = attach(df.withColumn("__d", F.coalesce(days.cast("double"), F.lit(default))), place, gazetteer)
    seg = rows.select(subject, order, F.col(place).alias("a"), F.lead(place).over(w).alias("b"), "__d", F.col("lat").alias("lat_a"), F.lead("lat").over(w).alias("lat_b"), start.alias("__start"))
    both = F.col("lat_a").isNotNull() & F.col("lat_b").isNotNull() & F.col("b").isNotNull()
    till = F.sum(F.when(both, F.col("__d")).otherwise(0.0)).over(w.rowsBetween(W.unboundedPreceding, 0))
    seg = seg.withColumn("till", till).where(both)
    when = lambda x: F.timestamp_micros((F.unix_micros("__start") + x * F.lit(86_400_000_000)).cast("long"))
    return seg.select(subject, F.col(order).alias("step"), "a", "b", when(F.col("till") - F.col("__d")).alias("t0"), when(F.col("till")).alias("t1"))


def has_lists(df: DataFrame, places: str) -> bool:
    """Whether any row of an upload holds two places or more, so that its rows are whole ways and not hops; it is read until one is found."""
    return not df.where(F.size(places) >= 2).isEmpty()


def list_segments(df: DataFrame, subject: str, places: str, days: str, gazetteer: DataFrame, start: Column, default: float = 1.0) -> DataFrame:
    """subject, step, a, b, lat_a, lon_a, lat_b, lon_b, t0, t1: hops of lists of places, one list a row.

    Days are those of the hops if there is one for each hop, or one for each place (the
    last is left out); any other number of days counts as none, and every hop takes the
    default. The clock runs on over hops of which both ends are in the gazetteer; others
    are left out.
    """
    n = F.size(places)
    fits = (F.size(days) == n - 1) | (F.size(days) == n)
    hop = lambda i: F.struct((i + 1).alias("step"), F.get(places, i).alias("a"), F.get(places, i + 1).alias("b"), F.when(fits, F.get(F.col(days), i).cast("double")).otherwise(F.lit(default)).alias("d"))
    rows = df.where(n >= 2).withColumns({"__r": F.monotonically_increasing_id(), "__start": start}).select(subject, "__r", "__start", F.explode(F.transform(F.sequence(F.lit(0), n - 2), hop)).alias("__s")).select(subject, "__r", "__start", "__s.*")
    at = lambda rows, end: attach(rows, end, gazetteer).withColumnsRenamed({"lat": f"lat_{end}", "lon": f"lon_{end}"})
    found = at(at(rows, "a"), "b").where("lat_a IS NOT NULL AND lat_b IS NOT NULL")
    till = F.sum("d").over(W.partitionBy(subject, "__r").orderBy("step").rowsBetween(W.unboundedPreceding, 0))
    when = lambda x: F.timestamp_micros((F.unix_micros("__start") + x * F.lit(86_400_000_000)).cast("long"))
    return found.withColumn("till", till).select(subject, "step", "a", "b", "lat_a", "lon_a", "lat_b", "lon_b", when(F.col("till") - F.col("d")).alias("t0"), when(F.col("till")).alias("t1"))


def geojson(segments: DataFrame, subject: str, coordinates: Column) -> DataFrame:
    """subject, feature: one GeoJSON line per segment as text."""
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("LineString").alias("type"), coordinates.alias("coordinates")).alias("geometry"), F.struct(F.array("t0", "t1").alias("times")).alias("properties"))
    return segments.select(subject, F.to_json(feature).alias("feature"))


def heat_points(df: DataFrame, lat: str, lon: str, n: int | None = None) -> DataFrame:
    """Points with coordinates; the first n in a hashed order if asked, for a map that can show no more."""
    rows = df.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).select(lat, lon)
    return rows if n is None else rows.orderBy(F.xxhash64(lat, lon), lat, lon).limit(n)
