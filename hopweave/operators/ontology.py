"""Subjects, visits, places and actors as RDF triples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopweave.functions.text import slug
from hopweave.sources.shared import written

# ---- fixed values: names of classes, predicates and namespaces
CLASSES = ("Victim", "Trafficker", "Chief", "Location", "Visit")
PREDICATES = ("hasSerializedId", "hasUniqueId", "hasGender", "hasNationality", "hasTrafficker", "hasChief", "hasVisit", "atLocation", "visitOrder")
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
RDF_LABEL = "http://www.w3.org/2000/01/rdf-schema#label"
RDFS_CLASS = "http://www.w3.org/2000/01/rdf-schema#Class"
GEO = "http://www.w3.org/2003/01/geo/wgs84_pos#"
XSD_INT = "http://www.w3.org/2001/XMLSchema#integer"
XSD_DOUBLE = "http://www.w3.org/2001/XMLSchema#double"


def mapping(base: str, override: dict[str, str] | None = None) -> dict[str, str]:
    """URI of every class and predicate; override replaces some of them."""
    b = base.rstrip("#/") + "#"
    found = {n: b + n for n in (*CLASSES, *PREDICATES)} | {"label": RDF_LABEL, "lat": GEO + "lat", "lon": GEO + "long"}
    return found | {k: v for k, v in (override or {}).items() if k in found}


def triples(df: DataFrame, base: str, subject: str, uid: str, place: str, order: str, perps: str, chiefs: str, gender: str, nationality: str, gazetteer: DataFrame | None = None, override: dict[str, str] | None = None) -> DataFrame:
    """s, p, o, o_kind (uri or literal), o_type: distinct triples of all rows.

    Visits, links to actors, actors, places and subjects have no triple in common unless
    override gives two predicates one name, so each kind is told apart by its own short
    keys, and URIs are made of what is left. Attributes of a subject are the most frequent
    value, the smallest of equals.
    """
    u, b = mapping(base, override), base.rstrip("#/") + "#"
    uri = lambda kind, key: F.concat(F.lit(f"{b}{kind}/"), key)

    def triple(s: Column, p: str, o: Column, kind: str = "uri", of: str = "") -> Column:
        return F.struct(s.alias("s"), F.lit(p).alias("p"), o.cast("string").alias("o"), F.lit(kind).alias("o_kind"), F.lit(of).alias("o_type"))

    def of_visit(at: Column) -> Column:
        visit = uri("visit", F.col("visit"))
        of = lambda p, o, *how: triple(visit, p, o, *how)
        return F.array(of(RDF_TYPE, F.lit(u["Visit"])), triple(uri("victim", at["v"]), u["hasVisit"], visit), of(u["atLocation"], uri("location", at["loc"])), of(u["visitOrder"], at["n"], "literal", XSD_INT))

    # read for each kind
    df = written(df.select(*dict.fromkeys((subject, uid, place, order, perps, chiefs, gender, nationality)), slug(F.col(subject)).alias("__v"), slug(F.col(place)).alias("__loc")), "rows")
    key = slug(F.concat_ws("-", F.col(subject), F.col(order).cast("string"), F.col(place)))
    visits = df.select(key.alias("visit"), F.struct(F.col("__v").alias("v"), F.col("__loc").alias("loc"), F.col(order).alias("n")).alias("at"))
    # rows of a visit meet, as a rule one; its type is one triple whatever they say
    visits = visits.groupBy("visit").agg(F.collect_set("at").alias("at")).select(F.inline(F.array_distinct(F.flatten(F.transform("at", of_visit)))))
    roles = (("Trafficker", perps), ("Chief", chiefs))
    links, names = [], []
    for kind, c in roles:
        each = df.select(F.col("__v").alias("v"), F.explode(F.col(c).cast("array<string>")).alias("x"))
        met = each.select("v", slug(F.col("x")).alias("x")).distinct()
        links.append(met.select(F.inline(F.array(triple(uri("victim", F.col("v")), u[f"has{kind}"], uri(kind.lower(), F.col("x")))))))
        names.append(each.select("x").distinct().select(F.lit(kind.lower()).alias("kind"), F.lit(u[kind]).alias("of"), "x"))
    names.append(df.select(F.col(place).cast("string").alias("x")).distinct().select(F.lit("location").alias("kind"), F.lit(u["Location"]).alias("of"), "x"))
    named = F.concat(F.lit(b), "kind", F.lit("/"), slug(F.col("x")))
    called = reduce(DataFrame.unionAll, names).select(F.inline(F.array(*(F.struct(named.alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit(k).alias("o_kind"), F.lit("").alias("o_type")) for p, o, k in ((RDF_TYPE, F.col("of"), "uri"), (u["label"], F.col("x"), "literal"))))))
    v = uri("victim", slug(F.col(subject)))
    one = df.groupBy(subject).agg(*(F.mode(c, True).alias(c) for c in (uid, gender, nationality)))
    of_subject = F.array(
        triple(v, RDF_TYPE, F.lit(u["Victim"])), triple(v, u["hasSerializedId"], F.col(subject), "literal"),
        *(triple(v, u[p], F.col(c), "literal") for p, c in (("hasUniqueId", uid), ("hasGender", gender), ("hasNationality", nationality))),
    )
    classes = df.sparkSession.range(1).select(F.inline(F.array(*(triple(F.lit(u[c]), RDF_TYPE, F.lit(RDFS_CLASS)) for c in CLASSES))))
    few = [classes, one.select(F.inline(of_subject)), called]
    if gazetteer is not None:
        found = df.select(place).distinct().join(gazetteer.select(F.col("name").alias(place), "lat", "lon"), place)
        few.append(found.select(F.inline(F.array(*(triple(uri("location", slug(F.col(place))), u[c], F.col(c), "literal", XSD_DOUBLE) for c in ("lat", "lon"))))))
    out = reduce(DataFrame.unionAll, [reduce(DataFrame.unionAll, few).distinct(), visits, *links]).where("s IS NOT NULL AND o IS NOT NULL AND o <> ''")
    return out.distinct() if override else out


def union(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionAll, frames).distinct()


def n_triples(rows: DataFrame) -> DataFrame:
    """line: each triple as an N-Triples statement, which is Turtle as well."""
    esc = F.regexp_replace(F.regexp_replace(F.regexp_replace("o", "\\\\", "\\\\\\\\"), '"', '\\\\"'), "\\n", "\\\\n")
    literal = F.concat(F.lit('"'), esc, F.lit('"'), F.when(F.col("o_type") != "", F.concat(F.lit("^^<"), "o_type", F.lit(">"))).otherwise(""))
    o = F.when(F.col("o_kind") == "uri", F.concat(F.lit("<"), "o", F.lit(">"))).otherwise(literal)
    return rows.select(F.concat(F.lit("<"), "s", F.lit("> <"), "p", F.lit("> "), o, F.lit(" .")).alias("line"))


#: A statement of N-Triples.
STATEMENT = '^\\s*<([^>]*)>\\s+<([^>]*)>\\s+(?:<([^>]*)>|"((?:[^"\\\\]|\\\\.)*)"(?:\\^\\^<([^>]*)>)?(?:@\\S+)?)\\s*\\.\\s*$'


def unread_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Lines that parse_n_triples() does not read: those that are no statement, blank or a comment."""
    return lines.where(~F.col(column).rlike(STATEMENT) & ~F.col(column).rlike("^\\s*(#.*)?$"))


def parse_n_triples(lines: DataFrame, column: str = "value") -> DataFrame:
    """Triples of N-Triples lines; unread_lines() has the lines that are none."""
    c = F.col(column)
    g = lambda n: F.regexp_extract(c, STATEMENT, n)
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(g(4), "\\\\n", "\n"), '\\\\"', '"'), "\\\\\\\\", "\\\\")
    rows = lines.where(c.rlike(STATEMENT))
    return rows.select(g(1).alias("s"), g(2).alias("p"), F.when(g(3) != "", g(3)).otherwise(text).alias("o"), F.when(g(3) != "", "uri").otherwise("literal").alias("o_kind"), g(5).alias("o_type"))
