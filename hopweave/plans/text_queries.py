"""Queries of the text functions, over messy columns that are built alike in both engines."""

from __future__ import annotations

from pyspark.sql import functions as F

from hopweave.functions import fuzzy
from hopweave.functions import text as T
from hopweave.plans.register import query
from hopweave.plans.views import table

#: Messy inputs of a customer, in SQL that both engines read alike.
RAW = {
    "gender": "CASE c_custkey % 8 WHEN 0 THEN 'a male' WHEN 1 THEN 'M/F' WHEN 2 THEN 'boy' WHEN 3 THEN 'n/a' WHEN 5 THEN ' Woman ' WHEN 6 THEN 'female, adult' WHEN 7 THEN c_mktsegment END",
    "nat": "CASE c_custkey % 8 WHEN 0 THEN 'eritrea region' WHEN 1 THEN 'from Sudan' WHEN 2 THEN 'UK of aMERica' WHEN 3 THEN 'nowhere' WHEN 5 THEN 'ITALY' WHEN 6 THEN 'afghani' WHEN 7 THEN c_name END",
    "duration": "CASE c_custkey % 13 WHEN 0 THEN '3 days' WHEN 1 THEN '2 weeks' WHEN 2 THEN '1 month 2 weeks' WHEN 3 THEN '2 months 3 days' WHEN 4 THEN '3/4 days' WHEN 5 THEN '2-3 days' WHEN 6 THEN '2.5 weeks' WHEN 7 THEN '48 hours' WHEN 8 THEN '1 year' WHEN 9 THEN '7' WHEN 10 THEN '12.7' WHEN 11 THEN (c_custkey % 40) || ' Days and ' || (c_custkey % 5) || ' Weeks' END",
    "people": "CASE c_custkey % 7 WHEN 0 THEN 'Ali, Omar and Ali' WHEN 1 THEN 'no' WHEN 2 THEN 'Walid -> Boss; none' WHEN 3 THEN c_name || ' / ' || c_mktsegment WHEN 5 THEN '  \"Abu  Salam\"  ' WHEN 6 THEN 'The Guard met Medhanie & Kidane | IOM' END",
    "places": "CASE c_custkey % 7 WHEN 0 THEN '[' || chr(39) || 'A' || chr(39) || ' ' || chr(39) || 'B c' || chr(39) || ']' WHEN 1 THEN '[A, B]' WHEN 2 THEN '[A B]' WHEN 3 THEN 'X  (Y)' WHEN 4 THEN '' WHEN 6 THEN c_name || ';' || c_mktsegment || ';' || lower(c_mktsegment) END",
    "coord": "CASE c_custkey % 8 WHEN 0 THEN '328.966.720' WHEN 1 THEN '35,6895' WHEN 2 THEN '-11.019.081' WHEN 3 THEN 'N/A' WHEN 4 THEN '1234.5' WHEN 5 THEN 'approx 32.5 N' WHEN 7 THEN '' || (c_custkey % 180) END",
    "dated": "CASE c_custkey % 5 WHEN 0 THEN 'left in 2017 or 2018' WHEN 1 THEN 'in ' || (1990 + c_custkey % 40) WHEN 2 THEN 'abc' WHEN 3 THEN '12017' END",
}


def raw(spark, d):
    return table(spark, d, "customer").selectExpr("c_custkey AS k", *(f"{e} AS {n}" for n, e in RAW.items()))


def with_raw(sql: str) -> str:
    return "WITH raw AS (SELECT c_custkey AS k, " + ", ".join(f"{e} AS {n}" for n, e in RAW.items()) + f" FROM customer) {sql}"


def one(name: str, f, sql: str) -> None:
    """Registers k, out of a Column expression over raw()."""
    query(name, with_raw(f"SELECT k, {sql} AS out FROM raw"))(lambda spark, d: raw(spark, d).select("k", f().alias("out")))


def joined(c):
    return F.array_join(c, "|")


# ---- parts of the SQL side

_STRIP = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
_TXT = lambda x: f"coalesce({x}, '')"
_CLEAN = lambda x: f"regexp_replace(regexp_replace({_STRIP(_TXT(x))}, '\\s+', ' ', 'g'), '^[\"'']+|[\"'']+$', '', 'g')"
_CAP = lambda x: f"(upper({x}[1]) || lower({x}[2:]))"
_CAPS_KEPT = lambda x: f"trim(array_to_string(list_transform(string_split({_CLEAN(x)}, ' '), lambda w: CASE WHEN length(w) <= 4 AND upper(w) = w AND lower(w) <> w THEN w ELSE {_CAP('w')} END), ' '))"
_IN = lambda values: "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"
_MAP = lambda x, t: f"CASE {x} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in t.items()) + " END"
_UNIQ = lambda x: f"list_filter({x}, lambda p, i: list_position({x}, p) = i)"
_UNIQ_LOWER = lambda x: f"list_filter({x}, lambda p, i: list_position(list_transform({x}, lambda q: lower(q)), lower(p)) = i)"
_BAR = lambda x: f"array_to_string({x}, '|')"
_SEP = "\\s*(?:,|;|/|&|\\b[aA][nN][dD]\\b|\\||–|—|→|->|=>| [tT][oO] )\\s*"

one("clean_text", lambda: T.clean_text(F.col("people")), _CLEAN("people"))
one("split_list", lambda: joined(T.split_list(F.col("people"))), _BAR(f"list_filter(list_transform(string_split_regex({_CLEAN('people')}, '{_SEP}'), lambda p: trim(p)), lambda p: p <> '' AND lower(p) NOT IN {_IN(T.LIST_BLANKS)})"))
one("titlecase_caps", lambda: T.titlecase_keep_caps(F.col("nat")), _CAPS_KEPT("nat"))
one("standardize_nationality", lambda: T.standardize_nationality(F.col("nat")), f"coalesce({_MAP('lower(' + _CLEAN('nat') + ')', T.NATIONALITIES)}, {_CAPS_KEPT('nat')})")
one("standardize_gender", lambda: T.standardize_gender(F.col("gender")), f"CASE WHEN {_TXT('gender')} = '' THEN '' ELSE coalesce({_MAP('lower(' + _CLEAN('gender') + ')', T.GENDERS)}, array_to_string(list_transform(regexp_extract_all(gender, '[A-Za-z]+|[^A-Za-z]+'), lambda w: {_CAP('w')}), '')) END")
one("standardize_location", lambda: T.standardize_location(F.concat(F.lit(" ."), F.col("nat"), F.lit(" ."))), _CAPS_KEPT("regexp_replace(" + _CLEAN("' .' || nat || ' .'") + ", '^[ .]+|[ .]+$', '', 'g')"))
one("smart_blank", lambda: T.smart_blank(F.when(F.col("k") % 3 == 0, " NaN ").otherwise(F.col("people"))), f"CASE WHEN k % 3 = 0 OR lower({_STRIP(_TXT('people'))}) IN {_IN(T.BLANKS)} THEN '' ELSE {_STRIP(_TXT('people'))} END")
_G = f"lower({_STRIP(_TXT('gender'))})"
one("gender_norm", lambda: T.normalize_gender(F.col("gender")), f"CASE WHEN {_G} IN {_IN(T.GENDER_BLANKS)} THEN 'Unknown' WHEN {_G} IN {_IN(T.FEMALE)} THEN 'Female' WHEN {_G} IN {_IN(T.MALE)} THEN 'Male' WHEN regexp_matches({_G}, '\\bf(emale)?\\b') THEN 'Female' WHEN regexp_matches({_G}, '\\bm(ale)?\\b') THEN 'Male' ELSE 'Unknown' END")
one("gender_lower", lambda: T.gender_lower(F.col("gender")), f"CASE WHEN {_G} LIKE 'f%' THEN 'female' WHEN {_G} LIKE 'm%' THEN 'male' ELSE 'unknown' END")
_W = "regexp_extract_all(trim(coalesce(nat, '')), '[A-Za-z]+')"
one(
    "nationality_norm",
    lambda: T.normalize_nationality(F.col("nat")),
    f"CASE WHEN trim(coalesce(nat, '')) = '' THEN '' ELSE coalesce(list_filter(list_transform({_W}, lambda w: {_MAP('lower(w)', T.DEMONYMS)}), lambda x: x IS NOT NULL)[1], list_filter({_W}, lambda w: regexp_full_match(w, '[A-Z][a-z]+'))[1], {_CAP('trim(nat)')}) END",
)
one("nationality_or_unknown", lambda: T.nationality_or_unknown(F.col("nat")), f"CASE WHEN trim(coalesce(nat, '')) = '' THEN 'Unknown' ELSE {_CAP('trim(nat)')} END")
_PERSONS = _IN(T.NOT_PERSONS)
one("location_tokens", lambda: joined(T.location_tokens(F.col("people"))), _BAR(_UNIQ("list_filter(regexp_extract_all(coalesce(people, ''), '[A-Za-z]+'), lambda w: regexp_full_match(w, '[A-Z][a-z]+'))")))
one("person_tokens", lambda: joined(T.person_tokens(F.col("people"))), _BAR(_UNIQ(f"list_filter(regexp_extract_all(coalesce(people, ''), '[A-Za-z]+'), lambda w: regexp_full_match(w, '[A-Z][a-z]+') AND lower(w) NOT IN {_PERSONS})")))
one("compact_time", lambda: T.compact_time(F.col("duration")), "array_to_string(list_filter(regexp_extract_all(lower(coalesce(duration, '')), '[a-z]+|[0-9]+'), lambda t: t <> 'and'), '_')")
one("extract_year", lambda: T.extract_year(F.col("dated")), "TRY_CAST(nullif(regexp_extract(coalesce(dated, ''), '\\b((19|20)[0-9]{2})\\b', 1), '') AS INTEGER)")
#: People with names in other alphabets and with accents.
ABROAD = "concat(coalesce(people, ''), CASE k % 6 WHEN 0 THEN ' Şanlıurfa Dőr' WHEN 1 THEN ', Čačak City é x' WHEN 2 THEN ' – Асмэра; 東京 2x' WHEN 3 THEN ', São Tomé' ELSE '' END)"
one("retrieval_tokens", lambda: joined(T.retrieval_tokens(F.expr(ABROAD))), _BAR(f"regexp_extract_all(lower({ABROAD}), '[\\p{{L}}\\p{{N}}]{{2,}}')"))

_D = "lower(coalesce(duration, ''))"
_N = f"list_transform(regexp_extract_all({_D}, '\\b([0-9]+(?:\\.[0-9]+)?)\\b', 1), lambda x: CAST(x AS DOUBLE))"
_FRAC = f"TRY_CAST(nullif(regexp_extract({_D}, '([0-9]+)\\s*/\\s*([0-9]+)', 1), '') AS DOUBLE) / TRY_CAST(nullif(regexp_extract({_D}, '([0-9]+)\\s*/\\s*([0-9]+)', 2), '') AS DOUBLE)"
one(
    "duration_a",
    lambda: T.duration_upload(F.col("duration")),
    f"""CAST(CASE WHEN contains({_D}, 'month') THEN greatest(1, round_even(coalesce({_N}[1], 1) * 30 + CASE WHEN contains({_D}, 'week') THEN coalesce({_N}[2], 0) * 7 ELSE 0 END + CASE WHEN contains({_D}, 'day') THEN coalesce({_N}[3], 0) ELSE 0 END, 0))
    WHEN contains({_D}, 'week') THEN greatest(1, round_even(coalesce({_N}[1], 1) * 7 + coalesce({_N}[2], 0), 0)) WHEN contains({_D}, 'day') THEN greatest(1, round_even(coalesce({_FRAC}, {_N}[1], 1), 0)) END AS INTEGER)""",
)
_FIRST = f"TRY_CAST(nullif(regexp_extract({_D}, '[0-9]+(\\.[0-9]+)?', 0), '') AS DOUBLE)"
one(
    "duration_b",
    lambda: T.duration_eta(F.col("duration")),
    f"CAST(trunc(CASE WHEN regexp_full_match({_D}, '[0-9]+(\\.[0-9]+)?') THEN {_FIRST} WHEN NOT regexp_matches({_D}, '[0-9]\\s*[/-]\\s*[0-9]') THEN {_FIRST} * CASE WHEN contains({_D}, 'week') THEN 7 WHEN contains({_D}, 'month') THEN 30 WHEN contains({_D}, 'day') THEN 1 END END) AS INTEGER)",
)
_UNIT = "([0-9]+(?:\\.[0-9]+)?)\\s*(day|days|week|weeks|month|months|year|years)"
one(
    "duration_c",
    lambda: T.duration_first(F.col("duration")),
    f"CASE WHEN TRY_CAST(nullif(regexp_extract({_D}, '{_UNIT}', 1), '') AS DOUBLE) > 0 THEN CAST(regexp_extract({_D}, '{_UNIT}', 1) AS DOUBLE) * CASE regexp_extract({_D}, '{_UNIT}', 2)[1] WHEN 'd' THEN 1 WHEN 'w' THEN 7 WHEN 'm' THEN 30 ELSE 365 END END",
)
_R = f"regexp_replace({_D}, '([0-9]+)\\s*-\\s*([0-9]+)\\s*(day|days)', '\\1 days \\2 days', 'g')"
_P = "([0-9]+/[0-9]+|[0-9]+(?:[.,][0-9]+)?)(?:\\s|-)?(days|day|weeks|week|months|month|hours|hour)"
one(
    "duration_d",
    lambda: F.round(T.duration_sum(F.col("duration")), 6),
    f"round(nullif(list_sum(list_transform(list_zip(regexp_extract_all({_R}, '{_P}', 1), regexp_extract_all({_R}, '{_P}', 2)), lambda x: CASE WHEN contains(x[1], '/') THEN CAST(split_part(x[1], '/', 1) AS DOUBLE) / CAST(split_part(x[1], '/', 2) AS DOUBLE) ELSE CAST(replace(x[1], ',', '.') AS DOUBLE) END * CASE x[2][1] WHEN 'd' THEN 1 WHEN 'w' THEN 7 WHEN 'm' THEN 30 ELSE 1e0 / 24 END)), 0), 6)",
)
_S = "trim(coalesce(places, ''))"
_Q = f"list_filter(list_transform(regexp_extract_all({_S}, '[''\"]([^''\"]+)[''\"]', 1), lambda x: trim(x)), lambda x: x <> '')"
_INNER = f"regexp_replace({_S}, '^\\[|\\]$', '', 'g')"
_BRACKET = f"regexp_full_match({_S}, '\\[.*\\]')"
one(
    "parse_places",
    lambda: joined(T.parse_places(F.col("places"))),
    f"CASE WHEN {_S} = '' THEN '' WHEN {_BRACKET} THEN {_BAR(f'CASE WHEN len({_Q}) > 0 THEN {_Q} ELSE list_filter(string_split_regex(replace({_INNER}, chr(44), chr(32)), chr(92) || chr(115) || chr(43)), lambda x: x <> chr(32) AND length(x) > 0) END')} ELSE {_S} END",
)
one(
    "coerce_list",
    lambda: joined(T.coerce_list(F.col("places"))),
    _BAR(f"list_filter(list_transform(CASE WHEN {_BRACKET} THEN CASE WHEN len({_Q}) > 0 THEN {_Q} ELSE string_split({_INNER}, ',') END WHEN contains({_S}, ';') THEN string_split({_S}, ';') WHEN contains({_S}, ',') THEN string_split({_S}, ',') ELSE [{_S}] END, lambda x: trim(x)), lambda x: x <> '')"),
)
_L = f"list_filter(list_transform(CASE WHEN len({_Q}) > 0 THEN {_Q} ELSE string_split_regex({_INNER}, '[;,|•]') END, lambda x: trim(x)), lambda x: x <> '' AND lower(x) NOT IN {_IN(T.NOT_ACTORS)})"
one("parse_listish", lambda: joined(T.parse_listish(F.col("places"))), _BAR(_UNIQ_LOWER(_L)))
one("parse_days", lambda: joined(F.transform(T.parse_days(F.col("duration")), lambda x: F.round(x * 10).cast("long").cast("string"))), _BAR("list_transform(regexp_extract_all(coalesce(duration, ''), '-?[0-9]+(?:\\.[0-9]+)?'), lambda x: CAST(CAST(round(CAST(x AS DOUBLE) * 10) AS BIGINT) AS VARCHAR))"))
one("normalize_location", lambda: T.normalize_location(F.col("places")), "nullif(regexp_replace(trim(split_part(coalesce(places, ''), '(', 1)), '\\s+', ' ', 'g'), '')")
one("first_token", lambda: T.first_token(T.split_list(F.col("people")), F.col("nat")), f"coalesce(nullif(trim(list_filter(list_transform(string_split_regex({_CLEAN('people')}, '{_SEP}'), lambda p: trim(p)), lambda p: p <> '' AND lower(p) NOT IN {_IN(T.LIST_BLANKS)})[1]), ''), nullif(trim(nat), ''))")
one("join_lists", lambda: F.concat(T.join_csv(F.array("gender", "nat")), F.lit("#"), T.join_display(F.array("gender", "nat"))), "concat_ws(';', gender, nat) || '#' || concat_ws(' · ', gender, nat)")
one("slug", lambda: T.slug(F.col("people")), "CASE WHEN s = '' THEN 'unk' ELSE s END".replace("s =", "regexp_replace(regexp_replace(regexp_replace(lower(trim(coalesce(people, ''))), '[^\\p{L}\\p{N}_-]+', '-', 'g'), '-{2,}', '-', 'g'), '^-+|-+$', '', 'g') =").replace("ELSE s", "ELSE regexp_replace(regexp_replace(regexp_replace(lower(trim(coalesce(people, ''))), '[^\\p{L}\\p{N}_-]+', '-', 'g'), '-{2,}', '-', 'g'), '^-+|-+$', '', 'g')"))
one("row_signature", lambda: T.row_signature(F.col("k"), F.col("nat"), F.col("gender")), "substr(sha1(concat_ws('|', CAST(k AS VARCHAR), coalesce(nat, ''), coalesce(gender, ''))), 1, 12)")
one("piped_text", lambda: T.piped(F.col("gender"), F.col("nat"), F.col("dated")), _BAR("list_filter([trim(coalesce(gender, '')), trim(coalesce(nat, '')), trim(coalesce(dated, ''))], lambda x: x <> '')").replace("'|'", "' | '"))
one("log_size", lambda: F.round(T.log_size(F.col("k")), 6), "round(12 + 6 * log10(greatest(1, k)), 6)")
one("clean_ids", lambda: F.concat_ws("/", *T.backfilled_ids(F.when(F.col("k") % 2 == 0, "<NA>").otherwise(F.col("k").cast("string")), F.when(F.col("k") % 3 == 0, "None").otherwise(F.concat(F.lit("S"), F.col("k").cast("string"))))), "CASE WHEN k % 2 = 0 AND k % 3 = 0 THEN '/' WHEN k % 2 = 0 THEN 'S' || k || '/S' || k WHEN k % 3 = 0 THEN k || '/' || k ELSE k || '/S' || k END")
one(
    "coord_parse",
    lambda: F.round(T.coordinate(F.col("coord"), "lat"), 6),
    "CASE k % 8 WHEN 0 THEN 32.896672e0 WHEN 1 THEN 35.6895e0 WHEN 2 THEN -1.1019081e0 WHEN 4 THEN 12.345e0 WHEN 5 THEN 32.5e0 WHEN 7 THEN CASE WHEN k % 180 <= 90 THEN CAST(k % 180 AS DOUBLE) ELSE (k % 180) / 10e0 END END".replace("-1.1019081e0", "round(-1.1019081e0, 6)").replace("THEN 32.896672e0", "THEN round(32.896672e0, 6)"),
)


one("positive_days", lambda: T.positive_days(F.when(F.col("k") % 4 == 0, "nan").when(F.col("k") % 4 == 1, (F.col("k") - 40).cast("string")).when(F.col("k") % 4 == 2, "inf")), "CASE WHEN k % 4 = 1 AND k > 40 THEN CAST(k - 40 AS DOUBLE) END")
_PAIR = lambda: F.when(F.col("k") % 3 == 0, F.concat_ws(", ", (F.col("k") / 2).cast("string"), F.lit("-7.5"))).when(F.col("k") % 3 == 1, "north, 3")
one("split_pair", lambda: F.concat_ws("|", *(F.coalesce(F.round(x, 3).cast("string"), F.lit("-")) for x in T.split_pair(_PAIR()))), "CASE k % 3 WHEN 0 THEN CAST(k / 2e0 AS VARCHAR) || '|-7.5' WHEN 1 THEN '-|3.0' ELSE '-|-' END")
one("year_of", lambda: T.year_of(F.when(F.col("k") % 2 == 0, F.concat_ws("-", (F.col("k") % 30 + 1990).cast("string"), F.lit("05-06"))), F.col("dated")), "CASE WHEN k % 2 = 0 THEN CAST(k % 30 + 1990 AS INTEGER) ELSE TRY_CAST(nullif(regexp_extract(coalesce(dated, ''), '\\b((19|20)[0-9]{2})\\b', 1), '') AS INTEGER) END")


@query("explode_outer", with_raw("SELECT k, CASE WHEN len(l) = 0 THEN NULL ELSE unnest(l) END AS item FROM (SELECT k, CASE WHEN len(x) = 0 THEN [NULL] ELSE x END AS l FROM (SELECT k, list_filter(list_transform(string_split_regex(" + _CLEAN("people") + f", '{_SEP}'), lambda p: trim(p)), lambda p: p <> '' AND lower(p) NOT IN {_IN(T.LIST_BLANKS)}) AS x FROM raw))"))
def _(spark, d):
    return raw(spark, d).select("k", F.explode_outer(T.split_list(F.col("people"))).alias("item"))


@query("calendar_parts", "SELECT event_id, CAST(year(ts) AS INTEGER) AS year, strftime(ts, '%Y-%m') AS month FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", F.year("ts").alias("year"), F.date_format("ts", "yyyy-MM").alias("month"))


@query("parse_dates", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS iso FROM orders")
def _(spark, d):
    r = F.col("o_orderkey") % 4
    text = F.when(r == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(r == 1, F.date_format("o_orderdate", "dd/MM/yyyy")).when(r == 2, F.date_format("o_orderdate", "dd.MM.yyyy")).otherwise("soon")
    return table(spark, d, "orders").select("o_orderkey", T.iso_date(text).alias("iso"))


_M = _STRIP(_TXT("people"))
_FOUND = (
    f"list_concat(list_concat(regexp_extract_all({_M}, '[''\"]([^''\"]{{2,}})[''\"]', 1), list_filter(string_split_regex({_M}, '(?i)[;,/|]| and | & |\\n|\\r'), lambda p: length({_STRIP('p')}) >= 2)), "
    f"regexp_extract_all({_M}, '\\b([A-Z][a-z]+(?:\\s+[A-Z][a-z]+){{0,3}})\\b', 1))"
)
_TRIMMED = f"list_transform({_FOUND}, lambda p: regexp_replace(regexp_replace({_STRIP('p')}, '^[''\"]+|[''\"]+$', '', 'g'), '\\s+', ' ', 'g'))"
_BARE = "regexp_replace(p, '^[ .]+|[ .]+$', '', 'g')"
_NAMED = f"list_filter({_TRIMMED}, lambda p: lower({_BARE}) NOT IN {_IN(('', *T.NOT_NAMES))} AND length({_BARE}) > 1)"


@query("name_mentions", with_raw(f"SELECT k, {_BAR('list_filter(m, lambda p, i: list_position(list_transform(m, lambda q: lower(q)), lower(p)) = i)')} AS out FROM (SELECT k, {_NAMED} AS m FROM raw)"))
def _(spark, d):
    return raw(spark, d).select("k", joined(T.name_mentions(F.col("people"))).alias("out"))


def _key(x: str) -> str:
    folded = f"strip_accents(translate(lower({_STRIP(x)}), '’–—', chr(39) || '--'))"
    return f"trim(regexp_replace(regexp_replace({folded}, '[^\\p{{L}}\\p{{N}}_\\s-]', ' ', 'g'), '\\s+', ' ', 'g'))"


_TAIL = f"trim(string_split({ABROAD}, ',')[-1])"


@query(
    "place_keys",
    with_raw(
        f"SELECT k, array_to_string(list_filter(string_split({_key(ABROAD)}, ' '), lambda w: w <> '' AND w NOT IN {_IN(T.PLACE_STOPS)}), ' ') AS key, "
        f"CASE WHEN contains({ABROAD}, ',') AND length({_TAIL}) BETWEEN 2 AND 64 THEN {_key(_TAIL)} END AS country, strip_accents({ABROAD}) AS folded FROM raw"
    ),
)
def _(spark, d):
    who = F.expr(ABROAD)
    return raw(spark, d).select("k", T.place_key_without_stops(who).alias("key"), T.country_hint(who).alias("country"), T.fold_accents(who).alias("folded"))


@query("fuzzy_dedupe")
def _(spark, d):
    return raw(spark, d).select("k", joined(fuzzy.fuzzy_dedupe(T.split_list(F.col("people")))).alias("out"))


@query("similarity")
def _(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.lower("p_name").alias("a"), F.lower("p_type").alias("b"))
    return rows.select("p_partkey", *(f("a", "b").alias(n) for n, f in (("ratio", fuzzy.ratio), ("token_set", fuzzy.token_set_ratio), ("matcher", fuzzy.matcher_ratio), ("weighted", fuzzy.weighted_ratio))))
