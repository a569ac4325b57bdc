"""Scalar functions from Column to Column: cleaning, splitting, parsing, tokens.

Everything is built-in expressions, so it stays in generated code. A null argument
counts as an empty text unless a docstring says otherwise.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: the vocabulary that results depend on

#: Patterns of names in free text, and of the four duration parsers.
QUOTED_NAME = "['\"]([^'\"]{2,})['\"]"
NAME_DELIMITER = "(?i)[;,/|]| and | & |\\n|\\r"
CAPITALIZED_NAME = "\\b([A-Z][a-z]+(?:\\s+[A-Z][a-z]+){0,3})\\b"
ANY_NUMBER = "\\b([0-9]+(?:\\.[0-9]+)?)\\b"
FRACTION = "([0-9]+)\\s*/\\s*([0-9]+)"
FIRST_NUMBER = "([0-9]+(?:\\.[0-9]+)?)"
PLAIN_NUMBER = "^[0-9]+(\\.[0-9]+)?$"
NUMBER_PAIR = "[0-9]\\s*[/-]\\s*[0-9]"
FIRST_DURATION = "(?i)([0-9]+(?:\\.[0-9]+)?)\\s*(day|days|week|weeks|month|months|year|years)"
DAY_RANGE = "([0-9]+)\\s*-\\s*([0-9]+)\\s*(day|days)"
EACH_DURATION = "([0-9]+(?:[.,][0-9]+)?|[0-9]+/[0-9]+)(?:\\s|-)?(days|day|weeks|week|months|month|hours|hour)"

BLANKS = ("nan", "none", "null")
LIST_BLANKS = (*BLANKS, "no")
GENDERS = {"m": "Male", "male": "Male", "man": "Male", "boy": "Male", "f": "Female", "female": "Female", "woman": "Female", "girl": "Female"}
FEMALE, MALE = ("f", "female", "woman", "girl", "lady", "women"), ("m", "male", "man", "boy", "gentleman", "men")
GENDER_BLANKS = ("", "none", "nan", "n/a", "unk", "unknown")
NATIONALITIES = {
    "ethiopian": "Ethiopian", "eritrean": "Eritrean", "sudanese": "Sudanese", "somali": "Somali", "nigerian": "Nigerian",
    "libyan": "Libyan", "syrian": "Syrian", "afghan": "Afghan", "afghani": "Afghan",
}
DEMONYMS = {
    "eritrea": "Eritrean", "eritrean": "Eritrean", "ethiopia": "Ethiopian", "ethiopian": "Ethiopian", "sudan": "Sudanese",
    "sudanese": "Sudanese", "somalia": "Somali", "somali": "Somali", "libya": "Libyan", "libyan": "Libyan", "tunisia": "Tunisian",
    "tunisian": "Tunisian", "morocco": "Moroccan", "moroccan": "Moroccan", "egypt": "Egyptian", "egyptian": "Egyptian",
    "italy": "Italian", "italian": "Italian", "france": "French", "french": "French", "germany": "German", "german": "German",
    "spain": "Spanish", "spanish": "Spanish", "nigeria": "Nigerian", "nigerian": "Nigerian",
}
NOT_PERSONS = (
    "unknown", "none", "no", "nil", "n/a", "boss", "chief", "police", "officer", "man", "woman", "him", "her", "they", "he", "she", "i",
    "me", "you", "we", "and", "but", "the", "a", "an", "someone", "anybody", "everybody", "person", "people", "kidnapper", "guard", "smuggler",
)
NOT_ACTORS = (
    "yes", "no", "none", "unknown", "n/a", "na", "nil", "-", "_", "chief", "perpetrator", "perpetrators", "human traffickers", "place",
    "of", "and", "the",
)
NOT_NAMES = ("mr", "mrs", "ms", "dr", "chief", "trafficker", "traffickers", "human", "of", "and", "the", "unknown", "none", "n/a", "na")
PLACE_STOPS = (
    "city", "province", "governorate", "state", "region", "prefecture", "district", "wilaya", "municipality", "town", "village", "county",
    "office", "camp", "unhcr", "iom", "of", "the", "and", "in", "at",
)

LIST_SEPARATORS = "(?i)\\s*(?:,|;|/|&|\\band\\b|\\||–|—|→|->|=>| to )\\s*"
CHAIN_SEPARATORS = "(?i)\\s*(?:->|›|>|,|;|\\||\\band\\b|→)\\s*"
UNIT_SEPARATORS = "[,;/|]| to |->|–|-{1,2}"

# ---- small parts


def text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, "^\\s+|\\s+$", "")


def is_one_of(c: Column, values) -> Column:
    return c.isin(*values)


def lookup(c: Column, table: dict[str, str]) -> Column:
    """The table's value for c; null where it has none."""
    return F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), c)


def capitalize(c: Column) -> Column:
    """First character upper, the rest lower."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substr(c, F.lit(2))))


def title(c: Column) -> Column:
    """Every run of letters capitalized."""
    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit("(\\p{L}+|[^\\p{L}]+)"), F.lit(1)), capitalize), "")


def unique(a: Column) -> Column:
    """Distinct items in the order of their first occurrence."""
    return F.array_distinct(a)


def unique_by_lower(a: Column) -> Column:
    """Items whose lower case has not occurred before, in order."""
    low = F.transform(a, F.lower)
    return F.filter(a, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)


def find_all(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def first_match(c: Column, pattern: str, group: int = 0) -> Column:
    """The first match, or null."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


# ---- cleaning


def clean_text(c: Column) -> Column:
    """Trimmed, white space collapsed, quotes at both ends removed."""
    return F.regexp_replace(F.regexp_replace(strip(text(c)), "\\s+", " "), "^[\"']+|[\"']+$", "")


def split_list(c: Column) -> Column:
    """Parts between list separators, without blanks and words for none."""
    parts = F.transform(F.split(clean_text(c), LIST_SEPARATORS), strip)
    return F.filter(parts, lambda p: (p != "") & ~is_one_of(F.lower(p), LIST_BLANKS))


def standardize_gender(c: Column) -> Column:
    """Male or Female for eight words, else the value in title case."""
    return F.when(text(c) == "", "").otherwise(F.coalesce(lookup(F.lower(clean_text(c)), GENDERS), title(text(c))))


def titlecase_keep_caps(c: Column) -> Column:
    """Words capitalized, but for words of up to four letters that are all upper case."""
    words = F.split(clean_text(c), " ")
    kept = lambda w: (F.length(w) <= 4) & (F.upper(w) == w) & (F.lower(w) != w)
    return strip(F.array_join(F.transform(words, lambda w: F.when(kept(w), w).otherwise(capitalize(w))), " "))


def standardize_nationality(c: Column) -> Column:
    return F.coalesce(lookup(F.lower(clean_text(c)), NATIONALITIES), titlecase_keep_caps(c))


def standardize_location(c: Column) -> Column:
    return titlecase_keep_caps(F.regexp_replace(clean_text(c), "^[ .]+|[ .]+$", ""))


def smart_blank(c: Column) -> Column:
    """Trimmed; null and words for none become the empty text."""
    v = strip(text(c))
    return F.when(is_one_of(F.lower(v), BLANKS), "").otherwise(v)


def normalize_gender(c: Column) -> Column:
    """Female, Male or Unknown; words for female are looked for first."""
    s = F.lower(strip(text(c)))
    return (
        F.when(is_one_of(s, GENDER_BLANKS), "Unknown")
        .when(is_one_of(s, FEMALE), "Female")
        .when(is_one_of(s, MALE), "Male")
        .when(s.rlike("\\bf(emale)?\\b"), "Female")
        .when(s.rlike("\\bm(ale)?\\b"), "Male")
        .otherwise("Unknown")
    )


def gender_lower(c: Column) -> Column:
    """female, male or unknown by the first letter of the trimmed value."""
    s = F.lower(strip(text(c)))
    return F.when(s.startswith("f"), "female").when(s.startswith("m"), "male").otherwise("unknown")


def normalize_nationality(c: Column) -> Column:
    """The first word with a demonym, else the first capitalized word, else the value capitalized."""
    s = strip(text(c))
    words = find_all(s, "[A-Za-z]+")
    known = F.filter(F.transform(words, lambda w: lookup(F.lower(w), DEMONYMS)), lambda x: x.isNotNull())
    capital = F.filter(words, lambda w: w.rlike("^[A-Z][a-z]+$"))
    return F.when(s == "", "").otherwise(F.coalesce(F.try_element_at(known, F.lit(1)), F.try_element_at(capital, F.lit(1)), capitalize(s)))


def nationality_or_unknown(c: Column) -> Column:
    s = smart_blank(c)
    return F.when(s == "", "Unknown").otherwise(capitalize(s))


# ---- tokens


def location_tokens(c: Column, gazetteer: Column | None = None) -> Column:
    """Distinct capitalized words; with a gazetteer (array of lower-case names), words that are in it."""
    words = F.flatten(F.transform(F.split(text(c), UNIT_SEPARATORS), lambda p: find_all(p, "[A-Za-z]+")))
    fits = (lambda w: (F.length(w) >= 2) & w.rlike("^[A-Z][a-z]+$")) if gazetteer is None else (lambda w: (F.length(w) >= 2) & F.array_contains(gazetteer, F.lower(w)))
    return unique(F.transform(F.filter(words, fits), capitalize))


def person_tokens(c: Column) -> Column:
    """Distinct capitalized words that are no common noun or pronoun."""
    return unique(F.filter(find_all(text(c), "[A-Za-z]+"), lambda w: w.rlike("^[A-Z][a-z]+$") & ~is_one_of(F.lower(w), NOT_PERSONS)))


def compact_time(c: Column) -> Column:
    """Lower-case words and numbers but `and`, joined by underscores."""
    return F.array_join(F.filter(find_all(F.lower(text(c)), "[a-z]+|[0-9]+"), lambda t: t != "and"), "_")


def retrieval_tokens(c: Column) -> Column:
    """Runs of two or more letters or digits of any script, lower case."""
    return find_all(F.lower(text(c)), "[\\p{L}\\p{N}]{2,}")


def topic_tokens(c: Column) -> Column:
    """Runs of three or more letters, lower case."""
    return F.transform(find_all(text(c), "[A-Za-z]{3,}"), F.lower)


def name_mentions(c: Column) -> Column:
    """Names in free text: a list if it looks like one, else quoted parts, parts between delimiters and capitalized runs."""
    s = strip(text(c))
    parts = F.concat(
        find_all(s, QUOTED_NAME, 1),
        F.filter(F.split(s, NAME_DELIMITER), lambda p: F.length(strip(p)) >= 2),
        find_all(s, CAPITALIZED_NAME, 1),
    )
    clean = F.transform(parts, lambda p: F.regexp_replace(F.regexp_replace(strip(p), "^['\"]+|['\"]+$", ""), "\\s+", " "))
    bad = lambda p: is_one_of(F.regexp_replace(F.lower(p), "^[ .]+|[ .]+$", ""), ("", *NOT_NAMES)) | (F.length(F.regexp_replace(p, "^[ .]+|[ .]+$", "")) <= 1)
    return F.when(s.startswith("[") & s.contains("]"), parse_listish(c)).otherwise(unique_by_lower(F.filter(clean, lambda p: ~bad(p))))


# ---- durations: four parsers that differ on purpose


def duration_upload(c: Column) -> Column:
    """Whole days, months before weeks before days; the n-th unit takes the n-th number of the text; at least 1."""
    t = F.lower(text(c))
    nums = F.transform(find_all(t, ANY_NUMBER, 1), lambda x: x.cast("double"))
    nth = lambda i, default: F.coalesce(F.try_element_at(nums, F.lit(i)), F.lit(default))
    has = lambda w: t.contains(w)
    above, below = (first_match(t, FRACTION, g).cast("double") for g in (1, 2))
    months = nth(1, 1.0) * 30 + F.when(has("week"), nth(2, 0.0) * 7).otherwise(0.0) + F.when(has("day"), nth(3, 0.0)).otherwise(0.0)
    weeks = nth(1, 1.0) * 7 + nth(2, 0.0)
    day = F.coalesce(F.try_divide(above, below), nth(1, 1.0))
    found = F.when(has("month"), months).when(has("week"), weeks).when(has("day"), day)
    return F.when(found.isNotNull(), F.greatest(F.lit(1.0), F.bround(found)).cast("int"))


def duration_eta(c: Column) -> Column:
    """Whole days: a plain number, else the first whole number before a unit, weeks before months before days."""
    t = F.lower(strip(text(c)))
    any_n = first_match(t, FIRST_NUMBER, 1).cast("double")
    whole = t.rlike(PLAIN_NUMBER)
    unit = F.when(t.contains("week"), 7).when(t.contains("month"), 30).when(t.contains("day"), 1)
    plain = ~t.rlike(NUMBER_PAIR)
    return F.when(whole, any_n.cast("int")).when(plain, (any_n * unit).cast("int"))


def duration_first(c: Column) -> Column:
    """Days as a double: the first number with a unit, years too; null unless positive."""
    s = text(c)
    n = first_match(s, FIRST_DURATION, 1).cast("double")
    u = F.lower(first_match(s, FIRST_DURATION, 2))
    d = n * F.when(u.startswith("day"), 1.0).when(u.startswith("week"), 7.0).when(u.startswith("month"), 30.0).otherwise(365.0)
    return F.when(d > 0, d)


def duration_sum(c: Column) -> Column:
    """Days as a double: the sum over all numbers with a unit, hours too; a range counts both ends."""
    s = F.regexp_replace(F.lower(text(c)), DAY_RANGE, "$1 days $2 days")
    pattern = EACH_DURATION
    both = F.arrays_zip(find_all(s, pattern, 1).alias("n"), find_all(s, pattern, 2).alias("u"))
    half = lambda x, i: F.get(F.split(x["n"], "/"), F.lit(i)).try_cast("double")
    value = lambda x: F.when(x["n"].contains("/"), F.try_divide(half(x, 0), half(x, 1))).otherwise(F.regexp_replace(x["n"], ",", ".").try_cast("double"))
    days = lambda x: value(x) * F.when(x["u"].startswith("day"), 1.0).when(x["u"].startswith("week"), 7.0).when(x["u"].startswith("month"), 30.0).otherwise(1 / 24)
    total = F.aggregate(both, F.lit(0.0), lambda a, x: a + F.coalesce(days(x), F.lit(0.0)))
    return F.when(total > 0, total)


def positive_days(c: Column) -> Column:
    """A finite positive double, or null."""
    v = c.try_cast("double")
    return F.when((v > 0) & (v < float("inf")), v)


# ---- dates


def extract_year(c: Column) -> Column:
    return first_match(text(c), "\\b((19|20)[0-9]{2})\\b", 1).cast("int")


def parse_date(c: Column, formats: tuple[str, ...] = ("yyyy-MM-dd", "yyyy/MM/dd", "dd/MM/yyyy", "dd-MM-yyyy", "dd.MM.yyyy", "d MMM yyyy")) -> Column:
    """A date by the first format that fits the whole text, or null."""
    s = strip(text(c))
    return F.coalesce(*(F.try_to_timestamp(s, F.lit(f)) for f in formats)).cast("date")


def iso_date(c: Column) -> Column:
    return F.coalesce(F.date_format(parse_date(c), "yyyy-MM-dd"), F.lit(""))


def year_of(interview: Column, left_home: Column) -> Column:
    """The interview date's year, else the year of leaving home."""
    return F.coalesce(F.year(parse_date(interview)), extract_year(left_home))


# ---- lists in text


def parse_places(c: Column) -> Column:
    """Places of a list in text: quoted parts first, then bare words; any other text is one place."""
    s = strip(text(c))
    quoted = F.filter(F.transform(find_all(s, "['\"]([^'\"]+)['\"]", 1), strip), lambda x: x != "")
    bare = F.filter(F.split(F.regexp_replace(F.regexp_replace(s, "^\\[|\\]$", ""), ",", " "), "\\s+"), lambda x: x != "")
    empty = F.array().cast("array<string>")
    return F.when(s == "", empty).when(s.rlike("(?s)^\\[.*\\]$"), F.when(F.size(quoted) > 0, quoted).otherwise(bare)).otherwise(F.array(s))


def parse_days(c: Column) -> Column:
    """All numbers in a text, as doubles."""
    return F.transform(find_all(text(c), "-?[0-9]+(?:\\.[0-9]+)?"), lambda x: x.cast("double"))


def parse_listish(c: Column) -> Column:
    """Names of a list in text: quoted parts, else parts between ; , | and bullets; stop words dropped; unique by lower case."""
    s = strip(text(c))
    quoted = find_all(s, "['\"]([^'\"]+)['\"]", 1)
    parts = F.when(F.size(quoted) > 0, quoted).otherwise(F.split(F.regexp_replace(s, "^\\[|\\]$", ""), "[;,|•]"))
    clean = F.transform(parts, lambda v: F.regexp_replace(strip(v), "^['\"]+|['\"]+$", ""))
    return unique_by_lower(F.filter(clean, lambda v: (v != "") & ~is_one_of(F.lower(v), NOT_ACTORS)))


def coerce_list(c: Column) -> Column:
    """A list in text, parts between semicolons, parts between commas, or the text alone."""
    s = strip(text(c))
    quoted = find_all(s, "['\"]([^'\"]+)['\"]", 1)
    inner = F.regexp_replace(s, "^\\[|\\]$", "")
    parts = F.when(s.rlike("(?s)^\\[.*\\]$"), F.when(F.size(quoted) > 0, quoted).otherwise(F.split(inner, ","))).when(s.contains(";"), F.split(s, ";")).when(s.contains(","), F.split(s, ",")).otherwise(F.array(s))
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def list_of(c: Column, is_array: bool) -> Column:
    """An array of texts whatever the column holds."""
    return F.coalesce(c, F.array().cast("array<string>")) if is_array else coerce_list(c)


def first_token(items: Column, fallback: Column) -> Column:
    """The first item, trimmed, else the fallback; blank counts as none."""
    return F.coalesce(F.nullif(strip(F.try_element_at(items, F.lit(1))), F.lit("")), F.nullif(strip(fallback), F.lit("")))


def join_display(items: Column) -> Column:
    return F.array_join(F.filter(items, lambda x: x.isNotNull()), " · ")


def join_csv(items: Column) -> Column:
    return F.array_join(F.filter(items, lambda x: x.isNotNull()), ";")


def normalize_location(c: Column) -> Column:
    """What stands before the first bracket, spaces collapsed; null if nothing."""
    return F.nullif(F.regexp_replace(strip(F.split(text(c), "\\(").getItem(0)), "\\s+", " "), F.lit(""))


def hierarchy_chain(c: Column) -> Column:
    """Distinct parts of a chain of command, in title case but for short upper-case words."""
    parts = F.filter(F.transform(F.split(text(c), CHAIN_SEPARATORS), strip), lambda p: (p != "") & ~is_one_of(F.lower(p), BLANKS))
    caps = lambda p: (F.upper(p) == p) & (F.lower(p) != p) & (F.length(p) <= 5)
    return unique(F.transform(parts, lambda p: F.when(caps(p), p).otherwise(title(p))))


# ---- keys


def slug(c: Column) -> Column:
    """A name as part of a URI."""
    s = F.regexp_replace(F.lower(strip(text(c))), "[^\\p{L}\\p{N}_-]+", "-")
    s = F.regexp_replace(F.regexp_replace(s, "-{2,}", "-"), "^-+|-+$", "")
    return F.when(s == "", "unk").otherwise(s)


def row_signature(*parts: Column) -> Column:
    """The first twelve hexadecimal digits of a sha1 over the parts."""
    return F.substring(F.sha1(F.concat_ws("|", *(text(p) for p in parts)).cast("binary")), 1, 12)


def clean_id(c: Column) -> Column:
    """Placeholders for a missing id become the empty text."""
    s = strip(text(c))
    return F.when(is_one_of(F.lower(s), ("<na>", *BLANKS)), "").otherwise(s)


def backfilled_ids(uid: Column, sid: Column) -> tuple[Column, Column]:
    """Both ids, each taken from the other where it is blank."""
    u, s = clean_id(uid), clean_id(sid)
    return F.coalesce(F.nullif(u, F.lit("")), s), F.coalesce(F.nullif(s, F.lit("")), u)


def doc_id(sid: Column, route: Column) -> Column:
    return F.concat_ws("-", text(sid), text(route))


def piped(*parts: Column) -> Column:
    """The parts that are not blank, joined by bars."""
    return F.array_join(F.filter(F.array(*(strip(text(p)) for p in parts)), lambda x: x != ""), " | ")


def log_size(n: Column, base: float = 12.0, scale: float = 6.0) -> Column:
    return F.lit(base) + F.lit(scale) * F.log10(F.greatest(F.lit(1), n))


# ---- coordinates


def split_pair(c: Column) -> tuple[Column, Column]:
    """Latitude and longitude of a text `lat, lon`."""
    p = F.split(text(c), ",")
    return tuple(strip(F.get(p, F.lit(i))).try_cast("double") for i in (0, 1))


def coordinate(c: Column, kind: str) -> Column:
    """A latitude or longitude in a messy text: a number in range, digits with grouping dots at a plausible scale, or a number moved into range."""
    limit, scales = (90.0, (1e7, 1e6, 1e5, 1e4)) if kind == "lat" else (180.0, (1e6, 1e7, 1e5, 1e4))
    s = F.regexp_replace(strip(text(c)), ",", ".")
    plain = s.try_cast("double")
    digits = F.regexp_replace(s, "[^0-9]", "").try_cast("double") * F.when(s.contains("-"), -1.0).otherwise(1.0)
    dots = F.length(s) - F.length(F.regexp_replace(s, "\\.", ""))
    scaled = F.coalesce(*(F.when(F.abs(digits / sc) <= limit, digits / sc) for sc in scales))
    rest = F.regexp_replace(s, "[^0-9.-]+", "").try_cast("double")
    shift = F.greatest(F.lit(0.0), F.ceil(F.log10(F.abs(rest) / limit)))
    moved = F.when(F.abs(rest) <= limit, rest).otherwise(rest / F.pow(F.lit(10.0), shift))
    none = is_one_of(F.upper(strip(text(c))), ("", "N/A", "NA", "NULL", "NONE"))
    return F.when(none, None).when(F.abs(plain) <= limit, plain).when((dots >= 2) & scaled.isNotNull(), scaled).otherwise(moved)


# ---- names of places


def _folding(last: int = 0xFFFF) -> tuple[dict[str, str], dict[str, str]]:
    """What compatibility decomposition leaves of a character without its marks: one character, and several Latin ones."""
    one, more = {}, {}
    for n in (*range(0xC0, 0xD800), *range(0xF900, last + 1)):
        parts = unicodedata.normalize("NFKD", chr(n))
        rest = "".join(x for x in parts if unicodedata.category(x) != "Mn")
        if rest != chr(n) and len(rest) == 1:
            one[chr(n)] = rest
        elif rest != chr(n) and rest.isascii() and rest.isalpha():
            more[chr(n)] = rest
    return one, more


_FOLDED, _SPELLED = _folding()


def fold_accents(c: Column | str) -> Column:
    """Without accents, in any script whose accented letters decompose; ligatures of Latin letters are spelled out.

    A table of characters and one pattern, so it stays in the JVM.
    """
    s = text(F.col(c) if isinstance(c, str) else c)
    s = F.regexp_replace(F.translate(s, "".join(_FOLDED), "".join(_FOLDED.values())), "\\p{Mn}+", "")
    table = F.create_map(*(F.lit(x) for pair in _SPELLED.items() for x in pair))
    spelled = F.array_join(F.transform(F.split(s, ""), lambda x: F.coalesce(table[x], x)), "")
    return F.when(s.rlike(f"[{''.join(_SPELLED)}]"), spelled).otherwise(s)


def place_key(c: Column) -> Column:
    """Lower case without accents and punctuation, spaces collapsed."""
    s = fold_accents(F.translate(F.lower(strip(text(c))), "’–—", "'--"))
    return strip(F.regexp_replace(F.regexp_replace(s, "[^\\p{L}\\p{N}_\\s-]", " "), "\\s+", " "))


def place_key_without_stops(c: Column) -> Column:
    """place_key() without words such as city or province."""
    return F.array_join(F.filter(F.split(place_key(c), " "), lambda w: (w != "") & ~is_one_of(w, PLACE_STOPS)), " ")


def country_hint(c: Column) -> Column:
    """The key of what follows the last comma, if it has 2 to 64 characters."""
    tail = strip(F.element_at(F.split(text(c), ","), -1))
    return F.when(text(c).contains(",") & F.length(tail).between(2, 64), place_key(tail))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
