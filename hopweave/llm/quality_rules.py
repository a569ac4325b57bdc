"""Quality rules kept as a ledger of failure bits.

Every rule is evaluated once per document. The ledger holds the measurements and a
bit mask of the rules that failed; a policy is a version name and a mask, so a new
policy or an ablation is bitwise work on the ledger and never reads a text again.

Words are runs of characters other than U+0020 and U+0009 to U+000D. Defined cases:
a null text has no words and no lines; an empty text fails `few_words`; texts of
any length are measured whole; equal rows give equal rows; an empty table gives an
empty ledger; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hopweave.llm.batches import map_documents

SPACE = " \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"
WINDOW = 5

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_lower")

#: Rules in the order of their bits: name, and SQL over the measurements that is true when a document fails.
RULES = (
    ("few_words", "n_words < 10"),
    ("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "4 * n_symbols > n_words"),
    ("repeated_lines", "10 * n_dup_lines > 3 * n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 20 * n_words"),
    ("shouting", "2 * n_upper > n_upper + n_lower AND n_upper > 20"),
)
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_windows"]
#: Policies by version: the rules that reject a document.
POLICIES = {"base": BASE, "v1": sum(BIT.values())}

_NOT_UPPER = bytes(b for b in range(256) if not 0x41 <= b <= 0x5A)
_NOT_LOWER = bytes(b for b in range(256) if not 0x61 <= b <= 0x7A)
_NOT_SYMBOL = bytes(b for b in range(256) if b not in SYMBOLS)


def repeated_words(ids: np.ndarray, distinct: int) -> int:
    """Words that stand in a window of five that occurs twice or more; ids are the words' numbers.

    Windows are numbered exactly: pairs of words, pairs of those, and the fifth word.
    """
    n = len(ids)
    if n <= WINDOW or distinct == n:
        return 0
    number = lambda x: np.unique(x, return_inverse=True)[1].astype(np.int64)
    twos = number(ids[:-1] * distinct + ids[1:])
    fours = number(twos[:-2] * n + twos[2:])
    _, inverse, counts = np.unique(fours[:-1] * distinct + ids[4:], return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[inverse] > 1)
    if not len(starts):
        return 0
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + WINDOW, -1)
    return int((np.cumsum(edge)[:n] > 0).sum())


def measure(text: str) -> tuple[int, ...]:
    """MEASURES of one text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    return (
        len(words),
        len(text) - sum(map(text.count, SPACE)),
        len(raw.translate(None, _NOT_SYMBOL)),
        len(lines),
        len(lines) - len(set(lines)),
        repeated_words(ids, len(number)),
        len(raw.translate(None, _NOT_UPPER)),
        len(raw.translate(None, _NOT_LOWER)),
    )


def failed_bits() -> Column:
    bits = [F.when(F.expr(rule), F.lit(BIT[name]).cast("long")).otherwise(F.lit(0).cast("long")) for name, rule in RULES]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, MEASURES and fail_bits, one row per row of docs."""

    def make():
        return lambda texts: [list(c) for c in zip(*map(measure, texts), strict=True)]

    return map_documents(docs, make, ", ".join(f"{m} long" for m in MEASURES), id_col, text_col).withColumn("fail_bits", failed_bits())


def apply_policy(rows: DataFrame, version: str = "v1", out: str = "kept") -> DataFrame:
    """Adds out: true if no rule of the policy failed."""
    return rows.withColumn(out, F.col("fail_bits").bitwiseAND(F.lit(POLICIES[version]).cast("long")) == 0)


def ablation(rows: DataFrame, version: str = "v1") -> DataFrame:
    """Per rule of a policy: rule, n_failed, n_only (rejected by this rule alone), n_rejected_without.

    Documents are first counted by their mask, so at most 2 ** len(RULES) rows are joined with the rules.
    """
    mask = POLICIES[version]
    by_mask = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long")).alias("m")).agg(F.count("*").alias("n"))
    sums = []
    for name, bit in BIT.items():
        if bit & mask:
            has, rest = F.col("m").bitwiseAND(F.lit(bit).cast("long")) != 0, F.col("m").bitwiseAND(F.lit(mask & ~bit).cast("long")) != 0
            n = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
            sums.append(F.struct(F.lit(name).alias("rule"), n(has).alias("n_failed"), n(has & ~rest).alias("n_only"), n(rest).alias("n_rejected_without")))
    return by_mask.agg(F.array(*sums).alias("x")).select(F.inline("x"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = apply_policy(ledger(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    failed = F.col("fail_bits").bitwiseAND(F.lit(BASE).cast("long")) != 0
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (F.col("kept") & ~failed).alias("kept"), "fail_bits")


def rule_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the policy rejects, alone and with the others, over all documents."""
    return ablation(ledger(spark.read.parquet(f"{sf_dir}/documents.parquet")))


_WORDS = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"

#: Rows of documents are numbered first: an id may repeat.
_LEDGER_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text, {_WORDS} AS ws FROM d),
m AS (
  SELECT rid, doc_id, len(ws) AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
         length(regexp_replace(text, '[^A-Z]+', '', 'g')) AS n_upper,
         length(regexp_replace(text, '[^a-z]+', '', 'g')) AS n_lower,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM w),
p AS (SELECT rid, generate_subscripts(ws, 1) AS i, unnest(ws) AS word FROM w),
s AS (
  SELECT rid, i, CASE WHEN lead(i, 4) OVER o IS NOT NULL
         THEN concat_ws(' ', word, lead(word) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o) END AS five
  FROM p WINDOW o AS (PARTITION BY rid ORDER BY i)),
r AS (
  SELECT s.rid, s.i FROM s JOIN (SELECT rid, five FROM s WHERE five IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1) t
  ON s.rid = t.rid AND s.five = t.five),
h AS (SELECT rid, count(DISTINCT i + k) AS n FROM r, (SELECT unnest([0, 1, 2, 3, 4]) AS k) GROUP BY 1),
a AS (
  SELECT doc_id, n_words, word_chars, n_symbols, n_upper, n_lower, len(ls) AS n_lines,
         len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(h.n, 0) AS n_repeat_words
  FROM m LEFT JOIN h ON m.rid = h.rid),
b AS (SELECT *, {" + ".join(f"CASE WHEN {rule} THEN {BIT[name]} ELSE 0 END" for name, rule in RULES)} AS fail_bits FROM a)
"""

OP8_SQL = _LEDGER_SQL + f"""SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       (fail_bits & {BASE}) <> 0 AS base_failed, fail_bits = 0 AS kept, CAST(fail_bits AS BIGINT) AS fail_bits
FROM b
"""

_MASK = POLICIES["v1"]
_WITHOUT = lambda bit: f"(fail_bits & {_MASK & ~bit}) <> 0"
ABLATION_SQL = _LEDGER_SQL + " UNION ALL ".join(
    f"SELECT '{name}' AS rule, count(*) FILTER ((fail_bits & {bit}) <> 0) AS n_failed, count(*) FILTER ((fail_bits & {bit}) <> 0 AND NOT {_WITHOUT(bit)}) AS n_only, count(*) FILTER ({_WITHOUT(bit)}) AS n_rejected_without FROM b"
    for name, bit in BIT.items()
    if bit & _MASK
)
