"""Importance resampling towards a target distribution.

A document's features are its words and pairs of adjacent words, each hashed into one of
10,000 buckets. How much more often a bucket occurs in the target than in the source
texts is its gain; a document's weight is the mean gain of its features, and Gumbel
noise from its id makes taking the highest scores a draw without replacement by weight.

Built-in functions only: the buckets of a document are one array, and its gains are
summed over that array by looking them up in an array literal of 10,000 numbers, so no
row is made for a feature where documents are scored. Counting sums each task's features
by bucket before they are shuffled, hence only totals are. Documents are ranked by
counting from one score to the next: scores are whole numbers within some 100,000
values, and only rows that can be drawn are ordered.

Defined cases: a null text has no words; a document without features weighs 0; null ids
count as the empty text and come last among equal scores; rows that repeat an id each
have their own score and rank; documents with too few words are scored, never drawn;
without target texts, or without any text, gains follow the same formula; an empty
table gives an empty table; other columns are not read. Texts are used whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hopweave.llm.shared import written
from hopweave.operators.numbering import numbered

BUCKETS = 10_000
PERCENT, MIN_WORDS, SEED = 25, 20, 7
#: The letters that are lower-cased, and a word.
UPPER, LOWER, WORD = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def buckets(tokens: Column, n: int = BUCKETS) -> Column:
    """Buckets of all words and of all pairs of adjacent words; tokens is a column that is there, not an expression."""
    bucket = lambda x: (F.crc32(x.cast("binary")) % n).cast("int")
    less = F.greatest(F.size(tokens) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(tokens, F.lit(1), less), F.slice(tokens, F.lit(2), less), lambda a, b: bucket(F.concat(a, F.lit(" "), b)))
    return F.concat(F.transform(tokens, bucket), pairs)


def totals(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """bucket, n: features of all texts."""
    found = texts.select(words(F.col(text_col)).alias("ws")).select(F.explode(buckets(F.col("ws"))).alias("bucket"))
    return found.groupBy("bucket").agg(F.count("*").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text_col: str = "text", target_text_col: str = "text") -> DataFrame:
    """bucket, gain: 10,000 rows."""
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(totals(docs, text_col).withColumnRenamed("n", "s"), "bucket", "left").join(totals(target, target_text_col).withColumnRenamed("n", "t"), "bucket", "left").fillna(0)
    one = W.partitionBy(F.lit(0))  # of 10,000 rows
    more = lambda c, x: (c + x).cast("double")
    ratio = more(F.col("t"), 1) * more(F.sum("s").over(one), BUCKETS) / (more(F.col("s"), 1) * more(F.sum("t").over(one), BUCKETS))
    return both.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def scored(docs: DataFrame, gain: list[int], seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight, score; gain: of each bucket in order."""
    table = F.expr(f"array({', '.join(f'{g}L' for g in gain)})")
    rows = docs.select(F.col(id_col).alias("doc_id"), words(F.col(text_col)).alias("ws"))
    rows = rows.select("doc_id", F.size("ws").cast("long").alias("n_words"), buckets(F.col("ws")).alias("bs"))
    total = F.aggregate("bs", F.lit(0).cast("long"), lambda n, b: n + F.element_at(table, b + 1))
    rows = rows.select("doc_id", "n_words", F.size("bs").cast("long").alias("n_features"), total.alias("total"))
    # a quotient rounded down: remainders are not negative
    weight = F.when(F.col("n_features") > 0, F.expr("(total - pmod(total, n_features)) div n_features")).otherwise(F.lit(0)).cast("long")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))
    return rows.select("doc_id", "n_words", "n_features", weight.alias("weight"), (weight + noise).alias("score"))


def drawn(rows: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """rows of scored(), which are read several times, with rank: null for those that are not drawn."""
    able = F.col("n_words") >= min_words
    by_score = rows.where(able).groupBy("score").agg(F.count("*").alias("n"))  # whole numbers in a bounded range
    above = by_score.select("score", "n", F.sum("n").over(W.orderBy(F.desc("score"))).alias("upto"))
    quota = F.expr(f"({percent} * n_all) div 100")
    found = above.withColumn("n_all", F.sum("n").over(W.partitionBy(F.lit(0)))).withColumn("quota", quota).where("quota > 0 AND upto - n < quota")
    least, n = found.agg(F.min("score"), F.max("quota")).first()
    if not n:
        return rows.withColumn("rank", F.lit(None).cast("long"))
    near = able & (F.col("score") >= least)
    order = [F.col("doc_id").asc_nulls_last(), "n_features", "weight"]
    ranks = numbered(rows.where(near), -F.col("score"), order, "rank")
    ranks = ranks.withColumn("rank", F.when(F.col("rank") <= n, F.col("rank")).cast("long"))
    return ranks.unionByName(rows.where(~near).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every document; rank 1, 2, ... for the drawn ones."""
    gain = [r["gain"] for r in gains(docs, target, text_col, target_text_col).orderBy("bucket").collect()]  # 10,000 numbers
    return drawn(written(scored(docs, gain, seed, id_col, text_col), "scored"), percent, min_words)


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return rows.select("doc_id", "n_features", "weight", "score", "rank")


def _features(table: str, keys: str) -> str:
    tokens = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}')"
    return f"SELECT {keys}, list_concat(ws, list_transform(list_zip(ws[:-2], ws[2:]), lambda x: x[1] || ' ' || x[2])) AS fs, len(ws) AS n_words FROM (SELECT {keys}, {tokens} AS ws FROM {table})"


OP13_SQL = f"""
WITH crc AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, [0, 1, 2, 3, 4, 5, 6, 7]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
d AS (SELECT row_number() OVER () AS rid, doc_id, fs, n_words FROM ({_features("documents", "doc_id")})),
e AS (SELECT fs FROM ({_features("benchmark", "item_id")})),
du AS (SELECT rid, unnest(fs) AS f FROM d), eu AS (SELECT unnest(fs) AS f FROM e),
known AS (SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(strlen(f)), lambda i: CAST('0x' || hx[2 * i + 1 : 2 * i + 2] AS BIGINT))), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) % {BUCKETS} AS bucket
  FROM (SELECT f, hex(encode(f)) AS hx FROM (SELECT f FROM du UNION SELECT f FROM eu)), crc),
ds AS (SELECT bucket, count(*) AS s FROM du JOIN known USING (f) GROUP BY 1), es AS (SELECT bucket, count(*) AS t FROM eu JOIN known USING (f) GROUP BY 1),
g AS (SELECT b AS bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1e0) * ((SELECT coalesce(sum(s), 0) FROM ds) + 10000e0) / ((coalesce(s, 0) + 1e0) * ((SELECT coalesce(sum(t), 0) FROM es) + 10000e0)))) AS BIGINT) AS gain
  FROM range({BUCKETS}) r(b) LEFT JOIN ds ON ds.bucket = b LEFT JOIN es ON es.bucket = b),
m AS (SELECT rid, CAST(floor(sum(gain) / CAST(count(*) AS DOUBLE)) AS BIGINT) AS weight FROM du JOIN known USING (f) JOIN g USING (bucket) GROUP BY 1),
sc AS (SELECT d.rid, doc_id, n_words, CAST(len(fs) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5e0) / 4294967296e0))) AS BIGINT) AS score FROM d LEFT JOIN m ON m.rid = d.rid),
r AS (SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) AS rank, count(*) OVER () AS n FROM sc WHERE n_words >= {MIN_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= {PERCENT} * n // 100 THEN rank END AS rank FROM sc LEFT JOIN r USING (rid)
"""
