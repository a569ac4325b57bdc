"""Mixing sources to target weights: integer quotas of equal blocks by Sainte-Lague.

Sources get a share of the budget by weight; a source that would be repeated more often
than allowed stops there, and the rest is shared again. The budget is counted in blocks
of BLOCK words, and the blocks go to the sources by highest quotients target / (2 k - 1),
k being the blocks that a source would then have. A source's documents are dealt into
shards by a seeded digest, and its blocks go to its shards in the same way by their
words. In a shard the documents follow each other by digest, the words are cut into
blocks of equal length (of one word more or less), and as many blocks as the quota says
are taken: all of them as often as the quota has them all, and of the rest those that a
seeded permutation (a * block + b modulo the number of blocks, a prime) puts first. What
is taken of a document follows from its place in the shard by arithmetic, so no row is
made for a block.

Only a number and a digest of each document are shuffled, by source and shard. One row for
each source is ordered in one task, and one row for each shard (some thousand documents)
in a task of its source.

Defined cases: a null text has no words, and nothing is taken of it; a null source is a
source of its own, the last one; null ids count as the empty text; rows equal in id and
text are interchangeable, and every one counts; without any words all targets are 0; an
empty table gives an empty table; other columns are not read. A source of fewer than
about BLOCK words is one block, and is taken as a whole, up to `repeats` times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hopweave.llm.shared import written

SPACES = r"\x20\x09-\x0D"
#: Words of a block.
BLOCK = 16
#: A source has a shard more for each so many documents, and for each so many words.
SHARD_ROWS, SHARD_WORDS = 4096, 1 << 22
WEIGHTS = (3, 1, 2)
PERCENT, REPEATS, SEED = 150, 2, "11"
#: Multiplier of the permutation: a prime above any number of blocks in a shard.
PRIME = 2654435761


def n_words(text: Column) -> Column:
    """Runs of characters other than U+0020 and U+0009 to U+000D; each becomes one letter, so no list of words is made."""
    t = F.rtrim(F.coalesce(text.cast("string"), F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.length(F.regexp_replace(t, rf"[{SPACES}]*[^{SPACES}]+", "w")).cast("long")


def _digest(text: Column, digits: int) -> Column:
    """The first hexadecimal digits of a md5 as a number."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, digits), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = PERCENT, repeats: int = REPEATS) -> DataFrame:
    """sizes (source, source_size, any other columns) with nth (its place by code point, null last) and target.

    Sources are capped in the order of size to weight: one is if its share of what those
    before it leave is above its cap, and then all before it are.
    """
    one = W.partitionBy(F.lit(0))
    rows = sizes.withColumn("nth", F.row_number().over(one.orderBy(F.col("source").asc_nulls_last())))
    rows = rows.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("nth") - 1, len(weights)) + 1).cast("long"))
    rows = rows.withColumns({"cap": F.col("source_size") * repeats, "budget": F.sum("source_size").over(one) * percent / 100, "all_w": F.sum("w").over(one)})
    upto = one.orderBy(F.col("cap") / F.col("w"), "nth").rowsBetween(W.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(upto), F.lit(0))
    rows = rows.withColumn("capped", F.col("cap") / F.col("w") <= (F.col("budget") - before("cap")) / (F.col("all_w") - before("w")))
    capped = lambda c: F.coalesce(F.sum(F.when(F.col("capped"), F.col(c))).over(one), F.lit(0))
    rows = rows.withColumns({"open_w": F.col("all_w") - capped("w"), "open": F.col("budget") - capped("cap")})
    rows = rows.withColumn("target", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("w") * (F.col("open") / F.nullif(F.col("open_w"), F.lit(0)))))
    return rows.select(*sizes.columns, "nth", "target")


def apportion(cells: DataFrame, group: list[str], votes: str, seats: str, most: str, order: str, out: str) -> DataFrame:
    """cells with out: how many of their group's seats they get by highest quotients votes / (2 k - 1), `most` at most; ties by order.

    Any divisor's rounded shares are a beginning of the sequence of highest quotients, so
    only the last of them, about two for each cell, are compared one by one.
    """
    g = W.partitionBy(*group) if group else W.partitionBy(F.lit(0))
    rows = cells.withColumns({"__all": F.sum(votes).over(g).cast("double"), "__n": F.count(F.lit(1)).over(g)})
    share = lambda s: F.least(F.col(most), F.floor(F.col(votes) * s / F.col("__all") + 0.5).cast("long"))
    sure = F.when(F.col("__all") > 0, share(F.greatest(F.col(seats) - F.col("__n") / 2, F.lit(0.0)))).otherwise(F.lit(0).cast("long"))
    last = F.when(F.col("__all") > 0, F.least(F.col(most), share(F.col(seats) + F.col("__n") / 2) + 1)).otherwise(F.lit(0).cast("long"))
    rows = rows.withColumns({"__sure": sure, "__last": last})
    rows = rows.withColumn("__left", F.col(seats) - F.sum("__sure").over(g))
    more = rows.where("__last > __sure").select(*group, order, votes, "__left", F.explode(F.expr("sequence(__sure + 1, __last)")).alias("__k"))
    place = F.row_number().over(g.orderBy(F.desc(F.col(votes) / (2 * F.col("__k") - 1)), order, "__k"))
    won = more.withColumn("__place", place).where("__place <= __left").groupBy(*group, order).agg(F.count("*").alias("__won"))
    rows = rows.join(won, [*group, order], "left")
    return rows.select(*cells.columns, (F.col("__sure") + F.coalesce("__won", F.lit(0))).alias(out))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = PERCENT, repeats: int = REPEATS, block: int = BLOCK, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """What the mix takes of each document: doc_id, source, size, source_size, target, shard, passes, extra.

    A document's words are taken `passes` times, and those of the spans in extra
    (from_word, to_word: numbers of words, the end exclusive) once more.
    """
    doc, text = F.col(id_col), F.col(text_col).cast("string")
    key = _digest(F.concat_ws(":", F.lit(seed), F.coalesce(doc.cast("string"), F.lit("")), F.coalesce(text, F.lit(""))), 15)
    sized = written(docs.select(doc.alias("doc_id"), F.col(source_col).cast("string").alias("source"), n_words(text).alias("size"), key.alias("key")), "sized")
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    sources = targets(sizes, weights, percent, repeats)
    sources = sources.withColumn("shards", F.expr(f"1 + n_docs div {SHARD_ROWS} + source_size div {SHARD_WORDS}"))
    sources = written(sources, "sources")  # one row for each source
    rows = sized.join(sources.select(F.col("source").alias("__source"), "nth", "source_size", "target", "shards"), F.col("source").eqNullSafe(F.col("__source")))
    rows = rows.drop("__source").withColumn("shard", F.col("key") % F.col("shards"))

    cells = rows.groupBy("nth", "shard").agg(F.sum("size").alias("words")).where("words > 0")
    cells = written(cells.withColumn("blocks", F.greatest(F.lit(1).cast("long"), F.floor(F.col("words") / block + 0.5).cast("long"))), "cells")
    whole = cells.groupBy("nth").agg((F.sum("blocks") * repeats).alias("most"))
    whole = whole.join(sources.select("nth", "target"), "nth").withColumn("seats", F.floor(F.sum("target").over(W.partitionBy(F.lit(0))) / block + 0.5).cast("long"))
    given = apportion(whole, [], "target", "seats", "most", "nth", "quota").select("nth", "quota")
    given = cells.join(given, "nth").withColumn("most", F.col("blocks") * repeats)
    given = apportion(given, ["nth"], "words", "quota", "most", "shard", "taken_blocks")
    given = given.select("nth", "shard", "words", "blocks", F.expr("taken_blocks div blocks").alias("passes"), (F.col("taken_blocks") % F.col("blocks")).alias("rest"), _digest(F.concat_ws(":", F.lit(seed), "nth", "shard"), 7).alias("start"))

    at = W.partitionBy("nth", "shard").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.join(given, ["nth", "shard"], "left").withColumn("at", F.coalesce(F.sum("size").over(at), F.lit(0)))
    rows = rows.withColumns({"first": F.expr("((at + 1) * blocks - 1) div words"), "last": F.expr("((at + size) * blocks - 1) div words")})
    extra = F.expr(
        f"""CASE WHEN size > 0 AND rest > 0 THEN transform(
            filter(sequence(first, last), j -> (j * {PRIME}L + start) % blocks < rest),
            j -> struct(greatest((j * words) div blocks - at, 0L) AS from_word, least(((j + 1) * words) div blocks - at, size) AS to_word))
        ELSE array() END"""
    )
    return rows.select("doc_id", "source", "size", "source_size", "target", "shard", F.coalesce("passes", F.lit(0)).cast("long").alias("passes"), extra.alias("extra"))


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    more = F.aggregate("extra", F.lit(0).cast("long"), lambda n, x: n + x["to_word"] - x["from_word"])
    return rows.select("doc_id", "size", "source_size", "target", (F.col("passes") * F.col("size") + more).alias("taken"))


def _apportion_sql(name: str, cells: str, group: str, votes: str, seats: str, most: str, order: str) -> str:
    """Tables name_a, name_b and name: the cells with their quota."""
    by = f"PARTITION BY {group}" if group else ""
    keys = f"{group}, {order}" if group else order
    return f"""
{name}_a AS (SELECT *, CAST(sum({votes}) OVER ({by}) AS DOUBLE) AS every, count(*) OVER ({by}) AS n FROM {cells}),
{name}_b AS (SELECT *, CASE WHEN every > 0 THEN least({most}, CAST(floor({votes} * greatest({seats} - n / 2e0, 0e0) / every + 0.5e0) AS BIGINT)) ELSE 0 END AS sure,
  CASE WHEN every > 0 THEN least({most}, least({most}, CAST(floor({votes} * ({seats} + n / 2e0) / every + 0.5e0) AS BIGINT)) + 1) ELSE 0 END AS last FROM {name}_a),
{name}_c AS (SELECT *, {seats} - sum(sure) OVER ({by}) AS remains FROM {name}_b),
{name}_d AS (SELECT *, row_number() OVER ({by} ORDER BY {votes} / CAST(2 * k - 1 AS DOUBLE) DESC, {order}, k) AS place FROM (SELECT {keys}, {votes}, remains, unnest(range(sure + 1, last + 1)) AS k FROM {name}_c)),
{name} AS (SELECT c.*, sure + coalesce(won, 0) AS given FROM {name}_c c LEFT JOIN (SELECT {keys}, count(*) AS won FROM {name}_d WHERE place <= remains GROUP BY {keys}) x USING ({keys}))"""


OP11_SQL = rf"""
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
  CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15) AS BIGINT) AS key FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n_docs FROM sized GROUP BY 1),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS nth FROM s0),
s2 AS (SELECT *, [{", ".join(map(str, WEIGHTS))}][(nth - 1) % {len(WEIGHTS)} + 1] AS w, source_size * {REPEATS} AS cap FROM s1),
s3 AS (SELECT *, CAST(cap AS DOUBLE) / w AS ratio, CAST(sum(source_size) OVER () AS DOUBLE) * {PERCENT} / 100e0 AS budget, sum(w) OVER () AS all_w FROM s2),
s4 AS (SELECT *, ratio <= (budget - CAST(coalesce(sum(cap) OVER o, 0) AS DOUBLE)) / (all_w - coalesce(sum(w) OVER o, 0)) AS capped FROM s3 WINDOW o AS (ORDER BY ratio, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s5 AS (SELECT *, CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE w * ((budget - CAST(coalesce(sum(cap) FILTER (capped) OVER (), 0) AS DOUBLE)) / CAST(nullif(all_w - coalesce(sum(w) FILTER (capped) OVER (), 0), 0) AS DOUBLE)) END AS target FROM s4),
sources AS (SELECT source, source_size, nth, target, 1 + n_docs // {SHARD_ROWS} + source_size // {SHARD_WORDS} AS shards FROM s5),
placed AS (SELECT d.*, nth, source_size, target, key % shards AS shard FROM sized d JOIN sources s ON d.source IS NOT DISTINCT FROM s.source),
cells AS (SELECT *, greatest(1, CAST(floor(words / {BLOCK}e0 + 0.5e0) AS BIGINT)) AS blocks FROM (SELECT nth, shard, CAST(sum(size) AS BIGINT) AS words FROM placed GROUP BY 1, 2 HAVING sum(size) > 0)),
whole AS (SELECT nth, target, most, CAST(floor(sum(target) OVER () / {BLOCK}e0 + 0.5e0) AS BIGINT) AS seats FROM (SELECT nth, CAST(sum(blocks) * {REPEATS} AS BIGINT) AS most FROM cells GROUP BY 1) JOIN sources USING (nth)),
{_apportion_sql("a", "whole", "", "target", "seats", "most", "nth").strip()},
fine AS (SELECT cells.*, given AS quota, blocks * {REPEATS} AS most FROM cells JOIN a USING (nth)),
{_apportion_sql("b", "fine", "nth", "words", "quota", "most", "shard").strip()},
given AS (SELECT nth, shard, words, blocks, CAST(given // blocks AS BIGINT) AS passes, CAST(given % blocks AS BIGINT) AS rest, CAST('0x' || substr(md5('{SEED}:' || nth || ':' || shard), 1, 7) AS BIGINT) AS start FROM b),
laid AS (SELECT p.*, words, blocks, coalesce(passes, 0) AS passes, rest, start, CAST(coalesce(sum(size) OVER (PARTITION BY nth, shard ORDER BY key, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS here FROM placed p LEFT JOIN given USING (nth, shard)),
cut AS (SELECT *, CASE WHEN size > 0 AND rest > 0 THEN list_filter(range(((here + 1) * blocks - 1) // words, ((here + size) * blocks - 1) // words + 1), lambda j: (j * {PRIME} + start) % blocks < rest) ELSE [] END AS js FROM laid)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(passes * size + coalesce(list_sum(list_transform(js, lambda j: least(((j + 1) * words) // blocks - here, size) - greatest((j * words) // blocks - here, 0))), 0) AS BIGINT) AS taken
FROM cut
"""
