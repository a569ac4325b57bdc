"""Retrieval by inverted-index joins that stop by bounds.

Postings (term, doc, w) hold what a term gives to a document, and queries (q, term, wq)
what it is worth there; a score is the sum of w * wq over terms in common. The k best
documents of a query are found without scoring every document that shares a term:

1. The terms that can give a query most name the documents that they are worth most to,
   a few times k of them; their exact scores set a floor under the k-th best score.
2. A term gives at most wq times its largest w. Terms whose bounds together stay below
   the floor cannot bring a document among the k best: those that save most postings are
   left out, and only postings of the other terms are joined.
3. What a document has from these terms and the bounds of the rest together must reach
   the floor; only then is it scored exactly.

Where the terms of (2) have most of the postings all the same, all terms are joined at
once: postings lie in buckets by document, so scores are made where they are, and what
does not reach the floor goes no further.

Common words are worth little, so their postings, of which each has as many as there are
documents, are joined with what is left after (3) only. Nothing is dropped: every
document that may reach the floor is scored, and a query with fewer than k documents
gets all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hopweave.sources.shared import bucketed, written

#: Scores are compared to nine digits; bounds leave room for that.
SLACK = 1e-8
#: What sets a query's floor: the first postings of a term by what it is worth to them, as a multiple of k, of so many terms.
HEADS, STRONG = 2, 8
#: Bounds are used where the terms that are needed have no more than this share of the postings.
PAYS = 0.25
#: Documents, and pairs of documents and queries, of a task at most, about.
DEALT, PAIRED = 8_000, 2_000_000
#: Terms whose weights are broadcast at most: some 30 MB.
SHIPPED = 300_000
#: Terms whose first documents set the floor where documents are ruled out by blocks.
SEEDS = 4


def tasks(spark: SparkSession, rows: int, each: int) -> int:
    """Tasks of a shuffle of so many rows: those of the session, and more where each would have more than `each`."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))


def bucket_count(docs: DataFrame, queries: DataFrame) -> int:
    """Tasks that documents are dealt to, which are the buckets of all tables by document."""
    return tasks(docs.sparkSession, docs.count(), max(1, min(DEALT, PAIRED // max(1, queries.count()))))


def dealt(docs: DataFrame, doc: str, buckets: int | None = None) -> DataFrame:
    """docs dealt by id, before texts become tokens: each document is counted where it is, and nothing but texts is shuffled."""
    return docs.repartition(buckets or tasks(docs.sparkSession, docs.count(), DEALT), F.col(doc))


def grams(docs: DataFrame, key: str, tokens: Column, bigrams: bool = False) -> DataFrame:
    """key, a, b: a row for each token a (b is null), and for each pair of adjacent tokens with bigrams."""
    rows = docs.select(key, tokens.alias("__t"))
    # explode() would let the optimizer test each text for tokens where it is read, before it is dealt
    if not bigrams:
        return rows.select(key, F.explode_outer("__t").alias("a"), F.lit(None).cast("string").alias("b")).where("a IS NOT NULL")
    rows = rows.select(key, "__t", F.posexplode_outer("__t").alias("i", "a")).where("a IS NOT NULL")
    # the last token has no pair
    one, pair = (F.struct(F.lit(n).alias("pair"), b.alias("b")) for n, b in ((False, F.lit(None).cast("string")), (True, F.get("__t", F.col("i") + 1))))
    return rows.select(key, "a", F.inline(F.array(one, pair))).where("NOT pair OR b IS NOT NULL").select(key, "a", "b")


def term() -> Column:
    """The term of a row of grams()."""
    return F.when(F.col("b").isNull(), F.col("a")).otherwise(F.concat("a", F.lit(" "), "b")).alias("term")


def term_table(rows: DataFrame, key: str) -> DataFrame:
    """key, term, tf of grams()."""
    return rows.select(key, term()).groupBy(key, "term").agg(F.count("*").alias("tf"))


def idf(terms: DataFrame, n_docs: DataFrame) -> DataFrame:
    """term, df, idf = ln((1 + n) / (1 + df)) + 1 of terms with df; n_docs is one row with n."""
    return terms.select("term", "df").crossJoin(F.broadcast(n_docs)).select("term", "df", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


def frequent(rows: DataFrame, most: int) -> tuple[DataFrame, int]:
    """h (digests of terms), and the least count: of the `most` digests that occur most often and those that occur as often; rows of grams().

    Digests are counted in place of terms: they are short, and no term occurs more often
    than its digest. A least count of 1 is for all terms.
    """
    counts = written(rows.groupBy(F.xxhash64("a", "b").alias("h")).agg(F.count("*").alias("n")).where("n > 1"), "digests")
    last = counts.select("n").orderBy(F.desc("n")).limit(most).agg(F.min("n"), F.count("*")).first()
    least = last[0] if last[1] == most else 1
    return written(counts.where(F.col("n") >= least).select("h"), "frequent"), least


def feature_terms(docs: DataFrame, doc: str, tokens: Column, bigrams: bool, most: int, buckets: int | None = None) -> tuple[DataFrame, DataFrame]:
    """term_table() of the `most` terms that occur most often (ties by term) and some others, and term, df of those terms."""
    buckets = buckets or tasks(docs.sparkSession, docs.count(), DEALT)
    rows = grams(dealt(docs, doc, buckets), doc, tokens, bigrams)
    digests, least = frequent(grams(docs, doc, tokens, bigrams), most)

    def counted(some: DataFrame) -> tuple[DataFrame, DataFrame]:
        terms = bucketed(term_table(some, doc), "terms", doc, buckets)
        stats = terms.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("n")).orderBy(F.desc("n"), "term").limit(most)
        return terms, written(stats, "features")

    if least > 1:
        terms, stats = counted(rows.withColumn("h", F.xxhash64("a", "b")).join(digests, "h", "left_semi"))
        n, fewest = stats.agg(F.count("*"), F.min("n")).first()
        # terms that share a digest can make it seem frequent; unless that pushed others out, no other term is among the most
        if n == most and fewest >= least:
            return terms, stats.select("term", "df")
    terms, stats = counted(rows)
    return terms, stats.select("term", "df")


def common_terms(weights: DataFrame) -> DataFrame | None:
    """The SHIPPED terms at most that most documents have; None if these are all."""
    place = F.floor(F.log2("df") * 8)
    sizes = {r.place: r.n for r in weights.groupBy(place.alias("place")).agg(F.count("*").alias("n")).collect()}  # some hundred rows
    held, least = 0, None
    for at in sorted(sizes, reverse=True):
        held += sizes[at]
        if held > SHIPPED:
            least = at + 1
            break
    return None if least is None else weights.where(place >= least)


def squares(terms: DataFrame, weights: DataFrame, doc: str) -> DataFrame:
    """doc, norm. Weights of the commonest terms go to the rows, which are summed where they are; rows of other terms go to the weights."""
    square = lambda rows: rows.groupBy(doc).agg(F.sum((F.col("tf") * F.col("idf")) * (F.col("tf") * F.col("idf"))).alias("s"))
    common = common_terms(weights)
    if common is None:
        return square(terms.join(F.broadcast(weights.select("term", "idf")), "term")).select(doc, F.sqrt("s").alias("norm"))
    common = written(common.select("term", "idf"), "common")
    rare = terms.join(F.broadcast(common.select("term")), "term", "left_anti").join(weights.select("term", "idf"), "term")
    parts = square(terms.join(F.broadcast(common), "term")).unionByName(square(rare))
    return parts.groupBy(doc).agg(F.sqrt(F.sum("s")).alias("norm"))


def tfidf_index(docs: DataFrame, doc: str, queries: DataFrame, q: str, doc_tokens: Column, query_tokens: Column, bigrams: bool = False, max_features: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Postings of the queries' terms and the queries, for scores that are cosines of TF-IDF vectors.

    max_features keeps the terms that occur most often in all documents, ties by term.
    """
    buckets = bucket_count(docs, queries)
    if max_features is None:
        terms = bucketed(term_table(grams(dealt(docs, doc, buckets), doc, doc_tokens, bigrams), doc), "terms", doc, buckets)
        stats = terms.groupBy("term").agg(F.count("*").alias("df"))
    else:
        terms, stats = feature_terms(docs, doc, doc_tokens, bigrams, max_features, buckets)
    weights = written(idf(stats, docs.agg(F.count("*").alias("n"))), "idf")
    asked = term_table(grams(queries, q, query_tokens, bigrams), q).join(weights, "term").select(q, "term", "idf", (F.col("tf") * F.col("idf")).alias("wq"))
    asked = written(asked, "asked")
    # of the terms that are not asked for a document's norm is all that is needed
    mine = terms.join(written(asked.select("term", "idf").distinct(), "terms"), "term").select(doc, "term", (F.col("tf") * F.col("idf")).alias("w"))
    norms = squares(terms, weights, doc)
    postings = bucketed(mine.join(norms, doc).select("term", doc, (F.col("w") / F.col("norm")).alias("w")), "postings", doc, buckets)
    q_norms = asked.groupBy(q).agg(F.sqrt(F.sum(F.col("wq") * F.col("wq"))).alias("q_norm"))
    return postings, written(asked.join(q_norms, q).select(q, "term", (F.col("wq") / F.col("q_norm")).alias("wq")), "queries")


def overlap_index(docs: DataFrame, doc: str, queries: DataFrame, q: str, doc_tokens: Column, query_tokens: Column) -> tuple[DataFrame, DataFrame]:
    """Postings of the queries' terms and the queries, for scores that are sums of idf over distinct terms in common."""
    asked = written(queries.select(q, F.explode(F.array_distinct(query_tokens)).alias("term")), "asked")
    buckets = bucket_count(docs, queries)
    terms = dealt(docs, doc, buckets).select(doc, F.explode_outer(F.array_distinct(doc_tokens)).alias("term")).where("term IS NOT NULL")
    postings = bucketed(terms.join(asked.select("term").distinct(), "term", "left_semi").select("term", doc, F.lit(1.0).alias("w")), "postings", doc, buckets)
    weights = idf(postings.groupBy("term").agg(F.count("*").alias("df")), docs.agg(F.count("*").alias("n")))
    return postings, written(asked.join(weights, "term").select(q, "term", F.col("idf").alias("wq")), "queries")


def _exact(pairs: DataFrame, doc: str, q: str, postings: DataFrame, asked: DataFrame) -> DataFrame:
    """q, doc, score of pairs."""
    terms = pairs.select(q, doc).join(asked, q)
    return terms.join(postings, [doc, "term"]).groupBy(q, doc).agg(F.sum(F.col("w") * F.col("wq")).alias("score"))


def bounded_terms(postings: DataFrame, asked: DataFrame, doc: str, q: str, k: int) -> DataFrame:
    """q, term, wq, bound, floor, needed: whether a document can be among the k best without any other needed term."""
    stats = postings.groupBy("term").agg(F.count("*").alias("n"), F.max("w").alias("most"))
    terms = written(asked.join(stats, "term").select(q, "term", "wq", "n", (F.col("wq") * F.col("most")).alias("bound")), "bounds")
    strong = F.row_number().over(W.partitionBy(q).orderBy(F.desc("bound"), "term"))
    seeds = written(terms.withColumn("i", strong).where(F.col("i") <= STRONG).select(q, "term"), "seeds")
    # each task passes on a term's first postings only
    heads = postings.join(seeds.select("term").distinct(), "term", "left_semi").withColumn("i", F.row_number().over(W.partitionBy("term").orderBy(F.desc("w"), doc))).where(F.col("i") <= HEADS * k)
    pairs = written(seeds.join(heads.select("term", doc), "term").select(q, doc).distinct(), "heads")
    near = postings.join(pairs.select(doc).distinct(), doc, "left_semi")
    place = F.row_number().over(W.partitionBy(q).orderBy(F.desc("score")))
    floors = _exact(pairs, doc, q, near, terms.select(q, "term", "wq")).withColumn("i", place).where(F.col("i") == k).select(q, F.col("score").alias("floor"))
    rows = terms.join(floors, q, "left").withColumn("floor", F.coalesce(F.col("floor") * (1 - SLACK) - SLACK, F.lit(0.0)))
    cheap = W.partitionBy(q).orderBy(F.col("bound") / F.col("n"), "term").rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("needed", F.sum("bound").over(cheap) >= F.col("floor"))


def by_document(postings: DataFrame, terms: DataFrame, doc: str, q: str) -> DataFrame:
    """q, doc, score of what reaches the floor, by all terms at once: postings lie in buckets by document, and a task has all that a score there is made of."""
    scores = postings.join(terms.select(q, "term", "wq", "floor"), "term").groupBy(q, doc).agg(F.sum(F.col("w") * F.col("wq")).alias("score"), F.max("floor").alias("floor"))
    return scores.where(F.col("score") >= F.col("floor")).drop("floor")


def best_documents(postings: DataFrame, asked: DataFrame, doc: str, q: str, k: int) -> DataFrame:
    """q, doc, score, rank: the k best documents of each query that share a term with it; ties at nine digits by document."""
    terms = written(bounded_terms(postings, asked, doc, q, k), "needed")
    size = terms.agg(F.sum("n"), F.sum(F.when(F.col("needed"), F.col("n")))).first()
    if (size[1] or 0) > PAYS * (size[0] or 0):
        return top_k(by_document(postings, terms, doc, q), q, doc, k)
    rest = terms.groupBy(q).agg(F.max("floor").alias("floor"), F.coalesce(F.sum(F.when(~F.col("needed"), F.col("bound"))), F.lit(0.0)).alias("rest"))
    some = terms.where("needed").select(q, "term", "wq").join(postings, "term").groupBy(q, doc).agg(F.sum(F.col("w") * F.col("wq")).alias("part"))
    able = some.join(rest, q).where(F.col("part") + F.col("rest") >= F.col("floor"))
    more = able.where("rest > 0").select(q, doc).join(terms.where("NOT needed").select(q, "term", "wq"), q).join(postings, [doc, "term"])
    parts = able.select(q, doc, F.col("part").alias("s")).unionByName(more.select(q, doc, (F.col("w") * F.col("wq")).alias("s")))
    return top_k(parts.groupBy(q, doc).agg(F.sum("s").alias("score")), q, doc, k)


def best_by_blocks(postings: DataFrame, asked: DataFrame, doc: str, q: str, k: int) -> DataFrame:
    """What best_documents() gives, for queries whose terms are all common: documents are ruled out by the block.

    A block has the documents that the same term gives most to, and about as much (within
    half a doubling). A query's bound on a block is the sum over its terms of wq and the
    largest w there; of blocks that do not reach the floor no document is looked at.
    """
    most = F.max_by("term", F.struct("w", "term"))
    block = postings.groupBy(doc).agg(most.alias("main"), F.floor(2 * F.log2(F.max("w"))).alias("tier"))
    rows = written(postings.join(block, doc), "blocks")
    tops = rows.groupBy("main", "tier", "term").agg(F.max("w").alias("top"))
    heads = rows.withColumn("i", F.row_number().over(W.partitionBy("term").orderBy(F.desc("w"), doc))).where(F.col("i") <= k)
    worth = asked.join(rows.groupBy("term").agg(F.max("w").alias("most")), "term")
    seeds = worth.withColumn("i", F.row_number().over(W.partitionBy(q).orderBy(F.desc(F.col("wq") * F.col("most")), "term"))).where(F.col("i") <= SEEDS)
    pairs = seeds.select(q, "term").join(heads.select("term", doc), "term").select(q, doc).distinct()
    place = F.row_number().over(W.partitionBy(q).orderBy(F.desc("score")))
    floors = _exact(pairs, doc, q, postings, asked).withColumn("i", place).where(F.col("i") == k).select(q, F.col("score").alias("floor"))
    bounds = asked.join(tops, "term").groupBy(q, "main", "tier").agg(F.sum(F.col("wq") * F.col("top")).alias("bound"))
    open_ = bounds.join(floors, q, "left").where(F.col("bound") >= F.coalesce(F.col("floor") * (1 - SLACK) - SLACK, F.lit(0.0)))
    terms = open_.select(q, "main", "tier").join(asked, q)
    scores = terms.join(rows, ["main", "tier", "term"]).groupBy(q, doc).agg(F.sum(F.col("w") * F.col("wq")).alias("score"))
    return top_k(scores, q, doc, k)


def top_k(scores: DataFrame, q: str, doc: str, k: int) -> DataFrame:
    """The k best documents of each query with their rank; scores are compared to nine digits, ties by document."""
    w = W.partitionBy(q).orderBy(F.desc(F.round("score", 9)), doc)
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def ranking_metrics(ranked: DataFrame, relevance: DataFrame, q: str, doc: str, k: int = 10) -> DataFrame:
    """q, ndcg, ap, rr, precision, recall, hit at k; relevance: q, doc, grade. Queries without a relevant document are left out.

    ap is divided by the number of relevant documents, also where k is less.
    """
    rel = relevance.where("grade > 0")
    ideal = rel.withColumn("r", F.row_number().over(W.partitionBy(q).orderBy(F.desc("grade"), doc)))
    ideal = ideal.groupBy(q).agg(F.sum(F.when(F.col("r") <= k, (F.pow(2.0, F.col("grade")) - 1) / F.log2(F.col("r") + 1))).alias("idcg"), F.count("*").alias("n_rel"))
    hits = ranked.where(F.col("rank") <= k).join(rel, [q, doc])
    hits = hits.withColumn("nth", F.row_number().over(W.partitionBy(q).orderBy("rank")))
    got = hits.groupBy(q).agg(
        F.sum((F.pow(2.0, F.col("grade")) - 1) / F.log2(F.col("rank") + 1)).alias("dcg"),
        F.sum(F.col("nth") / F.col("rank")).alias("sp"), F.min("rank").alias("first"), F.count("*").alias("n_hit"),
    )
    out = ideal.join(got, q, "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return out.select(
        q, zero(F.col("dcg") / F.col("idcg")).alias("ndcg"), zero(F.col("sp") / F.col("n_rel")).alias("ap"), zero(1 / F.col("first")).alias("rr"),
        zero(F.col("n_hit") / F.lit(k)).alias("precision"), zero(F.col("n_hit") / F.col("n_rel")).alias("recall"), F.when(F.col("n_hit") > 0, 1).otherwise(0).alias("hit"),
    )
