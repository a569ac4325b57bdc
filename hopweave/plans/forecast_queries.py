"""Queries of forecasts, retrieval and evaluation."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from hopweave.functions import fuzzy
from hopweave.functions import text as T
from hopweave.operators import evaluate as E
from hopweave.operators import forecast as M
from hopweave.operators import next_place as P
from hopweave.operators import retrieval as R
from hopweave.operators import runner
from hopweave.operators import trajectory as J
from hopweave.plans.register import query
from hopweave.plans.views import cases, event_hops, hops, table, with_event_hops, with_hops
from hopweave.sources import runs
from hopweave.sources.catalog import Catalog
from hopweave.sources.shared import shared_folder, written

_GRAMS = """, c AS (SELECT * FROM (SELECT *, lag(loc) OVER (PARTITION BY victim ORDER BY event_id) AS before FROM event_hops) WHERE before IS NULL OR before <> loc),
l AS (SELECT victim, event_id, lag(loc, 2) OVER w AS c2, lag(loc) OVER w AS c1, loc AS w FROM c WINDOW w AS (PARTITION BY victim ORDER BY event_id)),
u AS (SELECT w, count(*) AS n1 FROM l GROUP BY 1), b AS (SELECT c1, w, count(*) AS n2 FROM l WHERE c1 IS NOT NULL GROUP BY 1, 2), t AS (SELECT c2, c1, w, count(*) AS n3 FROM l WHERE c2 IS NOT NULL GROUP BY 1, 2, 3),
x AS (SELECT victim, arg_max(w, event_id) AS c1, max(struct_pack(e := event_id, c := c1)).c AS c2 FROM l GROUP BY 1),
y AS (SELECT x.*, d2, d3, t1, v FROM x LEFT JOIN (SELECT c1, sum(n2) AS d2 FROM b GROUP BY 1) p ON p.c1 = x.c1 LEFT JOIN (SELECT c2, c1, sum(n3) AS d3 FROM t GROUP BY 1, 2) q ON q.c1 = x.c1 AND q.c2 = x.c2, (SELECT sum(n1) AS t1, count(*) AS v FROM u)),
k AS (SELECT y.*, b.w FROM y JOIN b ON b.c1 = y.c1 WHERE d2 IS NOT NULL UNION ALL SELECT y.*, u.w FROM y, u WHERE d2 IS NULL),
m AS (SELECT victim, k.w, (CASE WHEN coalesce(d3, 0) > 0 THEN 0.6e0 * (coalesce(n3, 0) + 0.05e0) / (d3 + 0.05e0 * v) ELSE 0 END + CASE WHEN coalesce(d2, 0) > 0 THEN 0.3e0 * (coalesce(n2, 0) + 0.05e0) / (d2 + 0.05e0 * v) ELSE 0 END + 0.1e0 * (n1 + 0.05e0) / (t1 + 0.05e0 * v))
  / (CASE WHEN coalesce(d3, 0) > 0 THEN 0.6e0 ELSE 0 END + CASE WHEN coalesce(d2, 0) > 0 THEN 0.3e0 ELSE 0 END + 0.1e0) AS p
  FROM k JOIN u ON u.w = k.w LEFT JOIN b ON b.c1 = k.c1 AND b.w = k.w LEFT JOIN t ON t.c2 = k.c2 AND t.c1 = k.c1 AND t.w = k.w),
z AS (SELECT victim, w, p / sum(p) OVER (PARTITION BY victim) AS prob FROM m)
"""


def with_grams(sql: str) -> str:
    return with_event_hops("").rstrip() + _GRAMS + sql


def model(spark, d):
    rows = event_hops(spark, d)
    return M.ngrams(rows, "victim", "loc", "event_id"), M.contexts(rows, "victim", "loc", "event_id")


@query("ngram_counts", with_grams("SELECT 1 AS n, NULL::VARCHAR AS c2, NULL::VARCHAR AS c1, w, n1 AS count FROM u UNION ALL SELECT 2, NULL, c1, w, n2 FROM b UNION ALL SELECT 3, c2, c1, w, n3 FROM t"))
def _(spark, d):
    return model(spark, d)[0]


@query("next_distribution", with_grams("SELECT victim, w, round(prob, 6) AS prob FROM z"))
def _(spark, d):
    return M.next_distribution(*model(spark, d), "victim").withColumn("prob", F.round("prob", 6))


@query("next_top3", with_grams("SELECT victim, w, CAST(r AS INTEGER) AS rank FROM (SELECT victim, w, row_number() OVER (PARTITION BY victim ORDER BY round(prob, 12) DESC, w) AS r FROM z) WHERE r <= 3"))
def _(spark, d):
    return M.next_ranked(*model(spark, d), "victim", 3).select("victim", "w", "rank")


@query("next_top1", with_grams("SELECT w, count(*) AS n FROM (SELECT w, row_number() OVER (PARTITION BY victim ORDER BY round(prob, 12) DESC, w) AS r FROM z) WHERE r = 1 GROUP BY 1 ORDER BY n DESC, w LIMIT 10"))
def _(spark, d):
    return M.top_next(*model(spark, d), "victim")


#: The best place after each pair of places, and after one place without another before it.
_CONTEXTS = "x AS (SELECT coalesce(a.w, '') || '>' || b.w AS victim, a.w AS c2, b.w AS c1 FROM (SELECT w FROM u UNION ALL SELECT NULL) a, u b)"
_PATH = _GRAMS.replace("x AS (SELECT victim, arg_max(w, event_id) AS c1, max(struct_pack(e := event_id, c := c1)).c AS c2 FROM l GROUP BY 1)", _CONTEXTS)


@query(
    "next_path",
    with_event_hops("").rstrip()
    + _PATH.rstrip()
    + """, best AS (SELECT victim AS k, w, prob FROM (SELECT *, row_number() OVER (PARTITION BY victim ORDER BY round(prob, 12) DESC, w) AS r FROM z) WHERE r = 1),
s0 AS (SELECT victim, max(struct_pack(e := event_id, c := c1)).c AS c2, arg_max(w, event_id) AS c1 FROM l GROUP BY 1),
s1 AS (SELECT victim, c1 AS c2, w AS c1, prob FROM s0 JOIN best ON k = coalesce(c2, '') || '>' || c1), s2 AS (SELECT victim, c1 AS c2, w AS c1, best.prob FROM s1 JOIN best ON k = coalesce(c2, '') || '>' || c1),
s3 AS (SELECT victim, c1 AS c2, w AS c1, best.prob FROM s2 JOIN best ON k = coalesce(c2, '') || '>' || c1)
SELECT victim, 1 AS step, c1 AS w, round(prob, 6) AS prob FROM s1 UNION ALL SELECT victim, 2, c1, round(prob, 6) FROM s2 UNION ALL SELECT victim, 3, c1, round(prob, 6) FROM s3""",
)
def _(spark, d):
    return M.next_path(*model(spark, d), "victim", 3).withColumn("prob", F.round("prob", 6))


_LINKS = """, c AS (SELECT * FROM (SELECT *, lag(loc) OVER (PARTITION BY victim ORDER BY ord) AS before FROM hops) WHERE before IS NULL OR before <> loc),
v AS (SELECT victim, loc, count(*) AS times FROM c GROUP BY 1, 2), a AS (SELECT loc, actor, count(*) AS n FROM hops GROUP BY 1, 2),
s AS (SELECT victim, actor, sum(n * times) AS s FROM v JOIN a ON v.loc = a.loc GROUP BY 1, 2), sc AS (SELECT victim, actor, s / sum(s) OVER (PARTITION BY victim) AS score FROM s)
"""


@query("link_scores", with_hops("").rstrip() + _LINKS + "SELECT victim, actor, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY victim ORDER BY round(score, 12) DESC, actor) AS rank FROM sc) WHERE rank <= 5")
def _(spark, d):
    rows = M.link_ranked(hops(spark, d), "victim", "loc", "ord", "actor", 5)
    return rows.withColumn("score", F.round("score", 6)).select("victim", "actor", "score", "rank")


@query("link_top1", with_hops("").rstrip() + _LINKS + "SELECT actor, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY victim ORDER BY round(score, 12) DESC, actor) AS rank FROM sc) WHERE rank = 1 GROUP BY 1 ORDER BY n DESC, actor LIMIT 10")
def _(spark, d):
    best = M.link_ranked(hops(spark, d), "victim", "loc", "ord", "actor", 1)
    return best.groupBy("actor").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "actor").limit(10)


@query("link_run", with_hops("").rstrip() + _LINKS + "SELECT victim, actor, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY victim ORDER BY round(score, 12) DESC, actor) AS rank FROM sc) WHERE rank <= 3")
def _(spark, d):
    """Linked actors as they are read back from a saved run."""
    c = Catalog(spark, f"{shared_folder(spark)}/runs-{uuid.uuid4().hex}")
    best = M.link_ranked(hops(spark, d), "victim", "loc", "ord", "actor", 3)
    id_ = runs.save_links(c, ["hops"], best, "victim", "actor")
    saved = c.load(id_)
    return saved.select("victim", F.inline("predictions")).select("victim", F.col("perpetrator").alias("actor"), F.round("score", 6).alias("score"))


@query(
    "arrival_run",
    with_hops("").rstrip() + ", s AS (SELECT victim, ord, loc, gap_days FROM hops WHERE gap_days IS NOT NULL AND ord <= 4) SELECT victim, CAST(count(*) OVER (PARTITION BY victim) AS BIGINT) AS steps, loc AS place, gap_days AS eta_days, round(gap_days / 7e0, 2) AS eta_weeks FROM s",
)
def _(spark, d):
    """Days to the first places of each subject as they are read back from a saved run."""
    c = Catalog(spark, f"{shared_folder(spark)}/runs-{uuid.uuid4().hex}")
    steps = hops(spark, d).where("gap_days IS NOT NULL AND ord <= 4").select("victim", F.col("ord").alias("step"), F.col("loc").alias("to"), F.col("gap_days").alias("days"))
    saved = c.load(runs.save_arrivals(c, ["hops"], steps, "victim", "2020-01-01"))
    return saved.select("victim", "steps", F.inline("steps_detail")).select("victim", "steps", F.col("to").alias("place"), F.col("eta_days").cast("int").alias("eta_days"), "eta_weeks")


@query("evaluation_report")
def _(spark, d):
    """Figures of an evaluation from end to end: hops are saved as a dataset, loaded, resolved, split and evaluated, and the report is saved and read back."""
    c = Catalog(spark, f"{shared_folder(spark)}/runs-{uuid.uuid4().hex}")
    rows = hops(spark, d).select("victim", F.col("ord").cast("string").alias("ord"), "loc", F.concat(F.col("gap_days").cast("string"), F.lit(" days")).alias("stay"), F.array("actor").alias("perps"))
    rows = written(rows, "hops")
    ids = [c.save(rows.where(F.crc32(F.col("victim").cast("binary")) % 2 == n), f"part {n}", "processed") for n in (0, 1)]
    report = runner.run(c, ids, {"sid": "victim", "route": "ord", "location": "loc", "time": "stay"}, ["perps"])
    saved = c.load_json(runs.save_report(c, "hops", report, ids))
    return runner.figures(saved, spark).withColumn("value", F.round("value", 6))


_FIRST_LINK = "(SELECT victim, actor FROM (SELECT *, row_number() OVER (PARTITION BY victim ORDER BY round(score, 12) DESC, actor) AS rank FROM sc) WHERE rank = 1)"


@query("predictions_last_place", with_hops("").rstrip() + _LINKS + f"SELECT victim, actor, last_place FROM {_FIRST_LINK} LEFT JOIN (SELECT victim, arg_max(loc, ord) AS last_place FROM hops GROUP BY 1) USING (victim)")
def _(spark, d):
    rows = hops(spark, d)
    return M.with_last_place(M.link_ranked(rows, "victim", "loc", "ord", "actor", 1), rows, "victim", "loc", "ord").select("victim", "actor", "last_place")


@query("actors_by_last_place", with_hops("").rstrip() + _LINKS + f"SELECT last_place, actor, count(*) AS n FROM {_FIRST_LINK} JOIN (SELECT victim, arg_max(loc, ord) AS last_place FROM hops GROUP BY 1) USING (victim) GROUP BY 1, 2")
def _(spark, d):
    rows = hops(spark, d)
    return M.actors_by_last_place(M.link_ranked(rows, "victim", "loc", "ord", "actor", 1), rows, "victim", "loc", "ord", "actor")


_ONE = with_grams("SELECT w, round(prob, 6) AS prob FROM z").replace("x AS (SELECT victim, arg_max(w, event_id) AS c1, max(struct_pack(e := event_id, c := c1)).c AS c2 FROM l GROUP BY 1)", "x AS (SELECT 'one' AS victim, 'click' AS c1, 'view' AS c2)")


@query("predict_next_dist", _ONE)
def _(spark, d):
    return M.predict_next_dist(model(spark, d)[0], "view", "click").withColumn("prob", F.round("prob", 6))


_MED = ", g AS (SELECT lag(loc) OVER (PARTITION BY victim ORDER BY ord) AS a, loc AS b, gap_days AS d, victim, ord FROM hops), g2 AS (SELECT * FROM g WHERE d IS NOT NULL)"


@query(
    "eta_one_step",
    with_hops("").rstrip() + _MED + " SELECT victim, CAST(ord AS INTEGER) AS ord, CAST(coalesce(p, o, (SELECT floor(median(d)) FROM g2), 7) AS DOUBLE) AS days FROM g LEFT JOIN (SELECT a, b, floor(median(d)) AS p FROM g2 WHERE a IS NOT NULL AND victim <> 'C1' GROUP BY 1, 2) x ON x.a = g.a AND x.b = g.b LEFT JOIN (SELECT b, floor(median(d)) AS o FROM g2 WHERE victim <> 'C1' GROUP BY 1) y ON y.b = g.b".replace("(SELECT floor(median(d)) FROM g2)", "(SELECT floor(median(d)) FROM g2 WHERE victim <> 'C1')"),
)
def _(spark, d):
    rows = hops(spark, d)
    # a subject's first hop has no pair and takes the place's median
    medians = J.duration_medians(rows.where("victim <> 'C1'"), "victim", "loc", "ord", F.col("gap_days"))
    steps = J.next_place(rows, "victim", "loc", "ord").select("victim", "ord", F.col("previous").alias("a"), F.col("loc").alias("b"))
    return M.eta(steps, "a", "b", medians).select("victim", "ord", "days")


_STEPS = ", st AS (SELECT victim, loc AS a, lead(loc) OVER (PARTITION BY victim ORDER BY ord) AS b, CAST(lead(gap_days) OVER (PARTITION BY victim ORDER BY ord) AS DOUBLE) AS days, CAST(substr(victim, 2) AS BIGINT) % 10 < 3 AS held FROM hops QUALIFY b IS NOT NULL)"


def steps(spark, d):
    rows = hops(spark, d).withColumn("held", F.expr("cast(substring(victim, 2) as bigint) % 10 < 3"))
    nxt = J.next_place(rows, "victim", "loc", "ord")
    from pyspark.sql import Window as W

    days = F.lead("gap_days").over(W.partitionBy("victim").orderBy("ord")).cast("double")
    rows = nxt.select("victim", F.col("loc").alias("a"), F.col("next").alias("b"), days.alias("days"), "held").where("b IS NOT NULL")
    return rows.where("NOT held"), rows.where("held")


@query(
    "nextloc_accuracy",
    with_hops("").rstrip() + _STEPS + ", r AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY count(*) DESC, b) AS rank FROM st WHERE NOT held GROUP BY 1, 2) SELECT count(*) AS n, round(avg(CASE WHEN rank <= 1 THEN 1e0 ELSE 0 END), 6) AS acc_1, round(avg(CASE WHEN rank <= 3 THEN 1e0 ELSE 0 END), 6) AS acc_3, round(avg(CASE WHEN rank <= 5 THEN 1e0 ELSE 0 END), 6) AS acc_5 FROM st LEFT JOIN r ON r.a = st.a AND r.b = st.b WHERE held",
)
def _(spark, d):
    return M.majority_accuracy(*steps(spark, d)).withColumns({c: F.round(c, 6) for c in ("acc_1", "acc_3", "acc_5")})


@query("eta_mae", with_hops("").rstrip() + _STEPS + " SELECT count(*) AS n, round(avg(abs(coalesce(p, (SELECT median(days) FROM st WHERE NOT held)) - days)), 6) AS mae FROM st LEFT JOIN (SELECT a, b, median(days) AS p FROM st WHERE NOT held GROUP BY 1, 2) m ON m.a = st.a AND m.b = st.b WHERE held")
def _(spark, d):
    return M.eta_mae(*steps(spark, d), "days").withColumn("mae", F.round("mae", 6))


def place_windows(spark, d):
    """Hops, the day before which models are trained (four fifths of the time), and windows of hops."""
    rows = hops(spark, d)
    cut = table(spark, d, "orders").agg(F.expr("date_add(to_date(min(o_orderdate)), cast(0.8 * datediff(max(o_orderdate), min(o_orderdate)) as int))")).first()[0]
    return rows, F.lit(cut), written(P.windows(rows, "victim", "loc", "ord", "on_date"), "windows")


@query("place_windows", with_hops("").rstrip() + ", c AS (SELECT * FROM (SELECT *, lag(loc) OVER (PARTITION BY victim ORDER BY ord) AS before FROM hops) WHERE before IS NULL OR before <> loc) SELECT victim, CAST(ord AS INTEGER) AS ord, on_date, loc AS lag_1, lag(loc) OVER w AS lag_2, lag(loc, 2) OVER w AS lag_3, lead(loc) OVER w AS next FROM c WINDOW w AS (PARTITION BY victim ORDER BY ord) QUALIFY lag_3 IS NOT NULL")
def _(spark, d):
    return P.windows(hops(spark, d), "victim", "loc", "ord", "on_date")


@query("next_place_model")
def _(spark, d):
    """The three likeliest places after each subject's last window, by the trained model."""
    _, cut, windows = place_windows(spark, d)
    model = P.fit(windows.where(F.col("on_date") < cut))
    return P.next_ranked(model, windows, "victim", 3).withColumn("prob", F.round("prob", 6))


@query("next_place_accuracy")
def _(spark, d):
    rows, cut, windows = place_windows(spark, d)
    before = F.col("on_date") < cut
    out = P.compared(rows.where(before), windows.where(before), windows.where(~before), "victim", "loc", "ord")
    return out.withColumns({c: F.round(c, 6) for c in ("acc_1", "acc_3", "acc_5")})


@query("lag_windows", with_event_hops(", i AS (SELECT loc, row_number() OVER (ORDER BY count(*) DESC, loc) AS i FROM event_hops GROUP BY 1), q AS (SELECT victim, event_id, lag(i, 3) OVER w AS a, lag(i, 2) OVER w AS b, lag(i) OVER w AS c, i AS target FROM event_hops JOIN i ON i.loc = event_hops.loc WINDOW w AS (PARTITION BY victim ORDER BY event_id)) SELECT victim, event_id, a || ',' || b || ',' || c AS win, CAST(target AS INTEGER) AS target FROM q WHERE a IS NOT NULL").replace(") , i AS", "), i AS"))
def _(spark, d):
    rows = M.lag_windows(event_hops(spark, d), "victim", "loc", "event_id")
    return rows.select("victim", "event_id", F.array_join(F.transform("window", lambda x: x.cast("string")), ",").alias("win"), "target")


_TFIDF = """WITH dt AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]{2,}')) AS term FROM documents) GROUP BY 1, 2),
qt AS (SELECT item_id, term, count(*) AS tf FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]{2,}')) AS term FROM benchmark) GROUP BY 1, 2),
w AS (SELECT term, ln((1e0 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf FROM dt GROUP BY 1),
dn AS (SELECT doc_id, sqrt(sum(tf * idf * tf * idf)) AS norm FROM dt JOIN w USING (term) GROUP BY 1), qn AS (SELECT item_id, sqrt(sum(tf * idf * tf * idf)) AS q_norm FROM qt JOIN w USING (term) GROUP BY 1)
"""


@query("tfidf_topk", _TFIDF + ", s AS (SELECT item_id, doc_id, dot / (norm * q_norm) AS score FROM (SELECT item_id, doc_id, sum(qt.tf * idf * dt.tf * idf) AS dot FROM qt JOIN w USING (term) JOIN dt USING (term) GROUP BY 1, 2) JOIN dn USING (doc_id) JOIN qn USING (item_id)) SELECT item_id, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s) WHERE rank <= 10")
def _(spark, d):
    tokens = T.retrieval_tokens(F.col("text"))
    index = R.tfidf_index(table(spark, d, "documents"), "doc_id", table(spark, d, "benchmark"), "item_id", tokens, tokens)
    return R.best_documents(*index, "doc_id", "item_id", 10).withColumn("score", F.round("score", 6)).select("item_id", "doc_id", "score", "rank")


_FEATURES = 50_000
_PAIRED = lambda t: f"list_concat({t}, list_transform(list_zip({t}[:-2], {t}[2:]), lambda x: x[1] || ' ' || x[2]))"
_TK = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]{2,}')"


@query(
    "tfidf_bigrams",
    f"""WITH a AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_PAIRED('k')}) AS term FROM (SELECT doc_id, {_TK} AS k FROM documents)) GROUP BY 1, 2),
qt AS (SELECT item_id, term, count(*) AS tf FROM (SELECT item_id, unnest({_PAIRED('k')}) AS term FROM (SELECT item_id, {_TK} AS k FROM benchmark)) GROUP BY 1, 2),
most AS (SELECT term FROM a GROUP BY 1 ORDER BY sum(tf) DESC, term LIMIT {_FEATURES}), dt AS (SELECT a.* FROM a JOIN most USING (term)),"""
    + _TFIDF[_TFIDF.index("\nw AS") :].replace("\nw AS", "w AS", 1)
    + """, s AS (SELECT item_id, doc_id, dot / (norm * q_norm) AS score FROM (SELECT item_id, doc_id, sum(qt.tf * idf * dt.tf * idf) AS dot FROM qt JOIN w USING (term) JOIN dt USING (term) GROUP BY 1, 2) JOIN dn USING (doc_id) JOIN qn USING (item_id))
SELECT item_id, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s) WHERE rank <= 10""",
)
def _(spark, d):
    tokens = T.retrieval_tokens(F.col("text"))
    index = R.tfidf_index(table(spark, d, "documents"), "doc_id", table(spark, d, "benchmark"), "item_id", tokens, tokens, bigrams=True, max_features=_FEATURES)
    return R.best_documents(*index, "doc_id", "item_id", 10).withColumn("score", F.round("score", 6)).select("item_id", "doc_id", "score", "rank")


_OVERLAP = _TFIDF + ", s AS (SELECT item_id, doc_id, sum(idf) AS score FROM qt JOIN w USING (term) JOIN dt USING (term) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s)"


@query("overlap_topk", _OVERLAP + " SELECT item_id, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10")
def _(spark, d):
    tokens = T.retrieval_tokens(F.col("text"))
    index = R.overlap_index(table(spark, d, "documents"), "doc_id", table(spark, d, "benchmark"), "item_id", tokens, tokens)
    return R.best_documents(*index, "doc_id", "item_id", 10).withColumn("score", F.round("score", 6)).select("item_id", "doc_id", "score", "rank")


_REL = """, rel AS (SELECT item_id, doc_id, CAST(1 + (item_id + doc_id) % 3 AS INTEGER) AS grade FROM r WHERE rank % 2 = 0 AND rank <= 40),
ideal AS (SELECT item_id, sum(CASE WHEN o <= 10 THEN (2 ** grade - 1) / log2(o + 1) END) AS idcg, count(*) AS n_rel FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY grade DESC, doc_id) AS o FROM rel) GROUP BY 1),
hit AS (SELECT r.item_id, rank, grade, row_number() OVER (PARTITION BY r.item_id ORDER BY rank) AS nth FROM r JOIN rel ON r.item_id = rel.item_id AND r.doc_id = rel.doc_id WHERE rank <= 10),
got AS (SELECT item_id, sum((2 ** grade - 1) / log2(rank + 1)) AS dcg, sum(nth / rank) AS sp, min(rank) AS first, count(*) AS n_hit FROM hit GROUP BY 1)
"""


def ranking(spark, d):
    tokens = T.retrieval_tokens(F.col("text"))
    index = R.overlap_index(table(spark, d, "documents"), "doc_id", table(spark, d, "benchmark"), "item_id", tokens, tokens)
    ranked = R.best_documents(*index, "doc_id", "item_id", 40)  # twice as many relevant documents as are looked at
    rel = ranked.where("rank % 2 = 0").select("item_id", "doc_id", (1 + (F.col("item_id") + F.col("doc_id")) % 3).cast("int").alias("grade"))
    return R.ranking_metrics(ranked, rel, "item_id", "doc_id")


@query("ndcg", _OVERLAP + _REL + "SELECT item_id, round(coalesce(dcg / idcg, 0), 6) AS ndcg FROM ideal LEFT JOIN got USING (item_id)")
def _(spark, d):
    return ranking(spark, d).select("item_id", F.round("ndcg", 6).alias("ndcg"))


@query("map_mrr", _OVERLAP + _REL + "SELECT item_id, round(coalesce(sp / n_rel, 0), 6) AS ap, round(coalesce(1e0 / first, 0), 6) AS rr, round(coalesce(n_hit / 10, 0), 6) AS precision, round(coalesce(n_hit / n_rel, 0), 6) AS recall, CASE WHEN n_hit > 0 THEN 1 ELSE 0 END AS hit FROM ideal LEFT JOIN got USING (item_id)")
def _(spark, d):
    return ranking(spark, d).select("item_id", *(F.round(c, 6).alias(c) for c in ("ap", "rr", "precision", "recall")), "hit")


@query("group_holdout", "WITH g AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), o AS (SELECT o_custkey, coalesce(sum(n) OVER (ORDER BY md5('42:' || o_custkey), o_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g) SELECT o_custkey, CASE WHEN before < (SELECT round_even(0.3 * sum(n), 0) FROM g) THEN 'test' ELSE 'pool' END AS split FROM o")
def _(spark, d):
    return E.group_holdout(table(spark, d, "orders"), "o_custkey")


@query("group_kfold", "SELECT o_custkey, CAST((row_number() OVER (ORDER BY md5('42:' || o_custkey), o_custkey) - 1) % 5 AS INTEGER) AS fold FROM (SELECT DISTINCT o_custkey FROM orders)")
def _(spark, d):
    return E.group_kfold(table(spark, d, "orders"), "o_custkey")


@query("split_summary", "WITH g AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), o AS (SELECT o_custkey, n, coalesce(sum(n) OVER (ORDER BY md5('42:' || o_custkey), o_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < (SELECT round_even(0.3 * sum(n), 0) FROM g) AS test FROM g) SELECT CAST(sum(n) FILTER (test) AS BIGINT) AS test_rows, CAST(sum(n) FILTER (NOT test) AS BIGINT) AS pool_rows, count(*) FILTER (test) AS test_groups, count(*) FILTER (NOT test) AS pool_groups, (SELECT count(*) FROM (SELECT o_custkey FROM o GROUP BY 1 HAVING count(DISTINCT test) > 1)) AS leaks FROM o")
def _(spark, d):
    rows = table(spark, d, "orders")
    return E.split_summary(rows.join(E.group_holdout(rows, "o_custkey"), "o_custkey"), "o_custkey", "split")


@query("build_splits", "WITH g AS (SELECT o_custkey, count(*) AS n, md5('42:' || o_custkey) AS k FROM orders GROUP BY 1), o AS (SELECT o_custkey, k, coalesce(sum(n) OVER (ORDER BY k, o_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < (SELECT round_even(0.3 * sum(n), 0) FROM g) AS test FROM g) SELECT o_custkey, 'test' AS split, NULL::INTEGER AS fold FROM o WHERE test UNION ALL SELECT o_custkey, 'pool', CAST((row_number() OVER (ORDER BY k, o_custkey) - 1) % 5 AS INTEGER) FROM o WHERE NOT test")
def _(spark, d):
    return E.build_splits(table(spark, d, "orders"), "o_custkey")


@query("group_column", "SELECT conv_id, turn, 'tx:' || substr(md5(coalesce(text, 'NA')), 1, 16) AS grp FROM conversations")
def _(spark, d):
    rows = table(spark, d, "conversations")
    return rows.select("conv_id", "turn", E.group_column(rows).alias("grp"))


_SCORED = "WITH s AS (SELECT l.doc_id, quality AS y, (n_chars - lo) * 1e0 / (hi - lo) AS score FROM labels l JOIN documents d ON l.doc_id = d.doc_id, (SELECT min(n_chars) AS lo, max(n_chars) AS hi FROM documents))"


def scored(spark, d):
    docs = table(spark, d, "documents")
    edges = docs.agg(F.min("n_chars").alias("lo"), F.max("n_chars").alias("hi"))
    rows = table(spark, d, "labels").join(docs.select("doc_id", "n_chars"), "doc_id").crossJoin(F.broadcast(edges))
    return rows.select("doc_id", F.col("quality").alias("y"), ((F.col("n_chars") - F.col("lo")) / (F.col("hi") - F.col("lo"))).alias("score"))


@query("prf1", _SCORED + ", c AS (SELECT count(*) FILTER (y = 1 AND score >= 0.05) AS tp, count(*) FILTER (y = 0 AND score >= 0.05) AS fp, count(*) FILTER (y = 1 AND score < 0.05) AS fn, count(*) FILTER (y = 0 AND score < 0.05) AS tn FROM s) SELECT tp, fp, fn, tn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2e0 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c")
def _(spark, d):
    rows = scored(spark, d).withColumn("p", (F.col("score") >= 0.05).cast("int"))
    return E.confusion(rows, "y", "p").withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query("roc_auc", _SCORED + ", r AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2e0 AS r FROM s) SELECT round((sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2e0) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 6) AS auc FROM r")
def _(spark, d):
    return E.roc_auc(scored(spark, d), "y", "score").withColumn("auc", F.round("auc", 6))


_CURVE = ", b AS (SELECT score, count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS m FROM s GROUP BY 1), c AS (SELECT score, sum(p) OVER o AS tp, sum(m) OVER o AS fp, (SELECT sum(p) FROM b) AS pos, (SELECT sum(m) FROM b) AS neg FROM b WINDOW o AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"


@query("average_precision", _SCORED + _CURVE + ", q AS (SELECT score, tp / pos AS r, tp / (tp + fp) AS p FROM c), t AS (SELECT r - coalesce(lag(r) OVER o, 0) AS dr, p + coalesce(lag(p) OVER o, 1) AS pp FROM q WINDOW o AS (ORDER BY score DESC)) SELECT round(sum(dr * pp / 2), 6) AS ap FROM t")
def _(spark, d):
    return E.average_precision(scored(spark, d), "y", "score").withColumn("ap", F.round("ap", 6))


@query("curve_points", _SCORED + _CURVE + " SELECT round(score, 9) AS score, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(pos AS BIGINT) AS pos, CAST(neg AS BIGINT) AS neg FROM c")
def _(spark, d):
    return E.curve(scored(spark, d), "y", "score").withColumn("score", F.round("score", 9))


@query("brier", _SCORED + " SELECT round(avg((score - y) * (score - y)), 6) AS brier FROM s")
def _(spark, d):
    return E.brier(scored(spark, d), "y", "score").withColumn("brier", F.round("brier", 6))


@query("ece", _SCORED + " SELECT round(sum(n * abs(c - a)) / (SELECT count(*) FROM s), 6) AS ece FROM (SELECT count(*) AS n, avg(score) AS c, avg(y) AS a FROM s WHERE score < 1 GROUP BY floor(score * 15))")
def _(spark, d):
    return E.ece(scored(spark, d), "y", "score").withColumn("ece", F.round("ece", 6))


@query("reliability", _SCORED + " SELECT CAST(floor(score * 15) AS INTEGER) AS bin, count(*) AS n, round(avg(score), 6) AS confidence, round(avg(y), 6) AS accuracy FROM s WHERE score < 1 GROUP BY 1")
def _(spark, d):
    return E.reliability(scored(spark, d), "y", "score").withColumns({c: F.round(c, 6) for c in ("confidence", "accuracy")})


@query("greedy_match_f1")
def _(spark, d):
    limits = (60.0, 70.0, 80.0, 90.0, 100.0)
    rows = cases(spark, d).select(fuzzy.greedy_match("perps", F.transform("perps", lambda x: F.concat(x, F.lit("1"))), limits).alias("counts"))
    return E.micro_scores(rows, limits)


@query("bootstrap_ci")
def _(spark, d):
    return E.bootstrap_ci(scored(spark, d), "doc_id", F.col("y"))
