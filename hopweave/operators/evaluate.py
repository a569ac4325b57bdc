"""Splits and metrics for evaluations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopweave.operators.numbering import by_text, numbered, running_sums, spread

EPS = 1e-12


def group_key(group: Column, seed: int) -> Column:
    """A reproducible order of groups, the same in any engine."""
    return F.md5(F.concat(F.lit(f"{seed}:"), group.cast("string")).cast("binary"))


def group_holdout(df: DataFrame, group: str, fraction: float = 0.3, seed: int = 42) -> DataFrame:
    """group, split: whole groups go to test in hashed order until it has round(fraction * rows) rows."""
    sizes = df.groupBy(group).agg(F.count("*").alias("n")).withColumn("key", group_key(F.col(group), seed))
    target = sizes.agg(F.bround(fraction * F.sum("n")).alias("target"))
    upto = running_sums(sizes, by_text(F.col("key")), ["key", group], {"upto": F.col("n")})
    return upto.crossJoin(F.broadcast(target)).select(group, F.when(F.col("upto") - F.col("n") < F.col("target"), "test").otherwise("pool").alias("split"))


def group_kfold(df: DataFrame, group: str, k: int = 5, seed: int = 42) -> DataFrame:
    """group, fold: groups dealt round in hashed order."""
    groups = df.select(group).distinct().withColumn("key", group_key(F.col(group), seed))
    return numbered(groups, by_text(F.col("key")), ["key", group], "i").select(group, ((F.col("i") - 1) % k).cast("int").alias("fold"))


#: Columns that name a subject, and columns of free text, in the order in which they are looked for.
GROUP_COLUMNS = ("Serialized ID", "Unique ID", "Victim ID", "sid", "subject_id", "id")
TEXT_COLUMNS = ("text", "Text", "narrative", "Narrative", "content")


def group_column(df: DataFrame, asked: str | None = None, index: str | None = None) -> Column:
    """The group of each row: the column asked for, else an id, else a digest of the text, else the row's index, else one group."""
    if asked in df.columns:
        return F.coalesce(F.col(f"`{asked}`").cast("string"), F.lit("NA"))
    if name := next((c for c in GROUP_COLUMNS if c in df.columns), None):
        return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("NA"))
    if name := next((c for c in TEXT_COLUMNS if c in df.columns), None):
        return F.concat(F.lit("tx:"), F.substring(F.md5(F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("NA")).cast("binary")), 1, 16))
    return F.concat(F.lit("row:"), F.col(f"`{index}`").cast("string")) if index else F.lit("all")


def build_splits(df: DataFrame, group: str, k: int = 5, fraction: float = 0.3, seed: int = 42) -> DataFrame:
    """group, split, fold: the hold-out, and for the groups of the pool the fold in which they validate."""
    split = group_holdout(df, group, fraction, seed)
    folds = group_kfold(split.where("split = 'pool'"), group, k, seed)
    return split.join(folds, group, "left")


def persist_splits(splits: DataFrame, catalog, name: str, group: str, k: int = 5, seed: int = 42) -> str:
    """Saves splits in a catalog as a dataset of kind eval_splits; its id. join() with it by group gives back the rows of a split."""
    return catalog.save(splits, name, "eval_splits", extra={"group_col": group, "k": k, "seed": seed})


def apply_split(df: DataFrame, splits: DataFrame, group: str, split: str, fold: int | None = None) -> DataFrame:
    """Rows of a split; with a fold of the pool, those that validate in it."""
    own = splits.where(F.col("split") == split)
    return df.join((own if fold is None else own.where(F.col("fold") == fold)).select(group), group, "left_semi")


def split_summary(rows: DataFrame, group: str, split: str) -> DataFrame:
    """One row: rows and groups by split, and groups that are in both."""
    test, pool = (F.col(split) == s for s in ("test", "pool"))
    per = rows.groupBy(group).agg(F.sum(test.cast("int")).alias("t"), F.sum(pool.cast("int")).alias("p"))
    return per.agg(F.sum("t").alias("test_rows"), F.sum("p").alias("pool_rows"), F.count_if(F.col("t") > 0).alias("test_groups"), F.count_if(F.col("p") > 0).alias("pool_groups"), F.count_if((F.col("t") > 0) & (F.col("p") > 0)).alias("leaks"))


def confusion(df: DataFrame, truth: str, predicted: str, *by: str) -> DataFrame:
    """by, tp, fp, fn, tn, precision, recall, f1."""
    y, p = F.col(truth) == 1, F.col(predicted) == 1
    n = df.groupBy(*by).agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))
    pr = F.col("tp") / (F.col("tp") + F.col("fp") + EPS)
    rc = F.col("tp") / (F.col("tp") + F.col("fn") + EPS)
    return n.withColumns({"precision": pr, "recall": rc}).withColumn("f1", 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + EPS))


def curve(df: DataFrame, truth: str, score: str) -> DataFrame:
    """score, tp, fp, pos, neg: cumulative counts by falling score; one row per distinct score, so ties count as one step."""
    return _curve(df, truth, score).select(score, "tp", "fp", "pos", "neg")


def _curve(df: DataFrame, truth: str, score: str) -> DataFrame:
    by_score = df.groupBy(score).agg(F.count_if(F.col(truth) == 1).alias("p"), F.count_if(F.col(truth) == 0).alias("m"))
    total = by_score.agg(F.sum("p").alias("pos"), F.sum("m").alias("neg"))  # one row
    return running_sums(by_score, -spread(F.col(score)), [F.desc(score)], {"tp": F.col("p"), "fp": F.col("m")}).crossJoin(F.broadcast(total))


def roc_auc(df: DataFrame, truth: str, score: str) -> DataFrame:
    """One row: area under the ROC curve by mean ranks, so ties count half."""
    by_score = df.groupBy(score).agg(F.count_if(F.col(truth) == 1).alias("p"), F.count("*").alias("n"))
    ranks = running_sums(by_score, spread(F.col(score)), [score], {"upto": F.col("n")}).withColumn("r", F.col("upto") - F.col("n") + (F.col("n") + 1) / 2)
    s = ranks.agg(F.sum(F.col("r") * F.col("p")).alias("rs"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    neg = F.col("n") - F.col("p")
    return s.select(F.when((F.col("p") > 0) & (neg > 0), (F.col("rs") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * neg)).alias("auc"))


def average_precision(df: DataFrame, truth: str, score: str) -> DataFrame:
    """One row: area under the precision-recall curve by trapezoids over distinct scores, from recall 0 and precision 1."""
    c = _curve(df, truth, score)
    recall, precision = F.col("tp") / F.col("pos"), F.col("tp") / (F.col("tp") + F.col("fp"))
    tp, all_of = F.col("tp") - F.col("p"), F.col("tp") + F.col("fp") - F.col("p") - F.col("m")  # at the step before
    before = F.when(all_of > 0, tp / all_of).otherwise(1.0)
    return c.select(((recall - tp / F.col("pos")) * (precision + before) / 2).alias("a")).agg(F.sum("a").alias("ap"))


def brier(df: DataFrame, truth: str, score: str) -> DataFrame:
    return df.agg(F.avg(F.pow(F.col(score) - F.col(truth), 2)).alias("brier"))


def reliability(df: DataFrame, truth: str, score: str, bins: int = 15) -> DataFrame:
    """bin, n, confidence, accuracy; a score of 1 is in no bin."""
    return df.where((F.col(score) >= 0) & (F.col(score) < 1)).groupBy(F.floor(F.col(score) * bins).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.avg(score).alias("confidence"), F.avg(F.col(truth).cast("double")).alias("accuracy"))


def ece(df: DataFrame, truth: str, score: str, bins: int = 15) -> DataFrame:
    """One row: expected calibration error, over all rows."""
    total = df.agg(F.count("*").alias("t"))
    rows = reliability(df, truth, score, bins).crossJoin(F.broadcast(total))
    return rows.agg(F.sum(F.col("n") / F.col("t") * F.abs(F.col("confidence") - F.col("accuracy"))).alias("ece"))


def micro_scores(counts: DataFrame, thresholds: tuple[float, ...]) -> DataFrame:
    """threshold, tp, fp, fn, precision, recall, f1 summed over rows of `counts` (tp, fp, fn by turns)."""
    each = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(len(thresholds) - 1)), lambda i: F.struct(*(F.get("counts", i * 3 + j).alias(n) for j, n in enumerate(("tp", "fp", "fn"))))))
    rows = counts.select(each.alias("i", "c")).groupBy("i").agg(*(F.sum(f"c.{n}").alias(n) for n in ("tp", "fp", "fn")))
    limit = F.array(*(F.lit(t) for t in thresholds))
    pr, rc = F.col("tp") / (F.col("tp") + F.col("fp") + EPS), F.col("tp") / (F.col("tp") + F.col("fn") + EPS)
    return rows.select(F.get(limit, F.col("i")).alias("threshold"), "tp", "fp", "fn", pr.alias("precision"), rc.alias("recall"), (2 * pr * rc / (pr + rc + EPS)).alias("f1"))


def bootstrap_ci(df: DataFrame, key: str, value: Column, n: int = 200, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """One row: mean of value, and the interval of its means over n Poisson resamples.

    A row's weight in resample i is a Poisson draw from a hash of its key and i, so
    resamples need no shuffle but one sum for each of them.
    """
    u = (F.pmod(F.xxhash64(key, "i", F.lit(seed)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    steps, p, total = [], 0.36787944117144233, 0.0
    for k in range(12):
        total += p
        steps.append(total)
        p /= k + 1
    weight = sum((F.when(u > s, 1).otherwise(0) for s in steps), F.lit(0))
    rows = df.select(key, value.cast("double").alias("x")).where("x IS NOT NULL").withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn("w", weight)
    means = rows.groupBy("i").agg((F.sum(F.col("w") * F.col("x")) / F.nullif(F.sum("w"), F.lit(0))).alias("m"))
    ends = means.agg(F.percentile("m", F.lit(alpha / 2)).alias("low"), F.percentile("m", F.lit(1 - alpha / 2)).alias("high"))
    return df.agg(F.avg(value.cast("double")).alias("mean")).crossJoin(ends)  # one row each


def run_sections(sections: dict) -> dict:
    """Results of functions by name; one that fails gives its error and does not stop the others."""
    out = {}
    for name, f in sections.items():
        try:
            out[name] = {"available": True, "result": f()}
        except Exception as e:  # noqa: BLE001  reported, not hidden
            out[name] = {"available": False, "reason": f"{type(e).__name__}: {e}"}
    return out
