"""Runs of forecasts and evaluations as artifacts of a catalog, with fixed schemas.

What one subject has is a small JSON document; runs over all subjects are datasets that
Spark writes, one record for each subject.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopweave.sources.catalog import Catalog

# ---- fixed values: kinds and fields of saved runs
NEXT_PLACES, LINKS, ARRIVALS, REPORT = "prediction_run", "perp_prediction_run", "eta_run", "evaluation_report"
WEEK = 7.0


def save_next_places(catalog: Catalog, sources: list[str], subject: str, predictions: DataFrame, owner: str | None = None) -> str:
    """Saves the next places of one subject; predictions: w, prob, best first by prob, then w."""
    rows = predictions.orderBy(F.desc("prob"), "w").collect()  # one subject's best places
    payload = {"victim": str(subject), "predicted_next_locations": [{"location": r["w"], "score": float(r["prob"])} for r in rows]}
    return catalog.save_json(payload, f"NextLoc run for {subject}", NEXT_PLACES, owner=owner, source=",".join(sources))


def save_prediction(catalog: Catalog, sources: list[str], subject: str, places: DataFrame, actors: DataFrame, steps: int, k: int, owner: str | None = None) -> str:
    """Saves next places (step, w, prob) and linked actors (actor, score) of one subject together."""
    where = [{"location": r["w"], "confidence": float(r["prob"])} for r in places.orderBy("step").collect()]
    who = [{"perpetrator": r["actor"], "score": float(r["score"])} for r in actors.orderBy(F.desc("score"), "actor").collect()]
    payload = {"sources": sources, "victim": str(subject), "steps": steps, "topk_perps": k, "predicted_next_locations": where, "predicted_next_perpetrators": who}
    return catalog.save_json(payload, f"Predictions for {subject}", NEXT_PLACES, owner=owner, source=",".join(sources))


def save_links(catalog: Catalog, sources: list[str], ranked: DataFrame, subject: str, actor: str, owner: str | None = None) -> str:
    """Saves the linked actors of all subjects: a record of victim and predictions (perpetrator, score) for each; ranked: subject, actor, score, rank."""
    each = F.array_sort(F.collect_list(F.struct("rank", F.col(actor).alias("perpetrator"), "score")))
    rows = ranked.groupBy(F.col(subject).cast("string").alias("victim")).agg(F.transform(each, lambda x: F.struct(x["perpetrator"].alias("perpetrator"), x["score"].alias("score"))).alias("predictions"))
    return catalog.save(rows, "Perpetrator predictions", LINKS, owner=owner, source=",".join(sources), fmt="jsonl")


def save_arrivals(catalog: Catalog, sources: list[str], steps: DataFrame, subject: str, start: str | None = None, owner: str | None = None) -> str:
    """Saves the days to each next place of all subjects; steps: subject, step, to, days."""
    detail = F.struct("step", F.col("to"), F.col("days").cast("int").alias("eta_days"), F.round(F.col("days").cast("int") / WEEK, 2).alias("eta_weeks"))
    rows = steps.groupBy(F.col(subject).cast("string").alias("victim")).agg(F.array_sort(F.collect_list(detail)).alias("d"))
    rows = rows.select("victim", F.size("d").alias("steps"), F.lit(start).cast("string").alias("start_date"), F.transform("d", lambda x: F.struct(x["to"].alias("to"), x["eta_days"].alias("eta_days"), x["eta_weeks"].alias("eta_weeks"))).alias("steps_detail"))
    return catalog.save(rows, "ETA of all subjects", ARRIVALS, owner=owner, source=",".join(sources), fmt="jsonl")


def save_report(catalog: Catalog, name: str, report: dict, sources: list[str], owner: str | None = None) -> str:
    return catalog.save_json(report, name, REPORT, owner=owner, source=",".join(sources))


def reports(catalog: Catalog) -> DataFrame:
    """Saved evaluation reports, newest first."""
    return catalog.entries(REPORT)
