"""An evaluation of datasets from end to end: load, resolve columns, split, evaluate, report.

Rows are split by subject, so that none is in two parts. Each section is evaluated by
itself; one that fails is reported with its reason and does not stop the others. What
comes back to the driver is a row of figures for each section.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hopweave.operators import evaluate as E
from hopweave.operators import forecast as M
from hopweave.operators import graph as G
from hopweave.operators.standardize import resolved
from hopweave.operators.trajectory import next_place
from hopweave.sources.shared import written


@dataclass
class Config:
    """Seed, folds, held-out share, links that are ranked at most, and the sections to evaluate."""

    seed: int = 42
    k: int = 5
    test_frac: float = 0.3
    max_links: int = 300
    sections: tuple[str, ...] = ("places", "arrivals", "links")


def steps_of(rows: DataFrame) -> DataFrame:
    """sid, split, a, b, days: steps from one place to the next; days are those of the row that is left."""
    steps = next_place(rows.where("location IS NOT NULL AND location <> ''"), "sid", "location", "route")
    return steps.select("sid", "split", F.col("location").alias("a"), F.col("next").alias("b"), F.col("days")).where("b IS NOT NULL")


def _figures(rows: DataFrame) -> list[dict]:
    return [r.asDict() for r in rows.collect()]  # a few rows of figures


def evaluated(rows: DataFrame, cfg: Config = Config()) -> dict:
    """A report on rows of resolved(): sid, route, location, actors, days."""
    if rows.isEmpty():
        return {"meta": asdict(cfg), "splits": {"available": False, "reason": "no processed data"}, "sections": {}}
    splits = written(E.build_splits(rows.select("sid"), "sid", cfg.k, cfg.test_frac, cfg.seed), "splits")
    parts = written(rows.join(splits, "sid"), "parts")
    steps = written(steps_of(parts), "steps")
    train, test = steps.where("split = 'pool'"), steps.where("split = 'test'")

    def places():
        return _figures(M.majority_accuracy(train, test))[0]

    def arrivals():
        timed = lambda d: d.where("days IS NOT NULL")
        if timed(train).isEmpty():
            raise ValueError("no durations in the pool")
        return _figures(M.eta_mae(timed(train), timed(test), "days"))[0]

    def links():
        # rows of one subject are in one part, so known links are looked for among rows, not subjects
        n = F.row_number().over(W.partitionBy("sid").orderBy("route", "location"))
        each = parts.withColumn("__late", n > F.lit(0.7) * F.count("*").over(W.partitionBy("sid")))
        pairs = lambda late: G.bipartite_edges(each.where(F.col("__late") == late), "sid", "actors")
        train, held = (written(pairs(late), "edges") for late in (False, True))
        return _figures(G.evaluate_links(train, held, most=cfg.max_links, seed=cfg.seed).orderBy("heuristic"))

    known = {"places": places, "arrivals": arrivals, "links": links}
    summary = _figures(E.split_summary(parts, "sid", "split"))[0]
    return {"meta": asdict(cfg), "splits": {"available": True, "summary": summary, "group_col": "sid"}, "sections": E.run_sections({n: known[n] for n in cfg.sections})}


def run(catalog, ids: list[str], columns: dict[str, str], actor_lists: list[str], text_columns: list[str] = (), cfg: Config = Config()) -> dict:
    """Loads processed datasets of a catalog, resolves their columns (sid, route, location, time) and evaluates them."""
    df = catalog.load_processed(ids, [c for c in columns.values() if c])
    report = evaluated(written(resolved(df, columns, list(text_columns), actor_lists), "resolved"), cfg)
    return report | {"resolved_columns": columns, "ds_ids": ids}


def figures(report: dict, spark) -> DataFrame:
    """section, metric, value: the numbers of a report; lists are told apart by their heuristic."""
    rows = [("splits", k, float(v)) for k, v in report["splits"].get("summary", {}).items()]
    for name, section in report["sections"].items():
        found = section.get("result") or {}
        for part in found if isinstance(found, list) else [found]:
            label = f"{name}:{part['heuristic']}" if "heuristic" in part else name
            rows += [(label, k, float(v)) for k, v in part.items() if isinstance(v, int | float)]
    return spark.createDataFrame(rows, "section string, metric string, value double")
