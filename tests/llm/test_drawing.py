"""Mixing, fill-in-the-middle and resampling against brute force, on small tables with the awkward cases."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from hopweave.llm import fill_middle, mixing, resampling
from hopweave.llm import queries as llm
from tests.llm.test_llm import AWKWARD
from tests.test_oracles import TABLES, shown

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Tables with null ids, texts and sources, repeated rows, ties, long texts and clashing names."""
    rng = random.Random(3)
    texts = [*AWKWARD, "a <P> b", "<S>", "x<M", "P> <S", "<<P>>", "é<M>é", "<", "日本" * 3000, " ".join(str(i % 97) for i in range(9000))]
    rows = [(i, t, rng.choice(["z", "a", None, "", "\U00010000", "￿"]), "q", i, 1) for i, t in enumerate(texts)]
    rows += [(100 + i, " ".join(rng.choices("alpha beta Gamma delta eps".split(), k=rng.randrange(60))), "big", "q", 5, 2) for i in range(300)]
    rows += [(None, "no id here", "a", "q", 0, 3), (None, None, None, None, None, None), (7, "same", "a", "q", 0, 4), (7, "same", "a", "q", 0, 4)]
    path = tmp_path_factory.mktemp("odd")
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, size string, rank long, at long")
    frame.repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, "alpha beta beta"), (2, None), (3, "Gamma delta")], "item_id long, text string").coalesce(1).write.parquet(f"{path}/benchmark.parquet")
    return str(path)


NEW = ["op11_mixing", "op12_fill_middle", "op13_resampling"]


def rows_of(spark, name, path):
    df = llm.QUERIES[name](spark, path)
    cols = sorted(df.columns)
    return cols, sorted(tuple(shown(r[c]) for c in cols) for r in df.collect())


@pytest.mark.parametrize("name", NEW)
def test_odd_tables_by_sql(spark, odd, name):
    duck = duckdb.connect()
    for t in ("documents", "benchmark"):
        duck.sql(f"create view {t} as select * from '{odd}/{t}.parquet/*.parquet'")
    cols, got = rows_of(spark, name, odd)
    want = duck.sql(llm.ORACLE_SQL[name])
    at = [want.columns.index(c) for c in cols]
    assert got == sorted(tuple(shown(r[i]) for i in at) for r in want.fetchall())


@pytest.mark.parametrize("name", NEW)
def test_reruns_and_partitions_agree(spark, odd, tmp_path, name):
    spark.read.parquet(f"{odd}/documents.parquet").repartition(7, "text").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{odd}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert rows_of(spark, name, odd) == rows_of(spark, name, str(tmp_path))


@pytest.mark.parametrize("name", NEW)
def test_empty_tables(spark, odd, tmp_path, name):
    for t in ("documents", "benchmark"):
        spark.read.parquet(f"{odd}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert rows_of(spark, name, str(tmp_path))[1] == []


# ---- mixing


def test_targets_by_rounds(spark):
    """The excess is shared again, round by round, until no target is above its cap."""
    rng = random.Random(5)
    for n in (1, 2, 3, 17, 40):
        sizes = [(f"s{i:02}", rng.choice([0, 1, 5, 100, 1000, 10_000, 300_000])) for i in range(n)]
        got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(sizes, "source string, source_size long")).collect()}
        weight = {s: (3, 1, 2)[i % 3] for i, (s, _) in enumerate(sizes)}
        cap, budget, fixed = {s: 2 * x for s, x in sizes}, 1.5 * sum(x for _, x in sizes), {}
        while True:
            free = [s for s, _ in sizes if s not in fixed]
            left = budget - sum(fixed.values())
            want = {s: left * weight[s] / sum(weight[x] for x in free) for s in free} | fixed
            above = [s for s in free if want[s] > cap[s]]
            if not above:
                break
            fixed |= {s: cap[s] for s in above}
        assert got == pytest.approx(want, rel=1e-9)


def test_quotas_by_highest_quotients(spark):
    rng = random.Random(6)
    cells, want = [], {}
    for g in range(12):
        votes = [rng.choice([0.0, 1.0, 2.0, 2.0, 7.5, 100.0, 1e6]) + rng.randrange(3) for _ in range(rng.randrange(1, 15))]
        seats, given = rng.randrange(0, 60), Counter()
        for _ in range(seats if sum(votes) else 0):
            given[min(range(len(votes)), key=lambda i: (-votes[i] / (2 * given[i] + 1), i))] += 1
        cells += [(g, i, v, seats, 10**9) for i, v in enumerate(votes)]
        want |= {(g, i): given[i] for i in range(len(votes))}
    df = spark.createDataFrame(cells, "g long, i long, v double, seats long, most long")
    got = mixing.apportion(df, ["g"], "v", "seats", "most", "i", "q").collect()
    assert {(r["g"], r["i"]): r["q"] for r in got} == want


def test_mix(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = mixing.mix(docs).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in docs.select("doc_id").collect())
    size, source, taken, target = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in docs.collect()}, {}, Counter(), {}
    for r in rows:
        assert r["size"] == size[r["doc_id"]]
        assert 0 <= r["passes"] <= 2
        ends = [0, *(x for s in r["extra"] for x in s), r["size"]]
        assert ends == sorted(ends)  # spans follow each other within the document
        more = sum(b - a for a, b in r["extra"])
        assert r["passes"] * r["size"] + more <= 2 * r["size"]
        taken[r["source"]] += r["passes"] * r["size"] + more
        target[r["source"]] = r["target"]
    for s in target:
        assert abs(taken[s] - target[s]) <= 2 * mixing.BLOCK
    assert len({r["shard"] for r in rows}) == 1


def test_shards(spark, monkeypatch):
    """Each block of a shard is taken `passes` times or once more, also with many shards."""
    monkeypatch.setattr(mixing, "SHARD_ROWS", 3)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = mixing.mix(docs).collect()
    by_source, passes = defaultdict(int), defaultdict(set)
    for r in rows:
        by_source[r["source"], r["target"]] += r["passes"] * r["size"] + sum(b - a for a, b in r["extra"])
        if r["size"]:
            passes[r["source"], r["shard"]].add(r["passes"])
    assert all(len(p) == 1 for p in passes.values())
    assert len(passes) > 2 * len(by_source)
    assert all(abs(n - t) <= max(60, 0.03 * t) for (_, t), n in by_source.items())


# ---- fill-in-the-middle


def test_automaton_by_steps():
    """The unrolled table says what the automaton says step by step, and what a search finds."""
    rng = random.Random(1)
    for _ in range(200):
        texts = ["".join(rng.choices(["<", "P", "S", "M", ">", "é", "日", "\U0001f600", "a", "<P>", "<S"], k=rng.randrange(40))) for _ in range(6)]
        raw = [t.encode() for t in texts]
        ends = np.cumsum([0, *map(len, raw)])
        scan = fill_middle.Scan(np.frombuffer(b"".join(raw), np.uint8), ends)
        for i, t in enumerate(texts):
            row, units, found = 0, 0, False
            for byte in raw[i]:
                c = fill_middle.CLASSES[byte]
                units += fill_middle.EMITS[row, c] & fill_middle.UNIT
                found |= bool(fill_middle.EMITS[row, c] & fill_middle.FOUND)
                row = fill_middle.AFTER[row, c]
            assert units == len(t) == scan.count(int(ends[i + 1])) - scan.count(int(ends[i]))
            assert found == bool(scan.holds[i]) == any(s in t for s in fill_middle.SENTINELS)
            for k in range(len(t) + 1):
                assert scan.locate(scan.count(int(ends[i])) + k, int(ends[i + 1])) - ends[i] == len(t[:k].encode())


def test_cuts_over_cells(monkeypatch):
    monkeypatch.setattr(fill_middle, "CELL", 3)
    test_automaton_by_steps()


def test_fill_in_middle(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet").where("doc_id is not null").dropDuplicates(["doc_id"])
    rows = fill_middle.fill_in_middle(docs).withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    texts, seen = {r["doc_id"]: r["text"] or "" for r in docs.collect()}, Counter()
    for r in rows:
        t, h = texts[r["doc_id"]], hashlib.sha256(f"1:{r['doc_id']}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
        a, b = sorted((h1 % (len(t) + 1), h2 % (len(t) + 1)))
        p, m, s = t[:a], t[a:b], t[b:]
        if not t or re.search("<[PSM]>", t) or h3 % 100 >= 90:
            want = ("plain", None, None, t)
        elif h4 % 100 < 20:
            want = ("spm", a, b - a, f"<S>{s}<P>{p}<M>{m}")
        else:
            want = ("psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")
        assert (r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == want
        assert r["back"] == t
        assert r["n"] == len(t)
        seen[r["form"]] += 1
    assert min(seen.values()) > 5


def test_restoring_beside_sentinels(spark):
    """Pieces that end or begin like a sentinel are told from it."""
    rows = [(p, m, s) for p in ("", "<", "<S", "a<P") for m in ("", ">", "P>", "<M") for s in ("", "S>", "<", "<P")]
    df = spark.createDataFrame(rows, "p string, m string, s string")
    psm, spm = F.concat(F.lit("<P>"), "p", F.lit("<S>"), "s", F.lit("<M>"), "m"), F.concat(F.lit("<S>"), "s", F.lit("<P>"), "p", F.lit("<M>"), "m")
    got = df.select(F.concat("p", "m", "s").alias("t"), fill_middle.restored(psm, F.lit("psm")).alias("a"), fill_middle.restored(spm, F.lit("spm")).alias("b")).collect()
    for r in got:
        if not re.search("<[PSM]>", r["t"]):
            assert r["t"] == r["a"] == r["b"]


# ---- resampling


def test_resampling_by_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]

    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))

    def features(t):
        w = words(t)
        return [zlib.crc32(x.encode()) % 10000 for x in [*w, *map(" ".join, zip(w, w[1:], strict=False))]]

    s, t = Counter(b for _, x in docs for b in features(x)), Counter(b for x in items for b in features(x))
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000)))) for b in range(10000)]
    want = []
    for i, x in docs:
        f = features(x)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
        want.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(x))])
    able = sorted((r for r in want if r[5] >= 20), key=lambda r: (-r[3], r[0]))
    for k, r in enumerate(able[: 25 * len(able) // 100], 1):
        r[4] = k
    got = resampling.op13_resampling(spark, SF).collect()
    assert sorted((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in got) == sorted(tuple(r[:5]) for r in want)


def test_ties_go_to_smaller_ids(spark):
    rows = spark.createDataFrame([(i, 30, 5, 1, 100 + i % 2) for i in (5, 3, 9, 1, 4, 2, 8, 6)] + [(7, 3, 1, 1, 999)], "doc_id long, n_words long, n_features long, weight long, score long")
    got = {r["doc_id"]: r["rank"] for r in resampling.drawn(rows, percent=75).collect()}
    assert got == {1: 1, 3: 2, 5: 3, 9: 4, 2: 5, 4: 6, 6: None, 8: None, 7: None}
    assert all(r["rank"] is None for r in resampling.drawn(rows, percent=1).collect())


def test_plan_of_scoring_makes_no_rows(spark):
    """No row for a feature, no shuffle and no Python where documents are scored."""
    rows = resampling.scored(spark.read.parquet(f"{SF}/documents.parquet"), [0] * resampling.BUCKETS)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Generate|Exchange|Python|Arrow", plan)
