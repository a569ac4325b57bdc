"""Goldens of the text functions."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from hopweave.functions import fuzzy
from hopweave.functions import text as T


def values(spark, f, inputs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("x"))).collect()]


DURATIONS = ["3 days", "2 weeks", "1 month 2 weeks", "2 months 3 days", "3/4 days", "2-3 days", "2.5 weeks", "48 hours", "1 year", "7", "12.7"]


@pytest.mark.parametrize(
    ("f", "want"),
    [
        (T.duration_upload, [3, 14, 44, 60, 1, 2, 18, None, None, None, None]),
        (T.duration_eta, [3, 14, 7, 60, None, None, 17, None, None, 7, 12]),
        (T.duration_first, [3.0, 14.0, 30.0, 60.0, 4.0, 3.0, 17.5, None, 365.0, None, None]),
        (T.duration_sum, [3.0, 14.0, 44.0, 63.0, 0.75, 5.0, 17.5, 2.0, None, None, None]),
    ],
)
def test_durations(spark, f, want):
    assert values(spark, f, DURATIONS) == want


@pytest.mark.parametrize(
    ("f", "inputs", "want"),
    [
        (T.normalize_gender, ["a male", "M/F", "boy", "n/a", None], ["Male", "Female", "Male", "Unknown", "Unknown"]),
        (T.titlecase_keep_caps, ["UK of aMERica", None], ["UK Of America", ""]),
        (T.smart_blank, [None, " NaN ", "x "], ["", "", "x"]),
        (T.extract_year, ["left in 2017 or 2018", "abc", None], [2017, None, None]),
        (T.parse_places, ["['A' 'B']", "['A', 'B']", "[A B]", "X (Y)", "", None], [["A", "B"], ["A", "B"], ["A", "B"], ["X (Y)"], [], []]),
        (T.normalize_location, ["Asmara (Eritrea)", " ", None], ["Asmara", None, None]),
        (T.split_list, ["Ali, Omar and no; Ben -> Zed", "", None], [["Ali", "Omar", "Ben", "Zed"], [], []]),
        (T.coerce_list, ["a; b", "['x' 'y']", "a,b", "a", None], [["a", "b"], ["x", "y"], ["a", "b"], ["a"], []]),
        (T.parse_listish, ["['Ali' 'ALI' 'chief']", "a;b|A"], [["Ali"], ["a", "b"]]),
        (T.slug, [" A  b/ç!", "!!", None], ["a-b-ç", "unk", "unk"]),
        (T.person_tokens, ["The Boss met Medhanie and Medhanie"], [["Medhanie"]]),
        (T.hierarchy_chain, ["boss -> UN > boss; the man"], [["Boss", "UN", "The Man"]]),
        (T.compact_time, ["3 Days and 2 weeks", None], ["3_days_2_weeks", ""]),
        (T.normalize_nationality, ["from sudan", "Zzz people", "", "abc"], ["Sudanese", "Zzz", "", "Abc"]),
        (T.iso_date, ["2020-01-02", "02/01/2020", "soon", None], ["2020-01-02", "2020-01-02", "", ""]),
    ],
)
def test_goldens(spark, f, inputs, want):
    assert values(spark, f, inputs) == want


def test_coordinates(spark):
    got = values(spark, lambda c: T.coordinate(c, "lat"), ["328.966.720", "35,6895", "-11.019.081", "N/A", "1234.5", "x 32.5 N", None])
    assert [None if x is None else round(x, 6) for x in got] == [32.896672, 35.6895, -1.101908, None, 12.345, 32.5, None]


def test_similarity_and_matching():
    assert fuzzy.indel_ratio("abc", "abc") == 100 and fuzzy.indel_ratio("", "") == 100 and fuzzy.indel_ratio("a", "") == 0
    assert round(fuzzy.indel_ratio("lewenstein", "levenshtein"), 3) == round(200 * 9 / 21, 3)
    assert fuzzy.token_set("new york mets", "mets york new new") == 100
    assert fuzzy.deduped(["Ali Omar", "ali omar", "Ali Omarr", "Zed"]) == ["Ali Omar", "Zed"]
    assert fuzzy.greedy_counts(["ali", "ben"], ["ali", "bem", "x"], (60.0, 100.0)) == [2, 1, 0, 1, 2, 1]


def test_ratios_of_many_pairs_at_once(monkeypatch):
    """Rows of names are matched without a call for each pair, and as pair by pair."""
    rng = __import__("random").Random(1)
    name = lambda: rng.choice(["", "Name#00"]) + "".join(rng.choice("abAB é\0\U0001f600ß") for _ in range(rng.choice([0, 1, 3, 8, 20, 56, 63, 64, 70])))
    limits = (60.0, 80.0, 100.0)
    rows = [([name() for _ in range(rng.randrange(6))], [name() for _ in range(rng.randrange(6))]) for _ in range(300)]

    def one(truth, found):
        out, pairs = [], sorted((-fuzzy.indel_ratio(t.lower(), f.lower()), i, j) for i, t in enumerate(truth) for j, f in enumerate(found))
        for limit in limits:
            used = []
            for s, i, j in pairs:
                if -s >= limit and all(i != k and j != m for k, m in used):
                    used.append((i, j))
            out += [len(used), len(found) - len(used), len(truth) - len(used)]
        return out

    want = [one(*r) for r in rows]
    assert [fuzzy.greedy_counts(*r, limits) for r in rows] == want
    assert fuzzy.greedy_rows(rows, limits) == want
    monkeypatch.setattr(fuzzy, "indel_ratio", None)  # short names need no call for each pair
    assert fuzzy.greedy_rows([(["ali", "ben"], ["ali", "bem", "x"])] * 3, (60.0, 100.0)) == [[2, 1, 0, 1, 2, 1]] * 3


def test_udfs_take_nulls(spark):
    df = spark.sql("select cast(null as string) a, 'x' b, cast(null as array<string>) l")
    r = df.select(fuzzy.ratio("a", "b"), fuzzy.fuzzy_dedupe("l"), fuzzy.greedy_match("l", "l")).first()
    assert r[0] is None and r[1] == [] and set(r[2]) == {0}


def test_weighted_ratio():
    assert fuzzy.weighted("this is a test", "this is a new test!!!") == pytest.approx(85.5)
    assert fuzzy.weighted("abc", "abc") == 100 and fuzzy.weighted("", "abc") == 0 and fuzzy.weighted("b a", "a b") == pytest.approx(95)
    assert fuzzy.partial("abc", "xxabcxx") == 100 and fuzzy.partial("abcd", "xxabcxx") == 75
    rng = __import__("random").Random(1)
    some = lambda n: "".join(rng.choice("abc ") for _ in range(n))
    for _ in range(200):  # against every stretch
        a, b = some(rng.randint(1, 5)), some(rng.randint(5, 9))
        want = max(fuzzy.indel_ratio(a, b[max(0, i) : i + len(a)]) for i in range(1 - len(a), len(b)))
        assert fuzzy.partial(a, b) == pytest.approx(want)
