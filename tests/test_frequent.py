"""Most frequent texts and case variants by digests: ties, long texts, shared beginnings."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import cleanframe as cf
import cleanframe.plans.frequent as frequent


def texts():
    rng = random.Random(2)
    header = "the same beginning of every text, longer than the letters that are kept " * 2
    long = [header + "".join(rng.choice("abc") for _ in range(rng.randint(0, 300))) for _ in range(60)]
    short = ["".join(rng.choice("abAB") for _ in range(rng.randint(0, 3))) for _ in range(80)]
    return long + long[:20] + short + [t.upper() for t in long[:9]] + [None, None, "é" * 64, "é" * 65, "É" * 65]


def brute(values, k):
    return sorted(((-n, v) for v, n in Counter(v for v in values if v is not None).items()))[:k]


@pytest.mark.parametrize("ties", [10_000, 4])
def test_top_texts(spark, monkeypatch, ties):
    monkeypatch.setattr(frequent, "TIES", ties)
    a = texts()
    b = [f"{'x' * 90}{i}" for i in range(len(a))]  # all differ, behind the letters that are kept
    df = spark.createDataFrame(list(zip(a, b, [None] * len(a))), "a string, b string, c string").repartition(7)
    tops, totals = frequent.top_texts(df, ["a", "b", "c"], 5)
    assert [(-n, v) for v, n in tops["a"]] == brute(a, 5) and [(-n, v) for v, n in tops["b"]] == brute(b, 5) and tops["c"] == []
    assert totals == {"a": (len(a) - 2, len(set(a)) - 1), "b": (len(b), len(b)), "c": (0, 0)}
    rows = {r["column"]: r for r in cf.categorical_describe(df).collect()}
    assert (rows["a"]["top"], rows["a"]["freq"]) == (brute(a, 1)[0][1], -brute(a, 1)[0][0]) and rows["c"]["top"] == "NaN"
    assert cf.mode_values(df, ["a", "b", "c"]) == {"a": brute(a, 1)[0][1], "b": min(b)}


@pytest.mark.parametrize("ties", [10_000, 2])
def test_case_variant_groups_of_long_texts(spark, monkeypatch, ties):
    monkeypatch.setattr(frequent, "TIES", ties)
    a = texts()
    groups: dict = {}
    for v in set(a) - {None}:
        groups.setdefault(v.lower(), set()).add(v)
    want = sorted((low, v) for low in sorted(g for g, own in groups.items() if len(own) > 1)[:4] for v in groups[low])
    got = cf.case_variant_groups(spark.createDataFrame([(v,) for v in a], "a string"), k=4)
    assert sorted((r["lower_value"], r["value"]) for r in got.collect()) == want


def test_shuffled_keys_do_not_grow_with_texts(spark):
    df = spark.range(3).select(F.repeat(F.lit("long "), 10_000).alias("a"))
    key = frequent._cells(df, ["a"], known=frequent.known, head=lambda c: F.substring(c, 1, frequent.KEPT))
    assert key.select(F.max(F.length("known") + F.length("head"))).first()[0] < 140
