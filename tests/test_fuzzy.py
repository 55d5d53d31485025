"""Fuzzy duplicates against brute force."""

import os
import random
import re
import subprocess
import sys
from collections import Counter

import pytest
from pyspark import cloudpickle

import cleanframe as cf
import cleanframe.operators.fuzzy as fuzzy
import cleanframe.operators.fuzzy_blocks as blocks


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(rows, threshold, normalise=True):
    count = Counter(v for v in rows if v is not None)
    groups: dict = {}
    for v, n in count.items():
        normal = " ".join(v.split()).lower() if normalise else v
        if normal.strip():
            groups.setdefault(normal, []).append((-n, v))
    out = Counter()
    shown = {g: (min(own)[1], -sum(n for n, _ in own)) for g, own in groups.items()}
    names = sorted(groups)
    for i, a in enumerate(names):
        for b in names[:i]:
            longest = max(len(a), len(b))
            if abs(len(a) - len(b)) * 100 <= (100 - threshold) * longest and (d := edits(a, b)) * 100 <= (100 - threshold) * longest:
                (x, nx), (y, ny) = sorted((shown[a], shown[b]))
                out[(x, y, nx, ny, d, round(100 - 100 * d / longest, 6))] += 1
    for own in groups.values():
        top = min(own)
        out.update((top[1], v, -top[0], -n, 0, 100.0) for n, v in own if v != top[1])
    return out


def frame(spark, rows):
    return spark.createDataFrame([(v, i, "x") for i, v in enumerate(rows)], "name string, id int, normal string")


def edited(rng, text, k):
    for _ in range(k):
        at = rng.randrange(len(text) + 1)
        kind = rng.random()
        text = text[:at] + ("" if kind < 0.3 else rng.choice("abcdé日 ")) + text[at + (kind < 0.6) :]
    return text


def names(seed=1):
    rng = random.Random(seed)
    rows = [None, "", "  ", "a", "A", " a ", "New York", "new  york", "NEW YORK ", "New Yorks", "ok", "ko", "x" * 400, "x" * 399 + "y", "x" * 430, "é" * 30, "É" * 29 + "e"]
    for _ in range(25):
        base = "".join(rng.choice("abcdé日 ") for _ in range(rng.randint(3, 90)))
        rows += [edited(rng, base, rng.randint(0, 1 + len(base) // 6)) for _ in range(rng.randint(1, 6))]
    rows += [f"{k % 7} common street name {k}" for k in range(40)]
    return rows + rng.choices(rows, k=60)


def got(df):
    return Counter((r["value_a"], r["value_b"], r["rows_a"], r["rows_b"], r["distance"], round(r["similarity"], 6)) for r in df.collect())


@pytest.mark.parametrize("threshold, normalise, hot", [(90, True, 5000), (80, True, 3), (90, False, 3), (65, True, 5000), (100, True, 5000)])
def test_pairs_equal_brute_force(spark, monkeypatch, threshold, normalise, hot):
    monkeypatch.setattr(fuzzy, "HOT", hot)
    rows = names()
    found = got(cf.fuzzy_duplicates(frame(spark, rows), "name", threshold, normalise))
    want = brute(rows, threshold, normalise)
    assert found == want
    assert len(want) > (1 if threshold == 100 else 40)


def test_no_pair_of_values_without_a_common_segment(spark):
    plan = cf.fuzzy_duplicates(frame(spark, names()), "name")._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_only_similar_pairs_leave_the_join_and_no_side_is_broadcast(spark):
    """Spark takes the exploded sides for as small as the values' files, and would broadcast them."""
    df = frame(spark, names())
    for found, joins in ((cf.fuzzy_duplicates(df, "name"), 1), (cf.fuzzy_report(df, ["name"]), 1)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"BroadcastHashJoin .* Inner", plan)
        assert len(re.findall(r"SortMergeJoin .*levenshtein", plan)) == joins  # verified there, once for the report


def test_report_equals_the_pairs(spark):
    rows = names(2)
    want = brute(rows, 80)
    pairs = [w for w in want if w[4] > 0]
    row = cf.fuzzy_report(frame(spark, rows), ["name"], 80).first()
    assert (row["n_pairs"], row["n_values"], row["n_spellings"], round(row["max_similarity"], 6)) == (
        len(pairs), len({v for w in pairs for v in w[:2]}), len(want) - len(pairs), max(w[5] for w in pairs))


def test_report_and_samples(spark):
    df = frame(spark, ["John Smith", "john smith ", "Jon Smith", "Jon Smith", "Someone Else"])
    assert [tuple(r) for r in cf.fuzzy_samples(df, "name", "id", 85).collect()] == [
        (0, "John Smith", 1, "john smith ", 0, 100.0), (0, "John Smith", 2, "Jon Smith", 1, 90.0)]
    row = cf.fuzzy_report(df, threshold=90).filter("column = 'name'").first()
    assert (row["n_pairs"], row["n_values"], row["n_spellings"], row["max_similarity"]) == (1, 2, 1, 90.0)


def test_what_cannot_be_compared(spark):
    df = frame(spark, [])
    assert cf.fuzzy_duplicates(df, "name").collect() == []
    for bad in ("id", "none"):
        with pytest.raises(ValueError):
            cf.fuzzy_duplicates(df, bad)
    for threshold in (0, 101):
        with pytest.raises(ValueError):
            cf.fuzzy_duplicates(df, "name", threshold)
    assert cf.fuzzy_report(df.select("id")).collect() == []


def urls(n=200, seed=3):
    rng = random.Random(seed)
    return [f"{rng.choice(['http', 'https'])}://blog.tionble.example.com/{rng.choice(['en', 'de', 'fr'])}/{rng.randrange(300000)}{rng.choice(['', '/', '.html', '#top', '?page=2&ref=x'])}" for _ in range(n)]


def test_values_of_few_edits_are_not_joined_pair_by_pair(spark):
    """Each url of a host was joined with all others of it, and most of these pairs were verified."""
    plan = cf.fuzzy_duplicates(frame(spark, urls()), "name", 90)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"MapInArrow run\(.*\bsets", plan)
    assert len(re.findall(r"Filter .* > 89\)", plan)) >= 2  # the join sees longer ones, and what may match these


@pytest.mark.parametrize("batch", [7, 10_000])
def test_few_pairs_of_urls_are_verified(spark, monkeypatch, batch):
    rows = sorted(set(urls()))
    values = spark.createDataFrame([(i, v, v, 1) for i, v in enumerate(rows)], "id bigint, normal string, value string, rows bigint")
    values = values.mapInArrow(blocks.with_sets(89), "id bigint, normal string, value string, rows bigint, sets binary")
    batches = fuzzy._short_rows(values, 1000, 89, 1).toArrow().combine_chunks().to_batches(batch)
    verified, check = [], blocks._verified
    monkeypatch.setattr(blocks, "_verified", lambda rows, x, y: verified.append(len(x)) or check(rows, x, y))
    found = Counter((r["value_a"], r["value_b"], r["distance"]) for b in blocks.pairs_of_blocks(1000, 89)(iter(batches)) for r in b.to_pylist())
    want = {(b, a, d) for i, a in enumerate(rows) for j, b in enumerate(rows[:i])
            if abs(len(a) - len(b)) <= (k := max(len(a), len(b)) // 10) and (d := edits(a, b)) <= k}
    assert found == Counter(want) and len(want) > 200
    assert sum(verified) < len(rows) * (len(rows) - 1) / 2 * 0.6


@pytest.mark.parametrize("normalise", [True, False])
def test_letters_beyond_sixteen_bits_and_zeros(spark, normalise):
    base = "the 😀 quick 𝔘nicode \x00 value of 日本 letters"
    rows = [base, base + "\x00", base[:-1], base.replace("😀", "😁"), "\x00" + base, base.replace("日", "本"), "ascii only value of some letters", "ascii only value of some letterz"]
    assert got(cf.fuzzy_duplicates(frame(spark, rows), "name", 80, normalise)) == brute(rows, 80, normalise)


def test_blocks_run_where_the_package_is_not_on_the_path(tmp_path):
    (tmp_path / "run").write_bytes(cloudpickle.dumps([blocks.pairs_of_blocks(1000, 89), blocks.with_sets(89)]))
    code = "import pickle, pyarrow as pa; a, b = pickle.load(open('run', 'rb')); print(len(list(a(b(iter([pa.record_batch({'normal': pa.array(['x'])}).slice(1)])))))) "
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert done.stdout.strip() == "0", done.stderr
