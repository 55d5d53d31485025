"""Near duplicates, fingerprints and decontamination against brute force, with edge rows."""

import hashlib
import random
import re
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from cleanframe.llm.components import connected_components
from cleanframe.llm.decontaminate import MASKS, contaminated, contamination_report, without_benchmark
from cleanframe.llm.merkle import PIECE, edit_report, likeness, with_tree
from cleanframe.llm.ngram_join import ngram_jaccard_groups, one_of_each_group
from cleanframe.llm.scratch import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, cls string, seed string, part int, key int, comp int"


def rows_with_edges():
    """Random texts, near copies by single edits in one large group, and every edge row."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    out, base = [], [word() for _ in range(120)]
    for i in range(60):
        words = list(base)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = word()
        out.append((100 + i, " ".join(words)))
    for i in range(40):
        out.append((300 + i, "\n".join(word() for _ in range(rng.randint(1, 60)))))
    out += [(1, None), (2, ""), (3, " \t\n "), (4, "One two"), (5, "one TWO"), (6, "one two three four five"), (7, "one two three four five six"),
            (8, "É é"), (9, "é é"), (11, "x " * 5000), (12, "x " * 4000), (None, "lost words of no id at all here"), (20, "lost words of no id at all here")]
    out += [(13, "same text said twice in two rows"), (13, "same text said twice in two rows")]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, None, "c", "s", 1, 2, 3) for i, t in rows], SCHEMA)


def brute_groups(rows):
    sets = []
    for _, text in rows:
        text = (text or "").translate({c: c + 32 for c in range(65, 91)})
        w = WORD.findall(text)
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    group = list(range(len(rows)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                group[find(a)] = find(b)
    least: dict = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return Counter((i, len(sets[k]), least.get(find(k)) if sets[k] else i) for k, (i, _) in enumerate(rows))


def test_groups_match_brute_force(spark):
    rows = rows_with_edges()
    got = ngram_jaccard_groups(frame(spark, rows)).select("doc_id", "n_shingles", "component_id").collect()
    assert Counter(tuple(r) for r in got) == brute_groups(rows)


@pytest.mark.parametrize("hot", [5, 20])
def test_groups_match_brute_force_where_hot_grams_are_split(spark, hot):
    rows = rows_with_edges()
    for k in range(12):  # one class of many copies and one near copy: two classes share every hot n-gram
        words = [f"w{k}x{i}" for i in range(40)]
        rows += [(1000 + 100 * k + i, " ".join(words)) for i in range(30)] + [(1099 + 100 * k, " ".join([*words, "more"]))]
    got = ngram_jaccard_groups(frame(spark, rows), hot=hot).select("doc_id", "n_shingles", "component_id").collect()
    assert Counter(tuple(r) for r in got) == brute_groups(rows)


def test_one_of_each_group_keeps_columns_and_empty_texts(spark):
    rows = [(1, "a b c d e f g h i j k"), (2, "a b c d e f g h i j k"), (3, None), (4, ""), (None, "z z")]
    kept = one_of_each_group(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 3, 4]


def test_rows_that_share_an_id_go_with_their_own_group(spark):
    a, b = "a b c d e f g h i j k l m n", "totally clean words that nothing else in here says at all"
    near = a.replace("n", "o")
    rows = [(1, a), (1, a), (5, a), (5, b), (6, b), (6, b), (2, near), (2, None), (2, ""), (7, near), (7, "x y z"), (None, a), (8, "p q r s t u v w"), (8, "p q r s t u v w x")]
    kept = one_of_each_group(frame(spark, rows))
    got = Counter((r["doc_id"], r["text"]) for r in kept.collect())
    assert kept.columns == frame(spark, rows).columns
    twin = [(8, "p q r s t u v w"), (8, "p q r s t u v w x")]  # one group of one id: either may stay
    assert sum(got.pop(t, 0) for t in twin) == 1
    assert got == Counter([(1, a), (5, b), (2, None), (2, ""), (7, "x y z"), (None, a)])
    assert one_of_each_group(frame(spark, [])).collect() == []


def test_groups_of_an_empty_table(spark):
    assert ngram_jaccard_groups(frame(spark, [])).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (-5, 3)]
    got = connected_components(spark.createDataFrame(edges, "a bigint, b bigint"), Scratch(spark, "test"), "parts")
    assert {r["cls"]: r["comp"] for r in got.collect()} == {**{i: -5 for i in range(1, 41)}, -5: -5, **{k: 100 for k in range(100, 140)}}


def test_edits_match_python(spark):
    rows = [(5, "Abc. Déf!\nGhi jkl.\n\nMno."), (3, "xyz" * 100), (9, None), (4, ""), (1, "ab"), (7, "🙂🙃 smile.\nEnd"), (2, "Line.\n" * 2000)]
    got = {r["doc_id"]: r for r in edit_report(frame(spark, rows)).collect()}
    order = sorted(rows, reverse=True)
    for k, (i, text) in enumerate(order):
        text, following = text or "", order[(k + 1) % len(order)][1] or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + following[:third]
        assert got[i]["n_chars"] == len(text)
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert (got[i]["fingerprint"] == got[i]["edited_fingerprint"]) == (edited == text)
        assert (got[i]["first_change"] is None) == (edited == text)
        for name, other in (("near_edited", edited), ("near_next", following)):
            a, b = (Counter(x for line in t.split("\n") for x in re.findall(PIECE, line)) for t in (text, other))
            both, total = (sum(n * len(x) for x, n in c.items()) for c in (a & b, a + b))
            assert got[i][name] == pytest.approx(2 * both / total if total else float(text == other))


def test_repeated_lines_count_as_often_as_they_stand(spark):
    rows = [(2, "The same line again.\n" * 2000), (1, "something else " * 5000), (0, "\n\n"), (-1, "\n")]
    got = {r["doc_id"]: r for r in edit_report(frame(spark, rows)).collect()}
    assert got[2]["near_edited"] == pytest.approx(2 / 3, abs=0.01)
    assert got[0]["near_next"] == 0.0 and got[0]["near_edited"] == 1.0


def test_edits_with_repeated_and_missing_ids(spark):
    rows = [(1, "a"), (1, "a"), (1, "b"), (None, "c"), (None, None)]
    assert edit_report(frame(spark, rows)).count() == 5
    assert edit_report(frame(spark, [])).count() == 0
    assert edit_report(frame(spark, [(4, "alone text")])).first()["near_next"] == 1.0


def test_tree_tells_texts_apart_and_finds_the_edit(spark):
    a, b = "one.\ntwo.\nthree.\nfour.", "one.\ntwo.\nthree!\nfour."
    r = with_tree(spark.createDataFrame([(a, b, a)], "text string, other string, again string"))
    r = with_tree(with_tree(r, "other", "o_"), "again", "g_").select(
        F.col("fingerprint") == F.col("g_fingerprint"), F.col("fingerprint") == F.col("o_fingerprint"), likeness(F.col("leaves"), F.col("o_leaves"), F.lit(False))).first()
    assert r[0] and not r[1]
    assert r[2] == pytest.approx(2 * (4 + 4 + 5) / (2 * (4 + 4 + 6 + 5)))


def brute_placements(rows, items, percent=80):
    """Every placement of every item on every text, as the operator judges those that share a seed; here all."""
    found = {}
    split = lambda t: [w for w in WORD.findall((t or "").lower())]
    for i, text in rows:
        w = split(text)
        for item, words in ((k, split(t)) for k, t in items):
            for start in range(-len(words) + 1, len(w)):
                agree = sum(1 for k, x in enumerate(words) if 0 <= start + k < len(w) and w[start + k] == x)
                if (len(words) >= 6 or words == w) and 100 * agree >= percent * len(words):
                    best = found.get((i, item))
                    if best is None or agree > best[1]:
                        found[(i, item)] = (start, agree, len(words))
    return found


def test_decontamination_matches_brute_force(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(4))
    items = [(k, " ".join(word() for _ in range(rng.randint(12, 40)))) for k in range(8)] + [(90, "short one"), (91, None), (92, "")]
    rows = []
    for i in range(60):
        text = [word() for _ in range(rng.randint(5, 80))]
        if i % 3 == 0:
            item = items[i % 8][1].split()
            for _ in range(len(item) // 12):  # one word in twelve replaced keeps a seed
                item[rng.randrange(len(item))] = word()
            at = rng.randrange(len(text))
            text[at:at] = item
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(text).upper() if i % 2 else " ".join(text)))
    rows += [(1000, None), (1001, ""), (1002, items[0][1]), (1003, "  " + items[1][1] + "  "), (1003, "clean text that shares its id with another row")]
    docs = frame(spark, rows)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = brute_placements(rows, items)
    got = {(r["doc_id"], r["item_id"]): (r["start"], r["agree"], r["item_words"]) for r in contaminated(docs, bench).collect()}
    assert got == want and len(want) > 15
    shuffled = contaminated(docs, bench, placed_at_once=0)
    assert {(r["doc_id"], r["item_id"]): (r["start"], r["agree"], r["item_words"]) for r in shuffled.collect()} == want
    in_blocks = {(r["doc_id"], r["item_id"]): (r["start"], r["agree"], r["item_words"]) for r in contaminated(docs, bench, seeds_at_once=50).collect()}
    assert in_blocks == want
    report = contamination_report(docs, bench).collect()
    assert len(report) == len(rows)
    assert sorted(r["contaminated"] for r in report if r["doc_id"] == 1003) == [False, True]
    kept = without_benchmark(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(not r["contaminated"] for r in report)


def test_a_seed_is_left_whichever_words_are_replaced():
    for n in range(6, 25):
        seeds = [{s + k for k in mask} for mask in MASKS for s in range(n - mask[-1])]
        for replaced in combinations(range(n), n // 5):
            assert any(seed.isdisjoint(replaced) for seed in seeds), (n, replaced)


def test_items_that_agree_in_just_enough_words_are_found(spark):
    rng = random.Random(5)
    items, rows = [], []
    for n in [*range(6, 26), 30, 45, 60]:
        words = [f"w{n}x{k}" for k in range(n)]
        items.append((n, " ".join(words)))
        for t in range(12):
            text = list(words)
            for k in rng.sample(range(n), n // 5 + (t == 11)):  # the last one has a word too few
                text[k] = f"other{t}"
            cut = ["before"] * rng.randint(0, 9) + text + ["after"] * rng.randint(0, 9)
            rows.append((100 * n + t, " ".join(cut)))
    items += [(1, "one"), (2, "Two words"), (5, "a b c d e"), (-1, ""), (-2, None)]
    rows += [(1, "ONE "), (2, "one two"), (3, "two\nwords"), (4, "a b c d e"), (5, "a b c d x"), (6, "a b c d e f"), (7, ""), (8, None)]
    got = {(r["doc_id"], r["item_id"]) for r in contaminated(frame(spark, rows), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert got == {(i, i // 100) for i, _ in rows if i >= 100 and i % 100 != 11} | {(1, 1), (3, 2), (4, 5)}


def test_decontamination_of_empty_tables(spark):
    docs, bench = frame(spark, [(1, "some text of more than six words here")]), spark.createDataFrame([], "item_id bigint, text string")
    assert contamination_report(docs, bench).collect()[0]["contaminated"] is False
    assert contamination_report(frame(spark, []), bench).count() == 0
