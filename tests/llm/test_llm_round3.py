"""Hard negatives, main text of pages and periodic runs against brute force, with edge rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import cleanframe.llm.hard_negatives as hard
from cleanframe.llm.hard_negatives import hard_negatives
from cleanframe.llm.html_text import extract_main_text, main_text, stretches
from cleanframe.llm.periodic_runs import periodic_runs, repeat_tails, run_digests

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SMALL = "/root/testdata/sf0.001"


def brute_negatives(rows, anchor, positives=5, k=5, low=80):
    usable = [(i, y, tuple(math.floor(256 * x) for x in v)) for i, v, y in rows
              if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = Counter()
    for a in {r for r in usable if anchor(r[0])}:
        scored = sorted((-sum(x * y for x, y in zip(a[2], r[2])), r[0], r[1]) for r in usable)
        best = [(-s, i) for s, i, y in scored if y == a[1] and i != a[0]][:positives]
        for p, i in best:
            fits = [(-s, j) for s, j, y in scored if y != a[1] and low * p <= -100 * s <= 100 * p][:k]
            out.update((a[0], i, n, j, p, s) for n, (s, j) in enumerate(fits, 1))
    return out


def embedded(spark, rows):
    return spark.createDataFrame([(i, v, y, "x", 0) for i, v, y in rows], "vec_id bigint, embedding array<double>, label int, key string, score int")


def near(seed, n, labels=3, width=8):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=width)
    return [(i, (base + rng.normal(size=width) * rng.choice([0, 0.05, 0.6])).tolist(), int(rng.integers(labels))) for i in range(n)]


EDGE_VECTORS = [
    (None, [0.5] * 8, 1), (2000, None, 1), (2001, [0.5] * 8, None), (2002, [0.5, None, 0.1], 1), (2003, [float("nan")] * 8, 1),
    (2004, [float("inf")] + [0.5] * 7, 1), (2005, [], 1), (2006, [0.25], 2), (2010, [0.0] * 8, 0), (2020, [-0.5] * 8, 0), (2021, [-0.5] * 8, 0),
    (2030, [0.5] * 8, 9), (2040, [5e6] * 3, 1), (2041, [5e6 - 9] * 3, 2), (2042, [5e6 + 0.1] * 3, 1), (7, [0.5] * 8, 1), (7, [0.5] * 8, 1), (7, [0.5] * 8, 2)]


@pytest.mark.parametrize("size", [hard.CHUNK, 7])
def test_hard_negatives_match_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(hard, "CHUNK", size)
    monkeypatch.setattr(hard, "BLOCK", size)
    monkeypatch.setattr(hard, "HELD", 2 * size)
    rows = near(1, 300) + EDGE_VECTORS
    got = hard_negatives(embedded(spark, rows).repartition(3), F.col("vec_id") % 10 == 0).collect()
    want = brute_negatives(rows, lambda i: i % 10 == 0)
    assert Counter(tuple(r) for r in got) == want
    assert {r[0] for r in got} >= {0, 10, 2010, 2040} and any(r["positive_score"] > 2**53 for r in got)


def test_hard_negatives_of_one_common_vector(spark):
    rows = [(i, [0.5, 0.25], i % 2) for i in range(500)] + [(600 + i, [0.5, 0.24], 1) for i in range(50)]
    got = hard_negatives(embedded(spark, rows), F.col("vec_id") % 100 == 0, positives=3, k=4, low=95)
    assert Counter(tuple(r) for r in got.collect()) == brute_negatives(rows, lambda i: i % 100 == 0, 3, 4, 95)


def test_scores_beyond_64_bits_are_held_at_the_largest(spark):
    rows = [(0, [1e30], 1), (1, [1e30], 1), (2, [1e20], 2), (3, [-1e30], 2), (4, [0.0], 2)]
    got = hard_negatives(embedded(spark, rows), F.col("vec_id") == 0).collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 2, 2**63 - 1, 2**63 - 1)]


def test_hard_negatives_without_rows(spark):
    assert hard_negatives(embedded(spark, []), F.col("vec_id") % 10 == 0).collect() == []
    assert hard_negatives(embedded(spark, near(2, 9)), F.col("vec_id") < 0).collect() == []
    assert hard_negatives(embedded(spark, [(0, [1.0], 1), (1, [1.0], 2)]), F.col("vec_id") == 0).collect() == []


ARTICLE = "<article class='post has-comments'><h1>Head &amp line</h1><p>One <b>two</b>\n three<br>four<p>f&eacute;&nbsp;ve &lt;p&gt; 1 < 2</article>"
PAGES = {
    "article": (f"<body><header><h1>Site</h1></header><nav><a href=x>Menu</a></nav>{ARTICLE}<footer>&copy; us</footer></body>", "Head & line\nOne two three four\nfé ve <p> 1 < 2"),
    "inside": (
        "<main><article><header><h1>Title</h1></header><p>First.</p><aside>side</aside><div class='ad-slot'><p>Buy</p><div>now</div></div><p>Second.</p>"
        "<form><label>Mail</label><input name=a></form><script>var a='</p>'+1<2;</script><style>p{}</style><!-- <p>no</p> --><p>x</p>"
        "<section id='comments'><h2>Comments</h2><article class='comment'><p>Nice!</p></article></section><footer>By me</footer></article></main>", "Title\nFirst.\nSecond.\nx"),
    "short": ("<div class=ad>Long advert text before the article, much longer than it is</div><article><p>Hi</article>", "Hi"),
    "cut": ("<article><p>Kept text</p><p>more &am<b", "Kept text\nmore &am"),
    "no article": (
        "<body><div><a href=a>Home</a> <a href=b>About us and all</a></div><div></div><div><div>"
        + "".join(f"<p>Sentence {k} of the story, which is told at length.</p>" for k in range(6)) + "</div></div><div></div><div><p>Made by X</p></div></body>",
        "\n".join(f"Sentence {k} of the story, which is told at length." for k in range(6))),
    "named wrapper": ("<div class='sidebar-right'><article><p>Text</p></article></div>", "Text"),
    "notice": ("<div role=alert>We use cookies</div><div class='cookieNotice'>Accept</div><article><p hidden>secret</p><p>Text</p><ul><li>a<li>b</ul></article>", "Text\na\nb"),
    "open advert": ("<article><p class=ad>Buy<p>Text</p><li class=promo>x<li>y</article>", "Text\ny"),
    "quotes": ("<article title='a>b'><p data-x=\"1>2\">Text</p><p title=\"open>still text</p></article>", "Text\nstill text"),
    "empty": ("", ""), "null": (None, ""), "no text": ("<article><nav>x</nav></article><footer>y</footer>", ""), "plain": ("Only words, no markup", "Only words, no markup"),
}


def test_main_text_of_pages(spark):
    rows = [(name, page, "u", 7, 8) for name, (page, _) in PAGES.items()] + [("null", None, None, 7, 8), (None, "<article>a", "u", 7, 8)]
    got = extract_main_text(spark.createDataFrame(rows, "page_id string, html string, url string, n_chars int, text int")).collect()
    assert Counter((r["page_id"], r["text"], r["n_chars"]) for r in got) == Counter(
        [(n, t, len(t)) for n, (_, t) in PAGES.items()] + [("null", "", 0), (None, "a", 1)])
    assert extract_main_text(spark.createDataFrame([], "html string, url string")).collect() == []


def test_a_very_long_page_is_kept_whole():
    blocks = [f"Block {k} &amp; more" for k in range(60_000)]
    text, n, _ = main_text("<nav>no</nav><article>" + "".join(f"<p>{b}</p>\n" for b in blocks) + "</article>")
    assert text == "\n".join(b.replace("&amp;", "&") for b in blocks) and n == len(blocks)


def test_stretches_lie_between_surge_and_dive():
    sizes = np.array([0, 5, 0, 0, 0, 60, 40, 0, 70, 0, 0, 0, 9, 0])
    assert [(a, min(b, len(sizes))) for a, b in stretches(sizes, 86)] == [(5, 11)]
    assert len(stretches(sizes, 1)) == 3 and stretches(np.zeros(4, int), 1) == [] and stretches(np.zeros(0, int), 1) == []


def brute_runs(words, least=24, repeats=3):
    ids = {w: k for k, w in enumerate(dict.fromkeys(words))}
    a = np.array([ids[w] for w in words], np.int64)
    found = {}
    for q in range(len(a) // repeats, 0, -1):
        same = np.concatenate([[False], a[q:] == a[:-q], [False]])
        edge = np.flatnonzero(same[1:] != same[:-1])
        for i, j in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if j - i + q >= max(least, repeats * q):
                found[(i, j + q)] = q
    return sorted((i, j - i, q) for (i, j), q in found.items())


def runny_texts():
    rng = random.Random(3)
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "a " * 23), (5, "a " * 24), (6, "a " * 9000), (7, "A a " * 30), (8, "é x " * 12), (9, "a b c d e f g h " * 3),
            (10, "a b c d e f g h " * 2 + "a b c d e f g"), (11, "x " + "a b " * 20 + "a y " + "a b " * 20), (None, "q r " * 40), (5, "a " * 24), (12, "one\x85two　three " * 30)]
    for i in range(60):  # texts over few words, and nested and overlapping repeats
        words = [rng.choice("abc"[: rng.randint(1, 3)]) for _ in range(rng.randint(1, 400))]
        for _ in range(rng.randint(0, 4)):
            at, size = rng.randrange(len(words)), rng.randint(1, 30)
            words[at:at] = words[at : at + size] * rng.randint(2, 8)
        rows.append((100 + i, " ".join(words)))
    fib = ["a", "ab"]
    while len(fib[-1]) < 3000:
        fib.append(fib[-1] + fib[-2])
    rows += [(90, " ".join(fib[-1])), (91, " ".join(rng.choice("ab") for _ in range(5000)))]
    return rows


def collapsed(words, runs):
    held = {k for i, n, q in runs for k in range(i + q, i + n)}
    return " ".join(w for k, w in enumerate(words) if k not in held)


def test_runs_match_brute_force(spark):
    rows = runny_texts()
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id bigint, text string, runs int, period string")
    got = periodic_runs(docs).collect()
    want = Counter()
    for i, t in rows:
        words = WORD.findall(t or "")
        runs = brute_runs(words)
        want[(i, len(words), tuple(runs), collapsed(words, runs))] += 1
    assert Counter((r["doc_id"], r["n_words"], tuple(tuple(x) for x in r["runs"]), r["collapsed"]) for r in got) == want
    assert sum(len(r["runs"]) for r in got) > 100
    short = periodic_runs(docs, least=6, repeats=4).collect()
    assert Counter((r["doc_id"], tuple(tuple(x) for x in r["runs"])) for r in short) == Counter((i, tuple(brute_runs(WORD.findall(t or ""), 6, 4))) for i, t in rows)
    assert periodic_runs(docs.limit(0)).collect() == []


def test_run_digests_match_brute_force(spark):
    rows = runny_texts() + [(r["doc_id"] + 1000, r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = run_digests(periodic_runs(repeat_tails(spark.createDataFrame(rows, "doc_id bigint, text string")))).collect()
    want = Counter()
    for i, t in rows:
        words = WORD.findall(t or "")
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
        runs = brute_runs(words)
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2])) if runs else (None, None, None)
        want[(i, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
              hashlib.sha256("".join(f"{a},{n},{q}\n" for a, n, q in runs).encode()).hexdigest(), hashlib.sha256(collapsed(words, runs).encode()).hexdigest())] += 1
    assert Counter(tuple(r) for r in got) == want
