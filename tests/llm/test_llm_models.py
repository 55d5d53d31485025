"""Classifiers by held-out accuracy, counts and scores against brute force, mixtures and token files by their promises."""

import json
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from cleanframe.llm import suffix_tree
from cleanframe.llm.language import fit_language, identify, known_language
from cleanframe.llm.mixing import cycle, mix_sources, target_quanta
from cleanframe.llm.quality import FEATURES, fit_quality, score_quality, shape, text_shape
from cleanframe.llm.queries import QUERIES, fold
from cleanframe.llm.segment import gram_hashes, slices, words
from cleanframe.llm.suffix_tree import DISCOUNT, DIVERGENCE, EVIDENCE, SMOOTHING, score_texts
from cleanframe.llm.token_store import PieceEncoder, TokenFile, fetch_tokens, read_index, read_tokens, write_tokens
from cleanframe.llm.toxicity import fit_toxicity, score_toxicity
from cleanframe.llm.wordpiece import build, byte_vocabulary, token_counts

SF_DIR = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"
BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
EDGES = [(1, None), (2, ""), (3, " \t\n"), (4, "12 34 !?"), (5, "Éa" * 3), (None, "the same row"), (6, "the same row"), (6, "the same row"), (7, "word " * 60_000), (8, "x" * 300_000)]
CLASH = "doc_id bigint, text string, lang string, source string, score double, lang_pred string, predicted int, label int, mix_slot int, slot int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, None, 0.5, "q", 7, 8, 9, 10) for i, t in rows], CLASH)


def test_words_and_grams():
    texts = pa.array(["A b\tC", None, "", "  x", "one two three four five six"])
    w = words(texts)
    assert [w.text(k) for k in range(len(w.hash))] == [b"a", b"b", b"c", b"x", b"one", b"two", b"three", b"four", b"five", b"six"]
    assert w.first.tolist() == [0, 3, 3, 3, 4, 10]
    assert np.diff(gram_hashes(w, 5)[1]).tolist() == [1, 0, 0, 1, 2]
    assert words(pa.array(["c A b x"])).hash[1] == w.hash[0]
    assert list(slices(pa.array(["ab", "cd", None, "efgh"]), 4)) == [(0, 3), (3, 4)]


def held_out(spark, name, label, predicted):
    """Share of held-out rows whose label is predicted."""
    truth = spark.read.parquet(f"{SF_DIR}/{'documents' if label == 'lang' else 'labels'}.parquet")
    rows = QUERIES[name](spark, SF_DIR).filter("held_out").drop("lang").join(truth.select("doc_id", F.col(label).alias("truth")), "doc_id")
    return rows.agg(F.avg((F.col("truth") == F.col(predicted)).cast("int"))).first()[0]


def test_language_of_held_out_texts(spark):
    assert held_out(spark, "op3_language_kernel", "lang", "lang_pred") > 0.98


def test_quality_of_held_out_texts(spark):
    assert held_out(spark, "op4_quality_additive", "quality", "predicted") > 0.95


def test_toxicity_of_held_out_texts(spark):
    assert held_out(spark, "op5_toxicity_ftrl", "toxic", "predicted") > 0.9


def test_language_edges(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = fit_language(docs)
    got = identify(frame(spark, EDGES), model)
    assert got.columns == [c for c in frame(spark, []).columns if c not in ("score", "lang_pred")] + ["lang_pred", "score"]
    rows = got.collect()
    assert len(rows) == len(EDGES) and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["doc_id"] for r in rows if r["lang_pred"] == "und"} == {1, 2, 3, 4}
    assert known_language(docs, model).count() == docs.count()
    assert {r["doc_id"] for r in known_language(frame(spark, EDGES[:4]), model).collect()} == set()
    foreign = [(1, "これは日本語の文章です。今日は天気がいいですね。"), (2, "Это предложение написано на русском языке"), (3, "안녕하세요 오늘은 날씨가 좋네요")]
    for languages in (["en", "de"], ["en", "de", "fr", "es"]):
        own = docs.filter(F.col("lang").isin(languages))
        few = fit_language(own)
        assert known_language(frame(spark, foreign), few).count() == 0 and known_language(own, few).count() == own.count()
    none = fit_language(docs.withColumn("lang", F.lit(None).cast("string")))
    assert none is None and {r["lang_pred"] for r in identify(frame(spark, EDGES), none).collect()} == {"und"}
    assert identify(frame(spark, []), model).count() == 0


def test_quality_edges(spark):
    shapes = text_shape(frame(spark, EDGES))
    assert shapes.count() == len(EDGES)
    labels = spark.createDataFrame([(2, 0), (5, 1), (7, 1), (99, 1), (4, None)], "doc_id bigint, label int")
    for given in (labels, labels.filter("label = 1"), labels.limit(0)):
        scored = score_quality(shapes, fit_quality(shapes, given)).collect()
        assert len(scored) == len(EDGES) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in scored)
    x = dict(zip(FEATURES, shape(pa.array(["A b!\nA b!\nzz 12"]))[0]))
    assert x["repeated_lines"] == pytest.approx(1 / 3) and x["digits"] == 2 / 15 and x["marks"] == 2 / 15 and x["distinct"] == 4 / 6


def test_toxicity_edges(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = [(i, " ".join([word() for _ in range(30)] + (["vile", "slur."] if i % 4 == 0 else [])), int(i % 4 == 0)) for i in range(400)] + [(1000, None, 0), (1001, "x", None)]
    train = spark.createDataFrame(rows, "doc_id bigint, text string, label int")
    model = fit_toxicity(train)
    got = {r["doc_id"]: r for r in score_toxicity(frame(spark, [*EDGES, (50, "some words, VILE slur!"), (51, "some words")]), model).collect()}
    assert got[50]["predicted"] == 1 and got[51]["predicted"] == 0 and got[2]["predicted"] == 0
    assert len(model.slots) < 2000
    assert score_toxicity(frame(spark, EDGES), fit_toxicity(train.filter("label = 0"))).count() == len(EDGES)
    assert score_toxicity(frame(spark, EDGES), fit_toxicity(train.limit(0))).agg(F.max("predicted")).first()[0] == 1  # 0.5 for all


def test_toxicity_shuffles_ids_only(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(rng.choice([None, *range(200)]), " ".join(rng.choice(["a", "bc", "vile", "d"]) for _ in range(9))) for _ in range(400)]
    marked = [(rng.choice([None, *range(300)]), rng.choice([None, 0, 0, 1, 1, 2])) for _ in range(500)]
    docs, labels = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(marked, "doc_id bigint, label int")
    plans, collect = [], type(docs).collect
    monkeypatch.setattr(type(docs), "collect", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or collect(df))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for per_label in (30, 3000):
            want = fit_toxicity(docs.join(labels, "doc_id"), per_label)
            plans.clear()
            got = fit_toxicity(docs, per_label, labels=labels)
            assert got.bias == want.bias and got.slots.tolist() == want.slots.tolist() and got.weights.tolist() == want.weights.tolist()
            lines = "\n".join(plans).split("\n")
            shuffled = [below for line, below in zip(lines, lines[1:]) if "Exchange hashpartitioning" in line]
            assert shuffled and not any("text#" in x for x in shuffled)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_suffix_tree_groups_in_little_memory():
    x = np.random.default_rng(1).integers(0, 1 << 60, 1 << 20, dtype=np.uint64)
    tracemalloc.start()
    try:
        distinct, first, which = suffix_tree._grouped(x)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert (x[first] == distinct).all() and (distinct[which] == x).all()
    assert peak < 4 * x.nbytes


def test_suffix_tree_groups_by_ranges():
    rng = np.random.default_rng(2)
    kinds = rng.integers(0, 1 << 63, 1 << 18, dtype=np.uint64)
    x = kinds[rng.integers(0, len(kinds), 1 << 20)]
    tracemalloc.start()
    try:
        suffix_tree._grouped(x)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 2 * x.nbytes
    hot = np.where(rng.random(1 << 18) < 0.9, np.uint64(5), rng.integers(0, 9, 1 << 18, dtype=np.uint64))
    for x in (x, hot, np.zeros(1 << 17, np.uint64), np.arange(1 << 17, dtype=np.uint64)[::-1], np.zeros(1, np.uint64), np.zeros(0, np.uint64)):
        distinct, first, which = suffix_tree._grouped(x)
        assert (distinct == np.unique(x)).all() and (x[first] == distinct).all() and (distinct[which] == x).all()


def block_row(texts, kinds):
    """A block of texts of random tokens, all asked about, as its table holds it."""
    rng = np.random.default_rng(3)
    size = np.full(texts, 1 << 10)
    symbols = rng.integers(2, 1 << 63, kinds, dtype=np.uint64)
    tokens = np.minimum(rng.zipf(1.3, size.sum()), kinds).astype("<u4") - np.uint32(1)
    return {"block": 7, "n_tokens": size.tolist(), "held_out": [k % 5 == 1 for k in range(texts)], "tokens": suffix_tree._packed(tokens), "symbols": suffix_tree._zipped(symbols),
            "prob": suffix_tree._packed(np.linspace(0.1, 0.9, kinds, dtype=np.float32)), "alive": np.packbits(np.ones(len(tokens), bool)).tobytes()}, tokens, symbols


@pytest.mark.parametrize("width", [3, 48, 204])
def test_a_block_asks_each_bucket_once_about_every_pair(width):
    row, tokens, symbols = block_row(20, 300)
    asked = [r for b in suffix_tree._asked(1, width)(iter([pa.RecordBatch.from_pylist([row])])) for r in b.to_pylist()]
    assert len({r["bucket"] for r in asked}) == len(asked) and [r["bucket"] for r in asked] == sorted(r["bucket"] for r in asked)
    n = np.concatenate([suffix_tree._unpacked(r["n"]) for r in asked])
    context = np.concatenate([suffix_tree._unzipped(r["context"], np.uint64) for r in asked])
    bucket = np.concatenate([np.full(len(suffix_tree._unpacked(r["n"])), r["bucket"]) for r in asked])
    assert (suffix_tree._bucket(context, width) == bucket).all() and (np.diff(context.astype(object)) >= 0).all()
    pairs = Counter()
    for k, text in enumerate(tokens.reshape(20, -1).tolist()):
        for pair in zip([-1, *text[:-1]], text):
            pairs[pair] += k % 5 != 1
    assert sorted(n.tolist()) == sorted(pairs.values()) and len(set(context.tolist())) == len({c for c, _ in pairs})
    symbol = np.concatenate([suffix_tree._unpacked(r["symbol"], np.uint64, suffix_tree.SYMBOL_BYTES) for r in asked])
    before = np.concatenate([suffix_tree._unpacked(r["before"], np.float32) for r in asked])
    keep = np.uint64((1 << 8 * suffix_tree.SYMBOL_BYTES) - 1) << np.uint64(64 - 8 * suffix_tree.SYMBOL_BYTES)
    prob = dict(zip((symbols & keep).tolist(), suffix_tree._unpacked(row["prob"], np.float32).tolist()))
    assert [prob[x] for x in symbol.tolist()] == before.tolist()


def test_a_block_asks_in_little_memory():
    row, tokens, _ = block_row(1 << 10, 1 << 17)
    batch = pa.RecordBatch.from_pylist([row])
    del row
    tracemalloc.start()
    try:
        for _ in suffix_tree._asked(1, 48)(iter([batch])):
            pass
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 50 * len(tokens)


def test_mixture_deviates_by_less_than_a_block(spark):
    rows = [(i, f"t{i}", f"s{min(i % 17, 3)}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    mixed = mix_sources(docs, {"s0": 0.5, "s1": 0.3, "s2": 0.15, "s3": 0.05}, block_rows=4, quanta=20).collect()
    assert sorted((r["doc_id"], r["text"], r["source"]) for r in mixed) == rows
    blocks = sorted({(r["mix_slot"], r["source"]) for r in mixed})
    assert len({s for s, _ in blocks}) == len(blocks)  # a slot has one block
    share, seen = {"s0": 10 / 20, "s1": 6 / 20, "s2": 3 / 20, "s3": 1 / 20}, Counter()
    ends = {s: max(b for b, x in blocks if x == s) for s in share}
    for slot, source in blocks:
        seen[source] += 1
        for s, w in share.items():
            if slot <= ends[s]:
                assert abs(seen[s] - w * (slot + 1)) < 1
    assert all(0 <= r["mix_offset"] < 4 for r in mixed)


def test_cycle_gives_each_source_its_quanta(spark):
    sizes = spark.createDataFrame([("a", 700), ("b", 200), ("c", 99), ("", 1)], "source string, n_rows bigint")
    rows = cycle(target_quanta(sizes, quanta=30)).collect()
    assert sorted(r["slot"] for r in rows) == list(range(rows[0]["length"]))
    assert Counter(r["source"] for r in rows) == {r["source"]: r["quanta"] for r in rows}


def test_mixture_edges(spark):
    assert mix_sources(frame(spark, EDGES)).count() == len(EDGES)
    assert mix_sources(frame(spark, [])).count() == 0
    assert mix_sources(frame(spark, EDGES), {}).count() == len(EDGES)
    assert mix_sources(frame(spark, EDGES), part_rows=2).select("mix_slot", "mix_offset").distinct().count() == len(EDGES)


def test_token_files_round_trip(spark, tmp_path):
    from tokenizers import Tokenizer

    rows = [*EDGES, (20, "a  b\n c\n\n  d e "), (21, "don't we'll 日本 語　x y  z"), (22, " lead\r\n\ttail ")]
    rows += [(r["doc_id"] + 100, r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    root = str(tmp_path / "store")
    write_tokens(frame(spark, rows), root, BPE, frame_tokens=5000, files=3)
    got = read_tokens(spark, root).orderBy("start").collect()
    tokenizer = Tokenizer.from_file(BPE)
    want = {(i, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids) + (0,)) for i, t in rows}
    assert Counter((r["doc_id"], tuple(np.frombuffer(r["ids"], "<u4"))) for r in got).keys() == want and len(got) == len(rows)
    assert [r["doc_id"] if r["doc_id"] is not None else -1 for r in got] == sorted(i if i is not None else -1 for i, _ in rows)
    assert [r["start"] for r in got] == np.cumsum([0, *[r["n_tokens"] for r in got]])[:-1].tolist()
    digests = read_tokens(spark, root, with_ids=False).collect()
    assert Counter((r["start"], r["ids_crc32"]) for r in digests) == Counter((r["start"], zlib.crc32(r["ids"])) for r in got)
    some = fetch_tokens(spark, root, spark.createDataFrame([(120,), (5,), (-1,)], "doc_id bigint")).collect()
    assert {r["doc_id"]: bytes(r["ids"]) for r in some} == {r["doc_id"]: bytes(r["ids"]) for r in got if r["doc_id"] in (120, 5)}


def test_damaged_frames_are_noticed(spark, tmp_path):
    root = str(tmp_path / "store")
    write_tokens(frame(spark, [(i, "some words " * 50) for i in range(9)]), root, BPE, frame_tokens=300, files=1)
    file = read_index(spark, root).first()["file"]
    assert len(TokenFile(f"{root}/data", file)) > 2
    body = bytearray(open(file, "rb").read())
    body[30] ^= 0xFF
    open(file, "wb").write(bytes(body))
    with pytest.raises(PythonException):
        read_tokens(spark, root).collect()


def test_token_files_of_an_empty_table(spark, tmp_path):
    root = str(tmp_path / "store")
    write_tokens(frame(spark, []), root, BPE)
    assert read_tokens(spark, root).count() == 0


def test_pieces_encode_like_whole_texts():
    encoder, rng = PieceEncoder(BPE), random.Random(3)
    texts = ["".join(rng.choice(["a", "B", " ", "  ", "\n", "é", "1", ".", "'s", "\t", " ", "日", " "]) for _ in range(200)) for _ in range(60)]
    ids, sizes = encoder.encode(pa.array(texts))
    want = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert sizes.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]


def greedy(word, vocabulary, longest):
    at = n = 0
    while at < len(word):
        at += next(k for k in range(min(longest, len(word) - at), 0, -1) if word[at : at + k] in vocabulary)
        n += 1
    return n


def test_word_pieces_match_greedy_matching(spark):
    rows = [*EDGES[:-1], *[(r["doc_id"] + 100, r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]]
    vocabulary = set(byte_vocabulary(BPE))
    longest = max(map(len, vocabulary))
    got = Counter((r["doc_id"], r["n_words"], r["n_tokens"]) for r in token_counts(frame(spark, rows), BPE).collect())
    want = Counter()
    for i, text in rows:
        w = WORD.findall((text or "").encode())
        n = Counter(w)
        want[(i, len(w), sum(k * greedy(b" " + x, vocabulary, longest) for x, k in n.items()))] += 1
    assert got == want


def test_automaton_on_a_tricky_vocabulary():
    letters = [bytes([b]) for b in range(256)]
    vocabulary = letters + [b" a", b" abcd", b"bc", b"cde", b"bcdx", b"dd", b"ddd", b" abc"]
    automaton = build(vocabulary)
    texts = ["abcdx", "abcde", "abcddd", "bcdde", "a", "dddddddd", "abcdabcd", "zz"]
    got = automaton.count(words(pa.array([" ".join(texts)])))
    assert got.tolist() == [greedy(b" " + t.encode(), set(vocabulary), 6) for t in texts]
    with pytest.raises(ValueError):
        build([b"a", b"ab"])


def test_scores_match_brute_force_base(spark):
    rows = [*EDGES, *[(r["doc_id"] + 100, r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]]
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows}
    held[None] = False
    tokens = [[*WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}).encode()), b"\n"] for _, t in rows]
    count = Counter(w for (i, _), ws in zip(rows, tokens) if not held[i] for w in ws)
    n, v = sum(count.values()), len(count)
    want = Counter((i, held[i], len(ws), sum(w in count for w in ws), n, round(sum(math.log10((count.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 4)) for (i, _), ws in zip(rows, tokens))
    got = score_texts(frame(spark, rows), fold(5) == 1).collect()
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == want
    assert all(r["score"] < 0 for r in got)
    new = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in new) > sum(r["base_score"] for r in new)


def test_passages_of_ordinary_words_are_recognised(spark):
    rng = np.random.default_rng(4)
    word = lambda: f"w{rng.integers(0, 20_000)}"
    passage = " ".join(f"rare{k}" for k in range(30))  # each word far below one in 5,000 tokens
    rows = [(k, " ".join(word() for _ in range(1000))) for k in range(60)]
    rows += [(100 + k, passage) for k in range(6)] + [(200, passage), (201, " ".join(reversed(passage.split())))]
    got = {r["doc_id"]: r for r in score_texts(frame(spark, rows), F.col("doc_id") >= 200).collect()}
    assert got[200]["base_score"] == pytest.approx(got[201]["base_score"])
    assert got[200]["score"] > 0.5 * got[200]["base_score"]
    assert got[200]["score"] > got[201]["score"] + 30


def test_scores_without_training_texts(spark):
    assert score_texts(frame(spark, []), fold(5) == 1).count() == 0
    got = score_texts(frame(spark, EDGES[:6]), F.lit(True)).collect()
    assert len(got) == 6 and all(r["train_tokens"] == 0 and math.isfinite(r["score"]) for r in got)


class Tree:
    """The tree of a few texts in memory: counts by context, kept contexts, and the probability of any token after any context."""

    def __init__(self, texts, depth=3, least=2):
        self.tokens = Counter(t for text in texts for t in text)
        self.own = {t for t, c in self.tokens.items() if c >= least} | {"\n"}
        rest = [c for t, c in self.tokens.items() if t not in self.own]
        self.n, self.other, self.kinds, self.symbols = sum(self.tokens.values()), sum(rest), len(rest), len(self.own) + 1
        self.next = {}
        for text in texts:
            s = ["<"] + [self.symbol(t) for t in text]
            for at in range(1, len(s)):
                for d in range(1, min(depth, at) + 1):
                    self.next.setdefault(tuple(s[at - d : at]), Counter())[s[at]] += 1
        self.kept = set()
        for context in sorted(self.next, key=len):
            seen, total = self.next[context], sum(self.next[context].values())
            gain = sum(c / total * math.log(self.smoothed(context, x) / self.prob(context[1:], x)) for x, c in seen.items())
            if total >= least and gain >= DIVERGENCE and gain * total >= EVIDENCE:
                self.kept.add(context)

    def symbol(self, t):
        return t if t in self.own else None

    def smoothed(self, context, x):
        seen = self.next[context]
        return (seen[x] + SMOOTHING * self.prob(context[1:], x)) / (sum(seen.values()) + SMOOTHING)

    def prob(self, context, x):
        if not context:
            return ((self.other if x is None else self.tokens[x]) + 0.5) / (self.n + 0.5 * self.symbols)
        return self.smoothed(context, x) if context in self.kept else self.prob(context[1:], x)

    def token(self, context, t):
        p = self.prob(context, self.symbol(t))
        if t in self.own or not self.other:
            return p
        c = self.tokens[t]
        return p * (max(c - DISCOUNT, 1e-9) if c else DISCOUNT * self.kinds) / self.other

    def score(self, text, depth=3):
        s = ["<"] + [self.symbol(t) for t in text]
        return sum(math.log10(self.token(tuple(s[max(0, k + 1 - depth) : k + 1]), t)) for k, t in enumerate(text))


def test_scores_match_a_tree_in_memory(spark):
    rng = np.random.default_rng(1)

    def chain(n, back=2):
        """Words that depend on the last one and the one ``back`` places ago, but for one in ten."""
        x = rng.integers(0, 4, back).tolist()
        while len(x) < n + back:
            x.append((x[-1] + x[-back]) % 4 if rng.random() < 0.9 else int(rng.integers(0, 4)))
        return [f"{'abcd'[back]}{v}" if rng.random() < 0.98 else f"w{rng.integers(0, 60)}" for v in x[back:]]

    passage = [f"rare{k}" for k in range(12)]
    rows = [(k, " ".join(chain(int(rng.integers(1, 120)), 2 + k % 2))) for k in range(80)] + [(100 + k, " ".join(passage * (1 + k % 2))) for k in range(20)]
    rows += [(200, " ".join(passage)), (201, "never met words"), (202, " ".join(chain(300))), (203, ""), (204, None), (50, "once only words c1 c2 c3")]
    text = {i: [*(t or "").split(), "\n"] for i, t in rows if i >= 200}
    tree = Tree([[*(t or "").split(), "\n"] for i, t in rows if i < 200])
    assert {len(c) for c in tree.kept} == {1, 2, 3}
    for context in [*tree.kept, ("<",), ()]:  # over the training tokens and one unknown token
        assert sum(tree.token(context, t) for t in [*tree.tokens, "unknown"]) == pytest.approx(1, abs=1e-6)
    got = {r["doc_id"]: r["score"] for r in score_texts(frame(spark, rows), F.col("doc_id") >= 200).collect()}
    for i, t in text.items():
        assert got[i] == pytest.approx(tree.score(t), rel=1e-4)


def test_vocabulary_bytes_are_complete():
    with open(BPE, encoding="utf-8") as f:
        size = len(json.load(f)["model"]["vocab"])
    pieces = byte_vocabulary(BPE)
    assert size - len(pieces) <= 1 and {bytes([b]) for b in range(256)} <= set(pieces)
