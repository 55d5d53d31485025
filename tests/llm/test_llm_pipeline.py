"""The pipeline, stage by stage, against brute force on documents with planted cases."""

import random

import public_tokenizers
from pyspark.sql import functions as F
from test_llm_pairs import brute_groups, brute_placements

import corpus_pipeline
from cleanframe.llm.mixing import mix_sources

SMALL = "/root/testdata/sf0.001"
COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, met_id bigint, slot int"


def planted(spark, folder):
    """Real documents with copies, near copies, benchmark passages, texts without letters, nulls and clashing columns."""
    rng = random.Random(4)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect() if r["doc_id"] < 60]
    for k in range(5):
        words = rows[k][1].split()
        words[rng.randrange(len(words))] = "changed"
        rows.append((1000 + k, " ".join(words), rows[k][2], None))
        rows.append((1100 + k, rows[k][1], None, "src1"))
        rows.append((1200 + k, f"{rows[20 + k][1]}\n{items[k][1]}\n{rows[30 + k][1]}", rows[20 + k][2], "src2"))
    rows += [(1300, None, "en", "src1"), (1301, "", "en", "src1"), (1302, "12 34 ## !!", None, None), (None, "The words of a document that has no id at all, and of the other.", "en", None)]
    docs = spark.createDataFrame([(*r, len(r[1] or ""), 0.5, 1, 2) for r in rows], COLUMNS)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, items


def test_stages_do_what_brute_force_does(spark, tmp_path):
    from tokenizers import Tokenizer

    folder = str(tmp_path)
    rows, items = planted(spark, folder)
    text = {i: t for i, t, *_ in rows}
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{folder}/{name}")
        after = spark.read.parquet(f"{folder}/{name}")
        if name != "token_files":
            assert sorted(after.dtypes) == sorted(docs.dtypes)
            assert after.agg(F.min("score"), F.max("score"), F.sum("slot")).first()[:] == (0.5, 0.5, 2 * after.count())
        kept[name] = [r["doc_id"] for r in after.collect()]
        docs, before = after, docs

    assert set(kept["language"]) == set(text) - {1300, 1301, 1302}
    groups = brute_groups([(i, text[i]) for i in kept["language"]])
    assert sorted(i for i in kept["near_duplicates"] if i is not None) == sorted(i for (i, _, least), _ in groups.items() if i is not None and i == least)
    bad = {i for i, _ in brute_placements([(i, text[i]) for i in kept["near_duplicates"]], items)}
    assert bad >= {1200, 1201, 1202, 1203, 1204} & set(kept["near_duplicates"]) and len(bad) >= 3
    assert set(kept["decontamination"]) == set(kept["near_duplicates"]) - bad
    cleaned = spark.read.parquet(f"{folder}/decontamination")
    order = [r["doc_id"] for r in mix_sources(cleaned).orderBy("mix_slot", "mix_offset").collect()]
    assert sorted(order, key=str) == sorted(kept["decontamination"], key=str)
    tokens = docs.orderBy("start").collect()
    assert [r["doc_id"] for r in tokens] == order
    tokenizer = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    assert [r["n_tokens"] for r in tokens] == [len(tokenizer.encode(text[i], add_special_tokens=False).ids) + 1 for i in order]


def test_stages_on_an_empty_table(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([], COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0
