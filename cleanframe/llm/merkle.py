"""Document fingerprints as Merkle trees, with DataFrame functions only.

A text's paragraphs are its lines. The leaves are the pieces of the paragraphs: sentences, cut at 120 letters. A leaf's node is
the SHA-256 of its letters, a paragraph's that of its leaves' nodes. A section is a run of paragraphs that ends after an empty
one, or after one whose node begins with 0 or 1 (one in eight), so that an edit moves no other section's borders; its node is
the SHA-256 of its paragraphs' nodes, and the root that of its sections' nodes. Equal roots mean equal texts, and where
roots differ, the differing sections, paragraphs and leaves locate the edit.

The likeness of two fingerprints compares the leaves of their trees as multisets: twice the letters in leaves that both have, over
the letters of both. A leaf met twice in one tree and once in the other is shared once.

Edge cases. A null text is the empty text, which has one empty paragraph and no leaf. Two texts without a leaf have likeness 1 if
they are equal, else 0; one without and one with leaves have 0. Each step is linear in the text but for a sort of its leaves, so
very long texts are not special. Rows that repeat an id stand in the order of their texts' digests; a null id is the lowest.
Only doc_id and text are read, so other columns do not matter. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Leaves: up to 120 letters, ending at a sentence end or a line end.
PIECE = r"[^.!?\n]{1,120}[.!?\n]*|[.!?\n]+"
SECTION_ENDS = "01"


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def leaf_nodes(text: Column) -> Column:
    """(node, letters) of the leaves of each line, in order."""
    leaf = lambda x: F.struct(F.sha2(x.cast("binary"), 256).alias("node"), F.length(x).alias("letters"))
    return F.transform(F.split(_text(text), "\n", -1), lambda p: F.transform(F.regexp_extract_all(p, F.lit(PIECE), F.lit(0)), leaf))


def _digest(nodes: Column) -> Column:
    return F.sha2(F.array_join(nodes["node"], "").cast("binary"), 256)


def paragraph_nodes(leaves: Column) -> Column:
    """(node, leaves) of each line: its digest and how many leaves it has."""
    return F.transform(leaves, lambda p: F.struct(_digest(p).alias("node"), F.size(p).alias("leaves")))


def section_ends(paragraphs: Column) -> Column:
    """Numbers, from 0, of the paragraphs that end a section."""
    last = F.size(paragraphs) - 1

    def ends(k):
        p = F.get(paragraphs, k)
        return F.substring(p["node"], 1, 1).isin(*SECTION_ENDS) | (p["leaves"] == 0)

    return F.array_union(F.filter(F.sequence(F.lit(0), last), ends), F.array(last))


def section_nodes(paragraphs: Column, ends: Column) -> Column:
    """(node, paragraphs) of each section; both arguments are columns of a table, so that no section computes them anew."""

    def section(end, k):
        begin = F.coalesce(F.get(ends, k - 1), F.lit(-1)) + 1
        return F.struct(_digest(F.slice(paragraphs, begin + 1, end - begin + 1)).alias("node"), (end - begin + 1).alias("paragraphs"))

    return F.transform(ends, section)


def with_bag(docs: DataFrame, leaves: str, name: str) -> DataFrame:
    """``docs`` with a column ``name``, the multiset of a tree's leaves: each as letters, digest and its number among equal ones.

    Equal leaves stand together in sorted order, and are numbered from where they begin.
    """
    text = F.transform(F.flatten(leaves), lambda x: F.concat_ws(":", x["letters"].cast("string"), x["node"]))
    docs = docs.withColumn(f"{name}_sorted", F.array_sort(text))
    s = F.col(f"{name}_sorted")
    new = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: (k == 0) | (F.get(s, k) != F.get(s, k - 1)))
    docs = docs.withColumn(f"{name}_new", F.when(F.size(s) > 0, new).otherwise(F.expr("cast(array() as array<int>)")))
    first = F.col(f"{name}_new")

    def equal(begin, k):
        count = F.coalesce(F.get(first, k + 1), F.size(s)) - begin
        return F.transform(F.sequence(F.lit(1), count), lambda j: F.concat_ws(":", F.get(s, begin), j.cast("string")))

    return docs.withColumn(name, F.flatten(F.transform(first, equal))).drop(f"{name}_sorted", f"{name}_new")


def _letters(bag: Column) -> Column:
    return F.aggregate(bag, F.lit(0).cast("bigint"), lambda a, x: a + F.substring_index(x, ":", 1).cast("bigint"))


def likeness(a: Column, b: Column, equal: Column) -> Column:
    """0 to 1, from the leaves of two trees; ``equal`` decides where neither has any."""
    both, total = _letters(F.array_intersect(a, b)), _letters(a) + _letters(b)
    return F.when(total > 0, 2.0 * both / total).otherwise(F.when(equal, F.lit(1.0)).otherwise(F.lit(0.0)))


def with_tree(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with the tree of a text column: leaves (as a multiset), paragraphs, sections and fingerprint (the root)."""
    names = {x: f"{prefix}{x}" for x in ("nodes", "paragraphs", "ends", "sections", "fingerprint", "leaves")}
    docs = docs.withColumn(names["nodes"], leaf_nodes(F.col(text)))
    docs = docs.withColumn(names["paragraphs"], paragraph_nodes(F.col(names["nodes"])))
    docs = docs.withColumn(names["ends"], section_ends(F.col(names["paragraphs"])))
    docs = docs.withColumn(names["sections"], section_nodes(F.col(names["paragraphs"]), F.col(names["ends"])))
    docs = docs.withColumn(names["fingerprint"], _digest(F.col(names["sections"])))
    return with_bag(docs, names["nodes"], names["leaves"]).drop(names["nodes"], names["ends"])


def first_difference(a: Column, b: Column) -> Column:
    """Number, from 0, of the first paragraph in which two trees differ; null if they are equal."""
    nodes = [F.transform(x, lambda p: p["node"]) for x in (a, b)]
    differs = F.zip_with(*nodes, lambda x, y: ~x.eqNullSafe(y))
    return F.nullif(F.array_position(differs, True), F.lit(0).cast("bigint")) - 1


def changed_sections(a: Column, b: Column) -> Column:
    """How many sections of b are not in a."""
    return F.size(F.array_except(F.transform(b, lambda s: s["node"]), F.transform(a, lambda s: s["node"])))


def _range_of(key: Column, edges: list[int]) -> Column:
    """How many of the sorted edges are at most the key: a binary search, so a row costs the logarithm of their number."""
    borders, low, high = F.array(*[F.lit(e) for e in edges]), F.lit(0), F.lit(len(edges))

    def halve(s, _):
        mid = F.floor((s["low"] + s["high"]) / 2).cast("int")
        right = F.coalesce(F.get(borders, mid) <= key, F.lit(False)) & (s["low"] < s["high"])
        return F.struct(F.when(right, mid + 1).otherwise(s["low"]).alias("low"), F.when(right | (s["low"] >= s["high"]), s["high"]).otherwise(mid).alias("high"))

    start = F.struct(low.alias("low"), high.alias("high"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(len(edges).bit_length() + 1)), start, halve, lambda s: s["low"])


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, next_text): each text with that of the next document in descending order of id, the last with the first's.

    Documents are dealt into ranges of ids with one shuffle of the texts. The first document of each range also goes to the
    range before it (in descending order), so each range finds all its neighbours by itself.
    """
    ranges = min(8192, 16 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), _text(F.col("text")).alias("text"))
    keyed = docs.withColumns({"key": F.coalesce("doc_id", F.lit(-(2**63))), "tie": F.xxhash64("text")})
    cuts = keyed.agg(F.percentile_approx("key", [k / ranges for k in range(1, ranges)], 20 * ranges)).first()[0]
    keyed = keyed.withColumn("part", _range_of(F.col("key"), sorted(set(cuts or [0]))))
    heads = [(r["part"], *r["head"]) for r in keyed.groupBy("part").agg(F.max(F.struct("key", "tie")).alias("head")).collect()]  # a row for each range
    heads.sort()
    above = [heads[k + 1][0] for k in range(len(heads) - 1)] + [heads[0][0]] if heads else []
    extra = docs.sparkSession.createDataFrame([(h[1], h[2], to) for h, to in zip(heads, above)], "key bigint, tie bigint, above int")
    dealt = keyed.join(F.broadcast(extra), ["key", "tie"], "left")
    here = F.struct(F.col("part"), F.lit(0).alias("guest"))
    places = F.when(F.col("above").isNull(), F.array(here)).otherwise(F.array(here, F.struct(F.col("above").alias("part"), F.lit(1).alias("guest"))))
    dealt = dealt.select("doc_id", "key", "tie", "text", F.inline(places))
    order = Window.partitionBy("part").orderBy("guest", F.col("key").desc(), F.col("tie").desc())
    return dealt.withColumn("next_text", F.lead("text").over(order)).filter("guest = 0").select("doc_id", "text", "next_text")


def edit_report(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text: the last third replaced by the beginning of the next document.

    (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_sections, changed_sections,
    first_change): likeness of the fingerprint to that of the edited text and of the next document, and where the edit is.
    """
    rows = with_next(docs)
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", 1, n - third), F.substring("next_text", F.lit(1), third)))
    rows = with_tree(with_tree(rows), "edited", "edited_").withColumn("next_nodes", leaf_nodes(F.col("next_text")))
    rows = with_bag(rows, "next_nodes", "next_leaves")
    return rows.select(
        "doc_id", n.cast("bigint").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(F.col("leaves"), F.col("edited_leaves"), F.col("text") == F.col("edited")).alias("near_edited"),
        likeness(F.col("leaves"), F.col("next_leaves"), F.col("text") == F.col("next_text")).alias("near_next"),
        F.size("sections").alias("n_sections"), changed_sections(F.col("sections"), F.col("edited_sections")).alias("changed_sections"),
        first_difference(F.col("paragraphs"), F.col("edited_paragraphs")).alias("first_change"))
