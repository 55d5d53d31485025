"""Fuzzy duplicates: values of a text column that are similar but not equal.

Similarity is ``100 * (1 - edits / letters of the longer value)``, with the edit distance of Levenshtein. A longer value of
``l`` letters may differ by ``k`` edits, which threshold and length give. It is cut into ``k + 1`` segments, so a value within
``k`` edits of it holds at least one segment unchanged, shifted by at most ``k`` letters. Segments are joined by hash and rough
place with the substrings of values that are as long or shorter; place, length and hashed letter pairs rule out most of the
candidates, the rest are verified where they meet, so that only similar pairs are shuffled, and no two values without a common
segment ever meet. A run of common segments at one shift is verified at its first. A segment that many values share is dealt to
several tasks. Only the list of such segments is broadcast, one of ``HOT`` segments at most. Pairs whose longer value allows few
edits, as names and addresses do, are many to a segment and are verified in NumPy (``fuzzy_blocks``), under keys of exact length.

Values are counted first, so repeated rows cost nothing. The work grows with the letters of all distinct values: columns of names,
addresses or titles suit it.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import strip
from ..functions.types import col, is_text, require_columns, text_columns
from ..plans.fused import empty, union_all
from ..sources.shared import shared_folder
from .fuzzy_blocks import MOST, WIDEST, pairs_of_blocks, with_sets

HOT = 4_000  # values that share a segment, in one task; a sort-merge join keeps 4,096 rows of a key at hand
_PAIRS = "value_a string, value_b string, rows_a bigint, rows_b bigint, distance int, similarity double"


def _long(expr: str) -> Column:
    return F.expr(expr).cast("bigint")


def _normal(value: Column) -> Column:
    return F.lower(F.regexp_replace(strip(value), r"(?U)\s+", " "))


def _letter_pairs(value: str, seed: int) -> Column:
    """64 bits, one set for each hashed pair of neighbouring letters."""
    return F.expr(
        f"aggregate(transform(sequence(1, greatest(length({value}) - 1, 1)), i -> shiftleft(1L, cast(pmod(xxhash64(substring({value}, i, 2), {seed}), 64) as int))), "
        "0L, (x, y) -> x | y)")


def _shortest(slack: int) -> int:
    """Letters of the longest value whose pairs are verified in blocks."""
    return min(WIDEST, (10_000 * (MOST + 1) - 1) // max(slack, 1))


def _dealt(cut: DataFrame, held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with a number, so that one task meets at most about ``HOT`` cut values of a key."""
    hot = F.broadcast(cut.groupBy("key").agg(F.ceil(F.count("*") / F.lit(HOT)).cast("int").alias("parts")).filter("parts > 1"))
    cut = cut.join(hot, "key", "left").withColumn("salt", F.expr("if(parts is null, 0, cast(pmod(xxhash64(id), parts) as int))")).drop("parts")
    return cut, held.join(hot, "key", "left").withColumn("salt", F.explode(F.expr("sequence(0, coalesce(parts, 1) - 1)"))).drop("parts")


def _short_rows(values: DataFrame, slack: int, shortest: int, tasks: int) -> DataFrame:
    """Segments of values of at most ``shortest`` letters, and the substrings of others that may equal them, sorted by key.

    With k edits and k + 1 segments there is an unchanged segment that as many edits precede as segments stand before it, so at most as
    many follow as segments stand behind it. Both numbers bound its shift.
    """
    edits = lambda n: f"(({n}) * {slack} div 10000)"
    known = values.filter("sets is not null").selectExpr("id", "normal", "nullif(value, normal) as shown", "rows", "cast(length(normal) as bigint) as n", "sets")
    bounds = "greatest(i - 1, 0L) * {n} div (k + 1) as last", "i * {n} div (k + 1) as at", "(i + 1) * {n} div (k + 1) as upto"
    text = lambda at, size: f"xxhash64(substring(normal, cast({at} + 1 as int), cast({size} as int)))"
    kept = ("id", "normal", "shown", "rows", "n", "sets")
    cut = known.withColumn("k", _long(edits("n"))).filter("k > 0").withColumn("i", F.explode(F.expr("sequence(0L, k)")))
    cut = cut.selectExpr(*kept, "k", "i", *(b.format(n="n") for b in bounds))
    cut = cut.selectExpr(*kept, "i as spot", f"if(i = 0, 0L, {text('last', 'at - last')}) as back", f"xxhash64({text('at', 'upto - at')}, n, i) as key")
    held = known.withColumn("l", F.explode(F.expr(f"sequence(n, least(n * 10000 div {10000 - slack}, {shortest}L))"))).withColumn("k", _long(edits("l"))).filter("k > 0")
    held = held.withColumn("i", F.explode(F.expr("sequence(0L, k)"))).selectExpr(*kept, "l", "k", "i", *(b.format(n="l") for b in bounds))
    low, high = "greatest(at - i, at + n - l - (k - i), 0L)", "least(at + i, at + n - l + (k - i), n - (upto - at))"
    held = held.filter(f"{low} <= {high}").withColumn("place", F.explode(F.expr(f"sequence({low}, {high})")))
    # where the segment before is common too, at a shift allowed to it, the pair has met there
    held = held.selectExpr(
        *kept, "place as spot", f"if(i > 0 and place >= at - last and abs(place - at) < i, {text('place - (at - last)', 'at - last')}, 1L) as back",
        f"xxhash64({text('place', 'upto - at')}, l, i) as key")
    cut, held = _dealt(cut, held)
    rows = cut.withColumn("side", F.lit(0)).unionByName(held.withColumn("side", F.lit(1)))
    return rows.repartition(tasks, "key", "salt").sortWithinPartitions("key", "salt", "side")


def _long_pairs(values: DataFrame, slack: int, shortest: int) -> DataFrame:
    """Pairs (long, short, distance) of ids that lie within the edits that the longer one, of more than ``shortest`` letters, allows.

    ``slack`` is the allowed share of edits in 1/10000.
    """
    edits = lambda n: f"(({n}) * {slack} div 10000)"
    known = values.select("id", "normal", _long("length(normal)").alias("n"), _letter_pairs("normal", 1).alias("s1"), _letter_pairs("normal", 2).alias("s2"))
    # lengths from 2^size on share a grid of places
    width = "shiftleft(1L, greatest(size - 4, 3))"
    cut = known.filter(f"n > {shortest}").withColumn("k", _long(edits("n"))).filter("k > 0").withColumn("size", F.expr("length(bin(n))"))
    cut = cut.withColumn("segment", F.explode(F.expr("transform(sequence(0L, k), i -> struct(greatest(i - 1, 0L) * n div (k + 1) as last, i * n div (k + 1) as at, (i + 1) * n div (k + 1) as upto))")))
    cut = cut.selectExpr(
        "id", "normal", "n", "k", "s1", "s2", "segment.at as at", "cast(segment.at - segment.last as int) as back",
        f"xxhash64(xxhash64(substring(normal, cast(segment.at + 1 as int), cast(segment.upto - segment.at as int))), size, segment.at div {width}) as key")
    reach = f"(n * 10000 div {10000 - slack})"  # the longest value that may match
    held = known.withColumn("longest", _long(reach)).filter(f"longest > {shortest} and {edits('longest')} > 0")
    held = held.withColumn("size", F.explode(F.expr("sequence(length(bin(n)), length(bin(longest)))")))
    held = held.withColumn("least", F.expr(f"greatest(n, shiftleft(1L, size - 1), {shortest + 1}L)")).withColumn("most", F.expr("least(longest, shiftleft(1L, size) - 1)")).filter("least <= most")
    held = held.withColumn("shift", _long(edits("most"))).filter("shift > 0")
    parts = f"flatten(transform(sequence(least, most), l -> array(l div ({edits('l')} + 1), (l + {edits('l')}) div ({edits('l')} + 1))))"
    held = held.withColumn("part", F.explode(F.array_distinct(F.expr(parts)))).filter("part <= n and part > 0")
    held = held.withColumn("at", F.explode(F.expr("sequence(0L, n - part)")))
    held = held.withColumn("gram", F.expr("xxhash64(substring(normal, cast(at + 1 as int), cast(part as int)))"))
    held = held.withColumn("place", F.explode(F.expr(f"sequence(greatest(at - shift, 0L) div {width}, (at + shift) div {width})")))
    held = held.selectExpr("id", "normal", "n", "s1", "s2", "at", "xxhash64(gram, size, place) as key")
    cut, held = _dealt(cut, held)
    a, b = cut.alias("a"), held.alias("b")
    near = F.expr(
        "a.key = b.key and a.salt = b.salt and (b.n < a.n or (b.n = a.n and b.id < a.id)) and a.n - b.n <= a.k "
        "and abs(a.at - b.at) + abs((a.n - a.at) - (b.n - b.at)) <= a.k "
        # an edit changes at most two pairs of letters of either value
        "and bit_count(a.s1 & ~b.s1) <= 2 * a.k and bit_count(b.s1 & ~a.s1) <= 2 * a.k "
        "and bit_count(a.s2 & ~b.s2) <= 2 * a.k and bit_count(b.s2 & ~a.s2) <= 2 * a.k "
        # where the segment before is common too, the pair has met there
        "and (a.back = 0 or b.at < a.back or substring(a.normal, cast(a.at - a.back + 1 as int), a.back) <> substring(b.normal, cast(b.at - a.back + 1 as int), a.back)) "
        "and levenshtein(b.normal, a.normal, cast(a.k as int)) >= 0")
    # The right side of the join is the one whose rows of a key are bounded. Spark takes each side for as small as the values' files.
    return b.join(a.hint("merge"), near).selectExpr("a.id as long", "b.id as short", "levenshtein(b.normal, a.normal, cast(a.k as int)) as distance").distinct()


def fuzzy_duplicates(df: DataFrame, column: str, threshold: float = 90.0, normalise: bool = True) -> DataFrame:
    """Pairs of different values of a text column with a similarity of at least ``threshold`` percent.

    With ``normalise``, values are compared without outer space, with runs of white space as one space and in lower case. Spellings
    that are then equal are one value, shown by its most frequent spelling (the smallest on a tie); each other spelling is paired
    with that one at 100 %. Missing and blank values take no part. ``rows_a`` and ``rows_b`` count the rows of a value.
    """
    require_columns(df, [column])
    if not is_text(df, column):
        raise ValueError(f"'{column}' is not a text column")
    slack = 10_000 - round(threshold * 100)
    if not 0 <= slack < 10_000:
        raise ValueError("threshold must be above 0 and at most 100")
    shortest = _shortest(slack)
    spelled = df.select(col(column).alias("spelling")).filter(F.col("spelling").isNotNull()).groupBy("spelling").agg(F.count("*").alias("n"))
    spelled = spelled.withColumn("normal", _normal(F.col("spelling")) if normalise else F.col("spelling")).filter(F.trim("normal") != "")
    best = F.min(F.struct((-F.col("n")).alias("minus_n"), F.col("spelling").alias("spelling"))).alias("best")
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # as many files, as each value makes hundreds of rows
    values = spelled.repartition(tasks, "normal").groupBy("normal").agg(best, F.sum("n").alias("rows"), F.count("*").alias("spellings"))
    values = values.select(F.monotonically_increasing_id().alias("id"), "normal", F.col("best.spelling").alias("value"), -F.col("best.minus_n"), "rows", "spellings").toDF(
        "id", "normal", "value", "own_rows", "rows", "spellings")
    values = values.mapInArrow(with_sets(shortest), T.StructType([*values.schema.fields, T.StructField("sets", T.BinaryType())]))
    path = f"{shared_folder(df.sparkSession)}/fuzzy-{uuid.uuid4().hex}"  # ids must be the same in every use
    values.write.parquet(path)
    values = df.sparkSession.read.schema(values.schema).parquet(path)
    # merged: well-packed files of many values look small, but would fill the driver in a broadcast
    side = lambda name: values.select(F.col("id").alias(name), F.struct("value", "rows", F.length("normal").alias("n")).alias(f"{name}_v")).hint("merge")
    pairs = _long_pairs(values, slack, shortest).join(side("short"), "short").join(side("long"), "long")
    similarity = 100.0 - 100.0 * F.col("distance") / F.col("long_v.n")
    swap = F.col("short_v.value") <= F.col("long_v.value")
    first, last = (F.when(swap, F.col(x)).otherwise(F.col(y)) for x, y in (("short_v", "long_v"), ("long_v", "short_v")))
    similar = pairs.select(first.alias("a"), last.alias("b"), "distance", similarity.alias("similarity")).select(
        F.col("a.value").alias("value_a"), F.col("b.value").alias("value_b"), F.col("a.rows").alias("rows_a"), F.col("b.rows").alias("rows_b"), "distance", "similarity")
    similar = similar.unionByName(_short_rows(values, slack, shortest, tasks).mapInArrow(pairs_of_blocks(slack, shortest), _PAIRS))
    if not normalise:
        return similar
    several = values.filter("spellings > 1").select("normal", F.col("value").alias("value_a"), F.col("own_rows").alias("rows_a")).hint("merge")
    same = spelled.join(several, "normal").filter("spelling <> value_a").select(
        "value_a", F.col("spelling").alias("value_b"), "rows_a", F.col("n").alias("rows_b"), F.lit(0).alias("distance"), F.lit(100.0).alias("similarity"))
    return similar.unionByName(same)


def fuzzy_report(df: DataFrame, columns: Sequence[str] | None = None, threshold: float = 90.0, normalise: bool = True) -> DataFrame:
    """One row per text column: similar pairs, the values in them, and the largest similarity below equality."""
    names = text_columns(df, columns)
    schema = "column string, n_pairs bigint, n_values bigint, n_spellings bigint, max_similarity double"
    if not names:
        return empty(df, schema)
    found = union_all([fuzzy_duplicates(df, c, threshold, normalise).withColumn("column", F.lit(c)) for c in names])
    # both ends of a pair are counted by value, so that the pairs are found once
    ends = found.select("column", F.explode(F.array("value_a", "value_b")).alias("value"), "distance", "similarity").groupBy("column", "value").agg(
        F.count_if(F.col("distance") > 0).alias("pairs"), F.count_if(F.col("distance") == 0).alias("spellings"),
        F.max(F.when(F.col("distance") > 0, F.col("similarity"))).alias("similarity"))
    return ends.groupBy("column").agg(
        F.expr("sum(pairs) div 2").alias("n_pairs"), F.count_if(F.col("pairs") > 0).alias("n_values"), F.expr("sum(spellings) div 2").alias("n_spellings"), F.max("similarity").alias("max_similarity"))


def fuzzy_samples(df: DataFrame, column: str, key: str, threshold: float = 90.0, k: int = 5, normalise: bool = True) -> DataFrame:
    """The ``k`` most similar pairs, each value with the smallest ``key`` of the rows that have its spelling."""
    require_columns(df, [key])
    top = fuzzy_duplicates(df, column, threshold, normalise).orderBy(F.desc("similarity"), "value_a", "value_b").limit(k)
    first = df.groupBy(col(column).alias("value")).agg(F.min(col(key)).alias("key"))
    for side in ("a", "b"):
        top = top.join(first.select(F.col("value").alias(f"value_{side}"), F.col("key").alias(f"key_{side}")), f"value_{side}")
    return top.select("key_a", "value_a", "key_b", "value_b", "distance", "similarity")
