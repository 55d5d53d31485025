"""Mixing sources to target weights by proportionate fair scheduling, with DataFrame functions only.

The rows of each source form blocks of ``block_rows``. Weights are whole quanta of one cycle of slots.
The j-th block of a source with weight w is released at slot floor((j - 1) / w) and due by slot ceil(j / w); each slot takes, of
the blocks released, the one due first (ties: larger weight, then name). In every prefix of the sequence each source then
deviates from its exact share by less than one block. The schedule repeats after one cycle, so one cycle is computed, a table
of as many rows as there are quanta, and each block finds its slot by arithmetic. A source that has run out leaves its
slots empty and the others keep their proportions. No row is lost or repeated.

Within a source, rows stand in the order of a digest of their ids, that is, shuffled. They are numbered without gathering the
source: parts of the digest's range, alike in size, are numbered apart and shifted by the counts of the parts before.

Edge cases. A null source is the source named ''. A source without a weight shares the least quantum, 1. Rows that repeat an
id are ordered by a digest of the row's text; equal rows are interchangeable. A null id counts as ''. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Documents in a block, and the slots of a cycle that whole weights add up to (about).
BLOCK_ROWS, QUANTA = 16, 400
#: Exponent of the default weights: source size to this power, so that small sources gain and large ones lose.
TEMPER = 0.5
#: Rows that are numbered together, about.
PART_ROWS = 1 << 16


def target_quanta(sizes: DataFrame, weights: Mapping[str, float] | None = None, quanta: int = QUANTA, temper: float = TEMPER) -> DataFrame:
    """(source, n_rows, quanta): whole weights of at least 1 that add up to about ``quanta``.

    ``weights`` names the shares of sources; without it a source of n rows weighs n ** temper.
    """
    if weights is None:
        weight = F.pow(F.col("n_rows").cast("double"), F.lit(temper))
    else:
        given = F.create_map(*[F.lit(x) for pair in weights.items() for x in (pair[0], float(pair[1]))]) if weights else F.create_map()
        weight = F.coalesce(F.try_element_at(given, F.col("source")), F.lit(0.0)) if weights else F.lit(0.0)
    total = sizes.select(weight.alias("w")).agg(F.sum("w").alias("total"))
    share = F.when(F.col("total") > 0, F.col("w") / F.col("total")).otherwise(0.0)
    return sizes.withColumn("w", weight).join(F.broadcast(total)).select("source", "n_rows", F.greatest(F.round(share * quanta), F.lit(1)).cast("int").alias("quanta"))


def cycle(targets: DataFrame) -> DataFrame:
    """One cycle of the schedule: (source, quanta, turn, slot, length); ``turn`` counts the source's blocks from 0.

    It has a row for each slot, about as many as there are quanta, whatever the size of the data.
    """
    one = targets.agg(F.array_sort(F.collect_list(F.struct("source", "n_rows", "quanta"))).alias("sources"))
    one = one.filter(F.size("sources") > 0).withColumn("length", F.aggregate("sources", F.lit(0), lambda a, s: a + s["quanta"]))
    ids = F.sequence(F.lit(0), F.size("sources") - 1)

    def due(k, done):
        """Of source k: (due, minus weight, k) of its next block if that is released, else null."""
        quanta = F.get("sources", k)["quanta"]
        return lambda slot, length: F.when(
            F.floor(F.get(done, k) * length / quanta) <= slot,
            F.struct(F.ceil((F.get(done, k) + 1) * length / quanta).alias("due"), F.negative(quanta).alias("minus"), k.alias("k")))

    def step(state, slot):
        first = F.array_min(F.transform(ids, lambda k: due(k, state["done"])(slot, F.col("length"))))
        chosen = F.coalesce(first["k"], F.lit(-1))
        after = F.transform(state["done"], lambda x, i: F.when(i == chosen, x + 1).otherwise(x))
        row = F.struct(slot.alias("slot"), chosen.alias("k"), F.get(state["done"], chosen).alias("turn"))
        return F.struct(after.alias("done"), F.concat(state["rows"], F.array(row)).alias("rows"))

    nothing = F.expr("cast(array() as array<struct<slot:int,k:int,turn:int>>)")
    start = F.struct(F.transform("sources", lambda s: F.lit(0)).alias("done"), nothing.alias("rows"))
    rows = F.aggregate(F.sequence(F.lit(0), F.col("length") - 1), start, step)["rows"]
    slots = one.select("sources", "length", F.inline(rows)).filter("k >= 0")
    source = F.get("sources", F.col("k"))
    return slots.select(source["source"].alias("source"), source["quanta"].alias("quanta"), "turn", "slot", "length")


def _numbered(docs: DataFrame, part_rows: int) -> DataFrame:
    """``docs`` with place, from 0, within mix_source in the order of mix_key, mix_id, mix_tie."""
    bits = min(16, max(0, (docs.count() // part_rows).bit_length()))
    part = F.shiftright(F.conv(F.substring("mix_key", 1, 4), 16, 10).cast("int"), 16 - bits)
    docs = docs.withColumn("mix_part", part)
    counts = docs.groupBy("mix_source", "mix_part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("mix_source").orderBy("mix_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select("mix_source", "mix_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("mix_shift"))
    inside = Window.partitionBy("mix_source", "mix_part").orderBy("mix_key", F.col("mix_id").asc_nulls_first(), "mix_tie")
    docs = docs.withColumn("mix_inside", F.row_number().over(inside) - 1)
    return docs.join(shift, ["mix_source", "mix_part"]).withColumn("mix_place", F.col("mix_shift") + F.col("mix_inside")).drop("mix_part", "mix_shift", "mix_inside")


def mix_sources(docs: DataFrame, weights: Mapping[str, float] | None = None, block_rows: int = BLOCK_ROWS, quanta: int = QUANTA, temper: float = TEMPER, part_rows: int = PART_ROWS) -> DataFrame:
    """The columns of ``docs`` (doc_id, text, source among them) with mix_block, mix_slot and mix_offset.

    Sorted by mix_slot, mix_offset the rows are the mixture: mix_slot is the place of the block of ``block_rows`` rows,
    mix_offset that of the row in its block, mix_block the number of the block in its source. Columns of these names are
    replaced.
    """
    docs = docs.drop("mix_block", "mix_slot", "mix_offset")
    # The row travels as one column, so none of its names can clash.
    keyed = docs.select(
        F.struct("*").alias("mix_row"), F.col("doc_id").alias("mix_id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("mix_source"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("mix_key"),
        F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")).alias("mix_tie"))
    sizes = docs.groupBy(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source")).agg(F.count("*").alias("n_rows"))
    slots = cycle(target_quanta(sizes, weights, quanta, temper)).withColumnRenamed("source", "mix_source")
    placed = _numbered(keyed, part_rows)
    share = slots.groupBy("mix_source").agg(F.max("quanta").alias("mix_quanta"))
    block = F.floor(F.col("mix_place") / block_rows)
    placed = placed.join(share, "mix_source").withColumns({"mix_block": block, "mix_offset": (F.col("mix_place") % block_rows).cast("int"), "turn": (block % F.col("mix_quanta")).cast("int")})
    placed = placed.join(slots, ["mix_source", "turn"])
    slot = F.floor(F.col("mix_block") / F.col("mix_quanta")) * F.col("length") + F.col("slot")
    return placed.select("mix_row.*", "mix_block", slot.alias("mix_slot"), "mix_offset")
