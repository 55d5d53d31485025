"""Delimited text whose quotes hold line breaks, read in splits.

A line either leaves the reader between records or inside a quoted field, depending on how it was entered. Each split first tells, for
both ways to enter it, how it is left; the splits of a file are then chained, which gives the state each one starts in.
So a second pass starts every split at a true record: lines within a quoted field are put together there, and only a record that
crosses the edge of a split travels, in pieces, to be joined. A quote counts only where a field begins, so an inch mark
inside a value is a letter like any other.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_QUOTED = r'[^"]*+(?:""[^"]*+)*+'


def _patterns(sep: str) -> tuple[str, str]:
    """A line that ends inside a quoted field: when it begins a record, and when it begins inside a quoted field."""
    s = re.escape(sep) if sep != "\t" else r"\t"
    fields = rf'(?:(?:"{_QUOTED}"[^{s}]*+|[^"{s}][^{s}]*+|){s})*+'
    opened = rf'{fields}"{_QUOTED}'
    return opened, rf'{_QUOTED}(?:"[^{s}]*+{s}{opened})?+'


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their line ends cut at the line feed, the file and the start of the split."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select("value", F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def breaks_quotes(spark: SparkSession, path: str, sep: str) -> bool:
    """Whether any line, taken as the beginning of a record, ends inside a quoted field."""
    opened, _ = _patterns(sep)
    return not spark.read.text(path).filter(F.col("value").contains('"') & F.col("value").rlike(rf"\A{opened}\z")).isEmpty()


def _leaves(sep: str):
    """(file, start, from_record, from_quotes, closes): whether a split is left inside quotes, for both ways to enter it."""

    def run(batches):
        opened, still = (re.compile(p, re.S) for p in _patterns(sep))
        at, state = None, [False, True, False]

        def row():
            return pa.RecordBatch.from_pydict({"file": [at[0]], "start": [at[1]], "from_record": [state[0]], "from_quotes": [state[1]], "closes": [state[2]]})

        for batch in batches:
            for value, file, start in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if (file, start) != at:
                    if at:
                        yield row()
                    at, state = (file, start), [False, True, False]
                if value is None:  # no quote: the line is left as it was entered
                    continue
                if state[0] != state[1]:
                    inside = [bool((still if s else opened).fullmatch(value)) for s in state[:2]]
                else:
                    inside = [bool((still if state[0] else opened).fullmatch(value))] * 2
                state = [*inside, state[2] or not inside[1]]
        if at:
            yield row()

    return run


def _starts(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """Splits that start inside quotes: (file, start, opened), with the split in which that record began; and all that records cross.

    One row per split, so a file of 100 TB has fewer than a million; they are chained inside Spark, file by file.
    """
    quoted = _lines(spark, path).withColumn("value", F.when(F.col("value").contains('"'), F.col("value")))
    told = quoted.mapInArrow(_leaves(sep), "file bigint, start bigint, from_record boolean, from_quotes boolean, closes boolean")
    per_file = told.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("start", "from_record", "from_quotes", "closes"))).alias("splits"))
    # split by split: the state it starts in, and where the record that is then open began
    chained = F.expr("""aggregate(splits,
      struct(false as inside, -1L as began, cast(array() as array<struct<start: bigint, opened: bigint, ends: boolean>>) as seen),
      (a, x) -> struct(
        if(a.inside, x.from_quotes, x.from_record) as inside,
        if(a.inside and not x.closes, a.began, x.start) as began,
        concat(a.seen, array(struct(x.start as start, if(a.inside, a.began, -1L) as opened, if(a.inside, x.from_quotes, x.from_record) as ends))) as seen),
      a -> a.seen)""")
    return per_file.select("file", F.inline(chained))


def _assemble(sep: str, opened_at: dict[tuple[int, int], int]):
    """Records of a partition. A record that crosses the edge of a split comes in pieces: with the split it began in, and this one."""

    def run(batches):
        opened, still = (re.compile(p, re.S) for p in _patterns(sep))
        at, held, began, fresh, returns = None, None, -1, False, False
        out: dict[str, list] = {"value": [], "file": [], "opened": [], "start": []}

        def ended(text):
            """The last line of a file whose lines end in CR LF may lack both."""
            nonlocal returns
            returns = returns or text.endswith("\r")
            return text + "\r" if returns and not text.endswith("\r") else text

        def put(text, piece):
            out["value"].append(text)
            out["file"].append(at[0])
            out["opened"].append(began if piece else None)
            out["start"].append(at[1])

        for batch in batches:
            for value, file, start in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if (file, start) != at:
                    if held is not None:
                        put("\n".join(held), True)
                    at, began = (file, start), opened_at.get((file, start), -1)
                    held, fresh, returns = ([] if began >= 0 else None), start == 0, False
                if held is None:
                    if value in ("", "\r"):
                        continue
                    if '"' in value and opened.fullmatch(value):
                        held, began = [value], start
                    elif fresh:
                        fresh = False
                    else:
                        put(ended(value), False)
                    continue
                held.append(value)
                if '"' not in value or still.fullmatch(value):
                    continue
                if fresh and began == start:
                    fresh = False
                else:
                    put(ended("\n".join(held)), began != start)
                held, began = None, -1
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("value", pa.string()), *[(c, pa.int64()) for c in ("file", "opened", "start")]]))
            for column in out.values():
                column.clear()
        if held is not None:
            put("\n".join(held), True)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("value", pa.string()), *[(c, pa.int64()) for c in ("file", "opened", "start")]]))

    return run


def quoted_records(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """(value): each record as one text, without the header of each file. Where records end in CR LF, so that a record ends
    in CR here, quoted line breaks become line feeds.
    """
    return _records(spark, path, sep).select(
        F.when(F.col("value").endswith("\r"), F.replace(F.expr("left(value, length(value) - 1)"), F.lit("\r\n"), F.lit("\n"))).otherwise(F.col("value")).alias("value"))


def _records(spark: SparkSession, path: str, sep: str) -> DataFrame:
    starts = _starts(spark, path, sep)
    # only splits that a record crosses: at most one row for each of them, and none where no record crosses an edge
    crossed = {(r["file"], r["start"]): (r["opened"], r["ends"]) for r in starts.filter("opened >= 0 or ends").collect()}
    opened_at = {key: opened for key, (opened, _) in crossed.items() if opened >= 0}
    found = _lines(spark, path).mapInArrow(_assemble(sep, opened_at), "value string, file bigint, opened bigint, start bigint")
    whole = found.filter("opened is null").select("value")
    if not crossed:
        return whole
    edges = F.broadcast(spark.createDataFrame(list(crossed), "file bigint, start bigint"))
    pieces = _lines(spark, path).join(edges, ["file", "start"], "left_semi").select("value", "file", "start")
    pieces = pieces.mapInArrow(_assemble(sep, opened_at), "value string, file bigint, opened bigint, start bigint").filter("opened is not null")
    joined = pieces.groupBy("file", "opened").agg(F.sort_array(F.collect_list(F.struct("start", "value"))).alias("parts"))
    return whole.unionByName(joined.select(F.array_join(F.transform("parts", lambda p: p["value"]), "\n").alias("value")))
