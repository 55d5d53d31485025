"""N-gram Jaccard join: documents whose sets of word n-grams are alike, and the groups that such links form.

Method: all documents count their n-grams in a table of hashed counters of fixed size. Each set is ordered rarest first
by those counters (ties by hash), so that two sets alike enough must share an n-gram of their short prefixes. Prefixes
are joined on the n-gram under the length and positional filters; a pair is then verified once, on whole sets, after a
suffix filter (an upper bound from the sets' parts by hash range).

Equal sets form one class and are handled once. Groups of near copies are not expanded into all pairs: two rounds link
each class to the class that its prefix n-grams point to, and a last round verifies every remaining pair whose classes are
not connected yet. No link that would connect two groups is left out, so the groups are those of the full join.

Edge cases. A null or empty text, or one of white space, has an empty set and no links: its component is its own
document id. Fewer words than ``n``: the whole sequence is the one n-gram. Repeated rows are kept, as members of one
class. A null id keeps its row and never names a group; if a group has no other id, its component is null. An empty
table gives an empty result. N-grams and sets are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import connected_components
from .scratch import Scratch
from .segment import gram_hashes, released, slices, words

#: Hashed counters of n-gram frequency: 2^20 numbers, whatever the input.
COUNTER_BITS = 20
COUNTER_BLOCK = 1 << 14
#: A prefix n-gram counted in more documents than this is dealt to several tasks.
HOT = 50_000
#: Ids of documents that are broadcast, with a class at most: 16 bytes each.
BROADCAST_IDS = 2_000_000

#: Sets that a task holds before it hands them on.
SET_BYTES = 1 << 21
#: Column that a row's class travels in, beside columns of any other name.
CLASS = "__ngram_class"

_PROFILE = "doc_id bigint, n_shingles bigint, cls bigint, block int, counts binary"
_POSTING = "gram bigint, cls bigint, n int, pos int, salt int"
_SETS = "cls bigint, grams binary"


def _sets(batches: Iterator[pa.RecordBatch], n: int):
    """(batch, row, sorted distinct n-gram hashes) of every document."""
    for batch in batches:
        texts = batch.column("text")
        for low, high in slices(texts):
            grams, first = gram_hashes(words(texts.slice(low, high - low)), n)
            for row in range(low, high):
                yield batch, row, np.unique(grams[first[row - low] : first[row - low + 1]])


def _class(grams: np.ndarray) -> int:
    """Class id of a set: a digest of its hashes."""
    return int.from_bytes(hashlib.blake2b(grams.tobytes(), digest_size=8).digest(), "little", signed=True)


def _profile(n: int):
    """Per document its set size and class; per task the counters that are not all zero."""

    def run(batches):
        counts = np.zeros(1 << COUNTER_BITS, np.uint64)
        ids, sizes, classes, pending = [], [], [], []

        def rows():
            k = len(ids)
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())],
                ["doc_id", "n_shingles", "cls", "block", "counts"])

        for batch, row, grams in _sets(batches, n):
            ids.append(batch.column("doc_id")[row].as_py())
            sizes.append(len(grams))
            classes.append(_class(grams) if len(grams) else None)
            pending.append(grams >> np.uint64(64 - COUNTER_BITS))
            if len(ids) >= 2000:
                counts += np.bincount(np.concatenate(pending).astype(np.int64), minlength=len(counts)).astype(np.uint64)
                yield rows()
                ids, sizes, classes, pending = [], [], [], []
        if ids:
            counts += np.bincount(np.concatenate(pending).astype(np.int64), minlength=len(counts)).astype(np.uint64)
            yield rows()
        used = [b for b in range(0, len(counts), COUNTER_BLOCK) if counts[b : b + COUNTER_BLOCK].any()]
        k = len(used)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.array([b // COUNTER_BLOCK for b in used], pa.int32()),
             pa.array([_packed(counts[b : b + COUNTER_BLOCK]) for b in used], pa.binary())],
            ["doc_id", "n_shingles", "cls", "block", "counts"])

    return run


def _packed(counts: np.ndarray) -> bytes:
    """Counters as the narrowest integers that hold them; the length tells the width."""
    width = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if counts.max() <= np.iinfo(t).max)
    return counts.astype(width).tobytes()


def _unpacked(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, f"<u{len(blob) // COUNTER_BLOCK}").astype(np.uint64)


def _add_blocks(batches):
    """Sum the counter blocks of a task; at most as many rows out as there are blocks."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            total[block] = total[block] + _unpacked(blob) if block in total else _unpacked(blob)
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([_packed(v) for v in total.values()], pa.binary())], ["block", "counts"])


def _counters(profile: DataFrame) -> np.ndarray:
    """The counters of all documents: a table of fixed size."""
    blocks = profile.filter("block is not null").select("block", "counts")
    summed = blocks.repartition(16, "block").mapInArrow(_add_blocks, "block int, counts binary")
    counts = np.zeros(1 << COUNTER_BITS, np.uint64)
    for row in summed.toLocalIterator():
        counts[row["block"] * COUNTER_BLOCK : (row["block"] + 1) * COUNTER_BLOCK] += _unpacked(row["counts"])
    return np.minimum(counts, np.iinfo(np.uint32).max).astype(np.uint32)


def min_overlap(size: int, percent: int) -> int:
    """Least intersection with any partner of a set of ``size``."""
    return -(-percent * size // 100)


def _postings(counters, n: int, percent: int, hot: int):
    """Prefix n-grams of each class, rarest first; a class met twice in a task counts once.

    The salt is 0 for an n-gram that one task has whole, and 1 or more for each part of one that is split.
    """

    def run(batches):
        counts = counters.value
        most = max(hot, 8 * int(counts.mean()))
        seen: set[int] = set()
        out: list[tuple] = []
        held = 0
        for _, _, grams in _sets(batches, n):
            if not len(grams):
                continue
            cls = _class(grams)
            if cls in seen:
                continue
            if len(seen) < 200_000:  # only saves repeated postings; the join below drops the others
                seen.add(cls)
            often = counts[grams >> np.uint64(64 - COUNTER_BITS)]
            size = len(grams)
            prefix = np.lexsort((grams, often))[: size - min_overlap(size, percent) + 1]
            parts = np.maximum(-(-often[prefix].astype(np.int64) // most), 1)
            salt = np.where(parts > 1, cls % parts + 1, 0)
            out.append((grams[prefix].view(np.int64), np.full(len(prefix), cls), np.full(len(prefix), size), np.arange(len(prefix)), salt))
            held += len(prefix)
            if held >= 50_000:
                yield _table(out)
                out, held = [], 0
        if out:
            yield _table(out)

    return run


def _table(out: list[tuple]) -> pa.RecordBatch:
    gram, cls, n, pos, salt = (np.concatenate(c) for c in zip(*out))
    return pa.RecordBatch.from_arrays([pa.array(gram), pa.array(cls, pa.int64()), pa.array(n.astype(np.int32)), pa.array(pos.astype(np.int32)), pa.array(salt.astype(np.int32))], ["gram", "cls", "n", "pos", "salt"])


def _shared(batches):
    """Of one partition of postings, those whose n-gram stands in the prefix of another class, or is dealt to several tasks.

    A partition holds a hash share of the prefix n-grams; one that many documents have is split by its salt, and as its
    other classes may be in other partitions, all its postings stay.
    """
    parts = [[batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)] for batch in batches]
    if not parts:
        return
    gram, cls, n, pos, salt = (np.concatenate(c) for c in zip(*parts))
    del parts
    order = np.lexsort((cls, gram))
    gram, cls, n, pos, salt = gram[order], cls[order], n[order], pos[order], salt[order]
    new = np.ones(len(gram), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (cls[1:] != cls[:-1])
    gram, cls, n, pos, salt = gram[new], cls[new], n[new], pos[new], salt[new]
    again = gram[1:] == gram[:-1]
    keep = salt > 0
    keep[1:] |= again
    keep[:-1] |= again
    for low in range(0, int(keep.sum()), 50_000):
        at = np.flatnonzero(keep)[low : low + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(gram[at]), pa.array(cls[at]), pa.array(n[at]), pa.array(pos[at])], ["gram", "cls", "n", "pos"])


def _set_rows(n: int, wanted_key: str = "cls"):
    """Whole sets of documents whose class is the wanted one (ids may repeat with other texts)."""

    def run(batches):
        out: list[tuple[int, bytes]] = []
        held = 0
        for batch, row, grams in _sets(batches, n):
            cls = _class(grams) if len(grams) else None
            if cls == batch.column(wanted_key)[row].as_py():
                out.append((cls, grams.tobytes()))
                held += grams.nbytes
            if held >= SET_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())], ["cls", "grams"])
                out, held = [], 0
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())], ["cls", "grams"])

    return run


_RANGES = np.arange(1, 16, dtype=np.uint64) << np.uint64(60)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets link: suffix filter by hash ranges, then the exact count."""
    total = len(a) + len(b)
    parts = [np.diff(np.concatenate([[0], np.searchsorted(x, _RANGES), [len(x)]])) for x in (a, b)]
    bound = int(np.minimum(*parts).sum())
    if (100 + percent) * bound < percent * total:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (total - both)


def _verify(percent: int):
    def run(batches):
        for batch in batches:
            a, b, x, y = (batch.column(c) for c in ("a", "b", "grams_a", "grams_b"))
            good = [linked(np.frombuffer(x[i].as_buffer(), np.uint64), np.frombuffer(y[i].as_buffer(), np.uint64), percent) for i in range(len(a))]
            yield pa.RecordBatch.from_arrays([a.filter(pa.array(good, pa.bool_())), b.filter(pa.array(good, pa.bool_()))], ["a", "b"])

    return run


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link; each row carries the two whole sets."""
    left = sets.select(F.col("cls").alias("a"), F.col("grams").alias("grams_a"))
    right = sets.select(F.col("cls").alias("b"), F.col("grams").alias("grams_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "grams_a", "grams_b").mapInArrow(released(_verify(percent)), "a bigint, b bigint")


def _can_link(percent: int):
    """Length and positional filters on one shared n-gram of the prefixes of x and y.

    The positional bound holds at the first n-gram that two sets share, so a pair is kept if any shared one passes.
    """
    total = F.col("x.n").cast("bigint") + F.col("y.n")
    rest = F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos")).cast("bigint")
    length = (100 * F.col("x.n").cast("bigint") >= percent * F.col("y.n")) & (100 * F.col("y.n").cast("bigint") >= percent * F.col("x.n"))
    return length & ((100 + percent) * rest >= percent * total)


def _pointed(live: DataFrame, percent: int) -> DataFrame:
    """For each class one partner: that of most of its prefix n-grams, each pointing to the class that has it earliest."""
    lead = live.groupBy("gram").agg(F.min(F.struct("pos", "cls", "n", "comp")).alias("lead"))
    lead = lead.select("gram", F.col("lead.pos").alias("pos"), F.col("lead.cls").alias("cls"), F.col("lead.n").alias("n"), F.col("lead.comp").alias("comp"))
    met = live.alias("x").join(lead.alias("y"), (F.col("x.gram") == F.col("y.gram")) & (F.col("x.comp") != F.col("y.comp")) & _can_link(percent))
    votes = met.groupBy(F.col("x.cls").alias("cls"), F.col("y.cls").alias("to")).agg(F.count("*").alias("k"))
    best = votes.groupBy("cls").agg(F.max(F.struct("k", F.negative("to").alias("minus"), "to")).alias("best"))
    return best.select(F.least("cls", "best.to").alias("a"), F.greatest("cls", "best.to").alias("b")).distinct()


def _crossing(live: DataFrame, percent: int) -> DataFrame:
    """Every pair of classes not connected yet that shares a prefix n-gram and passes the filters."""
    mixed = live.groupBy("gram").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high").select("gram")
    live = live.join(mixed, "gram", "left_semi")
    met = live.alias("x").join(live.alias("y"), (F.col("x.gram") == F.col("y.gram")) & (F.col("x.cls") < F.col("y.cls")) & (F.col("x.comp") != F.col("y.comp")) & _can_link(percent))
    return met.select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b")).distinct()


def _small(ids: DataFrame) -> DataFrame:
    """Ids to broadcast, if their counted number allows it; else both sides are shuffled."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def ngram_jaccard_groups(docs: DataFrame, n: int = 5, percent: int = 80, rounds: int = 2, partitions: int | None = None, hot: int = HOT) -> DataFrame:
    """Groups of documents (doc_id, text) under the links ``100 * intersection >= percent * union`` of word n-gram sets.

    Returns one row per input row: doc_id, n_shingles, component_id (smallest id reachable by links), ``cls``, the
    class of equal sets, and ``comp``, the smallest class of the group (both null for an empty set).
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngram-join")
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    profile = scratch.keep(docs.mapInArrow(released(_profile(n)), _PROFILE), "profile")
    rows = profile.filter("block is null").select("doc_id", "n_shingles", "cls")

    counters = spark.sparkContext.broadcast(_counters(profile))
    postings = docs.select("text").mapInArrow(released(_postings(counters, n, percent, hot)), _POSTING)
    width = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    live = scratch.keep(postings.repartition(width, "gram", "salt").mapInArrow(released(_shared), "gram bigint, cls bigint, n int, pos int"), "live")

    # One document of each class that has a candidate; a null id is found by its text.
    chosen = rows.groupBy("cls").agg(F.min("doc_id").alias("doc_id")).join(live.select("cls").distinct(), "cls", "left_semi")
    chosen = _small(scratch.keep(chosen, "chosen"))
    whole = docs.join(chosen, docs["doc_id"].eqNullSafe(chosen["doc_id"])).select("text", "cls")
    sets = scratch.keep(whole.mapInArrow(released(_set_rows(n)), _SETS), "sets")

    links: DataFrame | None = None
    labels: DataFrame | None = None
    for turn in range(rounds + 1):
        known = live.withColumn("comp", F.col("cls")) if labels is None else live.join(labels, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
        pairs = _pointed(known, percent) if turn < rounds else _crossing(known, percent)
        new = scratch.keep(_verified(pairs, sets, percent), f"links{turn}")
        if labels is None or not new.isEmpty():
            links = new if links is None else links.union(new)
            old, labels = labels, connected_components(links, scratch, f"round{turn}")
            if old is not None:
                scratch.drop(f"round{last}")
            last = turn

    members = rows.filter("cls is not null").join(labels, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    names = members.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    grouped = members.join(names, "comp").select("doc_id", "n_shingles", "component_id", "cls", "comp")
    alone = rows.filter("cls is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "cls", F.col("cls").alias("comp"))
    done = scratch.keep(grouped.union(alone), "groups")
    counters.destroy()
    scratch.drop("profile", "live", "chosen", "sets", f"round{last}", *[f"links{turn}" for turn in range(rounds + 1)])
    return done


def _classed(n: int):
    """The rows with the class of their set."""

    def run(batches):
        for batch in batches:
            texts = batch.column("text")
            for low, high in slices(texts):
                grams, first = gram_hashes(words(texts.slice(low, high - low)), n)
                own = [np.unique(grams[a:b]) for a, b in zip(first[:-1], first[1:])]
                part = batch.slice(low, high - low)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([_class(g) if len(g) else None for g in own], pa.int64())], [*part.schema.names, CLASS])

    return run


def one_of_each_group(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group, one that has the smallest id; so rows that repeat an id and set collapse to one.

    Documents with an empty set, or a null id, stay. A row is judged by its id and its set: of rows that share an id but not their texts, each
    goes with its own group. Of rows that are equal in both, the one with the smallest hash of all its columns stays.
    """
    groups = ngram_jaccard_groups(docs, n, percent)
    named = groups.filter("doc_id is not null and cls is not null")
    gone = _small(named.filter("component_id < doc_id").select("doc_id").distinct())
    shared = groups.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows")).filter("rows > 1").select("doc_id")
    if shared.isEmpty():
        return docs.join(gone, "doc_id", "left_anti")
    shared = _small(shared)
    alone = docs.join(shared, "doc_id", "left_anti").join(gone, "doc_id", "left_anti")
    kind = T.StructType([*docs.schema.fields, T.StructField(CLASS, T.LongType())])
    held = docs.join(shared, "doc_id", "left_semi").select(docs.columns).mapInArrow(released(_classed(n)), kind)
    first = named.filter("component_id = doc_id").select(F.col("doc_id").alias(f"{CLASS}_id"), F.col("cls").alias(f"{CLASS}_set"), F.col("comp").alias(f"{CLASS}_group")).distinct()
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    kept = held.join(first, (F.col("doc_id") == F.col(f"{CLASS}_id")) & (F.col(CLASS) == F.col(f"{CLASS}_set")))
    kept = kept.groupBy(f"{CLASS}_group").agg(F.min_by(row, F.xxhash64(row)).alias("row")).select("row.*")
    return alone.unionByName(kept.select(docs.columns)).unionByName(held.filter(F.col(CLASS).isNull()).select(docs.columns))
