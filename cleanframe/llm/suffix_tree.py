"""Language-model scores by a probabilistic suffix tree, beside those of a smoothed unigram model.

A text is its words, A-Z lower-cased, and one end. Tokens met at least ``min_count`` times in training, and the end, are symbols
of their own; all others, met or not, share one symbol. The tree predicts each token's symbol from the symbols before it in its
text, with a mark for the text's beginning, up to ``depth`` of them. Every context met at least ``min_count`` times in training
is considered, so symbols and contexts grow with the corpus. It is kept if its distribution diverges from that of the longest
kept context shorter than it (Kullback-Leibler). Distributions are smoothed by that shorter context's, down to the root, whose
symbols count half a time more than seen. A token that shares its symbol is scored further by its discounted share of that
symbol's tokens, and a token never met by the discounted mass. So the scores are log10 probabilities over the training tokens and
one unknown token, as those of the unigram model are.

All training texts are counted. Texts are cut into blocks; a block sends its distinct tokens, known by 64-bit hashes, in buckets of
hashes to the task that has all of a bucket, which counts them over all blocks and answers with their counts, so that no token
travels once for each time it is used. The tree is never gathered: for each length, a block sends its distinct (context, next
symbol) by hash of the context in the same way, and the answer is the symbol's probability there. Contexts are 64-bit hashes
too; the symbols that follow one context are told apart by 48 bits. Blocks are kept in tables bucketed by block, so only answers
are shuffled to them; their pairs are found some buckets at a time, so that working memory is a part of theirs. A context too rare to
gather the evidence asked for, by a bound that holds for every distribution, is not asked about. A token without a longer context
to ask about is summed up, and its probability no longer carried. Probabilities are kept to 15 bits after the leading one (an error of
7e-6 of a token's log10), so that tables and shuffles are small.

Edge cases. A null or empty text is the end token alone; a very long text is a block of its own. Repeated rows are each counted and scored; a null id is held out
if the fold says so, else trained on. Without training texts the counts are 0 and the tree is uniform.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .segment import done, mix, released, slices, span_hashes, words

DEPTH = 3
#: Times that a token with a symbol of its own, and a context, is met in training at least: what is met once cannot be met again.
MIN_COUNT = 2
#: A context is kept if it diverges by this much (nats a token) and by so much in all its tokens together.
DIVERGENCE, EVIDENCE = 1e-3, 30.0
#: Weight of the shorter context's distribution, in tokens.
SMOOTHING = 20.0
#: Taken off each count of a token that shares its symbol, for tokens never met.
DISCOUNT = 0.75
#: Bytes of text in a block.
BLOCK_BYTES = 12 << 20
#: Tokens whose contexts are hashed at once.
ROWS = 1 << 18
#: Ranges in which numbers are sorted, one after the other, from so many numbers on.
RANGES, RANGED = 8, 1 << 16
#: Bytes of a symbol's hash that tell it from the others that follow a context.
SYMBOL_BYTES = 6
#: Buckets for each shuffle partition: a task answers one bucket after the other.
BUCKETS = 4

_U = np.uint64
#: The end of a text as a token; no word contains a line break.
END = span_hashes(np.frombuffer(b"\n", np.uint8), np.array([0]), np.array([1]))[0]

_BLOCKS = "block bigint, doc_id array<bigint>, held_out array<boolean>, n_tokens array<bigint>, tokens binary, symbols binary, n binary"
_LISTED = "block bigint, bucket int, symbols binary, n binary"
_COUNTED = "block bigint, bucket int, c binary, train_tokens bigint, distinct bigint, own_tokens bigint, own_distinct bigint, ends bigint"
_STATE = "block bigint, doc_id array<bigint>, held_out array<boolean>, n_tokens array<bigint>, tokens binary, symbols binary, sums binary, prob binary, alive binary"
_ASKED = "block bigint, bucket int, context binary, symbol binary, n binary, before binary"
_ANSWER = "block bigint, bucket int, prob binary"
_SCORED = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def _packed(x: np.ndarray, width: int = 4) -> bytes:
    """Numbers of a few bytes, byte by byte, compressed: equal leading bytes lie together."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize)[:, -width:].T).tobytes())


def _unpacked(blob: bytes, kind="<u4", width: int = 4) -> np.ndarray:
    import zstandard

    held = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(width, -1)
    out = np.zeros((held.shape[1], np.dtype(kind).itemsize), np.uint8)
    out[:, -width:] = held.T
    return out.view(kind).ravel()


def _zipped(x: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def _unzipped(blob: bytes, kind) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), kind)


def _rounded(p: np.ndarray) -> np.ndarray:
    """Positive numbers as floats of four bytes, the last of them zero."""
    return ((p.astype(np.float32).view(np.uint32) + np.uint32(0x80)) & np.uint32(0xFFFFFF00)).view(np.float32)


def _grouped(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct numbers in order, a place of each, and the number of each place. Smaller and faster than ``np.unique``, as any place will do
    and only a range of the numbers is sorted at a time."""
    some = np.sort(x[:: max(1, len(x) // 1024)]) if len(x) >= RANGED else x[:0]
    edges = np.unique(some[len(some) // RANGES :: max(1, len(some) // RANGES)])
    part = np.zeros(len(x), np.uint8)
    for edge in edges:
        part += x >= edge
    which = np.empty(len(x), np.int32)
    distinct, first, n = [x[:0]], [which[:0]], 0
    for k in range(len(edges) + 1):
        at = np.flatnonzero(part == k).astype(np.int32)
        held = x[at]
        order = np.argsort(held)
        held, at = held[order], at[order]
        new = np.ones(len(held), bool)
        np.not_equal(held[1:], held[:-1], out=new[1:])
        which[at] = np.cumsum(new, dtype=np.int32) + np.int32(n - 1)
        distinct.append(held[new])
        first.append(at[new])
        n += len(distinct[-1])
    del part, at, held, order, new
    return np.concatenate(distinct), np.concatenate(first), which


def _row(row: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([row], schema)


def _blocks(batches):
    """One row for each block of texts: its documents, their tokens by number, the distinct tokens and how often each is trained on."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        texts = batch.column("text")
        for low, high in slices(texts, 2 * BLOCK_BYTES):  # a batch is a block, but for very long texts
            part = texts.slice(low, high - low)
            hashes, counts = [], []
            for a, b in slices(part):
                w = words(part.slice(a, b - a))
                hashes.append(w.hash)
                counts.append(np.diff(w.first))
            count, hashes = np.concatenate(counts), np.concatenate(hashes)
            distinct, _, which = _grouped(hashes)
            del w, hashes
            held = batch.column("held_out").slice(low, high - low).to_numpy(zero_copy_only=False).astype(bool)
            trained = np.bincount(which[np.repeat(~held, count)], minlength=len(distinct))
            # Tokens by falling frequency, then the end; the end follows each document's words.
            rank = np.empty(len(distinct), np.uint32)
            order = np.argsort(-np.bincount(which, minlength=len(distinct)), kind="stable")
            rank[order] = np.arange(len(distinct))
            tokens = np.full(len(which) + len(count), len(distinct), "<u4")
            word = np.ones(len(tokens), bool)
            word[np.cumsum(count + 1) - 1] = False
            tokens[word] = rank[which]
            del which
            yield pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([batch.column("doc_id").slice(low, high - low).to_pylist()], pa.list_(pa.int64())),
                 pa.array([held.tolist()]), pa.array([(count + 1).tolist()], pa.list_(pa.int64())),
                 *[pa.array([x], pa.binary()) for x in (_packed(tokens), np.append(distinct[order], END).tobytes(), _zipped(np.append(trained[order], int((~held).sum()))))]],
                ["block", "doc_id", "held_out", "n_tokens", "tokens", "symbols", "n"])
            number += 1


#: Shared symbol and mark of a beginning, as hashes.
_OTHER, _MARK = _U(0), _U(1)
_STEP, _PAIR = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)


def _rows(batches) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def _buckets(rows) -> Iterator[list[dict]]:
    """The rows of each bucket; those of a task come in the order of their buckets."""
    return (list(part) for _, part in groupby(_rows(rows), itemgetter("bucket")))


def _bucket(hashes: np.ndarray, width: int) -> np.ndarray:
    """A bucket is a range of hashes."""
    return (hashes >> _U(32)) * _U(width) >> _U(32)


def _cuts(hashes: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """Buckets of hashes in order, with the range of each."""
    at = np.searchsorted(_bucket(hashes, width), np.arange(width + 1, dtype=_U))
    return [(k, int(a), int(b)) for k, (a, b) in enumerate(zip(at[:-1], at[1:])) if a < b]


def _listed(width: int):
    """For each block and bucket, the distinct tokens and how often each is trained on."""

    def run(batches):
        for row in _rows(batches):
            hashes, n = np.frombuffer(row["symbols"], _U), _unzipped(row["n"], np.int64)
            order = np.argsort(hashes)
            for bucket, a, b in _cuts(hashes[order], width):
                at = order[a:b]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["block"]], pa.int64()), pa.array([bucket], pa.int32()), pa.array([hashes[at].tobytes()], pa.binary()), pa.array([_zipped(n[at])], pa.binary())],
                    ["block", "bucket", "symbols", "n"])

    return run


_COUNTED_TYPES = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("c", pa.binary()),
                            *[(x, pa.int64()) for x in ("train_tokens", "distinct", "own_tokens", "own_distinct", "ends")]])


def _counted(min_count: int):
    """Counts of the tokens of a block, in the order sent, and a row without a block that sums up the bucket."""

    def run(batches):
        for rows in _buckets(batches):
            hashes = [np.frombuffer(r["symbols"], _U) for r in rows]
            distinct, _, which = _grouped(np.concatenate(hashes))
            c = np.bincount(which, np.concatenate([_unzipped(r["n"], np.int64) for r in rows]), len(distinct)).astype(np.int64)
            own = (c >= min_count) | (distinct == END)
            yield _row({"train_tokens": int(c.sum()), "distinct": int((c > 0).sum()), "own_tokens": int(c[own].sum()),
                        "own_distinct": int((c[own] > 0).sum()), "ends": int((c[distinct == END] > 0).sum())}, _COUNTED_TYPES)
            for r, part in zip(rows, np.split(c[which], np.cumsum([len(x) for x in hashes])[:-1])):
                yield _row({"block": r["block"], "bucket": r["bucket"], "c": _zipped(part)}, _COUNTED_TYPES)

    return run


@dataclass
class Pairs:
    """Distinct (context, next symbol) of some buckets of a block at one length, where the context may be met often enough."""

    at: np.ndarray  # which of the predicted symbols that have such a context
    which: np.ndarray  # the pair of each
    first: np.ndarray  # the first of ``at`` for each pair, or any other
    context: np.ndarray  # of each pair, in order
    symbol: np.ndarray
    buckets: list[tuple[int, int, int]]


class Block:
    """A block at length ``d``: the tokens asked about, ``rows``, and their probabilities so far."""

    def __init__(self, row: dict, d: int, width: int):
        self.d, self.width, self.size = d, width, np.array(row["n_tokens"])
        self.alive = np.unpackbits(np.frombuffer(row["alive"], np.uint8), count=int(self.size.sum())).astype(bool)
        # Each text begins with the mark, which is not predicted itself.
        back = self._back()
        self.rows = np.flatnonzero(self.alive & (back >= d)).astype(np.int32)
        self.kinds, first, kind = _grouped(_unzipped(row["symbols"], _U))
        self.symbol = kind.astype(np.uint32)[_unpacked(row["tokens"])]
        self.prob = _unpacked(row["prob"], np.float32)
        if d == 1:  # at the root, by token
            self.prob = self.prob[first][self.symbol[self.rows]]

    def _back(self) -> np.ndarray:
        back = np.arange(1, int(self.size.sum()) + 1, dtype=np.int32)
        back -= np.repeat((np.cumsum(self.size) - self.size).astype(np.int32), self.size)
        return back

    def pairs(self) -> Iterator[Pairs]:
        """Pairs by context, then by symbol, some buckets at a time: every task that reads the block finds the same order."""
        back, rows, symbol, marked = self._back(), self.rows, self.symbol, np.append(self.kinds, _MARK)
        context, part = np.full(len(rows), self.d, _U), np.empty(len(rows), np.uint8)
        for a in range(0, len(rows), ROWS):
            at, h = rows[a : a + ROWS], context[a : a + ROWS]
            for k in range(self.d):
                h[:] = mix(h + marked[np.where(back[at] == k + 1, len(self.kinds), symbol[np.maximum(at - 1 - k, 0)])] * _STEP + _PAIR)
            part[a : a + ROWS] = _bucket(h, self.width) * _U(RANGES) // _U(self.width)
        del back
        for k in range(RANGES):
            at = np.flatnonzero(part == k).astype(np.int32)
            contexts, _, ranked = _grouped(context[at])
            key, first, which = _grouped((ranked.astype(_U) << _U(32)) | symbol[rows[at]])
            held = contexts[(key >> _U(32)).astype(np.int64)]
            yield Pairs(at, which, first, held, self.kinds[(key & _U(0xFFFFFFFF)).astype(np.int64)], _cuts(held, self.width))


def _asked(d: int, width: int):
    """For each block and bucket, the pairs of length ``d`` with their training counts and probabilities so far."""

    def run(batches):
        for row in _rows(batches):
            block = Block(row, d, width)
            trained = np.repeat(~np.array(row["held_out"], bool), block.size)[block.rows]
            for p in block.pairs():
                n = np.bincount(p.which[trained[p.at]], minlength=len(p.context)).astype(np.uint32)
                before = block.prob[p.at[p.first]]
                for bucket, a, b in p.buckets:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row["block"]], pa.int64()), pa.array([bucket], pa.int32()), *[pa.array([x], pa.binary()) for x in (_zipped(p.context[a:b]), _packed(p.symbol[a:b], SYMBOL_BYTES), _packed(n[a:b]), _packed(before[a:b]))]],
                        ["block", "bucket", "context", "symbol", "n", "before"])

    return run


def least_count(n: int, symbols: int, min_count: int) -> int:
    """How often a context must be met at least to be kept.

    A pair met k times has a probability of k / size or more under every shorter context, so t tokens cannot diverge by more than
    t log((size + smoothing) / (t + smoothing)) in all. A context met less often than this bound allows is never kept.
    """
    size, t = n + 0.5 * symbols + SMOOTHING, max(1, min_count)
    while t < size and t * np.log((size + SMOOTHING) / (t + SMOOTHING)) < EVIDENCE:
        t += 1
    return t


_STATE_TYPES = pa.schema([("block", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("held_out", pa.list_(pa.bool_())), ("n_tokens", pa.list_(pa.int64())),
                          *[(x, pa.binary()) for x in ("tokens", "symbols", "sums", "prob", "alive")]])


def _by_text(size: np.ndarray, x: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
    """Sums over the tokens of each text, or over those in ``rows``."""
    text = np.repeat(np.arange(len(size), dtype=np.int32), size)
    if rows is not None:
        text = text[rows]
    return np.bincount(text, x, len(size))


def _begun(counts: dict[str, int], symbols: int, min_count: int, least: int, width: int):
    """Blocks with the counts of their tokens: each token's symbol and its probability at the root; sums that need no context."""
    n, v, other, kinds = (counts[k] for k in ("train_tokens", "distinct", "other_tokens", "other_distinct"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        answers = dict(zip(right.column("bucket").to_pylist(), right.column("c").to_pylist()))
        out = []
        for row in left.to_pylist():
            hashes, tokens, size = np.frombuffer(row["symbols"], _U), _unpacked(row["tokens"]), np.array(row["n_tokens"])
            order, c = np.argsort(hashes), np.zeros(len(hashes), np.int64)
            for bucket, a, b in _cuts(hashes[order], width):
                c[order[a:b]] = _unzipped(answers[bucket], np.int64)
            own = (c >= min_count) | (hashes == END)
            root = _rounded((np.where(own, c, other) + 0.5) / (n + 0.5 * symbols))
            base = np.log10((c + 0.5) / (n + 0.5 * (v + 1)))
            # Within the shared symbol: discounted counts, and the rest for a token never met.
            within = np.where(c > 0, np.maximum(c - DISCOUNT, 1e-9), DISCOUNT * kinds) / other if other else np.ones(len(c))
            # A symbol met too seldom is no context of the next one. The mark is met as often as the end.
            alive = np.ones(len(tokens), bool)
            alive[1:] = ~(own & (c < least))[tokens[:-1]]
            sums = [_by_text(size, (c > 0)[tokens]), _by_text(size, base[tokens])]
            log = np.where(own, 0.0, np.log10(within))[tokens]
            log[~alive] += np.log10(root.astype(np.float64))[tokens[~alive]]
            sums = np.array([*sums, _by_text(size, log)])
            out.append(row | {"symbols": _zipped(np.where(own, hashes, _OTHER)), "sums": sums.tobytes(), "prob": _packed(root), "alive": np.packbits(alive).tobytes()})
        return pa.Table.from_pylist(out, _STATE_TYPES)

    return lambda left, right: done(run, left, right)


def _answer(least: int):
    """Probability of each asked pair, in the order asked, with its context if that is kept; NaN where the context is too rare,
    and negative where the pair is, which is then too rare as a context of the next length.

    A bucket has all rows of each of its contexts.
    """

    def run(batches):
        for rows in _buckets(batches):
            context, symbol = (np.concatenate(x) for x in zip(*[(_unzipped(r["context"], _U), _unpacked(r["symbol"], _U, SYMBOL_BYTES)) for r in rows]))
            which = _grouped(context)[2]
            n, before = (np.concatenate([_unpacked(r[k], kind) for r in rows]) for k, kind in (("n", np.uint32), ("before", np.float32)))
            _, first, same = _grouped(mix(context * _PAIR + symbol * _STEP))
            del context, symbol
            total, seen = np.bincount(which, n), np.bincount(same, n)
            prob = (seen[same] + SMOOTHING * before) / (total[which] + SMOOTHING)
            share = seen / np.maximum(total[which[first]], 1)
            gain = np.bincount(which[first], share * np.log(prob[first] / before[first]), len(total))
            keep = (gain >= DIVERGENCE) & (gain * total >= EVIDENCE)
            prob = _rounded(np.where(keep[which], prob, before))
            prob = np.where(total[which] < least, np.float32(np.nan), np.where(seen[same] < least, -prob, prob))
            ends = np.cumsum([len(_unzipped(r["context"], _U)) for r in rows])
            for r, part in zip(rows, np.split(prob, ends[:-1])):
                yield pa.RecordBatch.from_arrays([pa.array([r["block"]], pa.int64()), pa.array([r["bucket"]], pa.int32()), pa.array([_packed(part)], pa.binary())], ["block", "bucket", "prob"])

    return run


def _told(d: int, depth: int, width: int, train_tokens: int):
    """Blocks with the answers for length ``d``: their probabilities so far, or after the last one the scores."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        answers = dict(zip(right.column("bucket").to_pylist(), right.column("prob").to_pylist()))
        out = []
        for row in left.to_pylist():
            block = Block(row, d, width)
            size, rows, alive, prob = block.size, block.rows, block.alive, block.prob
            # A context and its last symbol are a context of the symbol that follows, met no more often than those it ends with.
            longer = np.zeros(len(alive) + 1, bool)
            for p in block.pairs():
                told = np.full(len(p.context), np.nan, np.float32)
                for bucket, a, b in p.buckets:
                    told[a:b] = _unpacked(answers[bucket], np.float32)
                told = told[p.which]
                prob[p.at] = np.where(np.isnan(told), prob[p.at], np.abs(told))
                if d < depth:
                    longer[rows[p.at] + 1] = told > 0
            del block
            if d < depth:
                longer[:-1] &= alive
                begin = np.cumsum(size) - size
                for k in range(d):  # the first tokens of a text have no context of that length
                    longer[(begin + k)[size > k]] = False
            stays = longer[rows]
            sums = np.frombuffer(row["sums"]).reshape(3, -1).copy()
            sums[2] += _by_text(size, np.log10(prob[~stays].astype(np.float64)), rows[~stays])
            if d < depth:
                out.append(row | {"sums": sums.tobytes(), "prob": _packed(prob[stays]), "alive": np.packbits(longer[:-1]).tobytes()})
            else:
                out.append(pa.table({"doc_id": pa.array(row["doc_id"], pa.int64()), "held_out": pa.array(row["held_out"], pa.bool_()), "n_tokens": size, "n_known": sums[0].astype(np.int64),
                                     "train_tokens": np.full(len(size), train_tokens), "base_score": sums[1], "score": sums[2]}))
        return pa.Table.from_pylist(out, _STATE_TYPES) if d < depth else pa.concat_tables(out)

    return lambda left, right: done(run, left, right)


def score_texts(docs: DataFrame, held_out, depth: int = DEPTH, min_count: int = MIN_COUNT) -> DataFrame:
    """Score every row of (doc_id, text) by a tree learnt from the rows for which the column ``held_out`` is false.

    Returns doc_id, held_out, n_tokens, n_known (tokens met in training), train_tokens, base_score and score (log10).
    """
    if depth < 1:
        raise ValueError("depth must be 1 at least")
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    width = BUCKETS * tasks
    scratch = Scratch(spark, "suffix-tree")
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))

    def answered(asked: DataFrame, answer, schema: str, name: str) -> DataFrame:
        """Each bucket in one task, which answers it; kept, so that the questions' shuffle files go."""
        return scratch.keep(asked.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(released(answer), schema), name, compression="none")

    blocks = scratch.keep(docs.mapInArrow(released(_blocks), _BLOCKS), "blocks", BLOCK_BYTES, compression="none")
    counted = answered(blocks.select("block", "symbols", "n").mapInArrow(released(_listed(width)), _LISTED), _counted(min_count), _COUNTED, "counted")
    n, v, n_own, v_own, ends = counted.filter("block is null").agg(*[F.coalesce(F.sum(x), F.lit(0)) for x in ("train_tokens", "distinct", "own_tokens", "own_distinct", "ends")]).first()
    counts = {"train_tokens": n, "distinct": v, "other_tokens": n - n_own, "other_distinct": v - v_own}
    symbols = v_own + 1 - ends + 1  # the end has one, met or not, and the others share one
    least = least_count(n, symbols, min_count)
    begun = _begun(counts, symbols, min_count, least, width)
    state = scratch.keep_by(blocks.drop("n").groupBy("block").cogroup(counted.filter("block is not null").select("block", "bucket", "c").groupBy("block")).applyInArrow(begun, _STATE), "state0", "block", tasks, compression="none")
    scratch.drop("blocks", "counted")
    for d in range(1, depth + 1):
        asked = state.select("block", "held_out", "n_tokens", "tokens", "symbols", "prob", "alive").mapInArrow(released(_asked(d, width)), _ASKED)
        answers = answered(asked, _answer(least), _ANSWER, f"answers{d}")
        # A block finds its pairs again when their answers come.
        told = state.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_told(d, depth, width, n), _STATE if d < depth else _SCORED)
        if d == depth:
            return told
        state = scratch.keep_by(told, f"state{d}", "block", tasks, compression="none")
        scratch.drop(f"state{d - 1}", f"answers{d}")
