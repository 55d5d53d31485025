"""Similar pairs among the short values that share a segment, in NumPy.

Rows come sorted by key; of each key the cut values first, then the values that hold the segment. Each of these is held against
all cut values of its key: sets of letters and of letter pairs, as bits, rule out most, the others are compared between their
common beginning and their common end, in a band as wide as the edits allowed.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

# Executors need not have this package on their path: its functions travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MOST = 8  # edits of a value whose pairs are verified here
WIDEST = 128  # its letters
CELLS = 1 << 17  # pairs looked at at once
BATCH = 1 << 15  # pairs verified at once
_FAR = 100  # with WIDEST additions still a byte
_NUMBERS = ("key", "salt", "side", "id", "n", "rows", "spot", "back")  # spot: number of a cut value's segment, place in one that holds it
_NAMES = ["value_a", "value_b", "rows_a", "rows_b", "distance", "similarity"]

Rows = dict  # NumPy arrays, and an Arrow one of the values shown


def _letters(texts: pa.Array, sizes: np.ndarray) -> np.ndarray:
    """Letters of all texts in a row, as numbers above 0."""
    texts = texts.cast(pa.binary())
    first, last = np.frombuffer(texts.buffers()[1], np.int32)[[texts.offset, texts.offset + len(texts)]]
    text = texts.buffers()[2].slice(first, last - first).to_pybytes().decode("utf-8", "replace")
    if len(text) != sizes.sum():  # bytes that are no letters
        text = "".join(t.decode("utf-8", "replace")[:n].ljust(n, "?") for t, n in zip(texts.to_pylist(), sizes))
    letters = np.frombuffer(text.encode("utf-32-le"), np.uint32) + 1
    return letters.astype(np.uint8) if len(letters) and letters.max() < 256 else letters


def _set(items: np.ndarray) -> np.ndarray:
    """256 bits a row, one set for each hashed item and how often it has come before; an item of 0 is none."""
    items = np.sort(items, axis=1)
    place = np.arange(items.shape[1])
    new = np.ones(items.shape, bool)
    new[:, 1:] = items[:, 1:] != items[:, :-1]
    before = place - np.maximum.accumulate(np.where(new, place, 0), axis=1)
    bits = np.zeros((len(items), 256), bool)
    some = items > 0
    bits[np.nonzero(some)[0], ((items[some] * np.uint64(1_000_003) + before[some].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)] = True
    return np.packbits(bits, axis=1)


def with_sets(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds the sets of letters and of pairs of neighbouring letters of a value, null for one of more than ``width`` letters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            normal = batch.column("normal")
            sizes = pc.utf8_length(normal).to_numpy(zero_copy_only=False)
            fits = sizes <= width
            texts, n = normal.filter(pa.array(fits)), sizes[fits]
            inside = np.arange(width) < n[:, None]
            letters = np.zeros(inside.shape, np.uint64)
            if len(n):
                letters[inside] = _letters(texts, n)
            pairs = np.where(letters[:, 1:] > 0, (letters[:, :-1] << np.uint64(32)) | letters[:, 1:], np.uint64(0))
            sets = iter(np.concatenate((_set(letters), _set(pairs)), axis=1))
            yield batch.append_column("sets", pa.array([next(sets).tobytes() if f else None for f in fits], pa.binary()))

    return run


def _read(batch: pa.RecordBatch, width: int) -> Rows:
    rows = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in _NUMBERS}
    rows["shown"] = pc.coalesce(batch.column("shown"), batch.column("normal"))
    sets = batch.column("sets")
    first = np.frombuffer(sets.buffers()[1], np.int32)[sets.offset]
    sets = np.frombuffer(sets.buffers()[2], np.uint64, 8 * len(sets), first).reshape(-1, 8)
    rows["letters"], rows["pairs"] = sets[:, :4].copy(), sets[:, 4:].copy()
    rows["few"] = np.bitwise_or.reduce(rows["letters"], axis=1)  # the same items in 64 bits
    for c in ("few", "letters", "pairs"):
        count = np.bitwise_count(rows[c])
        rows[f"n_{c}"] = count if count.ndim == 1 else count.sum(axis=1, dtype=np.int16)
    sizes = rows["n"]
    letters = _letters(batch.column("normal"), sizes)
    inside = np.arange(width) < sizes[:, None]
    rows["ahead"] = np.zeros(inside.shape, letters.dtype)
    rows["ahead"][inside] = letters
    starts = np.cumsum(sizes) - sizes
    rows["behind"] = np.zeros(inside.shape, letters.dtype)
    rows["behind"][inside] = letters[(np.repeat(starts + sizes - 1, sizes) - (np.arange(len(letters)) - np.repeat(starts, sizes)))]
    return rows


def _distances(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, k: int) -> np.ndarray:
    """Edits between rows of ``a`` and ``b`` with ``nb <= na <= nb + k`` letters; above ``k`` where there are more."""
    size, width = len(a), int(na.max(initial=0))
    a = np.ascontiguousarray(a[:, :width].T)
    padded = np.zeros((width + 2 * k, size), b.dtype)
    padded[k : k + width] = b[:, :width].T
    band = np.full((2 * k + 2, size), _FAR, np.uint8)  # cell j of row i of the table at j - i + k, and one beyond
    band[k : 2 * k + 1] = np.arange(k + 1, dtype=np.uint8)[:, None]
    found = np.zeros(size, np.uint8)
    for i in range(width):
        other = padded[i : i + 2 * k + 1] != a[i]
        other = other.view(np.uint8)
        other += band[:-1]
        np.minimum(other, band[1:] + np.uint8(1), out=band[:-1])
        for o in range(1, 2 * k + 1):
            np.minimum(band[o], band[o - 1] + np.uint8(1), out=band[o])
        ends = np.flatnonzero(na == i + 1)
        found[ends] = band[nb[ends] - na[ends] + k, ends]
    return found


def _common(rows: Rows, side: str, x: np.ndarray, y: np.ndarray, width: int) -> np.ndarray:
    """Letters that rows ``x`` and ``y``, of which no two hold the same value, have in common on one side."""
    letters = rows[side][:, :width]
    return (letters[x] != letters[y]).argmax(axis=1)


def _meets(rows: Rows, x: np.ndarray, y: np.ndarray, i: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """Whether segment ``i`` of rows ``x`` stands in rows ``y`` so much later, at a shift that is allowed to it."""
    n, m, k = rows["n"][x], rows["n"][y], rows["k"][x].astype(np.int64)
    at, upto = i * n // (k + 1), (i + 1) * n // (k + 1)
    met = (i <= k) & (abs(shift) <= i) & (abs(shift - m + n) <= k - i) & (at + shift >= 0) & (upto + shift <= m)
    some = np.flatnonzero(met)
    if len(some):
        at, size, shift = at[some, None], (upto - at)[some, None], shift[some, None]
        place = np.minimum(np.arange(int(size.max())), size - 1)
        met[some] = (rows["ahead"][x[some, None], at + place] == rows["ahead"][y[some, None], at + shift + place]).all(axis=1)
    return met


def _met_here(rows: Rows, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether a pair, whose first segment is not common, meets here and in no segment or place before."""
    n, k, i = rows["n"][x], rows["k"][x].astype(np.int64), rows["spot"][x]
    shift = rows["spot"][y] - i * n // (k + 1)
    here = _meets(rows, x, y, i, shift)
    for j in range(1, int(i.max(initial=0)) + 1):
        for s in range(-j, j + 1):
            at = np.flatnonzero(here & ((j < i) | ((j == i) & (s < shift))))
            here[at] = ~_meets(rows, x[at], y[at], np.full(len(at), j), np.full(len(at), s))
    return here


def _verified(rows: Rows, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the pairs of rows ``x`` and ``y``, where ``x`` is as long or longer, those that are similar and first meet here, and their edits."""
    width = int(rows["n"][x].max(initial=0))
    begin = np.minimum(_common(rows, "ahead", x, y, width), rows["n"][y])
    first = rows["spot"][x] == 0
    here = first == (begin >= rows["n"][x] // (rows["k"][x] + np.int64(1)))
    x, y, begin, first = x[here], y[here], begin[here], first[here]
    na, nb, k = rows["n"][x], rows["n"][y], rows["k"][x]
    end = np.minimum(_common(rows, "behind", x, y, width), nb - begin)
    na, nb = na - begin - end, nb - begin - end
    found = np.empty(len(x), np.uint8)
    least = -1
    for most in (4, 6, 8, 12, 20, 40, WIDEST):
        at = np.flatnonzero((na > least) & (na <= most))
        least = most
        if len(at):
            places = np.minimum(begin[at, None] + np.arange(min(most, int(na[at].max()))), rows["ahead"].shape[1] - 1)
            found[at] = _distances(rows["ahead"][x[at, None], places], rows["ahead"][y[at, None], places], na[at], nb[at], int(k[at].max()))
    ok = found <= k
    later = np.flatnonzero(ok & ~first)
    ok[later] = _met_here(rows, x[later], y[later])
    return x[ok], y[ok], found[ok]


def _shown(rows: Rows, long: np.ndarray, short: np.ndarray, distance: np.ndarray) -> pa.RecordBatch:
    a, b = rows["shown"].take(pa.array(short)), rows["shown"].take(pa.array(long))
    swap, some = pc.less_equal(a, b), (pa.array(rows["rows"][short]), pa.array(rows["rows"][long]))
    similarity = 100.0 - 100.0 * distance / rows["n"][long]
    sides = [pc.if_else(swap, *two) for two in ((a, b), (b, a), some, some[::-1])]
    return pa.RecordBatch.from_arrays([*sides, pa.array(distance.astype(np.int32)), pa.array(similarity)], _NAMES)


def _candidates(rows: Rows) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (cut, held) of one key that may be similar by their letters, of which the pair has not met before."""
    held = rows["side"] == 1
    new = np.ones(len(held), bool)
    new[1:] = (rows["key"][1:] != rows["key"][:-1]) | (rows["salt"][1:] != rows["salt"][:-1])
    start = np.flatnonzero(new)
    stop = np.append(start[1:], len(held))
    middle = stop - np.add.reduceat(held, start, dtype=np.int64)
    cells = (middle - start) * (stop - middle)
    letters, back, count, k = rows["few"], rows["back"], rows["n_few"], rows["k"]
    for g in np.flatnonzero(cells >= 1024):
        x = slice(start[g], middle[g])
        need, reach, first = (count[x] - np.minimum(k[x], count[x]))[:, None], k[x][:, None], not back[x].any()
        step = max(1, CELLS // (middle[g] - start[g]))
        for at in range(middle[g], stop[g], step):
            y = slice(at, min(at + step, stop[g]))
            common = np.bitwise_count(letters[x][:, None] & letters[y])
            near = (common >= need) & (common + reach >= count[y])
            if not first:
                near &= back[x][:, None] != back[y]
            i, j = np.nonzero(near)
            yield i + start[g], j + at
    small = (cells > 0) & (cells < 1024)
    of = np.repeat(np.arange(len(start)), np.where(small, stop - middle, 0))  # group of each row that holds
    ys = np.flatnonzero(held & np.repeat(small, stop - start))
    cuts = (middle - start)[of]
    total = np.cumsum(cuts)
    at = 0
    while at < len(ys):
        upto = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + CELLS, "right")))
        n = cuts[at:upto]
        y = np.repeat(ys[at:upto], n)
        x = np.arange(len(y)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[of[at:upto]], n)
        common = np.bitwise_count(letters[x] & letters[y])
        near = (common + k[x] >= count[x]) & (common + k[x] >= count[y]) & (back[x] != back[y])
        yield x[near], y[near]
        at = upto


def _similar(rows: Rows) -> Iterator[pa.RecordBatch]:
    def closer(x, y):
        n, k = rows["n"], rows["k"]
        ok = ((n[y] < n[x]) | ((n[y] == n[x]) & (rows["id"][y] < rows["id"][x]))) & (n[x] - n[y] <= k[x])
        x, y = x[ok], y[ok]
        # an edit changes at most one letter and two pairs of letters of either value
        for c, changed in (("letters", 1), ("pairs", 2)):
            common = np.bitwise_count(rows[c][x] & rows[c][y])
            reach = common[:, 0].astype(np.int16) + common[:, 1] + common[:, 2] + common[:, 3] + changed * k[x]
            ok = (reach >= rows[f"n_{c}"][x]) & (reach >= rows[f"n_{c}"][y])
            x, y = x[ok], y[ok]
        return x, y

    def found(xs, ys):
        x, y = np.concatenate(xs), np.concatenate(ys)
        for at in range(0, len(x), BATCH):
            a, b, distance = _verified(rows, x[at : at + BATCH], y[at : at + BATCH])
            if len(a):
                yield _shown(rows, a, b, distance)

    xs, ys, n = [], [], 0
    for x, y in _candidates(rows):
        x, y = closer(x, y)
        xs.append(x)
        ys.append(y)
        n += len(x)
        if n >= BATCH:
            yield from found(xs, ys)
            xs, ys, n = [], [], 0
    if n:
        yield from found(xs, ys)


def pairs_of_blocks(slack: int, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key: Rows | None = None  # cut values of the last key, whose rows may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _read(batch, width)
            rows["k"] = (rows["n"] * slack // 10_000).astype(np.uint8)
            if open_key is not None:
                rows = {c: pa.concat_arrays((open_key[c], v)) if c == "shown" else np.concatenate((open_key[c], v)) for c, v in rows.items()}
            yield from _similar(rows)
            last = (rows["key"] == rows["key"][-1]) & (rows["salt"] == rows["salt"][-1]) & (rows["side"] == 0)
            open_key = {c: v.filter(pa.array(last)) if c == "shown" else v[last] for c, v in rows.items()}

    return run
