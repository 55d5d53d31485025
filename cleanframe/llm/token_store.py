"""Token ids on disk: independent zstandard frames, a trailing seek table, a checksum for each frame.

A file holds the token ids of a range of documents in order. Each frame is a zstandard frame of its own with about
``frame_tokens`` ids of whole documents (a longer document stands alone), so a reader decompresses only the frames it
needs. The file ends with a skippable frame that lists compressed size, size and checksum of every frame (the public
seekable format: ``zstd -d`` reads such a file too).

Inside a frame, little-endian: the number of documents (u32); then for each document whether it has an id (u8), its id
(i64) and its number of tokens (u32), each as an array; then all token ids (u32).

Files are written by tasks under names of their own and become part of the store only through the index, which Spark
commits: a task that is lost and run again leaves an unused file at worst.

Edge cases. A null or empty text is the end token alone. A null id is kept, sorts first and is read back as null. Rows
that repeat an id are all kept. An empty table gives an empty store. Order: ascending ``order`` columns, ties by text hash.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import writing
from .segment import raw, released, slices, span_hashes

#: The seekable zstandard format (fixed values).
SKIPPABLE, SEEKABLE, WITH_CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80

FRAME_TOKENS = 1 << 16
#: Distinct pieces of text whose ids an encoder keeps.
KEPT_PIECES = 1_000_000
#: Pieces encoded in one call.
JOINED = 200
_INDEX = "file_no int, file string, frame int, slot int, doc_id bigint, n_tokens bigint"

# A space before one of these bytes starts a new piece in byte-level BPE: printable ASCII, or the lead byte of a letter.
# Lead bytes that also begin white space (U+0085, U+00A0, U+1680, U+2000 and so on) are left out.
_STARTS = np.zeros(256, bool)
_STARTS[0x21:0x7F] = True
_STARTS[0xC3:0xE1] = True


class PieceEncoder:
    """Encodes whole texts with a byte-level BPE tokenizer, each distinct piece of text once.

    Texts are cut before single spaces where the tokenizer's own splitting must cut as well, so the ids of the pieces
    are the ids of the text; ids of a piece met before are reused.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # Bytes of text that each token stands for: in byte-level BPE a token has one character for each byte.
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.width = np.zeros(max(vocab.values()) + 1, np.int64)
        self.width[list(vocab.values())] = [len(token) for token in vocab]
        self._forget()

    def _forget(self) -> None:
        self.place: dict[int, int] = {}
        self.begin, self.size, self.ids, self.used = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1 << 16, np.uint32), 0

    def _learn(self, hashes: np.ndarray, pieces: list[bytes]) -> None:
        """Encode new pieces, many in one text: each begins with a space, where the tokenizer cuts anyway."""
        lone = np.array([not (len(p) > 1 and p[0] == 0x20 and _STARTS[p[1]]) for p in pieces])
        order = np.argsort(~lone, kind="stable")
        pieces = [pieces[k] for k in order.tolist()]
        alone = int(lone.sum())
        texts = [*pieces[:alone], *[b"".join(pieces[k : k + JOINED]) for k in range(alone, len(pieces), JOINED)]]
        new = self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)
        ids = np.fromiter((i for x in new for i in x.ids), np.uint32)
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        last = np.searchsorted(np.cumsum(self.width[ids]), ends) + 1  # a token never spans two pieces
        size = np.diff(last, prepend=0)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.place.update(zip(hashes[order].tolist(), range(len(self.size), len(self.size) + len(pieces))))
        self.begin = np.concatenate([self.begin, self.used + last - size])
        self.size = np.concatenate([self.size, size])
        self.used += len(ids)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the number of each."""
        data, offsets = raw(texts)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        cut = np.zeros(len(data) + 1, bool)
        cut[:-2] = (data[:-1] == 0x20) & _STARTS[data[1:]]
        cut[offsets] = True
        at = np.flatnonzero(cut)
        begin, end = at[:-1], at[1:]
        distinct, first, which = np.unique(span_hashes(data, begin, end), return_index=True, return_inverse=True)
        if len(self.place) > KEPT_PIECES:
            self._forget()
        new = np.array([h not in self.place for h in distinct.tolist()])
        if new.any():
            self._learn(distinct[new], [data[begin[k] : end[k]].tobytes() for k in first[new].tolist()])
        place = np.fromiter(map(self.place.__getitem__, distinct.tolist()), np.int64, len(distinct))[which]
        size = self.size[place]
        last = np.cumsum(size)
        ids = self.ids[(self.begin[place] - last + size).repeat(size) + np.arange(last[-1])]
        before = np.concatenate([[0], last])[np.searchsorted(begin, offsets)]
        return ids, np.diff(before)


def _frame(doc_ids: list, sizes: list[int], ids: list[np.ndarray]) -> bytes:
    given = np.array([i is not None for i in doc_ids], np.uint8)
    names = np.array([i or 0 for i in doc_ids], "<i8")
    return struct.pack("<I", len(sizes)) + given.tobytes() + names.tobytes() + np.array(sizes, "<u4").tobytes() + b"".join(x.astype("<u4").tobytes() for x in ids)


def _documents(frame: bytes) -> Iterator[tuple[int | None, memoryview, int]]:
    """(doc_id, bytes of its ids, number of ids) of a decompressed frame."""
    (count,) = struct.unpack_from("<I", frame)
    given = np.frombuffer(frame, np.uint8, count, 4)
    names = np.frombuffer(frame, "<i8", count, 4 + count)
    sizes = np.frombuffer(frame, "<u4", count, 4 + 9 * count)
    at, view = 4 + 13 * count, memoryview(frame)
    for ok, name, size in zip(given.tolist(), names.tolist(), sizes.tolist()):
        yield (name if ok else None), view[at : at + 4 * size], size
        at += 4 * size


class _Writer:
    """One file of frames; closing it appends the seek table."""

    def __init__(self, root: str, file_no: int, frame_tokens: int):
        import xxhash
        import zstandard
        from pyarrow.fs import FileSystem

        self.store, base = FileSystem.from_uri(root)
        self.file = f"{base.rstrip('/')}/tokens-{file_no:06d}-{uuid.uuid4().hex}.zst"
        self.store.create_dir(base, recursive=True)
        self.out = self.store.open_output_stream(self.file, compression=None)
        self.compress = zstandard.ZstdCompressor(level=3, write_checksum=True, write_content_size=True).compress
        self.digest = lambda b: xxhash.xxh64_intdigest(b) & 0xFFFFFFFF
        self.table: list[tuple[int, int, int]] = []
        self.frame_tokens, self.held = frame_tokens, 0
        self.ids, self.sizes, self.names = [], [], []

    def add(self, name, ids: np.ndarray) -> tuple[int, int]:
        if self.sizes and self.held + len(ids) > self.frame_tokens:
            self.flush()
        place = (len(self.table), len(self.sizes))
        self.names.append(name)
        self.sizes.append(len(ids))
        self.ids.append(ids)
        self.held += len(ids)
        return place

    def flush(self) -> None:
        frame = _frame(self.names, self.sizes, self.ids)
        packed = self.compress(frame)
        self.out.write(packed)
        self.table.append((len(packed), len(frame), self.digest(frame)))
        self.ids, self.sizes, self.names, self.held = [], [], [], 0

    def close(self) -> None:
        if self.sizes:
            self.flush()
        rows = b"".join(struct.pack("<III", *row) for row in self.table)
        self.out.write(struct.pack("<II", SKIPPABLE, len(rows) + 9) + rows + struct.pack("<IBI", len(self.table), WITH_CHECKSUMS, SEEKABLE))
        self.out.close()


class TokenFile:
    """Reads frames of one file through its seek table."""

    def __init__(self, root: str, file: str):
        import xxhash
        import zstandard
        from pyarrow.fs import FileSystem

        store, _ = FileSystem.from_uri(root)
        self.source = store.open_input_file(file)
        size = self.source.size()
        count, flags, magic = struct.unpack("<IBI", self._read(size - 9, 9))
        if magic != SEEKABLE or flags != WITH_CHECKSUMS:
            raise ValueError(f"{file} has no seek table with checksums")
        table = np.frombuffer(self._read(size - 9 - 12 * count, 12 * count), "<u4").reshape(count, 3).astype(np.int64)
        self.sizes, self.digests = table[:, 0], table[:, 2]
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.decompress = zstandard.ZstdDecompressor().decompress
        self.digest = lambda b: xxhash.xxh64_intdigest(b) & 0xFFFFFFFF

    def __len__(self) -> int:
        return len(self.sizes)

    def _read(self, at: int, size: int) -> bytes:
        self.source.seek(int(at))
        return self.source.read(int(size))

    def frame(self, k: int) -> bytes:
        frame = self.decompress(self._read(self.starts[k], self.sizes[k]))
        if self.digest(frame) != self.digests[k]:
            raise ValueError(f"frame {k} is damaged")
        return frame


def _write(root: str, tokenizer: str, end_id: int, frame_tokens: int):
    def run(batches):
        from pyspark import TaskContext

        encoder, writer = PieceEncoder(tokenizer), None
        file_no = TaskContext.get().partitionId()
        for batch in batches:
            if writer is None and batch.num_rows:
                writer = _Writer(root, file_no, frame_tokens)
            names, texts = batch.column("doc_id"), batch.column("text")
            for low, high in slices(texts):
                ids, sizes = encoder.encode(texts.slice(low, high - low))
                places, at = [], 0
                for name, size in zip(names.slice(low, high - low).to_pylist(), sizes.tolist()):
                    places.append(writer.add(name, np.append(ids[at : at + size], np.uint32(end_id))))
                    at += size
                k = high - low
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file_no] * k, pa.int32()), pa.array([writer.file] * k), pa.array([p[0] for p in places], pa.int32()),
                     pa.array([p[1] for p in places], pa.int32()), names.slice(low, k), pa.array(sizes + 1, pa.int64())],
                    ["file_no", "file", "frame", "slot", "doc_id", "n_tokens"])
        if writer is not None:
            writer.close()

    return run


def write_tokens(docs: DataFrame, root: str, tokenizer: str, end_id: int = 0, order: Sequence[str] = ("doc_id",), frame_tokens: int = FRAME_TOKENS, files: int | None = None) -> DataFrame:
    """Encode (doc_id, text) and write the ids under ``root`` in ascending ``order``; each document ends with ``end_id``.

    Returns the index, written as Parquet under ``root``: one row per document with its file, frame and slot.
    ``tokenizer`` is the path of a byte-level BPE file; ``root`` is an address that pyarrow can open.
    """
    spark = docs.sparkSession
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), *[F.col(c).alias(f"order{i}") for i, c in enumerate(order)])
    by = [*[f"order{i}" for i in range(len(order))], F.xxhash64("text")]
    dealt = docs.repartitionByRange(files, *by).sortWithinPartitions(*by).select("doc_id", "text")
    with writing(spark):
        dealt.mapInArrow(released(_write(f"{root}/data", tokenizer, end_id, frame_tokens)), _INDEX).write.parquet(f"{root}/index")
    return read_index(spark, root)


def read_index(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(_INDEX).parquet(f"{root}/index")


def _files(spark: SparkSession, root: str) -> DataFrame:
    """Each file and the number of tokens before it; one row per file."""
    totals = read_index(spark, root).groupBy("file_no", "file").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("file_no", "file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))


def _rows(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    names = ["doc_id", "start", "n_tokens", "ids" if with_ids else "ids_crc32"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary() if with_ids else pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)


def _read(root: str, with_ids: bool):
    def run(batches):
        for batch in batches:
            for file, at in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist()):
                source = TokenFile(root, file)
                for k in range(len(source)):
                    rows = []
                    for name, ids, size in _documents(source.frame(k)):
                        rows.append((name, at, size, bytes(ids) if with_ids else zlib.crc32(ids)))
                        at += size
                    yield _rows(rows, with_ids)

    return run


def read_tokens(spark: SparkSession, root: str, with_ids: bool = True) -> DataFrame:
    """All documents of a store: doc_id, start (tokens before it), n_tokens, and ids (u32, little-endian) or their CRC-32."""
    schema = "doc_id bigint, start bigint, n_tokens bigint, " + ("ids binary" if with_ids else "ids_crc32 bigint")
    files = _files(spark, root)
    return files.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "file_no").mapInArrow(_read(f"{root}/data", with_ids), schema)


def _fetch(root: str):
    def run(batches):
        for batch in batches:
            for file, frame, slots in zip(*(batch.column(c).to_pylist() for c in ("file", "frame", "slots"))):
                docs, slots = list(_documents(TokenFile(root, file).frame(frame))), set(slots)
                rows = [(name, bytes(ids)) for k, (name, ids, _) in enumerate(docs) if k in slots]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["doc_id", "ids"])

    return run


def fetch_tokens(spark: SparkSession, root: str, wanted: DataFrame) -> DataFrame:
    """(doc_id, ids) of the documents whose id stands in ``wanted``; only their frames are decompressed."""
    at = read_index(spark, root).join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    frames = at.groupBy("file", "frame").agg(F.collect_list("slot").alias("slots"))  # a frame has a bounded number of documents
    return frames.mapInArrow(_fetch(f"{root}/data"), "doc_id bigint, ids binary")
