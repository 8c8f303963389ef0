"""Token ids in binary files of shuffled bit planes.

A file holds the ids of consecutive documents, cut into fixed-size blocks. A block of 32-bit ids is
transposed into its 32 bit planes (or 4 byte planes), each plane is one Zstandard frame, and the footer holds
the chunk index (where each block lies, its number of ids and the size of each plane) and the documents with
their lengths. Any block can be read alone, without the blocks before it:

    magic | planes of block 0 | planes of block 1 | ... | footer | footer size (u64) | magic

Documents are ordered by ranges, so files follow each other in ascending doc_id order and no task sees more
than its own range; only one row per file takes part in the running sum that gives global positions.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sourcesift.functions.lineage import shared_folder
from sourcesift.llm.textwords import SPACES, chunks, table, word_bounds
from sourcesift.llm.warc import _store

# fixed values of the format
MAGIC = b"IDPLANE1"
PLANES = {"bit": 32, "byte": 4}

#: Blocks of ids, and ids after which a file is closed (a document is never cut between files).
BLOCK_IDS, FILE_IDS = 1 << 16, 1 << 24
#: A worker keeps the ids of at least so many words met last and at most twice as many. Results do not depend on it.
KEPT_WORDS = 3 << 17

#: Pre-token patterns, as tokenizer files state them, that match no white space (fixed values).
SPACELESS = {r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}


#: 1 for ASCII letters, 2 for ASCII punctuation but the apostrophe: between the two a pre-token always ends.
KIND = np.zeros(256, np.uint8)
KIND[[b for b in range(128) if chr(b).isalpha()]] = 1
KIND[[b for b in b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"]] = 2


def transpose(ids: np.ndarray, planes: str = "byte") -> np.ndarray:
    """A block of ids as one row of bytes per plane, the lowest bit or byte first."""
    raw = ids.astype("<u4", copy=False).view(np.uint8).reshape(-1, 4)
    if planes == "byte":
        return np.ascontiguousarray(raw.T)
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")


def restore(rows: np.ndarray, n: int, planes: str = "byte") -> np.ndarray:
    """The inverse of :func:`transpose`."""
    if planes == "bit":
        bits = np.unpackbits(rows, axis=1, count=n, bitorder="little")
        rows = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").T
    return np.ascontiguousarray(rows.T).view("<u4").ravel()


class PlaneWriter:
    """One file: ids go in document by document, blocks go out as they fill."""

    def __init__(self, out, planes: str = "byte", block_ids: int = BLOCK_IDS, level: int = 3) -> None:
        import zstandard

        self.out, self.planes, self.block = out, planes, block_ids
        self.pack = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.open, self.waiting = [], 0
        self.keys, self.lengths, self.index = [], [], []
        self.n_ids, self.at = 0, len(MAGIC)
        out.write(MAGIC)

    def add(self, key: int | None, ids: np.ndarray) -> None:
        self.keys.append(key)
        self.lengths.append(len(ids))
        self.n_ids += len(ids)
        self.open.append(ids)
        self.waiting += len(ids)
        if self.waiting >= self.block:
            run = np.concatenate(self.open)
            whole = len(run) // self.block * self.block
            for i in range(0, whole, self.block):
                self._block(run[i : i + self.block])
            self.open, self.waiting = [run[whole:]], len(run) - whole

    def _block(self, ids: np.ndarray) -> None:
        packed = [self.pack.compress(row.tobytes()) for row in transpose(ids, self.planes)]
        self.index.append((self.at, len(ids), [len(p) for p in packed]))
        for p in packed:
            self.out.write(p)
            self.at += len(p)

    def close(self) -> None:
        if self.waiting:
            self._block(np.concatenate(self.open))
        head = json.dumps({"planes": self.planes, "block_ids": self.block, "n_ids": self.n_ids, "chunks": self.index}).encode()
        known = np.array([k is not None for k in self.keys], np.uint8)
        keys = np.array([k or 0 for k in self.keys], "<i8")
        body = [head, known.tobytes(), keys.tobytes(), np.array(self.lengths, "<i8").tobytes()]
        footer = self.pack.compress(struct.pack("<QQ", len(head), len(keys)) + b"".join(body))
        self.out.write(footer + struct.pack("<Q", len(footer)) + MAGIC)
        self.out.close()


class PlaneReader:
    """Footer of one file, and its blocks one by one."""

    def __init__(self, file) -> None:
        import zstandard

        self.file, self.unpack = file, zstandard.ZstdDecompressor()
        end = file.size()
        size, magic = struct.unpack("<Q8s", file.read_at(16, end - 16))
        if magic != MAGIC or file.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError("not a file of id planes")
        raw = self.unpack.decompress(file.read_at(size, end - 16 - size))
        head, n = struct.unpack_from("<QQ", raw)
        spec = json.loads(raw[16 : 16 + head])
        self.planes, self.block, self.n_ids, self.index = spec["planes"], spec["block_ids"], spec["n_ids"], spec["chunks"]
        at = 16 + head
        self.known = np.frombuffer(raw, np.uint8, n, at).astype(bool)
        self.keys = np.frombuffer(raw, "<i8", n, at + n)
        self.lengths = np.frombuffer(raw, "<i8", n, at + 9 * n)

    def read_block(self, i: int) -> np.ndarray:
        at, n, sizes = self.index[i]
        raw = self.file.read_at(sum(sizes), at)
        ends = np.cumsum(sizes)
        rows = [np.frombuffer(self.unpack.decompress(raw[e - s : e]), np.uint8) for s, e in zip(sizes, ends, strict=True)]
        return restore(np.stack(rows), n, self.planes)

    def documents(self) -> Iterator[np.ndarray]:
        """The ids of each document in turn; holds the open document and one block."""
        blocks, rest = iter(range(len(self.index))), np.zeros(0, np.uint32)
        for n in self.lengths.tolist():
            parts, have = [rest], len(rest)
            while have < n:
                parts.append(self.read_block(next(blocks)))
                have += len(parts[-1])
            run = np.concatenate(parts) if len(parts) > 1 else rest
            yield run[:n]
            rest = run[n:]


class _Pool:
    """Ids of words, end to end."""

    def __init__(self) -> None:
        self.slot: dict[str, int] = {}
        self.ids, self.ends = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def find(self, words: list[str]) -> np.ndarray:
        """The slot of each word, -1 where it is not here."""
        return np.fromiter(map(self.slot.get, words, repeat(-1)), np.int64, len(words))

    def put(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """New slots of words that are not here, from their ids end to end."""
        slots = np.arange(len(self.ends) - 1, len(self.ends) - 1 + len(words))
        self.slot.update(zip(words, slots.tolist(), strict=True))
        self.ids, self.ends = np.concatenate([self.ids, ids]), np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
        return slots

    def get(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the slots end to end, and how many each has."""
        first, sizes = self.ends[slots], self.ends[slots + 1] - self.ends[slots]
        done = np.cumsum(sizes)
        return self.ids[np.arange(int(sizes.sum())) + np.repeat(first - done + sizes, sizes)], sizes


@lru_cache(maxsize=2)
def _encoder(path: str) -> Callable[[pa.Array], Iterator[np.ndarray]]:
    """Texts -> ids of each, as the tokenizers library gives them without added special tokens.

    Where the file's pre-tokens cannot hold white space, which it drops, words between ASCII white space have
    ids of their own, and so have letters and punctuation side by side; then each different piece of a run of
    texts is encoded once. Other files are applied to whole texts.
    """
    import tokenizers

    tokenizer = tokenizers.Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    if hasattr(tokenizer.model, "_resize_cache"):
        tokenizer.model._resize_cache(0)  # words are kept here
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
    split = steps[0]
    apart = (
        split.get("type") == "Split" and split.get("behavior") == "Removed" and split.get("invert") is True
        and split.get("pattern", {}).get("Regex") in SPACELESS and not any(s.get("add_prefix_space") for s in steps)
        and not spec.get("post_processor") and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or set(t["content"]) & set(SPACES.decode()) for t in spec["added_tokens"])
    )
    is_word, specials = table(SPACES), [t["content"].encode() for t in spec["added_tokens"]]
    # ids of the words met of late, and of those before them; every word is in one of the two when it is needed
    young, old = _Pool(), _Pool()

    def encode(texts: list[str]) -> Iterator[list[int]]:
        return (e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False))

    def by_words(texts: pa.Array) -> Iterator[np.ndarray]:
        nonlocal young, old
        for _, _, data, at in chunks(texts, 1 << 22):
            s, e, words_at = word_bounds(data, at, is_word)
            raw = data.tobytes()
            if not any(t in raw for t in specials):  # such strings are found across pre-tokens
                kind = KIND[data]
                cut = np.flatnonzero(kind[1:] * kind[:-1] == 2) + 1
                inner = np.ones(len(data) + 1, bool)
                inner[at] = False
                cut = cut[inner[cut]]
                s, e = np.sort(np.concatenate([s, cut])), np.sort(np.concatenate([e, cut]))
                words_at = np.searchsorted(s, at)
            bounds = np.concatenate([[0], np.cumsum(e - s)])
            words = pa.LargeStringArray.from_buffers(len(s), pa.py_buffer(bounds), pa.py_buffer(data[is_word[data]].tobytes()))
            coded = words.dictionary_encode()
            distinct = coded.dictionary.to_pylist()
            if len(young.slot) > KEPT_WORDS:
                young, old = _Pool(), young
            slots = young.find(distinct)
            new = np.flatnonzero(slots < 0)
            before = old.find([distinct[i] for i in new.tolist()])
            again, fresh = new[before >= 0], new[before < 0]
            slots[again] = young.put([distinct[i] for i in again.tolist()], *old.get(before[before >= 0]))
            missing = [distinct[i] for i in fresh.tolist()]
            found = list(encode(missing))
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            slots[fresh] = young.put(missing, np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum())), sizes)
            flat, size = young.get(slots[coded.indices.to_numpy()])
            done = np.concatenate([[0], np.cumsum(size)])
            for a, z in zip(done[words_at[:-1]], done[words_at[1:]], strict=True):
                yield flat[a:z]

    def whole(texts: pa.Array) -> Iterator[np.ndarray]:
        for text in texts:
            yield np.array(next(encode([text.as_py() or ""])), np.uint32)

    return by_words if apart else whole


def ship_tokenizer(docs: DataFrame, path: str) -> str:
    """Send the tokenizer's file to every executor; its name there. It is read by the name Spark gives it."""
    docs.sparkSession.sparkContext.addFile(path)
    return path.rpartition("/")[2]


def write_planes(docs: DataFrame, path: str, folder: str, end_id: int | None = 1, planes: str = "byte", block_ids: int = BLOCK_IDS, file_ids: int = FILE_IDS) -> DataFrame:
    """Encode every whole text and write the ids in ascending doc_id order under ``folder``; the stored index of files.

    The index has a row per file: part, seq, file, n_docs, n_ids. A null text is empty; ``end_id`` is appended to
    each document (None: nothing is). A null doc_id comes first; rows that share a doc_id are ordered by a
    hash of their text.
    Other columns are left out. Names of files are new in each attempt of a task, and the index lists only those
    of the attempts that count, so lost executors do no harm.
    """
    name = ship_tokenizer(docs, path)
    end = np.zeros(0, np.uint32) if end_id is None else np.array([end_id], np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(SparkFiles.get(name))
        store, base = _store(folder)
        out, seq, file = None, 0, ""

        def close() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "file": file, "n_docs": len(out.keys), "n_ids": out.n_ids}], SCHEMA)

        for batch in batches:
            keys, part = batch.column(0).to_pylist(), batch.column(2)[0].as_py() if batch.num_rows else 0
            for key, ids in zip(keys, encode(batch.column(1)), strict=True):
                if out is None:
                    file = f"{part:08d}-{seq:06d}-{uuid.uuid4()}.planes"
                    store.create_dir(base, recursive=True)
                    out = PlaneWriter(store.open_output_stream(f"{base}/{file}", compression=None), planes, block_ids)
                out.add(key, np.concatenate([ids, end]))
                if out.n_ids >= file_ids:
                    yield close()
                    out, seq = None, seq + 1
        if out is not None:
            yield close()

    # a key that many rows share is dealt out by text, equal rows by their place in the input
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").alias("_text"), F.xxhash64("text").alias("_hash"), F.monotonically_increasing_id().alias("_row"))
    order = [F.col("_id").asc_nulls_first(), "_hash", "_row"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions("_id", "_hash", "_row")
    index = ranged.select("_id", "_text", F.spark_partition_id().alias("_part")).mapInArrow(run, "part int, seq int, file string, n_docs long, n_ids long")
    index.write.parquet(f"{folder}/index")
    return docs.sparkSession.read.parquet(f"{folder}/index")


SCHEMA = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])


def with_starts(index: DataFrame) -> DataFrame:
    """The index with ``first``: ids of all files before each. Running sums over 1,024 parts, then over those sums."""
    rows = index.withColumn("_run", F.expr("part div 1024"))
    before = Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = rows.groupBy("_run").agg(F.sum("n_ids").alias("_n")).select("_run", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    within = Window.partitionBy("_run").orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_within", F.coalesce(F.sum("n_ids").over(within), F.lit(0)))
    return rows.join(runs, "_run").select("part", "seq", "file", "n_docs", "n_ids", (F.col("_first") + F.col("_within")).alias("first"))


def read_planes(index: DataFrame, folder: str, keep_ids: bool = True) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32, and ids (array) if they are to be kept.

    ``ids_crc32`` is that of the ids as little-endian unsigned 32-bit integers. A file is the unit of work, a
    block and the open document are what a task holds of it.
    """
    files = with_starts(index)
    files = files.repartition(max(1, -(-index.count() // 2)))
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * keep_ids
    kinds = [pa.int64()] * 4 + [pa.list_(pa.int32())] * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(folder)

        def batch_of(rows: list) -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for file, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_input_file(f"{base}/{file}") as raw:
                    reader, rows, held = PlaneReader(raw), [], 0
                    for key, known, ids in zip(reader.keys.tolist(), reader.known.tolist(), reader.documents(), strict=True):
                        row = (key if known else None, first, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))
                        rows.append((*row, ids.astype(np.int32)) if keep_ids else row)
                        first += len(ids)
                        held += len(ids) * keep_ids + 16
                        if held > 1 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                    if rows:
                        yield batch_of(rows)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * keep_ids
    return files.select("file", "first").mapInArrow(run, schema)


def encode_documents(docs: DataFrame, path: str, folder: str | None = None, keep_ids: bool = True, **format) -> DataFrame:
    """Write the ids of every row of ``docs`` (doc_id, text) and read them back: see :func:`read_planes`.

    Every row has a result, also those with a null doc_id or text; an empty table gives an empty result.
    """
    folder = folder or shared_folder(docs.sparkSession) + "/planes"
    return read_planes(write_planes(docs, path, folder, **format), folder, keep_ids)
