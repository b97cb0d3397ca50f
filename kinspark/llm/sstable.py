"""Sorted-string-table shards of token ids.

A shard holds documents in ascending key order: zstd blocks of prefix-compressed records, a sparse index
(first key, place and length of each block), a Bloom filter over the keys, and a footer of fixed size that
says where index and filter are. One document is found by a binary search of the index and one block read.

File layout, integers little-endian::

    block*    zstd of records: u16 shared key bytes, u16 own key bytes, u32 ids, own key bytes, ids (u16, or u32 for large vocabularies)
    index     zstd of entries: u16 key length, u64 place, u32 length, key bytes
    filter    bit array
    footer    u64 index place, u64 index length, u64 filter place, u64 filter length, u32 filter hashes, u32 id width, u64 documents, u64 ids, 8-byte magic

Cases: null text counts as empty; a document without text still has its end id; a very long text is one
record, in a block of its own; a null doc_id is the key of length zero and sorts first; repeated doc_ids stay
as records of their own, in order of a digest of their text, and may go over several shards; an empty table
writes no shard and gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinspark.llm._common import materialize, new_folder, text_or_empty

MAGIC = b"KSST0001"
FOOTER = struct.Struct("<QQQQIIQQ8s")
RECORD = struct.Struct("<HHI")
ENTRY = struct.Struct("<HQI")
BLOCK_BYTES = 256 * 1024
BITS_PER_KEY, HASHES = 10, 7
#: A shard holds about this much text; where there is little, as many shards are made as shuffles have partitions, but none under the latter size.
SHARD_BYTES, LEAST_SHARD_BYTES = 128 << 20, 4 << 20
MASK64 = (1 << 64) - 1


def key_of(doc_id: int | None) -> bytes:
    """Eight bytes that sort as the identifier does; none for null."""
    return b"" if doc_id is None else struct.pack(">Q", (doc_id + (1 << 63)) & ((1 << 64) - 1))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def _hash(key: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(key)


def _bloom_places(h: int, bits: int, hashes: int) -> list[int]:
    step = (h >> 32) | 1
    return [((h + i * step) & MASK64) % bits for i in range(hashes)]


def _bloom_filter(hashed: array, bits: int) -> bytes:
    """The filter of all keys with these hashes, a bit a bit."""
    out = np.zeros((bits + 7) // 8, np.uint8)
    for at in range(0, len(hashed), 1 << 16):
        h = np.frombuffer(hashed, np.uint64)[at : at + (1 << 16)]
        step = (h >> np.uint64(32)) | np.uint64(1)
        for i in range(HASHES):
            place = (h + np.uint64(i) * step) % np.uint64(bits)
            np.bitwise_or.at(out, (place >> np.uint64(3)).astype(np.int64), np.left_shift(1, (place & np.uint64(7)).astype(np.int64)).astype(np.uint8))
    return out.tobytes()


def open_store(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder and the path there. Hadoop's names of object stores are those of Arrow's."""
    scheme, colon, rest = folder.partition("://")
    return fs.FileSystem.from_uri(f"s3://{rest}" if colon and scheme in ("s3a", "s3n") else folder)


class Writer:
    """Writes one shard to an open output; keys come in ascending order."""

    def __init__(self, out, id_width: int, level: int = 3):
        import zstandard

        self.out, self.width, self.zstd = out, id_width, zstandard.ZstdCompressor(level=level)
        self.block, self.held, self.first, self.last = [], 0, b"", b""
        self.index, self.hashed, self.place, self.ids = [], array("Q"), 0, 0

    def add(self, key: bytes, ids: bytes) -> None:
        """``ids`` are in the shard's id width."""
        shared = 0
        if self.block:
            most = min(len(key), len(self.last))
            while shared < most and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.first = key
        self.block += [RECORD.pack(shared, len(key) - shared, len(ids) // self.width), key[shared:], ids]
        self.held += len(ids) + RECORD.size + len(key) - shared
        self.last = key
        self.hashed.append(_hash(key))
        self.ids += len(ids) // self.width
        if self.held >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            data = self.zstd.compress(b"".join(self.block))
            self.out.write(data)
            self.index.append((self.first, self.place, len(data)))
            self.place += len(data)
            self.block, self.held = [], 0

    def close(self) -> None:
        self._flush()
        index = self.zstd.compress(b"".join(ENTRY.pack(len(k), place, n) + k for k, place, n in self.index))
        bloom = _bloom_filter(self.hashed, max(64, len(self.hashed) * BITS_PER_KEY))
        self.out.write(index)
        self.out.write(bloom)
        self.out.write(FOOTER.pack(self.place, len(index), self.place + len(index), len(bloom), HASHES, self.width, len(self.hashed), self.ids, MAGIC))


class Reader:
    """Reads a shard through an input file that can seek."""

    def __init__(self, source):
        import zstandard

        self.source, self.zstd = source, zstandard.ZstdDecompressor()
        size = source.size()
        source.seek(size - FOOTER.size)
        at, length, self.bloom_at, self.bloom_length, self.hashes, self.width, self.documents, self.ids, magic = FOOTER.unpack(source.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard of this format")
        source.seek(at)
        data, self.index, place = self.zstd.decompress(source.read(length), max_output_size=1 << 31), [], 0
        while place < len(data):
            n, block_at, block_length = ENTRY.unpack_from(data, place)
            place += ENTRY.size
            self.index.append((data[place : place + n], block_at, block_length))
            place += n
        self.bloom = None

    def _block(self, number: int) -> Iterator[tuple[bytes, memoryview]]:
        _, at, length = self.index[number]
        self.source.seek(at)
        data = memoryview(self.zstd.decompress(self.source.read(length), max_output_size=1 << 31))
        place, key = 0, b""
        while place < len(data):
            shared, own, n = RECORD.unpack_from(data, place)
            place += RECORD.size
            key = key[:shared] + bytes(data[place : place + own])
            place += own
            yield key, data[place : place + n * self.width]
            place += n * self.width

    def __iter__(self) -> Iterator[tuple[bytes, memoryview]]:
        for number in range(len(self.index)):
            yield from self._block(number)

    def get(self, key: bytes) -> list[bytes]:
        """The ids of every record with this key: Bloom filter, binary search of the index, then block reads."""
        if self.bloom is None:
            self.source.seek(self.bloom_at)
            self.bloom = self.source.read(self.bloom_length)
        bits = max(64, self.documents * BITS_PER_KEY)
        if not all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _bloom_places(_hash(key), bits, self.hashes)):
            return []
        firsts, found = [x[0] for x in self.index], []
        number = bisect_right(firsts, key) - 1
        while number > 0 and firsts[number] == key:  # a repeated key may begin in an earlier block
            number -= 1
        for n in range(max(number, 0), len(self.index)):
            if firsts[n] > key:
                break
            found += [bytes(ids) for k, ids in self._block(n) if k == key]
        return found


class WordEncoder:
    """Ids by the tokenizers library. White space is dropped and always parts words there, so that runs between
    spaces are encoded one by one and remembered within a bound.

    Runs of plain Latin characters, which no normal form changes, go straight to the library's merge model;
    any other run goes through the library's whole chain.
    """

    REMEMBERED = 800_000
    PLAIN = re.compile("[!-~\n\u00a1-\u024f]*").fullmatch

    def __init__(self, path: str, end_id: int):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        steps = json.loads(self.tokenizer.to_str())
        self.plain_chain = (
            [x["type"] for x in steps["normalizer"]["normalizers"]] == ["NFC", "Replace", "Lowercase"]
            and (steps["normalizer"]["normalizers"][1]["pattern"], steps["normalizer"]["normalizers"][1]["content"]) == ({"Regex": r"\s+"}, " ")
            and [x["type"] for x in steps["pre_tokenizer"]["pretokenizers"]] == ["Split", "ByteLevel"]
            if steps.get("normalizer", {}).get("type") == steps.get("pre_tokenizer", {}).get("type") == "Sequence"
            else False
        )
        pattern = steps["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] if self.plain_chain else "x"
        self.find = regex.compile(pattern).findall
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.letters = {b: b for b in shown} | {b: 256 + n for n, b in enumerate(hidden)}  # how byte-level models spell bytes
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.kind = np.dtype(f"<u{self.width}")
        self.end = np.array([end_id], self.kind).tobytes()
        self.runs: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        """Ids of what the pattern matches; printable ASCII is spelled as it is. Runs share pieces, as they differ in case and marks."""
        spelled = piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(self.letters)
        ids = self.pieces[piece] = b"".join([token.id.to_bytes(self.width, "little") for token in self.model.tokenize(spelled)])
        return ids

    def _learn(self, missing: list[str]) -> None:
        known, new, find, plain = self.pieces.get, self._piece, self.find, self.PLAIN
        other = []
        for run in missing:
            if self.plain_chain and plain(run):
                self.runs[run] = b"".join([known(piece) or new(piece) for piece in find(run.lower())])
            else:
                other.append(run)
        for run, encoded in zip(other, self.tokenizer.encode_batch(other, add_special_tokens=False), strict=True):
            self.runs[run] = np.array(encoded.ids, self.kind).tobytes()

    def encode_many(self, texts: list[str]) -> list[bytes]:
        split = [t.split(" ") for t in texts]
        wanted: set[str] = set().union(*split)
        if len(self.runs) > self.REMEMBERED:
            self.runs.clear()
            self.pieces.clear()
        self._learn(list(wanted.difference(self.runs)))
        ids_of = self.runs.__getitem__
        return [b"".join(map(ids_of, parts)) + self.end for parts in split]


_ENCODERS: dict[tuple[str, int], WordEncoder] = {}


def _encoder(path: str, end_id: int) -> WordEncoder:
    if (path, end_id) not in _ENCODERS:
        _ENCODERS[path, end_id] = WordEncoder(path, end_id)
    return _ENCODERS[path, end_id]


SHARDS = "path string, first_id long, last_id long, n_docs long, n_tokens long"


def write_shards(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and write all documents; returns one row per shard (:data:`SHARDS`) with ``start``, the ids before it.

    Rows are dealt out by ranges of the identifier and a digest of the text, so that shards don't overlap and
    rows of one identifier can go to several; equal rows can't. The number of shards follows from the size of
    the texts. A shard is written under a temporary name and moved, so that a task run again replaces it whole.
    """
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "sstable")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, context = _encoder(tokenizer_path, end_id), TaskContext.get()
        store, base = open_store(folder)
        name = f"{base}/shard-{context.partitionId():09d}.sst"
        writer, out, first, last = None, None, None, None
        for batch in batches:
            for start in _cuts(batch, 2_000_000):
                part = batch.slice(*start)
                for doc_id, ids in zip(part.column(0).to_pylist(), own.encode_many(part.column(1).to_pylist()), strict=True):
                    if writer is None:
                        store.create_dir(base, recursive=True)
                        out = store.open_output_stream(f"{name}.{context.taskAttemptId()}.tmp")
                        writer, first = Writer(out, own.width), doc_id
                    writer.add(key_of(doc_id), ids)
                    last = doc_id
        if writer is not None:
            writer.close()
            out.close()
            store.move(f"{name}.{context.taskAttemptId()}.tmp", name)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name], pa.string()), pa.array([first], pa.int64()), pa.array([last], pa.int64()), pa.array([len(writer.hashed)], pa.int64()), pa.array([writer.ids], pa.int64())],
                names=["path", "first_id", "last_id", "n_docs", "n_tokens"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // SHARD_BYTES), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // LEAST_SHARD_BYTES)))
    dealt = rows.withColumn("digest", F.xxhash64("text")).repartitionByRange(parts, "id", "digest").sortWithinPartitions("id", "digest").select("id", "text")
    shards = materialize(dealt.mapInArrow(run, SHARDS), "shards")
    before = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)  # a row a shard; names are in order of the ranges
    return shards.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def _cuts(batch: pa.RecordBatch, chars: int) -> Iterator[tuple[int, int]]:
    sizes = np.asarray(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False), np.int64)
    group = np.cumsum(sizes) // chars
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for start, end in zip(cuts, cuts[1:], strict=False):
        if end > start:
            yield start, end - start


def read_shards(shards: DataFrame, folder: str) -> DataFrame:
    """Every document of the shards, from their files: ``doc_id, start, n_tokens, ids_crc32``."""

    names = ["doc_id", "start", "n_tokens", "ids_crc32"]

    def some(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(x), pa.int64()) for x in zip(*rows, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = open_store(folder)
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_input_file(path) as source:
                    reader, rows = Reader(source), []
                    for key, ids in reader:
                        n = len(ids) // reader.width
                        wide = np.frombuffer(ids, f"<u{reader.width}").astype("<u4").tobytes()
                        rows.append((id_of(key), start, n, zlib.crc32(wide)))
                        start += n
                        if len(rows) >= 8192:
                            yield some(rows)
                            rows = []
                if rows:
                    yield some(rows)

    parts = int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return shards.select("path", "start").repartition(parts, "path").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def shard_digests(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the documents as shards in the shared folder, then read those files back."""
    folder = new_folder(docs.sparkSession, "sstable")
    return read_shards(write_shards(docs, tokenizer_path, end_id, folder, id_col, text_col), folder)
