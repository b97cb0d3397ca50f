"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

Cases: a null text counts as empty and has no ids; equal texts have equal ids; texts of any length are
encoded whole; of equal ranks the leftmost pair is merged first; rows repeat as they come; an empty table
gives an empty result; only the named columns are read, so other columns cannot clash. Ranks must hold every
single byte, so that any text has ids.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinspark.llm._common import text_or_empty

NO_PAIR = 1 << 62
POSITION_BITS = 32
POSITION_MASK = (1 << POSITION_BITS) - 1


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece.

    Leaf i of the tree holds (rank, i) for the pair of the live parts that start at i and at its right
    neighbour; an inner node holds the least of its children, so the root is the leftmost pair of the
    lowest rank. A merge at i touches leaf i, the leaf of the part swallowed, and the leaf of the left
    neighbour: three updates along a path to the root each.
    """
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    if n < 2:
        return [ranks[piece]] if n else []
    get = ranks.get
    size = 1 << (n - 2).bit_length() if n > 2 else 1
    tree = [NO_PAIR] * (2 * size)
    for i in range(n - 1):
        rank = get(piece[i : i + 2])
        if rank is not None:
            tree[size + i] = rank << POSITION_BITS | i
    for node in range(size - 1, 0, -1):
        left, right = tree[2 * node], tree[2 * node + 1]
        tree[node] = left if left < right else right
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))

    def put(leaf: int, value: int) -> None:
        node = size + leaf
        tree[node] = value
        while node > 1:
            other = tree[node ^ 1]
            node >>= 1
            least = value if value < other else other
            if tree[node] == least:
                return
            tree[node] = value = least

    while tree[1] != NO_PAIR:
        i = tree[1] & POSITION_MASK
        j = after[i]
        k = after[j]
        after[i] = k
        if j < n - 1:
            put(j, NO_PAIR)
        if k < n:
            before[k] = i
            rank = get(piece[i : after[k]])
            put(i, NO_PAIR if rank is None else rank << POSITION_BITS | i)
        else:
            put(i, NO_PAIR)
        h = before[i]
        if h >= 0:
            rank = get(piece[h:k])
            put(h, NO_PAIR if rank is None else rank << POSITION_BITS | h)
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : after[i]]])
        i = after[i]
    return ids


class MergeTable:
    """Merges many pieces side by side: each has a segment tree of its own, and all take their next step together."""

    ROWS = 8192

    def __init__(self, ranks: dict[bytes, int]):
        if any(bytes([i]) not in ranks for i in range(256)):
            raise ValueError("ranks lack single bytes")
        self.ranks = ranks
        self.width = max(ranks.values(), default=0) + 1
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left * self.width + right)
                    values.append(rank)
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.keys = np.append(np.array(keys, np.int64)[order], np.int64(NO_PAIR))
        self.values = np.append(np.array(values, np.int64)[order], 0)
        self.of_byte = np.array([ranks[bytes([i])] for i in range(256)], np.int64)

    def leaves(self, left: np.ndarray, right: np.ndarray, at: np.ndarray, there: np.ndarray) -> np.ndarray:
        """(rank, position) of the pairs, or NO_PAIR where there is none."""
        wanted = left * self.width + right
        found = np.searchsorted(self.keys, wanted)
        return np.where(there & (self.keys[found] == wanted), self.values[found] << POSITION_BITS | at, NO_PAIR)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece, as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(pieces)
        classes: dict[int, list[int]] = {}
        for at, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is not None:
                out[at] = whole.to_bytes(4, "little")
            elif len(piece) > 64:
                out[at] = np.array(merge_piece(piece, self.ranks), "<u4").tobytes()
            else:
                classes.setdefault(max(2, 1 << (len(piece) - 1).bit_length()), []).append(at)
        for size, members in classes.items():
            for start in range(0, len(members), self.ROWS):
                part = members[start : start + self.ROWS]
                for at, ids in zip(part, self._together([pieces[i] for i in part], size), strict=True):
                    out[at] = ids
        return out

    def _together(self, pieces: list[bytes], size: int) -> list[bytes]:
        rows = len(pieces)
        length = np.fromiter(map(len, pieces), np.int64, rows)
        token = np.zeros((rows, size + 1), np.int64)
        token[:, :size] = self.of_byte[np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), np.uint8).reshape(rows, size)]
        place = np.arange(size)
        alive = place < length[:, None]
        after = np.tile(np.arange(1, size + 2), (rows, 1))
        before = np.tile(np.arange(-1, size), (rows, 1))
        tree = np.full((rows, 2 * size), NO_PAIR, np.int64)
        tree[:, size:] = self.leaves(token[:, :size], token[:, 1:], place, place + 1 < length[:, None])
        node = size
        while node > 1:
            node //= 2
            tree[:, node : 2 * node] = np.minimum(tree[:, 2 * node : 4 * node : 2], tree[:, 2 * node + 1 : 4 * node : 2])
        flat, wide = tree.reshape(-1), 2 * size
        row = np.flatnonzero(tree[:, 1] != NO_PAIR)
        while row.size:
            root = tree[row, 1]
            i = root & POSITION_MASK
            j = after[row, i]
            k = after[row, j]
            end = length[row]
            h = before[row, i]
            token[row, i] = merged = root >> POSITION_BITS
            after[row, i] = k
            before[row, k] = i
            alive[row, j] = False
            first = np.maximum(h, 0)
            base = row * wide
            updates = (
                (j, np.full(row.size, NO_PAIR, np.int64), base),
                (i, self.leaves(merged, token[row, k], i, k < end), base),
            )
            has = np.flatnonzero(h >= 0)
            updates += ((h[has], self.leaves(token[row[has], first[has]], merged[has], h[has], np.ones(has.size, bool)), base[has]),)
            for leaf, value, origin in updates:
                at = leaf + size
                flat[origin + at] = value
                while size > 1 and at.size and at[0] > 1:
                    up = at >> 1
                    flat[origin + up] = value = np.minimum(value, flat[origin + (at ^ 1)])
                    at = up
            row = row[tree[row, 1] != NO_PAIR]
        ids = token[:, :size][alive].astype("<u4").tobytes()
        ends = (np.cumsum(alive.sum(1)) * 4).tolist()
        return [ids[x:y] for x, y in zip([0, *ends], ends, strict=False)]


class Encoder:
    """Encodes texts in groups; what a run of text between single spaces gives is remembered, within a bound."""

    REMEMBERED = 500_000

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.table = MergeTable(ranks)
        # White space as the Unicode property, as the rank files' library takes it.
        self.find = regex.compile(pattern.replace(r"\S", r"\P{White_Space}").replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}")).findall
        self.pieces: dict[str, bytes] = {}
        self.runs: dict[str, bytes | None] = {}
        self.token_bytes = [b""] * self.table.width
        for token, rank in ranks.items():
            self.token_bytes[rank] = token

    def _learn(self, pieces: set[str]) -> None:
        missing = [p for p in pieces if p not in self.pieces]
        if len(self.pieces) + len(missing) > self.REMEMBERED:
            self.pieces.clear()
            missing = list(pieces)
        self.pieces.update(zip(missing, self.table.merge([p.encode() for p in missing]), strict=True))

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        split = [t.split(" ") for t in texts]
        runs: set[str] = set().union(*(s[1:] for s in split))
        if len(self.runs) > self.REMEMBERED:
            self.runs.clear()
        found: dict[str, list[str]] = {}
        for run in runs.difference(self.runs):
            if not run or run[0].isspace() or run[-1].isspace():
                self.runs[run] = None  # the space before it may belong to a longer run of white space
            else:
                found[run] = self.find(" " + run)
        firsts = [self.find(s[0]) for s in split]
        self._learn(set().union(*found.values(), *firsts))
        ids_of = self.pieces.__getitem__
        for run, pieces in found.items():
            self.runs[run] = b"".join(map(ids_of, pieces))
        out, whole = [], {}
        for at, (parts, first) in enumerate(zip(split, firsts, strict=True)):
            rest = list(map(self.runs.__getitem__, parts[1:]))
            if not texts[at] or parts[0][-1:].isspace() or not parts[0] and len(parts) > 1 or None in rest:
                out.append(b"")  # two white-space characters in a row: the pattern decides over the whole text
                whole[at] = self.find(texts[at])
            else:
                out.append(b"".join(map(ids_of, first)) + b"".join(rest))
        for at, pieces in whole.items():
            self._learn(set(pieces))
            out[at] = b"".join(map(self.pieces.__getitem__, pieces))
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, memoryview(ids).cast("I")))


def in_groups(batches: Iterator[pa.RecordBatch], text_at: int, chars: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices of at most about so many characters, so that memory stays bounded."""
    for batch in batches:
        sizes = np.asarray(pc.binary_length(batch.column(text_at)).to_numpy(zero_copy_only=False), np.int64)
        group = np.cumsum(sizes) // chars
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for start, end in zip(cuts, cuts[1:], strict=False):
            if end > start:
                yield batch.slice(start, end - start)


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(ranks_path: str, pattern: str) -> Encoder:
    """One encoder for each worker process and rank file."""
    key = (ranks_path, pattern)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(load_ranks(ranks_path), pattern)
    return _ENCODERS[key]


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: its ids, their bytes decoded again. Columns ``id_col, ids array<int>, decoded binary``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(ranks_path, pattern)
        for part in in_groups(batches, 1, 1_000_000):
            ids = own.encode_many(part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([memoryview(x).cast("i").tolist() if x else [] for x in ids], pa.list_(pa.int32())), pa.array([own.decode(x) for x in ids], pa.binary())],
                names=["id", "ids", "decoded"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).mapInArrow(run, f"id {kind}, ids array<int>, decoded binary").withColumnRenamed("id", id_col)


def encode_digests(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """As :func:`encode_documents`, but counts and digests: ``id_col, n_tokens, ids_sha256, decoded_sha256``, and ``ids`` if asked for.

    A map over rows: no shuffle, and a lost task is run again from its input split.
    """
    names = ["id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if with_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(ranks_path, pattern)
        for part in in_groups(batches, 1):
            ids = own.encode_many(part.column(1).to_pylist())
            columns = [
                part.column(0),
                pa.array([len(x) // 4 for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                pa.array([hashlib.sha256(own.decode(x)).hexdigest() for x in ids], pa.string()),
            ]
            if with_ids:
                ends = np.cumsum([0, *(len(x) // 4 for x in ids)], dtype=np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<i4"))))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    return docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)
