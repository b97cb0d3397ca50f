"""SimHash fingerprints, linked through covering locality-sensitive hashing.

Every bit position i of a fingerprint has a nonzero vector a(i) of radius + 1 bits; table v keeps the
positions where a(i) and v have an odd product. Up to ``radius`` differing positions span less than the
whole space, so some nonzero v is orthogonal to all of them, and the pair collides in that table: no pair
within the radius is missed.

Cases: null and blank texts have fingerprint zero and link like any other; fewer words than a shingle
make one shingle of them all; very long texts are shingled whole, their bits summed in blocks; equal
fingerprints are one node, however many documents hold it; a null doc_id keeps its row and is never a
component's id unless it has no other; an empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinspark.llm._common import fresh, materialize, row_key, text_or_empty
from kinspark.llm.components import connected_components

BITS = 64
SEED = 42
#: Larger buckets are dealt out anew by further bits.
MOST_BUCKET = 20_000


def fingerprint(text: str | None, words: int = 4) -> int:
    """The SimHash of a text's word shingles, repeats included."""
    import xxhash

    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not parts:
        return 0
    joined, digest = b" ".join(parts), xxhash.xxh64_intdigest
    if len(parts) <= words:
        return digest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(parts) - words + 1
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[words - 1 :].tolist(), strict=True)), np.uint64, n)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):
        counts += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.uint32)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def covering_masks(radius: int, bits: int = BITS) -> list[int]:
    """2^(radius+1) - 1 masks; any two words that differ in at most ``radius`` bits agree under one of them."""
    size = (1 << (radius + 1)) - 1
    vectors = [1 + i % size for i in range(bits)]
    return [sum(1 << i for i, a in enumerate(vectors) if (a & v).bit_count() % 2) for v in range(1, size + 1)]


def star_links(members: np.ndarray, radius: int) -> list[tuple[int, np.ndarray]]:
    """Links that join the distinct fingerprints of one bucket as all links within the radius would.

    Each group found by breadth-first search is given as (its least, the others): as many links as members,
    not as pairs. Only fingerprints not reached yet are compared.
    """
    found, rest = [], np.sort(members)
    while rest.size > 1:
        least, rest = rest[0], rest[1:]
        todo, group = [least], []
        while todo and rest.size:
            near = np.bitwise_count(rest ^ todo.pop()) <= radius
            if near.any():
                new = rest[near]
                group.append(new)
                todo.extend(new)
                rest = rest[~near]
        if group:
            found.append((least, np.concatenate(group)))
    return found


def fingerprints(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp`` with the fingerprint's bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.fromiter((fingerprint(t.as_py(), words) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.view(np.int64))], names=["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def chunk_masks(mask: int, radius: int, bits: int = BITS) -> list[int]:
    """The positions that ``mask`` leaves out, in radius + 1 parts: words that differ there in at most ``radius`` agree in one part."""
    free = [i for i in range(bits) if not mask >> i & 1]
    return [sum(1 << i for i in free[part :: radius + 1]) for part in range(radius + 1)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _bucket_search(dealt: DataFrame, radius: int, most: int | None) -> DataFrame:
    """Star links ``a, b`` of the buckets (t, k) of ``dealt``, which come sorted by bucket.

    A bucket of more than ``most`` members isn't searched; its members pass through as rows (t, k, a).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["t", "k", "a", "b"]
        held: list[np.ndarray] = []
        last, large = None, False

        def links(runs: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            left, right = [], []
            for members in runs:
                for least, others in star_links(members, radius):
                    left.append(np.full(others.size, least, np.uint64))
                    right.append(others)
            if left:
                ends = [pa.array(np.concatenate(x).view(np.int64)) for x in (left, right)]
                yield pa.RecordBatch.from_arrays([pa.nulls(len(ends[0]), pa.int16()), pa.nulls(len(ends[0]), pa.int64()), *ends], names=names)

        def passed(bucket: tuple, members: np.ndarray) -> pa.RecordBatch:
            n = len(members)
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, bucket[0], np.int16)), pa.array(np.full(n, bucket[1], np.int64)), pa.array(members.view(np.int64)), pa.nulls(n, pa.int64())], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            t, k, fp = (np.asarray(batch.column(i)) for i in range(3))
            fp = fp.view(np.uint64)
            edges = np.flatnonzero((t[1:] != t[:-1]) | (k[1:] != k[:-1])) + 1
            bounds = np.concatenate([[0], edges, [len(t)]])
            begin = 0
            if last == (t[0], k[0]):  # the bucket began in a batch before
                held.append(fp[: bounds[1]])
                begin = 1
            if begin < len(bounds) - 1:
                if held and not large:
                    yield from links([np.concatenate(held)])
                elif held:
                    yield passed(last, np.concatenate(held))
                inner = np.flatnonzero(np.diff(bounds[begin:-1]) > 1) + begin
                runs = [(fp[bounds[i] : bounds[i + 1]], i) for i in inner]
                yield from links([r for r, _ in runs if most is None or len(r) <= most])
                for r, i in runs:
                    if most is not None and len(r) > most:
                        yield passed((t[bounds[i]], k[bounds[i]]), r)
                held, last, large = [fp[bounds[-2] :]], (t[-1], k[-1]), False
            if large or most is not None and sum(map(len, held)) > most:
                yield passed(last, np.concatenate(held))
                held, large = [], True
        if held:
            yield from links([np.concatenate(held)])

    return dealt.mapInArrow(run, "t short, k long, a long, b long")


def fingerprint_links(distinct: DataFrame, radius: int = 4, most: int = MOST_BUCKET) -> DataFrame:
    """Links ``a, b`` between distinct fingerprints (column ``fp``) whose components are those of all links within the radius.

    Members of a bucket agree in its mask's bits. Where a bucket is large, they are dealt out once more, by each
    of radius + 1 parts of the other bits: a pair within the radius agrees in one of those, so none is missed.
    """
    masks = covering_masks(radius)
    tables = F.array(*(F.struct(F.lit(t).cast("short").alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k")) for t, m in enumerate(masks)))
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def sorted_buckets(rows: DataFrame) -> DataFrame:
        return rows.repartition(parts, "t", "k").sortWithinPartitions("t", "k")

    first = materialize(_bucket_search(sorted_buckets(distinct.select("fp", F.explode(tables).alias("x")).select("x.t", "x.k", "fp")), radius, most), "links")
    links, large = first.where("t is null").select("a", "b"), first.where("t is not null")
    if large.isEmpty():
        return links
    own = F.array(*(F.array(*(F.lit(_signed(c)) for c in chunk_masks(m, radius))) for m in masks))
    parted = large.select("t", "k", "a", F.posexplode(F.element_at(own, F.col("t") + 1)).alias("part", "mask"))
    # A bucket's number is that of its table and part; its key holds the bits of both.
    key = F.col("k").bitwiseOR(F.col("a").bitwiseAND(F.col("mask")))
    second = parted.select((F.col("t") * (radius + 1) + F.col("part")).cast("short").alias("t"), key.alias("k"), F.col("a").alias("fp"))
    return links.union(_bucket_search(sorted_buckets(second), radius, None).select("a", "b"))


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document ``doc_id, fingerprint, component_id, n_linked``.

    ``component_id`` is the least doc_id reachable over links of at most ``radius`` differing bits and
    ``n_linked`` the number of other fingerprints in the component. Exact copies share a fingerprint and are
    reduced to one node before any table is made, so a group of copies of any size is one row in each bucket.
    """
    own = materialize(fingerprints(docs, words, id_col, text_col), "fingerprints")
    nodes = materialize(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    groups = materialize(connected_components(fingerprint_links(nodes.select("fp"), radius)), "groups")
    linked = groups.join(nodes, groups["node"] == nodes["fp"])
    roots = linked.groupBy("root").agg(F.min("least").alias("component"), (F.count(F.lit(1)) - 1).alias("others"))
    known = groups.join(roots, "root").select(F.col("node").alias("fp"), "component", "others")
    labels = nodes.join(known, "fp", "left").select("fp", F.coalesce("component", "least").alias("component_id"), F.coalesce("others", F.lit(0)).alias("n_linked"))
    labels = materialize(labels, "labels")  # so that both sides of the join below are shuffled for it and a frequent fingerprint can be split
    return own.join(labels, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_linked")


def drop_near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component: the one with the least id, and of rows equal in every column one.

    Rows are told apart by id and 128 bits over all columns, so that repeated or null ids do no harm. What is
    joined to the documents is the table of rows to drop.
    """
    key = fresh(docs, "row_key")
    keyed = docs.withColumn(key, row_key(docs.columns))
    named = keyed.select(F.struct(F.col(id_col).alias("id"), F.col(key).alias("key")).alias("doc_id"), F.col(text_col).alias("text"))
    found = near_duplicates(named, words, radius).select(F.col("doc_id.key").alias(key), (F.col("doc_id") != F.col("component_id")).alias("later"))
    judged = materialize(found.groupBy(key).agg(F.max("later").alias("later"), F.count(F.lit(1)).alias("n")).where("later or n > 1"), "dropped")
    kept = keyed.join(judged.select(key).hint("merge"), key, "left_anti").select(*docs.columns)  # one plan at every size
    equal = judged.where("not later").select(key)
    if equal.isEmpty():
        return kept
    return kept.unionByName(keyed.join(equal, key).dropDuplicates([key]).select(*docs.columns))
