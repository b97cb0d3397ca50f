"""All features of a pair, its own and those among its entity's candidates, in one pass over whole entities.

The same as :func:`features.pair_features`, :func:`relative.relative_features` and :func:`relative.cross_source`
one after another, for all of them at once: a record's strings are shuffled to its pairs, and pairs once by entity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinspark.functions import kernels, text
from kinspark.functions import similarity as sim
from kinspark.operators import features, relative

#: The order of the vector.
NAMES = [
    *(f for f in features.FEATURES if f != features.DEAD),
    *(f"{v}_{end}" for v in relative.BASE for end in ("rank", "gap_best", "over_best", "z")),
    "n_cands", "n_strong", "best_overall", "mean_overall", "is_argmax", "addr_strong_n", "addr_strong_sole", "cross_addr", "cross_name", "cross_addr_rank",
]
FORMS = ("n", "a", "p", "k", "d", "h", "o", "r")


def forms(records: DataFrame, idf: DataFrame) -> DataFrame:
    """``id``, the strings that features are made from, and the idf of each token of name and address in their order (null: unknown)."""
    base = records.select("entity_id", F.col("name_norm").alias("n"), F.col("addr_norm").alias("a"), text.tokens("addr_norm").alias("aw"))
    own = base.select(
        "entity_id", "n", "a", text.phonetic("n").alias("p"), text.skeleton("n").alias("k"),
        F.array_join(text.numeric_tokens("a"), " ").alias("d"), sim.house_number(F.col("aw")).alias("h"), F.array_join(sim.ordinals(F.col("aw")), " ").alias("o"),
        F.array_join(kernels.regions_udf(F.slice(F.reverse("aw"), 1, 3)), " ").alias("r"),
    )
    known = own.join(features.idf_maps(records, idf), "entity_id", "left")
    weights = F.transform(F.concat(text.tokens("n"), text.tokens("a")), lambda t: F.element_at("idf", t))
    return known.select(F.col("entity_id").alias("id"), *FORMS, weights.alias("w"))


def pair_vectors(pairs: DataFrame, records: DataFrame, idf: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``q, c``, the columns in ``keep`` and ``vector`` (array, see :data:`NAMES`) for pairs (q, c, source) of ids in ``records``."""
    own = forms(records, idf)
    asked = pairs.select("q", "c", "source", *keep).join(own.withColumnRenamed("id", "c"), "c")
    asking = own.join(pairs.select(F.col("q").alias("id")).distinct(), "id", "left_semi").withColumnRenamed("id", "q")
    both = asked.unionByName(asking, allowMissingColumns=True).select("q", "c", "source", *keep, *FORMS, "w")
    dealt = both.repartition("q").sortWithinPartitions("q", F.asc_nulls_first("c"))
    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema}
    return dealt.mapInArrow(_vectors(keep), ", ".join(f"{c} {kinds[c]}" for c in ("q", "c", *keep)) + ", vector array<double>")


def _vectors(keep: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if left is None else [*left.to_batches(), batch])
            begins = _begins(table)
            if len(begins) and begins[-1]:
                yield from _made(table.slice(0, begins[-1]), keep)
                table = table.slice(begins[-1])
            left = table
        if left is not None:
            yield from _made(left, keep)

    return run


def _begins(table: pa.Table) -> np.ndarray:
    """The rows at which entities begin."""
    number = table["q"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    return np.flatnonzero(np.diff(number, prepend=-1))


def _made(table: pa.Table, keep: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    from kinspark.functions import vectors

    table = table.combine_chunks()
    begins = _begins(table)
    entity = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(table))))
    record = ~table["c"].is_valid().to_numpy(zero_copy_only=False)
    c = np.flatnonzero(~record & record[begins][entity])  # an entity that is no record has no pairs
    if not len(c):
        return
    q = begins[entity[c]]
    source = table["source"].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    weights = table["w"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float)
    made, names, addresses, idf = vectors.pair_vectors({x: table[x].combine_chunks() for x in FORMS}, weights, q, c)
    group = np.unique(q, return_inverse=True)[1]
    made |= vectors.relative_vectors(made, group, relative.BASE, relative.KEY)
    made |= vectors.cross_vectors(made[relative.KEY], group, source[c], c, names, addresses, idf, relative.ANCHORS)
    flat = np.stack([made[name] for name in NAMES], 1).ravel()
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(c) + 1) * len(NAMES), pa.int32()), pa.array(flat))
    own = table.select(["q", "c", *keep]).take(pa.array(c))
    yield from own.append_column("vector", lists).to_batches()
