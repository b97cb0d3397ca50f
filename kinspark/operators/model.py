"""Matching models: labels, samples, splits, boosted trees, out-of-fold scores and the rescored band."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinspark.operators import decide, metrics


@dataclass(frozen=True)
class TreePreset:
    rounds: int = 60
    step: float = 0.05
    depth: int = 5
    least: int = 20
    rows: float = 0.8
    features: str = "0.8"


PRESETS = {"v1": TreePreset(least=100), "v2": TreePreset(depth=6, least=80), "specialist": TreePreset(step=0.03, features="0.7"), "stacked": TreePreset(depth=6, least=80)}


def bucket(key: str, n: int, seed: int = 42) -> Column:
    """A stable number below ``n`` for each entity."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(n)).cast("int")


def label(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """Pairs with ``label`` (1 if true)."""
    return pairs.join(truth.select("q", "c", F.lit(1).alias("label")), ["q", "c"], "left").fillna(0, ["label"])


def downsample_negatives(labelled: DataFrame, share: float, seed: int = 42) -> DataFrame:
    """All true pairs and about ``share`` of the others, by a hash of the pair (no shuffle)."""
    keep = F.pmod(F.xxhash64(F.lit(seed), F.col("q"), F.col("c")), F.lit(1_000_000)) < int(share * 1_000_000)
    return labelled.where((F.col("label") == 1) | keep)


def sample_entities(pairs: DataFrame, share: float, seed: int = 42) -> DataFrame:
    """All pairs of about ``share`` of the entities."""
    return pairs.where(bucket("q", 1_000_000, seed) < int(share * 1_000_000))


def sample_queries(records: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """``n`` entities of each country, those of least hash."""
    order = Window.partitionBy("country").orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), "entity_id")), "entity_id")
    return records.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n).drop("_r")


def split(pairs: DataFrame, train_percent: int = 75, seed: int = 42) -> DataFrame:
    """Pairs with ``validation``: by entity, never by pair."""
    return pairs.withColumn("validation", bucket("q", 100, seed) >= train_percent)


def train(rows: DataFrame, features: list[str], preset: TreePreset = PRESETS["v2"], seed: int = 42) -> GBTClassificationModel:
    """Boosted trees on ``label``, stopping early on ``validation`` rows if that column is there."""
    return fit(VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep").transform(rows), preset, seed)


def fit(made: DataFrame, preset: TreePreset = PRESETS["v2"], seed: int = 42) -> GBTClassificationModel:
    """As :func:`train`, with the vector ``features``."""
    kind = GBTClassifier(featuresCol="features", labelCol="label", maxIter=preset.rounds, stepSize=preset.step, maxDepth=preset.depth, minInstancesPerNode=preset.least, subsamplingRate=preset.rows, featureSubsetStrategy=preset.features, seed=seed)
    if "validation" in made.columns:
        kind = kind.setValidationIndicatorCol("validation")
    return kind.fit(made)


def predict(model: GBTClassificationModel, rows: DataFrame, features: list[str], name: str = "p") -> DataFrame:
    """Rows with the probability ``name``; ValueError where the model was fitted on another number of features."""
    if model.numFeatures != len(features):
        raise ValueError(f"the model has {model.numFeatures} features, {len(features)} are given")
    made = VectorAssembler(inputCols=features, outputCol="_f", handleInvalid="keep").transform(rows).withColumnRenamed("_f", "features")
    return score(model, made, name)


def score(model: GBTClassificationModel, made: DataFrame, name: str = "p") -> DataFrame:
    """As :func:`predict`, with the vector ``features``, which goes."""
    return model.transform(made).withColumn(name, vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def importance(model: GBTClassificationModel, features: list[str], n: int = 20) -> list[tuple[str, float]]:
    ranked = sorted(zip(features, model.featureImportances.toArray().tolist(), strict=True), key=lambda x: (-x[1], x[0]))
    return ranked[:n]


def without_relative(features: list[str]) -> list[str]:
    """The features that don't look at an entity's other candidates."""
    named = {"n_cands", "n_strong", "best_overall", "mean_overall", "is_argmax", "addr_strong_n", "addr_strong_sole", "cross_addr", "cross_name", "cross_addr_rank"}
    return [f for f in features if f not in named and not f.endswith(("_rank", "_gap_best", "_over_best", "_z"))]


def out_of_fold(rows: DataFrame, features: list[str], k: int = 3, preset: TreePreset = PRESETS["v2"]) -> DataFrame:
    """Rows with ``p`` from the model of the other folds; folds are by entity."""
    folded = rows.withColumn("_fold", bucket("q", k))
    out = None
    for fold in range(k):
        model = train(folded.where(F.col("_fold") != fold).drop("validation"), features, preset)
        own = predict(model, folded.where(F.col("_fold") == fold), features)
        out = own if out is None else out.unionByName(own)
    return out.drop("_fold")


def specialist(scored: DataFrame, features: list[str], low: float = 0.05, high: float = 0.95, preset: TreePreset = PRESETS["specialist"]) -> tuple[DataFrame, DataFrame]:
    """Trees for the band, which take the first score ``p`` as a feature: the band with ``p2``, and one row on its validation part.

    ``scored`` has label, validation, p and the features. The report gives the pairs, and AUC and accuracy of p and p2.
    """
    own = band(scored, low, high)
    named = [*features, "p"]
    made = predict(train(own, named, preset), own, named, "p2")
    held = made.where("validation")
    out = held.agg(F.count(F.lit(1)).alias("pairs"), *(F.round(F.avg(((F.col(s) >= 0.5) == (F.col("label") == 1)).cast("double")), 6).alias(f"accuracy_{s}") for s in ("p", "p2")))
    for s in ("p", "p2"):
        out = out.join(metrics.auc(held, s, "label").select(F.col("auc").alias(f"auc_{s}")), F.lit(True), "left")  # one row each
    return made, out


def band(scored: DataFrame, low: float, high: float) -> DataFrame:
    return scored.where((F.col("p") >= low) & (F.col("p") < high))


def rescorer_rows(scored: DataFrame, texts: DataFrame, low: float = 0.05, high: float = 0.95, easy: int = 1000) -> DataFrame:
    """Training rows of a text rescorer: the band, and ``easy`` pairs outside it, half true and half not, by hash."""
    out = scored.withColumn("in_band", ((F.col("p") >= low) & (F.col("p") < high)).cast("int"))
    order = Window.partitionBy("label").orderBy(F.md5(F.concat_ws("|", "q", "c")), "q", "c")
    outside = out.where("in_band = 0").withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= easy // 2).drop("_r")
    kept = out.where("in_band = 1").unionByName(outside)
    text = lambda key, name: texts.select(F.col("entity_id").alias(key), F.concat_ws(" | ", "name_norm", "addr_norm").alias(name))
    return kept.join(text("q", "text_a"), "q").join(text("c", "text_b"), "c").select(F.col("q").alias("s1_id"), F.col("c").alias("cand_id"), "text_a", "text_b", "label", F.col("p").alias("stage1"), "in_band")


Rescorer = Callable[[DataFrame], DataFrame]


def pandas_rescorer(score: Callable) -> Rescorer:
    """A rescorer from a function of two lists of texts; pairs of a batch are given in order of length and put back."""

    def run(batches):
        for batch in batches:
            order = (batch["text_a"].str.len() + batch["text_b"].str.len()).sort_values(kind="stable").index
            made = score(batch.loc[order, "text_a"].tolist(), batch.loc[order, "text_b"].tolist())
            batch.loc[order, "ce"] = made
            yield batch[["q", "c", "ce"]]

    return lambda pairs: pairs.select("q", "c", "text_a", "text_b").mapInPandas(run, "q string, c string, ce double")


def ratio_rescorer() -> Rescorer:
    """The rescorer used where none is given: the indel ratio of both texts."""
    from kinspark.functions.kernels import ratio_udf

    return lambda pairs: pairs.select("q", "c", ratio_udf("text_a", "text_b").alias("ce"))


def cascade(scored: DataFrame, texts: DataFrame, rescore: Rescorer, low: float = 0.05, high: float = 0.95, weight: float = 0.6) -> DataFrame:
    """Scores with the band rescored and blended; only the band's pairs get texts and reach the rescorer."""
    text = lambda key, name: texts.select(F.col("entity_id").alias(key), F.concat_ws(" | ", "name_norm", "addr_norm").alias(name))
    asked = band(scored, low, high).select("q", "c").join(text("q", "text_a"), "q").join(text("c", "text_b"), "c")
    return decide.blend(scored.join(rescore(asked), ["q", "c"], "left"), low, high, weight)
