"""Toxicity scores by weak supervision.

From a bounded sample of labelled rows, lexicon voters (words, word beginnings and, in scripts without spaces,
character pairs and triples that occur in toxic rows far more than chance allows) and pattern voters are made.
A generative label model estimates by expectation maximisation how often each voter speaks in toxic and other
rows, and on which other voter it depends (the tree of largest mutual information given the class). The given
labels choose the lexicon voters, and are one more voter of the model, whose accuracy is estimated like that
of the others, so that a wrong label is overruled. A logistic classifier over the votes is trained on the
posterior labels, drawn towards the voters' log-odds in the label model, and scores every whole text.

Cases: null and empty texts get the score of a text without any evidence; equal texts have equal scores;
very long texts are scored whole, and only their distinct words are held; rows without a label and ids without
a row are not used; of repeated rows of one doc_id one is used in training, and the larger label; where labels
have one class only, the built-in lexicon alone votes; repeated rows stay; ties between voters are settled by
their spelling; empty tables give an empty result; only the named columns are read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinspark.llm._common import BoundedCache, materialize, text_or_empty

#: Rows of each class that voters and classifier are fitted on.
SAMPLE_ROWS = 3000
THRESHOLD = 0.3
PREFIXES = (4, 5, 6, 7, 8, 9)
#: A text without any evidence scores at most this, whatever the share of toxic labels.
MOST_WITHOUT_EVIDENCE = 0.2
LEAST_ROWS = 4
SKETCH = 8
#: Rows of the sample whose units are held at once while they are counted.
ROWS_AT_ONCE = 128
#: The share of chance units that is allowed among the chosen ones.
FALSE_SHARE = 0.02
#: What the model takes the labels' accuracy for before it estimates it.
GOLD_ACCURACY = 0.98
WORD = re.compile(r"\w+")
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff]+")
#: Common English insults, the voters that need no labels.
SEED_WORDS = frozenset({"idiot", "moron", "stupid", "loser", "scum", "trash", "worthless", "pathetic", "disgusting", "clown", "dumb", "fool", "garbage", "filth", "vermin"})
ADDRESS = re.compile(r"\byou(?:'re| are)? (?:all )?(?:such )?(?:an? )?(?:" + "|".join(sorted(SEED_WORDS)) + r")\b", re.I)
PATTERNS = ("seed", "address", "masked", "bangs")
MASKED = re.compile(r"\b(?:[a-z]+[*@$]+[a-z]+)\b", re.I)


def units_of(word: str) -> list[str]:
    """The word and its beginnings, as lexicon units."""
    return [f"={word}", *(f"^{word[:n]}" for n in PREFIXES if len(word) >= n)]


def words_in(low: str) -> list[str]:
    """Words of a lower-case text; runs in scripts without spaces also give their pairs and triples of characters."""
    words = WORD.findall(low)
    if not low.isascii():
        for run in UNSPACED.findall(low):
            words += [run[i : i + n] for n in (2, 3) for i in range(len(run) - n + 1)]
    return words


def words_of(text: str) -> set[str]:
    return set(words_in(text.lower()))


def _tail(k: int, n: int, p: float) -> float:
    """Log of P(Bin(n, p) >= k), by its first term and ratio bound."""
    if k <= n * p:
        return 0.0
    first = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    ratio = (n - k) / (k + 1) * p / (1 - p)
    return min(0.0, first - math.log(max(1e-12, 1 - ratio)))


def distinct_pairs(row_of: np.ndarray, word_of: np.ndarray, code: np.ndarray, n_units: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct pairs (row, unit) in order, of ROWS_AT_ONCE rows at a time; ``code``: the unit of each word, or -1. Rows must rise."""
    if not len(row_of):
        return
    for start in range(0, int(row_of[-1]) + 1, ROWS_AT_ONCE):
        own = slice(*np.searchsorted(row_of, (start, start + ROWS_AT_ONCE)))
        units = code[word_of[own]]
        there = units >= 0
        pairs = np.unique(row_of[own][there].astype(np.int64) * n_units + units[there])
        yield pairs // n_units, pairs % n_units


def choose_units(row_of: np.ndarray, word_of: np.ndarray, vocabulary: pa.Array, toxic: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Units whose share of toxic rows no chance explains, allowing for how many units were looked at; those in most rows first.

    With them, pairs (row, place among them): the rows in which each speaks. ``row_of``, ``word_of``: which row, in rising
    order, has which word of the vocabulary. Units are counted a block of rows at a time, and only the rows of those
    that may be chosen are held, so that beside these two columns memory grows with the vocabulary.
    """
    n_toxic, none = int(toxic.sum()), np.zeros(0, np.int64)
    if not 0 < n_toxic < len(toxic) or not len(vocabulary):
        return [], none, none
    prior, looked_at = n_toxic / len(toxic), 0
    found: list[tuple[float, str, int, np.ndarray]] = []
    for n in (0, *PREFIXES):
        starts = pc.if_else(pc.greater_equal(pc.utf8_length(vocabulary), n), pc.utf8_slice_codeunits(vocabulary, 0, n) if n else vocabulary, None).dictionary_encode()
        spelled, code = starts.dictionary, pc.fill_null(starts.indices, -1).to_numpy(zero_copy_only=False).copy()
        if not len(spelled):
            continue
        all_rows, in_toxic = np.zeros(len(spelled), np.int64), np.zeros(len(spelled), np.int64)
        for rows, units in distinct_pairs(row_of, word_of, code, len(spelled)):
            all_rows += np.bincount(units, minlength=len(spelled))
            in_toxic += np.bincount(units[toxic[rows] == 1], minlength=len(spelled))
        looked_at += int((in_toxic >= LEAST_ROWS).sum())
        pure = (in_toxic >= LEAST_ROWS) & (in_toxic >= 9 * (all_rows - in_toxic))
        if not pure.any():
            continue
        code[(code < 0) | ~pure[code]] = -1
        parts = list(distinct_pairs(row_of, word_of, code, len(spelled)))
        rows, units = (np.concatenate(x) for x in zip(*parts, strict=True))
        held = np.flatnonzero(pure)
        names = {i: f"^{x}" if n else f"={x}" for i, x in zip(held.tolist(), spelled.take(pa.array(held)).to_pylist(), strict=True)}
        order = np.argsort(units, kind="stable")
        cuts = np.flatnonzero(np.diff(units[order])) + 1
        for own in np.split(order, cuts):
            u = int(units[own[0]])
            found.append((_tail(int(in_toxic[u]), int(all_rows[u]), prior), names[u], int(in_toxic[u]), rows[own]))
    found.sort(key=lambda x: x[:2])
    limit = -math.inf  # as many pass as keeps the expected share of chance units (Benjamini and Hochberg)
    for rank, (chance, *_) in enumerate(found, 1):
        if chance <= math.log(FALSE_SHARE * rank / looked_at):
            limit = chance
    alike: dict[bytes, tuple[str, np.ndarray]] = {}
    for _, u, _, rows in sorted((x for x in found if x[0] <= limit), key=lambda x: (-x[2], -len(x[1]), x[1])):
        alike.setdefault(rows[toxic[rows] == 1].tobytes(), (u, rows))  # of units in the same toxic rows, the longest
    chosen = list(alike.values())
    at = [np.full(len(rows), i, np.int64) for i, (_, rows) in enumerate(chosen)]
    return [u for u, _ in chosen], np.concatenate([rows for _, rows in chosen]) if chosen else none, np.concatenate(at) if at else none


def without_copies(words: pa.Array, toxic: np.ndarray) -> np.ndarray:
    """Places of the rows of which no earlier one with that label is a copy: copies are no independent evidence.

    Rows count as copies where the SKETCH words of least hash are the same ones.
    """
    starts = np.asarray(words.offsets, np.int64)
    mixed = np.asarray(words.values.dictionary_encode().indices, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    first: dict[tuple[int, bytes], int] = {}
    for at, label in enumerate(toxic.tolist()):
        first.setdefault((label, np.sort(mixed[starts[at] : starts[at + 1]])[:SKETCH].tobytes()), at)
    return np.array(list(first.values()), np.int64)


@dataclass
class Model:
    units: dict[str, int]
    weights: np.ndarray
    bias: float
    accuracies: dict[str, tuple[float, float]] = field(default_factory=dict)

    def scorer(self):
        """A function of a text, with a bounded memory of tokens."""

        def make(token: str) -> tuple[int, ...]:
            return tuple({self.units[u] for w in words_in(token) for u in units_of(w) if u in self.units})

        known, n_units = BoundedCache(make, 400_000), len(self.units)

        def score(text: str) -> float:
            low = text.lower()
            hits = set()
            for token in set(low.split()):
                if found := known[token]:
                    hits.update(found)
            z = self.bias + sum(self.weights[i] for i in sorted(hits)) + sum(self.weights[n_units + i] for i, on in enumerate(pattern_votes(text, low)) if on)
            return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

        return score


def pattern_votes(text: str, low: str) -> list[bool]:
    seed = any(w in low for w in SEED_WORDS) and not SEED_WORDS.isdisjoint(WORD.findall(low))
    return [seed, seed and ADDRESS.search(text) is not None, ("*" in text or "@" in text) and MASKED.search(text) is not None, low.count("!") * 20 > len(low) > 0]


def dependency_tree(votes: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Of each voter, the voter it depends on, or -1: the tree of largest mutual information given the class.

    Voters that share no row are independent but for chance, so that only pairs that speak together are looked at.
    """
    n, parent = votes.shape[1], np.full(votes.shape[1], -1)
    if n < 2:
        return parent
    information = np.zeros((n, n), np.float32)
    for weight in (q, 1 - q):
        total = weight.sum() + 1
        both = ((votes * weight[:, None]).T @ votes + 0.25) / total
        one = ((votes * weight[:, None]).sum(0) + 0.5) / total
        cells = ((both, one[:, None], one), (one[:, None] - both, one[:, None], 1 - one), (one - both, 1 - one[:, None], one), (1 - one[:, None] - one + both, 1 - one[:, None], 1 - one))
        for joint, left, right in cells:
            joint = np.maximum(joint, 1e-9)
            information += (total * joint * np.log(joint / (left * right))).astype(np.float32)
    information[votes.T @ votes == 0] = 0
    np.fill_diagonal(information, 0)
    inside, best, by = np.zeros(n, bool), np.zeros(n, np.float32), np.full(n, -1)
    for _ in range(n):  # the tree grows by the strongest edge to a voter outside it
        at = int(np.argmax(np.where(inside, -1, best)))
        inside[at], parent[at] = True, by[at]
        better = ~inside & (information[at] > best)
        best[better], by[better] = information[at][better], at
    return parent


def vote_rates(votes: np.ndarray, q: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """(class, parent's vote, voter): how often a voter speaks. Few rows are drawn towards the class's rate."""
    rates = np.empty((2, 2, votes.shape[1]))
    spoken = votes[:, np.maximum(parent, 0)] * (parent >= 0)
    for label, weight in ((0, 1 - q), (1, q)):
        plain = (weight @ votes + 0.5) / (weight.sum() + 1)
        for vote in (0, 1):
            own = weight[:, None] * (spoken == vote)
            rates[label, vote] = ((own * votes).sum(0) + plain) / (own.sum(0) + 1)
    return rates


def log_odds(votes: np.ndarray, rates: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """Log of P(votes | toxic) over P(votes | other) of each row."""
    spoken = (votes[:, np.maximum(parent, 0)] * (parent >= 0)).astype(np.int8)
    out = np.zeros(len(votes))
    for vote in (0, 1):
        yes, no = np.log(rates[1, vote] / rates[0, vote]), np.log((1 - rates[1, vote]) / (1 - rates[0, vote]))
        out += ((spoken == vote) * (votes * yes + (1 - votes) * no)).sum(1)
    return out


def label_model(votes: np.ndarray, gold: np.ndarray, prior: float, rounds: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, tuple[float, float]]:
    """Posterior labels, plain rates of speaking (class, voter), the voters' discounts and parents, and the labels' rates.

    The given labels are one more voter, independent of the others given the class, whose accuracy is estimated
    like theirs: where the others speak clearly, a label can be overruled. As weights of a linear score, the log-odds
    of voters that agree beyond chance given the class are divided by one plus the sum of those correlations.
    """
    votes = votes.astype(np.float32)
    q = np.where(gold == 1, GOLD_ACCURACY, 1 - GOLD_ACCURACY)
    parent = np.full(votes.shape[1], -1)
    rights = (0.5, 0.5)
    for step in range(rounds):
        if step in (0, rounds // 2):
            parent = dependency_tree(votes, q)
        rights = tuple((float(w @ gold) + 0.5) / (float(w.sum()) + 1) for w in (1 - q, q))
        label_odds = np.where(gold == 1, math.log(rights[1] / rights[0]), math.log((1 - rights[1]) / (1 - rights[0])))
        odds = math.log(prior / (1 - prior)) + label_odds + log_odds(votes, vote_rates(votes, q, parent), parent)
        q = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    plain = vote_rates(votes, q, np.full(votes.shape[1], -1))[:, 0]
    centred = votes - q[:, None] * plain[1] - (1 - q)[:, None] * plain[0]
    scale = np.sqrt((centred**2).mean(0)) + 1e-9
    corr = (centred.T @ centred) / max(1, len(votes)) / np.outer(scale, scale)
    np.fill_diagonal(corr, 0)
    return q, plain, 1 / (1 + np.maximum(0, corr - 0.1).sum(1)), parent, rights


def logistic(x: np.ndarray, q: np.ndarray, centre: np.ndarray | None = None, l2: float = 0.3, rounds: int = 60) -> np.ndarray:
    """Weights and, last, the bias, by Newton steps on soft labels; weights are drawn to ``centre`` (zero if not given)."""
    x = np.hstack([x, np.ones((len(x), 1))])
    target = np.zeros(x.shape[1])
    if centre is not None:
        target[:-1] = centre
    ridge = np.full(x.shape[1], l2)
    ridge[-1] = 1e-3

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((np.logaddexp(0, z) - q * z).sum() + (ridge * (w - target) ** 2).sum() / 2)

    w = target.copy()
    w[-1] = math.log(max(q.mean(), 1e-4) / max(1 - q.mean(), 1e-4))
    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(ridge), x.T @ (q - p) - ridge * (w - target))
        size = 1.0
        while size > 1e-4 and loss(w + size * step) > now:
            size /= 2
        w, now = w + size * step, loss(w + size * step)
        if np.abs(size * step).max() < 1e-4:
            break
    return w


def fit(texts: list[str], toxic: list[int], prior: float | None = None) -> Model:
    """``prior``: the share of toxic rows among all labelled ones, where the sample's differs."""
    words = pa.array([sorted(words_of(t)) for t in texts], pa.list_(pa.string()))
    return fit_words(words, [pattern_votes(t, t.lower()) for t in texts], toxic, prior)


def fit_words(words: pa.Array, patterns: list[list[bool]], toxic: list[int], prior: float | None = None) -> Model:
    """As :func:`fit`, from the distinct words (lists of strings) and pattern votes of each text."""
    gold = np.array(toxic, np.int64)
    if not 0 < gold.sum() < len(gold):
        weights = np.zeros(len(PATTERNS))
        weights[0] = 6.0
        return Model({}, weights, -4.0)
    own = without_copies(words, gold)
    words, gold, patterns = words.take(pa.array(own)), gold[own], [patterns[i] for i in own]
    coded = pc.list_flatten(words).dictionary_encode()
    row_of = np.asarray(pc.list_parent_indices(words), np.int32)
    del words
    units, rows, at = choose_units(row_of, np.asarray(coded.indices, np.int32), coded.dictionary, gold)
    del coded, row_of
    votes = np.zeros((len(gold), len(units) + len(PATTERNS)), np.float32)
    votes[rows, at] = 1
    votes[:, len(units) :] = patterns
    share = gold.mean()
    q, rates, discounts, _, _ = label_model(votes, gold, share)
    w = logistic(votes, q, np.log(rates[1] / rates[0]) * discounts)
    real = min(max(prior if prior is not None else share, 1e-4), 1 - 1e-4)
    shift = math.log(real / (1 - real)) - math.log(share / (1 - share))
    names = [*units, *PATTERNS]
    bias = min(float(w[-1] + shift), math.log(MOST_WITHOUT_EVIDENCE / (1 - MOST_WITHOUT_EVIDENCE)))
    return Model({u: i for i, u in enumerate(units)}, w[:-1], bias, {n: (float(rates[1, i]), float(rates[0, i])) for i, n in enumerate(names)})


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on at most ``sample_rows`` labelled rows of each class, those with the least hashes, that are not held out."""
    own = labels.where("toxic is not null and doc_id is not null").where(~held_out("doc_id")).select("doc_id", "toxic").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    own = materialize(own, "labels")
    counts = dict(own.groupBy("toxic").count().collect())
    hashed = own.withColumn("h", F.xxhash64("doc_id"))
    picked = [hashed.where(F.col("toxic") == c).orderBy("h", "doc_id").limit(sample_rows) for c in (0, 1)]
    picked = F.broadcast(picked[0].union(picked[1]).select("doc_id", "toxic"))  # at most twice sample_rows ids
    rows = docs.select("doc_id", text_or_empty("text").alias("text")).join(picked, "doc_id")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() for t in batch.column(1)]
            columns = [pa.array([sorted(words_of(t)) for t in texts], pa.list_(pa.string())), pa.array([pattern_votes(t, t.lower()) for t in texts], pa.list_(pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, batch.column(2)], names=["doc_id", "words", "patterns", "toxic"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    words = rows.select("doc_id", "text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(read, f"doc_id {kind}, words array<string>, patterns array<boolean>, toxic int")
    sample = words.groupBy("doc_id").agg(F.max(F.struct("words", "patterns")).alias("x"), F.max("toxic").alias("toxic")).select("doc_id", "x.words", "x.patterns", "toxic")
    table = sample.toArrow().sort_by("doc_id").combine_chunks()  # at most twice sample_rows rows, of distinct words
    own = {n: table.column(n).combine_chunks() for n in ("words", "patterns", "toxic")}
    del table
    total = sum(counts.values())
    model = fit_words(own.pop("words"), own["patterns"].to_pylist(), own["toxic"].to_pylist(), counts.get(1, 0) / total if total else None)
    pa.default_memory_pool().release_unused()  # the driver has it for the stages that follow
    return model


def score_documents(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), name: str = "score") -> DataFrame:
    """The columns in ``keep`` and the score as ``name``: a map over rows, without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast((model.units, model.weights, model.bias))  # units of the bounded sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Model(*shared.value).scorer()
        for batch in batches:
            scores = pa.array([score(t.as_py()) for t in batch.column(0)], pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(1, batch.num_columns)), scores], names=[*(f"c{i}" for i in range(len(keep))), "score"])

    kinds = ", ".join(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    scored = docs.select(text_or_empty(text_col).alias("_text"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(keep))).mapInArrow(run, f"{kinds}, score double")
    return scored.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(keep)), F.col("score").alias(name))


def judge_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per document ``doc_id, held_out, score, predicted``."""
    scored = score_documents(docs, train(docs, labels))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
