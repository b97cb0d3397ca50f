"""Language identification by a linear-chain conditional random field over words.

Each word has hashed features (beginnings and ends of up to three letters, letter n-grams, entries of
frequent-word lexicons); transitions between the languages of neighbouring words are learned with them.
Training sequences are made from labelled texts of several languages, cut and joined so that languages
switch within a sequence. Forward-backward gives each word its distribution over languages; a document's
language is the one with the largest mean.

Forward-backward runs over segments of fixed length side by side. The product of each segment's transfer
matrices carries messages across segments, so that the result is that of one pass over the whole text.

Cases: a text that is null or has no letter (Unicode category L) is ``und`` with score 0; equal texts have equal results up to
rounding; words longer than WORD_LETTERS letters count as several; very long texts are predicted whole, in
segments; of equal shares the first language in order is taken; without labelled rows everything is ``und``;
repeated rows stay, and rows of one doc_id and language are one in the training sample; an empty table gives
an empty result; only the named columns are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinspark.llm._common import materialize, text_or_empty
from kinspark.llm.bpe import in_groups

#: Bound of the training sample: documents of each language, runs of MEAN_RUN words of each, and words in all.
SAMPLE_DOCS = 400
SAMPLE_RUNS = 16
SAMPLE_WORDS = 120_000
STEPS = 1 << 30
BUCKETS = 1 << 16
WORD_LETTERS = 30
SEGMENT = 64
LEXICON = 150
MEAN_RUN = 25
NO_LETTER = re.compile(r"[\W\d_]+")
ROUNDS, RATE, L2 = 40, 0.15, 1e-4


def word_parts(token: str) -> list[str]:
    """The token's letters in lower case, cut where there are too many."""
    letters = NO_LETTER.sub("", token.lower())
    if not letters.isalpha():  # signs such as a half or a circled one are word characters, but no letters
        letters = "".join(filter(str.isalpha, letters))
    return [letters[i : i + WORD_LETTERS] for i in range(0, len(letters), WORD_LETTERS)]


def feature_ids(words: list[str], lexicon: dict[str, int]) -> np.ndarray:
    """(words, features) of hashed features; -1 where a word has no such feature."""
    width = WORD_LETTERS + 2
    code = np.zeros((len(words), width), np.int64)
    length = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer("".join(w.ljust(WORD_LETTERS, "\0") for w in words).encode("utf-32-le"), np.uint32).reshape(len(words), WORD_LETTERS) if words else np.zeros((0, WORD_LETTERS), np.uint32)
    code[:, 1 : width - 1] = flat
    rows = np.arange(len(words))
    code[:, 0] = 1  # marks of the word's ends
    code[rows, length + 1] = 2
    total = length + 2
    columns = []

    def put(kind: int, value: np.ndarray, there: np.ndarray) -> None:
        mixed = (value * 0x9E3779B1 + kind * 0x85EBCA6B) & 0xFFFFFFFF
        mixed = ((mixed ^ (mixed >> 15)) * 0x2C1B3C6D) & 0xFFFFFFFF
        columns.append(np.where(there, (mixed ^ (mixed >> 13)) % BUCKETS, -1))

    for n in (2, 3):
        for at in range(width - n + 1):
            there = at + n <= total
            if not there.any():
                break
            value = np.zeros(len(words), np.int64)
            for i in range(n):
                value = value * 1_000_003 + code[:, at + i]
            put(n, value & 0xFFFFFFFFFFFF, there)
    for n in (1, 2, 3):
        there = length >= n
        head = tail = np.zeros(len(words), np.int64)
        for i in range(n):
            head = head * 1_000_003 + code[:, 1 + i]
            tail = tail * 1_000_003 + code[rows, np.maximum(length - n + 1 + i, 0)]
        put(10 + n, head & 0xFFFFFFFFFFFF, there)
        put(20 + n, tail & 0xFFFFFFFFFFFF, there)
    known = np.fromiter((lexicon.get(w, 0) for w in words), np.int64, len(words))
    put(30, known, known > 0)
    return np.stack(columns, 1) if columns else np.zeros((0, 1), np.int64)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray
    transitions: np.ndarray
    lexicon: dict[str, int]

    def emissions(self, words: list[str]) -> np.ndarray:
        """Log potentials (words, languages), best at 0."""
        out = np.empty((len(words), len(self.languages)), np.float32)
        padded = np.vstack([self.weights, np.zeros((1, self.weights.shape[1]), self.weights.dtype)])
        for start in range(0, len(words), 20_000):
            ids = feature_ids(words[start : start + 20_000], self.lexicon)
            total = np.zeros((len(ids), padded.shape[1]), np.float32)
            for column in ids.T:
                total += padded[column]  # -1 is the row of zeros
            out[start : start + 20_000] = total
        return out - out.max(1, keepdims=True) if len(words) else out


def _scaled(x: np.ndarray, axes) -> np.ndarray:
    return x / np.maximum(x.sum(axes, keepdims=True), 1e-30)


def segment_marginals(e: np.ndarray, there: np.ndarray, t: np.ndarray, alpha: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """Marginals (segments, steps, languages) given the messages into both ends of each segment.

    ``e``: potentials (segments, steps, languages); ``there`` is false at padding, which changes no message.
    """
    n, steps, size = e.shape
    forward = np.empty_like(e)
    for s in range(steps):
        alpha = np.where(there[:, s, None], _scaled((alpha @ t) * e[:, s], 1), alpha)
        forward[:, s] = alpha
    out = np.empty_like(e)
    for s in range(steps - 1, -1, -1):
        out[:, s] = _scaled(forward[:, s] * beta, 1)
        beta = np.where(there[:, s, None], _scaled((beta * e[:, s]) @ t.T, 1), beta)
    return out


def chain_sums(index: np.ndarray, lengths: np.ndarray, potentials: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Sum of word marginals (sequences, languages) by exact forward-backward.

    ``index``: rows of ``potentials`` of all words, sequence after sequence; ``lengths``: words in each, at least 1.
    """
    size = potentials.shape[1]
    segments = -(-lengths // SEGMENT)
    first = np.concatenate([[0], np.cumsum(segments)[:-1]])
    n = int(segments.sum())
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    place = np.repeat(first * SEGMENT - starts, lengths) + np.arange(len(index))
    there = np.zeros(n * SEGMENT, bool)
    there[place] = True
    e = np.ones((n * SEGMENT, size), np.float32)
    e[place] = potentials[index]
    e, there = e.reshape(n, SEGMENT, size), there.reshape(n, SEGMENT)
    uniform = np.full(size, 1 / size, np.float32)
    alpha, beta = np.tile(uniform, (n, 1)), np.tile(uniform, (n, 1))
    several = np.flatnonzero(segments > 1)
    if several.size:
        members = np.concatenate([np.arange(first[d], first[d] + segments[d]) for d in several])
        product = np.tile(np.eye(size, dtype=np.float32), (len(members), 1, 1))
        em, tm = e[members], there[members]
        for s in range(SEGMENT):
            product = np.where(tm[:, s, None, None], _scaled((product @ t) * em[:, s, None, :], (1, 2)), product)
        at = np.full(n, -1)
        at[members] = np.arange(len(members))
        for rank in range(1, int(segments[several].max())):
            own = several[segments[several] > rank]
            now = first[own] + rank
            alpha[now] = _scaled(np.einsum("nl,nlm->nm", alpha[now - 1], product[at[now - 1]]), 1)
            back = first[own] + segments[own] - 1 - rank
            beta[back] = _scaled(np.einsum("nlm,nm->nl", product[at[back + 1]], beta[back + 1]), 1)
    marginals = segment_marginals(e, there, t, alpha, beta)
    return np.add.reduceat((marginals * there[:, :, None]).sum(1, dtype=np.float64), first, axis=0)


def slopes(scores: np.ndarray, tr: np.ndarray, index: np.ndarray, there: np.ndarray, gold: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood of labelled sequences, and its slopes by word potential and by transition.

    ``scores``: log potentials (words, languages); ``tr``: log transitions; ``index``, ``there``, ``gold``
    (sequences, steps): the word, whether there is one, its language. Padding comes last in a sequence. Before
    the first word every language is as likely.
    """
    size, steps = scores.shape[1], index.shape[1]
    e = np.exp(scores - scores.max(1, keepdims=True))[index]
    e[~there] = 1
    t = np.exp(tr - tr.max())
    uniform = np.full((len(index), size), 1 / size)
    forward, alpha, log_z = np.empty_like(e), uniform, 0.0
    for s in range(steps):
        step = (alpha @ t) * e[:, s]
        total = step.sum(1)
        log_z += np.log(total[there[:, s]]).sum()
        alpha = np.where(there[:, s, None], step / total[:, None], alpha)
        forward[:, s] = alpha
    onehot = np.eye(size)[gold] * there[:, :, None]
    pair_there = there[:, 1:] & there[:, :-1]
    before, after = gold[:, :-1][pair_there], gold[:, 1:][pair_there]
    seen = np.zeros((size, size))
    np.add.at(seen, (before, after), 1)
    into = t.sum(0)
    first = np.bincount(gold[:, 0][there[:, 0]], minlength=size)
    seen += t / into * first  # the language before the first word, given that of the first word
    found = (np.log(e) * onehot).sum() + np.log(t[before, after]).sum() + (first * np.log(into / size)).sum()
    beta, marginal, pairs = uniform, np.empty_like(e), np.zeros((size, size))
    for s in range(steps - 1, -1, -1):
        marginal[:, s] = _scaled(forward[:, s] * beta, 1)
        later = beta * e[:, s]
        joint = (forward[:, s - 1] if s else uniform)[:, :, None] * t * later[:, None, :]
        pairs += (_scaled(joint, (1, 2)) * there[:, s, None, None]).sum(0)
        beta = np.where(there[:, s, None], _scaled(later @ t.T, 1), beta)
    slack = (onehot - marginal * there[:, :, None]).reshape(-1, size)
    by_word = np.stack([np.bincount(index.ravel(), slack[:, c], len(scores)) for c in range(size)], 1)
    return float(found - log_z), by_word, seen - pairs


def fit(texts: list[str], languages: list[str], seed: int = 7) -> Model | None:
    """Maximum likelihood of switched word sequences, by gradient steps with momentum terms (Adam)."""
    names = sorted(set(languages))
    if not names:
        return None
    rng = np.random.default_rng(seed)
    own: dict[str, list[list[str]]] = {n: [] for n in names}
    for text, language in zip(texts, languages, strict=True):
        words = [p for token in text.split() for p in word_parts(token)]
        own[language].append(words)
    counts = {n: Counter(w for words in own[n] for w in set(words)) for n in names}
    lexicon: dict[str, int] = {}
    for i, n in enumerate(names):
        for w, c in counts[n].most_common(LEXICON):
            if all(counts[m][w] / max(1, len(own[m])) < 0.2 * c / max(1, len(own[n])) for m in names if m != n):
                lexicon[w] = i + 1
    pieces: list[tuple[list[str], int]] = []
    share = SAMPLE_WORDS // len(names)
    for i, n in enumerate(names):
        taken = 0
        runs = [words[a : a + MEAN_RUN] for words in own[n] for a in range(0, len(words), MEAN_RUN)]
        for k in rng.permutation(len(runs)):
            cut = runs[k][: max(3, int(rng.geometric(1 / MEAN_RUN)))]
            pieces.append((cut, i))
            taken += len(cut)
            if taken >= share:
                break
    sequence, label = [], []
    for k in rng.permutation(len(pieces)):
        words, i = pieces[k]
        sequence += words
        label += [i] * len(words)
    if not sequence:
        return None
    short = -len(sequence) % SEGMENT
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(sequence))}
    index = np.array([*(vocabulary[w] for w in sequence), *[0] * short]).reshape(-1, SEGMENT)
    there = np.ones(index.size, bool)
    there[len(sequence) :] = False
    there = there.reshape(-1, SEGMENT)
    gold = np.array([*label, *[0] * short]).reshape(-1, SEGMENT)
    ids = feature_ids(list(vocabulary), lexicon)
    size = len(names)
    valid = ids >= 0
    flat, word_of = ids[valid], np.nonzero(valid)[0]
    w, tr = np.zeros((BUCKETS, size)), np.eye(size) * 1.0
    state = [np.zeros_like(x) for x in (w, w, tr, tr)]
    total = there.sum()
    for step in range(1, ROUNDS + 1):
        scores = np.stack([np.bincount(word_of, w[flat, c], len(vocabulary)) for c in range(size)], 1)
        _, by_word, by_pair = slopes(scores, tr, index, there, gold)
        gw = np.stack([np.bincount(flat, by_word[word_of, c], BUCKETS) for c in range(size)], 1) / total - L2 / 100 * w
        gt = by_pair / total - L2 * tr
        for x, g, m, v in ((w, gw, state[0], state[1]), (tr, gt, state[2], state[3])):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            x += RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(names, w.astype(np.float32), np.exp(tr - tr.max()).astype(np.float32), lexicon)


class Predictor:
    """Predicts groups of texts; potentials of words are remembered within a bound."""

    REMEMBERED = 400_000

    def __init__(self, model: Model):
        self.model = model
        self.places: dict[str, int | None] = {}
        self.potentials = np.zeros((0, len(model.languages)), np.float32)

    def _learn(self, tokens: set[str]) -> dict[str, list[int]]:
        """Places of tokens' words; returns tokens of several words apart."""
        if len(self.places) > self.REMEMBERED:
            self.places.clear()
            self.potentials = self.potentials[:0]
        new, words, several = [x for x in tokens if x not in self.places], [], {}
        base = len(self.potentials)
        for token in new:
            parts = word_parts(token)
            if len(parts) > 1:
                several[token] = [base + len(words) + i for i in range(len(parts))]
                self.places[token] = -2
            else:
                self.places[token] = base + len(words) if parts else -1
            words += parts
        self.potentials = np.concatenate([self.potentials, np.exp(self.model.emissions(words))])
        for token in several:
            self.places.pop(token)
        return several

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        split = [t.split() for t in texts]
        several = self._learn(set().union(*split))
        place = self.places.get
        rows, lengths, owners = [], [], []
        for at, tokens in enumerate(split):
            own = np.fromiter((place(x, -2) for x in tokens), np.int64, len(tokens))
            if several and (own == -2).any():
                own = np.array([p for x in tokens for p in (several.get(x) or [place(x, -1)])], np.int64)
            own = own[own >= 0]
            if own.size:
                rows.append(own)
                lengths.append(own.size)
                owners.append(at)
        out = [("und", 0.0)] * len(texts)
        if owners:
            sums = chain_sums(np.concatenate(rows), np.array(lengths), self.potentials, self.model.transitions)
            share = sums / sums.sum(1, keepdims=True)
            for at, best, s in zip(owners, share.argmax(1).tolist(), share.max(1).tolist(), strict=True):
                out[at] = (self.model.languages[best], min(1.0, round(s, 6)))
        return out


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sampled_words(text: str) -> str:
    """At most SAMPLE_RUNS runs of MEAN_RUN words, spread evenly over the whole text."""
    words = [p for token in text.split() for p in word_parts(token)]
    last = len(words) - MEAN_RUN
    if len(words) > SAMPLE_RUNS * MEAN_RUN:
        words = [w for i in range(SAMPLE_RUNS) for w in words[i * last // (SAMPLE_RUNS - 1) :][:MEAN_RUN]]
    return " ".join(words)


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model | None:
    """Fit on runs of at most ``sample_docs`` labelled documents of each language, those with the least hashes, that are not held out.

    Ids are counted by language; hashes that can't be among the least go before the shuffle (four times as many as
    wanted are let through, of which fewer than wanted are not to be met with). What comes to the driver is bounded
    by the sample's parameters.
    """
    own = docs.where("lang is not null and doc_id is not null").where(~held_out("doc_id")).select("doc_id", "lang", F.xxhash64("doc_id").alias("h"))
    counts = materialize(own.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "counts")  # of known size, so that a small one is broadcast and ids stay where they are
    least = own.join(counts, "lang").withColumn("step", F.pmod("h", F.lit(STEPS))).where(F.col("step") <= F.lit(4.0 * sample_docs * STEPS) / F.col("n"))
    order = Window.partitionBy("lang").orderBy("step", "h", "doc_id")
    own = least.withColumn("at", F.row_number().over(order)).where(F.col("at") <= sample_docs)
    picked = materialize(own.select("doc_id", "lang").distinct(), "sample")
    bound = docs.select("doc_id", "lang", text_or_empty("text").alias("text")).join(picked, ["doc_id", "lang"])  # a written table, so that its size decides whether it is broadcast

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([sampled_words(t.as_py()) for t in batch.column(2)], pa.string())], names=["doc_id", "lang", "words"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = bound.mapInArrow(run, f"doc_id {kind}, lang string, words string").groupBy("doc_id", "lang").agg(F.min("words").alias("words")).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["lang"]))
    return fit([r["words"] for r in rows], [r["lang"] for r in rows])


def identify(docs: DataFrame) -> DataFrame:
    """Per document ``doc_id, held_out, lang_pred, score``. A map over rows after training, without a shuffle."""
    model = train(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS weights a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = Predictor(shared.value) if shared.value else None
        for part in in_groups(batches, 1, 2_000_000):
            texts = part.column(1).to_pylist()
            found = predictor.predict(texts) if predictor else [("und", 0.0)] * len(texts)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", text_or_empty("text").alias("text")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
