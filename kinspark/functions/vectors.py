"""The features of :mod:`kinspark.operators.features` and :mod:`kinspark.operators.relative` over whole entities in NumPy.

A table holds records; pairs are rows of it, those of an entity side by side in order of the candidate's id. What
depends on a record is made once for each record of the table, sets are matrices of term numbers (-1: none).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from kinspark.functions import batches, kernels

#: Pairs compared at once.
AT_ONCE = 2048
NONE = -1


class Terms:
    """Numbers of the terms of columns of texts, and what depends on a term alone."""

    def __init__(self, columns: dict[str, pa.Array]) -> None:
        lists = {x: pc.split_pattern(column, " ") for x, column in columns.items()}
        flat = pa.concat_arrays([pa.array([""], pa.string()), *(x.flatten().cast(pa.string()) for x in lists.values())]).dictionary_encode()
        self.spelling = flat.dictionary.to_pylist()
        number, at = flat.indices.to_numpy(zero_copy_only=False), 1
        #: For each column the numbers of its terms, with repeats, and their rows.
        self.of: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        self.rows = {x: len(column) for x, column in columns.items()}
        for x, own in lists.items():
            row = pc.list_parent_indices(own).to_numpy(zero_copy_only=False)
            terms = number[at : at + len(row)]
            at += len(row)
            self.of[x] = terms[terms > 0], row[terms > 0]  # number 0 is the empty string, which is no term
        self.shapes()

    def matrix(self, x: str) -> np.ndarray:
        """Distinct terms, a row a text."""
        terms, row = self.of[x]
        sizes = np.bincount(row, minlength=self.rows[x])
        out = np.full((self.rows[x], max(int(sizes.max(initial=0)), 1)), NONE, np.int32)
        out[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = terms
        for j in range(1, out.shape[1]):
            out[(out[:, :j] == out[:, j : j + 1]).any(1), j] = NONE
        return out

    def shapes(self) -> None:
        self.length = np.fromiter(map(len, self.spelling), np.int64, len(self.spelling))
        self.letters = np.fromiter(map(kernels.letters, self.spelling), np.uint64, len(self.spelling))
        self.first = np.fromiter((ord(t[:1] or " ") for t in self.spelling), np.int64, len(self.spelling))
        begins: dict[str, int] = {}
        self.begin = np.fromiter((begins.setdefault(t[:3], len(begins)) if len(t) >= 3 else NONE for t in self.spelling), np.int32, len(self.spelling))
        self.place = np.empty(len(self.spelling), np.int64)
        self.place[sorted(range(len(self.spelling)), key=self.spelling.__getitem__)] = np.arange(len(self.spelling))


def grams_of(codes: np.ndarray, lengths: np.ndarray, space: int, n_letters: int) -> np.ndarray:
    """Numbers of the distinct padded trigrams of each string."""
    wide = codes.shape[1]
    padded = np.zeros((len(codes), wide + 3), np.int64)
    padded[:, :2] = space
    padded[:, 2 : wide + 2] = codes
    padded[np.arange(len(codes)), lengths + 2] = space
    base = n_letters + 1
    out = (padded[:, :-2] * base + padded[:, 1:-1]) * base + padded[:, 2:]
    out[(np.arange(wide + 1) > lengths[:, None]) | (lengths == 0)[:, None]] = NONE
    if base**3 < 1 << 31:
        out = out.astype(np.int32)
    out.sort(1)
    out[:, 1:][out[:, 1:] == out[:, :-1]] = NONE
    return out


def size(x: np.ndarray) -> np.ndarray:
    return (x >= 0).sum(1)


def shared_sorted(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Numbers that both rows hold, from one sort; quick where sets are large."""
    both = np.concatenate((x, y), 1)
    both.sort(1)
    return ((both[:, 1:] == both[:, :-1]) & (both[:, 1:] >= 0)).sum(1)


def over(part: np.ndarray, whole: np.ndarray, empty: np.ndarray) -> np.ndarray:
    return np.where(empty, 0.0, part / np.where(empty | (whole == 0), 1, whole))


class Met:
    """Two sets of terms a pair: which are equal, which stand alone."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        self.x, self.y = x, y
        self.in_x, self.in_y = x >= 0, y >= 0
        self.equal = (x[:, :, None] == y[:, None, :]) & self.in_x[:, :, None]
        self.shared_x, self.shared_y = self.equal.any(2), self.equal.any(1)
        self.nx, self.ny, self.shared = self.in_x.sum(1), self.in_y.sum(1), self.shared_x.sum(1)
        self.empty = (self.nx == 0) | (self.ny == 0)
        self.joint = self.nx + self.ny - self.shared

    def jaccard(self) -> np.ndarray:
        return over(self.shared, self.joint, self.empty)

    def containment(self) -> np.ndarray:
        return over(self.shared, np.minimum(self.nx, self.ny), self.empty)

    def masses(self, weight: np.ndarray) -> tuple[np.ndarray, ...]:
        """Sums of weight: of x, of y, of both, of either."""
        wx, wy = np.where(self.in_x, weight[self.x], 0.0), np.where(self.in_y, weight[self.y], 0.0)
        x = wx.sum(1)
        return x, wy.sum(1), np.where(self.shared_x, wx, 0.0).sum(1), x + np.where(self.shared_y, 0.0, wy).sum(1)

    def idf_overlap(self, weight: np.ndarray) -> np.ndarray:
        _, _, both, either = self.masses(weight)
        return over(both, either, self.empty | (either == 0))

    def idf_containment(self, weight: np.ndarray) -> np.ndarray:
        x, y, both, _ = self.masses(weight)
        least = np.minimum(x, y)
        return over(both, least, self.empty | (least <= 0))

    def alone(self) -> np.ndarray:
        """(pair, place in x, place in y) of terms that only one side holds."""
        return (self.in_x & ~self.shared_x)[:, :, None] & (self.in_y & ~self.shared_y)[:, None, :]

    def prefix_overlap(self, terms: Terms, alone: np.ndarray) -> np.ndarray:
        bx, by = np.where(self.in_x, terms.begin[self.x], NONE), np.where(self.in_y, terms.begin[self.y], NONE)
        at, i, j = np.nonzero(alone & (bx[:, :, None] == by[:, None, :]) & (bx >= 0)[:, :, None])
        s = terms.spelling
        right = np.fromiter((s[a].startswith(s[b]) or s[b].startswith(s[a]) for a, b in zip(self.x[at, i].tolist(), self.y[at, j].tolist(), strict=True)), bool, len(at))
        begun = np.zeros(self.x.shape, bool)
        begun[at[right], i[right]] = True
        return over(begun.sum(1), self.joint, self.empty)

    def soft_overlap(self, terms: Terms, weight: np.ndarray, alone: np.ndarray) -> np.ndarray:
        """As :func:`kernels.soft_overlap`."""
        _, _, score, total = self.masses(weight)
        lx, ly = np.where(self.in_x, terms.length[self.x], 0), np.where(self.in_y, terms.length[self.y], 0)
        fx, fy = terms.first[self.x], terms.first[self.y]
        near = (5 * lx[:, :, None] >= 4 * ly[:, None, :]) & (5 * ly[:, None, :] >= 4 * lx[:, :, None])
        at, i, j = np.nonzero(alone & (near | (fx[:, :, None] == fy[:, None, :])))
        a, b = self.x[at, i].astype(np.int64), self.y[at, j].astype(np.int64)
        la, lb, ma, mb = terms.length[a], terms.length[b], terms.letters[a], terms.letters[b]
        left, right = np.bitwise_count(ma & ~mb).astype(np.int64), np.bitwise_count(mb & ~ma).astype(np.int64)
        begin = terms.first[a] == terms.first[b]
        most = np.minimum(la - left, lb - right)
        like = (5 * la >= 4 * lb) & (5 * lb >= 4 * la)
        kept = like & (most * (la + lb) >= np.where(begin, 1.3999, 1.6399) * la * lb)
        kept |= begin & ((la - lb >= 2) & (right == 0) | (lb - la >= 2) & (left == 0))
        at, a, b = at[kept], a[kept], b[kept]
        known, back = np.unique(a * len(terms.spelling) + b, return_inverse=True)
        likeness = credits(terms, known // len(terms.spelling), known % len(terms.spelling))[back]
        some = likeness > 0
        at, a, b, likeness = at[some], a[some], b[some], likeness[some]
        order = np.lexsort((terms.place[b], -likeness, terms.place[a], -weight[a], at))
        gain = likeness * np.minimum(weight[a], weight[b])
        asked: set[tuple[int, int]] = set()
        taken: set[tuple[int, int]] = set()
        for p, x, y, g in zip(at[order].tolist(), a[order].tolist(), b[order].tolist(), gain[order].tolist(), strict=True):
            if (p, x) not in asked and (p, y) not in taken:
                asked.add((p, x))
                taken.add((p, y))
                score[p] += g
        return over(score, total, self.empty | (total <= 0))


def credits(terms: Terms, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """0.9 for abbreviations, the likeness of near spellings, else 0."""
    s = terms.spelling
    x, y = [s[i] for i in a.tolist()], [s[i] for i in b.tolist()]
    out = np.fromiter((0.9 if kernels.abbreviates(p, q) or kernels.abbreviates(q, p) else 0.0 for p, q in zip(x, y, strict=True)), float, len(x))
    la, lb = terms.length[a], terms.length[b]
    own = np.flatnonzero((out == 0) & (5 * la >= 4 * lb) & (5 * lb >= 4 * la))
    order = own[np.argsort(la[own] + lb[own], kind="stable")]
    for start in range(0, len(order), AT_ONCE):
        at = order[start : start + AT_ONCE]
        near = batches.jaro_winklers([x[i] for i in at], [y[i] for i in at])
        out[at] = np.where(near >= 0.88, near, 0.0)
    return out


def partial_ratios(x: np.ndarray, m: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ratio and partial ratio of strings given as codes, the shorter first: strands are combed once, and give the
    common subsequence of the shorter with every window of the longer. A strand that begins above place s and ends
    below place e is one letter of each window from s or before to e or after that is not met.
    """
    wide, rows = y.shape[1], np.arange(len(x))
    ends = np.repeat(np.arange(wide, dtype=np.int16)[:, None], len(x), 1)
    x, y = np.ascontiguousarray(x.T), np.ascontiguousarray(y.T)
    met, low = np.empty(len(rows), bool), np.empty(len(rows), np.int16)
    for i in range(x.shape[0]):
        own = np.where(i < m, x[i], NONE)
        side = np.full(len(rows), -1 - i, np.int16)  # passes by where the shorter string has ended
        for j in range(wide):
            down = ends[j]
            np.equal(own, y[j], out=met)
            np.minimum(side, down, out=low)
            np.copyto(low, down, where=met)
            np.maximum(side, down, out=down) if not met.any() else np.copyto(down, np.where(met, side, np.maximum(side, down)))
            side, low = low, side
    last = np.full((len(rows), wide + 1), wide + 1, np.int64)
    for e in range(wide):
        last[rows, np.where(ends[e] >= 0, ends[e], wide)] = e
    best = np.where((m == 0) & (n == 0), 1.0, 0.0)
    whole = ((ends >= 0) & (np.arange(wide)[:, None] < n)).sum(0)
    missed, padded = np.zeros(len(rows), np.int64), np.concatenate((ends, np.full((1, len(rows)), -1, np.int16)))
    for t in range(1, int((m + n).max(initial=0))):
        first, to = np.maximum(t - m, 0), np.minimum(t, n)
        go = (t < m + n) & (m > 0)
        gone = (t - m >= 1) & (last[rows, np.clip(first - 1, 0, wide)] < np.minimum(t - 1, n))
        come = (t <= n) & (padded[min(t - 1, wide)] >= first)
        missed += come.astype(np.int64) - gone
        length = to - first
        np.maximum(best, np.where(go, 2 * (length - missed) / np.maximum(length + m, 1), 0.0), out=best)
    total = m + n
    return np.where(total > 0, 2 * (n - whole) / np.maximum(total, 1), 1.0), best


class Texts:
    """Codes of a column of strings."""

    def __init__(self, texts: Sequence[str], letters: dict[str, int]) -> None:
        self.texts = texts
        self.codes, self.length = batches._codes(texts, letters)

    def both_partial(self, q: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        whole, part = np.zeros(len(q)), np.zeros(len(q))
        lq, lc = self.length[q], self.length[c]
        short, long = np.where(lq <= lc, q, c), np.where(lq <= lc, c, q)
        order = np.lexsort((self.length[long], self.length[short]))
        for start in range(0, len(q), AT_ONCE):
            at = order[start : start + AT_ONCE]
            m, n = self.length[short[at]], self.length[long[at]]
            codes = self.codes if self.codes.max(initial=0) > 32_000 else self.codes.astype(np.int16)
            whole[at], part[at] = partial_ratios(codes[short[at], : m.max(initial=0)], m, codes[long[at], : n.max(initial=0)], n)
        return whole, part

    def ratios(self, q: np.ndarray, c: np.ndarray, n_letters: int) -> np.ndarray:
        """Indel ratios; letters of an entity's record are placed once for all its pairs."""
        own, rows = np.unique(q, return_inverse=True)
        words = max(-(-int(self.length[own].max(initial=0)) // batches.BITS), 1)
        masks, full = batches._masks(self.codes[own, : words * batches.BITS], self.length[own], n_letters, words), batches._full(self.length[own], words)
        out = np.zeros(len(q))
        order = np.argsort(self.length[c], kind="stable")
        for start in range(0, len(q), AT_ONCE):
            at = order[start : start + AT_ONCE]
            y = np.ascontiguousarray(self.codes[c[at], : self.length[c[at]].max(initial=0)].T)
            met, total = batches._lcs(masks, full, rows[at], y), self.length[q[at]] + self.length[c[at]]
            out[at] = np.where(total > 0, 2 * met / np.maximum(total, 1), 1.0)
        return out

    def jaro_winklers(self, q: np.ndarray, c: np.ndarray) -> np.ndarray:
        out = np.zeros(len(q))
        order = np.lexsort((self.length[c], self.length[q]))
        for start in range(0, len(q), AT_ONCE):
            at = order[start : start + AT_ONCE]
            out[at] = batches.jaro_winklers([self.texts[i] for i in q[at]], [self.texts[i] for i in c[at]])
        return out


def _edits_within_one(x: str, y: str) -> bool:
    if len(x) > len(y):
        x, y = y, x
    if len(y) - len(x) > 1:
        return False
    i = next((i for i, (a, b) in enumerate(zip(x, y, strict=False)) if a != b), len(x))
    return x[i + 1 :] == y[i + 1 :] if len(x) == len(y) else x[i:] == y[i + 1 :]


def _in_order(short: str, long: str) -> bool:
    rest = iter(long)
    return all(c in rest for c in short)


def _drops(x: str, y: str) -> bool:
    """As :func:`similarity.digits_drop`."""
    short, long = (y, x) if len(x) >= len(y) else (x, y)
    return len(long) - len(short) <= 2 and len(short) > 0 and _in_order(short, long)


def number_features(d1: list[str], d2: list[str], h1: str, h2: str, o1: list[str], o2: list[str]) -> dict[str, float]:
    """The features of numbers; terms are distinct."""
    s1, s2 = set(d1), set(d2)
    z1, z2 = (list(dict.fromkeys(x.lstrip("0") or "0" for x in d)) for d in (d1, d2))
    jaccard = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b)) if a and b else 0.0
    out = {"num_jac": jaccard(d1, d2), "num_jac_canon": jaccard(z1, z2), "ordinal_jac": jaccard(o1, o2), "num_shared": float(len(s1 & s2)), "num_exact": float(bool(d1) and s1 == s2)}
    only1, only2 = [x for x in d1 if x not in s2], [y for y in d2 if y not in s1]
    if d1 and d2:
        joint = len(s1 | s2)
        out["num_near"] = sum(any(_edits_within_one(x, y) for y in only2) for x in only1) / joint
        out["num_compat"] = sum(x in z2 or any(_drops(x, y) for y in z2) for x in z1) / min(len(z1), len(z2))
        out["num_prefix_overlap"] = sum(any(min(len(x), len(y)) >= 3 and (x.startswith(y) or y.startswith(x)) for y in only2) for x in only1) / joint
    out["house_exact"] = float(h1 == h2 != "")
    out["house_digit_drop"] = float(h1 != "" and h2 != "" and h1 != h2 and _drops(h1, h2))
    return out


def pair_vectors(columns: dict[str, pa.Array], weights: np.ndarray, q: np.ndarray, c: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """The 50 features of pairs (rows ``q`` and ``c`` of the table) by name; and names, addresses as terms, and idf of the terms.

    ``columns``: n, a, p, k (strings), d, o, r (terms joined by spaces), h. ``weights``: idf of the terms of n, then of a,
    record by record, with repeats; NaN where it isn't known.
    """
    terms, letters = Terms({x: columns[x] for x in "napkr"}), {" ": 1}
    table = {x: column.to_pylist() for x, column in columns.items()}
    own = np.concatenate([terms.of[x][0] for x in "na"])[np.argsort(np.concatenate([terms.of[x][1] for x in "na"]), kind="stable")]
    sets = {x: terms.matrix(x) for x in "napkr"}
    idf = np.full(len(terms.spelling) + 1, np.nan)
    idf[own[~np.isnan(weights)]] = weights[~np.isnan(weights)]
    by = {default: np.where(np.isnan(idf), default, idf) for default in (8.0, 12.0)}
    texts = {x: Texts(table[x], letters) for x in "na"} | {x + "s": Texts([" ".join(sorted(filter(None, t.split(" ")))) for t in table[x]], letters) for x in "na"} | {x: Texts(table[x], letters) for x in "pk"}
    grams = {x: grams_of(texts[x].codes, texts[x].length, 1, len(letters)) for x in "na"}
    n_grams = {x: size(g) for x, g in grams.items()}
    out: dict[str, np.ndarray] = {}
    made: list[dict[str, np.ndarray]] = []
    for start in range(0, len(q), AT_ONCE):
        made.append(_set_features(terms, sets, grams, n_grams, by, q[start : start + AT_ONCE], c[start : start + AT_ONCE]))
    out |= {name: np.concatenate([x[name] for x in made]) for name in made[0]} if made else {}
    for name, x in (("name_exact", "n"), ("addr_exact", "a"), ("name_phon_exact", "p"), ("name_skel_exact", "k")):
        same = columns[x].dictionary_encode().indices.to_numpy(zero_copy_only=False)
        out[name] = ((same[q] == same[c]) & (texts[x].length[q] > 0)).astype(float)
    ln, la = texts["n"].length.astype(float), texts["a"].length
    out["len_n1"], out["len_n2"] = ln[q], ln[c]
    out["len_ratio"] = np.abs(ln[q] - ln[c]) / np.maximum(ln[q] + ln[c], 1.0)
    out["addr_missing"] = ((la[q] == 0) | (la[c] == 0)).astype(float)
    out["name_missing"] = ((ln[q] == 0) | (ln[c] == 0)).astype(float)
    out["name_ratio"], out["name_partial"] = texts["n"].both_partial(q, c)
    for name, x in (("name_token_sort", "ns"), ("addr_ratio", "a"), ("addr_token_sort", "as")):
        out[name] = texts[x].ratios(q, c, len(letters))
    for name, x in (("name_jw", "n"), ("name_phon_jw", "p"), ("name_skel_jw", "k")):
        out[name] = texts[x].jaro_winklers(q, c)
    d, o, h = [t.split() for t in table["d"]], [t.split() for t in table["o"]], table["h"]
    some = {x: np.array([bool(t) for t in table[x]], bool) for x in "doh"}
    out["num_onesided"] = (some["d"][q] != some["d"][c]).astype(float)
    out["house_onesided"] = (some["h"][q] != some["h"][c]).astype(float)
    both = np.flatnonzero((some["d"][q] & some["d"][c]) | (some["o"][q] & some["o"][c]) | (some["h"][q] & some["h"][c]))
    for name in ("num_jac", "num_jac_canon", "ordinal_jac", "num_shared", "num_exact", "num_near", "num_compat", "num_prefix_overlap", "house_exact", "house_digit_drop"):
        out[name] = np.zeros(len(q))
    for at, i, j in zip(both.tolist(), q[both].tolist(), c[both].tolist(), strict=True):
        for name, value in number_features(d[i], d[j], h[i], h[j], o[i], o[j]).items():
            out[name][at] = value
    return out, sets["n"], sets["a"], by[8.0]


def _set_features(terms: Terms, sets: dict, grams: dict, n_grams: dict, by: dict, q: np.ndarray, c: np.ndarray) -> dict[str, np.ndarray]:
    out = {}
    for name, x in (("name", "n"), ("addr", "a")):
        nx, ny, shared = n_grams[x][q], n_grams[x][c], shared_sorted(grams[x][q], grams[x][c])
        out[f"{name}_jac3"] = over(shared, nx + ny - shared, (nx == 0) | (ny == 0))
        met = Met(sets[x][q], sets[x][c])
        out[f"{name}_jac_tok"], out[f"{name}_contain"] = met.jaccard(), met.containment()
        out[f"{name}_idf_overlap"], out[f"{name}_contain_idf"] = met.idf_overlap(by[8.0]), met.idf_containment(by[12.0])
        alone = met.alone()
        out[f"{name}_prefix_overlap"] = met.prefix_overlap(terms, alone)
        out[f"{name}_soft_idf"] = met.soft_overlap(terms, by[12.0], alone)
        if x == "n":
            out["name_sorted_exact"] = ((met.nx == met.shared) & (met.ny == met.shared) & ~met.empty).astype(float)
            out["tok_diff"] = np.abs(met.nx - met.ny).astype(float)
    for name, x in (("name_phon_jac", "p"), ("name_skel_jac", "k")):
        out[name] = Met(sets[x][q], sets[x][c]).jaccard()
    met = Met(sets["r"][q], sets["r"][c])
    out["region_match"] = (met.shared > 0).astype(float)
    out["region_conflict"] = (~met.empty & (met.shared == 0)).astype(float)
    out["region_onesided"] = ((met.nx > 0) != (met.ny > 0)).astype(float)
    return out


def ranks(group: np.ndarray, start: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Places from 0 within each group by falling value; of equals (to nine places, as sums differ by their order) the first comes first."""
    order = np.lexsort((np.arange(len(value)), -np.round(value, 9), group))
    out = np.empty(len(value), np.int64)
    out[order] = np.arange(len(value)) - start[group]
    return out


def relative_vectors(made: dict[str, np.ndarray], group: np.ndarray, base: Sequence[str], key: str) -> dict[str, np.ndarray]:
    """As :func:`relative.relative_features`; ``group``: numbers from 0, rising."""
    start = np.flatnonzero(np.diff(group, prepend=-1))
    n = np.diff(np.append(start, len(group)))
    out: dict[str, np.ndarray] = {}
    for v in base:
        x = made[v]
        best, mean = np.maximum.reduceat(x, start)[group], (np.add.reduceat(x, start) / n)[group]
        spread = np.sqrt(np.add.reduceat((x - mean) ** 2, start) / n)[group]
        out[f"{v}_rank"] = ranks(group, start, x) / np.maximum(n - 1, 1)[group]
        out[f"{v}_gap_best"] = best - x
        out[f"{v}_over_best"] = over(x, best, best <= 0)
        out[f"{v}_z"] = over(x - mean, spread, spread <= 1e-6)
    x = made[key]
    total = lambda test: np.add.reduceat(test.astype(float), start)[group]
    strong = total(x >= 0.9)
    out["n_cands"] = n[group].astype(float)
    out["n_strong"] = total(x > 0.5)
    out["best_overall"], out["mean_overall"] = np.maximum.reduceat(x, start)[group], (np.add.reduceat(x, start) / n)[group]
    out["is_argmax"] = (ranks(group, start, x) == 0).astype(float)
    out["addr_strong_n"] = strong
    out["addr_strong_sole"] = ((x >= 0.9) & (strong == 1)).astype(float)
    return out


def cross_vectors(value: np.ndarray, group: np.ndarray, source: np.ndarray, c: np.ndarray, names: np.ndarray, addresses: np.ndarray, weight: np.ndarray, anchors: int) -> dict[str, np.ndarray]:
    """As :func:`relative.cross_source` and :func:`relative.cross_rank`; ``value``: the key of a pair."""
    start = np.flatnonzero(np.diff(group, prepend=-1))
    n = np.diff(np.append(start, len(group)))
    place = ranks(group, start, value)
    top = np.full((len(start), anchors), NONE, np.int64)
    best = np.flatnonzero(place < anchors)
    top[group[best], place[best]] = best
    out = {"cross_addr": np.zeros(len(c)), "cross_name": np.zeros(len(c))}
    for slot in range(anchors):
        other = top[group, slot]
        own = np.flatnonzero((other >= 0) & (source != source[other]))
        for first in range(0, len(own), AT_ONCE):
            at = own[first : first + AT_ONCE]
            for name, terms in (("cross_addr", addresses), ("cross_name", names)):
                out[name][at] = np.maximum(out[name][at], Met(terms[c[at]], terms[c[other[at]]]).idf_overlap(weight))
    out["cross_addr_rank"] = ranks(group, start, out["cross_addr"]) / np.maximum(n - 1, 1)[group]
    return out
