"""Toxicity by a string-kernel support vector machine with Nyström landmarks.

The kernel is the gap-weighted subsequence kernel of order three over the words
of sentences, with boundary marks: every ordered triple of letters counts by
``DECAY`` to the power of the stretch it spans. Letters that are inserted, and
marks or spaces between letters, only make stretches longer: a mark takes a
place but is no symbol of a triple. So "idxiot", "i.d.i.o.t" and "i d i o t"
stay close to the plain word by the kernel alone. Landmarks are words of the
training sentences; the machine is linear in the Nyström features, trained on
the words that tell in sentences of labelled documents (the most toxic word of
a toxic sentence, all of a clean one). Since the landmarks are fixed, the
trained function of a word is one weighted sum over its own triples divided by
its norm, which is exact and costs one table lookup for each triple.

A document's evidence are its words on the toxic side, each weighed by how much
its nearest landmark tells in the training texts (log of the share of toxic texts
with such words over that of clean ones). The score is a logistic function of the
strongest word and of the sum, with weights that can't be negative, and a rising
map to shares; so more evidence never lowers it. Both are fitted on documents
that the machine which scored them has not seen.

An insult may also be cut by spaces and marks into several words, or stand inside
of a longer word. Landmarks that only toxic texts hold are therefore looked for
in the letters of the whole text, with up to GAP marks or spaces between two of
them; a stretch that is found so is scored by the kernel like a word, its marks
and spaces left out.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, sliced

DECAY = 0.6
LONGEST = 14
#: Labelled rows that are read for the fit: at most so many of either class.
MAX_TOXIC, MAX_CLEAN = 1000, 2000
LANDMARKS = 96
#: The most that a landmark weighs, and from where on it is looked for across words.
MOST, CLEAR = 6.0, 4.5
#: Marks and spaces between two letters of an insult.
GAP = 3
#: Landmarks of which KIN are alike by so much make no place for another one like them.
ALIKE, KIN = 0.5, 6
#: Words whose features are in memory at once.
NEAR = 128
#: Decision values that are no evidence yet.
FLOOR = 0.3
#: Decision values from which a word tells how much its landmark is worth.
SURE = 0.7
#: Single letters in a row stand as one word.
_SPACED = re.compile(r"(?<!\S)\w(?:[ \t]\w){2,}(?!\S)")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


# -------------------------------------------------------------- words


def tokens(text: str) -> set[str]:
    """Words of a text in lower case, as they are written; single letters in a row are also one word, spaces included."""
    lower = text.lower()
    found = set(lower.split())
    if _SPACED.search(lower):
        found.update(m[0] for m in _SPACED.finditer(lower))
    return found


def trim(word: str) -> str:
    """A word without the marks around it; those inside stay."""
    if word.isalnum():
        return word
    low, high = 0, len(word)
    while low < high and not word[low].isalnum():
        low += 1
    while high > low and not word[high - 1].isalnum():
        high -= 1
    return word[low:high]


def pieces(word: str) -> list[str]:
    """A word as it is, or for long ones the different overlapping stretches that cover it."""
    if len(word) <= LONGEST:
        return [word]
    step = LONGEST // 2
    return list(dict.fromkeys(word[i : i + LONGEST] for i in range(0, len(word) - step, step)))


# Symbols: 1 and 2 are the boundaries, 3 to 28 a to z, 29 a digit, 30 to 62 the rest of Latin-1 in lower case, 63 to 70 all other letters; 0 is a gap.
SYMBOLS = 71


def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Words as rows of symbols, with 0 for marks and spaces and after the end, and their lengths; the boundaries are included."""
    size = np.fromiter((len(w) + 2 for w in words), dtype=np.int64, count=len(words))
    code = np.frombuffer("".join([f"\x01{w}\x02" for w in words]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    symbol = np.where(code <= 2, code, 63 + code % 8)
    for low, high, base in ((0x61, 0x7A, 3), (0xDF, 0xFF, 30)):
        inside = (code >= low) & (code <= high)
        symbol[inside] = base + code[inside] - low
    symbol[(code >= 0x30) & (code <= 0x39)] = 29
    different, which = np.unique(code, return_inverse=True)
    symbol[np.array([c > 2 and not chr(c).isalnum() for c in different.tolist()], dtype=bool)[which]] = 0
    rows = np.zeros((len(words), int(size.max()) if len(words) else 0), dtype=np.int64)
    at = np.repeat(np.arange(len(words)), size)
    rows[at, np.arange(len(code)) - np.repeat(np.cumsum(size) - size, size)] = symbol
    return rows, size


# -------------------------------------------------------------- kernel


def kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Order-three subsequence kernel of equally many encoded words, row by row, by the usual recursion."""
    n = a.shape[0]
    before = np.ones((n, a.shape[1] + 1, b.shape[1] + 1))
    for order in (1, 2):
        now = np.zeros_like(before)
        for i in range(a.shape[1]):
            run = np.zeros(n)
            for j in range(b.shape[1]):
                same = (a[:, i] == b[:, j]) & (a[:, i] > 0)
                run = DECAY * (run + DECAY * np.where(same, before[:, i, j], 0))
                now[:, i + 1, j + 1] = DECAY * now[:, i, j + 1] + run
        before = now
    total = np.zeros(n)
    for i in range(a.shape[1]):
        for j in range(b.shape[1]):
            same = (a[:, i] == b[:, j]) & (a[:, i] > 0)
            total += np.where(same, DECAY * DECAY * before[:, i, j], 0)
    return total


def _triples(width: int) -> list[tuple[int, int, int, float]]:
    return [(i, j, k, DECAY ** (k - i + 1)) for i, j, k in combinations(range(width), 3)]


def feature_rows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Explicit features of encoded words: word, triple and weight of every subsequence."""
    who, what, weight = [], [], []
    for i, j, k, w in _triples(rows.shape[1]):
        full = np.flatnonzero((rows[:, i] > 0) & (rows[:, j] > 0) & (rows[:, k] > 0))
        who.append(full)
        what.append((rows[full, i] * SYMBOLS + rows[full, j]) * SYMBOLS + rows[full, k])
        weight.append(np.full(len(full), w))
    if not who:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    return np.concatenate(who), np.concatenate(what), np.concatenate(weight)


def norms(rows: np.ndarray, chunk: int = 2048) -> np.ndarray:
    """Square roots of the kernel of each word with itself, by the recursion of ``kernel`` for many words at once."""
    n, width = rows.shape
    out = np.ones(n)
    for at in range(0, n, chunk):
        col = np.ascontiguousarray(rows[at : at + chunk].T)
        step = np.array([[(col[i] == col[j]) & (col[i] > 0) for j in range(width)] for i in range(width)], dtype=np.float64) * DECAY**2
        before = step.copy()
        for _ in (2, 3):
            # before[i, j]: weight of all matches of one order less that end at i and j.
            reach = np.zeros((width + 1, width + 1, col.shape[1]))
            for i in range(width):
                run = np.zeros(col.shape[1])
                for j in range(width):
                    run = DECAY * run + before[i, j]
                    reach[i + 1, j + 1] = DECAY * reach[i, j + 1] + run
            before = step * reach[:width, :width]
        out[at : at + chunk] = np.sqrt(np.maximum(before.sum(axis=(0, 1)), 1e-12))
    return out


@dataclass
class Landmarks:
    """Words that the machine knows others by."""

    words: list[str]
    weights: np.ndarray
    triples: np.ndarray  # all triples of landmarks, ascending
    features: np.ndarray  # of each landmark, by triple, of length 1
    reliance: np.ndarray  # how much each tells, from 0 to MOST

    def __iter__(self) -> Iterator:
        """Words and weights."""
        return iter((self.words, self.weights))

    def nearest(self, words: list[str]) -> np.ndarray:
        """The most similar landmark of each word."""
        out = np.zeros(len(words), dtype=np.int64)
        for at in range(0, len(words), NEAR):
            rows, _ = encode(words[at : at + NEAR])
            who, what, weight = feature_rows(rows)
            place = np.searchsorted(self.triples, what)
            place[place == len(self.triples)] = 0
            on = self.triples[place] == what
            like = np.zeros((len(rows), len(self.triples)))
            np.add.at(like, (who[on], place[on]), weight[on])
            out[at : at + NEAR] = np.argmax(like @ self.features.T, axis=1)
        return out

    def pattern(self) -> re.Pattern | None:
        clear = [w for w, r in zip(self.words, self.reliance, strict=True) if r >= CLEAR and w.isalpha() and len(w) > 3]
        return re.compile("|".join(rf"[\W_]{{0,{GAP}}}".join(w) for w in clear)) if clear else None


@dataclass
class Model:
    table: np.ndarray  # weight of each triple of symbols
    bias: float
    calibration: np.ndarray  # intercept and weights of the features of ``pool``
    steps: tuple[np.ndarray, np.ndarray] | None = None  # rising map from that sum to a probability
    landmarks: Landmarks | None = None  # from which the table was made

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Decision values of trimmed words; empty words are as clean as can be."""
        out = np.full(len(words), -1.0)
        parts = [(i, p) for i, w in enumerate(words) for p in pieces(w) if w]
        if not parts:
            return out
        texts = [p for _, p in parts]
        where, lengths = np.array([i for i, _ in parts]), np.array([len(p) for p in texts])
        for size in np.unique(lengths):
            pick = np.flatnonzero(lengths == size)
            for i in range(0, len(pick), 10_000):
                chunk = pick[i : i + 10_000]
                rows, _ = encode([texts[c] for c in chunk])
                total = np.zeros(len(chunk))
                for a, b, c, w in _triples(rows.shape[1]):
                    total += w * self.table[(rows[:, a] * SYMBOLS + rows[:, b]) * SYMBOLS + rows[:, c]]
                np.maximum.at(out, where[chunk], total / norms(rows) + self.bias)
        return out

    def strengths(self, words: list[str], scores: np.ndarray) -> np.ndarray:
        """Evidence of trimmed words: their decision values above FLOOR, times what their nearest landmark tells."""
        out = np.maximum(scores - FLOOR, 0.0) / (1 - FLOOR)
        told = np.flatnonzero(out > 0)
        if len(told) and self.landmarks is not None:
            # Of a long word the piece that scores highest counts.
            parts = [max(parts, key=lambda p, g=dict(zip(parts, self.word_scores(parts), strict=True)): g[p]) if len(parts := pieces(words[i])) > 1 else parts[0] for i in told]
            out[told] *= self.landmarks.reliance[self.landmarks.nearest(parts)]
        return out

    def evidence(self, features: np.ndarray) -> np.ndarray:
        return self.calibration[0] + features @ self.calibration[1:]

    def probability(self, features: np.ndarray) -> np.ndarray:
        z = np.clip(self.evidence(features), -30, 30)
        plain = 1.0 / (1.0 + np.exp(-z))
        # A small share of the plain logistic keeps the order where the map is flat.
        return plain if self.steps is None else 0.98 * np.interp(z, *self.steps) + 0.02 * plain


# ------------------------------------------------------------ training


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 10.0, steps: int = 30) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, by Newton steps on the active rows."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w, ridge = np.zeros(x1.shape[1]), np.eye(x1.shape[1])
    ridge[-1, -1] = 1e-6
    active = None
    for _ in range(steps):
        now = y * (x1 @ w) < 1
        if active is not None and (now == active).all():
            break
        active = now
        xa, wa = x1[active], weight[active] * c
        w = np.linalg.solve(ridge + xa.T @ (xa * wa[:, None]), xa.T @ (wa * y[active]))
    return w[:-1], float(w[-1])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    x1, w = np.hstack([np.ones((len(x), 1)), x]), np.zeros(x.shape[1] + 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        step = np.linalg.solve((x1 * (p * (1 - p) + 1e-9)[:, None]).T @ x1 + ridge * np.eye(len(w)), x1.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _rising_logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic weights of which none but the first is negative: features that would lower the score are left out."""
    used = list(range(x.shape[1]))
    while True:
        w = _logistic(x[:, used], y)
        if not used or w[1:].min() >= 0:
            out = np.zeros(x.shape[1] + 1)
            out[[0, *[i + 1 for i in used]]] = w
            return out
        used.pop(int(np.argmin(w[1:])))


def _rising(z: np.ndarray, y: np.ndarray, least: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression: middles of pools of at least ``least`` rows, and their shares of ones."""
    order = np.argsort(z, kind="stable")
    pools: list[list[float]] = []
    for i in range(0, len(z), least):
        part = order[i : i + least]
        pools.append([float(y[part].sum()), float(len(part)), float(z[part].sum())])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    # Shares are drawn in a little, which may not undo the order.
    return np.array([p[2] / p[1] for p in pools]), np.maximum.accumulate([(p[0] + 0.1) / (p[1] + 0.2) for p in pools])


def pool(strengths: np.ndarray, words: int) -> tuple[float, float, float]:
    """Features of a text: its strongest word, the log of the sum of all, and the log of that sum in a hundred different words."""
    if not len(strengths):
        return 0.0, 0.0, 0.0
    total = float(strengths.sum())
    return float(strengths.max()), float(np.log1p(total)), float(np.log1p(100 * total / max(words, 20)))


def _sentences(texts: list[str]) -> tuple[list[list[np.ndarray]], list[str]]:
    """Sentences of each text as sorted numbers of their words, and the words."""
    index: dict[str, int] = {}
    found = [[np.array(sorted({index.setdefault(w, len(index)) for w in sorted({trim(w) for w in tokens(s)} - {""})}), dtype=np.int32) for s in _SENTENCE.split(t)] for t in texts]
    return [[s for s in doc if len(s)] for doc in found], list(index)


def _bags(sentences: list[list[np.ndarray]]) -> list[np.ndarray]:
    return [np.unique(np.concatenate(doc)) if doc else np.empty(0, np.int32) for doc in sentences]


def _normed(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Triples of words, ascending, and features of length 1 of each word by triple."""
    rows, _ = encode(words)
    who, what, weight = feature_rows(rows)
    triples, column = np.unique(what, return_inverse=True)
    dense = np.zeros((len(words), len(triples)))
    np.add.at(dense, (who, column), weight)
    return triples, dense / np.maximum(np.sqrt((dense**2).sum(axis=1, keepdims=True)), 1e-12)


def _spread(order: list[int], vocabulary: list[str], count: int) -> list[int]:
    """The first of ``order`` of which no more than KIN before are much alike, so that one family of words doesn't fill the landmarks."""
    if not order:
        return []
    rows, _ = encode([vocabulary[i] for i in order])
    who, what, weight = feature_rows(rows)
    triples, column = np.unique(what, return_inverse=True)
    by_word = np.argsort(who, kind="stable")
    ends = np.searchsorted(who[by_word], np.arange(len(order) + 1))
    # Only words that are taken stand as whole rows.
    dense, taken = np.zeros((min(count, len(order)), len(triples)), dtype=np.float32), []
    for at in range(len(order)):
        if len(taken) == len(dense):
            break
        own, row = by_word[ends[at] : ends[at + 1]], np.zeros(len(triples), dtype=np.float32)
        np.add.at(row, column[own], weight[own].astype(np.float32))
        row /= max(float(np.sqrt((row.astype(np.float64) ** 2).sum())), 1e-12)
        if int((dense[: len(taken)] @ row > ALIKE).sum()) < KIN:
            dense[len(taken)] = row
            taken.append(at)
    return [order[at] for at in taken]


def _machine(sentences: list[list[np.ndarray]], vocabulary: list[str], y: np.ndarray, flat: Model, rounds: int, landmarks: int) -> tuple[Model, np.ndarray]:
    """Train on sentences with the labels of their texts; also the evidence of the whole vocabulary."""
    bags = _bags(sentences)
    n1, n0 = int(y.sum()), int((~y).sum())

    def shares(side: np.ndarray, n: int) -> np.ndarray:
        held = [b for b, on in zip(bags, side, strict=True) if on]
        return np.bincount(np.concatenate(held), minlength=len(vocabulary)) / n

    p1, p0 = shares(y, n1), shares(~y, n0)
    z = (p1 - p0) / np.sqrt((p1 + 1 / n1) / n1 + (p0 + 1 / n0) / n0)
    order = np.argsort(-z, kind="stable")
    chosen = _spread([int(i) for i in order[: 20 * landmarks] if 3 <= len(vocabulary[i]) <= LONGEST and z[i] > 0], vocabulary, landmarks * 2 // 3)
    f = z / max(z.max(), 1e-9) - 0.5
    rng = np.random.default_rng(7)
    model = flat
    for turn in range(rounds):
        negative = Counter()
        for bag, toxic in zip(bags, y, strict=True):
            if not toxic:
                for i in bag[np.argsort(-f[bag], kind="stable")[:3]]:
                    negative[int(i)] += 1
        hard = [i for i, _ in negative.most_common() if i not in chosen and 3 <= len(vocabulary[i]) <= LONGEST]
        marks = chosen + hard[: landmarks - len(chosen)]
        for i in rng.integers(0, len(vocabulary), 3 * n0):
            negative[int(i)] += 1 if p1[i] <= p0[i] else 0
        positive = Counter()
        for doc, toxic in zip(sentences, y, strict=True):
            if toxic:
                best = sorted((int(s[np.argmax(f[s])]) for s in doc), key=lambda i: -f[i])
                # Sentences of a toxic document that don't tell are left out.
                for i in best[:1] + [i for i in best[1:4] if f[i] > (0 if turn else 0.2)]:
                    positive[i] += 1
        # Only triples of landmarks have weights.
        triples, m_dense = _normed([vocabulary[i] for i in marks])
        place = np.full(SYMBOLS**3, -1, dtype=np.int64)
        place[triples] = np.arange(len(triples))
        gram = m_dense @ m_dense.T
        values, vectors = np.linalg.eigh(gram + 1e-6 * np.eye(len(marks)))
        root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-6))) @ vectors.T
        # Words enter by the same pieces by which they are scored: the most toxic one of a witness, all of any other.
        told = list(positive)
        rows_of = [max(parts, key=lambda p, g=dict(zip(parts, model.word_scores(parts), strict=True)): g[p]) if len(parts := pieces(vocabulary[i])) > 1 else parts[0] for i in told]
        owner, other = told.copy(), [i for i, c in negative.items() if c]
        target = [1.0] * len(told)
        for i in other:
            for part in pieces(vocabulary[i]):
                rows_of.append(part)
                owner.append(i)
                target.append(-1.0)
        texts = sorted(set(rows_of))
        at = {t: n for n, t in enumerate(texts)}
        rows, _ = encode(texts)
        who, what, weight = feature_rows(rows)
        on = place[what] >= 0
        who, column, weight = who[on], place[what[on]], weight[on]
        k = np.column_stack([np.bincount(who, weight * m_dense[c][column], minlength=len(texts)) for c in range(len(marks))])
        x = ((k / norms(rows)[:, None]) @ root)[[at[t] for t in rows_of]]
        side = np.array(target)
        counts = np.array([min(positive[i] if t > 0 else negative[i], 20) for i, t in zip(owner, target, strict=True)], dtype=float)
        for sign in (1.0, -1.0):
            counts[side == sign] *= len(side) / (2 * counts[side == sign].sum())
        w, bias = _svm(x, side, counts / len(side) * 200)
        table = np.zeros(SYMBOLS**3)
        table[triples] = (root @ w) @ m_dense
        model = Model(table, bias, flat.calibration, landmarks=Landmarks([vocabulary[i] for i in marks], root @ w, triples, m_dense, np.ones(len(marks))))
        f = model.word_scores(vocabulary)
    # What each landmark tells: in how many texts of either kind words near it, or near one much like it, stand.
    kin = model.landmarks.features @ model.landmarks.features.T > ALIKE
    told = np.flatnonzero(f > SURE)
    near = np.full(len(vocabulary), -1)
    if len(told):
        near[told] = model.landmarks.nearest([pieces(vocabulary[i])[0] for i in told])
    held = np.zeros((2, len(model.landmarks.words)))
    for bag, toxic in zip(bags, y, strict=True):
        own = np.unique(near[bag])
        held[int(toxic)] += kin[own[own >= 0]].any(axis=0)
    share1, share0 = held[1] / n1, held[0] / n0
    base = 0.01 * held.sum(axis=0) / (n0 + n1) + 0.5 / (n0 + n1)
    model.landmarks.reliance = np.clip(np.log(share1 + base) - np.log(share0 + base), 0.0, MOST)
    return model, model.strengths(vocabulary, f)


def fit(texts: list[str], labels: np.ndarray, rounds: int = 5, landmarks: int = LANDMARKS) -> Model:
    """Train on whole texts with 0/1 labels: their sentences are bags of words with the label of the text.

    The calibration is fitted on scores that two machines, each trained on one
    half of the texts, give to the other half. With one class only the model
    gives that class's share to every text.
    """
    y = np.asarray(labels) == 1
    share = float(np.clip(y.mean() if len(y) else 0.0, 0.01, 0.99))
    flat = Model(np.zeros(SYMBOLS**3), -1.0, np.array([np.log(share / (1 - share)), 0.0, 0.0, 0.0]))
    if not y.any() or y.all():
        return flat
    sentences, vocabulary = _sentences(texts)
    if not vocabulary:
        return flat
    bags = _bags(sentences)
    half = np.zeros(len(y), dtype=bool)
    for side in (y, ~y):
        half[np.flatnonzero(side)[::2]] = True
    features = np.zeros((len(y), 3))
    model, f = _machine(sentences, vocabulary, y, flat, rounds, landmarks)
    for part in (half, ~half):
        seen = [sentences[i] for i in np.flatnonzero(part)]
        if len({bool(v) for v in y[part]}) == 2 and any(seen):
            # Its first two turns find nearly the same words.
            _, g = _machine(seen, vocabulary, y[part], flat, min(rounds, 2), landmarks)
        else:
            g = f
        for i in np.flatnonzero(~part):
            features[i] = pool(g[bags[i]], len(bags[i]))
    model.calibration = _rising_logistic(features, y.astype(float))
    model.steps = _rising(np.clip(model.evidence(features), -30, 30), y.astype(float))
    return model


def sample_rows(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic", max_ones: int = MAX_TOXIC, max_zeros: int = MAX_CLEAN, train_part=None) -> DataFrame:
    """Ids as text, texts and labels of a bounded sample, the smallest by a hash of the id in each class; the same in every run.

    Null labels and ids are left out; of several labels of an id the largest
    holds, of several texts the smallest.
    """
    rows = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("_y"))
    if train_part is not None:
        rows = rows.where(train_part(F.col(id_col)))
    draw = F.xxhash64(F.col(id_col).cast("string"), F.lit(11))
    kept = [rows.where(F.col("_y") == v).orderBy(draw, id_col).limit(n) for v, n in ((1, max_ones), (0, max_zeros))]
    picked = kept[0].unionByName(kept[1]).withColumnRenamed(id_col, "_pick")
    # Bounded by the two limits above.
    joined = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).join(F.broadcast(picked), F.col("_id") == F.col("_pick"))
    found = joined.groupBy("_id").agg(F.min("_text").alias("_text"), F.max("_y").alias("_y"))
    return found.select(F.col("_id").cast("string").alias("_at"), "_text", F.col("_y").cast("long").alias("_y"))


def training_sample(docs: DataFrame, labels: DataFrame, *args, **kwargs) -> tuple[list[str], np.ndarray]:
    """Texts and labels of ``sample_rows``, by ascending id as text."""
    found = sample_rows(docs, labels, *args, **kwargs).orderBy("_at").select("_text", "_y").collect()
    return [r["_text"] for r in found], np.array([r["_y"] for r in found], dtype=np.int64)


def _trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    texts, labels = [], []
    for batch in batches:
        texts += batch.column(1).to_pylist()
        labels += batch.column(2).to_pylist()
    if texts:
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(texts, np.array(labels, dtype=np.int64)))], pa.binary())], names=["model"])


def fit_on(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> Model:
    """The model of the bounded sample, trained in a task, so that the driver gets the model alone (some MB)."""
    rows = sample_rows(docs, labels, text_col, id_col, train_part=train_rows)
    found = rows.repartition(1).sortWithinPartitions("_at").mapInArrow(_trained, "model binary").collect()
    return pickle.loads(bytes(found[0]["model"])) if found else fit([], np.empty(0, dtype=np.int64))


def train_rows(id_col: F.Column) -> F.Column:
    """Rows that a model may learn from: crc32 of the id as text modulo 3 is not 1."""
    return ~held_out(id_col, 3, 1)


#: Texts whose words are in memory at once, and words that a task remembers.
SLICE, REMEMBER = 1000, 300_000


class Scorer:
    """Scores of many texts; remembers the decision values and evidence of words it has seen."""

    def __init__(self, model: Model):
        self.model, self.cache = model, {}
        self.across = model.landmarks.pattern() if model.landmarks is not None else None

    def _stretches(self, text: str) -> set[str]:
        """Insults cut by marks and spaces or inside of a longer word, without the marks."""
        if self.across is None:
            return set()
        found = set()
        for m in self.across.finditer(text):
            # Parts of several words must be whole words.
            if m.group().isalnum() or not (text[m.start() - 1 : m.start()].isalnum() or text[m.end() : m.end() + 1].isalnum()):
                found.add("".join(c for c in m.group() if c.isalnum()))
        return found

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Probability and most toxic word's decision value of each text."""
        # Words that differ only in the marks around them count once.
        sets = [{trim(w) for w in tokens(t or "")} | self._stretches((t or "").lower()) for t in texts]
        cache = self.cache
        if len(cache) > REMEMBER:
            cache.clear()
        new = list(set().union(*sets) - cache.keys())
        scores = self.model.word_scores(new)
        cache.update(zip(new, zip(scores.tolist(), self.model.strengths(new, scores).tolist(), strict=True), strict=True))
        top, features = np.full(len(sets), -1.0), np.zeros((len(sets), 3))
        for i, s in enumerate(sets):
            if s:
                found = [cache[w] for w in s]
                top[i] = max(f for f, _ in found)
                features[i] = pool(np.array([e for _, e in found if e > 0]), len(s))
        return self.model.probability(features), top


def _slices(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, text, 16 << 20):
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def score_toxicity(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", threshold: float = 0.7, model: Model | None = None) -> DataFrame:
    """One row per input row: id, held_out, score (0 to 1), predicted (1 from ``threshold``), top_word_score.

    Null and empty texts are scored as texts without words; an empty table gives
    no rows, and without labels of both classes every text has the share of
    toxic labels as its score. Repeated rows give the same row each. Labels,
    language, source and id are no inputs of a score. Very long texts are read
    whole. Ids keep their type and bits; other columns are not read.
    """
    model = model or fit_on(docs, labels, text_col, id_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for part in _slices(batches, 2):
            score, top = scorer(part.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(score), pa.array(top)], names=["id", "held_out", "score", "top"])

    id_type = docs.select(id_col).schema[0].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), held_out(F.col(id_col), 3, 1).alias("held_out"), F.col(text_col).alias("_text"))
    out = rows.mapInArrow(run, f"id {id_type}, held_out boolean, score double, top double")
    return out.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), F.col("top").alias("top_word_score"))


def drop_toxic(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", threshold: float = 0.7, model: Model | None = None) -> DataFrame:
    """The rows whose score is below ``threshold``, all columns as they are, in one pass over the rows.

    Null and empty texts, repeated rows, empty tables and very long texts as in ``score_toxicity``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or fit_on(docs, labels, text_col, id_col))
    text = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for part in _slices(batches, text):
            score, _ = scorer(part.column(text).to_pylist())
            yield part.filter(pa.array(score < threshold))

    return docs.mapInArrow(run, docs.schema)
