"""Language of documents by a linear-chain conditional random field over words.

Every word gets a language label. A word's own evidence is a sum of learned
weights of its affixes, character n-grams and itself (lexicon), hashed to a
table; a learned transition weight joins neighbouring labels. Forward-backward
gives each word's posterior, so switches inside a text are seen; the posteriors
of a document's words add up to its language.

The chain runs over all words of many documents at once: products of transition
matrices inside blocks of words are vectorised, and a short scan links the
blocks. A text that is longer than what is held at once is read in chunks whose
products are linked the same way. Both are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import held_out, materialize, sliced

#: Documents that are read for the fit, at most: of each language, and of all. Every language gives one at least.
MAX_DOCS, MAX_ALL = 120, 8_000
#: The feature table has 2 ** TABLE_BITS rows, fewer where these times the languages would pass 2 ** WEIGHT_BITS.
TABLE_BITS, WEIGHT_BITS = 17, 24
LONGEST = 24
#: Words that are in memory at once (fewer with many languages); longer texts are read in such chunks.
CHUNK = 249_984
BLOCK = 64
_SALT = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1, 0xD3A2646D, 0xFD7046C5, 0xB55A4F09], dtype=np.uint64)


# ------------------------------------------------------------ features


def split_words(text: str) -> list[str]:
    """Words of a text in lower case; longer ones than LONGEST are cut into stretches that stand as words."""
    words = text.lower().split()
    if words and max(map(len, words)) > LONGEST:
        words = [w[i : i + LONGEST] for w in words for i in range(0, len(w), LONGEST)]
    return words


def bare(word: str) -> str:
    """Letters of a word with what stands between them; empty if there is none."""
    low, high = 0, len(word)
    while low < high and not word[low].isalpha():
        low += 1
    while high > low and not word[high - 1].isalpha():
        high -= 1
    return word[low:high]


def feature_rows(words: list[str], bits: int = TABLE_BITS) -> list[tuple[np.ndarray, np.ndarray]]:
    """For groups of words of one length: their positions, and rows of hashed features."""
    size = np.array([len(w) for w in words], dtype=np.int64)
    out = []
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        if n == 0:
            out.append((at, np.empty((len(at), 0), dtype=np.int64)))
            continue
        code = np.frombuffer("".join([f"\x01{words[i]}\x02" for i in at]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(len(at), n + 2).astype(np.uint64)

        def gram(i: int, k: int, kind: int, code: np.ndarray = code) -> np.ndarray:
            h = np.full(len(code), kind + 1, dtype=np.uint64) * _SALT[kind]
            for j in range(i, i + k):
                h = (h ^ code[:, j]) * np.uint64(0x100000001B3)
                h ^= h >> np.uint64(29)
            return h

        cols = [gram(0, n + 2, 0)]
        cols += [gram(0, k + 1, 1) for k in (1, 2, 3, 4) if k <= n]
        cols += [gram(n + 1 - k, k + 1, 2) for k in (1, 2, 3, 4) if k <= n]
        cols += [gram(i, k, k + 2) for k in (1, 2, 3) for i in range(1, n + 2 - k)]
        h = np.column_stack(cols)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        out.append((at, (h >> np.uint64(64 - bits)).astype(np.int64)))
    return out


# --------------------------------------------------------------- chain


class Chain:
    """Forward-backward over the words of concatenated chains.

    ``score`` is words x labels (log), ``first`` marks words that begin a chain,
    ``trans`` and ``start`` are log weights.
    """

    def __init__(self, score: np.ndarray, first: np.ndarray, trans: np.ndarray, start: np.ndarray):
        self.n, self.k = score.shape
        self.blocks = -(-self.n // BLOCK)
        phi = np.ones((self.blocks * BLOCK, self.k))
        phi[: self.n] = np.exp(score - score.max(axis=1, keepdims=True))
        self.phi = phi.reshape(self.blocks, BLOCK, self.k)
        reset = np.zeros(self.blocks * BLOCK, dtype=bool)
        reset[: self.n] = first
        reset[self.n :] = True  # what fills up the last block tells nothing about the words before
        self.reset = reset.reshape(self.blocks, BLOCK)
        self.step, self.start = np.exp(trans - trans.max()), np.exp(start - start.max())
        product = np.tile(np.eye(self.k), (self.blocks, 1, 1))
        for t in range(BLOCK):
            new = product @ self.step
            on = self.reset[:, t]
            if on.any():
                new[on] = product[on].sum(axis=2, keepdims=True) * self.start
            product = new * self.phi[:, t, None, :]
            product /= product.max(axis=(1, 2), keepdims=True)
        self.product = product

    def whole(self) -> np.ndarray:
        """What all words do to a vector of label weights, up to a factor."""
        out = np.eye(self.k)
        for p in self.product:
            out = out @ p
            out /= out.max()
        return out

    def run(self, before: np.ndarray | None = None, after: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Forward and backward weights of every word, each up to a factor; ``before`` and ``after`` are those at the ends.

        ``after`` counts only if the words fill whole blocks.
        """
        left, right = np.ones((self.blocks, self.k)), np.ones((self.blocks, self.k))
        if before is not None:
            left[0] = before
        if after is not None:
            right[-1] = after
        for b in range(1, self.blocks):
            v = left[b - 1] @ self.product[b - 1]
            left[b] = v / v.max()
        for b in range(self.blocks - 2, -1, -1):
            v = self.product[b + 1] @ right[b + 1]
            right[b] = v / v.max()
        alpha, beta, v = np.empty_like(self.phi), np.empty_like(self.phi), left
        for t in range(BLOCK):
            v = np.where(self.reset[:, t, None], v.sum(axis=1, keepdims=True) * self.start, v @ self.step) * self.phi[:, t]
            v = v / v.max(axis=1, keepdims=True)
            alpha[:, t] = v
        v = right
        for t in range(BLOCK - 1, -1, -1):
            beta[:, t] = v
            v = v * self.phi[:, t]
            v = np.where(self.reset[:, t, None], (v @ self.start)[:, None], v @ self.step.T)
            v = v / v.max(axis=1, keepdims=True)
        return alpha.reshape(-1, self.k)[: self.n], beta.reshape(-1, self.k)[: self.n]


def posteriors(score: np.ndarray, first: np.ndarray, trans: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Posterior label shares of every word of concatenated chains."""
    if not len(score):
        return score.copy()
    alpha, beta = Chain(score, first, trans, start).run()
    both = alpha * beta
    return both / both.sum(axis=1, keepdims=True)


def gradients(score: np.ndarray, gold: np.ndarray, first: np.ndarray, trans: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Derivatives of the negative log-likelihood of the labels by scores, transitions and starts."""
    chain = Chain(score, first, trans, start)
    alpha, beta = chain.run()
    both = alpha * beta
    post = both / both.sum(axis=1, keepdims=True)
    k = chain.k
    by_score = post.copy()
    by_score[np.arange(len(gold)), gold] -= 1
    # Posteriors of pairs of neighbours, summed: forward weights, the step, and what the next word and all after it tell.
    on = np.flatnonzero(~first[1:]) + 1
    ahead = chain.phi.reshape(-1, k)[on] * beta[on]
    back = alpha[on - 1]
    pairs = chain.step * (back.T @ (ahead / ((back @ chain.step) * ahead).sum(axis=1, keepdims=True)))
    np.subtract.at(pairs, (gold[on - 1], gold[on]), 1.0)
    begin = np.flatnonzero(first)
    starts = post[begin].sum(axis=0) - np.bincount(gold[begin], minlength=k)
    return by_score, pairs, starts


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # feature table x languages
    trans: np.ndarray
    start: np.ndarray

    @property
    def bits(self) -> int:
        return len(self.weights).bit_length() - 1

    def emissions(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.languages)))
        for at, cols in feature_rows(words, self.bits):
            for i in range(cols.shape[1]):
                out[at] += self.weights[cols[:, i]]
        return out


def fit(texts: list[str], languages: list[str], rounds: int = 20, rate: float = 0.4, decay: float = 1e-4, seed: int = 3) -> Model:
    """Maximise the conditional likelihood of the labels by adaptive gradient steps.

    Texts are cut into stretches of a few words that are strung together in
    random order, some six to a chain, so the chain learns what a switch costs
    and how texts begin. Stretches of languages with few words are repeated, up
    to ten times, towards the words of the others.
    """
    names = sorted(set(languages))
    k, rng = len(names), np.random.default_rng(seed)
    bits = max(8, min(TABLE_BITS, WEIGHT_BITS - max(k - 1, 1).bit_length()))
    model = Model(names, np.zeros((1 << bits, k)), np.zeros((k, k)), np.zeros(k))
    if k < 2:
        return model
    index: dict[str, int] = {}
    place = {name: i for i, name in enumerate(names)}
    stretches, total = [], np.zeros(k)
    for text, name in zip(texts, languages, strict=True):
        ids = [index.setdefault(b, len(index)) for w in split_words(text) if (b := bare(w))]
        total[place[name]] += len(ids)
        at = 0
        while at < len(ids):
            n = int(rng.integers(3, 30))
            stretches.append((ids[at : at + n], place[name]))
            at += n
    if not stretches:
        return model
    times = np.clip(np.round(total.mean() / np.maximum(total, 1)), 1, 10).astype(int)
    order = rng.permutation(np.repeat(np.arange(len(stretches)), times[[c for _, c in stretches]]))
    word = np.array([i for s in order for i in stretches[s][0]], dtype=np.int64)
    sizes = [len(stretches[s][0]) for s in order]
    gold = np.repeat([stretches[s][1] for s in order], sizes)
    features = feature_rows(list(index), bits)
    first = np.zeros(len(word), dtype=bool)
    first[(np.cumsum(sizes) - sizes)[rng.random(len(sizes)) < 1 / 6]] = True
    first[0] = True
    seen_w, seen_t, seen_s = np.full_like(model.weights, 1e-8), np.full((k, k), 1e-8), np.full(k, 1e-8)
    for _ in range(rounds):
        scores = np.zeros((len(index), k))
        for at, cols in features:
            for i in range(cols.shape[1]):
                scores[at] += model.weights[cols[:, i]]
        gap, pairs, starts = gradients(scores[word], gold, first, model.trans, model.start)
        by_word = np.column_stack([np.bincount(word, gap[:, c], minlength=len(index)) for c in range(k)]) / len(word)
        grad = decay * model.weights / len(word) * 100
        for at, cols in features:
            for i in range(cols.shape[1]):
                for c in range(k):
                    grad[:, c] += np.bincount(cols[:, i], by_word[at, c], minlength=len(grad))
        seen_w += grad**2
        model.weights -= rate * grad / np.sqrt(seen_w)
        for held, seen, part in ((model.trans, seen_t, pairs / len(word)), (model.start, seen_s, starts / len(word))):
            seen += part**2
            held -= rate * part / np.sqrt(seen)
    return model


def training_sample(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", lang_col: str = "lang", max_docs: int = MAX_DOCS, max_all: int = MAX_ALL) -> DataFrame:
    """Texts (_text, _lang) for the fit: of every language outside the held-out part the documents with the smallest hashes of their ids.

    One pass over ids and languages ranks them, with only the first of each
    language leaving a task; a second brings the texts of the chosen ones. Of
    several texts of one id and language the smallest stands for all.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).where(~held_out(F.col(id_col), 4, 2))
    draw = F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(17))
    rows = rows.select(F.col(id_col).alias("_pick"), F.col(lang_col).alias("_lang"), draw.alias("_d"))
    rank = F.dense_rank().over(Window.partitionBy("_lang").orderBy("_d", F.col("_pick").cast("string")))
    picked = materialize(rows.withColumn("_rank", rank).where(F.col("_rank") <= max_docs).distinct(), "languages")
    many = picked.where("_rank = 1").select("_lang").distinct().count()
    picked = picked.where(F.col("_rank") <= max(1, min(max_docs, max_all // max(many, 1)))).select("_pick", "_lang")
    if many <= max_all:
        # At most max_all short rows.
        picked = F.broadcast(picked)
    named = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_own")).where("_text IS NOT NULL")
    joined = named.join(picked, F.col("_id").eqNullSafe(F.col("_pick")) & (F.col("_own") == F.col("_lang")))
    return joined.groupBy("_id", "_lang").agg(F.min("_text").alias("_text")).orderBy("_lang", F.col("_id").cast("string")).select("_text", "_lang")


def train(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", lang_col: str = "lang", max_docs: int = MAX_DOCS) -> Model:
    """Fit on the bounded sample of ``training_sample``."""
    found = training_sample(docs, text_col, id_col, lang_col, max_docs).collect()
    return fit([r["_text"] for r in found], [r["_lang"] for r in found])


# ------------------------------------------------------------- predict


class Labeller:
    """Word posteriors of many texts; remembers the evidence of words it has seen."""

    def __init__(self, model: Model, remember: int = 1_000_000):
        self.model, self.remember = model, remember
        self.index: dict[str, int] = {}
        self.table = np.zeros((1024, len(model.languages)))

    def _evidence(self, words: list[str]) -> np.ndarray:
        """Index of each word in the table, -1 for words without a letter."""
        if len(self.index) > self.remember:
            self.index = {}
        get = self.index.get
        ids = np.array([get(w, -2) for w in words], dtype=np.int64)
        if (ids == -2).any():
            new = list(dict.fromkeys(words[i] for i in np.flatnonzero(ids == -2)))
            plain = [bare(w) for w in new]
            told = [w for w, b in zip(new, plain, strict=True) if b]
            base = max(self.index.values(), default=-1) + 1 if self.index else 0
            while len(self.table) < base + len(told):
                self.table = np.vstack([self.table, np.zeros_like(self.table)])
            self.table[base : base + len(told)] = self.model.emissions([b for b in plain if b])
            self.index.update(dict.fromkeys((w for w, b in zip(new, plain, strict=True) if not b), -1))
            self.index.update(zip(told, range(base, base + len(told)), strict=True))
            get = self.index.get
            ids = np.array([get(w) for w in words], dtype=np.int64)
        return ids

    def _chunk(self) -> int:
        """Words at once: whole blocks whose products take 4 million numbers at most."""
        blocks = max(1, min(CHUNK // BLOCK, (1 << 22) // max(1, len(self.model.languages)) ** 2))
        return blocks * BLOCK

    def _long(self, ids: np.ndarray) -> np.ndarray:
        """Sum of the posteriors of one chain of words, read in chunks."""
        m, size = self.model, self._chunk()

        def chain(at: int) -> Chain:
            part = ids[at : at + size]
            first = np.zeros(len(part), dtype=bool)
            first[0] = at == 0
            return Chain(self.table[part], first, m.trans, m.start)

        spots = range(0, len(ids), size)
        products = [chain(at).whole() for at in spots]
        left, right = [np.ones(len(m.languages))], [np.ones(len(m.languages))]
        for p in products[:-1]:
            v = left[-1] @ p
            left.append(v / v.max())
        for p in products[:0:-1]:
            v = p @ right[-1]
            right.append(v / v.max())
        total = np.zeros(len(m.languages))
        for at, before, after in zip(spots, left, right[::-1], strict=True):
            alpha, beta = chain(at).run(before, after)
            both = alpha * beta
            total += (both / both.sum(axis=1, keepdims=True)).sum(axis=0)
        return total

    def shares(self, texts: list[str]) -> np.ndarray:
        """Mean posterior of the words with letters of each text; all zero if there is none."""
        k, size = len(self.model.languages), self._chunk()
        sums, counts = np.zeros((len(texts), k)), np.zeros(len(texts))
        words: list[str] = []
        owners: list[tuple[int, int]] = []

        def flush() -> None:
            ids = self._evidence(words)
            owner = np.repeat([o for o, _ in owners], [n for _, n in owners])
            on = ids >= 0
            piece = owner[on]
            first = np.concatenate(([True], piece[1:] != piece[:-1])) if on.any() else np.empty(0, bool)
            post = posteriors(self.table[ids[on]], first, self.model.trans, self.model.start)
            for c in range(k):
                sums[:, c] += np.bincount(piece, post[:, c], minlength=len(texts))
            counts[:] += np.bincount(piece, minlength=len(texts))
            words.clear()
            owners.clear()

        for i, text in enumerate(texts):
            own = split_words(text)
            if len(own) > size:
                ids = self._evidence(own)
                ids = ids[ids >= 0]
                if len(ids):
                    sums[i], counts[i] = self._long(ids), len(ids)
                continue
            if words and len(words) + len(own) > size:
                flush()
            words.extend(own)
            owners.append((i, len(own)))
        if words:
            flush()
        return sums / np.maximum(counts, 1)[:, None]


def _predicted(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        labeller = Labeller(m)
        for batch in sliced(batches, 2, 16 << 20):
            shares = labeller.shares([t or "" for t in batch.column(2).to_pylist()])
            if m.languages:
                best = shares.argmax(axis=1)
                names = [m.languages[b] if shares[i, b] > 0 else "und" for i, b in enumerate(best)]
                score = shares.max(axis=1)
            else:
                names, score = ["und"] * len(shares), np.zeros(len(shares))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(np.clip(score, 0, 1))], names=["id", "held_out", "lang_pred", "score"])

    return run


def predict_language(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", lang_col: str = "lang", model: Model | None = None) -> DataFrame:
    """One row per input row: id, held_out, lang_pred, score (mean posterior of the language over the words).

    ``und`` with score 0 for a null text, one without letters, or if nothing
    could be learned; an empty table gives no rows. Language, source and id are
    no inputs of a prediction. Ties go to the first language by name. Repeated
    rows give the same row each. Very long texts are read whole, exactly as one
    chain. Ids keep their type and bits; other columns are not read.
    """
    model = model or train(docs, text_col, id_col, lang_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    id_type = docs.select(id_col).schema[0].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), held_out(F.col(id_col), 4, 2).alias("held_out"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(_predicted(shared), f"id {id_type}, held_out boolean, lang_pred string, score double").withColumnRenamed("id", id_col)
