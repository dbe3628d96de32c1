"""Toxicity: a convolutional text classifier on hashed word embeddings.

A word (letters and digits, A-Z in lower case) is the sum of three rows: two hashes of the word into tables of
WORD_ROWS rows, so that words which share one row seldom share both, and a hash of its first five bytes into a table of
PREFIX_ROWS. Filters of several widths slide over the words, each keeps its greatest value over the whole text, and a
logistic unit reads these. It is trained in numpy on the driver, on at most SAMPLE labelled rows (those of least hash of
doc_id, texts up to SAMPLE_CHARS characters), from a fixed seed. Part of the sample is held back to set a threshold for
each language; the language is guessed from function words in the text, never read from a column, and the score is
shifted so that each language's threshold is 0.5.

Defined results: null and empty texts get the score of a text without words, which is the model's least. A null doc_id
counts as not held out and takes no part in training. If the labels hold no row, or only one class, every score is 0.
Long texts are scored whole, a slice of words at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recollex.llm import kernels
from recollex.llm.common import table

SAMPLE, SAMPLE_CHARS = 6000, 20_000
WORD_ROWS, PREFIX_ROWS, WIDTH = 1 << 17, 1 << 15, 8
WIDTHS, FILTERS = (1, 2, 3), 8
EPOCHS, BATCH, RATE, DECAY = 6, 32, 0.05, 1e-4
FOLDS = 5
#: Function words by which a language is guessed: fixed values.
FUNCTION_WORDS = {
    "en": "the of and to in is that was for it with are this be",
    "de": "der die das und ist nicht ein eine mit von zu den sich auf",
    "fr": "le la les des est que et en un une dans pour pas du",
    "es": "el la los las del que y en un una por con para es",
}
LANGUAGES = (*FUNCTION_WORDS, "")


def held_out(doc_id: Column) -> Column:
    """Rows that are for measuring only, never for training."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def _hash_text(words: list[str]) -> np.ndarray:
    raw, off = kernels.text_bytes(pa.array([" ".join(words)]))
    starts, ends, _ = kernels.word_bounds(raw, off, kernels.ALNUM)
    return kernels.span_hashes(raw, starts, ends, lower=True)


_LANGUAGE_OF = {}
for _n, _words in enumerate(FUNCTION_WORDS.values()):
    for _h in _hash_text(_words.split()).tolist():
        _LANGUAGE_OF[_h] = _LANGUAGE_OF.get(_h, 0) | 1 << _n
_KNOWN = np.array(sorted(_LANGUAGE_OF), dtype=np.uint64)
_KNOWN_BITS = np.array([[_LANGUAGE_OF[int(h)] >> n & 1 for n in range(len(FUNCTION_WORDS))] for h in _KNOWN], dtype=np.int64)


def features(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows of the three tables for each word, first word of each text and the end, guessed language of each text)."""
    starts, ends, first = kernels.word_bounds(raw, off, kernels.ALNUM)
    h = kernels.span_hashes(raw, starts, ends, lower=True)
    p = kernels.span_hashes(raw, starts, np.minimum(ends, starts + 5), lower=True)
    rows = np.stack([h & np.uint64(WORD_ROWS - 1), (h >> np.uint64(32)) & np.uint64(WORD_ROWS - 1), p & np.uint64(PREFIX_ROWS - 1)], 1).astype(np.int32)
    at = np.minimum(np.searchsorted(_KNOWN, h), len(_KNOWN) - 1)
    hit = np.flatnonzero(_KNOWN[at] == h)
    text = np.searchsorted(first, hit, side="right") - 1
    counts = np.zeros((len(off) - 1, len(FUNCTION_WORDS)), np.int64)
    np.add.at(counts, text, _KNOWN_BITS[at[hit]])
    return rows, first, np.where(counts.max(1) > 0, counts.argmax(1), len(FUNCTION_WORDS))


class Net:
    """Embedding tables, filters and the logistic unit."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.word1, self.word2 = (np.zeros((WORD_ROWS, WIDTH), np.float32) for _ in range(2))
        self.prefix = np.zeros((PREFIX_ROWS, WIDTH), np.float32)
        self.filters = [rng.normal(0, 0.3, (k, WIDTH, FILTERS)).astype(np.float32) for k in WIDTHS]
        self.shift = np.zeros(FILTERS * len(WIDTHS), np.float32)
        self.out = rng.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32)
        self.bias = np.float32(-1)
        self.thresholds = np.zeros(len(LANGUAGES), np.float32)

    def embed(self, rows: np.ndarray) -> np.ndarray:
        return self.word1[rows[:, 0]] + self.word2[rows[:, 1]] + self.prefix[rows[:, 2]]

    def responses(self, x: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Every filter's value where its window begins, which is at the words' places only; each text in x ends in a window's worth of empty words."""
        n = len(x) - max(WIDTHS) + 1
        out = np.empty((n, FILTERS * len(WIDTHS)), np.float32)
        for i, (k, w) in enumerate(zip(WIDTHS, self.filters, strict=True)):
            own = x[:n] @ w[0]
            for j in range(1, k):
                own += x[j : n + j] @ w[j]
            out[:, i * FILTERS : (i + 1) * FILTERS] = own
        behind = np.ones(n, bool)
        behind[place] = False
        out[behind] = -np.inf
        return out

    def pooled(self, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The greatest value of each filter over each text; that of a text without words is its window of empty words."""
        margin = max(WIDTHS) - 1
        texts = len(first) - 1
        x = np.zeros((len(rows) + margin * texts + margin, WIDTH), np.float32)
        place = np.arange(len(rows)) + margin * np.repeat(np.arange(texts), np.diff(first))
        x[place] = self.embed(rows)
        begin = first[:-1] + margin * np.arange(texts)
        if not texts:
            return np.zeros((0, FILTERS * len(WIDTHS)), np.float32)
        values = self.responses(x, place)
        values[begin[np.diff(first) == 0]] = 0
        return np.maximum(np.maximum.reduceat(values, begin, axis=0) + self.shift, 0)

    def logits(self, rows: np.ndarray, first: np.ndarray, most: int = 1 << 17) -> np.ndarray:
        """Texts are taken some at a time; one of more than `most` words is pooled over overlapping slices."""
        out, at, texts = np.empty(len(first) - 1, np.float32), 0, len(first) - 1
        while at < texts:
            to = max(at + 1, int(np.searchsorted(first, first[at] + most, side="right")) - 1)
            lo, hi = int(first[at]), int(first[to])
            if hi - lo <= most:
                best = self.pooled(rows[lo:hi], first[at : to + 1] - lo)
            else:
                best = np.maximum.reduce([self.pooled(rows[i : min(hi, i + most + max(WIDTHS) - 1)], np.array([0, min(hi, i + most + max(WIDTHS) - 1) - i])) for i in range(lo, hi, most)])
            out[at:to] = best @ self.out + self.bias
            at = to
        return out

    def scores(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        rows, first, language = features(raw, off)
        return 1 / (1 + np.exp(-np.clip(self.logits(rows, first) - self.thresholds[language], -30, 30).astype(np.float64)))

    def begin(self, texts: list[np.ndarray], y: np.ndarray) -> None:
        """The first two components of every row: how far its texts' labels depart from the mean, as a signed root."""
        rng = np.random.default_rng(5)
        for i, (held, size) in enumerate(((self.word1, WORD_ROWS), (self.word2, WORD_ROWS), (self.prefix, PREFIX_ROWS))):
            seen, toxic = np.zeros(size), np.zeros(size)
            for rows, label in zip(texts, y, strict=True):
                own = np.unique(rows[:, i])
                seen[own] += 1
                toxic[own] += label
            away = toxic - seen * y.mean()
            held[:, int(i == 2)] = np.sign(away) * np.log1p(np.abs(away) / np.sqrt(seen * y.mean() + 1)) * (1 if i == 2 else 0.5)
            held[:, 2:] = rng.normal(0, 0.1, (size, WIDTH - 2)) * (seen > 1)[:, None]
        for w in self.filters:
            w[0, 0, : FILTERS // 2] += 1
            w[0, 1, FILTERS // 2 :] += 1
        self.out += 0.3

    def fit(self, texts: list[np.ndarray], y: np.ndarray) -> None:
        """Adagrad on the log loss; only the windows that a filter chose pass a gradient on."""
        rng = np.random.default_rng(3)
        margin = max(WIDTHS) - 1
        tables = (self.word1, self.word2, self.prefix)
        moments = [np.full(t.shape, 0.01, np.float32) for t in tables]
        dense = [*self.filters, self.shift, self.out]
        squares = [np.full(d.shape, 0.01, np.float32) for d in dense]
        bias_square = 0.01
        pos = max(1.0, min(4.0, (1 - y.mean()) / y.mean() / 3))  # the rarer class weighs more
        for _ in range(EPOCHS):
            order = rng.permutation(len(y))
            for b in range(0, len(y), BATCH):
                chosen = order[b : b + BATCH]
                own = np.concatenate([texts[c] for c in chosen])
                sizes = np.array([len(texts[c]) for c in chosen])
                begin = np.concatenate([[0], np.cumsum(sizes + margin)])
                place = np.arange(len(own)) + margin * np.repeat(np.arange(len(chosen)), sizes)
                x = np.zeros((begin[-1] + margin, WIDTH), np.float32)
                x[place] = self.embed(own)
                word = np.full(len(x), -1)
                word[place] = np.arange(len(own))
                values = self.responses(x, place)
                at = np.stack([values[lo:hi].argmax(0) + lo for lo, hi in zip(begin[:-1], begin[1:], strict=True)])
                best = values[at, np.arange(values.shape[1])] + self.shift
                hidden = np.maximum(best, 0)
                p = 1 / (1 + np.exp(-np.clip(hidden @ self.out + self.bias, -30, 30)))
                away = ((p - y[chosen]) * np.where(y[chosen] > 0, pos, 1) / len(chosen)).astype(np.float32)
                grads = [np.zeros_like(w) for w in self.filters]
                back = away[:, None] * self.out * (best > 0)
                places, steps = [], []
                for i, (k, w) in enumerate(zip(WIDTHS, self.filters, strict=True)):
                    for f in range(FILTERS):
                        c = i * FILTERS + f
                        for j in range(k):
                            grads[i][j, :, f] = back[:, c] @ x[at[:, c] + j]
                            places.append(at[:, c] + j)
                            steps.append(back[:, c, None] * w[j, :, f])
                grads += [back.sum(0), hidden.T @ away + DECAY * self.out]
                words = word[np.concatenate(places)]
                step = np.concatenate(steps)[words >= 0]
                touched = own[words[words >= 0]]
                for i, (t, m) in enumerate(zip(tables, moments, strict=True)):
                    where, inverse = np.unique(touched[:, i], return_inverse=True)
                    g = np.zeros((len(where), WIDTH), np.float32)
                    np.add.at(g, inverse, step)
                    m[where] += g * g
                    t[where] -= RATE * g / np.sqrt(m[where])
                for d, g, q in zip(dense, grads, squares, strict=True):
                    q += g * g
                    d -= RATE * g / np.sqrt(q)
                bias_square += float(away.sum()) ** 2
                self.bias -= np.float32(RATE * away.sum() / bias_square**0.5)


def threshold(logits: np.ndarray, y: np.ndarray) -> float:
    """The logit of least errors, in the middle of the widest gap between neighbours that reaches it."""
    order = np.argsort(logits, kind="stable")
    z, t = logits[order].astype(float), y[order]
    z = np.concatenate([[z[0] - 2], z, [z[-1] + 2]])
    errors = np.concatenate([[0], np.cumsum(t)]) + np.concatenate([np.cumsum((1 - t)[::-1])[::-1], [0]])
    gaps = np.where(errors == errors.min(), z[1:] - z[:-1], -1)
    i = int(gaps.argmax())
    return float((z[i] + z[i + 1]) / 2)


def train(texts: pa.Array, y: np.ndarray, learn: bool = True) -> Net | None:
    """A net fitted to the texts, with the thresholds of the languages; None if the labels aren't of both classes.

    Without `learn` the net stays as begin() leaves it, which shows what the training adds.
    """
    y = y.astype(np.float32)
    if not 0 < y.sum() < len(y):
        return None
    rows: list[np.ndarray] = []  # of each text; nothing is copied from here on but batches
    languages = []
    for _, _, raw, off in kernels.slices(texts):
        own, first, language_ = features(raw, off)
        rows += np.split(own, first[1:-1])
        languages.append(language_)
    language = np.concatenate(languages)
    fold = np.arange(len(y)) % FOLDS == 0
    if not 0 < y[~fold].sum() < (~fold).sum() or not 0 < y[fold].sum() < fold.sum():
        fold[:] = False
    net, learnt = Net(), np.flatnonzero(~fold)
    learnt = learnt[[len(rows[c]) > 0 for c in learnt]]  # a text without words has nothing to learn from
    if not 0 < y[learnt].sum() < len(learnt):
        return None
    chosen = [rows[c] for c in learnt]
    net.begin(chosen, y[learnt])
    if learn:
        net.fit(chosen, y[learnt])
    kept = np.flatnonzero(fold) if fold.any() else learnt
    logits = np.concatenate([net.logits(rows[c], np.array([0, len(rows[c])])) for c in kept])
    net.thresholds[:] = threshold(logits, y[kept])
    for n in range(len(LANGUAGES)):
        of_language = language[kept] == n
        if y[kept][of_language].sum() >= 10 and (1 - y[kept][of_language]).sum() >= 10:
            net.thresholds[n] = threshold(logits[of_language], y[kept][of_language])
    return net


def sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """text and toxic of at most `most` labelled rows that aren't held out. The chosen labels are at most twice as many rows."""
    known = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    order = [F.xxhash64("doc_id"), "doc_id", "toxic"]
    known = known.orderBy(*order).limit(2 * most)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where(F.length("text") <= SAMPLE_CHARS)
    return texts.join(F.broadcast(known), "doc_id").orderBy(*order, F.xxhash64("text")).limit(most).select("text", "toxic")


def fitted(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Net | None:
    try:
        rows = sample(docs, labels, most).toArrow()
        return train(rows.column("text").combine_chunks(), rows.column("toxic").to_numpy()) if rows.num_rows else None
    finally:
        rows = None
        kernels.release()


def score(docs: DataFrame, net: Net | None) -> DataFrame:
    """docs with `score` and `predicted`, which take the place of columns of these names."""
    docs = docs.drop("score", "predicted")
    at = docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = shared.value
            parts = [np.zeros(0)]
            for i, j, raw, off in kernels.slices(batch.column(at)):
                parts.append(np.zeros(j - i) if own is None else own.scores(raw, off))
            values = np.concatenate(parts)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values), pa.array((values >= 0.5).astype(np.int32))], [*batch.schema.names, "score", "predicted"])

    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(lambda it: kernels.tidy(scored(it)), f"{fields}, score double, predicted int")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    net = fitted(docs, table(spark, sf_dir, "labels"))
    return score(docs, net).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
