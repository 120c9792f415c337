"""Quality classifier: learned vectors of hashed words and character n-grams, averaged, softmax.

A text's features are its words, their character n-grams (3 to 5 characters, with word borders),
and word pairs reduced to whether a word repeats one of the four before it. Every feature has a
learned vector; the text is their mean; a softmax layer gives the class. Training is plain
stochastic gradient descent in numpy on a bounded sample of labelled rows. As the last layer is
linear, a text is then scored by the mean of one number per feature.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import hash_words, kept, labelled_sample, mixed, text_slices, words_of

BITS = 17  # 2 ** BITS vectors
WIDTH = 6
GRAMS = (3, 4, 5)
BACK = 4
SLICE_WORDS = 16_384  # distinct words whose features are found together
SAMPLE_ROWS = 4000  # labelled rows that training sees at most
SAMPLE_CHARS = 2400  # characters of each that training reads at most; scoring reads all
EPOCHS = 6
RATE = 0.5
STEP = np.uint64(0x9E3779B97F4A7C15)


def _cell(hashes: np.ndarray) -> np.ndarray:
    return (mixed(hashes) >> np.uint64(64 - BITS)).astype(np.int64)


def word_features(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Feature cells of distinct words, one run per word: offsets and cells.

    Words are taken SLICE_WORDS at a time, as the arrays in between are far larger than the result.
    """
    parts = [_features(words.slice(k, SLICE_WORDS)) for k in range(0, max(1, len(words)), SLICE_WORDS)]
    sizes, cells = zip(*parts, strict=True)
    return np.concatenate([[0], np.cumsum(np.concatenate(sizes))]), np.concatenate(cells)


def _features(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Number of features of each word, and the cells of all."""
    texts = words.to_pylist()
    joined = "".join(f"<{w}>" for w in texts)
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.uint64)
    lengths = np.array([len(w) + 2 for w in texts], np.int64)
    ends = np.cumsum(lengths)
    owner = np.repeat(np.arange(len(texts)), lengths)
    room = np.repeat(ends, lengths) - np.arange(len(points))  # characters left in the word
    cells, owners = [_cell(hash_words(words))], [np.arange(len(texts))]
    h = np.zeros(len(points), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        part = points[n - 1 :]
        h[: len(part)] = h[: len(part)] * STEP + part + np.uint64(1)
        if n in GRAMS:
            at = np.flatnonzero(room >= n)
            cells.append(_cell(h[at] + np.uint64(n)))
            owners.append(owner[at])
    cell, own = np.concatenate(cells), np.concatenate(owners)
    order = np.argsort(own, kind="stable")
    return np.bincount(own, minlength=len(texts)), cell[order].astype(np.int32)


def _repeats(offsets: np.ndarray, codes: np.ndarray) -> list[np.ndarray]:
    """For each distance up to BACK: is the word the same as the one so far before it in its text?"""
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    out = []
    for k in range(1, BACK + 1):
        same = np.zeros(len(codes), bool)
        same[k:] = (codes[k:] == codes[:-k]) & (doc[k:] == doc[:-k])
        out.append(same)
    return out


_MARKS = _cell(np.arange(1, BACK + 1, dtype=np.uint64) * STEP)


def train(rows: list[tuple[str, int]], seed: int = 7) -> np.ndarray:
    """Log-odds of class 1 that each feature cell stands for; the last number is the bias."""
    weights = np.zeros((1 << BITS) + 1)
    classes = {y for _, y in rows}
    if len(classes) < 2:  # nothing to tell apart
        weights[-1] = 4.0 if classes == {1} else -4.0 if classes == {0} else 0.0
        return weights
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1, 1, (1 << BITS, WIDTH)) / WIDTH
    out, bias = np.zeros((2, WIDTH)), np.zeros(2)
    texts = pa.array([t for t, _ in rows], pa.string())
    labels = np.array([y for _, y in rows])
    offsets, codes, distinct = words_of(texts)
    starts, cells = word_features(distinct)
    sizes = np.diff(starts)
    repeats = _repeats(offsets, codes)

    def bag(i: int) -> tuple[np.ndarray, np.ndarray]:
        """Cells of a text and their shares; made anew for each step, as all bags together are large."""
        a, b = offsets[i], offsets[i + 1]
        own, times = np.unique(codes[a:b], return_counts=True)
        many = sizes[own]
        at = np.arange(many.sum()) + np.repeat(starts[own] - (np.cumsum(many) - many), many)
        ids = np.concatenate([cells[at], _MARKS])
        marks = [r[a:b].sum() for r in repeats]
        weight = np.concatenate([np.repeat(times, many), marks]).astype(float)
        return ids, weight / max(1.0, weight.sum())

    steps, done = EPOCHS * len(rows), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            rate = RATE * (1 - done / steps)
            done += 1
            ids, weight = bag(i)
            mean = weight @ vectors[ids]
            z = out @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = p @ out
            out -= rate * np.outer(p, mean)
            bias -= rate * 0.1 * p
            # Scaling by the bag's size instead of its mean lets sparse features learn at all.
            np.subtract.at(vectors, ids, (rate * 20) * weight[:, None] * back)
    weights[:-1] = vectors @ (out[1] - out[0])
    weights[-1] = bias[1] - bias[0]
    return weights


def scores(texts: pa.Array, weights: np.ndarray) -> np.ndarray:
    """Probability of class 1 for each text."""
    offsets, codes, distinct = words_of(texts)
    n = len(offsets) - 1
    if not len(codes):
        return np.full(n, 1 / (1 + np.exp(-weights[-1])))
    starts, cells = word_features(distinct)
    sums = np.add.reduceat(weights[cells], starts[:-1])
    total = np.concatenate([[0.0], np.cumsum(sums[codes])])
    count = np.concatenate([[0], np.cumsum(np.diff(starts)[codes])])
    value, many = total[offsets[1:]] - total[offsets[:-1]], count[offsets[1:]] - count[offsets[:-1]]
    for mark, same in zip(_MARKS, _repeats(offsets, codes), strict=True):
        seen = np.concatenate([[0], np.cumsum(same)])
        seen = seen[offsets[1:]] - seen[offsets[:-1]]
        value, many = value + weights[mark] * seen, many + seen
    return 1 / (1 + np.exp(-np.clip(value / np.maximum(many, 1) + weights[-1], -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, fold: int = 0) -> np.ndarray:
    """Train on at most SAMPLE_ROWS labelled rows outside the fold."""
    return train(labelled_sample(docs, labels, "quality", fold, SAMPLE_ROWS, SAMPLE_CHARS))


def score(docs: DataFrame, weights: np.ndarray, column: str = "score") -> DataFrame:
    """``docs`` with ``column``, the probability that a text is good, over the whole text.

    Null and empty texts and texts without words get the score of the bias alone. Equal texts
    score alike; a column of that name is replaced; all other columns are kept.
    """
    model = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float64))

    @F.arrow_udf("double")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kept(None)
        for part in parts:
            batch = pa.RecordBatch.from_arrays([part], ["text"])
            found = [scores(texts, model.value) for _, texts in text_slices([batch])]
            yield pa.array(np.concatenate(found) if found else np.zeros(0))

    return docs.withColumn(column, run("text"))
