"""Topics as independent components of the document vectors.

Semantic signal separation (Kardos et al. 2024) with FastICA (Hyvarinen 1999). Every iteration
is one pass over the whitened vectors that returns sums of a size fixed by the topic count. Where
passes stand is kept in a small table, so that a later call goes on from there until they rest.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.functions import text as X
from folioscope.functions import vectors as V
from folioscope.operators import arrays as A
from folioscope.operators.embedding import Embedder, embed
from folioscope.operators.filters import valid_embeddings
from folioscope.operators.prepare import hash_sample
from folioscope.operators.stats import topic_doc_counts
from folioscope.session import cut, new_path
from folioscope.sources.snapshots import publish, read_published

TOP_TERMS = 10  # fixed value: terms listed per topic
MIN_DOCUMENTS = 1
TOLERANCE = 1e-4
MAX_PASSES = 400  # over the sample
WHOLE_STEPS = 20  # before steps get shorter
TABLE_PASSES = 10  # over all rows, in one call
STEP_PASSES = 20  # over all rows, before turns take the place of steps
TURN_TOPICS = 32  # at most, that turns are made for, as their sums grow with the cube
TURN_LENGTH = 0.3
TURN_FLOOR = 1e-3  # of the largest curvature; what is flatter counts as this
CALLS = 20  # after which topics that have not come to rest are an error
WARM_ROWS = 20_000
RANK_SHARE = 1e-9  # of the largest variance; a direction with less counts as none


@dataclass
class Components:
    """Mean of the vectors, one unmixing row per topic, and whether the iteration came to rest."""

    mean: np.ndarray
    unmixing: np.ndarray
    converged: bool = True
    passes: int = 0
    change: float = 0.0


class NotAtRest(RuntimeError):
    """The passes over the table have not come to rest within their bound."""


class TopicResult(NamedTuple):
    """Terms and counts of the topics, documents' weights, and one row about the result."""

    topics: DataFrame
    assignments: DataFrame
    record: DataFrame


def _decorrelate(w: np.ndarray) -> np.ndarray:
    """(W Wt)^-1/2 W"""
    values, vectors = np.linalg.eigh(w @ w.T)
    return vectors @ np.diag(1.0 / np.sqrt(np.maximum(values, 1e-300))) @ vectors.T @ w


def _update_sums(w: np.ndarray):
    """Sums of one FastICA pass with the log-cosh contrast, as a function of whitened rows."""

    def sums(z: np.ndarray) -> np.ndarray:
        g = np.tanh(z @ w.T)
        return np.concatenate([[len(z)], (g.T @ z).ravel(), (1.0 - g * g).sum(axis=0)])

    return sums


def _next(w: np.ndarray, total: np.ndarray) -> np.ndarray:
    k = len(w)
    n, gz, slope = total[0], total[1 : 1 + k * k].reshape(k, k), total[1 + k * k :]
    return _decorrelate(gz / n - (slope / n)[:, None] * w)


def _change(old: np.ndarray, new: np.ndarray) -> float:
    return float(np.abs(np.abs(np.einsum("ij,ij->i", old, new)) - 1.0).max())


def _step(w: np.ndarray, total: np.ndarray, number: int) -> tuple[np.ndarray, float]:
    """The next unmixing matrix, and how far a whole step would have changed this one.

    Steps get shorter with their number. Near a solution that whole steps jump to and fro about,
    as they do when sources are close to normal, shorter ones come to rest.
    """
    new = _next(w, total)
    change = _change(w, new)
    length = 1.0 if number < WHOLE_STEPS else max(0.02, 0.5 ** (1 + (number - WHOLE_STEPS) // 40))
    turned = np.where(np.einsum("ij,ij->i", w, new) < 0, -1.0, 1.0)[:, None] * new
    return (new if length == 1.0 else _decorrelate((1 - length) * w + length * turned)), change


def _turn_sums(w: np.ndarray):
    """``_update_sums``, followed by the sums that tell how the contrast bends under rotations."""
    steps = _update_sums(w)

    def sums(z: np.ndarray) -> np.ndarray:
        y = z @ w.T
        slope = 1.0 - np.tanh(y) ** 2
        bends = [((slope[:, i, None] * y).T @ y).ravel() for i in range(len(w))]
        return np.concatenate([steps(z), *bends])

    return sums


def _turn(w: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, float]:
    """The unmixing matrix after a Newton step over rotations, and how far a whole FastICA step
    would have changed this one.

    A FastICA step is such a step with a curvature that holds for independent sources only. Where
    sources are close to normal its error is as large as the curvature, and steps need not come to
    rest. The curvature taken from the rows has no such error; a point at rest is the same for both.
    """
    k = len(w)
    head, bends = total[: 1 + k * k + k], total[1 + k * k + k :].reshape(k, k, k) / total[0]
    change = _change(w, _next(w, head))
    a = head[1 : 1 + k * k].reshape(k, k) / head[0] @ w.T
    sign = np.where(np.diag(a) < head[1 + k * k :] / head[0], -1.0, 1.0)
    a, bends = sign[:, None] * a, sign[:, None, None] * bends
    below, above = np.tril_indices(k, -1)
    planes = np.zeros((len(below), k, k))  # generators of the rotations
    each = np.arange(len(below))
    planes[each, below, above], planes[each, above, below] = 1.0, -1.0
    flat = planes.reshape(len(planes), -1)
    slope = flat @ a.ravel()
    twice = -(planes @ a).reshape(len(planes), -1) @ flat.T
    curvature = np.einsum("ijl,aij->ail", bends, planes).reshape(len(planes), -1) @ flat.T + (twice + twice.T) / 2
    values, axes = np.linalg.eigh((curvature + curvature.T) / 2)
    size = np.abs(values)
    turn = axes @ ((axes.T @ slope) / np.maximum(size, max(TURN_FLOOR * size.max(initial=0.0), 1e-300)))
    turn *= min(1.0, TURN_LENGTH / max(np.linalg.norm(turn), 1e-300))
    by = np.tensordot(turn, planes, 1)
    return _decorrelate((np.eye(k) + by + by @ by / 2) @ w), change


def fit(
    df: DataFrame,
    n_components: int,
    seed: int = 42,
    tolerance: float = TOLERANCE,
    max_passes: int = MAX_PASSES,
    table_passes: int = TABLE_PASSES,
    key: str = "arxiv_id",
    state: str | None = None,
) -> Components:
    """Independent components of the vectors, each with unit variance and positive skew.

    The iteration starts from the solution for a bounded hash sample, so that few passes over
    the whole table remain. Where ``STEP_PASSES`` of them do not end it, Newton steps follow, also one
    pass each. It ends when a pass over all rows changes nothing more, or after
    ``table_passes`` of them with ``converged`` false; then another call with the same folder
    ``state`` goes on where this one stopped, if the vectors are still the same. Asking for more
    topics than the vectors have directions with variance is an error.
    """
    if n_components < 1:
        raise ValueError("n_components must be at least 1")
    rows = valid_embeddings(df).select(key, "embedding")
    n, mean, cov = A.moments(rows, "embedding")
    if n < n_components + 1:
        raise ValueError(
            f"{n_components} topics take at least {n_components + 1} vectors, here are {n}"
        )
    values, axes = A.principal_axes(cov, n_components)
    rank = int((values > RANK_SHARE * max(values[0], 0.0)).sum())
    if rank < n_components:
        raise ValueError(f"the vectors vary in {rank} directions only; ask for {rank} topics at most")
    whitening = axes / np.sqrt(values)[:, None]
    white = cut(rows.select(key, A.coordinates("embedding", mean, whitening).alias("z")), "whitened")

    k = len(whitening)
    basis = hashlib.md5(np.round(np.concatenate([[n], mean, whitening.ravel()]), 6).tobytes()).hexdigest()
    last = _stopped_at(df.sparkSession, state, basis)
    if last is None:
        w = _decorrelate(np.random.default_rng(seed).standard_normal((k, k)))
        sample = A.matrix(hash_sample(white, key, n, WARM_ROWS, seed).select("z").toArrow()["z"])
        for steps in range(max_passes):
            w, change = _step(w, _update_sums(w)(sample), steps)
            if change < tolerance:
                break
        passes, change = 0, np.inf
    else:
        w, steps = np.array(last["w"]).reshape(k, k), last["steps"]
        passes, change = last["passes"], last["change"]
    for _ in range(table_passes):
        if change < tolerance:
            break
        if passes < STEP_PASSES or not 1 < k <= TURN_TOPICS:
            w, change = _step(w, A.sum_over(white, "z", _update_sums(w)), steps)
        else:
            w, change = _turn(w, A.sum_over(white, "z", _turn_sums(w)))
        passes, steps = passes + 1, steps + 1
    if state is not None:
        row = [(basis, w.ravel().tolist(), steps, passes, change)]
        kinds = "basis string, w array<double>, steps int, passes int, change double"
        publish(df.sparkSession.createDataFrame(row, kinds), state)
    skew = A.sum_over(white, "z", lambda z: ((z @ w.T) ** 3).sum(axis=0))
    w = w * np.where(skew < 0, -1.0, 1.0)[:, None]
    return Components(mean, w @ whitening, change < tolerance, passes, float(change))


def _stopped_at(spark: SparkSession, state: str | None, basis: str):
    """The row that the last call left in ``state`` for the same vectors, or None."""
    rows = None if state is None else read_published(spark, state)
    return None if rows is None else rows.where(F.col("basis") == basis).first()


def fit_to_rest(df: DataFrame, n_components: int, state: str, seed: int = 42, calls: int = CALLS, **options) -> Components:
    """``fit`` called until the passes rest; ``NotAtRest`` after ``calls`` of them.

    What was reached stays in ``state``, so a job that was lost, or stopped here, goes on from it.
    """
    for _ in range(calls):
        components = fit(df, n_components, seed, state=state, **options)
        if components.converged:
            return components
    raise NotAtRest(
        f"{n_components} topics still change by {components.change:.1e} after {components.passes} passes; "
        f"call again with {state} to go on, or ask for fewer topics"
    )


def topic_weights(df: DataFrame, components: Components) -> DataFrame:
    """Rows that have a vector, which is replaced by ``topic_weights`` and ``dominant_topic``."""
    weights = A.coordinates("embedding", components.mean, components.unmixing)
    weighed = valid_embeddings(df).withColumn("topic_weights", weights).drop("embedding")
    return weighed.withColumn("dominant_topic", V.dominant_topic("topic_weights"))


def assign_topics(weighed: DataFrame) -> DataFrame:
    """(id, rounded weights, dominant topic) rows."""
    return weighed.select(
        "arxiv_id", V.round_all("topic_weights").alias("topic_weights"), "dominant_topic"
    )


def top_terms(scored: DataFrame, n: int = TOP_TERMS) -> DataFrame:
    """The ``n`` strongest rows of each topic; equal weights by term."""
    window = Window.partitionBy("topic_id").orderBy(F.desc("weight"), "term")
    ranked = scored.withColumn("rank", F.row_number().over(window))
    return ranked.where(F.col("rank") <= n).select("topic_id", "rank", "term", "weight")


def term_weights(
    weighed: DataFrame,
    n_topics: int,
    min_documents: int = MIN_DOCUMENTS,
    chars: int | None = None,
) -> DataFrame:
    """(topic_id, term, weight) of every term of the vocabulary.

    A term's vector is the mean vector of the documents that hold it. Components are linear, so
    its weight in a topic is the mean weight of those documents: one aggregation by term, summed
    within each map task first, which keeps words that are everywhere cheap.
    """
    worded = weighed.select(
        F.explode(X.terms(X.embed_text(chars=chars))).alias("term"),
        *[F.col("topic_weights")[i].alias(f"w{i}") for i in range(n_topics)],
    )
    means = worded.groupBy("term").agg(
        F.count("*").alias("n"),
        *[F.round(F.avg(f"w{i}"), 6).alias(f"w{i}") for i in range(n_topics)],
    )
    entries = F.array(
        *[
            F.struct(F.lit(i).alias("topic_id"), F.col(f"w{i}").alias("weight"))
            for i in range(n_topics)
        ]
    )
    kept = means.where(F.col("n") >= min_documents)
    return kept.select("term", F.explode(entries).alias("e")).select("e.topic_id", "term", "e.weight")


def model_term_weights(
    weighed: DataFrame,
    components: Components,
    embedder: Embedder,
    min_documents: int = MIN_DOCUMENTS,
    chars: int | None = None,
) -> DataFrame:
    """(topic_id, term, weight) of every term, by the model's own vector of the term.

    The distinct terms of at least ``min_documents`` documents are embedded as texts, a table spread
    over all tasks, and projected on the components like documents.
    """
    terms = weighed.select(F.explode(X.terms(X.embed_text(chars=chars))).alias("term"))
    vocabulary = terms.groupBy("term").count().where(F.col("count") >= min_documents).select("term")
    vectors = embed(vocabulary, embedder, text="term")
    projected = A.coordinates("embedding", components.mean, components.unmixing)
    entries = vectors.select("term", F.posexplode(projected).alias("topic_id", "weight"))
    return entries.select("topic_id", "term", F.round("weight", 6).alias("weight"))


def topic_terms(
    weighed: DataFrame,
    n_topics: int,
    n: int = TOP_TERMS,
    min_documents: int = MIN_DOCUMENTS,
    assignments: DataFrame | None = None,
    model: tuple[Components, Embedder] | None = None,
) -> DataFrame:
    """(topic_id, rank, term, weight, doc_count): the top terms of each topic.

    Terms are weighed by the documents that hold them, or by the vectors that ``model`` gives them.
    A topic without a term keeps one row, with its count. Documents are counted from
    ``assignments`` where these are stored already.
    """
    scored = (
        term_weights(weighed, n_topics, min_documents) if model is None
        else model_term_weights(weighed, *model, min_documents)
    )
    counts = topic_doc_counts(weighed if assignments is None else assignments, n_topics)
    return counts.join(top_terms(scored, n), "topic_id", "left").select(
        "topic_id", "rank", "term", F.round("weight", 4).alias("weight"), "doc_count"
    )


def extract_topics(
    df: DataFrame,
    n_components: int = 10,
    top_n: int = TOP_TERMS,
    seed: int = 42,
    min_documents: int = MIN_DOCUMENTS,
    embedder: Embedder | None = None,
    state: str | None = None,
    key: str = "",
) -> TopicResult:
    """Topic terms, document assignments and the record of the papers that have a vector.

    The fit is run to rest. ``embedder`` weighs terms by the model's vectors. The record counts
    papers and vectors and says how the fit ended; ``key`` is the request it answers.
    """
    spark = df.sparkSession
    components = fit_to_rest(df, n_components, state or new_path(spark, "topic-passes"), seed)
    weighed = topic_weights(df, components)
    assignments = cut(assign_topics(weighed), "assignments")
    model = None if embedder is None else (components, embedder)
    found = topic_terms(weighed, n_components, top_n, min_documents, assignments, model)
    record = df.agg(
        F.lit(key).alias("cache_key"), F.lit(n_components).alias("n_components"),
        F.count("*").alias("paper_count"), F.count("embedding").alias("valid_embedding_count"),
        F.lit(components.converged).alias("converged"), F.lit(components.passes).alias("passes"),
    )
    return TopicResult(found, assignments, record)


def save_topics(result: TopicResult, root: str, key: str) -> None:
    """Store a topic result under its request key, as a new version."""
    for part, df in result._asdict().items():
        publish(df, f"{root}/{part}/key={key}")


def load_topics(spark: SparkSession, root: str, key: str) -> TopicResult | None:
    """A stored topic result, or None when it is not stored whole under the key."""
    parts = [read_published(spark, f"{root}/{part}/key={key}") for part in TopicResult._fields]
    return None if any(part is None for part in parts) else TopicResult(*parts)
