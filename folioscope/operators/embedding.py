"""Text to vectors. The model is a plug-in: a callable from a pandas series to a matrix."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql.functions import arrow_udf

from folioscope.operators.prepare import paper_projection
from folioscope.sources.corpus import with_year_month

Embedder = Callable[[pd.Series], np.ndarray]

_WORD = regex.compile(r"[\p{L}\p{N}_]{2,}")
_LATIN_WORD = re.compile(r"\w{2,}")
WORDS_KEPT = 1 << 18


SLICE_BYTES = 4 << 20  # of the texts that the model gets at once


class _Slots(dict):
    """Numbers of words by their digests, kept for words that come again."""

    def __missing__(self, word: str) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        slot = self[word] = int.from_bytes(hashlib.md5(word.encode()).digest()[:4], "big")
        return slot


_slots = _Slots()


def _words(text: str) -> list[str]:
    """Words of two or more letters or digits, in lower case."""
    text = text.lower()
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return _WORD.findall(text)
    return _LATIN_WORD.findall(text)  # the same for these characters


class HashedWords:
    """Signed hashing of words into ``dim`` sums, scaled to length one.

    Needs no model files. The low bits of a word's digest give the dimension, the next bit the
    sign. A text without words is the zero vector.
    """

    def __init__(self, dim: int = 64):
        self.dim = dim

    def __call__(self, texts: pd.Series) -> np.ndarray:
        sums = np.zeros((len(texts), self.dim))
        for row, text in enumerate(texts):  # the words of one text at a time are held
            slots = np.fromiter(map(_slots.__getitem__, _words(text)), np.int64)
            signs = 1.0 - 2.0 * (slots // self.dim % 2)
            sums[row] = np.bincount(slots % self.dim, weights=signs, minlength=self.dim)
        lengths = np.linalg.norm(sums, axis=1, keepdims=True)
        return sums / np.where(lengths == 0, 1.0, lengths)


_loaded: dict[str, Embedder] = {}


class LoadedModel:
    """A model that every Python process builds once, on its first text, and that has a name.

    Only ``name`` and ``factory`` travel to the workers. Vectors of models with different names are
    not comparable; the name is stored with them and decides whether they must be made again.
    """

    def __init__(self, name: str, factory: Callable[[], Embedder]):
        self.name, self.factory = name, factory

    def __call__(self, texts: pd.Series) -> np.ndarray:
        if self.name not in _loaded:
            _loaded.clear()  # one model at a time
            _loaded[self.name] = self.factory()
        return _loaded[self.name](texts)


def model_name(embedder: Embedder) -> str:
    """The name of a model; for one without, its class and what it was made with."""
    named = getattr(embedder, "name", None)
    if named:
        return str(named)
    settings = sorted(vars(embedder).items()) if hasattr(embedder, "__dict__") else []
    kind = getattr(embedder, "__qualname__", type(embedder).__qualname__)
    return kind + "".join(f" {k}={v}" for k, v in settings if isinstance(v, (int, float, str)))


def _slices(part: pa.Array) -> Iterator[pa.Array]:
    """The texts in runs of at most ``SLICE_BYTES``, or of one text; a single run when there are none."""
    if not len(part):
        yield part
    sizes = pc.fill_null(pc.binary_length(part), 0).to_numpy(zero_copy_only=False)
    ends, start = np.cumsum(sizes, dtype=np.int64), 0
    while start < len(part):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + SLICE_BYTES, side="right")))
        yield part.slice(start, stop - start)
        start = stop


def embed(
    df: DataFrame,
    embedder: Embedder,
    text: str = "text",
    out: str = "embedding",
    partitions: int | None = None,
) -> DataFrame:
    """Add a vector column computed by the embedder, one call per slice of an Arrow batch of texts.

    A null text gives a null vector. ``partitions`` first deals the rows evenly over so many
    tasks, worth its shuffle only for a slow model.
    """
    rows = df.repartition(partitions) if partitions else df

    def vectors_of(part: pa.Array) -> pa.Array:
        texts = part.to_pandas()
        known = texts.notna().to_numpy()
        vectors = np.zeros((0, 0), np.float32)
        if known.any():
            vectors = np.ascontiguousarray(embedder(texts[known]), dtype=np.float32)
        width = vectors.shape[1] if len(vectors) else 0
        offsets = np.concatenate([[0], np.cumsum(np.where(known, width, 0))])
        return pa.ListArray.from_arrays(
            pa.array(offsets, pa.int32()),
            pa.array(vectors.ravel(), pa.float32()),
            mask=pa.array(~known),
        )

    @arrow_udf("array<float>")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            yield pa.concat_arrays([vectors_of(some) for some in _slices(part)])

    return rows.withColumn(out, run(text))


def embed_query(text: str, embedder: Embedder) -> list[float]:
    """Vector of a single text."""
    return np.asarray(embedder(pd.Series([text])))[0].tolist()


def embed_papers(
    keyed: DataFrame,
    embedder: Embedder,
    partitions: int | None = None,
    chars: int | None = None,
) -> DataFrame:
    """Keyed papers to embedded papers: project, embed the text, drop it, add the year-month.

    Texts are embedded whole unless ``chars`` asks for their first characters only.
    """
    projected = paper_projection(keyed, chars)
    return with_year_month(embed(projected, embedder, partitions=partitions).drop("text"))
