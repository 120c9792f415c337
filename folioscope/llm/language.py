"""Language by compression: the language whose dictionary compresses a text best.

For each language that the labelled rows name, a raw-content zstandard dictionary is filled with
text of that language. A text is compressed with every dictionary, in blocks, so that the
dictionaries matter for all of a long text; the smallest total wins. A narrow margin is a rejection.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import text_slices

DICTIONARY_CHARS = 200_000  # of each language at most; as many rows are taken as fit
SAMPLE_ROWS = 4000  # labelled rows that fill the dictionaries at most
ROW_CHARS = 300  # characters of such a row at most; prediction reads all
LEAST_ROWS = 40  # rows that a language may have, however many languages there are
BLOCK = 4096  # bytes compressed together
LEVEL = 3
NARROW = 0.02  # margin below which a prediction counts as rejected
UNKNOWN = "und"


_OTHER = re.compile(r"[\W\d_]+")


def plain(text: str) -> str:
    """Lower-case words with one space between, so that layout and signs do not count."""
    return _OTHER.sub(" ", text).lower()


@dataclass
class Dictionaries:
    contents: dict[str, bytes]

    def __post_init__(self) -> None:
        import zstandard

        self.names = list(self.contents)  # most frequent first
        self.compressors = []
        for name in self.names:
            data = zstandard.ZstdCompressionDict(self.contents[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(level=LEVEL)
            self.compressors.append(
                zstandard.ZstdCompressor(
                    level=LEVEL, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False
                )
            )

    def sizes(self, text: str) -> list[int]:
        raw = plain(text).encode()
        blocks = [raw[k : k + BLOCK] for k in range(0, len(raw), BLOCK)]
        return [sum(len(c.compress(b)) for b in blocks) for c in self.compressors]

    def predict(self, text: str) -> tuple[str, float, bool]:
        """Language, score and whether the margin is narrow.

        The score is 1 - best / second best, seen relative to what a clear margin is, from 0 to 1.
        """
        sizes = self.sizes(text)
        order = sorted(range(len(sizes)), key=lambda k: (sizes[k], k))
        best = order[0]
        margin = 1 - sizes[best] / sizes[order[1]] if len(order) > 1 else 1.0
        return self.names[best], 1 - 0.5 ** (margin / NARROW), margin < NARROW


def fit(docs: DataFrame, usable: object = None) -> Dictionaries:
    """Dictionaries from a bounded sample of rows with text and lang that the condition allows.

    All languages share SAMPLE_ROWS rows evenly, or have LEAST_ROWS if that is more, taken in the
    order of a hash of their ids and texts; no language can crowd out another, and nothing of what is
    taken is cut off. Repeated rows count once. Rows far down in that order are left out where they
    lie, by the number of different rows of their language, so only some twice the sample is ranked.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") > 0))
    if usable is not None:
        rows = rows.where(usable)
    # A row's share of the dictionary lies where its hash says, not always at its head.
    start = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.greatest(F.length("text") - ROW_CHARS, F.lit(1))).cast("int") + 1
    part = F.col("text").substr(start, F.lit(ROW_CHARS))
    rows = rows.select("lang", F.xxhash64("doc_id", "text").alias("h"), "doc_id", part.alias("part"))
    known = rows.groupBy("lang").agg(F.count("*").alias("rows"), F.approx_count_distinct("h").alias("n"))
    counts = known.orderBy(F.desc("rows"), "lang").collect()
    each = max(LEAST_ROWS, min(SAMPLE_ROWS // max(1, len(counts)), DICTIONARY_CHARS // ROW_CHARS))
    near = F.pmod("h", F.lit(1 << 31)) < F.least(F.lit(2.0 * each + 50) / F.col("n"), F.lit(1.0)) * F.lit(float(1 << 31))
    # A local table, so Spark knows how small it is and rows stay where they lie.
    sizes = docs.sparkSession.createDataFrame([(r["lang"], r["n"]) for r in counts], "lang string, n long")
    some = rows.join(sizes, "lang").where(near).select("lang", "h", "doc_id", "part").distinct()
    first = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id", "part"))
    top = some.withColumn("n", first).where(F.col("n") <= each).select("lang", "n", "part").toArrow()
    texts = {row["lang"]: {} for row in counts}
    for lang, _, text in sorted(zip(*(top[c].to_pylist() for c in ("lang", "n", "part")), strict=True)):
        texts[lang][text] = None
    return Dictionaries({k: " ".join(map(plain, own)).encode() for k, own in texts.items()})


_letter = r"\p{L}"


def predict(docs: DataFrame, dictionaries: Dictionaries) -> DataFrame:
    """(doc_id, lang_pred, score, rejected), one row for each row, from the text alone.

    Texts that are null or have no letter get ``und`` and 0, as do all texts when no language was
    learned. Ties go to the language with more learned rows. Rejected rows keep their best language.
    """
    model = docs.sparkSession.sparkContext.broadcast(dict(dictionaries.contents))
    own: list[Dictionaries] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not own:
            own.append(Dictionaries(model.value))
        for batch, texts in text_slices(batches):
            letters = pc.match_substring_regex(texts, _letter).to_pylist()
            out = [
                own[0].predict(t) if letter and own[0].names else (UNKNOWN, 0.0, True)
                for t, letter in zip(texts.to_pylist(), letters, strict=True)
            ]
            lang, score, rejected = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lang, pa.string()), pa.array(np.array(score)), pa.array(rejected, pa.bool_())],
                ["doc_id", "lang_pred", "score", "rejected"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")
