"""Packing of token sequences by shortest-pack-first over the histogram of lengths.

Documents are tokenised, cut at the sequence length, and their pieces counted by length. Lengths
are placed longest first, each into the open packs with the most room, all packs of one pattern at
once; so the work depends on the number of lengths, not of documents. The slots of the patterns
are then given to the pieces of each length by rank.
"""

from __future__ import annotations

import heapq
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import kept, text_slices, words_of
from folioscope.session import cut

MEMO_WORDS = 400_000  # words whose ids a Python worker keeps
SLICE = 4_000_000
SPREAD = 64  # parts that the pieces of one length are ranked in


class WordIds:
    """Ids of texts, each distinct word between ASCII white space encoded once.

    Right for tokenizers that drop white space and whose words never reach over it, such as BPE
    with word ends: white space is a starter in normal forms, and no match includes it. Words of
    plain letters, alone or before signs, go through the same model without the normaliser and the
    pattern, which change nothing in them but their case and the border before the signs; they are
    told apart by their word ends. All others go through the tokenizer as it is.
    """

    PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!#$%&()*+,./:;=?@^_{|}~-]*)")
    TOGETHER = 2000

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.lean = Tokenizer.from_file(path)
        self.lean.normalizer = normalizers.Sequence([])
        self.lean.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.ends[i] = token.endswith("</w>")
        self.memo: dict[str, bytes] = {}

    def _whole(self, words: list[str]) -> None:
        found = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        self.memo.update(zip(words, (np.array(e.ids, "<u4").tobytes() for e in found), strict=True))

    def _plain(self, words: list[str], texts: list[str], each: int) -> None:
        for k in range(0, len(words), self.TOGETHER):
            some = words[k : k + self.TOGETHER]
            joined = " ".join(texts[k : k + self.TOGETHER]).lower()
            ids = np.array(self.lean.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
            stops = (np.flatnonzero(self.ends[ids]) + 1)[each - 1 :: each]
            if len(stops) != len(some) or stops[-1] != len(ids):
                self._whole(some)
                continue
            raw, start = ids.tobytes(), 0
            for word, stop in zip(some, (4 * stops).tolist(), strict=True):
                self.memo[word] = raw[start:stop]
                start = stop

    def _learn(self, words: list[str]) -> None:
        alone, signed, signed_texts, rest = [], [], [], []
        for word in words:
            m = self.PLAIN.fullmatch(word)
            if not m:
                rest.append(word)
            elif m[2]:
                signed.append(word)
                signed_texts.append(f"{m[1]} {m[2]}")
            else:
                alone.append(word)
        self._plain(alone, alone, 1)
        self._plain(signed, signed_texts, 2)
        self._whole(rest)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Token offsets by text, and all ids."""
        offsets, codes, distinct = words_of(texts)
        words = distinct.to_pylist()
        new = [w for w in words if w not in self.memo]
        if len(self.memo) + len(new) > MEMO_WORDS:
            self.memo, new = {}, words
        self._learn(new)
        own = [self.memo[w] for w in words]
        flat = np.frombuffer(b"".join(own), "<u4")
        sizes = np.array([len(x) // 4 for x in own], np.int64)
        starts = np.cumsum(sizes) - sizes
        each = sizes[codes] if len(codes) else sizes[:0]
        ends = np.concatenate([[0], np.cumsum(each)])
        # Position of each id in `flat`: the start of its word there, and its place in the word.
        at = np.repeat(starts[codes] - ends[:-1], each) + np.arange(ends[-1]) if len(codes) else ends[:0]
        return ends[offsets], flat[at]


def word_ids(path: str) -> WordIds:
    return kept(f"word ids {path}", lambda: WordIds(path))


def pieces(docs: DataFrame, path: str, size: int = 2048, end: int = 1) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): each document's ids and ``end``, cut at ``size``.

    A null text counts as empty: its one piece is the end id. One set of pieces for each row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, stop = word_ids(path), np.array([end], "<u4").tobytes()
        for batch, texts in text_slices(batches, size=SLICE):
            rows: list[tuple] = []
            ends, flat = words.encode(texts)
            for k, doc in enumerate(batch.column(0).to_pylist()):
                ids = flat[ends[k] : ends[k + 1]].tobytes() + stop
                total = len(ids) // 4
                for start in range(0, total, size):
                    part = ids[4 * start : 4 * (start + size)]
                    rows.append((doc, start, len(part) // 4, zlib.crc32(part), total))
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    return rows.mapInArrow(run, schema)


def patterns(histogram: dict[int, int], size: int) -> list[tuple[int, tuple[int, ...]]]:
    """(number of packs, their lengths) by shortest-pack-first.

    For each length the packs with the most room are filled, as many pieces as fit into each; all
    packs of a pattern are taken together, and only the last pattern a length meets is split. So a
    length adds at most three patterns, whatever the counts.
    """
    open_: list[tuple[int, tuple[int, ...], int]] = []  # (fill, lengths, packs), least filled first
    closed: list[tuple[int, tuple[int, ...]]] = []
    for length in sorted(histogram, reverse=True):
        left, back = histogram[length], []
        while left and open_ and size - open_[0][0] >= length:
            fill, own, packs = heapq.heappop(open_)
            each = (size - fill) // length
            whole = min(packs, left // each)
            if whole:
                back.append((fill + each * length, own + (length,) * each, whole))
                left -= whole * each
                packs -= whole
            if packs and left and left < each:
                back.append((fill + left * length, own + (length,) * left, 1))
                left, packs = 0, packs - 1
            if packs:
                heapq.heappush(open_, (fill, own, packs))
        each = size // length
        if left // each:
            back.append((each * length, (length,) * each, left // each))
        if left % each:
            back.append((left % each * length, (length,) * (left % each), 1))
        for fill, own, packs in back:
            if size - fill < 1:
                closed.append((packs, own))
            else:
                heapq.heappush(open_, (fill, own, packs))
    return closed + [(packs, own) for _, own, packs in open_]


def ranked(parts: DataFrame) -> DataFrame:
    """``parts`` with ``rank``: 0, 1, ... among the rows of a length.

    A length that most rows have is ranked in parts, and what comes before a part is added; the
    sums run over at most ``SPREAD`` rows a length.
    """
    spread = parts.withColumn("part", F.pmod(F.xxhash64("doc_id", "start"), F.lit(SPREAD)))
    within = Window.partitionBy("length", "part").orderBy("doc_id", "start", "ids_crc32")
    sums = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = spread.groupBy("length", "part").agg(F.count("*").alias("n")).select(
        "length", "part", F.coalesce(F.sum("n").over(sums), F.lit(0)).alias("before")
    )
    own = spread.withColumn("own", F.row_number().over(within) - 1)
    return own.join(before, ["length", "part"]).withColumn("rank", F.col("before") + F.col("own")).drop("part", "own", "before")


def slots(found: list[tuple[int, tuple[int, ...]]], size: int) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: first rank, first sequence and offset of each run of slots."""
    rows: dict[int, list[tuple[int, int, int]]] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for packs, lengths in found:
        offset = 0
        for length in lengths:
            first = taken.get(length, 0)
            rows.setdefault(length, []).append((first, sequence, offset))
            taken[length] = first + packs
            offset += length
        sequence += packs
    return {k: tuple(np.array(c, np.int64) for c in zip(*v, strict=True)) for k, v in rows.items()}


def pack(docs: DataFrame, path: str, size: int = 2048, end: int = 1) -> DataFrame:
    """The pieces of all documents with ``sequence_id`` and ``offset``.

    Sequences hold at most ``size`` tokens, without gaps from offset 0. An empty table gives none.
    The driver sees the histogram (at most ``size`` rows) and the patterns (at most three times as many).
    """
    parts = cut(pieces(docs, path, size, end), "pieces")
    counts = {r["length"]: r["count"] for r in parts.groupBy("length").count().collect()}
    table = docs.sparkSession.sparkContext.broadcast(slots(patterns(counts, size), size))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = table.value
        for batch in batches:
            lengths = batch["length"].to_numpy()
            rank = batch["rank"].to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for length in np.unique(lengths):
                at = np.flatnonzero(lengths == length)
                first, base, shift = known[int(length)]
                run = np.searchsorted(first, rank[at], "right") - 1
                sequence[at] = base[run] + rank[at] - first[run]
                offset[at] = shift[run]
            own = [batch[c] for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            yield pa.RecordBatch.from_arrays(
                [*own, pa.array(sequence), pa.array(offset)],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    schema = (
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
        "sequence_id long, offset long"
    )
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank"]
    return ranked(parts).select(columns).mapInArrow(place, schema)
