"""Encoding and decoding with merge-type SentencePiece vocabularies.

Encoding runs a score-ordered agenda of adjacent symbol pairs: of all neighbours whose
concatenation is a piece, those with the highest score are merged first, the left one on ties. No
piece has a space mark after another character, so pairs never cross the start of a word and each
distinct word of a batch is encoded once. All its words advance together, one merge a round.
Every new word is checked against the sentencepiece library, which also decodes.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import text_slices

SPACE = "▁"
MEMO_WORDS = 250_000  # words whose ids a Python worker keeps
SLICE = 2_000_000
NEVER = np.int64(2**62)


class Agenda:
    """Merge tables of a vocabulary."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.sp = sp = SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        if any(sp.is_unused(i) for i in range(n)):
            raise ValueError("vocabularies with unused pieces are not supported")
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        names = {sp.id_to_piece(i): i for i in plain}
        # SentencePiece keeps the first of equal names; scores decide the order of merges.
        self.words = not any(SPACE in p.lstrip(SPACE) for p in names)
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        letters = sorted({c for p in names for c in p})
        extra = {c: n + k for k, c in enumerate(c for c in letters if c not in names)}
        self.n = n
        self.stranger = n + len(extra)  # stands for all characters outside the vocabulary
        self.symbol = np.full(0x110000, self.stranger, np.int32)  # by code point
        for c in letters:
            self.symbol[ord(c)] = names[c] if c in names else extra[c]
        known = names | extra
        scores = np.array([sp.get_score(i) for i in range(n)])
        pairs: dict[tuple[int, int], int] = {}
        for piece, i in names.items():
            for k in range(1, len(piece)):
                left, right = known.get(piece[:k]), known.get(piece[k:])
                if left is not None and right is not None:
                    pairs[left, right] = i
        order = {s: r for r, s in enumerate(sorted(set(scores.tolist()), reverse=True))}
        self.base = self.stranger + 1
        keys = np.array([a * self.base + b for a, b in pairs], np.int64)
        merged = np.array(list(pairs.values()), np.int64)
        rank = np.array([order[s] for s in scores[merged].tolist()], np.int64)
        self._table(keys, merged, rank)
        self.memo: dict[str, list[int]] = {}
        self.ints = list(range(n))
        self.breaks = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")

    def _table(self, keys: np.ndarray, merged: np.ndarray, rank: np.ndarray) -> None:
        """Pairs in a hash table of four times their number, with linear probing."""
        self.bits = max(4, int(len(keys) * 4).bit_length())
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.slot_id, self.slot_rank = np.zeros(size, np.int64), np.zeros(size, np.int64)
        self.probes = 1
        for key, m, r, at in zip(keys.tolist(), merged.tolist(), rank.tolist(), self._slot(keys).tolist(), strict=True):
            probes = 1
            while self.keys[at] != -1:
                at, probes = (at + 1) & (size - 1), probes + 1
            self.keys[at], self.slot_id[at], self.slot_rank[at] = key, m, r
            self.probes = max(self.probes, probes)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        spread = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (spread >> np.uint64(64 - self.bits)).astype(np.int64)

    def _ranked(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and id of the piece that each pair makes; NEVER where there is none."""
        keys = left * self.base + right
        at = self._slot(keys)
        found = self.keys[at]
        open_ = np.flatnonzero((found != keys) & (found != -1))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & (len(self.keys) - 1)
            here = self.keys[at[open_]]
            open_ = open_[(here != keys[open_]) & (here != -1)]
        hit = self.keys[at] == keys
        return np.where(hit, self.slot_rank[at], NEVER >> 32), self.slot_id[at]

    def agenda(self, words: Sequence[str]) -> list[list[int]]:
        """Ids of words that have at least one character."""
        lengths = np.array([len(w) for w in words], np.int64)
        text = "".join(words)
        symbols = self.symbol[np.frombuffer(text.encode("utf-32-le"), np.uint32)].astype(np.int64)
        # A merged symbol keeps the position of its first character; `word` is the row it is in.
        place = np.arange(len(text))
        word = np.repeat(np.arange(len(words)), lengths)
        done_word, done_symbol, done_place = [], [], []
        same = word[:-1] == word[1:]
        rank, piece = self._ranked(symbols[:-1], symbols[1:])
        rank, piece = np.append(np.where(same, rank, NEVER >> 32), NEVER >> 32), np.append(piece, 0)
        while len(symbols):
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            best = np.minimum.reduceat((rank << 31) | np.arange(len(rank)), first)
            live = best < ((NEVER >> 32) << 31)
            rows = np.diff(np.append(first, len(symbols)))
            if not live.all():
                over = np.repeat(~live, rows)
                done_word.append(word[over])
                done_symbol.append(symbols[over])
                done_place.append(place[over])
                kept = ~over
                shift = np.cumsum(over)
                at = best[live] & ((1 << 31) - 1)
                at -= shift[at]
                symbols, word, place, rank, piece = (x[kept] for x in (symbols, word, place, rank, piece))
                if not len(symbols):
                    break
            else:
                at = best & ((1 << 31) - 1)
            symbols[at] = piece[at]
            kept = np.ones(len(symbols), bool)
            kept[at + 1] = False
            at -= np.arange(len(at))  # one symbol has gone in every word before
            symbols, word, place, rank, piece = (x[kept] for x in (symbols, word, place, rank, piece))
            last = len(symbols) - 1
            fresh = np.concatenate([at, at[at > 0] - 1])
            fresh = fresh[fresh < last] if last > 0 else fresh[:0]
            fresh = fresh[word[fresh] == word[fresh + 1]]
            edge = at[(at == last) | (word[at] != word[np.minimum(at + 1, last)])]
            rank[edge] = NEVER >> 32
            rank[fresh], piece[fresh] = self._ranked(symbols[fresh], symbols[fresh + 1])
        word, symbols, place = (np.concatenate(x) for x in (done_word, done_symbol, done_place))
        order = np.argsort(place, kind="stable")
        word, symbols, place = word[order], symbols[order], place[order]
        ends = np.searchsorted(word, np.arange(len(words)), "right").tolist()
        ints, n = self.ints, self.n
        ids, out, start = symbols.tolist(), [], 0
        odd = symbols >= n
        strange = set(word[odd].tolist()) if odd.any() else ()
        for k, end in enumerate(ends):
            if k in strange:
                own: list[int] = []
                for i, p in zip(ids[start:end], place[start:end].tolist(), strict=True):
                    own.extend([ints[i]] if i < n else [self.bytes[b] for b in text[p].encode()])
                out.append(own)
            else:
                out.append([ints[i] for i in ids[start:end]])
            start = end
        return out

    def encode(self, texts: Sequence[str]) -> list[list[int]]:
        """Ids of the texts, without begin and end ids."""
        parts = []
        for text in texts:
            marked = SPACE + text.replace(" ", SPACE)
            parts.append(([] if not text else self.breaks.findall(marked)) if self.words else [marked] * bool(text))
        new = list({w for p in parts for w in p} - self.memo.keys())
        if len(self.memo) + len(new) > MEMO_WORDS:
            self.memo, new = {}, list({w for p in parts for w in p})
        if new:
            found = self.agenda(new)
            asked = [k for k, w in enumerate(new) if len(w) > 1]
            for k, ids in zip(asked, self.sp.encode([new[k][1:] for k in asked], num_threads=1), strict=True):
                if ids != found[k]:
                    raise ValueError(f"agenda and library differ on {new[k]!r}")
            self.memo.update(zip(new, found, strict=True))
        get = self.memo.__getitem__
        return [[i for w in p for i in get(w)] for p in parts]


_agendas: dict[str, Agenda] = {}


def agenda_of(path: str) -> Agenda:
    """The tables of a vocabulary, made once in a Python worker."""
    if path not in _agendas:
        _agendas[path] = Agenda(path)
    return _agendas[path]


def encode(docs: DataFrame, path: str, decoded: bool = True) -> DataFrame:
    """(doc_id, ids, decoded): token ids of each text, and what the library makes of them again.

    One row for each row, in no order. A null text counts as empty: no ids, empty text. ``path`` is
    the vocabulary file, readable on every executor. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        agenda = agenda_of(path)
        for batch, texts in text_slices(batches, size=SLICE):
            ids = agenda.encode(texts.to_pylist())
            back = agenda.sp.decode(ids, num_threads=1) if decoded and ids else [None] * len(ids)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(back, pa.string())],
                ["doc_id", "ids", "decoded"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) from the ids and texts of ``encode``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        agenda = agenda_of(path)
        for batch, texts in text_slices(batches, size=SLICE):
            ids = agenda.encode(texts.to_pylist())
            back = agenda.sp.decode(ids, num_threads=1) if ids else []
            sha = [hashlib.sha256(",".join(map(str, i)).encode()).hexdigest() for i in ids]
            sha_back = [hashlib.sha256(t.encode()).hexdigest() for t in back]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(i) for i in ids], pa.int64()), pa.array(sha), pa.array(sha_back)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
