"""Token counts by byte-pair merging, without token ids.

The symbols of a word form a doubly linked list, and a heap holds its adjacent pairs that have a
merge rank. The pair of the lowest rank, the leftmost of equals, is popped and merged until the heap
is empty; a merge takes one symbol away, so a word has as many tokens as it had symbols, less its
merges. No id is looked up or written. Counts of short words are kept from text to text.

Texts are normalised and split into words as the vocabulary file says. Where the file asks for the
usual rules (composed characters, lower case, runs of letters, single digits, runs of signs) and a
text has only characters whose class has not changed between Unicode versions, that is one pattern;
all other texts and files go through the normaliser and splitter that the library built from the file.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import kept, text_slices

KEPT_WORDS = 400_000  # counts that a Python worker keeps
KEPT_LENGTH = 64  # longer words are counted anew each time
SHIFT = 24  # bits of a symbol in the key of a pair
PLACE = 40  # bits of a place in a heap entry
# Characters with one class in all Unicode versions from 15 on.
SETTLED = re.compile("[\x00-\u0557\u1e00-\u206f\u20a0-\u20bf\u2100-\u2bff\u3000-\u9fef\uac00-\ud7a3\uff00-\uffef\U0001f300-\U0001f6cf]*")
# The rules of the vocabulary file that the one pattern stands for.
USUAL_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
USUAL_SPLIT = {"behavior": "Removed", "invert": True}


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if printable, else the next free one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(free)) for b in range(256)]


class TokenCounter(dict):
    """Number of tokens of words; a word that is asked for and not known is merged and kept."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            rules = json.load(file)
        model = rules["model"]
        if model["type"] != "BPE" or model.get("ignore_merges") or model.get("continuing_subword_prefix"):
            raise ValueError(f"{path} is not a plain byte-pair vocabulary")
        vocabulary, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        self.inside = {c: vocabulary[c] for c in byte_letters()}
        self.last = {c: vocabulary[c + suffix] for c in byte_letters()}
        self.inside_bytes = [self.inside[c] for c in byte_letters()]
        self.last_bytes = [self.last[c] for c in byte_letters()]
        self.ranks, self.merged = {}, array("i")
        for rank, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.ranks.setdefault(vocabulary[left] << SHIFT | vocabulary[right], rank)
            self.merged.append(vocabulary[left + right])
        added = rules["added_tokens"]
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError(f"{path} has added tokens with rules of their own")
        names = sorted((t["content"] for t in added), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, names))) if names else None
        self.pattern = self._usual(rules)

    @staticmethod
    def _usual(rules: dict) -> regex.Pattern | None:
        normalizers = (rules["normalizer"] or {}).get("normalizers")
        steps = (rules["pre_tokenizer"] or {}).get("pretokenizers") or []
        if normalizers != USUAL_NORMALIZERS or [s["type"] for s in steps] != ["Split", "ByteLevel"]:
            return None
        split, level = steps
        if USUAL_SPLIT.items() <= split.items() and not level["add_prefix_space"] and not level["use_regex"]:
            return regex.compile(split["pattern"]["Regex"])
        return None

    def merge(self, symbols: list[int]) -> int:
        """Symbols that are left when no adjacent pair has a rank."""
        n, ranks, merged = len(symbols), self.ranks, self.merged
        heap = [
            ranks[pair] << PLACE | i
            for i, pair in enumerate(a << SHIFT | b for a, b in zip(symbols, symbols[1:], strict=False))
            if pair in ranks
        ]
        if not heap:
            return n
        heapify(heap)
        after, before, left, mask = array("l", range(1, n + 1)), array("l", range(-1, n)), n, (1 << PLACE) - 1
        while heap:
            entry = heappop(heap)
            rank, i = entry >> PLACE, entry & mask
            j = after[i]
            # An entry is stale if one of its symbols has been merged since.
            if symbols[i] < 0 or j >= n or ranks.get(symbols[i] << SHIFT | symbols[j]) != rank:
                continue
            symbols[i], symbols[j] = merged[rank], -1
            k, h = after[j], before[i]
            after[i], before[k] = k, i
            left -= 1
            if k < n and (r := ranks.get(symbols[i] << SHIFT | symbols[k])) is not None:
                heappush(heap, r << PLACE | i)
            if h >= 0 and (r := ranks.get(symbols[h] << SHIFT | symbols[i])) is not None:
                heappush(heap, r << PLACE | h)
        return left

    def __missing__(self, word: str) -> int:
        data = word.encode()
        symbols = [self.inside_bytes[b] for b in data]
        symbols[-1] = self.last_bytes[data[-1]]
        n = self.merge(symbols)
        if len(word) <= KEPT_LENGTH:
            self[word] = n
        return n

    def _by_library(self, text: str) -> int:
        count = 0
        splitter, normalizer = self.tokenizer.pre_tokenizer, self.tokenizer.normalizer
        for word, _ in splitter.pre_tokenize_str(normalizer.normalize_str(text) if normalizer else text):
            symbols = [self.inside[c] for c in word]
            symbols[-1] = self.last[word[-1]]
            count += self.merge(symbols)
        return count

    def _part(self, text: str) -> int:
        if self.pattern is None or not (text.isascii() or SETTLED.fullmatch(text)):
            return self._by_library(text)
        # The library lowers each character by itself, so a sigma never takes its final form.
        lowered = unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3").lower()
        return sum(map(self.__getitem__, self.pattern.findall(lowered)))

    def count(self, text: str) -> int:
        """Tokens of ``text``; strings of special tokens in it count as one token each."""
        if self.special is None or not self.special.search(text):
            return self._part(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(self._part(p) for p in parts if p)


def counter(path: str) -> TokenCounter:
    """The counter of a vocabulary file, built once in a Python worker."""
    known = kept(f"token counts {path}", lambda: TokenCounter(path))
    if len(known) > KEPT_WORDS:
        known.clear()
    return known


def count(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit): one row for each row of ``docs``, whole texts.

    A null text counts as empty: no bytes, no tokens. Repeated rows and null ids give a row each;
    an empty table gives none. Other columns of ``docs`` are not read, so their names do not matter.
    A word without any white space is merged as a whole, in memory that grows with its length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches):
            known = counter(path)
            tokens = pa.array([known.count(t) for t in texts.to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pc.binary_length(texts).cast(pa.int64()), tokens, pc.greater(tokens, limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
