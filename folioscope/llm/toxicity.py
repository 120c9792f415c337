"""Toxicity by a grammar of weighted finite-state transducers.

A clause is read as symbols: insult (in three strengths), threat, target, negation, reporting verb,
intent, opening and closing quote mark, other. Which words insult is learned from labelled rows, as
whole words and as word beginnings, beside short fixed lists for the other symbols. Five transducers
(``machines``) stand as data, states and arcs with input, output and weight: the threat machine marks
threats that follow an intent, the negation machine marks matches that a negation governs, the target
machine marks matches with a target before or behind them within the same quotation, the reporting
machine marks matches in attributed quotes, before or after the attribution, and in indirect speech;
the insult machine gives every marked match its weight. They are composed, each reading what the one
before it writes; arcs of the composition are made when first needed and kept. What is decided by
words further on is guessed, and wrong guesses end nowhere; the best path that ends gives a clause's
score. A text's score is a logistic function of its clause scores, fitted on the same labelled rows.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import kept, labelled_sample, text_slices, words_of

SAMPLE_ROWS = 5000  # labelled rows that training sees at most
SAMPLE_CHARS = 9000  # characters of each that training reads at most; scoring reads all
STEMS = (4, 5, 6, 7, 8)  # lengths of word beginnings
LEAST_TEXTS = 5  # toxic texts that a learned pattern occurs in at least
PURE = 0.85  # least share of toxic texts among those with a learned pattern
CHANCE = 1e-3  # expected number of patterns that pass by chance

# Fixed symbols of the grammar.
THREATS = frozenset("kill murder hurt shoot stab beat destroy töten umbringen tuer frapper matar golpear".split())
TARGETS = frozenset(
    "you your youre yourself u he she they him them his her their these those everyone "
    "du dich dir ihr euch sie er tu toi te vous il elle ils tú te usted ellos ella él".split()
)
NEGATIONS = frozenset("not no never isnt arent wasnt dont nicht kein keine nie pas jamais aucun nunca ningún".split())
REPORTS = frozenset(
    "said says say wrote writes called calls claimed quoted reported told sagte schrieb nannte dit écrit dijo llamó".split()
)
INTENT = frozenset("will gonna shall should must going werde werden vais va voy".split())
REACH = 5  # words that a negation governs
NEAR = 3  # words within which a target or an intent strengthens
SPEECH = 8  # words of indirect speech after a reporting verb
AFTER = 3  # words within which an attribution follows a quote
STRENGTHS = (1.0, 0.7, 0.4)  # of insults, by purity of their pattern
FACTORS = {"~": 0.35, '"': 0.4, "'": 0.7, "@": 1.25}  # negated, in a quote, in indirect speech, with a target
MATCHES = {"i0": STRENGTHS[0], "i1": STRENGTHS[1], "i2": STRENGTHS[2], "k": 0.2, "K": 0.75}
WORDS = ("o", "t", "n", "r", "w")  # other, target, negation, reporting verb, intent
QUOTES = ("q", "Q")

_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_OPEN, _CLOSE = tuple('"“«„'), tuple('"”»“')
_STOP = (".", "!", "?", ";", "\n")


def plain(word: str) -> str:
    """Lower-case letters of a word, without apostrophes and signs around it."""
    found = _WORD.search(word)
    return found[0].lower().replace("'", "").replace("’", "") if found else ""


Arc = tuple[object, str, float]  # next state, output symbol, weight


@dataclass
class Machine:
    """A transducer: arcs by state and input symbol, where it starts, and which states may end."""

    start: object
    final: frozenset
    arcs: dict[tuple[object, str], list[Arc]]

    def __call__(self, state: object, symbol: str) -> list[Arc]:
        return self.arcs.get((state, symbol), [])


def _machine(start: object, ends: Callable[[object], bool], symbols: Sequence[str], step: Callable[[object, str], list[Arc]]) -> Machine:
    """Tabulate ``step`` for all states that can be reached."""
    arcs, open_, seen = {}, [start], {start}
    while open_:
        state = open_.pop()
        for symbol in symbols:
            arcs[state, symbol] = step(state, symbol)
            new = {a[0] for a in arcs[state, symbol]} - seen
            seen |= new
            open_ += sorted(new, key=repr)
    return Machine(start, frozenset(s for s in seen if ends(s)), arcs)


def _threat(left: int, symbol: str) -> list[Arc]:
    """``left``: words for which an intent still counts."""
    if symbol in QUOTES:
        return [(left, symbol, 0.0)]
    if symbol == "w":
        return [(NEAR + 1, symbol, 0.0)]
    return [(max(0, left - 1), "K" if symbol == "k" and left else symbol, 0.0)]


def _negation(left: int, symbol: str) -> list[Arc]:
    """``left``: words that the last negation still governs."""
    if symbol in QUOTES:
        return [(left, symbol, 0.0)]
    if symbol == "n":
        return [(REACH, symbol, 0.0)]
    return [(max(0, left - 1), symbol + "~" * (left > 0 and symbol in MATCHES), 0.0)]


def _target(state: tuple[int, int, int], symbol: str) -> list[Arc]:
    """State: words for which a target counts, within which one must come, and within which none may."""
    since, must, none = state
    if symbol in QUOTES:
        return [] if must else [((0, 0, 0), symbol, 0.0)]
    if symbol == "t":
        return [] if none else [((NEAR, 0, 0), symbol, 0.0)]
    if must == 1:
        return []
    left = (max(0, since - 1), max(0, must - 1), max(0, none - 1))
    if symbol[0] not in "ikK":
        return [(left, symbol, 0.0)]
    if since:
        return [(left, symbol + "@", 0.0)]
    out = [((0, left[1] or NEAR, left[2]), symbol + "@", 0.0)]
    return out if left[1] else [*out, ((0, 0, NEAR), symbol, 0.0)]


def _report(state: tuple[str, int], symbol: str) -> list[Arc]:
    """State: where the reading is, and the words that are left of it."""
    place, left = state
    match = symbol[0] in "ikK"
    if place == "outside":
        if symbol == "q":
            return [(("said", 0), symbol, 0.0)] if left else [(("owed", 0), symbol, 0.0), (("own", 0), symbol, 0.0)]
        if symbol == "Q":
            return [(state, symbol, 0.0)]
        return [((place, SPEECH if symbol == "r" else max(0, left - 1)), symbol + "'" * (match and left > 0), 0.0)]
    if place in ("said", "owed", "own"):
        if symbol == "Q":
            return [({"said": ("outside", 0), "owed": ("due", AFTER), "own": ("free", AFTER)}[place], symbol, 0.0)]
        return [(state, symbol + '"' * (match and place != "own"), 0.0)]
    # Behind a quote: its attribution is due, or must not come.
    if symbol == "r":
        return [(("outside", 0), symbol, 0.0)] if place == "due" else []
    if symbol in QUOTES or left == 1:
        if place == "due":
            return []
        return _report(("outside", 0), symbol)
    return [((place, left - 1), symbol, 0.0)]


def machines() -> list[Machine]:
    """Threat, negation, target, reporting and insult machine, in the order in which they are composed."""
    words, matches = [*WORDS, *QUOTES], list(MATCHES)
    negated = matches + [m + "~" for m in matches]
    aimed = negated + [m + "@" for m in negated]
    told = aimed + [m + mark for m in aimed for mark in "\"'"]

    def weight(symbol: str) -> float:
        kind = symbol.rstrip("~@\"'")
        return MATCHES[kind] * math.prod(FACTORS[mark] for mark in symbol[len(kind):]) if kind in MATCHES else 0.0

    return [
        _machine(0, lambda s: True, words + matches, _threat),
        _machine(0, lambda s: True, words + matches, _negation),
        _machine((0, 0, 0), lambda s: not s[1], words + negated, _target),
        _machine(("outside", 0), lambda s: s[0] not in ("owed", "due"), words + aimed, _report),
        _machine(0, lambda s: True, words + told, lambda s, symbol: [(s, symbol, weight(symbol))]),
    ]


class Composition:
    """Machines in a row as one; an arc is made when first asked for and kept."""

    def __init__(self, parts: Sequence[Machine]) -> None:
        self.parts = list(parts)
        self.start = tuple(m.start for m in parts)
        self.arcs: dict[tuple[tuple, str], list[tuple[tuple, float]]] = {}

    def __call__(self, state: tuple, symbol: str) -> list[tuple[tuple, float]]:
        if (state, symbol) not in self.arcs:
            paths: list[tuple[tuple, str, float]] = [((), symbol, 0.0)]
            for machine, own in zip(self.parts, state, strict=True):
                paths = [((*s, n), out, w + v) for s, read, w in paths for n, out, v in machine(own, read)]
            self.arcs[state, symbol] = [(s, w) for s, _, w in paths]
        return self.arcs[state, symbol]

    def ends(self, state: tuple) -> bool:
        return all(s in m.final for s, m in zip(state, self.parts, strict=True))

    def best(self, symbols: Sequence[str]) -> float:
        """Weight of the best path that reads the symbols and ends; 0 if none does."""
        reached = {self.start: 0.0}
        for symbol in symbols:
            after: dict[tuple, float] = {}
            for state, total in reached.items():
                for new, weight in self(state, symbol):
                    after[new] = max(after.get(new, -math.inf), total + weight)
            reached = after
        return max((w for s, w in reached.items() if self.ends(s)), default=0.0)


@dataclass
class Grammar:
    insults: dict[str, float] = field(default_factory=dict)  # patterns; a beginning ends in "*"
    weights: tuple[float, ...] = (-2.0, 0.0, 0.0, 0.0)

    def __post_init__(self) -> None:
        self.memo: dict[str, str] = {}
        self.composed = Composition(machines())

    def symbol(self, word: str) -> str:
        """Symbol of a word as it stands in the text, without its quote marks."""
        if word in self.memo:
            return self.memo[word]
        w = plain(word)
        share = max([self.insults.get(w, 0.0), *(self.insults.get(w[:k] + "*", 0.0) for k in STEMS if len(w) > k)])
        if share:
            out = "i0" if share >= 0.97 else "i1" if share >= 0.93 else "i2"
        else:
            lists = (("k", THREATS), ("t", TARGETS), ("n", NEGATIONS), ("r", REPORTS), ("w", INTENT))
            out = next((name for name, words in lists if w in words), "o")
        if len(self.memo) > 500_000:
            self.memo.clear()
        self.memo[word] = out
        return out

    def symbols(self, words: list[str]) -> list[str]:
        """Symbols of a clause with its quote marks."""
        out = []
        for word in words:
            out += ["q"] * (word[:1] in _OPEN) + [self.symbol(word)]
            out += ["Q"] * (len(word) > 1 and word.rstrip(".,!?:;")[-1:] in _CLOSE)
        return out

    def clause(self, words: list[str]) -> float:
        """Score of one clause, that of the best path through the composed transducers."""
        return self.composed.best(self.symbols(words))

    def features(self, texts: pa.Array) -> np.ndarray:
        """For each text: best clause, all clauses (dampened), the same in proportion to the text's length (dampened)."""
        offsets, codes, distinct = words_of(texts)
        out = np.zeros((len(offsets) - 1, 3))
        words = distinct.to_pylist()
        hot = np.array([self.symbol(w) in MATCHES for w in words], bool)
        at = np.flatnonzero(hot[codes]) if len(codes) else np.zeros(0, np.int64)
        if not len(at):
            return out
        stop = np.array([w.endswith(_STOP) for w in words], bool)
        docs = np.searchsorted(offsets, at, "right") - 1
        read = -1
        for k, doc in zip(at.tolist(), docs.tolist(), strict=True):
            if k < read:
                continue  # in the clause that was just read
            start, end = k, k + 1
            while start > offsets[doc] and not stop[codes[start - 1]]:
                start -= 1
            while end < offsets[doc + 1] and not stop[codes[end - 1]]:
                end += 1
            read = end
            score = self.clause([words[c] for c in codes[start:end]])
            out[doc, 0] = max(out[doc, 0], score)
            out[doc, 1] += score
        out[:, 1] = np.log1p(out[:, 1])
        out[:, 2] = out[:, 1] / np.log(10 + np.diff(offsets))
        return out

    def scores(self, texts: pa.Array) -> np.ndarray:
        z = self.features(texts) @ np.array(self.weights[1:]) + self.weights[0]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _sketch(words: list[str]) -> tuple[int, ...]:
    """The two least hashes of the three-word shingles; near copies mostly share both, others hardly ever."""
    found = {zlib.crc32(" ".join(words[k : k + 3]).encode()) for k in range(max(1, len(words) - 2))}
    return tuple(sorted(found)[:2])


def learn_patterns(rows: list[tuple[str, int]]) -> dict[str, float]:
    """Words and word beginnings that mark toxic texts, with the share of toxic ones among their texts.

    Near copies count once, as else every word of a copied toxic text would look like a mark.
    """
    seen: tuple[Counter, Counter] = (Counter(), Counter())
    texts = [0, 0]
    sketches: tuple[set, set] = (set(), set())
    for text, y in rows:
        listed = [w.lower() for w in _WORD.findall(text)]
        sketch = _sketch(text.lower().split())
        if sketch in sketches[y]:
            continue
        sketches[y].add(sketch)
        words = {w.replace("'", "").replace("’", "") for w in listed}
        found = words | {w[:k] + "*" for w in words for k in STEMS if len(w) > k}
        seen[y].update(found)
        texts[y] += 1
    if not min(texts):
        return {}
    out = {}
    for pattern, toxic in seen[1].items():
        clean = seen[0][pattern]
        n = toxic + clean
        if toxic < LEAST_TEXTS or toxic < PURE * n:
            continue
        # Bound on seeing so many toxic texts among n if the pattern said nothing.
        base, share = texts[1] / sum(texts), toxic / n
        rest = (1 - share) * math.log((1 - share) / (1 - base)) if share < 1 else 0.0
        tail = -n * (share * math.log(share / base) + rest)
        if tail < math.log(CHANCE / len(seen[1])):
            out[pattern] = min(1.0, share)
    return out


def train(rows: list[tuple[str, int]]) -> Grammar:
    """Learn the insults, then fit the score on the clause features of the same rows."""
    grammar = Grammar(learn_patterns(rows))
    y = np.array([label for _, label in rows], float)
    if len(set(y.tolist())) < 2:
        grammar.weights = (-2.0, 2.0, 1.0, 0.0)
        return grammar
    x = grammar.features(pa.array([t for t, _ in rows], pa.string()))
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    ridge = np.diag([0.0, 0.05, 0.05, 0.05]) * 2
    for _ in range(30):  # Newton's method on the penalised likelihood
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        s = np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve((x * s[:, None]).T @ x + ridge + 1e-9 * np.eye(len(w)), x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    grammar.weights = tuple(w.tolist())
    return grammar


def fit(docs: DataFrame, labels: DataFrame, fold: int = 0) -> Grammar:
    """Learn from at most SAMPLE_ROWS labelled rows outside the fold."""
    return train(labelled_sample(docs, labels, "toxic", fold, SAMPLE_ROWS, SAMPLE_CHARS))


def score(docs: DataFrame, grammar: Grammar, column: str = "score") -> DataFrame:
    """``docs`` with ``column``, how likely a text is toxic, over the whole text.

    Null and empty texts and texts without a matched clause get the score of no match. A column
    of that name is replaced; all other columns and repeated rows are kept.
    """
    insults, weights = dict(grammar.insults), tuple(grammar.weights)
    model = docs.sparkSession.sparkContext.broadcast((insults, weights))
    own: list[Grammar] = []

    @F.arrow_udf("double")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kept(None)
        if not own:
            own.append(Grammar(*model.value))
        for part in parts:
            batch = pa.RecordBatch.from_arrays([part], ["text"])
            found = [own[0].scores(texts) for _, texts in text_slices([batch])]
            yield pa.array(np.concatenate(found) if found else np.zeros(0))

    return docs.withColumn(column, run("text"))
