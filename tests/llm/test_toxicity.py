"""The transducers: readings of sentences, and the composition against all paths through the machines."""

import random

import pytest

from folioscope.llm import toxicity
from folioscope.llm.toxicity import FACTORS

GRAMMAR = toxicity.Grammar({"moron": 1.0, "idio*": 1.0})


def clause(text):
    return GRAMMAR.clause(text.split())


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("you moron", FACTORS["@"]),
        ("moron", 1.0),
        ("idiots", 1.0),
        ("you are a moron and an idiot", FACTORS["@"] + 1),
        ('he said "you moron"', FACTORS["@"] * FACTORS['"']),
        ('"you moron" he said', FACTORS["@"] * FACTORS['"']),
        ('"you moron" and so on and on', FACTORS["@"]),
        ("he said you are a moron", FACTORS["@"] * FACTORS["'"]),
        ("you are not really such a big moron", FACTORS["~"]),
        ("moron x moron you", 2 * FACTORS["@"]),
        ("moron a b c d moron you", 1 + FACTORS["@"]),
        ("kill the lights", 0.2),
        ("i will kill you", 0.75 * FACTORS["@"]),
        ("nothing to see", 0.0),
        ("", 0.0),
    ],
)
def test_readings(text, want):
    assert clause(text) == pytest.approx(want)


def every_path(parts, symbols):
    """Weights of all paths, machine after machine over whole sequences."""
    written = [(tuple(symbols), 0.0)]
    for machine in parts:
        after = []
        for sequence, total in written:
            paths = [(machine.start, (), total)]
            for symbol in sequence:
                paths = [(n, (*out, o), w + v) for s, out, w in paths for n, o, v in machine(s, symbol)]
            after += [(out, w) for s, out, w in paths if s in machine.final]
        written = after
    return [w for _, w in written]


def test_composition_equals_all_paths():
    rnd = random.Random(6)
    parts = toxicity.machines()
    composed = toxicity.Composition(parts)
    symbols = [*toxicity.WORDS, *toxicity.QUOTES, *toxicity.MATCHES]
    for _ in range(600):
        sequence = [rnd.choice(symbols) for _ in range(rnd.randint(0, 10))]
        paths = every_path(parts, sequence)
        assert len(paths) == 1  # one reading for each clause
        assert composed.best(sequence) == pytest.approx(max(paths))


def test_near_copies_count_once():
    rnd = random.Random(2)
    words = [f"q{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(200)]
    clean = [(" ".join(rnd.choices(words[:150], k=30)), 0) for _ in range(200)]
    copied = " ".join([*words[150:], *words[:20]])
    toxic = [(copied, 1)] * 40 + [(" ".join([*rnd.choices(words[:150], k=30), "dolt"]), 1) for _ in range(40)]
    learned = toxicity.learn_patterns(clean + toxic)
    assert "dolt" in learned and not set(learned) & set(words[150:])
