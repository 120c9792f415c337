"""Lexical search, hard negatives and token counts next to brute force, the library, and odd tables."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from folioscope.llm import hard_negatives, lexical_search, token_counts
from folioscope.llm.common import documents
from folioscope.llm.queries import QUERIES, tokenizer

WORDS = "the of a to and naïve straße 漢字 x1 rare odd Café été alpha beta gamma delta omega".split()
DOC_SCHEMA = "doc_id long, text string, rank int, score string, term long, item_id string"


def brute_search(docs, items, k):
    def terms(text):
        lowered = "".join(c.lower() if c.isascii() else c for c in text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)

    counted = [(d, Counter(terms(t))) for d, t in docs]
    counted = [(d, c) for d, c in counted if c]
    n, total = len(counted), sum(sum(c.values()) for _, c in counted)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, own in asked.items():
        rows = []
        for doc, c in counted:
            m, score = 50 + 50 * sum(c.values()) * n // total, 0
            for t in own & c.keys():
                w = math.floor(1000 * math.log((2 * n + 2) / (2 * sum(t in x for _, x in counted) + 1)))
                score += w * (10**9 * c[t] // (1000 * c[t] + 20 * m))
            if score > 0:
                rows.append((-score, doc is None, doc or 0, doc))
        out += [(item, r, doc, -s) for r, (s, _, _, doc) in enumerate(sorted(rows)[:k], 1)]
    return Counter(out)


@pytest.mark.parametrize("block_docs, tile_terms", [(16_384, 200_000), (7, 40)])
def test_search_equals_brute_force(spark, monkeypatch, block_docs, tile_terms):
    monkeypatch.setattr(lexical_search, "SEED_EVERY", 2)
    monkeypatch.setattr(lexical_search.postings, "__defaults__", (block_docs,))
    rnd = random.Random(4)
    docs = [(i, rnd.choice([" ", "-", "\n"]).join(rnd.choices(WORDS, k=rnd.randint(1, 25)))) for i in range(300)]
    docs += [(500, None), (501, ""), (502, " .,\n"), (503, "x" * 50_000), (504, "the " * 30_000), (None, "rare odd"), (7, docs[7][1])]
    docs += [(600 + i, "rare Alpha") for i in range(40)]  # ties
    items = [(i, " ".join(rnd.sample(WORDS, rnd.randint(1, 9)))) for i in range(12)]
    items += [(20, None), (21, "--"), (22, "nowhere"), (23, "rare alpha alpha"), (23, "odd"), (None, "naïve"), (24, " ".join(WORDS) + " y" * 90)]
    items.append((25, " ".join(f"q{i}" for i in range(80)) + " rare omega"))
    table = spark.createDataFrame([(d, t, 1, "clash", 2, "clash") for d, t in docs], DOC_SCHEMA).repartition(5)
    asked = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, rank int")
    found = lexical_search.search(table, asked, 10, tile_terms)
    assert Counter(map(tuple, found.select("item_id", "rank", "doc_id", "score").collect())) == brute_search(docs, items, 10)
    assert lexical_search.search(table.limit(0), asked, 10).count() == 0
    assert lexical_search.search(table, asked.limit(0), 10).count() == 0


def test_masks_are_left_out_only_below_the_best(spark):
    rng = np.random.default_rng(2)
    held = rng.random((900, 30)) < np.linspace(0.02, 0.9, 30)
    rows, terms = np.nonzero(held)
    block = lexical_search.Block(
        np.arange(900), np.zeros(900, np.uint8), rng.integers(5, 400, 900), np.cumsum(held.sum(axis=1)), terms, rng.integers(1, 5, len(terms))
    )
    weights = np.linspace(7000, 100, 30).astype(np.int64)
    made = lexical_search.Postings(block, weights, 900, 90_000)
    whole = {r: s for r, s in zip(*made.search(np.arange(30), 900, 0), strict=True)}
    best = sorted(whole.values(), reverse=True)
    for floor in (0, best[20], best[9] + 1):
        some = dict(zip(*made.search(np.arange(30), 10, floor), strict=True))
        least = max(floor, best[9])
        assert some.items() <= whole.items() and {r for r, s in whole.items() if s >= least} <= some.keys()
    assert len(made.search(np.arange(30), 10, 0)[0]) < len(whole)


def brute_negatives(rows, every=100, low=30, high=90):
    good = sorted((i, y, np.floor(256 * np.array(v, np.float64)).astype(np.int64)) for i, y, v in rows)
    out = set()
    for a, label, q in (r for r in good if r[0] % every == 0):
        scored = sorted((-int(q @ x), i, y) for i, y, x in good if i != a and len(x) == len(q))
        for ps, positive in [(-s, i) for s, i, y in scored if y == label][:5]:
            fit = [(-s, i) for s, i, y in scored if y != label and low * ps <= -100 * s <= high * ps][:10]
            out |= {(a, positive, r, n, ps, s) for r, (s, n) in enumerate(fit, 1)}
    return out


@pytest.mark.parametrize("dim, block_rows, tile_anchors", [(16, 32_768, 4096), (3, 40, 4), (16, 100, 7)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, dim, block_rows, tile_anchors):
    monkeypatch.setattr(hard_negatives, "BUCKET_ROWS", 16)
    rng = np.random.default_rng(dim)
    centre = rng.standard_normal((4, dim))
    labels = rng.choice(4, 600, p=[0.7, 0.1, 0.1, 0.1])
    x = np.round(centre[labels] + rng.standard_normal((600, dim)), 2) * rng.choice([0.2, 1.0, 3.0], (600, 1))
    x[50:80] = x[50]
    rows = [(i * 10, int(y if i % 7 else (y + 1) % 4), v.tolist()) for i, (y, v) in enumerate(zip(labels, x, strict=True))]
    rows += [(9000, 1, [0.0] * dim), (9001, 1, [1.0] * (dim + 1)), (9100, 1, [1.0] * (dim + 1)), (9102, 2, [0.8] * (dim + 1)), (9103, 1, [])]
    odd = [(9200, None, [1.0] * dim), (9300, 1, None), (9400, 1, [float("nan")] * dim), (9500, 1, [float("inf")] * dim),
           (9600, 1, [None] * dim), (None, 1, [1.0] * dim), rows[3], rows[3]]
    schema = "vec_id long, label int, embedding array<double>, rank string, block string"
    table = spark.createDataFrame([(*r, "clash", "clash") for r in rows + odd], schema)
    found = hard_negatives.mine(table, block_rows=block_rows, tile_anchors=tile_anchors)
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert {tuple(r[c] for c in names) for r in found.collect()} == brute_negatives(rows)
    assert found.count() == len(brute_negatives(rows)) > 100
    assert hard_negatives.mine(table.limit(0)).count() == 0


def test_coordinate_ranges_leave_out_rows_but_no_result():
    rng = np.random.default_rng(1)
    x = np.floor(2560 * rng.standard_normal((2000, 24)) * 0.6 ** np.arange(24)).astype(np.int32)
    length = np.sqrt((x.astype(float) ** 2).sum(axis=1))
    seen = []
    for share in (-0.2, 0.2, 0.5, 0.8, 0.95):
        seen.append(0)
        for q, q_length in zip(x[:20], length[:20], strict=True):
            least = int(share * (q.astype(np.int64) @ q))
            for bucket in hard_negatives.buckets(np.arange(2000), x, length, 256):
                may = bucket.candidates(q, q_length, np.argsort(-np.abs(q))[:4], least)
                ids, score = bucket.scores(q, q_length, may)
                seen[-1] += len(ids)
                exact = bucket.x.astype(np.int64) @ q
                assert set(bucket.ids[exact >= least]) <= set(ids) and set(score) <= set(exact.tolist())
    assert seen[0] == 40_000 and seen == sorted(seen, reverse=True) and seen[3] < 20_000


def test_large_components_stay_exact():
    x = np.tile(np.array([[2**20, 3], [-(2**20), 1]], np.int32), (1, 2**13))
    length = np.sqrt((x.astype(float) ** 2).sum(axis=1))
    bucket = hard_negatives.Bucket(np.arange(2), x, length)
    for q in x:
        want = [sum(a * b for a, b in zip(row.tolist(), q.tolist(), strict=True)) for row in x]
        assert bucket.scores(q, length[0], None)[1].tolist() == want


def odd_texts():
    rnd = random.Random(6)
    letters = [chr(c) for c in range(0x558)] + list("ÀéΣσςİıǅ‍ 　漢字가😀🏽'") * 20 + ["<|endoftext|>", "<|startoftext|>", "'s", "'LL", " ", "the"] * 30
    texts = ["".join(rnd.choices(letters, k=rnd.randint(0, 40))) for _ in range(2000)]
    ranges = [(0, 0x2FFF), (0, 0xD7FF), (0xE000, 0x10FFFF)]
    texts += ["".join(chr(rnd.randint(*rnd.choice(ranges))) for _ in range(20)) for _ in range(2000)]
    return texts + ["", "   ", "a" * 100_000, "<|endoftext|>" * 9, "a<|endoftext|", "<|ENDOFTEXT|>", "é" * 20]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_token_counts_equal_the_library(name, spark, small):
    from tokenizers import Tokenizer

    texts = odd_texts() + [r["text"] or "" for r in documents(spark, small).select("text").collect()]
    counter = token_counts.TokenCounter(tokenizer(name))
    library = Tokenizer.from_file(tokenizer(name)).encode_batch(texts, add_special_tokens=False)
    assert [counter.count(t) for t in texts] == [len(e.ids) for e in library]


def test_settled_characters_are_split_as_by_the_library():
    from tokenizers import Tokenizer

    counter = token_counts.TokenCounter(tokenizer("word_bpe_49k.json"))
    texts = [f"a{c}1{c}{c}-{c}" for c in map(chr, [*range(0xD800), *range(0xE000, 0x20000)]) if token_counts.SETTLED.fullmatch(c)]
    library = Tokenizer.from_file(tokenizer("word_bpe_49k.json")).encode_batch_fast(texts, add_special_tokens=False)
    assert [counter.count(t) for t in texts] == [len(e.ids) for e in library]


def test_token_count_rows(spark, small):
    rows = [(1, None, "c"), (1, "", "c"), (2, "the end", "c"), (2, "the end", "c"), (None, "é " * 3000, "c")]
    table = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    found = token_counts.count(table, tokenizer("word_bpe_49k.json"))
    assert sorted(map(tuple, found.collect()), key=str) == sorted(
        [(1, 0, 0, False), (1, 0, 0, False), (2, 7, 2, False), (2, 7, 2, False), (None, 9000, 3000, True)], key=str
    )
    assert token_counts.count(table.limit(0), tokenizer("word_bpe_49k.json")).count() == 0
    whole = QUERIES["op13_token_counts"](spark, small)
    assert whole.count() == documents(spark, small).count()
