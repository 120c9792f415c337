"""SpotSigs against a plain version of the same definition, and what its anchors are."""

import random
import re

from pyspark.sql import functions as F

from folioscope.llm import spotsigs
from folioscope.llm.common import documents


def plain_signatures(text, common):
    words = re.sub(r"[\W_]+", " ", text.lower()).split()
    marked = ["^", *words, *["$"] * spotsigs.CHAIN]

    def chain(k):
        at, kept = k + 1, [marked[k]]
        for _ in range(spotsigs.CHAIN):
            passed = 0
            while passed < spotsigs.SKIP and at < len(marked) and marked[at] in common:
                at, passed = at + 1, passed + 1
            if at >= len(marked):
                return None
            kept += [marked[at]] if marked[at] not in common else []
            at += 1
        return " ".join(kept)

    def content(k):
        return marked[k] not in common and marked[k] not in ("^", "$")

    if not words:
        words = [""]
    own = [chain(k) for k, w in enumerate(marked) if w == "^" or w in common]
    own = [s for s in own if s]
    if len(own) < len(words) / spotsigs.SPARSE:
        own += [s for k in range(len(marked) - 2) if content(k) and content(k + 1) and content(k + 2) and (s := chain(k + 2))]
    return set(own)


def test_sets_and_likeness_equal_a_plain_version(spark):
    rnd = random.Random(3)
    common, rare = ["the", "of", "und", "la"], [f"w{k}" for k in range(40)]
    texts = []
    for k in range(300):
        share = rnd.choice((0, 0.05, 0.4, 0.8))
        words = [rnd.choice(common if rnd.random() < share else rare) for _ in range(rnd.randint(1, 60))]
        texts.append(rnd.choice((" ", ", ", "\n")).join(words))
        if k % 3 == 0:
            texts.append(texts[-1].replace("w1", "w2", 1) + " the end")
    rows = list(zip(range(len(texts)), texts, texts[1:] + texts[:1], strict=True))
    found = spark.createDataFrame(rows, "doc_id long, text string, other string").select(
        "doc_id", spotsigs.signatures("text", common).alias("a"), spotsigs.signatures("other", common).alias("b")
    ).select("doc_id", F.size("a").alias("n"), spotsigs.likeness("a", "b").alias("near"), spotsigs.length_class("a").alias("class_a"),
             spotsigs.length_class("b").alias("class_b"))
    for row in found.collect():
        _, text, other = rows[row["doc_id"]]
        a, b = plain_signatures(text, common), plain_signatures(other, common)
        assert row["n"] == len(a), text
        want = len(a & b) / len(a | b) if abs(row["class_a"] - row["class_b"]) <= 1 else 0.0
        assert abs(row["near"] - want) < 1e-9


def test_anchors_are_the_words_that_most_documents_hold(spark, small):
    docs = documents(spark, small)
    anchors = spotsigs.common_words(docs, 60)
    held = {}
    for row in docs.select("text").collect():
        for word in set(re.sub(r"[\W_]+", " ", (row["text"] or "").lower()).split()):
            held[word] = held.get(word, 0) + 1
    assert anchors == sorted(held, key=lambda w: (-held[w], w))[:60]
    assert spotsigs.common_words(docs.limit(0)) == list(spotsigs.ANCHORS)


def test_few_signatures_are_stretches(spark, small, monkeypatch):
    docs = documents(spark, small)
    anchors = spotsigs.common_words(docs)

    def total():
        return docs.agg(F.sum(F.size(spotsigs.signatures("text", anchors)))).first()[0]

    every = total()
    monkeypatch.setattr(spotsigs, "SPARSE", 1e12)
    assert total() > 0.9 * every
