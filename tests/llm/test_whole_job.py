"""Results that must be whole: no link, key, language or part of a text is left out."""

import random

import numpy as np
import pytest

from folioscope.llm import embedding_dedup, jaccard_join, language, secret_scan, spotsigs


def vector_rows(x, first=0):
    return [(first + i, [float(c) for c in v]) for i, v in enumerate(x)]


def test_vectors_link_across_cells_and_by_length(spark):
    rng = np.random.default_rng(3)
    a = rng.standard_normal((1500, 8))
    b = rng.standard_normal((1500, 8))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    x = np.concatenate([a, 0.901 * a + np.sqrt(1 - 0.901**2) * b])
    other = np.concatenate([a[:40, :5], a[:40, :5] + 0.01])
    rows = vector_rows(x) + vector_rows(other, 10_000)
    out = {
        r["vec_id"]: r
        for r in embedding_dedup.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), cell_rows=40).collect()
    }
    for first, y in ((0, x), (10_000, other)):
        u = y / np.linalg.norm(y, axis=1, keepdims=True)
        linked = u @ u.T >= 0.9
        label = embedding_dedup.forest(len(y), *np.nonzero(linked))
        assert [out[first + i]["n_links"] for i in range(len(y))] == (linked.sum(axis=1) - 1).tolist()
        assert [out[first + i]["component_id"] for i in range(len(y))] == (first + label).tolist()


@pytest.mark.parametrize("block_sets", [1024, 16])
def test_links_inside_components_are_counted(spark, monkeypatch, block_sets):
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", block_sets)
    rnd = random.Random(7)
    texts = {}
    for group in range(4):
        base = [f"g{group}w{i}" for i in range(90)]
        for _ in range(30):
            words = list(base)
            for k in rnd.sample(range(90), rnd.randint(0, 3)):
                words[k] = f"own{rnd.randint(0, 5)}"
            texts[len(texts)] = " ".join(words)
    texts |= {200: texts[0], 201: texts[0], 300: "a text of its own without any copy"}
    rows = [*texts.items(), (None, texts[0])]
    out = jaccard_join.link(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()
    sets = {i: {tuple(w[k : k + 4]) for k in range(len(w) - 3)} for i, t in texts.items() for w in [t.split()]}
    want = {
        a: sum(a != b and 100 * len(x & y) >= 85 * len(x | y) for b, y in sets.items()) for a, x in sets.items()
    }
    assert {r["doc_id"]: r["n_links"] for r in out} == want | {None: 0} and max(want.values()) > 8


def test_texts_without_common_words_are_covered_to_their_end(spark):
    words = [f"zq{i}" for i in range(12)]
    rows = [(k, " ".join([*words[:k], "other", *words[k + 1 :]])) for k in range(2, 12)] + [(20, " ".join(words))]
    found = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", spotsigs.signatures("text").alias("s"))
    sets = {r["doc_id"]: set(r["s"]) for r in found.collect()}
    assert all(sets[k] != sets[20] and sets[k] & sets[20] for k in range(2, 12))


def test_short_random_keys_are_found(spark):
    rnd = random.Random(8)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    rows = [(i, "see " + "".join(rnd.choice(alphabet) for _ in range(16 + i % 8))) for i in range(80)]
    rows += [(100 + i, "thereatthereatthere in state-of-the-art-state Ohohohohohohohohoh") for i in range(20)]
    out = secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = {r["doc_id"]: r["found"] for r in out}
    assert sum(bool(found[i]) for i in range(80)) >= 72 and not any(found[i] for i in found if i >= 100)


def test_every_language_has_a_dictionary(spark):
    rows = [(100 * k + i, f"l{k}", " ".join(f"q{k}x{(i + j) % 9}{chr(97 + k % 26) * 5}" for j in range(12))) for k in range(70) for i in range(1 + (k < 64))]
    learned = language.fit(spark.createDataFrame(rows, "doc_id long, lang string, text string"))
    assert set(learned.names) == {f"l{k}" for k in range(70)} and all(learned.contents.values())


def kept_by_brute_force(rows, words=5, percent=80):
    """(doc_id, text) of the least row of each component of rows; rows with a null id, or without words, all."""

    def shingles(text):
        w = (text or "").lower().split()
        return {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()

    keyed = [(i, t) for i, t in rows if i is not None]
    sets = [shingles(t) for _, t in keyed]
    label = list(range(len(keyed)))
    for a in range(len(keyed)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                old, new = label[a], label[b]
                label = [new if x == old else x for x in label]
    best = {}
    for row, c in zip(keyed, label, strict=True):
        best[c] = min(best.get(c, row), row)
    return sorted([*best.values(), *(r for r in rows if r[0] is None)], key=str)


@pytest.mark.parametrize("repeat", [False, True])
def test_one_row_of_each_component_stays(spark, repeat):
    rnd = random.Random(3)
    rows = []
    for group in range(5):
        base = [f"g{group}w{i}" for i in range(80)]
        for _ in range(6):
            words = list(base)
            for k in rnd.sample(range(80), rnd.randint(0, 3)):
                words[k] = f"own{rnd.randint(0, 5)}"
            rows.append((len(rows) + 1, " ".join(words)))
    rows += [(60, "a text like no other in this table"), (61, "short"), (62, "short"), (63, ""), (None, rows[0][1]), (None, "")]
    if repeat:
        # One id holds a copy, texts that are like nothing else, and an equal row.
        rows += [(3, "first of two texts that share an id"), (3, "second of two texts with one id"), (3, rows[10][1]), (62, "short")]
    schema = "doc_id long, text string, _none string, _n int, row string"
    table = spark.createDataFrame([(*r, "clash", 1, "clash") for r in rows], schema)
    out = jaccard_join.keep_one(table)
    assert out.columns == table.columns
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == kept_by_brute_force(rows)
    assert jaccard_join.keep_one(table.limit(0)).count() == 0


def test_workers_keep_one_thing_at_a_time():
    from folioscope.llm import common

    assert common.kept("a", lambda: [1]) is common.kept("a", lambda: [2])
    assert common.kept("b", lambda: [3]) == [3] and list(common._kept) == ["b"]
    assert common.kept(None) is None and not common._kept


def test_presence_tables(spark):
    from folioscope.llm import common

    rows = spark.range(5000).repartition(7)

    def hashed(batches):
        for batch in batches:
            yield common.mixed(batch.column(0).to_numpy().view(np.uint64))

    table = common.presence_table(rows, hashed, 16)
    own = common.mixed(np.arange(200_000, dtype=np.uint64))
    marked = np.zeros(1 << 16, bool)
    marked[(own[:5000] >> np.uint64(48)).astype(np.int64)] = True
    assert common.present(table, own, 16).tolist() == marked[(own >> np.uint64(48)).astype(np.int64)].tolist()
