"""What the secret scan reports: base spans against plain patterns, random runs against names and keys."""

import random
import re

from pyspark.sql import functions as F

from folioscope.llm import secret_scan
from folioscope.llm.common import documents

BASE = (
    ("assign", re.compile(r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), 6),
    ("access", re.compile("AKIA[A-Z0-9]+"), 20),
    ("hex", re.compile("[0-9a-f]+"), 24),
)
SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def names(rnd):
    words = (
        "service count reduce factory config bean index stream handler abstract manager query parser buffer "
        "socket thread cache lookup table sorted user account payment invoice request donau dampf schiff "
        "gesellschaft versicherung usr local lib python share home project src main test resources build output"
    ).split()
    some = rnd.sample(words, rnd.randint(4, 6))
    return rnd.choice([
        "".join(map(str.capitalize, some)), some[0] + "".join(map(str.capitalize, some[1:])), "_".join(some),
        "_".join(some).upper(), "/" + "/".join(some), "https://example.com/" + "/".join(some) + str(rnd.randint(1, 999)),
        "".join(some), "".join(map(str.capitalize, some)) + str(rnd.randint(1, 99)),
        f"{rnd.getrandbits(32):08x}-{rnd.getrandbits(16):04x}-4{rnd.getrandbits(12):03x}-8{rnd.getrandbits(12):03x}-{rnd.getrandbits(48):012x}",
    ])


def test_names_are_no_keys_and_keys_are_found(spark, small):
    rnd = random.Random(4)
    corpus = documents(spark, small).select("doc_id", "text")
    rows = [(10**9 + k, f"see {names(rnd)} there") for k in range(1000)]
    for k in range(300):
        symbols = SYMBOLS if k % 2 else SYMBOLS[26:]
        rows.append((2 * 10**9 + k, "see " + "".join(rnd.choice(symbols) for _ in range(20)) + " there"))
    found = secret_scan.scan(corpus.unionByName(spark.createDataFrame(rows, "doc_id long, text string")))
    random_runs = F.filter("found", lambda s: s["kind"] == "random")
    hit = {r["doc_id"] for r in found.where(F.size(random_runs) > 0).select("doc_id").collect()}
    assert sum(10**9 <= k < 2 * 10**9 for k in hit) <= 50
    assert sum(k >= 2 * 10**9 for k in hit) >= 270


def test_base_spans_equal_plain_patterns(spark):
    rnd = random.Random(9)
    parts = [
        "Token", "api_key", "APIKEY", "passwd", "secret", ":", "=", " ", "  ", "'", '"', "abc", "x.y-z=", "AKIA", "AKIAAKIA",
        "Z9" * 9, "0f" * 6, "deadbeef", "ü", "😀", "\n", "\t", "password", "F0" * 13,
    ]
    rows = [(k, "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 60)))) for k in range(1500)]
    out = secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"))
    texts = dict(rows)
    for row in out.select("doc_id", secret_scan.joined("base").alias("base")).collect():
        spans = [
            (m.start(), rank, f"{kind}:{m.start()}:{m.end()}") for rank, (kind, pattern, least) in enumerate(BASE)
            for m in pattern.finditer(texts[row["doc_id"]]) if len(m[1] if kind == "assign" else m[0]) >= least
        ]
        assert row["base"] == ",".join(s for _, _, s in sorted(spans))


def test_orders_of_their_own_are_no_keys(spark, small):
    rows = [(-1, "abcdefghijklmnopqrstuvwxyz"), (-2, "A1" * 20), (-3, "2024-01-15-10-20-30"), (-4, "-" * 400), (-5, None)]
    corpus = documents(spark, small).select("doc_id", "text")
    found = secret_scan.scan(corpus.unionByName(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {r["doc_id"]: len(r["found"]) for r in found.where("doc_id < 0").collect()} == dict.fromkeys(range(-5, 0), 0)
