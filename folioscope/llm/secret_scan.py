"""Secret scans, with built-in functions only.

Patterns give the base spans. Beside them, long runs of code characters are judged by two questions.

*Is it ordinary writing?* The null hypothesis is the corpus' own writing: transitions between the
symbols of its shorter words, where a change of case, a digit after a letter and a separator end one
word and begin the next. A run is random if it is much likelier as random symbols of its inferred
encoding. The likelihood ratio is at most 1 on average under the null, so its inverse is a p-value
(Markov's inequality). A random run is the discovery: Benjamini-Hochberg over all runs of about the
same length keeps the expected share of ordinary writing among the discoveries below RATE, for short
and long runs alike.

*Does it look like random symbols of that encoding?* What follows an order of its own (alphabets,
counters, repeated parts) is no ordinary writing either. A battery of chi-squared for uniform use of
the alphabet, runs above and below the median, and serial correlation, each for the alphabet of the
inferred encoding, must not reject randomness at LEVEL. UUIDs and numbers name things and are no keys.

Positions are code points, the end exclusive. A null text counts as empty. On a corpus without
shorter words nothing is known of its writing, and no random run is found.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.session import cut

RATE = 0.05  # expected share of ordinary writing among the random runs that are reported
LEVEL = 0.005  # of the battery: share of random runs that it rejects
BINS_PER_DECADE, LAST_BIN = 20, 600  # of p-values; their number bounds what the driver sees
LEAST = 14  # characters of a run that is tested; shorter words teach what ordinary writing is
KINDS_ONLY = 0.3  # share of the model that knows only whether symbols are capitals, small letters or digits
PRIOR = 20.0  # transitions from each symbol that are added, spread as the model of kinds says

KINDS = ("assign", "access", "hex")
ASSIGN = (
    "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
# A run from the first AKIA on, and runs of hexadecimal digits, each at least so long.
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"

# Encodings from narrow to wide: name, pattern, size of the alphabet.
ENCODINGS = (
    ("hex", "^([0-9a-f]+|[0-9A-F]+)$", 16),
    ("lower", "^[a-z]+$", 26),
    ("upper", "^[A-Z]+$", 26),
    ("base32", "^[A-Z2-7]+$", 32),
    ("base36", "^([a-z0-9]+|[A-Z0-9]+)$", 36),
    ("letters", "^[A-Za-z]+$", 52),
    ("base62", "^[A-Za-z0-9]+$", 62),
    ("base64", "", 64),
)


RUN = f"[A-Za-z0-9+/_-]{{{LEAST},}}"
NO_KEY = "(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|^[^a-z]+$"  # UUIDs, numbers
WORD = f"(?<![A-Za-z0-9+/_-])[A-Za-z0-9]{{1,{LEAST - 1}}}(?![A-Za-z0-9+/_-])"
# Where a word ends and another begins: before a capital, and between letters and digits.
CHANGE = "(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])"
SYMBOLS = " 0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"  # a space between words


def _matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _places(text: Column, found: Column, pattern: str) -> Column:
    """Starts of the leftmost matches: what lies between them is split off and added up."""
    gaps = F.split(text, pattern, -1)
    empty = F.array().cast("array<int>")
    start = F.struct(F.lit(0).alias("at"), empty.alias("starts"))
    steps = F.zip_with(
        F.slice(gaps, 1, F.greatest(F.size(found), F.lit(1))), found,
        lambda gap, match: F.struct(F.length(gap).alias("gap"), F.length(match).alias("match")),
    )
    added = F.aggregate(
        steps, start,
        lambda acc, s: F.struct(
            (acc["at"] + s["gap"] + s["match"]).alias("at"),
            F.concat(acc["starts"], F.array(acc["at"] + s["gap"])).alias("starts"),
        ),
    )
    return F.when(F.size(found) > 0, added["starts"]).otherwise(empty)


def _sf(z: Column) -> Column:
    """Upper tail of the normal distribution (approximation with an error below 0.1 % of the tail)."""
    x = F.least(F.abs(z), F.lit(37.0))
    t = 1 / (1 + 0.5 * x / math.sqrt(2))
    y = x / math.sqrt(2)
    poly = F.lit(0.17087277)
    for c in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368):
        poly = poly * t + c
    tail = 0.5 * t * F.exp(-y * y - 1.26551223 + t * poly)
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _chi_squared(run: Column, symbols: Column, n: Column, size: Column) -> Column:
    """z of uneven use of the alphabet; Wilson-Hilferty: the cube root of chi-squared is nearly normal."""
    squares = F.aggregate(
        F.transform(F.array_distinct(symbols), lambda c: (F.length(run) - F.length(F.replace(run, c, F.lit("")))).cast("double")),
        F.lit(0.0), lambda t, c: t + c * c,
    )
    df = size - 1
    chi = F.greatest(size * squares / n - n, F.lit(1e-9))
    return (F.pow(chi / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))


def _runs(values: Column, n: Column) -> Column:
    """z of the number of runs above and below the median (Wald-Wolfowitz); far out if one side is empty."""
    start = F.struct(F.lit(-1).alias("last"), F.lit(0).alias("runs"), F.lit(0).alias("ones"))
    seen = _let(
        F.element_at(F.sort_array(values), (n / 2).cast("int") + 1),
        lambda middle: F.aggregate(
            F.transform(values, lambda v: (v >= middle).cast("int")), start,
            lambda a, v: F.struct(
                v.alias("last"), (a["runs"] + (v != a["last"]).cast("int")).alias("runs"), (a["ones"] + v).alias("ones")
            ),
        ),
    )

    def z(found: Column) -> Column:
        ones = found["ones"].cast("double")
        expected = 2 * ones * (n - ones) / n + 1
        variance = F.greatest((expected - 1) * (expected - 2) / (n - 1), F.lit(1e-9))
        return F.when((ones > 0) & (ones < n), (found["runs"] - expected) / F.sqrt(variance)).otherwise(37.0)

    return _let(seen, z)


def _serial(values: Column, n: Column) -> Column:
    """z of the correlation of neighbours; far out if all symbols are the same."""
    zero = F.struct(F.lit(0.0).alias("last"), F.lit(0.0).alias("both"), F.lit(0.0).alias("own"))

    def sums(mean: Column) -> Column:
        return F.aggregate(
            values, zero,
            lambda a, v: F.struct(
                (v - mean).alias("last"), (a["both"] + a["last"] * (v - mean)).alias("both"),
                (a["own"] + (v - mean) * (v - mean)).alias("own"),
            ),
        )

    found = _let(F.aggregate(values, F.lit(0.0), lambda t, v: t + v) / n, sums)
    return _let(found, lambda s: F.when(s["own"] > 0, (s["both"] / s["own"] + 1 / n) * F.sqrt(n)).otherwise(37.0))


def battery(run: Column) -> Column:
    """Struct of encoding, alphabet size and p-value of randomness of a run of code characters.

    The p-value is three times the least of the three tests' (Bonferroni), 1 at most.
    """
    name, size = F.lit(ENCODINGS[-1][0]), F.lit(float(ENCODINGS[-1][2]))
    for kind, pattern, m in reversed(ENCODINGS[:-1]):
        fits = run.rlike(pattern)
        name, size = F.when(fits, kind).otherwise(name), F.when(fits, float(m)).otherwise(size)
    n = F.length(run).cast("double")

    def tested(symbols: Column) -> Column:
        values = F.transform(symbols, lambda c: F.ascii(c).cast("double"))
        return _let(
            values,
            lambda v: F.struct(
                _chi_squared(run, symbols, n, size).alias("chi"), F.abs(_runs(v, n)).alias("runs"), F.abs(_serial(v, n)).alias("serial")
            ),
        )

    z = _let(F.filter(F.split(run, ""), lambda c: F.length(c) > 0), tested)
    p = _let(z, lambda t: 3 * F.least(_sf(t["chi"]), 2 * _sf(t["runs"]), 2 * _sf(t["serial"])))
    return F.struct(name.alias("encoding"), size.cast("int").alias("alphabet"), F.least(p, F.lit(1.0)).alias("p"))


def _pairs(word: Column) -> Column:
    """Pairs of neighbouring symbols of a word or run, with a space before, behind and at each change."""
    spaced = F.concat(F.lit(" "), F.regexp_replace(F.regexp_replace(word, CHANGE, " "), "[+/_-]+", " "), F.lit(" "))
    return _let(spaced, lambda s: F.transform(F.sequence(F.lit(1), F.length(s) - 1), lambda i: s.substr(i, F.lit(2))))


def writing(texts: DataFrame) -> list[float]:
    """Log-probability of each symbol after each other one, in the words shorter than LEAST of all texts.

    Words are counted where they lie before they are shuffled; the driver gets one row for a pair of symbols.
    """
    words = texts.select(F.explode(_matches(F.col("text"), WORD)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    pairs = words.select(F.explode(_pairs(F.col("word"))).alias("pair"), "n").groupBy("pair").agg(F.sum("n").alias("n"))
    size = len(SYMBOLS)
    counts = [[0.0] * size for _ in SYMBOLS]
    for row in pairs.collect():
        counts[SYMBOLS.index(row["pair"][0])][SYMBOLS.index(row["pair"][1])] = float(row["n"])
    if not any(map(sum, counts)):
        return []
    kinds = [" 0Aa".index("0" if c.isdigit() else "A" if c.isupper() else "a" if c.islower() else " ") for c in SYMBOLS]
    many = [kinds.count(k) for k in range(4)]
    steps = [[1.0] * 4 for _ in range(4)]  # between kinds of symbols
    for a, row in zip(kinds, counts, strict=True):
        for b, n in zip(kinds, row, strict=True):
            steps[a][b] += n
    # Words may begin with any kind where they are run together.
    steps[0] = [(x / sum(steps[0]) + 1 / 3) / 2 if k else 0.0 for k, x in enumerate(steps[0])]
    out = []
    for a, row in zip(kinds, counts, strict=True):
        for b, n in zip(kinds, row, strict=True):
            coarse = max(steps[a][b] / sum(steps[a]) / many[b], 1e-9)
            out.append(math.log((1 - KINDS_ONLY) * (n + PRIOR * coarse) / (sum(row) + PRIOR) + KINDS_ONLY * coarse))
    return out


def ordinary(run: Column, n: Column, alphabet: Column, model: list[float]) -> Column:
    """p-value of a run under ordinary writing; 1 if no writing is known."""
    if not model:
        return F.lit(1.0)
    table = F.split(F.lit(",".join(f"{v:.6f}" for v in model)), ",").cast("array<double>")

    def place(pair: Column) -> Column:
        return (F.instr(F.lit(SYMBOLS), pair.substr(1, 1)) - 1) * len(SYMBOLS) + F.instr(F.lit(SYMBOLS), pair.substr(2, 1))

    known = F.aggregate(_pairs(run), F.lit(0.0), lambda total, pair: total + F.element_at(table, place(pair)))
    return F.least(F.exp(F.greatest(known + n * F.log(alphabet.cast("double")), F.lit(-200.0))), F.lit(1.0))


def _stratum(length: Column) -> Column:
    """Runs whose lengths are within a factor of two are judged together."""
    return F.floor(F.log2(length)).cast("int")


def _bin(p: Column) -> Column:
    return F.least(F.floor(-F.log10(F.greatest(p, F.lit(1e-30))) * BINS_PER_DECADE), F.lit(LAST_BIN)).cast("int")


def discovered_from(candidates: DataFrame, rate: float = RATE) -> dict[int, int]:
    """By stratum the first bin of p-values that Benjamini-Hochberg takes for discoveries, for those that have one.

    ``candidates`` holds (stratum, bin). The histogram has at most LAST_BIN + 1 rows a stratum.
    """
    counts = candidates.groupBy("stratum", "bin").agg(F.count("*").alias("n"))
    smaller = Window.partitionBy("stratum").orderBy(F.desc("bin"))
    every = Window.partitionBy("stratum")
    ranked = counts.select("stratum", "bin", F.sum("n").over(smaller).alias("k"), F.sum("n").over(every).alias("all"))
    # The largest p-value of a bin stands for it.
    bound = F.pow(F.lit(10.0), -F.col("bin") / BINS_PER_DECADE)
    rows = ranked.where(bound <= rate * F.col("k") / F.col("all")).groupBy("stratum").agg(F.min("bin").alias("first"))
    return {r["stratum"]: r["first"] for r in rows.collect()}


def scan(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """(doc_id, base, found), one row for each row: arrays of (start, rank, end, kind, p) by start, then kind.

    ``base`` holds the spans of the patterns, ``found`` these and the random runs that do not
    overlap one of them. Only doc_id and text are read; repeated rows give repeated results.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    text = F.col("text")
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "random": RUN}
    rows = rows.withColumns({k: _matches(text, p) for k, p in patterns.items()})
    rows = rows.withColumn("values", F.when(F.size("assign") > 0, _matches(text, ASSIGN, 2)).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumns({f"{k}_at": _places(text, F.col(k), p) for k, p in patterns.items()})

    def spans(kind: str, rank: int) -> Column:
        each = F.arrays_zip(F.col(f"{kind}_at").alias("at"), F.col(kind).alias("match"))
        return F.transform(
            each, lambda s: F.struct(
                s["at"].alias("start"), F.lit(rank).alias("rank"), (s["at"] + F.length(s["match"])).alias("end"),
                F.lit(kind).alias("kind"), F.lit(None).cast("double").alias("p"),
            )
        )

    kept = F.filter(F.arrays_zip(spans("assign", 0).alias("span"), F.col("values").alias("value")), lambda s: F.length(s["value"]) >= 6)
    kept = F.transform(kept, lambda s: s["span"])
    rows = rows.withColumn("base", F.array_sort(F.concat(kept, spans("access", 1), spans("hex", 2))))
    rows = rows.withColumn("runs", F.arrays_zip(F.col("random_at").alias("at"), F.col("random").alias("match")))
    clear = F.filter(
        "runs", lambda r: ~F.exists("base", lambda b: (b["start"] < r["at"] + F.length(r["match"])) & (r["at"] < b["end"]))
    )
    clear = F.filter(clear, lambda r: ~r["match"].rlike(NO_KEY))
    model = writing(docs.select(F.coalesce("text", F.lit("")).alias("text")))
    tested = F.transform(
        clear, lambda r: _let(
            battery(r["match"]), lambda test: F.struct(
                r["at"].alias("at"), F.length(r["match"]).alias("n"), test["p"].alias("random"),
                ordinary(r["match"], F.length(r["match"]), test["alphabet"], model).alias("p"),
            )
        )
    )
    found = cut(rows.select("doc_id", "base", tested.alias("tested")), "secrets")

    each = found.select(F.explode("tested").alias("r"))
    first = discovered_from(each.select(_stratum(F.col("r.n")).alias("stratum"), _bin(F.col("r.p")).alias("bin")), rate)
    limits = F.create_map(*[F.lit(x) for s in range(64) for x in (s, first.get(s, LAST_BIN + 1))])
    random = F.filter("tested", lambda r: (_bin(r["p"]) >= F.try_element_at(limits, _stratum(r["n"]))) & (r["random"] >= LEVEL))
    added = F.transform(
        random, lambda r: F.struct(
            r["at"].alias("start"), F.lit(len(KINDS)).alias("rank"), (r["at"] + r["n"]).alias("end"),
            F.lit("random").alias("kind"), r["p"].alias("p"),
        )
    )
    return found.select("doc_id", "base", F.array_sort(F.concat("base", added)).alias("found"))


def joined(spans: Column | str) -> Column:
    """Spans as kind:start:end, comma-joined."""
    parts = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(parts, ",")
