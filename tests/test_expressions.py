import math
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioscope.functions import calendar as C
from folioscope.functions import text as X
from folioscope.functions import vectors as V


def values(spark, rows, expression, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, c {kind}")
    return [r[0] for r in df.orderBy("i").select(expression).collect()]


def test_subject_code(spark):
    rows = [
        "Machine Learning (cs.LG)",
        "General Relativity (gr-qc)",
        "Physics (General) (physics.gen-ph)",
        "Unclassified",
        "",
        None,
        "Empty ()",
    ]
    assert values(spark, rows, X.subject_code("c")) == [
        "cs.LG", "gr-qc", "General", None, None, None, None,
    ]
    assert values(spark, rows[:3], X.subject_code("c", strict=True)) == [
        "cs.LG", "gr-qc", "physics.gen-ph",
    ]


def test_subject_codes(spark):
    rows = ["A (cs.AI); B (physics.optics); C (gr-qc); D (stat.ML)", "", None]
    assert values(spark, rows, X.subject_codes("c")) == [["cs.AI", "stat.ML"], [], None]


def test_partition_year_month(spark):
    rows = ["22 Jan 2009", "Submitted 7 Mar 2023 (v2)", "5 Foo 2024", "Jan 2024", "", None]
    assert values(spark, rows, X.partition_year("c")) == ["2009", "2023", None, None, None, None]
    assert values(spark, rows, X.partition_month("c")) == ["01", "03", None, None, None, None]


def test_year_month(spark):
    rows = [
        "22 Jan 2009",
        "99 Jan 2024",
        "  1\tDec   20x4 ",
        "Submitted 7 Mar 2023 (v2)",
        "Jan 2024",
        "5 Foo 2024",
        "",
        None,
    ]
    assert values(spark, rows, X.year_month("c")) == [
        "2009-01", "2024-01", "20x4-12", None, None, None, None, None,
    ]


def test_embed_text_keeps_512_characters_or_all(spark):
    df = spark.createDataFrame([("T" * 10, "é" * 600), (None, "a"), ("t", None)], "title string, abstract string")
    short = [r[0] for r in df.select(X.embed_text()).collect()]
    assert short == ["T" * 10 + " " + "é" * 501, None, None]
    whole = df.select(X.embed_text(chars=None)).first()[0]
    assert len(whole) == 611


def test_shorten(spark):
    assert values(spark, ["a" * 100, "a" * 101, None], X.shorten("c", 100)) == [
        "a" * 100, "a" * 100 + "...", None,
    ]


def test_subject_group(spark):
    rows = ["cs.AI", "gr-qc", ".x", "a.b.c"]
    assert values(spark, rows, X.subject_group("c")) == ["cs", "gr-qc", ".x", "a"]


def test_terms(spark):
    assert values(spark, ["The the x_1 Über-Maß a 42"], X.terms("c")) == [["the", "x_1", "über", "maß", "42"]]


@settings(max_examples=15, deadline=None)
@given(
    st.lists(
        st.tuples(*[st.lists(st.floats(-5, 5, width=32), min_size=3, max_size=3)] * 2),
        min_size=1,
        max_size=20,
    )
)
def test_vector_functions(spark, pairs):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a array<float>, b array<float>")
    rows = df.orderBy("i").select(
        V.dot("a", "b"), V.cosine_similarity("a", "b"), V.distance("a", "b")
    ).collect()
    for (a, b), (dot, cosine, distance) in zip(pairs, rows, strict=True):
        assert dot == pytest.approx(sum(x * y for x, y in zip(a, b, strict=True)))
        assert distance == pytest.approx(math.dist(a, b))
        lengths = math.hypot(*a) * math.hypot(*b)
        if lengths == 0:
            assert cosine is None
        elif lengths > 1e-3:
            assert cosine == pytest.approx(dot / lengths, abs=1e-9)


def test_dominant_topic_takes_the_first_of_equals(spark):
    rows = [[0.1, 0.9, 0.9], [3.0, -1.0, 2.0]]
    assert values(spark, rows, V.dominant_topic("c"), "array<double>") == [1, 0]


def test_normalise(spark):
    assert values(spark, [[3.0, 4.0]], V.normalise("c"), "array<float>")[0] == pytest.approx([0.6, 0.8])


def test_months():
    assert C.months_back("2024-03", 11) == "2023-04"
    assert C.months_back("2024-01", 1) == "2023-12"
    assert C.months_of_year("2024", "2024-03") == ["01", "02", "03"]
    assert len(C.months_of_year("2023", "2024-03")) == 12


def test_month_bounds(spark):
    df = spark.createDataFrame([("2023", "12"), ("2024", "01"), ("2024", "07")], "year string, month string")
    assert df.where(C.not_after("2024-01")).count() == 2
    assert df.where(C.not_before("2024-01")).count() == 2
    assert df.select(F.count_if(C.not_after("2023-11"))).first()[0] == 0


_TOKENS = st.sampled_from(["1", "22", "99", "Jan", "Dec", "Foo", "jan", "2024", "20x4", "(v2)", "on", "", " ", "\t"])


@settings(max_examples=30, deadline=None)
@given(st.lists(st.lists(_TOKENS, max_size=5).map(" ".join), min_size=1, max_size=40))
def test_dates_of_any_shape(spark, rows):
    """Both date rules next to a plain statement of each."""
    number = {m: f"{i:02d}" for i, m in enumerate(X.MONTHS, 1)}

    def strict(s):
        parts = s.split()
        ok = len(parts) == 3 and parts[1] in number
        return f"{parts[2]}-{number[parts[1]]}" if ok else None

    def lenient(s):
        found = re.search(r"\d{1,2}\s+(\w{3})\s+(\d{4})", s)
        ok = found and found[1] in number
        return (found[2], number[found[1]]) if ok else (None, None)

    assert values(spark, rows, X.year_month("c")) == [strict(s) for s in rows]
    both = F.struct(X.partition_year("c"), X.partition_month("c"))
    assert [tuple(r) for r in values(spark, rows, both)] == [lenient(s) for s in rows]
