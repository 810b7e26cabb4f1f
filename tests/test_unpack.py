from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from frameloom.operators.unpack import parse_packed, unpack
from tests.conftest import rows


def vals(text):
    return [v for _, v, _ in parse_packed(text)]


def test_delimiters_quotes_and_remarks():
    for text, want in {
        "a; b;c": ["a", "b", "c"], " a | b |": ["a", "b"], "a\tb\nc\r\nd": ["a", "b", "c", "d"], "Bk 1/2 / x /": ["Bk 1/2", "x"], "a /  / b": ["a", "b"], "a · b": ["a", "b"],
        '"x; y", z': ["x; y", "z"], "“p, q”;„r | s“": ["p, q", "r | s"], "'Porcupine; Field 2', Egret's Eye": ["Porcupine; Field 2", "Egret's Eye"],
        '"The ""Old"" One", b': ['The "Old" One', "b"], '"The \\"Old\\" One"': ['The "Old" One'], '["a, b", "\\u03b5 c"]': ["a, b", "ε c"],
        "LX 5 (alt: Ost, West), b": ["LX 5 (alt: Ost, West)", "b"], "'Pumpkin's Veil', b": ["Pumpkin's Veil", "b"], ", ;; ": [], "": [], "  ": [],
    }.items():
        assert vals(text) == want, text


def test_malformed_input_is_read_as_it_stands_and_flagged():
    assert parse_packed('"a, b') == [(1, '"a', "bad_quote"), (2, "b", "bare")]
    assert parse_packed("a (b, c")[0] == (1, "a (b", "bad_bracket")
    assert [f for _, _, f in parse_packed('["x", "y')] == ["bad_bracket", "bad_quote"]
    assert parse_packed(None) == []


def test_long_fields_take_linear_time():
    assert len(vals("'x, " * 50_000)) == 50_000
    assert len(vals("(x, " * 50_000)) == 50_000
    assert vals('"' + "a" * 200_000 + '"') == ["a" * 200_000]


names = st.text(alphabet='abc ;,|"(“\'', min_size=1, max_size=8).map(str.strip).filter(lambda s: s and "\\" not in s)


@given(st.lists(names, min_size=1, max_size=6))
@settings(max_examples=300, deadline=None)
def test_quoted_names_come_back(items):
    assert vals("; ".join('"' + x.replace('"', '""') + '"' for x in items)) == items


def test_rows_repeats_nulls_and_clashes(spark):
    df = spark.createDataFrame([(1, "a; b"), (1, "a; b"), (2, None), (3, "")], "k int, packed string")
    for c in ("pos", "value", "flag"):
        df = df.withColumn(c, F.lit(0))
    assert rows(unpack(df, "k", "packed")) == [(1, 1, "a", "bare")] * 2 + [(1, 2, "b", "bare")] * 2
    assert unpack(df.limit(0), "k", "packed").count() == 0
