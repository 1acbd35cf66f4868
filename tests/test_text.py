import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioscope.functions import text as T


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "reason"),
    [
        ("short", "too_little_text"),
        ("a b c d e " * 20 + "(cid:7)", "replacement_or_cid_characters"),
        ("words and words " * 5 + "�", "replacement_or_cid_characters"),
        ("words and words " * 5 + "\x00", "null_characters"),
        ("aaaa bbbb cccc words and more words of text to reach the limit", "duplicated_glyph_runs"),
        ("%%% ### $$$ !!! ??? ... ,,, ;;; ::: ((( ))) a b c d e" * 2, "low_readable_character_ratio"),
        ("正文" * 30, "text_layer_candidate"),
        ("　" * 50 + "short", "too_little_text"),
    ],
)
def test_quality(spark, text, reason):
    got = one(spark, T.quality(F.col("t")), t=text)
    assert got["reason"] == reason
    assert got["ok"] == (reason == "text_layer_candidate")


def test_terms_of_latin_and_han(spark):
    got = one(spark, T.terms(F.col("t")), t="Tax TAX 2020; 公共政策 研")
    assert sorted(got) == sorted(["tax", "tax", "2020", "公共", "共政", "政策", "研"])


def test_citation_offsets_count_code_points(spark):
    text = "𝒜 says (Lee, 2020) and [3, 4] and (Lee, 2020) again［５］"
    got = one(spark, T.citation_markers(F.col("t")), t=text)
    assert [(m["kind"], text[m["start"] : m["end"]]) for m in got] == [("author_year", "(Lee, 2020)"), ("numbered", "[3, 4]"), ("author_year", "(Lee, 2020)"), ("numbered", "［５］")]


@pytest.mark.parametrize(("path", "bad"), [("a/b.pdf", False), ("a/../b.pdf", False), ("../b", True), ("a/../../b", True), ("/abs", True), ("C:\\x", True), ("\\\\host\\x", True), ("a\\..\\..\\b", True)])
def test_paths(spark, path, bad):
    assert one(spark, T.path_escapes(F.col("t")), t=path) is bad


def test_titles_and_quotes(spark):
    assert one(spark, T.clean_title(F.col("t")), t="【x】A_book (z-library.sk)") == "A book"
    assert one(spark, T.report_quote(F.col("t"), True), t="effi-\ncient  ﬁt\n") == "efficient fit"
    assert one(spark, T.report_quote(F.col("t"), False), t="甲 \x82 乙\x00") == "甲，乙"


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(alphabet=" \t\n\r\x0b\x0c\x1c\x1d\x85\u00a0\u3000\u2028aZ0é公", max_size=30))
def test_squeeze_and_lines_agree_with_python(spark, text):
    row = spark.createDataFrame([(text,)], "t string").select(T.squeeze(F.col("t")).alias("s"), T.lines(F.col("t")).alias("l"), T.strip(F.col("t")).alias("p")).first()
    assert row["s"] == "".join(c for c in text if not c.isspace())
    assert row["p"] == text.strip()
    want = re.split("\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]", text)
    assert row["l"] == want
