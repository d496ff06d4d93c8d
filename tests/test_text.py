import re
from collections import OrderedDict

import pytest
from pyspark.sql import functions as F

from civicpulse.functions import patterns as P
from civicpulse.functions import text


def values(spark, rows, column, kind="string"):
    df = spark.createDataFrame([(r,) for r in rows], f"t {kind}")
    return [r[0] for r in df.select(column(F.col("t"))).collect()]


TOKEN_CASES = {
    "Great :))) hotel.The best... wow.... call 312-555-1234 @bob #jobs 1.5 don't http://t.co/ab d: 8) ok":
        ["Great", ":)))", "hotel.The", "best...", "wow....", "call", "312-555-1234", "@bob", "#jobs", "1.5",
         "don't", "http://t.co/ab", "d:", "8)", "ok"],
    "x #x y": ["x", "#", "x", "y"],
    "<b>hi</b>": ["<b>", "hi", "</b>"],
    "a . . . b": ["a", ". . .", "b"],
    "café": ["caf", "é"],
    "one two": ["one", "two"],
    "": [],
}


def test_plain_words_are_passed_by_first_without_change(spark):
    """A quick way for plain words and white space, and the same tokens as by the alternatives alone."""
    assert P.PLAIN_WORD in P.TOKEN and not P.token_pattern().count(P.PLAIN_WORD)
    odd = ["", " ", "\u00a0", "\n", ",", "!", "?", '"', ".", "-", "'", "_", ":", ";", "=", "8", ")", "/", "o", "d", "é", "://", "\u2028", "'-"]
    words = ["word", "dpd", "ppo", "http", "ab", "Caf", "xx8xx", "ſſſ", "KKK", "#tag", "555"]
    rows = [a + x + b + y + c for a in ("", "dp", "8") for x in odd for b in words for y in odd for c in ("", "com", ")")]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    plain = F.regexp_extract_all("t", F.lit(P.token_pattern()), F.lit(1))
    assert df.where(~text.raw_tokens(F.col("t")).eqNullSafe(plain)).count() == 0


@pytest.mark.parametrize("source", TOKEN_CASES)
def test_raw_tokens(spark, source):
    assert values(spark, [source], text.raw_tokens) == [TOKEN_CASES[source]]


def test_clean_tokens(spark):
    got = values(spark, ["The BEST hotel.The #tag :))) D: .... don't", "the and #ab", "", None], text.tokenize)
    assert got == [["best", "_url_", ":)", "D:", "_url_", "don't"], [], [], None]


def test_case_option_skips_folding(spark):
    keep = lambda c: text.tokenize(c, preserve_case=True)
    assert values(spark, ["The Best the :))) a.com"], keep) == [["The", "Best", ":)))", "a.com"]]


def test_long_runs_do_not_overflow(spark):
    assert [len(x) for x in values(spark, [". " * 30_000, "(" * 3_000], text.raw_tokens)] == [1, 3_000]


def test_fold_matches_a_plain_rendering(spark):
    samples = ["8)", ":-D", "=(((", "x:P", "Www.Example.com/a", "8", "18:30", "D:", "d.com", "p8", "...."]
    emoticon = re.compile(P.STARTS_WITH_EMOTICON)
    address = re.compile(P.ADDRESS.replace(r"\p{L}\p{N}", r"\w").replace(r"\p{Nd}", r"\d"))
    expected = ["".join(OrderedDict.fromkeys(s)) if emoticon.match(s) else address.sub("_url_", s.lower())
                for s in samples]
    assert values(spark, samples, text.fold_token) == expected


def test_entities(spark):
    rows = ["&#233;&#8364;&#128512;", "&eacute;", "&amp;", "&amp; &copy;", "&#38;lt;", "&bogus; &amp;",
            "&#1114112; &#55296; &#99999999999999999999;", "plain"]
    assert values(spark, rows, text.decode_entities) == [
        "é€😀", "é", " and ", " and  ©", "<", "&bogus;  and ",
        "&#1114112; &#55296; &#99999999999999999999;", "plain"]
    strict = lambda c: text.decode_entities(c, strict=True)
    assert values(spark, ["&amp;", "&amp; &copy;", "&bogus; &amp;"], strict) == ["&amp;", " and  ©", "&bogus;  and "]


def test_features_are_a_set_that_bridges_removed_words(spark):
    tokens = lambda c: text.features_of(text.tokenize(c))
    assert values(spark, ["good the day good day", "one", ""], tokens) == [
        ["good", "day", "good\u0001day", "day\u0001good"], ["one"], []]
    assert values(spark, ["a b"], lambda c: text.feature_map(text.whitespace_tokens(c))) == [
        {"a": True, "b": True, "a\u0001b": True}]


def test_whitespace_and_hash(spark):
    assert values(spark, ["  A  #b\tc\n"], text.whitespace_tokens) == [["A", "#b", "c"]]
    assert values(spark, ["#ChiCago ##x"], text.strip_hash_lower) == ["chicago x"]


LOCATIONS = {
    "Chicago, IL": ("Chicago", "Chicago"), "Chicago": ("Chicago", "Chicag"), "A": ("A", "A"),
    ",x": (None, ",x"), "": (None, None), None: (None, None), "  (x)": (None, "  "),
    "New York (NY)": ("New York", "New York "), "C+ Town": ("C+ Town", "C+ Tow"),
}


@pytest.mark.parametrize("source", LOCATIONS)
def test_clean_location(spark, source):
    intent, strict = LOCATIONS[source]
    assert values(spark, [source], text.clean_location) == [intent]
    assert values(spark, [source], lambda c: text.clean_location(c, strict=True)) == [strict]


def test_page_strings(spark):
    assert values(spark, ["a<br>\n\tb  c\r"], text.clean_forum_text) == ["a b c "]
    assert values(spark, ["a<br>\nb\tc"], text.clean_review_text) == ["ab\tc"]
    assert values(spark, ["\n Chicago | X\t"], text.clean_topic) == ["chicago | x"]
    assert values(spark, ["Posts: 1\nLocation: Oak Park\nx", "none"], text.location_label) == ["Oak Park", None]


def test_digits_and_spaces_of_all_scripts(spark):
    assert values(spark, ["\u0663/\u0664", ".\u00a0.", "\u0663-\u0664"], text.raw_tokens) == [["\u0663/\u0664"], [".\u00a0."], ["\u0663-\u0664"]]
