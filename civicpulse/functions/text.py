"""Text functions, all ``Column -> Column`` and evaluated on the JVM."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import patterns as P

# Stands between the tokens of a pair; within a token it and ESCAPE are written as ESCAPE and a digit.
PAIR_SEPARATOR, ESCAPE = "\u0001", "\u0002"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def with_computed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column that later filters use.

    The optimizer moves a filter below the column it tests and computes the column there
    once more; it does not do so below a generator.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


# ---- entities ---------------------------------------------------------------------

def char_of(code: Column) -> Column:
    """The character of a code point (``char`` itself stops at 255); null if invalid."""
    valid = ((code >= 0) & (code <= 0x10FFFF)) & ~code.between(0xD800, 0xDFFF)
    # The leading byte-order mark is consumed by the decoder.
    utf32 = F.unhex(F.concat(F.lit("0000FEFF"), F.lpad(F.hex(code), 8, "0")))
    return F.when(valid, F.decode(utf32, "UTF-32"))


def _substitute(text: Column, found: Column, char: Callable[[Column], Column]) -> Column:
    return F.aggregate(
        found, text, lambda acc, e: F.coalesce(F.replace(acc, e, char(e)), acc))


def decode_numeric_entities(text: Column) -> Column:
    def char(entity):
        digits = F.substring(entity, F.lit(3), F.length(entity) - 3)
        return char_of(digits.try_cast("bigint"))

    found = F.array_distinct(F.regexp_extract_all(text, F.lit(r"(&#\d+;)"), F.lit(1)))
    return _substitute(text, found, char)


def named_entities(text: Column) -> Column:
    """Distinct named entities of a text other than ``&amp;``."""
    found = F.regexp_extract_all(text, F.lit(r"(&[\p{L}\p{N}_]+;)"), F.lit(1))
    return F.array_except(F.array_distinct(found), F.array(F.lit("&amp;")))


def decode_named_entities(text: Column, strict: bool = False) -> Column:
    """Named entities to characters, then ``&amp;`` to " and ".

    ``strict`` keeps ``&amp;`` in a text that holds no other named entity.
    """
    # One literal that the optimizer folds to a map; no entity is a control character.
    pairs = "\u0001".join(f"{n}\u0002{chr(c)}" for n, c in name2codepoint.items())
    names = F.str_to_map(F.lit(pairs), F.lit("\u0001"), F.lit("\u0002"))

    def char(entity):
        return F.try_element_at(names, F.substring(entity, F.lit(2), F.length(entity) - 2))

    def body(found):
        decoded = _substitute(text, found, char)
        spelled = F.replace(decoded, F.lit("&amp;"), F.lit(" and "))
        return F.when(F.size(found) > 0, spelled).otherwise(decoded) if strict else spelled

    return bind(named_entities(text), body)


def decode_entities(text: Column, strict: bool = False) -> Column:
    decoded = bind(decode_numeric_entities(text), lambda t: decode_named_entities(t, strict))
    return F.when(F.contains(text, F.lit("&")), decoded).otherwise(text)


# ---- tokens -----------------------------------------------------------------------

def raw_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(P.TOKEN), F.lit(1))


def normalize_emoticon(token: Column) -> Column:
    """Keep the first occurrence of each character, in order."""
    return F.array_join(F.array_distinct(F.split(token, "")), "")


def mask_addresses(text: Column) -> Column:
    """Web addresses to a mark; expects lower case."""
    return F.regexp_replace(text, P.ADDRESS, P.ADDRESS_MARK)


def fold_token(token: Column) -> Column:
    """Emoticons lose repeated characters, other tokens lose case and addresses."""
    # Byte searches keep most tokens away from the two patterns: every emoticon has one of
    # these eyes, every address has a dot.
    eyes = [F.contains(token, F.lit(eye)) for eye in ":;=8"]
    is_emoticon = (eyes[0] | eyes[1] | eyes[2] | eyes[3]) & token.rlike(P.STARTS_WITH_EMOTICON)
    return (
        F.when(is_emoticon, normalize_emoticon(token))
        .when(F.contains(token, F.lit(".")), mask_addresses(F.lower(token)))
        .otherwise(F.lower(token)))


def tokenize(
    text: Column,
    preserve_case: bool = False,
    stopwords: Sequence[str] = P.STOPWORDS,
    strict_entities: bool = False,
) -> Column:
    """Decoded, folded tokens without stop words and hashtags."""
    tokens = raw_tokens(decode_entities(text, strict_entities))
    if not preserve_case:
        tokens = F.transform(tokens, fold_token)
    return F.filter(
        tokens, lambda t: ~t.isin(*stopwords) & ~F.startswith(t, F.lit("#")))


def whitespace_tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"[\s\p{Z}]+"), lambda t: t != "")


def strip_hash_lower(text: Column) -> Column:
    return F.lower(F.replace(text, F.lit("#"), F.lit("")))


def escaped(token: Column) -> Column:
    """The token without the separator of pairs; different tokens stay different."""
    first = F.replace(token, F.lit(ESCAPE), F.lit(ESCAPE + "2"))
    return F.replace(first, F.lit(PAIR_SEPARATOR), F.lit(ESCAPE + "1"))


def adjacent_pairs(tokens: Column) -> Column:
    """Pairs of neighbours, ``first`` and ``second``."""
    def pairs(t):
        n = F.greatest(F.size(t) - 1, F.lit(0))
        return F.zip_with(
            F.slice(t, 1, n), F.slice(t, 2, n), lambda a, b: F.struct(a.alias("first"), b.alias("second")))

    return bind(tokens, pairs)


def plain_tokens(t: Column) -> Column:
    """Tokens without the separator of pairs."""
    # Hardly a text holds one of the two characters; all its tokens are searched at once.
    whole = F.array_join(t, "")
    special = F.contains(whole, F.lit(PAIR_SEPARATOR)) | F.contains(whole, F.lit(ESCAPE))
    return F.when(special, F.transform(t, escaped)).otherwise(t)


def joined_tokens(tokens: Column) -> Column:
    """Tokens as one text, with the separator of pairs between them; null without any."""
    return bind(tokens, lambda t: F.when(F.size(t) > 0, F.array_join(plain_tokens(t), PAIR_SEPARATOR)))


def features_of(tokens: Column) -> Column:
    """The set of single tokens and neighbour pairs."""
    def both(t):
        plain = plain_tokens(t)
        n = F.greatest(F.size(t) - 1, F.lit(0))
        pairs = bind(plain, lambda p: F.zip_with(
            F.slice(p, 1, n), F.slice(p, 2, n), lambda a, b: F.concat(a, F.lit(PAIR_SEPARATOR), b)))
        return F.array_distinct(F.concat(plain, pairs))

    return bind(tokens, both)


def feature_map(tokens: Column) -> Column:
    """The feature set as ``feature -> true``."""
    return bind(features_of(tokens),
                lambda f: F.map_from_arrays(f, F.transform(f, lambda _: F.lit(True))))


TOKENIZERS: dict[str, Callable[[Column], Column]] = {
    "clean": tokenize,
    "whitespace": whitespace_tokens,
}


# ---- page and location strings ----------------------------------------------------

def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, r"<[^>]+>", "")


def clean_review_text(text: Column) -> Column:
    return F.regexp_replace(strip_tags(text), r"\n", "")


def clean_forum_text(text: Column) -> Column:
    flat = F.regexp_replace(strip_tags(text), r"[\n\r\t]", " ")
    return F.regexp_replace(flat, " +", " ")


def clean_topic(text: Column) -> Column:
    return F.trim(F.lower(F.regexp_replace(text, r"[\n\r\t]", " ")))


def location_label(text: Column) -> Column:
    """What follows ``Location: `` on its line, or null."""
    return F.nullif(F.regexp_extract(text, r"Location: (.+)", 1), F.lit(""))


def clean_location(location: Column, strict: bool = False) -> Column:
    """The place name before the first punctuation mark; null if there is none.

    ``strict`` reproduces the pattern that also drops the last character of a location
    without punctuation.
    """
    if strict:
        cut = F.regexp_replace(location, rf"^([^{P.LOCATION_PUNCTUATION}]+).+$", "$1")
    else:
        cut = F.trim(F.regexp_extract(location, rf"^([^{P.LOCATION_PUNCTUATION}]+)", 1))
    return F.nullif(cut, F.lit(""))
