"""Which posts are kept, and which cities they are about.

Cities, keywords and languages are parameters, so they become literals of the plan: the
fan-out happens inside each row and needs neither a join nor a shuffle.  Lists too long for a
plan are tables: phrases are found by their rarest term, names by equality of word runs or
prefixes of the lengths that names have.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import groupby
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import bind, strip_hash_lower, whitespace_tokens, with_computed
from ..session import run_dir
from .skew import broadcast_if_small, hot_keys, salted_join

# A table of phrases or terms up to this size is broadcast; ROW_BYTES stands for its numbers.
BROADCAST_BYTES, ROW_BYTES = 64 * 1024 * 1024, 64
# Phrases filed under terms of texts that one task compares.
TASK_MEETINGS = 4_000_000


def track_phrases(spark: SparkSession, hashtags: Sequence[str], cities: Sequence[str]) -> DataFrame:
    """Every hashtag with every city as one phrase."""
    tags = spark.createDataFrame([(h,) for h in hashtags], "hashtag string")
    return (
        tags.withColumn("city", F.explode(F.array(*[F.lit(c) for c in cities])))
        .withColumn("phrase", F.concat(F.lit("#"), "hashtag", F.lit(" "), "city")))


def phrase_list(hashtags: Sequence[str], cities: Sequence[str]) -> list[str]:
    return [f"#{h} {c}" for h in hashtags for c in cities]


def terms_of(text: Column) -> Column:
    """What the terms of a phrase are compared with: words with ``#`` or ``@``, and without."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"([#@]?[\p{L}\p{N}_]+)"), F.lit(1))
    return bind(words, lambda w: F.array_distinct(F.concat(w, F.transform(w, lambda x: F.ltrim(x, F.lit("#@"))))))


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Written as columns, which are far smaller than rows; a lost executor repeats none of it."""
    folder = run_dir(df.sparkSession, purpose)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def fits(df: DataFrame, *texts: str) -> bool:
    """Whether a stored table with these texts can be broadcast."""
    size = df.agg(F.sum(sum((F.octet_length(c) for c in texts), F.lit(ROW_BYTES)))).first()[0] or 0
    return size <= BROADCAST_BYTES


def tracked_phrases(df: DataFrame, phrases: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key, phrase``: the phrases of a table (``phrase``) all of whose terms a text holds.

    Of the terms of a text only those that are in some phrase move, once, as numbers.  Each
    phrase is filed under its term that fewest texts hold, so a text meets a phrase only if it
    has that one; then the other terms are looked for among its own.  The filed phrases are
    brought to the texts, so what a text may hold is never shuffled; there are as many tasks as
    that takes.  Only a table of phrases too large to broadcast meets the texts by a shuffle,
    salted for frequent terms.  A phrase without terms is in no text.  ``key`` identifies a text.
    """
    terms = F.array_distinct(F.filter(F.split(F.lower("phrase"), r"\s+"), lambda t: t != ""))
    wanted = stored(phrases.select("phrase").distinct().withColumn("terms", terms).where(F.size("terms") > 0), "phrases")
    each = wanted.select("phrase", F.explode("terms").alias("term"))
    universe = stored(each.select("term").distinct().withColumn("number", F.monotonically_increasing_id()), "universe")
    words = df.select(key, F.explode(terms_of(F.col(text))).alias("term"))
    known = F.broadcast(universe) if fits(universe, "term") else universe
    held = stored(words.join(known, "term").select(key, "number"), "terms")
    counts = held.groupBy("number").agg(F.count(F.lit(1)).alias("n"))
    by_count = F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term", "number")))
    ranked = each.join(universe, "term").join(counts, "number", "left").groupBy("phrase").agg(by_count.alias("terms"))
    first, second = F.get("terms", F.lit(0)), F.get("terms", F.lit(1))
    filed = stored(ranked.where(first["n"] > 0).select(
        first["number"].alias("number"), first["n"].alias("n"), "phrase", second["number"].alias("second"),
        F.transform(F.slice("terms", F.lit(3), F.size("terms")), lambda t: t["number"]).alias("rest")), "filed")
    all_there = (F.col("second").isNull() | F.array_contains("present", F.col("second"))) & (
        (F.size("rest") == 0) | (F.size(F.array_except("rest", "present")) == 0))
    # A text meets so many phrases in all; a task has its share of them.
    meetings = filed.agg(F.sum("n")).first()[0] or 0
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), ceil(meetings / TASK_MEETINGS))
    rows = held.repartition(tasks, key).groupBy(key, "number").agg(F.count(F.lit(1)).alias("rows"))
    texts = rows.groupBy(key).agg(F.collect_list(F.struct("number", "rows")).alias("held")).withColumn(
        "present", F.transform("held", lambda h: h["number"]))
    if fits(filed, "phrase"):
        one = texts.select(key, "present", F.explode("held").alias("h"))
        # Rows with one key and the same term count each.
        one = one.select(key, "present", F.explode(F.array_repeat(F.col("h.number"), F.col("h.rows").cast("int"))).alias("number"))
        return one.join(F.broadcast(filed), "number").where(all_there).select(key, "phrase")
    met = salted_join(held, filed, "number", hot_keys(counts, "number"))
    # A phrase of one term is found by now.
    alone = met.where(F.col("second").isNull()).select(key, "phrase")
    there = texts.select(F.col(key).alias("held_key"), "present")
    others = met.where(F.col("second").isNotNull()).join(there, F.col(key).eqNullSafe(F.col("held_key")))
    return alone.unionByName(others.where(all_there).select(key, "phrase"))


def track_filter_by(df: DataFrame, phrases: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Rows that hold all terms of any phrase of a table."""
    return df.join(tracked_phrases(df, phrases, key, text).select(key).distinct(), key, "left_semi")


def tracked(text: Column, phrases: Sequence[str]) -> Column:
    """True if all terms of any phrase occur in the text, in any order and case.

    A plain term also matches the word behind ``#`` or ``@``; a term with ``#`` needs the
    hashtag.
    """
    terms = [sorted(set(p.lower().split())) for p in phrases]
    universe = sorted({t for ts in terms for t in ts})
    words = F.regexp_extract_all(F.lower(text), F.lit(r"([#@]?[\p{L}\p{N}_]+)"), F.lit(1))

    def matches(words):
        forms = F.concat(words, F.transform(words, lambda w: F.ltrim(w, F.lit("#@"))))
        # Only the few terms that occur are kept before the phrases are checked.
        present = F.array_distinct(F.filter(forms, lambda w: w.isin(*universe)))
        wanted = F.array(*[F.array(*[F.lit(t) for t in ts]) for ts in terms])
        return bind(present, lambda have: F.exists(
            wanted, lambda ts: F.forall(ts, lambda t: F.array_contains(have, t))))

    return F.coalesce(bind(words, matches), F.lit(False))


def track_filter(df: DataFrame, phrases: Sequence[str], text: str = "text") -> DataFrame:
    return df.where(tracked(F.col(text), phrases))


def language_filter(df: DataFrame, languages: Sequence[str], lang: str = "lang") -> DataFrame:
    return df.where(F.lower(lang).isin([x.lower() for x in languages]))


def mentioned_cities(text: Column, cities: Sequence[str], phrase_match: bool = False) -> Column:
    """Array with one entry per occurrence of a city in the text.

    Single words only, unless ``phrase_match`` also looks for names of several words.
    """
    by_words = {
        k: [c.lower() for c in cs]
        for k, cs in groupby(sorted(cities, key=lambda c: len(c.split())),
                             key=lambda c: len(c.split()))}

    def runs_of(tokens, width, names):
        starts = F.when(F.size(tokens) >= width, F.sequence(F.lit(1), F.size(tokens) - width + 1))
        runs = F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, width), " "))
        return F.filter(F.coalesce(runs, F.array().cast("array<string>")), lambda r: r.isin(*names))

    def found(tokens):
        hits = F.filter(tokens, lambda t: t.isin(*by_words.get(1, [""])))
        longer = [runs_of(tokens, k, names) for k, names in by_words.items() if k > 1]
        return F.concat(hits, *longer) if phrase_match else hits

    return bind(whitespace_tokens(strip_hash_lower(text)), found)


def with_mentions(
    df: DataFrame, cities: Sequence[str], text: str = "text", phrase_match: bool = False
) -> DataFrame:
    """Keep rows that name a city, with one entry of ``cities`` per occurrence."""
    found = with_computed(df, "cities", mentioned_cities(F.col(text), cities, phrase_match))
    return found.where(F.size("cities") > 0)


def city_mentions(
    df: DataFrame, cities: Sequence[str], text: str = "text", phrase_match: bool = False
) -> DataFrame:
    """One output row per occurrence of a city, duplicates kept; others are dropped."""
    hits = df.withColumn("city", F.explode_outer(mentioned_cities(F.col(text), cities, phrase_match)))
    return hits.where(F.col("city").isNotNull())


def lengths_of(names: DataFrame, length: Column) -> Column:
    """The lengths that names have: no more than the longest name is long."""
    found = names.select(length.alias("n")).distinct().collect()
    return F.array(*[F.lit(n) for n in sorted(r["n"] for r in found)]).cast("array<int>")


def city_mentions_by(df: DataFrame, cities: DataFrame, text: str = "text") -> DataFrame:
    """One output row per occurrence of a name of the table ``cities`` (``city``).

    The runs of words of a text, of the numbers of words that names have, are looked up by
    equality.
    """
    names = cities.select(F.lower("city").alias("city")).where("trim(city) <> ''").distinct()
    widths = lengths_of(names, F.size(F.split("city", " ")))

    def runs(tokens):
        def of(width):
            starts = F.when(F.size(tokens) >= width, F.sequence(F.lit(1), F.size(tokens) - width + 1))
            return F.coalesce(F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, width), " ")), F.array().cast("array<string>"))
        return F.flatten(F.transform(widths, of))

    found = df.withColumn("city", F.explode_outer(bind(whitespace_tokens(strip_hash_lower(F.col(text))), runs)))
    return found.join(broadcast_if_small(names), "city", "left_semi")


def topic_cities_by(df: DataFrame, cities: DataFrame, topic: str = "topic") -> DataFrame:
    """One output row per city of the table whose lower-cased name starts the topic."""
    names = cities.where("city IS NOT NULL").select("city", F.lower("city").alias("prefix")).distinct()
    lengths = F.filter(lengths_of(names, F.length("prefix")), lambda n: n <= F.length(topic))
    cut = df.withColumn("prefix", F.explode_outer(F.transform(lengths, lambda n: F.substr(F.col(topic), F.lit(1), n))))
    return cut.join(broadcast_if_small(names), "prefix").drop("prefix")


def topic_cities(df: DataFrame, cities: Sequence[str], topic: str = "topic") -> DataFrame:
    """One output row per city whose lower-cased name starts the topic."""
    names = F.array(*[F.lit(c) for c in cities])
    hits = F.filter(names, lambda c: F.startswith(F.col(topic), F.lower(c)))
    return df.withColumn("city", F.explode_outer(hits)).where(F.col("city").isNotNull())
