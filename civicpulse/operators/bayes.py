"""Naive Bayes over feature sets, trained and scored with joins and aggregates.

Only features that are present count.  With ``c`` documents of a label holding the
feature and ``n`` documents of the label in all, the smoothed probability is
``(c + 0.5) / (n + 0.5 * bins)``; ``bins`` is 2, or 1 for a feature of every document.

Log-probabilities are stored as whole nano-units: their sums are exact, so a score does
not depend on the order in which tasks deliver the rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import ceil, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions import patterns as P
from ..functions.text import adjacent_pairs, features_of, joined_tokens, tokenize
from ..session import run_dir, shared_dir
from . import featurelists
from .skew import broadcast_if_small, hot_keys, salted_join

NANO = 1_000_000_000
# A model up to this size is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 2_000_000
BROADCAST_BYTES = 64 * 1024 * 1024
# Features of a model that one partition of a shuffle holds in memory.
HASH_ROWS = 1_000_000
# Texts that are fewer in all look the model through.
FEW_BYTES = 2 * 1024 * 1024
# Texts that are more in all look a large model up by packed lists; its features in one part.
MANY_BYTES, PART_FEATURES = 64 * 1024 * 1024, 500_000
# Text whose features are looked up together, and parts of the features for each so much text.
BLOCK_BYTES, SPREAD = 16 * 1024 * 1024, 2


@dataclass(frozen=True)
class Model:
    """Label counts (a short list) and one row per feature.

    ``features`` has ``feature``, ``n`` and, in label order, ``counts`` and ``weights``
    (nano log-probabilities).  Row and byte counts are known for a saved model only.
    """

    labels: tuple[tuple[str, int], ...]
    features: DataFrame
    n_features: int | None = None
    feature_bytes: int | None = None

    @property
    def documents(self) -> int:
        return sum(n for _, n in self.labels)

    def prior_nano(self) -> list[int]:
        total = self.documents + 0.5 * len(self.labels)
        return [round(log((n + 0.5) / total) * NANO) for _, n in self.labels]

    def likelihood(self) -> DataFrame:
        """Long form: one row per label and feature, absent pairs with ``n = 0``."""
        cells = F.arrays_zip(
            F.array(*[F.lit(label) for label, _ in self.labels]).alias("label"), "counts", "weights")
        rows = self.features.select("feature", F.explode(cells).alias("c"))
        return rows.select(
            F.col("c.label").alias("label"), "feature", F.col("c.counts").alias("n"),
            F.col("c.weights").alias("logp_nano"), (F.col("c.weights") / NANO).alias("logp"))

    def prior(self) -> DataFrame:
        rows = [(label, n, w) for (label, n), w in zip(self.labels, self.prior_nano())]
        table = self.features.sparkSession.createDataFrame(
            rows, "label string, n bigint, logp_nano bigint")
        return table.withColumn("logp", F.col("logp_nano") / NANO)

    def is_small(self) -> bool:
        """Whether features and their weights, eight bytes a label, fit a broadcast."""
        return (self.n_features is not None and self.n_features <= BROADCAST_ROWS
                and self.feature_bytes + 8 * len(self.labels) * self.n_features <= BROADCAST_BYTES)


def nano(p: Column) -> Column:
    return F.round(F.log(p) * NANO).cast("bigint")


def relevant(df: DataFrame, label: str = "label") -> DataFrame:
    """Training rows that carry a sentiment."""
    return df.where(F.col(label) != P.IRRELEVANT)


def prior_table(df: DataFrame, label: str = "label") -> DataFrame:
    """Documents and smoothed log-probability per label, without touching the driver."""
    counts = relevant(df, label).groupBy(F.col(label).alias("label")).agg(
        F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n") + 0.5 * F.count(F.lit(1))).scalar()
    return counts.withColumn("logp_nano", nano((F.col("n") + 0.5) / total))


def explode_features(
    df: DataFrame, text: str, tokens: Callable[[Column], Column], *keep: str
) -> DataFrame:
    """One row per feature of each text; a text without features gives a null one."""
    # The outer form also keeps the optimizer from repeating the tokenizer in a filter.
    return df.select(*keep, F.explode_outer(features_of(tokens(F.col(text)))).alias("feature"))


def pair_counts(
    df: DataFrame, text: str = "text", tokens: Callable[[Column], Column] = tokenize
) -> DataFrame:
    """``first, second, n``: how often two tokens are neighbours."""
    pairs = df.select(F.explode_outer(adjacent_pairs(tokens(F.col(text)))).alias("pair"))
    return pairs.where(F.col("pair").isNotNull()).groupBy(
        F.col("pair.first").alias("first"), F.col("pair.second").alias("second")).agg(F.count(F.lit(1)).alias("n"))


def label_counts(df: DataFrame, label: str = "label") -> tuple[tuple[str, int], ...]:
    """The labels and their document counts, one row per label."""
    rows = relevant(df, label).groupBy(label).count().collect()
    return tuple(sorted((r[0], r[1]) for r in rows))


def train(
    df: DataFrame,
    label: str = "label",
    text: str = "text",
    tokens: Callable[[Column], Column] = tokenize,
) -> Model:
    """Count features per label in one aggregation, combined before its shuffle."""
    labels = label_counts(df, label)
    total = sum(n for _, n in labels)
    found = explode_features(relevant(df, label), text, tokens, label)
    counted = (
        found.where(F.col("feature").isNotNull())
        .groupBy("feature")
        .agg(F.count(F.lit(1)).alias("n"),
             F.array(*[F.count_if(F.col(label) == l) for l, _ in labels]).alias("counts")))
    bins = F.when(F.col("n") == total, 1).otherwise(2)
    weights = F.array(*[
        nano((F.col("counts")[i] + 0.5) / (n + 0.5 * bins)) for i, (_, n) in enumerate(labels)])
    return Model(labels, counted.withColumn("weights", weights))


def stored_features(model: Model) -> DataFrame:
    """The features of a model; those of one that is not saved are written, so that they are counted once."""
    if model.n_features is not None:
        return model.features
    folder = run_dir(model.features.sparkSession, "features")
    model.features.write.parquet(folder)
    return model.features.sparkSession.read.schema(model.features.schema).parquet(folder)


def looked_up(
    texts: DataFrame, features: DataFrame, weights: list[Column], key: str, text: str, tokens: Callable[[Column], Column],
) -> DataFrame:
    """``key`` and the weights ``w_<i>`` of each feature of its text, by shuffle.

    A partition's part of the model is held as a hash table while that stays small, so the far more
    rows of the texts need no sort.  The features of few texts, a small batch of a stream, are
    broadcast to the model instead, which is not shuffled for them.
    """
    spark, found = texts.sparkSession, explode_features(texts, text, tokens, key)
    if (texts.agg(F.sum(F.octet_length(text))).first()[0] or 0) <= FEW_BYTES:
        asked = features.join(F.broadcast(found.select("feature").distinct()), "feature", "left_semi")
        return found.join(asked.select("feature", *weights), "feature", "left")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    hint = "shuffle_hash" if features.count() <= HASH_ROWS * partitions else "merge"
    return salted_join(found, features.select("feature", *weights), "feature", hot_keys(features, "feature"), "left",
                       spread_by=[key], hint=hint)


def blocks_of(
    texts: DataFrame, key: str, text: str, tokens: Callable[[Column], Column], blocks: int,
) -> DataFrame:
    """Texts as packed tokens, dealt to blocks by their key."""
    return texts.select(
        F.pmod(F.xxhash64(key), F.lit(blocks)).alias("block"), key, joined_tokens(tokens(F.col(text))).alias("words")
    ).mapInArrow(featurelists.dealt(key), featurelists.DEALT).repartition(blocks, "block")


def asked_of(
    lists: DataFrame, dealt: DataFrame, parts: int, blocks: int, answer: Callable,
) -> DataFrame:
    """What each part of a model answers to each block of texts, back at the block."""
    wanted = dealt.groupBy("block").applyInArrow(featurelists.asked(parts), featurelists.ASKED)
    by_part = lambda rows: rows.repartition(parts, "feature_part").groupBy("feature_part")
    return by_part(lists).cogroup(by_part(wanted)).applyInArrow(answer, featurelists.ANSWERED).repartition(blocks, "block")


def summed(
    texts: DataFrame, model: Model, features: DataFrame, key: str, text: str, tokens: Callable[[Column], Column],
) -> DataFrame:
    """``key`` and the sums ``sum_<i>`` of its features' weights, for many texts and a large model.

    Blocks of texts ask the parts of the model by packed lists, as ``score_sparse`` does.
    """
    blocks, n = parts_for(texts, text), len(model.labels)
    parts = max(SPREAD * blocks, ceil(features.count() / PART_FEATURES))
    dealt = blocks_of(texts, key, text, tokens, blocks)
    lists = features.select("feature", "weights").mapInArrow(featurelists.listed(parts), featurelists.PACKED)
    weights = asked_of(lists, dealt, parts, blocks, featurelists.weighed(n))
    kinds = StructType([texts.schema[key], *(StructField(f"sum_{i}", LongType()) for i in range(n))])
    return dealt.groupBy("block").cogroup(weights.groupBy("block")).applyInArrow(featurelists.summed(key, parts, n), kinds)


def score(
    df: DataFrame,
    model: Model,
    key: str,
    text: str = "text",
    tokens: Callable[[Column], Column] = tokenize,
) -> DataFrame:
    """``key``, one ``score_<label>`` per label and the winning ``label``.

    ``key`` identifies a text.  Unknown features are ignored, a text without known
    features falls back to the prior, equal scores go to the greatest label.
    """
    texts, places = df.where(F.col(text).isNotNull()), range(len(model.labels))
    weights = [F.col("weights")[i].alias(f"w_{i}") for i in places]
    if not model.is_small() and (texts.agg(F.sum(F.octet_length(text))).first()[0] or 0) > MANY_BYTES:
        sums = summed(texts, model, stored_features(model), key, text, tokens)
    else:
        if model.is_small():
            found = explode_features(texts, text, tokens, key)
            hits = found.join(F.broadcast(model.features.select("feature", *weights)), "feature", "left")
        else:
            hits = looked_up(texts, stored_features(model), weights, key, text, tokens)
        sums = hits.groupBy(key).agg(*[F.sum(f"w_{i}").alias(f"sum_{i}") for i in places])
    scores = [
        ((F.coalesce(F.col(f"sum_{i}"), F.lit(0)) + w) / NANO).alias(f"score_{label}")
        for i, ((label, _), w) in enumerate(zip(model.labels, model.prior_nano()))]
    best = F.array_max(F.array(*[
        F.struct(s.alias("score"), F.lit(label).alias("label"))
        for s, (label, _) in zip(scores, model.labels)]))
    return sums.select(key, *scores, best["label"].alias("label"))


# ---- any number of labels ---------------------------------------------------------

@dataclass(frozen=True)
class SparseModel:
    """The same model by the pairs that occur, for any number of labels.

    ``labels`` has ``label, n, prior, absent``: ``absent`` is the weight of a known feature
    that never came with the label.  ``lists`` holds the features and their pairs, packed in
    ``parts`` lists (``featurelists``).  Neither labels nor features pass through the driver
    or the plan.
    """

    labels: DataFrame
    lists: DataFrame
    parts: int

    @property
    def pairs(self) -> DataFrame:
        """``feature, label, n, gain``: by how much a pair that occurs weighs more than ``absent``.
        A row with a null label stands for the feature itself."""
        return self.lists.mapInArrow(featurelists.pairs_in, "feature string, label string, n bigint, gain bigint")


def parts_for(df: DataFrame, text: str) -> int:
    """Into how many blocks a table of texts is dealt: at least as many as a shuffle has partitions."""
    size = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), ceil(size / BLOCK_BYTES))


def train_sparse(
    df: DataFrame, label: str = "label", text: str = "text", tokens: Callable[[Column], Column] = tokenize,
) -> SparseModel:
    """Count the pairs that occur.  A task counts the pairs of some megabytes of text and packs
    them by parts of the features; the lists of a part meet in one group.  What moves is sorted
    names and small numbers, compressed, in one row for each task and part."""
    shared_dir(df.sparkSession)
    kept = relevant(df, label)
    counts = kept.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n")).checkpoint()
    documents = counts.agg(F.sum("n")).first()[0] or 0
    kinds = counts.agg(F.count(F.lit(1))).scalar()
    labels = counts.select(
        "label", "n", nano((F.col("n") + 0.5) / (documents + 0.5 * kinds)).alias("prior"),
        nano(F.lit(0.5) / (F.col("n") + 1.0)).alias("absent"))
    parts = SPREAD * parts_for(kept, text)
    texts = kept.select(F.col(label).alias("label"), joined_tokens(tokens(F.col(text))).alias("words"))
    rows = with_label(texts, labels.withColumnRenamed("n", "docs"), labels.select("label", "n"))
    found = rows.select("label", "docs", "prior", "absent", "words").mapInArrow(
        featurelists.counted(parts), featurelists.PACKED)
    folder = run_dir(df.sparkSession, "pairs")
    (found.repartition(parts, "feature_part").groupBy("feature_part")
     .applyInArrow(featurelists.merged(documents), featurelists.PACKED).write.parquet(folder))
    return SparseModel(labels, df.sparkSession.read.schema(featurelists.PACKED).parquet(folder), parts)


def with_label(rows: DataFrame, labels: DataFrame, counts: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of their label."""
    small = broadcast_if_small(labels)
    if small is not labels:
        return rows.join(small, "label", how)
    return salted_join(rows, labels, "label", hot_keys(counts, "label"), how)


def score_sparse(
    df: DataFrame, model: SparseModel, key: str, text: str = "text", tokens: Callable[[Column], Column] = tokenize,
) -> DataFrame:
    """``key``, the winning ``label`` and its ``score``, as ``score`` has them.

    A text starts with the default of every label, its prior and an absent weight for each
    known feature; pairs that occur add their gain, which is positive.  So the winner is the
    best of the labels with a gain, or the best default of all.  The best default is that of the
    most frequent labels for texts of no known feature, of the rarest for two or more.

    Texts are dealt to blocks of some megabytes, as their tokens.  A block asks each part of the
    model once for the features it has there, in one packed list, and what their labels gain
    comes back to the block in another, where the sums are made: neither the features of single
    texts nor their labels are shuffled.
    """
    asked = df.where(F.col(text).isNotNull())
    blocks = parts_for(asked, text)
    dealt = blocks_of(asked, key, text, tokens, blocks)
    weights = asked_of(model.lists, dealt, model.parts, blocks, featurelists.answered)
    kinds = StructType([df.schema[key], *StructType.fromDDL("known bigint, score bigint, label string").fields])
    here = dealt.groupBy("block").cogroup(weights.groupBy("block")).applyInArrow(featurelists.scored(key, model.parts), kinds)
    best = here.select(key, "known", F.when(F.col("label").isNotNull(), F.struct("score", "label")).alias("best"))
    defaults = model.labels.agg(
        F.max(F.struct("prior", "label")).alias("none"),
        F.max(F.struct((F.col("prior") + F.col("absent")).alias("score"), "label")).alias("one"),
        F.max(F.struct((-F.col("n")).alias("n"), "label", "prior", "absent")).alias("more"))
    default = lambda name, part: defaults.select(F.col(f"{name}.{part}")).scalar()
    usual = F.struct(
        F.when(F.col("known") == 0, default("none", "prior")).when(F.col("known") == 1, default("one", "score"))
        .otherwise(default("more", "prior") + F.col("known") * default("more", "absent")).alias("score"),
        F.when(F.col("known") == 0, default("none", "label")).when(F.col("known") == 1, default("one", "label"))
        .otherwise(default("more", "label")).alias("label"))
    won = best.select(key, F.greatest("best", usual).alias("best"))
    return won.select(key, F.col("best.label").alias("label"), (F.col("best.score") / NANO).alias("score"))


def classify(
    df: DataFrame,
    model: Model | SparseModel | None,
    key: str | None = None,
    text: str = "text",
    tokens: Callable[[Column], Column] = tokenize,
) -> DataFrame:
    """Add ``sentiment``.  Without a model it is null.

    With a unique ``key`` column the scores join back on it.  Without one the texts
    themselves are the key: copies are scored once, and frequent copies are salted in
    the join back.
    """
    scored = score_sparse if isinstance(model, SparseModel) else score
    if model is None:
        return df.withColumn("sentiment", F.lit(None).cast("string"))
    if key is not None:
        labels = scored(df, model, key, text, tokens)
        return df.join(labels.select(key, F.col("label").alias("sentiment")), key, "left")
    keyed = df.withColumn("text_key", F.unhex(F.sha2(text, 256)))
    # The second filter is always true.  It keeps text and count in both uses of the
    # distinct texts, so that they share one shuffle.
    distinct = (
        keyed.where(F.col("text_key").isNotNull())
        .groupBy("text_key").agg(F.any_value(text).alias(text), F.count(F.lit(1)).alias("n"))
        .where((F.col("n") > 0) & (F.length(text) >= 0)))
    labels = scored(distinct, model, "text_key", text, tokens)
    hot = hot_keys(distinct, "text_key")
    return salted_join(
        keyed, labels.select("text_key", F.col("label").alias("sentiment")),
        "text_key", hot, "left").drop("text_key")


def informative_features(model: Model, limit: int = 100) -> DataFrame:
    """Features whose probability differs most between labels.

    A feature has to occur with at least two labels; ties go to the smaller feature.
    """
    seen = F.filter(F.arrays_zip("counts", "weights"), lambda c: c["counts"] > 0)
    spread = F.transform(seen, lambda c: c["weights"])
    return (
        model.features.where(F.size(seen) >= 2)
        .select("feature", (F.array_max(spread) - F.array_min(spread)).alias("log_ratio_nano"))
        .orderBy(F.desc("log_ratio_nano"), "feature").limit(limit)
        .withColumn("ratio", F.exp(F.col("log_ratio_nano") / NANO)))
