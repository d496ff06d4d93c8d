"""Mixing sources to target weights by balanced sampling with the cube method."""

from __future__ import annotations

import random
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, Store, even_join, hot_keys

#: Rows of one flight; larger sources fly in several blocks, whose remainders fly again.
BLOCK_ROWS = 2000


def word_counts(docs: DataFrame, text_column: str = "text") -> DataFrame:
    return docs.withColumn("size", F.coalesce(F.regexp_count(text_column, F.lit(WORD)), F.lit(0)).cast("bigint"))


def ranked(df: DataFrame, column: str) -> DataFrame:
    """``rank`` from 0 in the order of ``column``, nulls last, without gathering the rows.

    Rows are ranged over tasks; each adds the rows of the tasks before (one number per task).
    """
    ranged = df.repartitionByRange(F.col(column).asc_nulls_last()).sortWithinPartitions(
        F.col(column).asc_nulls_last()).withColumn("part", F.spark_partition_id()).withColumn(
        "at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = {r["part"]: r["count"] for r in ranged.groupBy("part").count().collect()}
    before, total = {}, 0
    for part in sorted(sizes):
        before[part], total = total, total + sizes[part]
    starts = F.create_map(*[F.lit(x).cast("bigint") for pair in before.items() for x in pair]) if before else F.lit(None)
    base = starts[F.col("part").cast("bigint")] if before else F.lit(0)
    return ranged.withColumn("rank", F.col("at") + base).drop("part", "at")


def targets(docs: DataFrame, weights: Sequence[float], share: float, most: float, store: Store) -> DataFrame:
    """``source, source_size, target``: ``share`` of all sizes, dealt out by weight.

    Sources in code point order, null last, take the weights in turn.  A target stops at
    ``most`` times its source's size; what is too much goes to the others by weight until no
    target is above.
    """
    sizes = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    # Names are unique but null, so the order is total.
    order = store.put(ranked(store.put(sizes), "source"))
    turn = F.array(*[F.lit(float(w)) for w in weights])
    table = order.withColumn("weight", turn[(F.col("rank") % len(weights)).cast("int")])
    limit = F.col("source_size") * float(most)
    total = float(table.agg(F.sum("source_size")).first()[0] or 0) * share
    level, stopped = None, -1
    while True:
        full = F.lit(False) if level is None else F.col("weight") * level > limit
        row = table.agg(F.sum(F.when(full, limit)), F.sum(F.when(~full, F.col("weight"))),
                        F.sum(full.cast("long"))).first()
        if row[2] == stopped or not row[1]:
            break
        stopped, level = row[2], (total - (row[0] or 0.0)) / row[1]
    return table.select("source", "source_size", F.least(limit, F.col("weight") * (level or 0.0)).alias("target"))


def flight(sizes: list[int], chances: list[float], draw: random.Random) -> list[float]:
    """Move chances within the null space of the totals of documents and of sizes until at
    most two are neither 0 nor 1.

    Three documents at a time: moving their chances along ``u`` keeps the sum of chances and
    the sum of size times chance.  The step is drawn so that each chance keeps its mean.
    """
    out, open_ = list(chances), []
    for i, chance in enumerate(chances):
        if not 1e-9 < chance < 1 - 1e-9:
            out[i] = float(round(chance))
            continue
        open_.append(i)
        while True:
            equal = len(open_) >= 2 and sizes[open_[-1]] == sizes[open_[-2]]
            if equal:
                used, u = open_[-2:], (1.0, -1.0)
            elif len(open_) >= 3:
                used = open_[-3:]
                a, b, c = (sizes[k] for k in used)
                u = (float(b - c), float(c - a), float(a - b))
            else:
                break
            up = min((1 - out[k]) / x if x > 0 else -out[k] / x for k, x in zip(used, u) if x)
            down = min(out[k] / x if x > 0 else (out[k] - 1) / x for k, x in zip(used, u) if x)
            step = up if draw.random() * (up + down) < down else -down
            for k, x in zip(used, u):
                out[k] += step * x
                if not 1e-9 < out[k] < 1 - 1e-9:
                    out[k] = float(round(out[k]))
            open_ = [k for k in open_ if 0.0 < out[k] < 1.0]
    return out


def landing(sizes: list[int], chances: list[float]) -> list[int]:
    """The nearest whole choice: of all roundings of the few open chances, the one that
    misses the total size least, then the total of documents."""
    open_ = [i for i, c in enumerate(chances) if 0.0 < c < 1.0]
    out = [int(c) for c in chances]
    want, docs = sum(sizes[i] * chances[i] for i in open_), sum(chances[i] for i in open_)

    def miss(choice: int) -> tuple[float, float, int]:
        some = [i for k, i in enumerate(open_) if choice >> k & 1]
        return abs(want - sum(sizes[i] for i in some)), abs(docs - len(some)), choice

    choice = min(range(1 << len(open_)), key=miss)
    for k, i in enumerate(open_):
        out[i] = choice >> k & 1
    return out


def flown(rows: DataFrame, last: bool) -> DataFrame:
    """One flight for each (source, block); with ``last`` it lands."""
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("mark", "ascending"), ("size", "ascending")])
        draw = random.Random(group["mark"][0].as_py() if group.num_rows else 0)
        sizes = group["size"].to_pylist()
        chances = flight(sizes, group["chance"].to_pylist(), draw)
        if last:
            chances = [float(x) for x in landing(sizes, chances)]
        return group.set_column(group.column_names.index("chance"), "chance", pa.array(chances, pa.float64()))
    return rows.groupBy("source", "block").applyInArrow(run, rows.schema)


def mixed(
    docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0,
    id_column: str = "doc_id", text_column: str = "text", source_column: str = "source",
) -> DataFrame:
    """``doc_id, content, source, size, source_size, target, copies, taken`` for each document;
    ``content`` is a hash of its text.

    ``copies`` says how often the mix takes the document (its chance is target / source
    size, at most ``most``, so copies never exceed ``most`` rounded up); ``taken = copies *
    size``.  Each source's taken words and its number of taken documents come out at their
    targets but for the landing of two documents.  Draws depend on ids and sizes alone, so
    reruns agree.

    Null texts and texts without words have size 0: they are taken once or twice like any
    other and count nothing.  Null sources form one source, the last; null ids are allowed;
    equal rows are equal documents that are drawn apart.  No sizes at all give targets of 0.
    """
    store = Store(docs.sparkSession, "cube")
    rows = store.put(word_counts(docs.select(
        F.col(id_column).cast("bigint").alias("id"), F.col(text_column).alias("text"),
        F.col(source_column).alias("source"))).withColumn("content", F.xxhash64("text")).drop("text"))
    goal = store.put(targets(rows, weights, share, most, store))
    counts = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    named = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("name")
    hot = hot_keys(counts.select(named, "n"), ["name"], "n")
    sized = counts.select(named, F.ceil(F.col("n") / BLOCK_ROWS).alias("blocks"))
    goals = goal.select(named, "source_size", "target").join(sized, "name")
    # Equal rows are counted and then numbered, some thousand at a time.
    equal = rows.groupBy("id", "source", "size", "content").agg(F.count(F.lit(1)).alias("n"))
    each = equal.withColumn("from", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(1000)))).withColumn(
        "copy", F.explode(F.sequence("from", F.least(F.col("from") + 999, F.col("n") - 1)))).drop("n", "from")
    placed = even_join(each.select("*", named), goals, ["name"], hot, "left").drop("name")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    fine = placed.withColumn("mark", F.xxhash64("id", "size", "content", "copy")).drop("copy").withColumn(
        "whole", F.floor(ratio).cast("double")).withColumn("chance", ratio - F.col("whole")).withColumn(
        "block", F.pmod("mark", "blocks"))
    now = store.put(flown(fine, False))
    done, open_ = [now.where("chance = 0 OR chance = 1")], now.where("chance > 0 AND chance < 1")
    blocks = now.agg(F.max("blocks")).first()[0] or 1
    while blocks > 1:
        # Two documents are left of a block at most; those of some hundred blocks fly together.
        blocks = -(-blocks // (BLOCK_ROWS // 4))
        now = store.put(flown(open_.withColumn("block", F.floor(F.col("block") / (BLOCK_ROWS // 4))), False))
        done.append(now.where("chance = 0 OR chance = 1"))
        open_ = now.where("chance > 0 AND chance < 1")
    done.append(flown(open_.withColumn("block", F.lit(0).cast("bigint")), True))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    count = (F.col("whole") + F.col("chance")).cast("bigint")
    return out.select(
        F.col("id").alias("doc_id"), "content", "source", "size", "source_size", "target", count.alias("copies"),
        (count * F.col("size")).alias("taken"))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as ``mixed`` takes it.

    Equal documents (id, text and source) are drawn apart and come out as often as all of
    them were taken.
    """
    keys = [F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("a"),
            F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("b")]
    taken = mixed(docs, **options).where("copies > 0").groupBy(*keys, F.col("content").alias("c")).agg(
        F.sum("copies").alias("copies"))
    marked = docs.select(F.struct(*docs.columns).alias("row"), *keys, F.xxhash64("text").alias("c"))
    first = marked.groupBy("a", "b", "c").agg(F.first("row").alias("row"))
    return first.join(taken, ["a", "b", "c"]).select(
        "row.*", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy")).drop("_copy")
