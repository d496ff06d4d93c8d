"""Line dedup: later copies of runs of lines are deleted."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Hashes, Store, even_join, hot_keys, row_key, sequence_hashes, texts
from .winnow import RUN, recurring, runs


#: What parts the fingerprints of one rule from another's.
RULE = np.uint64(0xA0761D6478BD642F)


def spoken(lines: list[bytes], words: int) -> list[int]:
    """Places of the lines that hold at least so many words, and one at least."""
    if words <= 1:
        return [i for i, line in enumerate(lines) if line and not line.isspace()]
    # A line of n words has 2 n - 1 bytes at least.
    return [i for i, line in enumerate(lines) if len(line) >= 2 * words - 1 and len(line.split(None, words)) >= words]


def line_runs(docs: DataFrame, rules: list[tuple[int, int]]) -> DataFrame:
    """Per text and rule (run, words) the hashes of its lines, and the runs of their
    fingerprints; no row for a text with fewer lines than the rule's run."""
    schema = T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType()),
        T.StructField("rule", T.IntegerType()), T.StructField("hashes", T.ArrayType(T.LongType())), T.StructField("runs", T.ArrayType(RUN))])
    kind = pa.list_(pa.struct([("a", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("w", pa.int32())]))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Hashes(21)
        for batch in batches:
            at, numbers, hashes, found = [], [], [], []
            for place, text in enumerate(texts(batch.column(3))):
                lines = text.split(b"\n")
                for number, (run, words) in enumerate(rules):
                    x = known.of([lines[i] for i in spoken(lines, words)]) ^ (RULE * np.uint64(number))
                    if len(x) < run:
                        continue
                    columns = (c.tolist() for c in runs(x, run))
                    at.append(place)
                    numbers.append(number)
                    hashes.append(x.view(np.int64))
                    found.append([dict(zip(("a", "first", "last", "w"), r)) for r in zip(*columns)])
            keys = [c.take(pa.array(at, pa.int64())) for c in batch.columns[:3]]
            yield pa.RecordBatch.from_arrays(
                [*keys, pa.array(numbers, pa.int32()), pa.array(hashes, pa.list_(pa.int64())), pa.array(found, kind)], names=schema.names)

    keyed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), *row_key(), "text")
    return keyed.mapInArrow(work, schema)


def windows(candidates: DataFrame, rules: list[tuple[int, int]]) -> DataFrame:
    """All windows around the recurring fingerprints: two hashes, the text, the place."""
    schema = "w1 bigint, w2 bigint, doc_id bigint, k1 bigint, k2 bigint, rule int, place int"

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for doc, k1, k2, rule, hashes, hits in zip(*(c.to_pylist() for c in batch.columns)):
                x = np.array(hashes, np.int64).view(np.uint64)
                w1, w2 = (sequence_hashes(x, rules[rule][0], base).view(np.int64) for base in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))
                at = np.unique(np.concatenate([np.arange(h["first"], h["last"] + 1) for h in hits]))
                parts.append((w1[at], w2[at], doc, k1, k2, rule, at))
            size = [len(p[6]) for p in parts]
            columns = [pa.array(np.concatenate([p[i] for p in parts])) if parts else pa.array([], pa.int64()) for i in (0, 1)]
            columns += [pa.array([p[i] for p in parts for _ in range(len(p[6]))], k) for i, k in zip(
                (2, 3, 4, 5), (pa.int64(), pa.int64(), pa.int64(), pa.int32()))]
            columns.append(pa.array(np.concatenate([p[6] for p in parts]) if sum(size) else [], pa.int32()))
            yield pa.RecordBatch.from_arrays(columns, names=["w1", "w2", "doc_id", "k1", "k2", "rule", "place"])

    return candidates.select("doc_id", "k1", "k2", "rule", "hashes", "hits").mapInArrow(work, schema)


def later_places(docs: DataFrame, rules: list[tuple[int, int]], store: Store) -> DataFrame:
    """``k1, k2, places``: windows of each text that also start earlier, each as one number:
    the place times the number of rules, and the rule.

    The fingerprints' positions are joined; around each the match is extended to both sides
    by the hashes of the windows that hold it.
    """
    rows = store.put(line_runs(docs, rules))
    keys = ("k1", "k2", "rule")
    hits = recurring(rows, store, keys)
    found = store.put(windows(rows.drop("runs").join(hits, list(keys)), rules))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "k1", "k2", "place")
    first = store.put(found.groupBy("w1", "w2").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    met = even_join(found, first, ["w1", "w2"], hot_keys(first, ["w1", "w2"], "n"))
    out = store.put(met.where(order != F.col("first")).groupBy("k1", "k2").agg(
        F.collect_set(F.col("place") * len(rules) + F.col("rule")).alias("places")))
    store.drop(rows, found, first)
    return out


def deduplicated(docs: DataFrame, run: int = 3, words: int | None = None, counts: bool = True) -> DataFrame:
    """The documents with ``text`` cut, and with ``counts`` their ``n_lines`` and ``n_removed``.

    Lines are split at newlines and compared as they are; lines without a word are never
    deleted and do not interrupt a run.  A window of ``run`` lines is deleted where the same
    lines also start at an earlier place: earlier by doc_id (nulls last), then by place; for
    one doc_id and different texts by their hashes.  So every repeated run of ``run`` lines
    or more keeps its first occurrence alone.  With ``words``, the same holds for each single
    line of at least so many words.  All windows are judged on the input.

    Rows equal in id and text count as one document and lose the same lines.  Null texts
    stay null and have no lines.  Other columns are passed on untouched, whatever their names;
    with ``counts``, input columns of those two names give way.  An empty table stays empty.
    """
    store = Store(docs.sparkSession, "lines")
    rules = [(run, 1), *([(1, words)] if words else [])]
    places = later_places(docs.select("doc_id", "text"), rules, store)
    schema = T.StructType([
        T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())])

    def cut(text: pd.Series, starts: pd.Series) -> pd.DataFrame:
        out = []
        for value, found in zip(text, starts):
            if value is None:
                out.append((None, 0, 0))
                continue
            lines = value.split("\n")
            gone: set[int] = set()
            if found is not None and len(found):
                raw = value.encode().split(b"\n")
                for number, (size, least) in enumerate(rules):
                    here = found[found % len(rules) == number] // len(rules)
                    at = spoken(raw, least) if len(here) else []
                    gone.update(at[i] for start in here.tolist() for i in range(start, start + size))
            out.append(("\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else value, len(lines), len(gone)))
        return pd.DataFrame(out, columns=["text", "n_lines", "n_removed"])

    cut_udf = F.pandas_udf(cut, schema)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *row_key())
    # Places grow with the documents, so the join back is a shuffle at every size; frequent
    # texts are split by the skew join.
    joined = rows.join(places.hint("merge"), ["k1", "k2"], "left").select("_row", cut_udf(F.col("_row.text"), F.col("places")).alias("_cut"))
    made = ["n_lines", "n_removed"] if counts else []
    return joined.select(
        *[F.col("_cut.text").alias("text") if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c not in made],
        *[F.col(f"_cut.{c}").alias(c) for c in made])
