"""Labelled rows for the classifiers: which may be learned from, a bounded sample of them, and scoring of texts."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from .common import discard, materialize, quoted, text_or_empty
from .tokens import slices

#: Bytes of features that the driver takes to fit a classifier.
FIT_BYTES = 64 << 20
#: Bytes of them that the driver's JVM holds at once on their way.
AT_ONCE = 4 << 20


def fold(key: str | Column, folds: int) -> Column:
    """crc32 of the key as text, modulo folds; a null key counts as the empty text."""
    return F.crc32(F.coalesce((F.col(key) if isinstance(key, str) else key).cast("string"), F.lit("")).cast("binary")) % folds


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, rows: int, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """order, text, label of the labelled documents with the least hashes of their keys, of `rows` keys.

    `usable` is a condition on column `key` of labels. The keys are at most `rows`, so they are broadcast.
    """
    chosen = (
        labels.where(usable & F.col(quoted(key)).isNotNull() & F.col(quoted(label)).isin(0, 1))
        .groupBy(F.col(quoted(key)).alias("_key"))
        .agg(F.max(quoted(label)).cast("int").alias("label"))
        .orderBy(F.xxhash64("_key"), "_key")
        .limit(rows)
    )
    texts = docs.select(F.col(quoted(key)).alias("_key"), text_or_empty(quoted(text)).alias("text"))
    return texts.join(F.broadcast(chosen), "_key").select(F.xxhash64("_key", "text").alias("order"), "text", "label")


def unlabelled_sample(docs: DataFrame, labels: DataFrame, usable: Column, rows: int, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """order, text, label (-1) of documents without a label: those of the `rows` usable keys with the least hashes that have none."""
    keys = docs.where(usable & F.col(quoted(key)).isNotNull()).select(F.col(quoted(key)).alias("_key")).orderBy(F.xxhash64("_key"), "_key").limit(rows).distinct()
    chosen = keys.join(labels.select(F.col(quoted(key)).alias("_key")), "_key", "left_anti")
    texts = docs.select(F.col(quoted(key)).alias("_key"), text_or_empty(quoted(text)).alias("text"))
    return texts.join(F.broadcast(chosen), "_key").select(F.xxhash64("_key", "text").alias("order"), "text", F.lit(-1).alias("label"))


def sample_features(
    sample: DataFrame, features: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], columns: str, rows: int, max_bytes: int = FIT_BYTES
) -> list[Row]:
    """The features of the sample, made in one parallel job: the rows of least order, at most `rows` and `max_bytes` of them, which come to the driver in parts.

    features: gives the columns `order`, `label` and `data`, whose bytes count, and any others. Rows of equal order are equal, so any will do.
    """
    made = materialize(sample.mapInArrow(features, columns), "features")
    held = n = 0
    parts: list[list[int]] = []  # the last order, the number of rows and the bytes of each part
    for r in made.select("order", F.length("data").alias("size")).orderBy("order").limit(rows).collect():
        if n and held + r["size"] > max_bytes:
            break
        if not parts or parts[-1][2] + r["size"] > AT_ONCE and r["order"] > parts[-1][0]:
            parts.append([r["order"], 0, 0])
        parts[-1] = [r["order"], parts[-1][1] + 1, parts[-1][2] + r["size"]]
        held += r["size"]
        n += 1
    found: list[Row] = []
    for before, (end, count, _) in zip([None, *parts], parts, strict=False):
        part = made.where(F.col("order") <= end) if before is None else made.where((F.col("order") > before[0]) & (F.col("order") <= end))
        found += [Row(**r) for r in part.orderBy("order").limit(count).toArrow().to_pylist()]
    discard(made)
    return found


def score_texts(docs: DataFrame, scorer: Callable[[], Callable[[str], float]], *, text: str = "text") -> DataFrame:
    """docs, packed as struct `doc`, with score. Only the texts go to Python; a scorer is made once a task."""

    @F.arrow_udf("double")
    def score(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        one = scorer()
        for column in columns:
            batch = pa.RecordBatch.from_arrays([column], names=["text"])
            yield pa.array([one(t) for _, texts in slices([batch]) for t in texts], pa.float64())

    return docs.select(F.struct(*map(quoted, docs.columns)).alias("doc"), score.asNondeterministic()(text_or_empty(quoted(text))).alias("score"))
