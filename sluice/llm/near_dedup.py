"""Near-duplicate classes by ProbMinHash, banding and exact verification.

Two texts are linked when the exact probability Jaccard similarity of their five-word shingles, weighted by how often they
occur, is at least 0.8; classes are the connected components of the links.

1. One pass computes the band keys of every text (`prob_minhash`). Equal texts are one node from here on.
2. Stars. Band buckets with one node go. Each node picks its largest bucket, and the nodes that picked the same one are verified
   against its centre, the one whose buckets are largest over all bands: in a group of edited copies, the one with the fewest edits. That is
   one pair a node. Linked nodes become classes.
3. Mixed buckets. Counts by bucket and class find the buckets that still hold several classes; all others are done. In a mixed
   bucket the nodes outside its largest class meet all others of another class, each pair in its first common band, in blocks
   bounded in nodes and bytes. A block compares signatures, then verifies exactly what they leave, the likeliest first, and
   skips pairs whose classes it has linked already: it returns links that join classes, never all pairs.

No bucket is capped and no pair that shares a band is left out. With 32 bands of 8 registers a pair at similarity 0.8 shares a band
with probability 0.997, one at 0.9 with 1 - 2e-8.

Defined cases: a null text counts as empty; texts without words are classed with equal texts only; texts of fewer than five
words are one shingle; repeated rows are in one class; null keys are classed but name a class only if it has no other key; an
empty table gives an empty result; other columns may have any name and type.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, join_to_groups, materialize, quoted, text_or_empty
from .components import connected_components
from .prob_minhash import Shingler, bands, signatures, similarity
from .tokens import slices

BANDS, ROWS = 32, 8
REGISTERS = BANDS * ROWS
THRESHOLD = 0.8
#: Pairs whose signatures agree less than three standard deviations below the threshold are not verified.
ESTIMATE = THRESHOLD - 3 * (THRESHOLD * (1 - THRESHOLD) / REGISTERS) ** 0.5
#: Nodes, and shingles, on either side of a block of pairs.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 20


def text_id(text: str) -> Column:
    """128 bits of the text's SHA-256."""
    return F.substring(F.unhex(F.sha2(text_or_empty(text).cast("binary"), 256)), 1, 16)


def _band_keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingler = Shingler()
    for rows, texts in slices(batches):
        shingles = [shingler(t) for t in texts]
        keys = bands(signatures(shingles, REGISTERS), ROWS).view(np.int64)
        keys = [k if len(s) else None for k, (s, _) in zip(keys, shingles, strict=True)]
        sizes = pa.array([len(s) for s, _ in shingles], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [rows.column("key"), rows.column("node"), sizes, pa.array(keys, pa.list_(pa.int64()))], names=["key", "node", "shingles", "bands"]
        )


def _profiles(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What comparisons need of a text. Registers are cut to 16 bits, which raises an estimate by chance once in 65,536."""
    shingler = Shingler()
    for rows, texts in slices(batches):
        shingles = [shingler(t) for t in texts]
        whole = signatures(shingles, REGISTERS)
        keys = bands(whole, ROWS).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                rows.column("node"),
                pa.array([s.tobytes() for s, _ in shingles], pa.binary()),
                pa.array([b"" if c.max(initial=1) == 1 else c.astype("<u4").tobytes() for _, c in shingles], pa.binary()),
                pa.array([s.astype("<u2").tobytes() for s in whole], pa.binary()),
                pa.array([k.tobytes() for k in keys], pa.binary()),
            ],
            names=["node", "shingles", "counts", "signature", "bands"],
        )


def _weights(shingles: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The shingle hashes of a profile and how often each occurs; empty counts mean once each."""
    hashes = np.frombuffer(shingles, np.uint64)
    return hashes, np.frombuffer(counts, "<u4").astype(np.int64) if counts else np.ones(len(hashes), np.int64)


def _star_links(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sides = [zip(b.column(f"shingles_{x}").to_pylist(), b.column(f"counts_{x}").to_pylist(), strict=True) for x in "ab"]
        keep = pa.array([similarity(_weights(*p), _weights(*q)) >= THRESHOLD for p, q in zip(*sides, strict=True)], pa.bool_())
        yield pa.RecordBatch.from_arrays([b.column(x).filter(keep) for x in "ab"], names=["a", "b"])


def _verify(pairs: DataFrame, profiles: DataFrame) -> DataFrame:
    """The pairs (a, b) that are linked."""
    for x in "ab":
        side = profiles.select(F.col("node").alias(x), F.col("shingles").alias(f"shingles_{x}"), F.col("counts").alias(f"counts_{x}"))
        pairs = join_to_groups(pairs, side, x)
    columns = pairs.select("a", "b", "shingles_a", "counts_a", "shingles_b", "counts_b")
    return materialize(columns.mapInArrow(_star_links, "a binary, b binary"), "links")


class _Classes:
    """Which classes a block has joined so far."""

    def __init__(self):
        self.root: dict[bytes, bytes] = {}

    def find(self, c: bytes) -> bytes:
        while (up := self.root.get(c, c)) != c:
            self.root[c] = c = self.root.get(up, up)
        return c

    def join(self, a: bytes, b: bytes) -> None:
        self.root[self.find(a)] = self.find(b)


def _block_links(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Links of one block that join classes. left: nodes outside the bucket's largest class; right: any of its nodes."""
    found: dict[str, list] = {"a": [], "b": []}
    if len(left) and len(right):
        near = _likely_pairs(left, right)
        joined = _Classes()
        sides = [d[["node", "class", "shingles", "counts"]].to_numpy() for d in (left, right)]
        for i, j in near:
            (a, class_a, *profile_a), (b, class_b, *profile_b) = sides[0][i], sides[1][j]
            if joined.find(class_a) != joined.find(class_b) and similarity(_weights(*profile_a), _weights(*profile_b)) >= THRESHOLD:
                joined.join(class_a, class_b)
                found["a"].append(a)
                found["b"].append(b)
    return pd.DataFrame(found)


def _likely_pairs(left: pd.DataFrame, right: pd.DataFrame) -> list[tuple[int, int]]:
    """Places of pairs of two classes with enough agreement whose first common band is this bucket's; the likeliest first."""
    sig, keys = (
        [np.frombuffer(b"".join(d[c]), t).reshape(len(d), -1) for d in (left, right)] for c, t in (("signature", "<u2"), ("bands", np.int64))
    )
    names = {c: n for n, c in enumerate({*left["class"], *right["class"]})}
    own, others = (d["class"].map(names).to_numpy() for d in (left, right))
    outside, node = right["outside"].to_numpy(), right["node"].to_numpy()
    least = REGISTERS * ESTIMATE
    pairs = []
    for i, (band, name) in enumerate(zip(left["band"], left["node"], strict=True)):
        agree = (sig[1] == sig[0][i]).sum(axis=1)
        at = np.flatnonzero((agree >= least) & (others != own[i]))
        first = (keys[1][at] == keys[0][i]).argmax(axis=1) == band
        # a pair of two outsiders comes up from both sides
        pairs += [(-int(agree[j]), i, int(j)) for j in at[first] if not (outside[j] and node[j] < name)]
    return [(i, j) for _, i, j in sorted(pairs)]


def _members(keyed: DataFrame) -> DataFrame:
    """node, shingles, band, bucket, size: the buckets of two nodes or more."""
    nodes = keyed.groupBy("node").agg(F.any_value("bands").alias("bands"), F.any_value("shingles").alias("shingles")).where("bands is not null")
    exploded = nodes.select("node", "shingles", F.posexplode("bands").alias("band", "bucket"))
    sizes = exploded.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    return materialize(join_to_groups(exploded, sizes, "bucket"), "buckets")


def _stars(members: DataFrame) -> DataFrame:
    """One pair (a, b) for each node: itself and the centre of its largest bucket."""
    picked = members.groupBy("node").agg(F.sum("size").alias("weight"), F.max(F.struct("size", "bucket")).alias("best"))
    picked = picked.select("node", "weight", F.col("best.bucket").alias("bucket"))
    centers = picked.groupBy("bucket").agg(F.max_by("node", F.struct("weight", "node")).alias("center"))
    return join_to_groups(picked, centers, "bucket").where("node != center").select(F.col("node").alias("a"), F.col("center").alias("b"))


def _node_profiles(base: DataFrame, keyed: DataFrame, members: DataFrame) -> DataFrame:
    """The profiles of the nodes in members. Texts move once, by key and node, so that no group of equal texts lands in one task."""
    one = keyed.groupBy("node").agg(F.min(F.struct("key")).alias("one"))
    chosen = one.join(members.select("node").distinct(), "node", "left_semi").select(F.struct("one.key", "node").alias("_id"))
    some = base.withColumn("_id", F.struct("key", "node")).join(chosen, "_id", "left_semi").dropDuplicates(["_id"])
    return materialize(some.select("node", "text").mapInArrow(_profiles, "node binary, shingles binary, counts binary, signature binary, bands binary"), "profiles")


def _across_classes(members: DataFrame, profiles: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) of nodes that share a bucket but, so far, no class."""
    named = materialize(members.join(classes, "node", "left").withColumn("class", F.coalesce("class", "node")).drop("size"), "named")
    by_class = named.groupBy("bucket", "class").agg(F.count(F.lit(1)).alias("n"), F.sum("shingles").alias("n_shingles"))
    main = F.max(F.struct("n", "class", "n_shingles")).alias("main")
    mixed = by_class.groupBy("bucket").agg(main, F.sum("n").alias("n"), F.sum("n_shingles").alias("n_shingles")).where("main.n < n")

    def parts(n: Column, shingles: Column) -> Column:
        return F.greatest(F.ceil(n / BLOCK), F.ceil(shingles / BLOCK_SHINGLES)).cast("int")

    state = mixed.select(
        "bucket",
        F.col("main.class").alias("main"),
        parts(F.col("n"), F.col("n_shingles")).alias("n_all"),
        parts(F.col("n") - F.col("main.n"), F.col("n_shingles") - F.col("main.n_shingles")).alias("n_out"),
    )
    rows = join_to_groups(named, state, "bucket").withColumn("outside", F.col("class") != F.col("main")).drop("shingles")
    rows = rows.join(profiles, "node")
    own = {n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int") for n in ("n_out", "n_all")}
    each = {n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)) for n in ("n_out", "n_all")}
    columns = ["bucket", "node", "class", "band", "outside", "shingles", "counts", "signature", "bands"]
    left = rows.where("outside").select(*columns, own["n_out"].alias("i"), each["n_all"].alias("j"))
    right = rows.select(*columns, own["n_all"].alias("j"), each["n_out"].alias("i"))
    key = ["bucket", "i", "j"]
    links = left.toDF(*left.columns).groupBy(*key).cogroup(right.toDF(*right.columns).groupBy(*key)).applyInPandas(_block_links, "a binary, b binary")
    links = materialize(links, "links")
    discard(named)
    return links


def near_classes(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, class_id (the least key of the class), class_size, representative (whether this row is the one to keep), text_id."""
    base = docs.select(F.col(key).cast("bigint").alias("key"), text_or_empty(text).alias("text"), text_id(text).alias("node"))
    keyed = base.mapInArrow(_band_keys, "key long, node binary, shingles long, bands array<long>")
    keyed = materialize(keyed.withColumn("row", F.monotonically_increasing_id()), "bands")
    members = _members(keyed)
    profiles = _node_profiles(base, keyed, members)
    links = _verify(_stars(members), profiles)
    classes = connected_components(links, "a", "b")
    more = _across_classes(members, profiles, classes)
    if not more.isEmpty():
        first, classes = classes, connected_components(classes.toDF("a", "b").unionByName(more), "a", "b")
        discard(first)
    discard(members, profiles, links, more)
    named = keyed.select("key", "node", "row").join(classes, "node", "left").withColumn("class", F.coalesce("class", "node"))
    first = F.min(F.struct(F.col("key").isNull(), "key", "row")).alias("first")
    groups = named.groupBy("class").agg(F.min("key").alias("class_id"), F.count(F.lit(1)).alias("class_size"), first)
    out = join_to_groups(named, groups, "class")
    return out.select(
        F.col("key").alias(key), "class_id", "class_size", (F.col("row") == F.col("first.row")).alias("representative"), F.col("node").alias("text_id")
    )


def near_dedup(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without all but the representative of each class.

    Rows are found again by key and text digest, so of rows that repeat both one stays; null and empty texts count as equal.
    Texts move once.
    """
    kept = near_classes(docs, key=key, text=text).where("representative").select(F.struct(F.col(key).alias("key"), F.col("text_id").alias("node")).alias("id"))
    rows = docs.select(F.struct(F.col(key).cast("bigint").alias("key"), text_id(text).alias("node")).alias("id"), F.struct(*map(quoted, docs.columns)).alias("doc"))
    return rows.join(kept, "id", "left_semi").dropDuplicates(["id"]).select("doc.*")
