"""SimHash near-duplicates by covering locality-sensitive hashing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, saved

SHINGLE, RADIUS, SEED = 3, 2, 42
#: Pairs are formed inside buckets of up to so many fingerprints; larger buckets go by shared one-bit neighbours, which is as exact.
SMALL_BUCKET = 32


def covering_masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """Masks such that any set of `radius` bit positions is left out by at least one mask.

    Position i gets a nonzero vector f(i) of radius+1 bits; the mask of each nonzero vector v keeps the positions with
    odd <f(i), v>. For `radius` positions some v is orthogonal to all their vectors, so two words that differ in no more than
    these positions agree under v's mask. There are 2^(radius+1) - 1 masks.
    """
    n = (1 << (radius + 1)) - 1
    return [sum(1 << i for i in range(bits) if bin((i % n + 1) & v).count("1") & 1) for v in range(1, n + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def simhash(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit fingerprint of one text (UTF-8); zero if it has no words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(g, SEED) for g in grams), dtype="<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 65536):  # memory stays bounded for very long texts
        ones += np.unpackbits(h[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """One row (id, fp) per row, and columns `more` (long); fp is the fingerprint as a signed long. Null texts count as empty."""

    def run(batches):
        for b in batches:
            texts = b.column(1).cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array((_signed(simhash(t)) for t in texts), pa.int64()), *b.columns[2:]], ["id", "fp", *more])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *more).mapInArrow(run, "id long, fp long" + "".join(f", {c} long" for c in more))


def near_pairs(fps: DataFrame, small_bucket: int = SMALL_BUCKET) -> DataFrame:
    """Edges (a, b) that connect all fingerprints within RADIUS = 2 bits. fps: node long, fp long, each fp once.

    Fingerprints that agree under a covering mask meet in a bucket. In buckets of up to `small_bucket` members pairs are compared;
    a larger bucket's members are linked through shared words at one bit's distance: two fingerprints are within two bits
    exactly if they have such a word (or each other) in common, and all that share one are within two bits of each other.
    So no bucket's pairs are ever enumerated beyond small_bucket², and none is left out.
    """
    masks = covering_masks(RADIUS)
    keys = F.array(*[F.struct(F.lit(k).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for k, m in enumerate(masks)])
    rows = fps.select("node", "fp", F.explode(keys).alias("k")).select("node", "fp", "k.t", "k.key")
    size = rows.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    met = saved(rows.join(size, ["t", "key"]))
    few = met.where(F.col("n") <= small_bucket)
    a, b = few.select("t", "key", F.col("node").alias("a"), F.col("fp").alias("fa")), few.select("t", "key", F.col("node").alias("b"), F.col("fp").alias("fb"))
    pairs = a.join(b.hint("shuffle_merge"), ["t", "key"]).where((F.col("a") < F.col("b")) & (F.bit_count(F.col("fa").bitwiseXOR(F.col("fb"))) <= RADIUS)).select("a", "b")
    many = met.where(F.col("n") > small_bucket).select("node", "fp").distinct()
    near = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(64)])
    turned = many.select("node", F.explode(near).alias("w"))
    low = turned.groupBy("w").agg(F.min("node").alias("b"), F.count("*").alias("n")).where("n > 1").select("w", "b")
    linked = turned.join(low, "w").where("node <> b").select(F.col("node").alias("a"), "b")
    return pairs.union(linked)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, fp, component_id) per row of docs; component_id is the smallest id reachable by links.

    Rows with equal fingerprints (equal texts among them) form one class before anything is compared. A row whose id is null takes
    part through its class; if no member of a class has an id, its component_id is null. Empty and null texts have fingerprint 0 and link
    like any other. An empty table gives an empty result.
    """
    fps = saved(fingerprints(docs, id_col, text_col))
    classes = fps.groupBy("fp").agg(F.min("id").alias("node")).where("node IS NOT NULL")
    roots = connected_components(near_pairs(classes))
    named = saved(classes.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id")))
    return fps.join(named, "fp", "left")


def heads(docs: DataFrame, key_col: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, key, n) per near-duplicate group: its smallest id (nulls last), of rows that share it the smallest key, and the number of rows with both.

    key_col: a long, the same for rows with one id only if they are equal. Groups are of fingerprints, so rows without an id are in them as well.
    """
    rows = fingerprints(docs, id_col, text_col, key_col).groupBy("fp", "id", F.col(key_col).alias("key")).agg(F.count("*").alias("n"))
    head = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key", "n")).alias("head")
    classes = saved(rows.groupBy("fp").agg(head))
    roots = connected_components(near_pairs(classes.select(F.col("fp").alias("node"), "fp")))
    named = classes.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left")
    return named.groupBy(F.coalesce("root", "fp").alias("component")).agg(F.min("head").alias("head")).select("head.id", "head.key", "head.n")


def op10_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    from .common import table

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
