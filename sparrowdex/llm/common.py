"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, in Java's and Python's notation for regular expressions.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where a session on one machine (master local) names none, as in tests, one of our own; elsewhere that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith(("local[", "local,")) and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sparrowdex-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def saved(df: DataFrame) -> DataFrame:
    """`df` computed once and kept in the shared folder: cuts lineage and survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return os.path.join(shared_dir(spark), f"{name}-{os.urandom(8).hex()}")


def remove_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder below the shared one, whatever its file system."""
    if not path.startswith(shared_dir(spark)):
        raise ValueError(f"{path} is not below the shared folder")
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def whole(docs: DataFrame):
    """The row as a struct: it comes through any step, whatever its columns are called."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")


def unwrapped(df: DataFrame, columns: list[str], **new):
    """The columns of rows made by whole(); those named in `new` have the new value."""
    return df.select(*[(new[c] if c in new else F.col(f"doc.`{c}`")).alias(c) for c in columns])


#: Bytes of rows that go to a Python worker at once, at most.
BATCH_BYTES = 2 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of the session by bytes: by rows alone, 10,000 long texts are one batch, which the JVM and the worker each hold more than once."""
    if int(spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()) > BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of the undirected graph with columns a, b (long): one row (node, root) per node that has an edge, root the smallest node.

    Alternates large-star and small-star steps. Each is a minimum by node (combined before the shuffle) and a join of the
    edges with those minima, which Spark can split where a node has very many edges; a node's neighbours are never gathered.
    The edges of each round are written to the shared folder. Rows with a null end and loops are no edges.
    """
    e = saved(edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.greatest("v", "m").alias("x"), "m", "u")
        small = small.select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("x").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        e = saved(small)
        now = e.agg(F.count("*"), F.sum(F.col("u") % 1000003), F.sum(F.col("v") % 1000003), F.sum(F.xxhash64("u", "v") % 1000003)).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
