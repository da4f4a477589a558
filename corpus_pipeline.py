"""The corpus pipeline: documents through quality classifier, near-dedup, secret scan, source mix and SentencePiece, stage by stage.

Each stage gets what its predecessor kept, written as Parquet and read again. All but the last return the columns of documents, and any others that
the table has, whatever their names. In every stage an empty table gives an empty one, repeated rows count as rows of their own (but
near_dedup keeps one of them), and rows without a doc_id, text, source or language go through like others. Stages that run Python bound the
session's Arrow batches by bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrowdex.llm import mixing, pieces, quality_model, secrets, simhash
from sparrowdex.llm.common import new_folder, remove_folder, saved, small_batches, table, unwrapped, whole


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier rejects. Null texts and texts without words are kept."""
    small_batches(spark)
    rows = docs.select(whole(docs), F.col("doc_id"), F.col("text"))
    return unwrapped(quality_model.classified(rows).where("quality_kept"), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each near-duplicate group, that of the smallest doc_id; rows without a doc_id are in groups too, after those with one.

    Rows are joined by doc_id (null as well) and a hash of all columns; of equal rows one is kept. Texts without words are near-duplicates of each other.
    """
    small_batches(spark)
    nulls = F.array(*[F.col(f"`{c}`").isNull() for c in docs.columns])
    rows = docs.select(whole(docs), F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), nulls.alias("nulls"))
    rows = rows.select("doc", "doc_id", "text", F.xxhash64("doc", "nulls").alias("key"))
    heads = saved(simhash.heads(rows, "key").select(F.col("id").alias("head_id"), F.col("key").alias("head"), "n"))
    kept = rows.join(heads, F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.col("key") == F.col("head")))
    one, more = kept.where("n = 1").select("doc"), kept.where("n > 1").dropDuplicates(["head_id", "head"]).select("doc")
    return unwrapped(one.unionByName(more), docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret in the texts; n_chars follows the text. Null texts stay null."""
    small_batches(spark)
    out = secrets.redact(docs, secrets.Ledger(spark, new_folder(spark, "secret-ledger")))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: for each pass in which it takes words of a document, a row with these words (the whole text, unchanged, where it takes all). Texts without words are not taken."""
    _, segs, out = mixing.mixed(spark, mixing.sized(docs))
    took = mixing.drawn(segs, out)
    # per document and pass: the runs of words taken, in order
    runs = took.groupBy("row", "pass").agg(F.array_sort(F.collect_list(F.struct("doc_from", "take"))).alias("runs"), F.sum("take").alias("taken"), F.max("size").alias("size"))
    met = mixing.keyed(docs).join(runs, "row")
    text = F.col("doc.text").cast("string")
    # only texts that are taken in part are cut into words; a lambda's variable is computed once, not for each run
    spaced = F.when(F.col("taken") < F.col("size"), F.translate(text, "\t\n\x0b\x0c\r", "     "))
    cut = lambda r, words: F.slice(words, (r["doc_from"] + 1).cast("int"), r["take"].cast("int"))
    some = F.transform(F.array(F.array_remove(F.split(spaced, " "), "")), lambda words: F.array_join(F.flatten(F.transform("runs", lambda r: cut(r, words))), " "))
    new = F.when(F.col("taken") == F.col("size"), text).otherwise(F.element_at(some, 1))
    met = met.withColumn("new", F.element_at(F.transform(F.array(new), lambda t: F.struct(t.alias("text"), F.length(t).cast("long").alias("n"))), 1))
    return unwrapped(met, docs.columns, text=F.col("new.text"), **({"n_chars": F.col("new.n")} if "n_chars" in docs.columns else {}))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes and decodes what the mix has taken: one row per row of the mix, with its ids, its decoded text and its other columns.

    A null text counts as empty. Other columns named like one that the stage returns have `_before` added to their names.
    """
    import public_tokenizers

    small_batches(spark)
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    clash = {"id", *pieces.ROUND_TRIP}
    names = {c: f"{c}_before" if c in clash else c for c in others}
    rows = docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    return pieces.round_trip(rows, public_tokenizers.path("piece_bpe_32k.model"), keep=tuple(names.values())).withColumnRenamed("id", "doc_id")


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("secret_scan", secret_scan), ("source_mix", source_mix), ("sentencepiece", sentencepiece)]

#: SQL cannot express the classifier, XXH64 fingerprints or the automaton; the tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = new_folder(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        out = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if k:  # its successor is written
            remove_folder(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
