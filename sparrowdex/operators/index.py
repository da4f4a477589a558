"""The index: documents, postings and statistics as Parquet tables in versioned folders."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window as W

from ..functions import text as tx

SCHEMA_VERSION = 1
KEY = "doc_id"


@dataclass
class Index:
    """Tables of an index. `documents` has KEY, text, lang and stored fields; `postings` field, term, KEY, tf, positions, dl; `lengths` field, dl (0: lacks it)."""

    documents: DataFrame
    postings: DataFrame
    lengths: DataFrame | None = None

    def terms(self, field: str = "text") -> DataFrame:
        """term, df, ttf of a field."""
        return self.postings.where(F.col("field") == field).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("ttf"))

    def field_stats(self, field: str = "text") -> DataFrame:
        """n (documents that have the field) and avgdl, one row; without a table of lengths, from each document's first posting."""
        if self.lengths is not None:
            return self.lengths.where(F.col("field") == field).agg(F.count_if(F.col("dl") > 0).alias("n"), F.avg(F.when(F.col("dl") > 0, F.col("dl"))).alias("avgdl"))
        first = self.postings.where((F.col("field") == field) & F.col("is_first"))
        return first.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def token_fields(text: Column, lang: Column | None = None) -> dict[str, Column]:
    """Analysed fields of a text: folded tokens, and tokens with digraphs read as umlauts. Lemma fields are derived from the first."""
    return {"text": tx.tokens(text), "text_translit": tx.digraph_tokens(text)}


def build_postings(docs: DataFrame, fields: dict[str, Column], lemma_fields: dict[str, str] | None = None) -> DataFrame:
    """field, term, KEY, tf, positions, dl, is_first.

    Positions of a document's term come together in one aggregation keyed by document and term, so that no term's list of documents is ever gathered.
    Lemmas are expressions of the text's tokens, so nothing is written to disk or sent before that aggregation, and a filter on fields or terms comes before it.
    """
    parts = []
    for name, toks in fields.items():
        # the length goes with each token, the list of tokens does not; the plain explode would have texts cut into tokens once more, for a filter on empty lists
        part = docs.select(KEY, toks.alias("toks")).select(KEY, F.size("toks").alias("dl"), "toks").select(KEY, "dl", F.posexplode_outer("toks").alias("pos", "term")).where("pos IS NOT NULL")
        if name == "text" and lemma_fields:
            part = part.select("*", *[tx.lemma_column(F.col("term"), lang).alias(k) for k, lang in lemma_fields.items()])
            forms = F.array(*[F.struct(F.lit(k).alias("field"), F.col(c).alias("term")) for k, c in ((name, "term"), *((k, k) for k in lemma_fields))])
            part = part.select(KEY, "dl", "pos", F.explode(forms).alias("f")).select("f.field", "f.term", KEY, "dl", "pos")
        else:
            part = part.select(F.lit(name).alias("field"), "term", KEY, "dl", "pos")
        parts.append(part)
    rows = reduce(DataFrame.unionByName, parts)
    grouped = rows.groupBy("field", "term", KEY, "dl").agg(F.count("*").cast("int").alias("tf"), F.array_sort(F.collect_list("pos")).alias("positions"))
    return grouped.withColumn("is_first", F.array_contains("positions", 0))


def build(docs: DataFrame, lemmas: bool = True) -> Index:
    """Index of documents (KEY, text, lang, ...). Null texts have no postings."""
    fields = token_fields(F.col("text"))
    return Index(docs, build_postings(docs, fields, {"text_lemma_de": "de", "text_lemma_en": "en"} if lemmas else None), lengths(docs, fields, lemmas))


def lengths(docs: DataFrame, fields: dict[str, Column], lemmas: bool = False) -> DataFrame:
    """field, dl of each document, 0 where it lacks the field: no shuffle, and a filter on fields leaves the others uncounted.

    Lemmas and transliterations have the length of the text that they come from: each of its tokens gives one.
    """
    names = [*fields, *(("text_lemma_de", "text_lemma_en") if lemmas else ())]
    same = ("text_translit", "text_lemma_de", "text_lemma_en") if "text" in fields else ()
    parts = [docs.select(F.lit(n).alias("field"), F.size(fields["text" if n in same else n]).alias("dl")) for n in names]
    return reduce(DataFrame.unionByName, parts)


def workspace(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share (spark.checkpoint.dir); on one machine without such a setting, a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith(("local[", "local,")) and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        base = "file://" + tempfile.mkdtemp(prefix="sparrowdex-")
    return f"{base}/{name}-{uuid.uuid4().hex}"


# -- storage -----------------------------------------------------------------------------------------------------------------------


class Conflict(RuntimeError):
    """Another writer has committed this version first: open the new one and try again."""


class Store:
    """Index versions below one folder. A version is a list of segments; readers keep the version they opened.

    A change writes one new segment: its documents and postings, and the keys that it takes out of older segments. So it costs what it brings, not
    the index. After MOST_SEGMENTS a commit merges them. A version's pointer file is created under its number, which fails if it is there already, so of
    two writers one gets a Conflict.
    """

    MOST_SEGMENTS = 16

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _at(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _numbers(self) -> list[int]:
        fs, p = self._at(f"{self.folder}/versions")
        return sorted(int(x.getPath().getName()[:-5]) for x in fs.listStatus(p) if x.getPath().getName().endswith(".json")) if fs.exists(p) else []

    def version(self, number: int | None = None) -> dict | None:
        """What the pointer of a version says, of the last one by default."""
        numbers = self._numbers()
        if not numbers:
            return None
        return json.loads(self.spark.read.text(f"{self.folder}/versions/{number or numbers[-1]:012d}.json", wholetext=True).first()[0])

    def needs_rebuild(self) -> bool:
        """A version that another schema version wrote, or none, must be built anew."""
        v = self.version()
        return v is None or v["schema_version"] != SCHEMA_VERSION

    def _write(self, index: Index | None, deletes: DataFrame | None = None, files: int | None = None) -> dict:
        """A segment in a folder of its own."""
        out = {"path": f"{self.folder}/s-{uuid.uuid4().hex}", "tables": None, "deletes": None}
        if index is not None:
            docs, postings = index.documents, index.postings
            if files:
                docs, postings = docs.repartition(files, KEY), postings.repartition(files, "field", "term")
            docs.write.parquet(f"{out['path']}/documents")
            # a term's rows lie together within files, so that its row groups alone are read
            postings.sortWithinPartitions("term", KEY).write.partitionBy("field").parquet(f"{out['path']}/postings")
            out["tables"] = [docs.schema.jsonValue(), postings.schema.jsonValue()]  # an empty table has no files to tell its schema
        if deletes is not None:
            deletes.select(KEY).distinct().write.parquet(f"{out['path']}/deletes")
            out["deletes"] = deletes.select(KEY).schema.jsonValue()
        return out

    def _point(self, segments: list[dict], note: str, number: int) -> int:
        line = json.dumps({"number": number, "schema_version": SCHEMA_VERSION, "note": note, "segments": segments})
        fs, p = self._at(f"{self.folder}/versions/{number:012d}.json")
        try:
            f = fs.create(p, False)
        except Exception as e:
            if fs.exists(p):
                raise Conflict(f"version {number} exists") from e
            raise
        f.write(bytearray(line.encode()))
        f.close()
        return number

    def _next(self) -> tuple[int, list[dict]]:
        v = self.version()
        return (v["number"] + 1, v["segments"]) if v else (1, [])

    def commit(self, index: Index, note: str = "commit", files: int | None = None) -> int:
        """A version of this index alone, in one segment."""
        number, _ = self._next()
        return self._point([self._write(index, None, files)], note, number)

    def _open(self, segments: list[dict]) -> Index:
        docs = postings = gone = None
        for k, s in enumerate(segments):
            if s["tables"]:
                d, p = (self.spark.read.schema(StructType.fromJson(t)).parquet(f"{s['path']}/{n}").withColumn("_segment", F.lit(k)) for t, n in zip(s["tables"], ("documents", "postings"), strict=True))
                docs, postings = (d, p) if docs is None else (docs.unionByName(d, allowMissingColumns=True), postings.unionByName(p))
            if s["deletes"]:
                x = self.spark.read.schema(StructType.fromJson(s["deletes"])).parquet(f"{s['path']}/deletes").withColumn("_until", F.lit(k))
                gone = x if gone is None else gone.unionByName(x)
        if gone is not None:  # rows of segments before the last one that takes their key out
            gone = gone.groupBy(KEY).agg(F.max("_until").alias("_until"))
            docs, postings = (t.join(gone, KEY, "left").where("_until IS NULL OR _segment >= _until").drop("_until") for t in (docs, postings))
        return Index(docs.drop("_segment"), postings.drop("_segment"))

    def open(self, number: int | None = None) -> Index:
        v = self.version(number)
        if v is None:
            raise FileNotFoundError(f"No index in {self.folder}")
        return self._open(v["segments"])

    def apply(self, docs: DataFrame | None = None, keys: DataFrame | None = None, lemmas: bool = True, note: str = "apply") -> int:
        """One commit that takes out `keys` and replaces documents by key or adds them (the last of equal keys in `docs` by all columns wins)."""
        fresh = gone = None
        if docs is not None:
            order = W.partitionBy(KEY).orderBy(*[F.desc(c) for c in docs.columns if c != KEY])
            new = docs.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")
            fresh, gone = build(new, lemmas), docs.select(KEY)
        if keys is not None:
            gone = keys.select(KEY) if gone is None else gone.unionByName(keys.select(KEY))
        number, segments = self._next()
        if not segments and fresh is None:
            raise FileNotFoundError(f"No index in {self.folder}")
        segments = [*segments, self._write(fresh, gone if segments else None)]
        if len(segments) > self.MOST_SEGMENTS:
            segments = [self._write(self._open(segments))]
        return self._point(segments, note, number)

    def upsert(self, docs: DataFrame, lemmas: bool = True) -> int:
        return self.apply(docs, None, lemmas, "upsert")

    def delete(self, keys: DataFrame) -> int:
        return self.apply(None, keys, note="delete")

    def purge(self) -> int:
        old = self.open()
        return self.commit(Index(old.documents.limit(0), old.postings.limit(0)), "purge")

    def compact(self, files: int = 1) -> int:
        """Merges the current version's segments into one, of `files` files a table."""
        return self.commit(self.open(), "compact", files)

    def vacuum(self, keep: int = 2) -> int:
        """Removes all but the last `keep` versions, and the segments that no version left names. Returns how many segments went."""
        numbers = self._numbers()
        kept = {s["path"].rsplit("/", 1)[-1] for n in numbers[-keep:] for s in self.version(n)["segments"]}
        for n in numbers[:-keep]:
            fs, p = self._at(f"{self.folder}/versions/{n:012d}.json")
            fs.delete(p, False)
        fs, p = self._at(self.folder)
        old = [x.getPath() for x in fs.listStatus(p) if x.getPath().getName().startswith("s-") and x.getPath().getName() not in kept]
        for x in old:
            fs.delete(x, True)
        return len(old)

    def status(self) -> dict:
        v = self.version()
        return {"version": v["number"], "documents": self.open().documents.count(), "segments": len(v["segments"]), "schema_version": v["schema_version"], "note": v["note"]} if v else {"version": 0, "documents": 0, "segments": 0}
