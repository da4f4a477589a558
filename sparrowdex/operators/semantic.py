"""Semantic search: exact nearest chunks by cosine, thresholds, grouping by parent document."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Chunks that a search considers.
K = 50
MAX_CHARS = 100_000


def cosine(v: Column, query: list[float]) -> Column:
    """Dot product with a query vector, in double precision; vectors have unit length."""
    return F.aggregate(F.zip_with(v, F.array(*[F.lit(float(x)) for x in query]), lambda a, b: a.cast("double") * b), F.lit(0.0), lambda acc, x: acc + x)


def stored_score(cos: Column) -> Column:
    return (1 + cos) / 2


def check_threshold(t: float | None) -> float:
    t = 0.70 if t is None else float(t)
    if not 0.0 <= t <= 1.0:
        raise ValueError("similarityThreshold must be between 0.0 and 1.0")
    return t


def nearest(chunks: DataFrame, query: list[float], k: int = K, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k nearest chunks by cosine, with `rank` from 1: a top-k per task and one merge, no sort of all rows."""
    top = chunks.withColumn("cosine", cosine(F.col(vec_col), query)).orderBy(F.desc("cosine"), id_col).limit(k)
    return top.withColumn("rank", F.row_number().over(W.orderBy(F.desc("cosine"), id_col)))  # k rows


def search(chunks: DataFrame, query: list[float], parent: str, threshold: float | None = None, k: int = K, post_filter: Column | None = None, parents: DataFrame | None = None, page: int = 0, page_size: int = 10, filter_first: bool = False) -> DataFrame:
    """parent, best cosine, n_chunks, chunks: all passing chunks among the k nearest, by parent, paged by best cosine.

    The page is cut first and filters on the parent apply to it; `filter_first` turns that round.
    """
    t = check_threshold(threshold)
    if filter_first and post_filter is not None:
        chunks = chunks.join(parents.where(post_filter).select(parent), parent, "left_semi") if parents is not None else chunks.where(post_filter)
    hits = nearest(chunks, query, k).where(stored_score(F.col("cosine")) >= (1 + t) / 2)
    g = hits.groupBy(parent).agg(F.max("cosine").alias("best"), F.count("*").alias("n_chunks"), F.array_sort(F.collect_list(F.struct((-F.col("cosine")).alias("o"), F.col("rank")))).alias("chunks"))
    g = g.orderBy(F.desc("best"), parent).offset(page * page_size).limit(page_size)
    if post_filter is not None and not filter_first:
        g = g.join(parents.where(post_filter), parent) if parents is not None else g.where(post_filter)
    return g


def profile(chunks: DataFrame, query: list[float], threshold: float | None = None, k: int = K) -> DataFrame:
    """All candidates with rank, both scores and whether they pass."""
    t = check_threshold(threshold)
    return nearest(chunks, query, k).select("vec_id", "rank", "cosine", stored_score(F.col("cosine")).alias("score"), (stored_score(F.col("cosine")) >= (1 + t) / 2).alias("passed"))


def chunk_documents(docs: DataFrame, embed: Callable[[list[str]], list[list[float]]], n_chars: int = 1500, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Chunks with vectors: id, chunk_index, chunk_text, chunk_position, embedding. Texts beyond MAX_CHARS get none. `embed` is any picklable function."""
    ok = docs.where(F.length(text_col).between(1, MAX_CHARS))
    n = F.ceil(F.length(text_col) / n_chars).cast("int")
    cut = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substr(F.col(text_col), i * n_chars + 1, F.lit(n_chars)))
    c = ok.select(id_col, n.alias("_n"), F.posexplode(cut).alias("chunk_index", "chunk_text"))
    c = c.withColumn("chunk_position", F.when(F.col("_n") > 1, F.col("chunk_index") / (F.col("_n") - 1)).otherwise(0.0).cast("float")).drop("_n")

    @F.pandas_udf("array<float>")
    def vectors(text: pd.Series) -> pd.Series:
        return pd.Series(list(embed([f"passage: {t}" for t in text])))

    return c.withColumn("embedding", vectors("chunk_text"))


def hashing_embedder(dim: int = 64) -> Callable[[list[str]], list[list[float]]]:
    """A deterministic embedder without a model: hashed tokens, unit length."""

    def embed(texts: list[str]) -> list[list[float]]:
        import math
        import re
        import zlib

        out = []
        for t in texts:
            v = [0.0] * dim
            for w in re.findall(r"\w+", re.sub(r"^(query|passage): ", "", t).lower()):
                h = zlib.crc32(w.encode())
                v[h % dim] += 1.0 if h & 1024 else -1.0
            n = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / n for x in v])
        return out

    return embed
