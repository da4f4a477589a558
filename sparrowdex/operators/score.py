"""Queries compiled to DataFrames of (doc_id, score): BM25 over postings, phrases by positions, Boolean groups by one aggregation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import query as q
from .index import KEY, Index

K1, B = 1.2, 0.75


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def bm25(tf: Column, dl: Column, n: Column, avgdl: Column, df: Column) -> Column:
    return idf(n, df) * tf / (tf + K1 * (1 - B + B * dl / avgdl))


def _matched(index: Index, node: q.Node) -> DataFrame:
    """Dictionary terms (term, df) that a term-like node stands for. The dictionary is far smaller than the postings; the query's part of it is filtered at the scan."""
    p = index.postings.where(F.col("field") == node.field)
    t = F.col("term")
    if isinstance(node, q.Term):
        p = p.where(t == node.text)
    elif isinstance(node, q.Prefix):
        p = p.where(t.startswith(node.text))
    elif isinstance(node, q.Wildcard):
        p = p.where(t.rlike(q.like_regex(node.pattern)))
    else:
        lo, hi = len(node.text) - node.edits, len(node.text) + node.edits
        p = p.where(F.length(t).between(lo, hi)).where(F.levenshtein(t, F.lit(node.text), node.edits) >= 0)
    return p


def _terms(index: Index, node: q.Node, scored: bool) -> DataFrame:
    p = _matched(index, node)
    if not scored:
        return p.groupBy(KEY).agg(F.lit(1.0).alias("score"))
    df = p.groupBy("term").agg(F.count("*").alias("df"))
    if isinstance(node, q.Prefix):  # the first terms of the dictionary share the largest document frequency
        df = df.orderBy("term").limit(q.PREFIX_TERMS)
        df = df.crossJoin(F.broadcast(df.agg(F.max("df").alias("most")))).select("term", F.col("most").alias("df"))
    stats = F.broadcast(index.field_stats(node.field))  # one row
    hits = p.join(df, "term").crossJoin(stats)
    return hits.withColumn("s", bm25(F.col("tf"), F.col("dl"), F.col("n"), F.col("avgdl"), F.col("df"))).groupBy(KEY).agg(F.sum("s").alias("score"))


def phrase_frequency(positions: list[Column], slop: int) -> Column:
    """How often terms with these positions stand in order: exactly (slop 0), else sum of 1 / (1 + width) over matches within the slop."""

    def shifted(p: Column, i: int) -> Column:
        return F.transform(p, lambda x: x - i)

    moved = [shifted(p, i) for i, p in enumerate(positions)]
    if slop == 0:
        return F.size(reduce(F.array_intersect, moved)).cast("double")

    def width(a: Column) -> Column:
        """From a's place to the nearest of each other term: distance of the outermost, null if one has none within the slop."""
        near = [F.array_min(F.transform(F.filter(m, lambda x: F.abs(x - a) <= slop), lambda x: F.struct(F.abs(x - a).alias("d"), x.alias("x"))))["x"] for m in moved[1:]]
        return F.greatest(a, *near) - F.least(a, *near) + reduce(lambda x, y: x + y, [n * 0 for n in near])

    widths = F.filter(F.transform(moved[0], width), lambda w: w.isNotNull() & (w <= slop))
    return F.aggregate(widths, F.lit(0.0), lambda acc, w: acc + 1.0 / (1.0 + w))


def _phrase(index: Index, node: q.Phrase) -> DataFrame:
    """One aggregation by document brings the terms' positions together; documents that lack a term fall out."""
    p = index.postings.where((F.col("field") == node.field) & F.col("term").isin(*set(node.terms)))
    distinct = list(dict.fromkeys(node.terms))
    stats = p.groupBy("term").agg(F.count("*").alias("df"))
    one = F.broadcast(index.field_stats(node.field))
    total = stats.crossJoin(one).agg(F.sum(idf(F.col("n"), F.col("df")) * sum((F.when(F.col("term") == t, float(node.terms.count(t))).otherwise(0.0) for t in distinct), F.lit(0.0))).alias("idf"), F.first("avgdl").alias("avgdl"))
    by_doc = p.groupBy(KEY, "dl").agg(*[F.max(F.when(F.col("term") == t, F.col("positions"))).alias(f"p{i}") for i, t in enumerate(distinct)])
    for i in range(len(distinct)):
        by_doc = by_doc.where(F.col(f"p{i}").isNotNull())
    f = by_doc.withColumn("f", phrase_frequency([F.col(f"p{distinct.index(t)}") for t in node.terms], node.slop)).where("f > 0")
    return f.crossJoin(F.broadcast(total)).select(KEY, (F.col("idf") * F.col("f") / (F.col("f") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))).alias("score"))


def compile(index: Index, node: q.Node) -> DataFrame:
    """(KEY, score) of the documents that match."""
    if isinstance(node, q.MatchAll):
        out = index.documents.select(KEY, F.lit(1.0).alias("score"))
    elif isinstance(node, q.Range):
        c = F.col(node.field)
        d = index.documents
        if node.low is not None:
            d = d.where(c >= F.lit(node.low).cast(d.schema[node.field].dataType) if node.closed[0] else c > F.lit(node.low).cast(d.schema[node.field].dataType))
        if node.high is not None:
            d = d.where(c <= F.lit(node.high).cast(d.schema[node.field].dataType) if node.closed[1] else c < F.lit(node.high).cast(d.schema[node.field].dataType))
        out = d.where(c.isNotNull()).select(KEY, F.lit(1.0).alias("score"))
    elif isinstance(node, q.Term) and node.field in index.documents.columns and node.field != q.DEFAULT_FIELD:
        out = index.documents.where(F.lower(F.col(node.field).cast("string")) == node.text).select(KEY, F.lit(1.0).alias("score"))
    elif isinstance(node, q.Phrase):
        out = _phrase(index, node)
    elif isinstance(node, q.Bool):
        out = _bool(index, node)
    else:
        out = _terms(index, node, isinstance(node, (q.Term, q.Fuzzy)) or getattr(node, "scored", False))
    return out.withColumn("score", F.col("score") * node.boost) if node.boost != 1.0 else out


def _bool(index: Index, node: q.Bool) -> DataFrame:
    """All clauses in one aggregation: scores add up, and counts by kind of clause tell whether enough matched."""
    clauses = [*node.must, *node.should, *node.must_not]
    if not clauses:
        return index.documents.limit(0).select(KEY, F.lit(0.0).alias("score"))
    n_must, n_should = len(node.must), len(node.should)
    if not n_must and not n_should:  # nothing asked for: excluding alone matches nothing
        return index.documents.limit(0).select(KEY, F.lit(0.0).alias("score"))
    rows = None
    for k, c in enumerate(clauses):
        kind = "must" if k < n_must else "should" if k < n_must + n_should else "never"
        one = compile(index, c).select(KEY, (F.col("score") if kind != "never" else F.lit(0.0)).alias("score"), F.lit(kind).alias("kind"))
        rows = one if rows is None else rows.unionByName(one)
    # each clause gives a document one row at most, so counts tell how many clauses matched: any number of them
    count = lambda kind: F.count_if(F.col("kind") == kind).alias(kind)
    g = rows.groupBy(KEY).agg(F.sum("score").alias("score"), count("must"), count("should"), count("never"))
    ok = (F.col("must") == n_must) & (F.col("never") == 0)
    if not n_must:
        ok = ok & (F.col("should") > 0)
    return g.where(ok).select(KEY, "score")


def language_boosts(index: Index) -> dict[str, float]:
    """0.3 + 0.7 * share of documents, by language."""
    rows = index.documents.groupBy("lang").count().collect()  # one row a language
    total = sum(r["count"] for r in rows) or 1
    return {r["lang"]: 0.3 + 0.7 * r["count"] / total for r in rows}


def all_fields(index: Index, node: q.Node, hint: str | None = None) -> q.Bool:
    """The tree of multi_field: a clause per field, each with the terms of its field."""
    from ..functions.text import digraph_str, lemma

    boosts = language_boosts(index)
    langs = {hint: 1.0} if hint in ("de", "en") else {k: boosts.get(k, 0.3) for k in ("de", "en")}
    parts = [q.Bool(2.0, should=(node,))]
    parts += [q.Bool(b, should=(q.to_field(node, f"text_lemma_{k}", lambda t, k=k: lemma(t, k)),)) for k, b in langs.items()]
    parts.append(q.Bool(0.5, should=(q.to_field(node, "text_translit", digraph_str),)))
    return q.Bool(should=tuple(parts))


def multi_field(index: Index, node: q.Node, hint: str | None = None) -> DataFrame:
    """The query over text (twice the score), lemma fields (by their language's share, or the hinted one alone) and transliterations (half)."""
    return compile(index, node if isinstance(node, q.MatchAll) else all_fields(index, node, hint))


def explain(index: Index, node: q.Node) -> DataFrame:
    """Contribution of each term of a flat query: doc_id, term, tf, idf, score, percent of the document's score."""
    from pyspark.sql.window import Window as W

    terms = q.query_terms(node)
    p = index.postings.where((F.col("field") == q.DEFAULT_FIELD) & F.col("term").isin(*terms))
    df = p.groupBy("term").agg(F.count("*").alias("df"))
    s = p.join(F.broadcast(df), "term").crossJoin(F.broadcast(index.field_stats()))
    s = s.select(KEY, "term", "tf", idf(F.col("n"), F.col("df")).alias("idf"), bm25(F.col("tf"), F.col("dl"), F.col("n"), F.col("avgdl"), F.col("df")).alias("score"))
    return s.where("score > 0.01").withColumn("percent", F.col("score") / F.sum("score").over(W.partitionBy(KEY)) * 100)
