"""Queries of the engine over the test tables, by name, each with DuckDB SQL for the same rows where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import facets, index, observe, passages, score, search, semantic
from ..operators import query as q
from ..operators.filters import Fields, Filter, combined, predicate
from ..sources import ingest, metadata
from ..streaming import watch

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def corpus(spark, d, *extra: str) -> index.Index:
    """The index over documents with the text field (and others named), built on the fly: filters on terms reach below the aggregation."""
    docs = read(spark, d, "documents")
    fields = {k: v for k, v in index.token_fields(F.col("text")).items() if k in ("text", *extra)}
    return index.Index(docs, index.build_postings(docs, fields), index.lengths(docs, fields))


def ranked(idx: index.Index, text: str, top: int | None = None, where: str = "true") -> DataFrame:
    hits = score.compile(idx, q.rewrite(q.parse(text)))
    out = idx.documents.where(where).select("doc_id").join(hits, "doc_id").select("doc_id", F.round("score", 6).alias("score"))
    return out.orderBy(F.desc("score"), "doc_id").limit(top) if top else out


def stored(spark, d, *extra: str) -> index.Store:
    """The same index, written to a fresh folder."""
    store = index.Store(spark, index.workspace(spark, "index"))
    store.commit(corpus(spark, d, *extra))
    return store


FOLDED = "strip_accents(replace(lower(coalesce(text, '')), 'ß', 'ss'))"
TOKS = rf"toks AS (SELECT doc_id, lang, source, n_chars, regexp_extract_all({FOLDED}, '[\p{{L}}\p{{N}}]+') AS t FROM documents)"
POST = f"""{TOKS}, st AS (SELECT count(*) AS n, avg(len(t)) AS a FROM toks WHERE len(t) > 0),
x AS (SELECT doc_id, len(t) AS dl, unnest(t) AS term, unnest(range(len(t))) AS pos FROM toks),
post AS (SELECT doc_id, term, dl, count(*) AS tf, list(pos ORDER BY pos) AS ps FROM x GROUP BY ALL)"""
_IDF = "ln(1 + (n - df + 0.5) / (df + 0.5))"
_S = f"{_IDF} * tf / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / a))"


def scored_sql(match: str, flags: str = "", having: str = "true", tail: str = "") -> str:
    return f"""WITH {POST}, m AS (SELECT *, count(*) OVER (PARTITION BY term) AS df FROM post WHERE {match}),
s AS (SELECT doc_id, term, {_S} AS s FROM m, st)
SELECT doc_id, round(sum(s{flags}), 6) AS score FROM s GROUP BY doc_id HAVING {having} {tail}"""


# -- ranking

@query(f"""WITH {POST}, m AS (SELECT *, count(*) OVER (PARTITION BY term) AS df FROM post WHERE term IN ('license', 'version')),
s AS (SELECT doc_id, round(sum({_S}), 6) AS score FROM m, st GROUP BY doc_id)
SELECT doc_id, score FROM s JOIN documents USING (doc_id) WHERE lang = 'en' ORDER BY score DESC, doc_id LIMIT 10""")
def bm25_or_topk(spark, d):
    return ranked(corpus(spark, d), "license version", 10, "lang = 'en'")


@query(scored_sql("term IN ('the', 'of')", having="count(*) = 2"))
def bm25_and(spark, d):
    return ranked(corpus(spark, d), "the AND of")


@query(scored_sql("term IN ('the', 'of')", flags=" * (term = 'the')::INT", having="count(*) = 1 AND max(term) = 'the'"))
def bm25_not(spark, d):
    return ranked(corpus(spark, d), "the NOT of")


@query(scored_sql("term IN ('the', 'and', 'of')", having="bool_or(term = 'the')"))
def bm25_required(spark, d):
    return ranked(corpus(spark, d), "+the and of")


@query("SELECT doc_id, n_chars, lang FROM documents ORDER BY coalesce(n_chars, 0) DESC, doc_id LIMIT 10 OFFSET 20")
def match_all_sorted_page(spark, d):
    idx = corpus(spark, d)
    rows = idx.documents.join(score.compile(idx, q.rewrite(q.parse("*"))), "doc_id").select("doc_id", "n_chars", "lang", "score")
    return search.Engine(idx).ordered(rows, "n_chars").offset(20).limit(10).select("doc_id", "n_chars", "lang")


_PH = f"""WITH {POST}, a AS (SELECT doc_id, dl, max(ps) FILTER (term = 'of') AS p, max(ps) FILTER (term = 'the') AS r FROM post WHERE term IN ('of', 'the') GROUP BY ALL HAVING count(*) = 2),
dfs AS (SELECT term, count(*) AS df FROM post WHERE term IN ('of', 'the') GROUP BY term), w AS (SELECT sum({_IDF}) AS idf FROM dfs, st),
u AS (SELECT doc_id, dl, r, unnest(p) AS p FROM a),
nn AS (SELECT doc_id, dl, p, list_min(list_transform(r, lambda v: abs(v - 1 - p))) AS gap FROM u),
f AS (SELECT doc_id, dl, sum((gap = 0)::INT)::DOUBLE AS f0, sum(CASE WHEN gap <= 3 THEN 1.0 / (1 + gap) ELSE 0 END)::DOUBLE AS f3 FROM nn GROUP BY ALL)"""
_PS = "idf * {f} / ({f} + 1.2 * (1 - 0.75 + 0.75 * dl / a))"


@query(f"{_PH} SELECT doc_id, round({_PS.format(f='f0')}, 6) AS score FROM f, w, st WHERE f0 > 0")
def phrase_exact(spark, d):
    hits = score.compile(corpus(spark, d), q.Phrase(terms=("of", "the")))
    return hits.select("doc_id", F.round("score", 6).alias("score"))


@query(f"{_PH} SELECT doc_id, round({_PS.format(f='f3')}, 6) AS score FROM f, w, st WHERE f3 > 0")
def phrase_slop3(spark, d):
    return ranked(corpus(spark, d), '"of the"~3')


@query(f"{_PH} SELECT doc_id, round(CASE WHEN f0 > 0 THEN 2 * {_PS.format(f='f0')} ELSE 0 END + {_PS.format(f='f3')}, 6) AS score FROM f, w, st WHERE f3 > 0")
def phrase_expanded(spark, d):
    return ranked(corpus(spark, d), '"of the"')


@query(f"""WITH {POST}, t AS (SELECT term, count(*) AS df FROM post WHERE term LIKE 'lice%' GROUP BY term ORDER BY term LIMIT 50), b AS (SELECT max(df) AS df FROM t)
SELECT doc_id, round(sum({_S}), 6) AS score FROM post JOIN (SELECT term FROM t) USING (term), b, st GROUP BY doc_id""")
def prefix_scored(spark, d):
    return ranked(corpus(spark, d), "lice*")


def constant_sql(match: str) -> str:
    return f"WITH {POST} SELECT doc_id, 1.0::DOUBLE AS score FROM post WHERE {match} GROUP BY doc_id"


@query(constant_sql("term LIKE 'li%'"))
def prefix_constant(spark, d):
    return ranked(corpus(spark, d), "li*")


@query(constant_sql("term LIKE '%cense'"))
def wildcard_leading(spark, d):
    return ranked(corpus(spark, d), "*cense")


@query(constant_sql("term LIKE 'lic_n%e'"))
def wildcard_infix(spark, d):
    return ranked(corpus(spark, d), "lic?n*e")


@query(scored_sql("term ~ '^[a-z0-9]+$' AND levenshtein(term, 'lisense') <= 1"))
def fuzzy_1(spark, d):
    return ranked(corpus(spark, d), "lisense~1")


_raw = "coalesce(text, '')"
for _a, _b in (("ae", "ä"), ("oe", "ö"), ("ue", "ü"), ("Ae", "Ä"), ("Oe", "Ö"), ("Ue", "Ü"), ("AE", "Ä"), ("OE", "Ö"), ("UE", "Ü")):
    _raw = f"replace({_raw}, '{_a}', '{_b}')"
DIGRAPHS = f"strip_accents(replace(lower({_raw}), 'ß', 'ss'))"


@query(rf"""WITH both_ AS (SELECT doc_id, 2.0 AS b, regexp_extract_all({FOLDED}, '[\p{{L}}\p{{N}}]+') AS t FROM documents UNION ALL SELECT doc_id, 0.5, regexp_extract_all({DIGRAPHS}, '[\p{{L}}\p{{N}}]+') FROM documents),
c AS (SELECT doc_id, b, len(t) AS dl, len(list_filter(t, lambda w: w = 'fur')) AS tf FROM both_),
st AS (SELECT b, count(*) FILTER (dl > 0) AS n, avg(dl) FILTER (dl > 0) AS a, count(*) FILTER (tf > 0) AS df FROM c GROUP BY b)
SELECT doc_id, round(sum(b * {_S}), 6) AS score FROM c JOIN st USING (b) WHERE tf > 0 GROUP BY doc_id""")
def multifield_boosted(spark, d):
    """The folded text at 2, transliterations at 0.5."""
    node = q.Term(text="fur")
    hits = score.compile(corpus(spark, d, "text_translit"), q.Bool(should=(q.Bool(2.0, should=(node,)), q.Bool(0.5, should=(q.to_field(node, "text_translit"),)))))
    return hits.select("doc_id", F.round("score", 6).alias("score"))


@query()
def multifield_lemmas(spark, d):
    """All four fields of a query, with lemma fields weighed by their language's share."""
    idx = index.build(read(spark, d, "documents"))
    # the four fields' clauses read the same postings: keep those of each field's terms (its lemmas, in the lemma fields)
    node = score.all_fields(idx, q.rewrite(q.parse("licenses")))
    idx.postings = idx.postings.where(F.col("term").isin(q.query_terms(node))).persist()
    return score.compile(idx, node).select("doc_id", F.round("score", 6).alias("score"))


@query("SELECT lang, round(0.3 + 0.7 * count(*) / (SELECT count(*) FROM documents), 6) AS boost FROM documents GROUP BY lang")
def language_boost(spark, d):
    boosts = score.language_boosts(index.Index(read(spark, d, "documents"), None))
    return spark.createDataFrame([(k, round(v, 6)) for k, v in boosts.items()], "lang string, boost double")


@query(f"""WITH {POST}, m AS (SELECT *, count(*) OVER (PARTITION BY term) AS df FROM post WHERE term IN ('license', 'version')),
s AS (SELECT doc_id, term, tf, {_IDF} AS idf, {_S} AS s FROM m, st)
SELECT doc_id, term, tf, round(idf, 6) AS idf, round(s, 6) AS score, round(s / sum(s) OVER (PARTITION BY doc_id) * 100, 4) AS percent FROM s WHERE s > 0.01""")
def explain_terms(spark, d):
    e = score.explain(corpus(spark, d), q.parse("license version"))
    return e.select("doc_id", "term", F.col("tf").cast("long").alias("tf"), F.round("idf", 6).alias("idf"), F.round("score", 6).alias("score"), F.round("percent", 4).alias("percent"))


# -- stored index and engine

_DOCS2 = "docs2 AS (SELECT doc_id, CASE WHEN source = 'src3' THEN coalesce(text, '') || ' License renewed' ELSE text END AS text, lang, source, n_chars FROM documents WHERE lang IS NULL OR lang <> 'fr' OR source = 'src3')"
_POST2 = POST.replace("FROM documents", "FROM docs2")


def _changed(spark, d) -> index.Store:
    """A stored index, then one commit that takes out French documents and replaces those of a source by others (French ones come back)."""
    store, docs = stored(spark, d), read(spark, d, "documents")
    new = docs.where("source = 'src3'").withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit(" License renewed")))
    store.apply(new, docs.where("lang = 'fr'").select("doc_id"), lemmas=False)
    return store


@query(f"""WITH {_DOCS2}, {_POST2}, m AS (SELECT *, count(*) OVER (PARTITION BY term) AS df FROM post WHERE term IN ('license', 'renewed')),
s AS (SELECT doc_id, term, {_S} AS s FROM m, st) SELECT doc_id, round(sum(s), 6) AS score FROM s GROUP BY doc_id""")
def stored_change_search(spark, d):
    idx = _changed(spark, d).open()
    return score.compile(idx, q.rewrite(q.parse("license renewed"))).select("doc_id", F.round("score", 6).alias("score"))


@query(f"WITH {_DOCS2} SELECT count(*) AS documents, 2::BIGINT AS segments, 'apply' AS note, 2::BIGINT AS version FROM docs2")
def stored_status(spark, d):
    s = _changed(spark, d).status()
    return spark.createDataFrame([(s["documents"], s["segments"], s["note"], s["version"])], "documents long, segments long, note string, version long")


@query(f"WITH {_DOCS2} SELECT doc_id, lang, length(text)::INT AS length FROM docs2")
def stored_compacted(spark, d):
    store = _changed(spark, d)
    store.compact(2)
    return store.open().documents.select("doc_id", "lang", F.length("text").alias("length"))


@query("SELECT 0::BIGINT AS before, count(*) AS after FROM documents")
def stored_purge_and_old_version(spark, d):
    """A purged index is empty; the version before it can still be opened."""
    store = stored(spark, d)
    store.purge()
    return spark.createDataFrame([(store.open().documents.count(), store.open(1).documents.count())], "before long, after long")


@query(f"WITH {_DOCS2}, {_POST2} SELECT term, count(*) AS df, sum(tf)::BIGINT AS ttf FROM post GROUP BY term")
def stored_terms(spark, d):
    return _changed(spark, d).open().terms()


def _page(spark, d) -> search.Page:
    e = search.Engine(corpus(spark, d), dims=["lang", "source"])
    return e.search("license version", [Filter("lang", "in", values=("en", "de"))], page=1, page_size=7)


_HITS = f"""WITH {POST}, m AS (SELECT *, count(*) OVER (PARTITION BY term) AS df FROM post WHERE term IN ('license', 'version')),
s AS (SELECT doc_id, 2 * sum({_S}) AS score FROM m, st GROUP BY doc_id), h AS (SELECT doc_id, score, lang, source FROM s JOIN documents USING (doc_id))"""


@query(f"""{_HITS}, f AS (SELECT * FROM h WHERE lang IN ('en', 'de')), n AS (SELECT count(*) AS n FROM f)
SELECT doc_id, lang, round(score, 6) AS score, n AS total_hits, ((n + 6) // 7)::BIGINT AS total_pages, 1::BIGINT AS page, n > 14 AS has_next, true AS has_previous FROM f, n ORDER BY f.score DESC, doc_id LIMIT 7 OFFSET 7""")
def search_page(spark, d):
    """The second page of a filtered search by the engine, with its paging."""
    p = _page(spark, d)
    rows = [(x["doc_id"], x["lang"], round(x["score"], 6), p.total_hits, p.total_pages, p.page, p.has_next, p.has_previous) for x in p.documents]
    return spark.createDataFrame(rows, "doc_id long, lang string, score double, total_hits long, total_pages long, page long, has_next boolean, has_previous boolean")


@query(f"""{_HITS} SELECT 'lang' AS dim, lang AS value, count(*) AS n FROM h WHERE lang IS NOT NULL GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM h WHERE lang IN ('en', 'de') AND source IS NOT NULL GROUP BY source""")
def search_page_facets(spark, d):
    """Facets of the same search: the filtered dimension keeps the counts of its other values."""
    return spark.createDataFrame([(x["dim"], x["value"], x["n"]) for x in _page(spark, d).facets], "dim string, value string, n long")


@query(f"""{_HITS}, f AS (SELECT 'lang' AS field, count(*) FILTER (lang IN ('en', 'de')) AS matches FROM h) SELECT * FROM f""")
def search_page_filters(spark, d):
    return spark.createDataFrame([(x["field"], x["matches"]) for x in _page(spark, d).active_filters], "field string, matches long")


@query("SELECT doc_id, source IN ('src1', 'src2') AND doc_id % 3 <> 1 AS included FROM documents")
def include_patterns(spark, d):
    """Excluded folders first, then patterns of base names."""
    ext = F.when(F.col("source").isin("src1", "src2"), "PDF").otherwise("bin")
    path = F.concat(F.lit("/data/"), F.when(F.col("doc_id") % 3 == 1, "a/node_modules/b/").otherwise("a/"), "doc_id", F.lit("."), ext)
    return read(spark, d, "documents").select("doc_id", ingest.should_include(path).alias("included"))


@query("SELECT 'dbmeta_k' AS name, 'LONG' AS type, true AS faceted, count(*) AS documents FROM events WHERE try_cast(json_extract_string(props, '$.k') AS BIGINT) IS NOT NULL HAVING count(*) > 0")
def metadata_registry(spark, d):
    e = read(spark, d, "events")
    payload = F.concat(F.lit('{"fields":[{"name":"k","type":"LONG","faceted":true,"value":"'), F.get_json_object("props", "$.k"), F.lit('"},{"name":"bad","type":"LONG","value":"x"},{"type":"TEXT","value":"no name"}]}'))
    return metadata.registry(e.where(F.get_json_object("props", "$.k").isNotNull()).select(metadata.parse_fields(payload).alias("fields")))


@query("""WITH c AS (SELECT DISTINCT user_id FROM events WHERE ts > TIMESTAMP '2024-01-20 00:00:00')
SELECT (SELECT count(*) FROM events WHERE ts > TIMESTAMP '2024-01-20 00:00:00') AS changed, (SELECT count(*) FROM orders JOIN c ON o_custkey = user_id) AS documents, (SELECT max(ts) FROM events) AS mark""")
def metadata_sync_summary(spark, d):
    """Documents (orders of a customer) that events after the mark touch, and the new mark."""
    from datetime import datetime

    docs = read(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("user_id"))
    _, mark, n = metadata.sync(docs, read(spark, d, "events"), datetime(2024, 1, 20), "user_id", "ts")
    return spark.createDataFrame([(n["changed"], n["documents"], mark)], "changed long, documents long, mark timestamp").select("changed", "documents", F.col("mark").cast("timestamp_ntz").alias("mark"))


@query("""SELECT doc_id::VARCHAR AS doc_id, CASE WHEN source = 'src5' THEN 'changed' ELSE coalesce(text, '') END AS text FROM documents WHERE doc_id % 4 <> 0 OR source = 'src5'""")
def watch_batch(spark, d):
    """A batch of change events on a stored index: deletions, then changes that come later than a deletion of the same path."""
    docs = read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), "lang", "source")
    store = index.Store(spark, index.workspace(spark, "index"))
    fields = {"text": tx.tokens(F.col("text"))}
    store.commit(index.Index(docs, index.build_postings(docs, fields)))
    gone = docs.where("cast(doc_id as long) % 4 = 0").select(F.col("doc_id").alias("path"), F.lit(watch.DELETED).alias("type"), F.lit(1).cast("long").alias("seq"))
    new = docs.where("source = 'src5'").select(F.col("doc_id").alias("path"), F.lit(watch.CHANGED).alias("type"), F.lit(2).cast("long").alias("seq"))
    load = lambda paths: paths.join(docs.drop("text"), "doc_id").withColumn("text", F.lit("changed"))
    watch.apply_batch(store, gone.unionByName(new), load, include=())
    return store.open().documents.select("doc_id", "text")


# -- filters, facets, sort

ORDERS = Fields(faceted=frozenset({"o_orderstatus", "o_orderpriority"}), long=frozenset({"o_custkey"}), date=frozenset({"o_orderdate"}), string=frozenset(), analyzed=frozenset())


@query("SELECT doc_id FROM documents WHERE lang = 'de' AND source IN ('src1', 'src2', 'src3')")
def filter_eq_in(spark, d):
    return read(spark, d, "documents").where(combined([Filter("lang", "eq", "de"), Filter("source", "in", values=("src1", "src2", "src3"))])).select("doc_id")


@query("SELECT doc_id FROM documents WHERE (lang IS NULL OR lang <> 'en') AND (source IS NULL OR source NOT IN ('src1', 'src2'))")
def filter_not_notin(spark, d):
    return read(spark, d, "documents").where(combined([Filter("lang", "not", "en"), Filter("source", "not_in", values=("src1", "src2"))])).select("doc_id")


@query("SELECT doc_id, n_chars FROM documents WHERE n_chars BETWEEN 500 AND 1500")
def filter_range_long(spark, d):
    return read(spark, d, "documents").where(predicate(Filter("n_chars", "range", low=500, high=1500))).select("doc_id", "n_chars")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate <= TIMESTAMP '1996-06-30 12:00:00'")
def filter_range_date(spark, d):
    return read(spark, d, "orders").where(predicate(Filter("o_orderdate", "range", low="1995-01-01", high="1996-06-30T12:00:00"), ORDERS)).select("o_orderkey")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderpriority = '1-URGENT' AND o_custkey >= 100 AND o_orderdate >= TIMESTAMP '1995-01-01'")
def filter_combined(spark, d):
    fs = [Filter("o_orderstatus", "in", values=("F", "O")), Filter("o_orderpriority", "eq", "1-URGENT"), Filter("o_custkey", "range", low=100), Filter("o_orderdate", "range", low="1995-01-01")]
    return read(spark, d, "orders").where(combined(fs, ORDERS)).select("o_orderkey", "o_totalprice")


@query("""WITH h AS (SELECT * FROM documents WHERE n_chars > 1000), f AS (SELECT 'lang' AS dim, lang AS value FROM h UNION ALL SELECT 'source', source FROM h)
SELECT dim, value, count(*) AS n FROM f GROUP BY ALL""")
def facet_hits(spark, d):
    return facets.hit_facets(read(spark, d, "documents").where("n_chars > 1000"), ["lang", "source"])


_SIDE = """SELECT 'lang' AS dim, lang AS value, count(*) AS n FROM documents WHERE n_chars > 500 AND source IN ('src1', 'src2') GROUP BY lang
UNION ALL SELECT 'source', source, count(*) FROM documents WHERE n_chars > 500 AND lang = 'en' GROUP BY source"""


def _side(spark, d):
    fs = [Filter("lang", "eq", "en"), Filter("source", "in", values=("src1", "src2")), Filter("n_chars", "range", low=501)]
    return fs, facets.sideways_facets(read(spark, d, "documents"), fs, ["lang", "source"])


@query(_SIDE)
def facet_drill_sideways(spark, d):
    return _side(spark, d)[1]


@query(f"WITH f AS ({_SIDE}) SELECT 'lang' AS field, (SELECT n FROM f WHERE dim = 'lang' AND value = 'en') AS matches UNION ALL SELECT 'source', (SELECT sum(n)::BIGINT FROM f WHERE dim = 'source' AND value IN ('src1', 'src2')) UNION ALL SELECT 'n_chars', -1")
def active_filter_counts(spark, d):
    fs, counts = _side(spark, d)
    return spark.createDataFrame([(x["field"], x["matches"]) for x in facets.active_filters(counts, fs)], "field string, matches long")


@query("""WITH f AS (SELECT 'o_custkey' AS dim, o_custkey::VARCHAR AS value, count(*) AS n FROM orders GROUP BY ALL UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY dim ORDER BY n DESC, value) AS k FROM f) SELECT dim, value, n FROM r WHERE k <= 100""")
def facet_top100(spark, d):
    return facets.hit_facets(read(spark, d, "orders"), ["o_custkey", "o_orderpriority"])


@query("SELECT d.doc_id, quality, toxic FROM documents d LEFT JOIN labels l USING (doc_id) ORDER BY coalesce(quality, 0) DESC, d.doc_id LIMIT 50")
def sort_metadata_tiebreak(spark, d):
    """Sorted by a metadata field: missing values count as 0, then score and key decide; an unknown metadata field falls back to the score."""
    docs = metadata.enrich(read(spark, d, "documents").select("doc_id", F.lit(1.0).alias("score")), read(spark, d, "labels"), "doc_id", ["quality"])
    e = search.Engine(index.Index(docs, None))
    top = e.ordered(docs, "dbmeta_quality").limit(50).select("doc_id", F.col("dbmeta_quality").alias("quality"), F.col("dbmeta_toxic").alias("toxic"))
    return top


# -- term statistics and profiles

@query(f"WITH {POST} SELECT term, count(*) AS df FROM post WHERE term LIKE 'th%' GROUP BY term ORDER BY df DESC, term LIMIT 20")
def suggest_terms(spark, d):
    return observe.suggest_terms(corpus(spark, d), "Th")[1]


@query(f"WITH {POST} SELECT term, count(*) AS df FROM post GROUP BY term ORDER BY df DESC, term LIMIT 20")
def top_terms(spark, d):
    return observe.top_terms(corpus(spark, d))[1]


@query(f"""WITH {POST}, n AS (SELECT count(*) AS n FROM documents), t AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS ttf FROM post WHERE term IN ('the', 'license', 'und', 'of') GROUP BY term)
SELECT term, df, ttf, round(ln((n + 1)::DOUBLE / (df + 1)), 6) AS idf, CASE WHEN df * 100 > n * 50 THEN 'very common' WHEN df * 100 > n * 20 THEN 'common' WHEN df * 100 > n * 5 THEN 'moderate' ELSE 'rare' END AS rarity FROM t, n""")
def term_statistics(spark, d):
    return observe.term_statistics(corpus(spark, d), ["the", "license", "und", "of"]).withColumn("idf", F.round("idf", 6))


@query(f"""WITH {POST}, h AS (SELECT DISTINCT doc_id FROM post WHERE term = 'the'), c AS (SELECT count(*) AS total, count(h.doc_id) AS matching, count(h.doc_id) FILTER (lang = 'en' AND n_chars >= 1000) AS after_filters FROM documents d LEFT JOIN h USING (doc_id))
SELECT total, matching, after_filters, round((matching - after_filters)::DOUBLE / matching * 100, 4) AS reduction FROM c""")
def search_metrics(spark, d):
    idx = corpus(spark, d)
    m = observe.search_metrics(idx, score.compile(idx, q.parse("the")), [Filter("lang", "eq", "en"), Filter("n_chars", "range", low=1000)])
    return m.withColumn("reduction", F.round("reduction", 4))


@query("""WITH c AS (SELECT count(*) AS a, count(*) FILTER (lang = 'en') AS b, count(*) FILTER (lang = 'en' AND n_chars >= 1000) AS c FROM documents),
s AS (SELECT 1 AS step, 'lang eq' AS filter, a AS before, b AS after FROM c UNION ALL SELECT 2, 'n_chars range', b, c FROM c),
p AS (SELECT *, before - after AS removed, (before - after)::DOUBLE / before * 100 AS percent FROM s)
SELECT step, filter, before, after, removed, round(percent, 4) AS percent, CASE WHEN percent < 10 THEN 'low' WHEN percent < 40 THEN 'medium' WHEN percent < 80 THEN 'high' ELSE 'very high' END AS selectivity FROM p""")
def filter_impact(spark, d):
    f = observe.filter_impact(read(spark, d, "documents"), [Filter("lang", "eq", "en"), Filter("n_chars", "range", low=1000)])
    return f.withColumn("percent", F.round("percent", 4))


@query("SELECT min(ts) AS min_ts, max(ts) AS max_ts FROM events")
def date_ranges(spark, d):
    return observe.date_ranges(read(spark, d, "events"), ["ts"])


@query("SELECT count(*) AS documents, count(DISTINCT lang) AS languages, sum(n_chars)::BIGINT AS chars FROM documents")
def doc_count(spark, d):
    return read(spark, d, "documents").agg(F.count("*").alias("documents"), F.countDistinct("lang").alias("languages"), F.sum("n_chars").alias("chars"))


@query("SELECT unnest(['doc_id', 'lang', 'n_chars', 'source', 'text', 'text_translit']) AS field")
def field_list(spark, d):
    """Stored and indexed fields, read off a stored index."""
    e = search.Engine(stored(spark, d, "text_translit").open())
    return spark.createDataFrame([(n,) for n in e.field_names()], "field string")


@query("SELECT doc_id, lang, substring(text, 1, 500000) AS content, length(text) > 500000 AS truncated, length(text)::INT AS original_length FROM documents WHERE doc_id = 17")
def point_lookup(spark, d):
    doc = search.Engine(index.Index(read(spark, d, "documents"), None)).get(17)
    rows = [(doc["doc_id"], doc["lang"], doc["text"], doc["truncated"], doc["original_length"])] if doc else []
    return spark.createDataFrame(rows, "doc_id long, lang string, content string, truncated boolean, original_length int")


@query("SELECT doc_id FROM documents WHERE source = 'src3' ORDER BY doc_id LIMIT 1000")
def lookup_by_field(spark, d):
    return search.Engine(index.Index(read(spark, d, "documents"), None)).keys_by_field("source", "src3")


# -- vectors

_VEC = "v AS (SELECT vec_id, label, list_dot_product(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7)) AS c FROM embeddings)"
_TOP = f"{_VEC}, k AS (SELECT *, row_number() OVER (ORDER BY c DESC, vec_id) AS rank FROM v ORDER BY c DESC, vec_id LIMIT 50)"


def _vectors(spark, d):
    e = read(spark, d, "embeddings")
    return e, list(e.where("vec_id = 7").select("embedding").first()[0])


@query(f"WITH {_TOP} SELECT vec_id, rank::INT AS rank, round(c, 6) AS cosine FROM k")
def knn_top50(spark, d):
    e, v = _vectors(spark, d)
    return semantic.nearest(e, v).select("vec_id", "rank", F.round("cosine", 6).alias("cosine"))


@query(f"WITH {_TOP} SELECT vec_id, rank::INT AS rank, round(c, 6) AS cosine, round((1 + c) / 2, 6) AS score, (1 + c) / 2 >= (1 + 0.3) / 2 AS passed FROM k")
def semantic_profile(spark, d):
    e, v = _vectors(spark, d)
    return semantic.profile(e, v, 0.3).withColumn("cosine", F.round("cosine", 6)).withColumn("score", F.round("score", 6))


@query(f"WITH {_TOP} SELECT label, round(max(c), 6) AS best, count(*) AS n_chunks FROM k WHERE (1 + c) / 2 >= (1 + 0.1) / 2 GROUP BY label ORDER BY max(c) DESC, label LIMIT 10")
def knn_threshold_grouped(spark, d):
    e, v = _vectors(spark, d)
    return semantic.search(e, v, "label", 0.1).select("label", F.round("best", 6).alias("best"), "n_chunks")


@query(f"WITH {_TOP}, g AS (SELECT label, max(c) AS b, count(*) AS n_chunks FROM k WHERE c >= 0 GROUP BY label ORDER BY b DESC, label LIMIT 10) SELECT label, round(b, 6) AS best, n_chunks FROM g WHERE label % 2 = 0")
def semantic_post_filter(spark, d):
    e, v = _vectors(spark, d)
    return semantic.search(e, v, "label", 0.0, post_filter=F.col("label") % 2 == 0).select("label", F.round("best", 6).alias("best"), "n_chunks")


@query(f"WITH {_TOP} SELECT label, round(max(c), 6) AS best, count(*) AS n_chunks FROM k WHERE c >= 0 GROUP BY label ORDER BY max(c) DESC, label LIMIT 3 OFFSET 3")
def semantic_paged(spark, d):
    e, v = _vectors(spark, d)
    return semantic.search(e, v, "label", 0.0, page=1, page_size=3).select("label", F.round("best", 6).alias("best"), "n_chunks")


# -- metadata, reconciliation, change streams

@query("SELECT d.doc_id, l.quality AS dbmeta_quality, l.toxic AS dbmeta_toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def metadata_enrich_left_join(spark, d):
    return metadata.enrich(read(spark, d, "documents").select("doc_id"), read(spark, d, "labels"), "doc_id", ["quality"])


@query("""SELECT event_id, 'dbmeta_k' AS name, 'LONG' AS type, json_extract_string(props, '$.k') AS value FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL""")
def metadata_json_parse(spark, d):
    e = read(spark, d, "events")
    payload = F.concat(F.lit('{"fields":[{"name":"k","type":"LONG","value":"'), F.get_json_object("props", "$.k"), F.lit('"}]}'))
    f = e.where(F.get_json_object("props", "$.k").isNotNull()).select("event_id", F.explode(metadata.parse_fields(payload)).alias("f"))
    return f.select("event_id", "f.name", "f.type", F.element_at("f.values", 1).alias("value"))


@query("""WITH c AS (SELECT DISTINCT source FROM documents WHERE doc_id < 3), m AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents JOIN c USING (source))
SELECT doc_id, source FROM m WHERE r <= 1000""")
def metadata_affected(spark, d):
    docs = read(spark, d, "documents")
    return metadata.affected(docs, docs.where("doc_id < 3"), "source").select("doc_id", "source")


def _listings(spark, d):
    docs = read(spark, d, "documents")
    now = docs.where("lang <> 'fr'").select("doc_id", (F.col("n_chars") + F.when(F.col("source") == "src5", 1).otherwise(0)).alias("modified_date"))
    return now, docs.where("lang <> 'es'").select("doc_id", F.col("n_chars").alias("modified_date"))


_REC = "CASE WHEN lang = 'es' THEN 'add' WHEN lang = 'fr' THEN 'delete' WHEN source = 'src5' THEN 'update' ELSE 'unchanged' END"


@query(f"SELECT doc_id, {_REC} AS action FROM documents")
def reconcile_actions(spark, d):
    return ingest.reconcile(*_listings(spark, d))


@query(f"SELECT {_REC} AS action, count(*) AS n FROM documents GROUP BY ALL")
def reconcile_counts(spark, d):
    return ingest.reconcile(*_listings(spark, d)).groupBy("action").agg(F.count("*").alias("n"))


@query("SELECT doc_id FROM documents WHERE lang = 'fr'")
def orphans_anti(spark, d):
    return ingest.reconcile(*_listings(spark, d)).where("action = 'delete'").select("doc_id")


@query("SELECT doc_id, lang FROM documents WHERE lang = 'es' OR (lang <> 'fr' AND source = 'src5')")
def changed_semi(spark, d):
    todo = ingest.reconcile(*_listings(spark, d)).where("action IN ('add', 'update')")
    return read(spark, d, "documents").join(todo, "doc_id", "left_semi").select("doc_id", "lang")


@query("""WITH r AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) SELECT user_id, event_id, event_type FROM r WHERE k = 1""")
def debounce_last_wins(spark, d):
    return watch.last_wins(read(spark, d, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


@query("SELECT event_id, user_id FROM events WHERE ts > TIMESTAMP '2024-01-20 00:00:00'")
def sync_since_watermark(spark, d):
    from datetime import datetime

    return metadata.changed_since(read(spark, d, "events"), datetime(2024, 1, 20), "ts").select("event_id", "user_id")


@query("SELECT time_bucket(INTERVAL '1 day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def windowed_event_counts(spark, d):
    return watch.windowed_counts(read(spark, d, "events"), "1 day").withColumn("total", F.round("total", 4))


# -- run-time statistics, crawl statistics

@query("SELECT count(*) AS n, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high, " + ", ".join(f"quantile_disc(value, {p / 100}) AS p{p}" for p in (50, 75, 90, 95, 99)) + " FROM events")
def runtime_percentiles(spark, d):
    p = [F.expr(f"percentile_disc({k / 100}) WITHIN GROUP (ORDER BY value)").alias(f"p{k}") for k in (50, 75, 90, 95, 99)]
    return read(spark, d, "events").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"), *p)


@query("""SELECT coalesce(source, 'none') AS folder, count(*) AS found, count(*) FILTER (length(trim(coalesce(text, ''), ' \t\n\r')) > 0) AS indexed, 0::BIGINT AS failed, sum(strlen(coalesce(text, '')))::BIGINT AS bytes FROM documents GROUP BY ALL
UNION ALL SELECT 'broken', count(*), 0, count(*), sum(strlen(coalesce(text, '')))::BIGINT FROM documents""")
def crawl_stats_by_source(spark, d):
    """Documents as text files in a folder for each source, and once more as files of a format that nothing extracts."""
    body = F.coalesce("text", F.lit("")).cast("binary").alias("content")
    docs = read(spark, d, "documents")
    files = docs.select(F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), "doc_id", F.lit(".txt")).alias("path"), body)
    files = files.unionByName(docs.select(F.concat(F.lit("broken/"), "doc_id", F.lit(".xyz")).alias("path"), body)).withColumn("length", F.octet_length("content").cast("long"))
    return ingest.crawl_statistics(files, ingest.extract(files), 1.0).select("folder", "found", "indexed", "failed", "bytes")


# -- scalar functions

@query("SELECT doc_id, sha256(coalesce(text, '')) AS content_hash FROM documents")
def content_hash(spark, d):
    return read(spark, d, "documents").select("doc_id", tx.content_hash(F.col("text")).alias("content_hash"))


@query(r"SELECT page_id, lower(nullif(regexp_extract(regexp_extract(url, '[^/]*$'), '^.+\.([^.]+)$', 1), '')) AS extension FROM pages")
def extension_of_url(spark, d):
    return read(spark, d, "pages").select("page_id", tx.file_extension(F.col("url")).alias("extension"))


@query("""WITH c AS (SELECT doc_id, coalesce(text, '') AS s, length(coalesce(text, '')) // 4 AS k FROM documents), i AS (SELECT unnest(range(4)) AS i)
SELECT doc_id, i::INT AS chunk_index, CASE WHEN i = 3 THEN substring(s, i * k + 1) ELSE substring(s, i * k + 1, k) END AS chunk_text, (i / 3)::FLOAT AS chunk_position FROM c, i""")
def chunk_split(spark, d):
    c = read(spark, d, "documents").select("doc_id", F.posexplode(tx.chunk_split(F.col("text"), 4)).alias("chunk_index", "chunk_text"))
    return c.withColumn("chunk_position", tx.chunk_position(F.col("chunk_index"), F.lit(4)))


def _tokens_sql(folded: str, each: str = "t") -> str:
    return rf"WITH k AS (SELECT doc_id, regexp_extract_all({folded}, '[\p{{L}}\p{{N}}]+') AS t FROM documents) SELECT doc_id, array_to_string({each}, ' ') AS tokens FROM k"


@query(_tokens_sql(FOLDED))
def folded_tokens(spark, d):
    return read(spark, d, "documents").select("doc_id", F.array_join(tx.tokens(F.col("text")), " ").alias("tokens"))


@query(_tokens_sql(FOLDED, "list_transform(t, lambda w: reverse(w))"))
def reversed_tokens(spark, d):
    return read(spark, d, "documents").select("doc_id", F.array_join(tx.reversed_tokens(F.col("text")), " ").alias("tokens"))


@query(_tokens_sql(DIGRAPHS))
def digraph_tokens(spark, d):
    return read(spark, d, "documents").select("doc_id", F.array_join(tx.digraph_tokens(F.col("text")), " ").alias("tokens"))


@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(html, '[\x00-\x08\x0B\x0C\x0E-\x1F\x{200B}-\x{200D}\x{FEFF}\x{FFFD}]', '', 'g'), '\s{2,}', ' ', 'g')) AS cleaned FROM pages")
def text_clean(spark, d):
    return read(spark, d, "pages").select("page_id", tx.clean(F.col("html")).alias("cleaned"))


@query()
def normalize_content(spark, d):
    return read(spark, d, "pages").select("page_id", tx.normalize_content("html").alias("content"))


@query()
def html_extract(spark, d):
    files = read(spark, d, "pages").select(F.concat(F.lit("page-"), F.col("page_id"), F.lit(".html")).alias("path"), F.col("html").cast("binary").alias("content"))
    return ingest.extract(files).select("path", "content", F.col("metadata")["title"].alias("title"), "file_type")


def _detected_sql() -> str:
    words = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS lang, len(list_filter(w, lambda x: x IN ({', '.join(repr(x) for x in v.split())}))) AS n FROM w" for k, v in tx.PROFILE.items())
    return rf"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(substring(coalesce(text, ''), 1, 10000)), '[\p{{L}}]+') AS w FROM documents), c AS ({words}),
r AS (SELECT doc_id, list(lang ORDER BY n DESC, lang DESC) AS l, list(n ORDER BY n DESC, lang DESC) AS n FROM c GROUP BY doc_id)
SELECT doc_id, CASE WHEN n[1] >= 3 AND n[1] * 2 >= n[2] * 3 THEN l[1] END AS detected FROM r"""


@query(_detected_sql())
def language_detection(spark, d):
    return read(spark, d, "documents").select("doc_id", tx.language(F.coalesce("text", F.lit(""))).alias("detected"))


@query()
def hit_passages(spark, d):
    """Passages of the best hits: made on one page of results alone."""
    idx = corpus(spark, d)
    top = ranked(idx, "license version", 10)
    return idx.documents.join(F.broadcast(top), "doc_id").select("doc_id", F.explode(passages.passages_udf(["license", "version"])("text")).alias("p")).select("doc_id", "p.text", "p.score", "p.coverage", "p.position")


@query()
def lemma_dictionary(spark, d):
    """Lemmas of the distinct terms."""
    return corpus(spark, d).terms().select("term", tx.lemma_column(F.col("term"), "en").alias("lemma_en"), tx.lemma_column(F.col("term"), "de").alias("lemma_de"))
