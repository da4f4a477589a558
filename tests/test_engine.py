from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sparrowdex.operators import facets, index, observe, passages, query, score, semantic
from sparrowdex.operators.filters import Fields, Filter, combined, parse_date, validate
from sparrowdex.operators.search import Engine
from sparrowdex.sources import ingest, metadata
from sparrowdex.streaming import watch

DOCS = [
    (1, "The contract was signed by both parties.", "en", "a", 40),
    (2, "Both parties run; the runner ran by the house.", "en", "b", 46),
    (3, "Der Vertrag im Haus mit Garten wurde unterzeichnet.", "de", "a", 51),
    (4, "Ein Haus. Verträge für Müller.", "de", None, 30),
    (5, None, None, "b", None),
]


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, lang string, source string, n_chars long")
    s = index.Store(spark, "file://" + str(tmp_path_factory.mktemp("index")))
    assert s.needs_rebuild()
    s.commit(index.build(docs))
    return s


@pytest.fixture(scope="module")
def engine(store):
    return Engine(store.open())


def found(engine, text):
    return [r[0] for r in score.compile(engine.index, query.rewrite(query.parse(text))).orderBy("doc_id").collect()]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("haus", [3, 4]), ("Haus AND Garten", [3]), ("parties NOT contract", [2]), ('"signed by both"', [1]), ('"both parties"', [1, 2]), ('"parties both"~1', []),
        ('"signed parties"~2', [1]), ("contr*", [1]), ("vertr*", [3, 4]), ("*trag", [3]), ("ve?trag", [3]), ("contrakt~1", [1]), ("lang:de AND haus", [3, 4]), ("n_chars:[45 TO *]", [2, 3]), ("+haus -garten", [4]), ("-haus", []), ("nothing", []), ("muller", [4]),
    ],
)
def test_matching(engine, text, want):
    assert found(engine, text) == want


def test_lemma_and_transliteration_fields(engine):
    ids = lambda text: {r[0] for r in score.multi_field(engine.index, query.parse(text)).collect()}
    assert ids("ran") == {2} and ids("Mueller") == {4} and ids("vertrag") == {3, 4}


def test_multifield_lemmas_against_all_four_fields(spark, tmp_path):
    from math import log

    from sparrowdex.functions.text import digraph_str, lemma
    from sparrowdex.plans import catalogue

    rows = [(1, "the license of the house", "en"), (2, "many licenses and a licens here", "en"), (3, "Die Licens im Haus", "de"), (4, "nothing of the kind", "en"), (5, None, "fr"), (6, "licenses licensed license", "de")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    share = {k: 0.3 + 0.7 * sum(r[2] == k for r in rows) / len(rows) for k in ("de", "en")}
    want: dict = {}
    for boost, change in ((2.0, lambda w: w), (share["de"], lambda w: lemma(w, "de")), (share["en"], lambda w: lemma(w, "en")), (0.5, digraph_str)):
        docs = {d: [change(w) for w in t.lower().split()] for d, t, _ in rows if t}
        n, avg, term = len(docs), sum(map(len, docs.values())) / len(docs), change("licenses")
        df = sum(term in w for w in docs.values())
        for d, w in docs.items():
            if tf := w.count(term):
                want[d] = want.get(d, 0.0) + boost * log(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (1 - 0.75 + 0.75 * len(w) / avg))
    got = {r["doc_id"]: r["score"] for r in catalogue.QUERIES["multifield_lemmas"](spark, str(tmp_path)).collect()}
    assert set(got) == set(want) and all(abs(got[d] - want[d]) < 2e-6 for d in want)


def test_lemma_fields_take_one_pass_without_python(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, lang string, source string, n_chars long")
    for rows in (index.build(docs).postings, index.build(docs).postings.where(F.col("term").isin("run", "haus"))):
        plan = rows._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
        assert "Python" not in plan and "Join" not in plan and plan.count("Exchange ") == 1
    fields = {r[0]: r[1] for r in index.build(docs).postings.where("term = 'haus'").groupBy("field").agg(F.sum("tf")).collect()}
    assert fields == {"text": 2, "text_translit": 2, "text_lemma_de": 2}  # the English rules make hau of it


def test_page_facets_passages_actions(engine):
    p = engine.search("haus OR parties", page_size=2)
    assert p.total_hits == 4 and p.total_pages == 2 and p.has_next and not p.has_previous
    assert all("**" in d["passages"][0]["text"] for d in p.documents)
    assert {(x["dim"], x["value"]): x["n"] for x in p.facets}[("lang", "de")] == 2
    assert p.actions[0] == {"action": "nextPage", "page": 1}
    f = engine.search("haus OR parties", [Filter("lang", "eq", "de")])
    assert f.total_hits == 2 and f.active_filters[0]["matches"] == 2
    assert {(x["dim"], x["value"]): x["n"] for x in f.facets}[("lang", "en")] == 2  # its own filter does not count


def test_sorting(engine):
    assert [d["doc_id"] for d in engine.search(None, sort_by="n_chars", sort_order="asc").documents] == [5, 4, 1, 2, 3]
    assert [d["doc_id"] for d in engine.search(None, sort_by="dbmeta_none").documents] == [1, 2, 3, 4, 5]
    with pytest.raises(ValueError):
        engine.search(None, sort_by="nope")


def test_profile_and_lookups(engine):
    p = engine.profile("haus", [Filter("lang", "eq", "de")])
    assert p["metrics"]["matching"] == 2 and p["filters"][0]["after"] == 2 and p["terms"][0]["df"] == 2 and p["recommendations"]
    hits = [d for d in DOCS if d[0] in {r[0] for r in engine.plan("haus")[1].where("lang = 'de'").select("doc_id").collect()}]
    want = {d: (len({h[k] for h in hits} - {None, ""}), sum(h[k] not in (None, "") for h in hits)) for d, k in (("lang", 2), ("source", 3)) if d in engine.dims}
    assert want and {c["dim"]: (c["n_values"], c["n_hits"]) for c in p["facets"] if c["dim"] in want} == want and all(c["ms"] > 0 for c in p["facets"])
    assert engine.get(3)["truncated"] is False and engine.get(99) is None
    assert "text_lemma_de" in engine.field_names()
    n, top = observe.suggest_terms(engine.index, "part")
    assert n == 1 and top.first()["df"] == 2


def test_store_upsert_delete_compact(spark, tmp_path):
    s = index.Store(spark, "file://" + str(tmp_path))
    docs = spark.createDataFrame(DOCS[:3], "doc_id long, text string, lang string, source string, n_chars long")
    s.upsert(docs)
    s.upsert(spark.createDataFrame([(2, "new words", "en", "b", 9)], docs.schema))
    assert s.status()["documents"] == 3 and found(Engine(s.open()), "words") == [2] and found(Engine(s.open()), "runner") == []
    s.delete(spark.createDataFrame([(1,)], "doc_id long"))
    s.compact(1)
    assert found(Engine(s.open()), "contract") == [] and s.status()["documents"] == 2
    s.purge()
    assert s.status()["documents"] == 0


def test_filters():
    for f in (Filter(""), Filter("lang", "like", "x"), Filter("text", "eq", "x"), Filter("lang", "eq"), Filter("lang", "in"), Filter("lang", "range", low=1), Filter("n_chars", "range")):
        with pytest.raises(ValueError):
            validate(f)
    assert parse_date("2024-01-15") == datetime(2024, 1, 15) and parse_date("2024-01-15T10:00:00+02:00") == datetime(2024, 1, 15, 8)


def test_negation_keeps_missing(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, text string, lang string, source string, n_chars long")
    assert [r[0] for r in df.where(combined([Filter("lang", "not", "en")])).orderBy("doc_id").collect()] == [3, 4, 5]
    assert facets.sideways_facets(df, [], ["lang"]).count() == 2


def test_passages():
    p = passages.passages("One cat. Two cats and a dog. A dog.", ["dog", "cats"])
    assert p[0]["text"].endswith("Two **cats** and a **dog**.") and p[0]["coverage"] == 1.0 and p[0]["score"] == 1.0
    assert passages.passages("Nothing here", ["x"])[0]["score"] == 0.0 and passages.passages(None, ["x"]) == []
    assert passages.mark("abcdef", [(0, 3), (2, 4)]) == "**abcd**ef"
    t = passages.truncate("x " * 100 + "**hit** " + "y " * 100, 60)
    assert "**hit**" in t and t.startswith("...") and t.endswith("...") and len(t) <= 66


def test_semantic(spark):
    rows = [(1, [1.0, 0.0], 1), (2, [0.8, 0.6], 1), (3, [0.0, 1.0], 2), (4, [-1.0, 0.0], 3)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = semantic.search(e, [1.0, 0.0], "label", 0.7).collect()
    assert [(r["label"], r["n_chunks"]) for r in got] == [(1, 2)]
    assert [r["passed"] for r in semantic.profile(e, [1.0, 0.0], 0.0).orderBy("rank").collect()] == [True, True, True, False]
    with pytest.raises(ValueError):
        semantic.check_threshold(1.5)
    c = semantic.chunk_documents(spark.createDataFrame([(1, "a b c d")], "doc_id long, text string"), semantic.hashing_embedder(8), 4)
    assert [r["chunk_position"] for r in c.orderBy("chunk_index").collect()] == [0.0, 1.0]


def test_runtime_stats():
    s = observe.RuntimeStats()
    for k in range(1, 101):
        s.record(k, k, 1.0, {"lang": 2.0})
    x = s.summary()
    assert (x["p50"], x["p99"], x["min"], x["max"], x["facets"]["lang"]) == (50, 99, 1, 100, 2.0)


def test_ingest(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text("the cat and the dog of the house")
    (tmp_path / "sub" / "b.html").write_text("<title>T</title><p>Hello</p>")
    (tmp_path / "c.txt").write_text(" ")
    (tmp_path / "d.bin").write_text("x")
    (tmp_path / "m.eml").write_text("Subject: S\nFrom: x@example.org\n\nBody")
    files = ingest.scan(spark, "file://" + str(tmp_path))
    ex = ingest.extract(files).cache()
    docs = {r["file_name"]: r for r in ingest.documents(files, ex).collect()}
    assert set(docs) == {"a.txt", "b.html", "m.eml"} and docs["b.html"]["title"] == "T" and docs["a.txt"]["lang"] == "en" and docs["m.eml"]["author"] == "x@example.org"
    assert ingest.empty_files(ex).count() == 1
    stats = ingest.crawl_statistics(files, ex, 1.0).agg(F.sum("found"), F.sum("indexed"), F.sum("empty")).first()
    assert tuple(stats) == (4, 3, 1)


def test_metadata(spark):
    assert metadata.sql_template("SELECT a::int FROM t WHERE x = :file_path AND y = ':no' AND z > :n") == ("SELECT a::int FROM t WHERE x = ? AND y = ':no' AND z > ?", ["file_path", "n"])
    p = '{"fields":[{"name":"k","type":"INT","value":"7"},{"name":"bad","type":"INT","value":"x"},{"name":"t","type":"KEYWORD","values":["a","b"],"faceted":true}]}'
    got = spark.createDataFrame([(p,)], "p string").select(metadata.parse_fields(F.col("p")).alias("f")).first()["f"]
    assert [(f["name"], f["values"], f["faceted"]) for f in got] == [("dbmeta_k", ["7"], False), ("dbmeta_t", ["a", "b"], True)]
    with pytest.raises(ValueError):
        metadata.parse_strict('{"x": 1}')
    docs = spark.createDataFrame([(1, "x"), (2, "y")], "doc_id long, path string")
    rows = spark.createDataFrame([("x", 2, datetime(2024, 1, 2)), ("x", 1, datetime(2024, 1, 1))], "path string, rank int, updated_at timestamp")
    assert [r["dbmeta_rank"] for r in metadata.enrich(docs, rows, "path", ["rank"]).orderBy("doc_id").collect()] == [1, None]
    hit, mark, info = metadata.sync(docs, rows, datetime(2024, 1, 1), "path")
    assert info == {"changed": 1, "documents": 1} and mark == datetime(2024, 1, 2)
    assert metadata.sync(docs, rows, mark, "path")[1] == mark


def test_stream_last_event_wins(spark, tmp_path):
    import json

    (tmp_path / "in").mkdir()
    events = [{"path": "a.txt", "type": "CREATE_OR_MODIFY", "seq": 1}, {"path": "a.txt", "type": "DELETE", "seq": 2}, {"path": "b.txt", "type": "CREATE_OR_MODIFY", "seq": 3}, {"path": "c.exe", "type": "CREATE_OR_MODIFY", "seq": 4}]
    (tmp_path / "in" / "1.json").write_text("\n".join(map(json.dumps, events)))
    store = index.Store(spark, "file://" + str(tmp_path / "index"))
    load = lambda paths: paths.select("doc_id", F.lit("some words").alias("text"), F.lit("en").alias("lang"))
    watch.watch(spark, str(tmp_path / "in"), store, load, str(tmp_path / "cp")).awaitTermination(120)
    assert [r[0] for r in store.open().documents.select("doc_id").collect()] == ["b.txt"]


def test_fields_defaults():
    assert {"lang", "source", "n_chars"} <= Fields().known
