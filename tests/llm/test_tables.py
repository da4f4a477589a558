"""Mixing, the quality classifier and the pipeline."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparrowdex.llm import mixing, pieces, quality_model, secrets, simhash


def water_fill(sizes, weights):
    total, capped = sum(sizes.values()), set()
    while True:
        left, open_ = total - sum(3 * sizes[s] for s in capped), sum(weights[s] for s in sizes if s not in capped)
        t = {s: 3 * sizes[s] if s in capped else left * weights[s] / open_ for s in sizes}
        over = {s for s in sizes if s not in capped and t[s] > 3 * sizes[s]}
        if not over:
            return t
        capped |= over


def test_permutation(spark):
    for n in (1, 2, 3, 7, 64, 1000):
        df = spark.range(n).select("id", mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit("s")).alias("p"))
        df = df.withColumn("back", mixing.permuted(F.col("p"), F.lit(n).cast("long"), F.lit("s"), inverse=True))
        rows = df.collect()
        assert sorted(r["p"] for r in rows) == list(range(n)) and all(r["back"] == r["id"] for r in rows)


def test_mix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 7)
    rng = random.Random(1)
    sources = ["b", "a", "é", None, "", "null", "\x00null", "tiny", "\U0001f600", "￿"]
    rows = [(k, " ".join(["w"] * rng.randrange(0, 400)), "tiny" if k == 5 else rng.choice([s for s in sources if s != "tiny"] + ["b"] * 6)) for k in range(150)]
    rows[5] = (5, "w " * 90, "tiny")
    rows += [(200, None, "a"), (7, rows[7][1], rows[7][2]), (7, rows[7][1], rows[7][2]), (None, "x y z", "b"), (201, "long " * 50_000, "a"), (202, "", "void")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for c in ("row", "doc", "id", "h", "size", "block", "_b", "_p_x"):  # columns named like ours
        df = df.withColumn(c, F.lit(1))
    df.write.mode("overwrite").parquet(path := spark.conf.get("spark.checkpoint.dir") + "/mix/documents.parquet")
    got = mixing.op3_source_mix(spark, path.rsplit("/", 1)[0]).collect()
    assert len(got) == len(rows) and all(r["taken"] <= 3 * r["size"] for r in got)
    sizes, by_doc = Counter(), {}
    for d, t, s in rows:
        sizes[s] += len((t or "").split())
        by_doc[d] = s
    order = sorted((s for s in sizes if s is not None), key=lambda s: s) + [None]
    want = water_fill(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)})
    taken = Counter()
    for r in got:
        s = by_doc[r["doc_id"]]
        assert r["source_size"] == sizes[s] and abs(r["target"] - want[s]) < 1e-6 * max(1, want[s])
        taken[s] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= mixing.BLOCK for s in sizes)
    again = mixing.op3_source_mix(spark, path.rsplit("/", 1)[0]).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["taken"])
    assert sorted(map(tuple, sorted(got, key=key)), key=str) == sorted(map(tuple, sorted(again, key=key)), key=str)


def test_mix_of_nothing(spark):
    path = spark.conf.get("spark.checkpoint.dir") + "/none"
    spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string").write.mode("overwrite").parquet(path + "/documents.parquet")
    assert sorted(tuple(r) for r in mixing.op3_source_mix(spark, path).select("doc_id", "size", "target", "taken").collect()) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]


def test_slots_take_each_block_once_a_pass(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD", 16)
    monkeypatch.setattr(mixing, "RANGE", 32)
    monkeypatch.setattr(mixing, "RUN", 2)
    goal = mixing.targets(spark.createDataFrame([("a", 1000), ("b", 3000), (None, 50_000), ("", 700)], "source string, source_size long"))
    plan = mixing.plan(goal)
    want = {r["source"]: r["n_slots"] for r in plan.collect()}
    out = mixing.slots(spark, plan).collect()
    total = sum(want.values())
    assert sorted(r["shard"] * 16 + r["place"] for r in out) == list(range(total))
    assert Counter(r["source"] for r in out) == want
    assert max(Counter((r["source"], r["pass"], r["block"]) for r in out).values()) == 1
    # draws with replacement: shard counts scatter as multinomial ones do, and few slots are not as drawn
    drawn = {r["slot"]: r["source"] for r in mixing.draws(spark, plan, total).collect()}
    assert len(drawn) == total
    assert sum(drawn[r["shard"] * 16 + r["place"]] != r["source"] for r in out) <= 4 * total**0.5
    p = want[None] / total
    of = Counter(s // 16 for s, x in drawn.items() if x is None and s < total // 16 * 16)
    counts = np.array([of[k] for k in range(total // 16)])
    assert abs(counts.mean() - 16 * p) < 4 * (16 * p * (1 - p) / len(counts)) ** 0.5
    assert 0.6 < counts.var() / (16 * p * (1 - p)) < 1.5


def test_label_model_and_scorer():
    good = b"The quick brown fox and the lazy dog were in the garden of the house. It was a day for a walk to the river with them. " * 1
    bad = [b"A | b | c | d | e | f | g | h | i | j | k | l | m | n | o | p | q | r | s | t | u | v", b"word " * 60, b"SHOUT!! THIS!! NOW!! " * 12, b"x*** y&&& z### q$$$ " * 10]
    assert -1 not in quality_model.votes(good, good.split())
    assert all(-1 in quality_model.votes(b, b.split()) for b in bad)
    code = lambda t: sum((v + 1) * 3**k for k, v in enumerate(quality_model.votes(t, t.split())))
    post = quality_model.label_model({code(good): 900, **{code(b): 25 for b in bad}})
    assert post[code(good)] > 0.9 and all(post[code(b)] < 0.2 for b in bad)
    w, bias = quality_model.fit_scorer([(quality_model.features(t, t.split()), post[code(t)]) for t in [good, *bad]])
    score = lambda t: sum(w[k] * v for k, v in quality_model.features(t, t.split()).items()) + bias
    assert score(good) > 0 > max(map(score, bad))
    assert quality_model.label_model({}) == {}


def test_accuracies_are_estimated(spark):
    """Planted labellers: votes drawn with known chances; the estimates come near them, and far from where all begin."""
    rng = random.Random(5)
    m, counts, alarms, hits = len(quality_model.LABELLERS), {}, [0, 0.004, 0, 0.001, 0, 0.002, 0, 0.006], [0.8, 0.3, 0.5, 0.6, 0.2, 0.7, 0.9, 0.4]
    for k in range(40_000):
        chance = hits if k % 8 == 0 else alarms
        code = sum((0 if rng.random() < chance[j] else 2) * 3**j for j in range(m))
        counts[code] = counts.get(code, 0) + 1
    _, alarm, hit, share = quality_model.estimate(counts)
    assert abs(share - 0.875) < 0.01 and max(abs(a - b) for a, b in zip(alarm, alarms, strict=True)) < 0.004 and max(abs(a - b) for a, b in zip(hit, hits, strict=True)) < 0.05
    df = spark.createDataFrame([(1, "word " * 60, "k"), (2, None, "k"), (2, None, None)], "doc_id long, text string, labeller string")
    got = {r["labeller"]: r for r in quality_model.accuracies(df).collect()}
    assert list(got) == list(quality_model.LABELLERS) and got["stutter"]["n_bad"] == 1 and got["capitals"]["n_votes"] == 1
    assert quality_model.accuracies(df.limit(0)).where("n_votes > 0").count() == 0


def test_classifier_table(spark):
    df = spark.createDataFrame([(1, None, "k"), (2, "", "k"), (2, "", "k"), (3, "word " * 500, None)], "doc_id long, text string, quality string")
    got = quality_model.classified(df)
    assert got.columns == [*df.columns, "quality_score", "quality_kept"] and got.count() == 4 and got.where("doc_id < 3 AND NOT quality_kept").count() == 0
    assert quality_model.classified(df.limit(0)).count() == 0


def test_classifier_against_labels(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = quality_model.op7_quality_classifier(spark, d).join(labels, "doc_id").groupBy("quality", "kept").count().collect()
    n = {(r["quality"], r["kept"]): r["count"] for r in got}
    assert n.get((1, False), 0) <= 0.01 * n[1, True] and n.get((0, True), 0) <= 0.15 * n[0, False]


def test_classifier_decides_on_short_texts(spark):
    d = "/root/testdata/sf0.1"
    short = spark.read.parquet(f"{d}/documents.parquet").where("size(split(trim(text), '\\\\s+')) < 17").select("doc_id").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
    got = quality_model.op7_quality_classifier(spark, d).join(short, "doc_id").groupBy("quality", "kept").count().collect()
    n = {(r["quality"], r["kept"]): r["count"] for r in got}
    assert n[0, False] >= 2 * n.get((0, True), 0) and n.get((1, False), 0) <= 0.02 * n[1, True]


CLASHES = ["doc", "row", "key", "head", "n", "h", "id", "blob", "spans", "words", "new", "runs", "quality_score", "quality_kept", "_n", "_h", "_words", "_blob", "_spans", "ids", "n_tokens", "a.b"]


def pipeline_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    docs = docs.unionByName(docs.limit(3)).unionByName(docs.limit(2).withColumn("text", F.lit(None).cast("string")).withColumn("doc_id", F.col("doc_id") + 1000))
    odd = spark.createDataFrame([(None, "one text of its own about a river and the sea, password = 'hunter2hunter2' and more of it", None, None), (5000, "", "en", ""), (5000, "one id, two texts: the garden of the house lies by the river in the sun", None, "")], "doc_id long, text string, lang string, source string")
    docs = docs.unionByName(odd.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)))
    for k, c in enumerate(CLASHES):
        docs = docs.select("*", F.lit(k).alias(c))
    return docs


def test_pipeline_stage_by_stage(spark):
    """Each stage against plain Python on what its predecessor wrote, with columns named like those that stages use."""
    cp = pytest.importorskip("corpus_pipeline")
    d = "/root/testdata/sf0.001"
    docs = pipeline_documents(spark)
    columns, folder = docs.columns, spark.conf.get("spark.checkpoint.dir") + "/test-pipeline"
    rows = [docs.collect()]
    for name, stage in cp.STAGES:
        stage(spark, docs, d).write.mode("overwrite").parquet(f"{folder}-{name}")
        docs = spark.read.parquet(f"{folder}-{name}")
        rows.append(docs.collect())
        assert name == "sentencepiece" or docs.columns == columns, name
        for k, c in enumerate(CLASHES):
            at = c + "_before" if name == "sentencepiece" and c in ("id", "ids", "n_tokens") else c
            assert {r[at] for r in rows[-1]} <= {k}, (name, c)
    start, kept, heads, clean, mix, encoded = rows
    key = lambda r: (r["doc_id"], r["text"], r["lang"], r["source"])
    # quality: by the classifier's own verdicts, text by text
    verdict = {r["text"]: r["quality_kept"] for r in quality_model.classified(spark.createDataFrame([(r["doc_id"], r["text"]) for r in start], "doc_id long, text string")).collect()}
    assert Counter(map(key, kept)) == Counter(key(r) for r in start if verdict[r["text"]])
    # near-dedup: groups by all pairs of fingerprints
    order = sorted(kept, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
    fps = [simhash.simhash((r["text"] or "").encode()) for r in order]
    group = list(range(len(order)))
    for i in range(len(order)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    assert len(heads) == len(set(group))
    assert Counter(r["doc_id"] for r in heads) == Counter(order[g]["doc_id"] for g in set(group)) and not Counter(map(key, heads)) - Counter(map(key, kept))
    # secrets: cut out one by one
    def redacted(text):
        if text is None:
            return None
        merged = []
        for a, b in sorted((a, b) for _, a, b in secrets.scan_text(text)):
            if merged and a < merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        for a, b in reversed(merged):
            text = text[:a] + "[secret]" + text[b:]
        return text

    want = [(r["doc_id"], redacted(r["text"]), r["lang"], r["source"]) for r in heads]
    assert Counter(map(key, clean)) == Counter(want) and all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in clean)
    # the mix: each row is words of its document, each source near its target, no document more than three times
    sizes, took, words = Counter(), Counter(), Counter()
    for r in clean:
        sizes[r["source"]] += len((r["text"] or "").split())
        words[r["doc_id"], r["source"]] += len((r["text"] or "").split())
    for r in mix:
        n = len(r["text"].split())
        took[r["source"]] += n
        have = [Counter(x["text"].split()) for x in clean if x["doc_id"] == r["doc_id"] and x["text"]]
        assert any(not Counter(r["text"].split()) - h for h in have) and r["n_chars"] == len(r["text"])
    names = sorted((s for s in sizes if s is not None), key=lambda s: s) + [None] * (None in sizes)
    goal = water_fill({s: sizes[s] for s in names if sizes[s]}, {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)})
    assert all(abs(took[s] - goal[s]) <= mixing.BLOCK for s in goal)
    by = Counter()
    for r in mix:
        by[r["doc_id"], r["source"]] += len(r["text"].split())
    assert all(n <= 3 * words[k] for k, n in by.items())
    # ids: those of the segmenter, text by text
    import public_tokenizers

    m = pieces.model(public_tokenizers.path("piece_bpe_32k.model"))
    plain = Counter((r["doc_id"], r["text"], tuple(m.encode(r["text"]).tolist())) for r in mix)
    assert Counter((r["doc_id"], r["text"], tuple(r["ids"])) for r in encoded) == plain and all(r["exact"] for r in encoded)
    assert len(heads) < len(kept) < len(start)


def test_pipeline_of_an_empty_table(spark, tmp_path):
    cp = pytest.importorskip("corpus_pipeline")
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    assert cp.run(spark, f"file://{tmp_path}").count() == 0


def test_near_dedup_keeps_one_row_of_each_group(spark):
    cp = pytest.importorskip("corpus_pipeline")
    rng = np.random.default_rng(4)
    text = lambda: " ".join(f"w{x}" for x in rng.integers(0, 10**6, 200))
    a, b, c, d, e = (text() for _ in range(5))
    rows = [(1, a, None), (2, b, "x"), (2, c, "x"), (3, b, "y"), (None, d, None), (None, e, "x"), (None, e, "x"), (None, a, "x"), (5, d + " end", "x"), (0, c, None), (7, "", "x"), (7, "", "x"), (None, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted(((r["doc_id"], r["text"]) for r in cp.near_dedup(spark, df, "").collect()), key=str)
    near = bin((simhash.simhash(d.encode()) ^ simhash.simhash((d + " end").encode()))).count("1") <= simhash.RADIUS
    want = [(1, a), (2, b), (0, c), (None, e), (7, ""), (5, d + " end"), *([] if near else [(None, d)])]
    assert got == sorted(want, key=str)
    assert cp.near_dedup(spark, df.limit(0), "").count() == 0
