"""Near-duplicate operators and components against brute force."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sparrowdex.llm import embeddings, simhash
from sparrowdex.llm.common import connected_components


def roots(n, pairs):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(k) for k in range(n)]


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(300, 360)] + [(400, k) for k in range(401, 450)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame([*pairs, (5, None), (7, 7)], "a long, b long")).collect()}
    want = roots(450, pairs)
    assert got == {k: want[k] for k in {x for p in pairs if p[0] != p[1] for x in p}}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_masks_cover():
    masks = simhash.covering_masks()
    assert len(masks) == 7
    for i in range(64):
        for j in range(i, 64):
            assert any(not m & (1 << i | 1 << j) for m in masks)


def plain_fingerprint(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    grams = [" ".encode().join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_fingerprints():
    for t in ("", None, "one", "one two", "One TWO three four ÄÖ", "a\x0bb\x0c c\td" * 9, "x " * 200):
        assert simhash.simhash(t.encode() if t is not None else None) == plain_fingerprint(t)
    big = " ".join(str(k * 7919 % 1000) for k in range(70_000))
    assert simhash.simhash(big.encode()) == plain_fingerprint(big)


def test_near_pairs_small_and_large_buckets(spark):
    rng = random.Random(2)
    base = rng.getrandbits(64)
    fps = {rng.getrandbits(64) for _ in range(200)} | {base}
    for _ in range(120):  # one crowd about a fingerprint, and chains of two bits
        x = base
        for b in rng.sample(range(64), rng.randrange(1, 5)):
            x ^= 1 << b
        fps.add(x)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    rows = spark.createDataFrame(list(enumerate(signed)), "node long, fp long")
    want = roots(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2])
    for small in (4, 1000):
        edges = simhash.near_pairs(rows, small)
        assert all((fps[r["a"]] ^ fps[r["b"]]).bit_count() <= 2 for r in edges.collect())
        got = {r["node"]: r["root"] for r in connected_components(edges).collect()}
        assert [got.get(k, k) for k in range(len(fps))] == want


def test_near_duplicates_edge_cases(spark):
    rows = [(3, "a b c d", "x"), (1, "A b C d", "y"), (9, None, "z"), (8, "", "z"), (None, "a b c d", None), (3, "a b c d", "x"), (None, "only here", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")  # a column named like one of ours
    got = sorted(((r["id"] or 0, r["component_id"]) for r in simhash.near_duplicates(df).collect()), key=lambda g: (g[0], str(g[1])))
    assert [g for g in got if g[0]] == [(1, 1), (3, 1), (3, 1), (8, 8), (9, 8)]
    assert sorted(str(g[1]) for g in got if not g[0]) == ["1", "None"]
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def brute_vectors(vectors, t=0.95):
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for v in vectors]
    links = []
    for i in range(len(vectors)):
        for j in range(i):
            if ok[i] and ok[j] and len(vectors[i]) == len(vectors[j]):
                a, b = np.array(vectors[i], float), np.array(vectors[j], float)
                if a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= t:
                    links.append((i, j))
    n = [0] * len(vectors)
    for i, j in links:
        n[i] += 1
        n[j] += 1
    return n, roots(len(vectors), links)


def vectors_of_every_kind():
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(6, 16))
    v = [*rng.normal(size=(60, 16)), *(centre[k % 6] + rng.normal(size=16) * 0.12 for k in range(150)), *[centre[0]] * 20, *[centre[1] * 3.0] * 5]
    v = [[float(np.float32(y)) for y in x] for x in v]
    return v + [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 2.0], [2.0, 4.0]]


@pytest.mark.parametrize("kind", ["double", "float"])
def test_embeddings(spark, monkeypatch, kind):
    v = vectors_of_every_kind()
    n, root = brute_vectors(v)
    df = spark.createDataFrame([(k, x, "s", 1) for k, x in enumerate(v)], f"vec_id long, embedding array<{kind}>, node string, cell int")
    for tile, block in ((1 << 20, (1024, 4096)), (40 * 16 * 8, (16, 24))):
        monkeypatch.setattr(embeddings, "TILE_BYTES", tile)
        monkeypatch.setattr(embeddings, "BLOCK", block)
        monkeypatch.setattr(embeddings, "SAMPLE", 50)
        got = {r["id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_duplicates(df).collect()}
        assert got == {k: (n[k], root[k]) for k in range(len(v))} and sum(n) > 1000
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_embeddings_with_repeated_and_missing_ids(spark):
    v = [[1.0, 0.0], [0.0, 1.0], [0.99, 0.1], [0.01, 1.0], [0.0, 1.0], [-1.0, 0.0], [-1.0, 0.01], None]
    ids = [1, 1, 2, 3, None, None, None, None]
    n, root = brute_vectors(v)
    least = {}
    for k, r in enumerate(root):
        least[r] = min((x for x in (least.get(r), ids[k]) if x is not None), default=None)
    df = spark.createDataFrame([(i, x) for i, x in zip(ids, v)], "vec_id long, embedding array<double>")
    got = sorted(map(tuple, embeddings.near_duplicates(df).collect()), key=str)
    assert got == sorted(((ids[k], n[k], least[root[k]]) for k in range(len(v))), key=str)


def test_bounds_never_lose_a_link():
    rng = np.random.default_rng(4)
    a = embeddings._unit(rng.normal(size=(300, 64)) + 3)
    turn = np.linalg.eigh(a.T @ a)[1][:, ::-1]
    for t in (0.9, 0.95):
        got = {(x, y) for i, j in embeddings.linked(a, a, a @ turn, a @ turn, t, True) for x, y in zip(i.tolist(), j.tolist())}
        assert got == {(x, y) for x, y in zip(*np.nonzero(a @ a.T >= t)) if x < y}
    y = a @ turn
    boxes = np.array([np.concatenate([x[:, :4].min(0), x[:, :4].max(0), [embeddings._tails(x, 4).max()]]) for x in np.array_split(y[np.argsort(y[:, 1])], 10)])
    parts = np.array_split(np.argsort(y[:, 1]), 10)
    for k in range(10):
        near = set(embeddings.near_cells(boxes, boxes[k], 0.95).tolist())
        assert all(m in near for m in range(10) if (a[parts[k]] @ a[parts[m]].T >= 0.95).any())


def test_query_columns(spark):
    df = simhash.op10_simhash_near_dedup(spark, "/root/testdata/sf0.001")
    assert df.columns == ["doc_id", "fingerprint", "component_id"] and df.where(F.length("fingerprint") != 16).count() == 0
