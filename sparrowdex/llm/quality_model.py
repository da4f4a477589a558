"""Quality classifier: a weak-label model of overlapping heuristic labellers, whose posterior labels train a hashed linear scorer."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

#: Documents that the scorer is fitted on, at most: those with the smallest hashes. Everything else covers all documents.
FIT_DOCS = 4000
BUCKETS = 1 << 14
#: A document is kept if the probability that it is good is at least this.
KEEP = 0.3
#: What is believed beforehand of a labeller's chance to call a good document bad: its mean, and its weight in votes cast. Labellers are built to be
#: precise; with a belief that weighs less than the votes, the model takes the class that most labellers see for the good one's exceptions.
FALSE_ALARM, BELIEF = 0.002, 1.0

# Function words of four languages, for the labeller that looks for prose.
COMMON = frozenset(
    "the of and to in is that for it as was with be by on not he at this are or his from an they which you "
    "der die das und in zu den von mit ist des sich im dem nicht ein eine als auch es an auf für er so "
    "le la les de des et à en un une du que qui est dans pour il au sur pas plus par ne se "
    "el los las y del que se un por con no una su para al lo como más o pero sus le ya".encode().split()
)
_SHAPE = bytes(ord("a") if 97 <= c <= 122 or c >= 128 else ord("A") if 65 <= c <= 90 else ord("0") if 48 <= c <= 57 else c for c in range(256))
_RUN = re.compile(rb"(.)\1+", re.S)
_SYMBOLS, _UPPER, _LETTERS = re.compile(rb"[^#*$%&|<>~^=@{}\\]+"), re.compile(rb"[^A-Z]+"), re.compile(rb"[^A-Za-z\x80-\xff]+")


def _vote(value: float, good: float, bad: float) -> int:
    """+1 (good) up to `good`, -1 (bad) from `bad`, else no opinion. For measures where less is better."""
    return 1 if value <= good else -1 if value >= bad else 0


def votes(text: bytes, words: list[bytes]) -> tuple[int, ...]:
    """What each labeller says of one text: 1 good, -1 bad, 0 nothing. All abstain on texts of fewer than 5 words."""
    n = len(words)
    if n < 5:
        return (0,) * len(LABELLERS)
    letters = max(1, len(_LETTERS.sub(b"", text)))
    lines = [x for x in text.split(b"\n") if x.strip()]
    same = sum(map(eq, words, words[1:])) / n
    return (
        _vote(len(_SYMBOLS.sub(b"", text)) / n, 0.05, 0.3),
        _vote(len(_UPPER.sub(b"", text)) / letters, 0.2, 0.5),
        _vote(text.count(b"!") / n, 0.1, 0.5),
        _vote(same, 0.05, 0.2),
        _vote(1 - len(set(lines)) / len(lines), 0.2, 0.5),
        _vote(-len(zlib.compress(text, 1)) / len(text), -0.25, -0.15) if len(text) >= 200 else 0,
        _vote(-sum(map(COMMON.__contains__, words)) / n, -0.1, -0.02) if n >= 20 else 0,
        _vote(sum(1 for w in words if not w.isalnum() and len(w) == 1) / n, 0.1, 0.3),
    )


LABELLERS = ("symbols", "capitals", "exclamations", "stutter", "repeated_lines", "compression", "function_words", "lone_marks")


def features(text: bytes, words: list[bytes]) -> dict[int, float]:
    """Hashed features of one text: shapes of words (letters, capitals, digits, marks; runs as one) and pairs of shapes, of unit length; levels of stutter."""
    shapes = _RUN.sub(rb"\1", text.translate(_SHAPE)).split()
    found: dict[int, float] = {}
    n = max(1, len(shapes))
    counted = [(b"1" + s, c) for s, c in Counter(shapes).items()]
    counted += [(b"2" + a + b" " + b, c) for (a, b), c in Counter(zip(shapes, shapes[1:], strict=False)).items()]
    for name, c in counted:
        k = zlib.crc32(name) % BUCKETS
        found[k] = found.get(k, 0.0) + c / n
    norm = sum(v * v for v in found.values()) ** 0.5 or 1.0
    found = {k: v / norm for k, v in found.items()}
    stutter = sum(map(eq, words, words[1:])) / max(1, len(words))
    for level in (0.03, 0.1, 0.3):
        if stutter > level:
            k = zlib.crc32(b"stutter%d" % (100 * level)) % BUCKETS
            found[k] = found.get(k, 0.0) + 1.0
    return found


def _batches(run):
    def each(batches):
        for b in batches:
            texts = b.column(1).cast(pa.binary()).to_pylist()
            yield run(b.column(0), texts)

    return each


def voted(docs: DataFrame) -> DataFrame:
    """(id, votes) with the votes as one number in base 3."""

    def run(ids, texts):
        codes = [sum((v + 1) * 3**k for k, v in enumerate(votes(t or b"", (t or b"").split()))) for t in texts]
        return pa.RecordBatch.from_arrays([ids, pa.array(codes, pa.int64())], ["id", "votes"])

    return docs.mapInArrow(_batches(run), "id long, votes long")


def estimate(counts: dict[int, int], rounds: int = 500) -> tuple[dict[int, float], np.ndarray, np.ndarray, float]:
    """Expectation-maximisation over pattern counts: probability of good by pattern; each labeller's false alarms and hits; share of good documents.

    Each labeller has its own chance of calling a good document bad (false alarm) and a bad one bad (hit), given which labellers are independent;
    when it abstains it says nothing. Estimates are the most probable ones under a belief of FALSE_ALARM, as strong as BELIEF times the labeller's own
    votes, and a weak one on hits and share; nothing bounds them. It starts from the votes, a bad one counting thrice.
    """
    m = len(LABELLERS)
    if not counts:
        return {}, np.full(m, FALSE_ALARM), np.full(m, 1 / 3), 0.5
    codes = np.array(sorted(counts))
    n = np.array([counts[c] for c in codes.tolist()], float)
    v = (codes[:, None] // 3 ** np.arange(m)) % 3 - 1
    bad, fine = (v < 0).astype(float), (v > 0).astype(float)
    belief = BELIEF * ((bad + fine).T @ n) + 1
    good = 1 / (1 + np.exp(-1.5 * (fine.sum(1) - 3.0 * bad.sum(1) + 1)))
    for _ in range(rounds):
        g, b = n * good, n * (1 - good)
        alarm = (bad.T @ g + FALSE_ALARM * belief) / ((bad + fine).T @ g + belief)
        hit = (bad.T @ b + 1) / ((bad + fine).T @ b + 3)
        share = (g.sum() + 1) / (n.sum() + 2)
        log = [bad @ np.log(x) + fine @ np.log(1 - x) for x in (alarm, hit)]
        new = 1 / (1 + np.exp(np.clip(log[1] - log[0] + np.log((1 - share) / share), -50, 50)))
        settled = np.abs(new - good).max() < 1e-6
        good = new
        if settled:
            break
    return dict(zip(codes.tolist(), good.tolist(), strict=True)), alarm, hit, float(share)


def label_model(counts: dict[int, int]) -> dict[int, float]:
    """Probability of good by vote pattern."""
    return estimate(counts)[0]


def accuracies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per labeller: votes cast and bad votes over all documents, and its estimated false alarms and hits."""
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    counts = {r["votes"]: r["count"] for r in voted(plain).groupBy("votes").count().collect()}  # 3^labellers rows at most
    _, alarm, hit, _ = estimate(counts)
    said = [[(c // 3**k) % 3 - 1 for k in range(len(LABELLERS))] for c in counts]
    rows = []
    for k, name in enumerate(LABELLERS):
        cast = sum(n for v, n in zip(said, counts.values(), strict=True) if v[k])
        rows.append((name, cast, sum(n for v, n in zip(said, counts.values(), strict=True) if v[k] < 0), float(alarm[k]), float(hit[k])))
    return docs.sparkSession.createDataFrame(rows, "labeller string, n_votes long, n_bad long, false_alarm double, hit double")


def fit_scorer(rows: list[tuple[dict[int, float], float]], rounds: int = 60, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels: full-batch steps scaled by each weight's past gradients. Classes weigh alike."""
    w, bias = np.zeros(BUCKETS), 0.0
    if not rows:
        return w, bias
    at = np.concatenate([np.full(len(f), k) for k, (f, _) in enumerate(rows)])
    col = np.concatenate([np.fromiter(f.keys(), np.int64, len(f)) for f, _ in rows])
    val = np.concatenate([np.fromiter(f.values(), float, len(f)) for f, _ in rows])
    y = np.array([q for _, q in rows])
    weight = y / max(y.sum(), 1e-9) + (1 - y) / max((1 - y).sum(), 1e-9)
    weight *= len(y) / weight.sum()
    past, past_b = np.full(BUCKETS, 1e-8), 1e-8
    for _ in range(rounds * 5):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(at, val * w[col], len(y)) + bias, -40, 40)))
        g = weight * (p - y) / len(y)
        gw, gb = np.bincount(col, val * g[at], BUCKETS) + decay * w, g.sum()
        past, past_b = past + gw * gw, past_b + gb * gb
        w, bias = w - 0.5 * gw / np.sqrt(past), bias - 0.5 * gb / np.sqrt(past_b)
    return w, bias


def classified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with `quality_score` (probability that the document is good) and `quality_kept` besides their own columns.

    Accuracies come from the votes on all documents, counted by pattern (3^labellers at most, so few that they go to the driver). The scorer
    is fitted on FIT_DOCS documents. Texts without words score 1 and are kept; all others have the scorer's verdict, however short. No text is shuffled.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    counts = {r["votes"]: r["count"] for r in voted(plain).groupBy("votes").count().collect()}
    posterior = label_model(counts)
    chosen = plain.select(F.xxhash64("id", "text").alias("h")).orderBy("h").limit(FIT_DOCS).agg(F.max("h")).first()[0]

    def learn(ids, texts):
        rows = []
        for t in texts:
            words = (t or b"").split()
            f = features(t or b"", words)
            code = sum((v + 1) * 3**k for k, v in enumerate(votes(t or b"", words)))
            rows.append((list(f), list(f.values()), posterior.get(code, 0.5), code))
        kinds = [pa.list_(pa.int32()), pa.list_(pa.float32()), pa.float64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["keys", "vals", "good", "code"])

    few = plain.where(F.xxhash64("id", "text") <= F.lit(chosen)) if chosen is not None else plain.limit(0)
    got = few.mapInArrow(_batches(learn), "keys array<int>, vals array<float>, good double, code long").orderBy("code", "good", F.xxhash64("keys")).limit(FIT_DOCS).collect()
    nothing = sum(3**k for k in range(len(LABELLERS)))  # all abstain
    w, bias = fit_scorer([(dict(zip(r["keys"], r["vals"], strict=True)), r["good"]) for r in got if r["code"] != nothing])

    @F.pandas_udf("double")
    def score(text):
        import pandas as pd

        out = []
        for t in text:
            t = (t or "").encode()
            words = t.split()
            good = float(1 / (1 + np.exp(-np.clip(sum(w[k] * x for k, x in features(t, words).items()) + bias, -40, 40))))
            out.append(good if words else 1.0)
        return pd.Series(out, dtype="float64")

    return docs.withColumn("quality_score", score(F.col(text_col).cast("string"))).withColumn("quality_kept", F.col("quality_score") >= KEEP)


def op7_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """All documents with the classifier's score and verdict. Null texts and texts without words are kept; null and repeated ids and repeated texts each get
    their own row; very long texts are read whole; extra columns do not matter; an empty table gives no rows."""
    found = classified(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.col("quality_score").alias("score"), F.col("quality_kept").alias("kept"))
