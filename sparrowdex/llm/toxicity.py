"""Toxicity: a support vector machine on a gap-weighted subsequence kernel, through Nyström landmarks.

The kernel compares words; a sentence's is the sum over its words, so a landmark is a word. Values below LEAST (see there) count as none, in
fitting and scoring alike.
"""

from __future__ import annotations

import re
from itertools import combinations
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, table

#: Letters in a subsequence, letters it may stretch over, weight of each letter it stretches over.
ORDER, SPAN, DECAY = 3, 6, 0.6
#: Kernel values below this count as none, so that only words like a landmark speak. A short landmark has less, if it has less with one letter put in.
LEAST = 0.5
LANDMARKS = 128
#: Labelled documents of each class that the machine is fitted on, and sentences, at most: those with the smallest hashes.
FIT_TOXIC, FIT_CLEAN, FIT_SENTENCES = 2000, 4000, 20_000
#: Standard errors by which a landmark's odds must differ from those of any word.
CERTAIN = 2.0
FLAG = 0.3
#: Tokens that a worker remembers.
CACHE = 400_000

_WORD = re.compile(r"[^\W\d_](?:[.*_-][^\W\d_](?![^\W\d_])){2,}|[^\W\d_]+(?:['’.*_-][^\W\d_]+)*")
#: Single letters set apart by spaces.
_SPACED = re.compile(r"(?<![^\s])[^\W\d_](?: [^\W\d_](?![^\W\d_])){2,}")
_MARKS = str.maketrans("", "", " .*_-'’")
_PIECE = re.compile(r"[^\W\d_]+")
_EDGES = ".,;:!?\"'()[]{}<>«»“”„’‘…-*_/\\|#&%$@+=~^`0123456789"
_ENDS = (".", "!", "?")
#: Letters that digits and marks are written for.
_LIKE = str.maketrans("013457@$", "oieastas")
_JOINT = re.compile(r"['’.*_-]?")
#: Longer runs of letters are read as pieces of so many letters that overlap by half.
LONG = 64


def letters(word: str) -> str:
    return word.translate(_MARKS)


def pieces(word: str) -> list[str]:
    """A word without its marks, cut into overlapping pieces if it is a very long one; nothing if it is too short for a subsequence."""
    n = len(word)
    if n <= LONG:
        return [word] if n >= ORDER else []
    return [word[k : k + LONG] for k in range(0, n - LONG // 2, LONG // 2)]


def words_of(token: str) -> list[str]:
    """Words in a token (characters without spaces, lower case), without marks; single letters set apart by marks are one word."""
    word = token.strip(_EDGES)
    return pieces(word) if word.isalpha() else [x for w in _WORD.findall(token) for x in pieces(letters(w))]


def runs_of(token: str) -> list[str]:
    """Readings of a token across digits and marks at which words_of breaks: two or three neighbouring pieces, and all, as they are written and with the letters that digits and marks look like."""
    at = [m.span() for m in _PIECE.finditer(token)]
    if len(at) < 2 or all(_JOINT.fullmatch(token, a[1], b[0]) for a, b in zip(at, at[1:])):
        return []
    spans = {(at[i][0], at[min(i + k, len(at)) - 1][1]) for k in (2, 3) for i in range(len(at) - 1)} | {(at[0][0], at[-1][1])}
    written = {letters(token[a:b]) for a, b in spans}
    return sorted({x for w in written | {w.translate(_LIKE) for w in written} for x in pieces(w)})


_spans: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _subsequences(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all subsequences of ORDER letters that stretch over SPAN of n letters at most, and their weights."""
    if n not in _spans:
        rest = [c for c in combinations(range(1, SPAN), ORDER - 1)]
        at = np.array([(i, *(i + k for k in c)) for i in range(n) for c in rest if i + c[-1] < n], np.int32).reshape(-1, ORDER)
        _spans[n] = at, DECAY ** (at[:, -1] - at[:, 0] + 1.0)
    return _spans[n]


def _points(words: list[str], n: int) -> np.ndarray:
    """Code points of words of n letters."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(words), n)


class Kernel:
    """Normalised subsequence kernel of words against landmarks, and the linear machine over the landmarks' Nyström features."""

    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks
        known = sorted({c for w in landmarks for c in w})
        self.base = len(known) + 1  # all foreign letters are one more letter
        self.letter = np.zeros(1 << 16, np.int32)
        for k, c in enumerate(known):
            if ord(c) < 0xFFFF:
                self.letter[ord(c)] = k + 1
        self.feature = np.full(self.base**ORDER, -1, np.int32)
        n_features, triples = 0, []
        for m, (codes, values) in enumerate(self._exact(self._codes([w], len(w))) for w in landmarks):
            for c, v in zip(codes.tolist(), values.tolist(), strict=True):
                if self.feature[c] < 0:
                    self.feature[c] = n_features
                    n_features += 1
                triples.append((self.feature[c], m, v))
        self.table = np.zeros((max(n_features, 1), len(landmarks)))
        for f, m, v in triples:
            self.table[f, m] = v
        self.root = np.eye(len(landmarks))
        if landmarks:
            self.table /= np.sqrt((self.table**2).sum(axis=0))
            values, vectors = np.linalg.eigh(self.table.T @ self.table)
            inverse = np.where(values > 1e-6, 1 / np.sqrt(np.maximum(values, 1e-6)), 0.0)
            self.root = vectors @ np.diag(inverse) @ vectors.T
        self.least = np.full(len(landmarks), LEAST)
        for m, w in enumerate(landmarks):
            put_in = [w[:k] + "\0" + w[k:] for k in range(1, len(w))]
            code, weight = self._codes(put_in, len(w) + 1)
            self.least[m] = min(LEAST, self._products(put_in, code, weight)[:, m].min())
        self.least *= 1 - 1e-6
        # each feature's landmarks and values as parts of the least value, one after the other, and the largest of each code
        self.at, self.landmark = np.nonzero(self.table)
        self.value = self.table[self.at, self.landmark] / self.least[self.landmark]
        self.first = np.searchsorted(self.at, np.arange(len(self.table) + 1))
        self.most = np.where(self.feature >= 0, (self.table / self.least).max(axis=1, initial=0.0)[self.feature], 0.0)
        self.weights, self.bias, self.scale = np.zeros(len(landmarks)), 0.0, (1.0, 0.0)
        self.forget()

    def forget(self) -> None:
        """Empties what a worker remembers: words and tokens with a kernel value, tokens seen."""
        self.hits: dict[str, np.ndarray] = {}
        self.tokens: dict[str, np.ndarray] = {}
        self.seen: set[str] = set()
        self.single: set[str] = set()  # tokens of one character

    def _codes(self, words: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
        x = self.letter[np.minimum(_points(words, n), 0xFFFF)]
        at, weight = _subsequences(n)
        code = x[:, at[:, 0]]
        for k in range(1, ORDER):
            code = code * self.base + x[:, at[:, k]]
        return code, weight

    def _exact(self, coded):
        """Distinct subsequences of one word with the sums of their weights."""
        codes, inverse = np.unique(coded[0][0], return_inverse=True)
        return codes, np.bincount(inverse, coded[1], len(codes))

    def _bound(self, code: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """An upper bound of each word's kernel with any landmark, as a multiple of the landmark's least value. The product with a landmark is exact; a subsequence that occurs twice only adds to the norm."""
        row, k = np.nonzero(self.feature[code] >= 0)
        f = self.feature[code[row, k]]
        n = self.first[f + 1] - self.first[f]
        pair = np.repeat(self.first[f] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        product = np.bincount(np.repeat(row, n) * len(self.landmarks) + self.landmark[pair], np.repeat(weight[k], n) * self.value[pair], len(code) * len(self.landmarks))
        return product.reshape(len(code), -1).max(axis=1, initial=0.0) / np.sqrt(weight @ weight)

    def _products(self, words: list[str], code: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Kernel of words of one length, given their subsequences' codes, with each landmark. In the norm all letters differ, foreign ones too."""
        n = len(code)
        alphabet, x = np.unique(_points(words, len(words[0])), return_inverse=True)
        x, at = x.reshape(n, -1).astype(np.int64), _subsequences(x.size // n)[0]
        size = len(alphabet)
        own = np.broadcast_to(np.arange(n)[:, None], code.shape)
        for k in range(ORDER):
            own = own * size + x[:, at[:, k]]
        _, inverse = np.unique(own, return_inverse=True)
        norm = np.bincount(inverse.ravel(), np.broadcast_to(weight, code.shape).ravel())
        first = np.zeros(len(norm), np.int64)
        first[inverse.ravel()] = np.repeat(np.arange(n), code.shape[1])
        norm = np.sqrt(np.bincount(first, norm * norm, n))
        row, k = np.nonzero(self.feature[code] >= 0)
        out = np.zeros((n, len(self.landmarks)))
        if len(row):
            start = np.flatnonzero(np.diff(row, prepend=-1))
            out[row[start]] = np.add.reduceat(weight[k][:, None] * self.table[self.feature[code[row, k]]], start, axis=0)
        return out / norm[:, None]

    def _values(self, words: list[str], code: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """_products, with none where a landmark's least value is not reached."""
        out = self._products(words, code, weight)
        out[out < self.least] = 0.0
        return out

    def learn_words(self, words) -> None:
        """Computes the kernel of words; those with a value that is no less than a landmark's least become hits."""
        by_length: dict[int, list[str]] = {}
        for w in words:
            by_length.setdefault(len(w), []).append(w)
        for n, group in by_length.items():
            step = max(1, 1_000_000 // (10 * n))
            for at in range(0, len(group), step):
                some = group[at : at + step]
                code, weight = self._codes(some, n)
                # upper bounds of the kernel: first with the largest value of each subsequence, then by landmark
                near = np.flatnonzero(self.most[code] @ weight >= (1 - 1e-9) * np.sqrt(weight @ weight))
                for lo in range(0, len(near), 512):
                    rows = near[lo : lo + 512]
                    rows = rows[self._bound(code[rows], weight) >= 1 - 1e-9]
                    if len(rows):
                        for k, value in zip(rows.tolist(), self._values([some[k] for k in rows], code[rows], weight), strict=True):
                            if value.any():
                                self.hits[some[k]] = value

    def learn_tokens(self, tokens: set[str]) -> None:
        """Computes the kernel values of tokens: the sum over a token's words, or those of a run across digits and marks if it is more like a landmark than each of them."""
        read: dict[str, list[str]] = {}
        odd: dict[str, tuple[list[str], list[str]]] = {}
        for x in tokens:
            word = x.strip(_EDGES)
            if word.isalpha() and len(word) <= LONG:
                if len(word) >= ORDER:
                    read.setdefault(word, []).append(x)
            else:
                odd[x] = words_of(x), runs_of(x)
        self.learn_words(set(read).union(*(w for w, _ in odd.values()), *(r for _, r in odd.values())).difference(self.hits))
        hits = self.hits
        for w in read.keys() & hits.keys():
            for x in read[w]:
                self.tokens[x] = hits[w]
        for x, (words, runs) in odd.items():
            parts = [hits[w] for w in words if w in hits]
            whole = max((hits[w] for w in runs if w in hits), key=np.max, default=None)
            if whole is not None and whole.max() > max(map(np.max, parts), default=0.0):
                self.tokens[x] = whole
            elif parts:
                self.tokens[x] = np.sum(parts, axis=0)

    def sentences(self, text: str, spaced: bool = False) -> list[list]:
        """The sentences of a text (lower case) with a hit, each as the tokens, or words of single letters (spaced: there may be any), that have one. A sentence ends at a line's end or a token that ends in one of _ENDS."""
        out, known, hits = [], self.tokens, self.hits
        for line in text.split("\n"):
            found = []
            if spaced:
                found += [w for m in _SPACED.findall(line) for w in pieces(letters(m)) if w in hits]
            for x in line.split():
                if x in known:
                    found.append(x)
                if found and x.endswith(_ENDS):
                    out.append(found)
                    found = []
            if found:
                out.append(found)
        return out

    def total(self, found: list[str]) -> np.ndarray:
        return np.sum([self.tokens[x] if x in self.tokens else self.hits[x] for x in found], axis=0)

    def batch(self, texts: list[str]):
        """For each text, its sentences that have a hit. All words are learnt once, whatever number of texts has them."""
        for at in range(0, len(texts), 200):
            low = [t.lower() for t in texts[at : at + 200]]
            sets = [set(t.split()) for t in low]
            if len(self.seen) > CACHE:
                self.forget()
            new = set().union(*sets).difference(self.seen)
            self.learn_tokens(new)
            self.seen |= new
            self.single |= {x for x in new if len(x) == 1}
            known = self.tokens.keys()
            for t, s in zip(low, sets, strict=True):
                apart = {w for m in _SPACED.findall(t) for w in pieces(letters(m))} if len(self.single & s) > 1 else ()
                if apart:
                    self.learn_words(apart.difference(self.hits))
                spaced = any(w in self.hits for w in apart)
                yield self.sentences(t, spaced) if spaced or not known.isdisjoint(s) else []

    def decision(self, sentences: list[list]) -> float:
        """Largest decision value of a text's sentences; a text with no hit has that of a sentence without one."""
        return max((float(self.weights @ (self.root @ self.total(x))) for x in sentences), default=0.0) + self.bias

    def probability(self, decision: float) -> float:
        a, b = self.scale
        return float(1 / (1 + np.exp(-np.clip(a * decision + b, -40, 40))))


def fit_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, decay: float = 1e-3, rounds: int = 2000) -> tuple[np.ndarray, float]:
    """Linear machine with hinge loss: averaged subgradient steps over the whole (bounded) sample."""
    w, b, mean, mean_b = np.zeros(x.shape[1]), 0.0, np.zeros(x.shape[1]), 0.0
    weight = weight / weight.sum()
    for t in range(1, rounds + 1):
        wrong = weight * y * ((y * (x @ w + b)) < 1)
        step = 1 / (decay * (t + 1000))
        w, b = w - step * (decay * w - x.T @ wrong), b + 0.1 * step * wrong.sum()
        mean, mean_b = mean + (w - mean) / t, mean_b + (b - mean_b) / t
    return mean, float(mean_b)


def fit_scale(d: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt's scaling: a slope of at least 0 and an offset, by Newton steps on a damped logistic loss."""
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * d + b, -40, 40)))
        s = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((p - y) * d).sum() + 1e-2 * a, (p - y).sum()])
        h = np.array([[(s * d * d).sum() + 1e-2, (s * d).sum()], [(s * d).sum(), s.sum() + 1e-9]])
        da, db = np.linalg.solve(h, g)
        a, b = a - np.clip(da, -1, 1), b - np.clip(db, -1, 1)
    return max(float(a), 0.0), float(b)


def disguised(word: str, turn: int) -> str:
    """The word with a letter, a digit or a mark put in, or a letter replaced by a mark, at a place that `turn` chooses."""
    turn, kind = divmod(turn, 4)
    put = ("abcdefghijklmnopqrstuvwxyz", "0123456789", ".*_-@/", "*")[kind]
    turn, k = divmod(turn, len(put))
    at = 1 + turn % (len(word) - 1)
    return word[:at] + put[k] + word[at + (kind == 3) :]


def fit(docs: DataFrame, labels: DataFrame) -> Kernel:
    """docs: id, text; labels: id, toxic (0 or 1), those to learn from. Landmarks are the words that speak most for toxic documents; the SVM is trained on sentences.

    A sentence of a clean document is clean; one of a toxic document counts as toxic if it has a word like a landmark. Each toxic sentence is
    trained on once more with its words disguised.
    """
    order = F.xxhash64("id", F.lit(1))
    ids = labels.groupBy("id").agg(F.max("toxic").alias("toxic")).join(docs.select("id"), "id", "left_semi")
    some = ids.where("toxic = 1").orderBy(order).limit(FIT_TOXIC).union(ids.where("toxic = 0").orderBy(order).limit(FIT_CLEAN))
    some = saved(some)  # FIT_TOXIC + FIT_CLEAN ids at most: the texts stay where they are
    chosen = saved(docs.join(F.broadcast(some), "id").select("id", "text", F.col("toxic").cast("long")))

    def list_words(batches):
        for b in batches:
            for text, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = sorted({w for x in set((text or "").lower().split()) for w in words_of(x)})
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([t] * len(words), pa.int64())], ["word", "toxic"])

    sizes = {r["toxic"]: r["count"] for r in chosen.groupBy("toxic").count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return Kernel([])
    counted = chosen.select("text", "toxic").mapInArrow(list_words, "word string, toxic long").groupBy("word").agg(F.sum("toxic").alias("a"), F.count("*").alias("n"))
    a, b = (F.col("a") + 0.5) / (n1 + 1.0), (F.col("n") - F.col("a") + 0.5) / (n0 + 1.0)
    z = F.log(a / b) / F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("n") - F.col("a") + 0.5))
    # rarely in clean documents, and far from chance
    telling = counted.where("a >= 3").withColumn("z", z).where((F.log(a / b) > 1.5) & (F.col("z") > CERTAIN)).orderBy(F.desc(F.log(a / b) * F.sqrt("a")), "word").limit(LANDMARKS)
    kernel = Kernel([r["word"] for r in telling.collect()])
    if not kernel.landmarks:
        kernel.scale = (0.0, float(np.log(n1 / n0)))
        return kernel

    def in_disguise(id_, found):
        """The sentences with their words disguised, as far as they still have a hit."""
        again = [[disguised(w, crc32(f"{id_} {k} {w}".encode())) for w in x] for k, x in enumerate(found)]
        kernel.learn_tokens({w for x in again for w in x})
        return [x for x in ([w for w in x if w in kernel.tokens] for x in again) if x]

    def list_sentences(batches):
        for b in batches:
            for id_, found, t in zip(b.column(0).to_pylist(), kernel.batch([x or "" for x in b.column(1).to_pylist()]), b.column(2).to_pylist(), strict=True):
                values = [kernel.total(x) for x in (found + in_disguise(id_, found) if t else found)]
                for at in range(0, len(values), 1000):
                    part = [v.astype(np.float32).tobytes() for v in values[at : at + 1000]]
                    columns = [pa.array([id_] * len(part), pa.int64()), pa.array(range(at, at + len(part)), pa.int64()), pa.array([t] * len(part), pa.int64()), pa.array(part, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["id", "k", "toxic", "v"])

    # the sentences with the smallest hashes, wherever in their documents they stand
    heard = chosen.mapInArrow(list_sentences, "id long, k long, toxic long, v binary").orderBy(F.xxhash64("id", "k", "v"), "toxic").limit(FIT_SENTENCES)
    rows = [(r["toxic"], np.frombuffer(r["v"], np.float32)) for r in heard.select("toxic", "v").collect()]
    x = np.array([kernel.root @ v for _, v in rows] + [np.zeros(len(kernel.landmarks))])
    y = np.array([1.0 if t else -1.0 for t, _ in rows] + [-1.0])
    # the last row stands for the clean sentences without a hit
    weight = np.where(y > 0, 1 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum() - 1, 1))
    weight[-1] = 0.5
    kernel.weights, kernel.bias = fit_svm(x, y, weight)

    def decide(batches):
        for b in batches:
            found = [kernel.decision(x) for x in kernel.batch([x or "" for x in b.column(1).to_pylist()])]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.float64()), b.column(2)], ["d", "toxic"])

    # over all sentences of each document, as in scoring: one number a document, as many of each class as there are
    pairs = [(r["d"], r["toxic"]) for r in chosen.mapInArrow(decide, "d double, toxic long").collect()]
    kernel.scale = fit_scale(np.array([d for d, _ in pairs]), np.array([t for _, t in pairs], float))
    kernel.forget()
    return kernel


def scored(docs: DataFrame, kernel: Kernel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for every row; null counts as empty. No shuffle."""

    def run(batches):
        for b in batches:
            scores = [kernel.probability(kernel.decision(v)) for v in kernel.batch([t or "" for t in b.column(1).to_pylist()])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64())], ["id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, score double")


def held_out(id_col: str):
    """Every fourth document by the CRC-32 of its id as text; null ids are not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    """Learns from labelled documents that are not held out, and scores all. Without labels of both classes every score is that of no evidence.

    A null text counts as empty; both have the score of a text without evidence. Rows that share a doc_id are scored one by one and learnt from under
    the id's largest label; rows without one are scored, not learnt from and not held out. Very long runs of letters are read in pieces (LONG).
    Labels other than 0 and 1 and columns besides doc_id, text and toxic are not read. An empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("id"), "text")
    labels = table(spark, sf_dir, "labels").where("toxic IN (0, 1)").select(F.col("doc_id").cast("long").alias("id"), "toxic")
    found = scored(docs, fit(docs, labels.where(~held_out("id"))), "id")
    return found.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "score", (F.col("score") >= FLAG).cast("int").alias("predicted"))
