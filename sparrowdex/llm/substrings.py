"""Substring dedup: fixed-block anchors, rolling-window probes, extension to maximal exact repeats.

Documents are dealt to chunks of bounded size. Four steps talk between chunks and the parts of a hash space:

1. every chunk indexes its non-overlapping ANCHOR-word reference blocks and probes with every rolling window of ANCHOR words: it sends
   each hash once, with the smallest document that has it as a block and the largest that has it as a window;
2. a part tells the chunks which of their hashes are a block of a document smaller than one that has the window: the hits;
3. a repeat of WINDOW words holds a whole block of the smaller document, since WINDOW >= 2 * ANCHOR - 1. So chunks
   extend each hit, on both sides of it, to all WINDOW-word windows around it and send 96 bits of these windows' hashes; a part finds
   each one's smallest document and tells the chunks that have it in larger ones;
4. a chunk joins the windows so found, known by the same 96 bits, to maximal repeats and removes them.

However often a passage occurs, a chunk sends its hash once, so a part reads it once a chunk at most, and no pairs are ever made.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

WINDOW, ANCHOR = 50, 25
#: Bytes of text in a chunk, and behind a part of the hash space (at 100 TB raise both; a task holds one at a time).
CHUNK_BYTES, PART_BYTES = 3 << 20, 8 << 20
_BASES = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93], np.uint64)
_MOST, _LEAST = np.iinfo(np.int64).max, np.iinfo(np.int64).min
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

HITS = "chunk long, n int, keys binary, lo binary, hi binary"
SENT = "part int, chunk long, n int, keys binary, docs binary, n_blocks int, block_keys binary, block_docs binary"
WIDE = "part int, chunk long, n int, a binary, b binary, lo binary, hi binary"
FOUND = "chunk long, n int, a binary, b binary, lo binary"
SPANS = "doc_id long, n_words long, n_removed long, spans array<struct<start:int,end:int>>, kept_sha256 string"


def _planes(x: np.ndarray, n_bytes: int = 8) -> bytes:
    """Bytes of equal weight together: the high ones of ids and counts then compress to nothing."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :n_bytes].T).tobytes()


def _from_planes(data: bytes, n: int, kind, n_bytes: int = 8) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :n_bytes] = np.frombuffer(data, np.uint8).reshape(n_bytes, n).T
    return out.view(kind).ravel()


def _power(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo 2^64."""
    if which not in _powers or len(_powers[which][0]) < n:
        base = int(_BASES[which])
        pair = []
        for x in (base, pow(base, -1, 1 << 64)):
            p = np.full(max(n, 1 << 16), x, np.uint64)
            p[0] = 1
            pair.append(np.cumprod(p, dtype=np.uint64))
        _powers[which] = tuple(pair)
    return tuple(p[:n] for p in _powers[which])


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Chunk:
    """The documents of a chunk, by id; those without an id come last and take no part in repeats."""

    def __init__(self, t: pa.Table):
        ids = t.column("doc_id").to_pylist()
        texts = t.column("text").cast(pa.binary()).to_pylist()
        order = sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k] or 0))
        self.ids = [ids[k] for k in order]
        self.words = [(texts[k] or b"").split() for k in order]
        sizes = np.array([len(w) for w in self.words], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        digest = xxhash.xxh3_64_intdigest
        self.hashes = np.fromiter((h for w in self.words for h in map(digest, w)), np.uint64, int(self.starts[-1]))
        known = np.array([x is not None for x in self.ids], bool)
        self.doc_of = np.repeat(np.arange(len(ids)), sizes)
        self.doc_ids = np.array([x or 0 for x in self.ids], np.int64)
        self.left = np.repeat(self.starts[1:], sizes) - np.arange(len(self.hashes))  # words from here to the document's end
        self.left[~known[self.doc_of]] = 0

    def windows(self, n: int) -> np.ndarray:
        """Where a window of n words starts, in words from the chunk's start."""
        return np.flatnonzero(self.left >= n)

    def rolled(self, n: int, at: np.ndarray, which: int = 0) -> np.ndarray:
        power, inverse = _power(which, len(self.hashes) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.hashes * power[:-1], dtype=np.uint64)])
        return _mixed((sums[at + n] - sums[at]) * inverse[at])


def _low(h: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(part, low 40 bits) of hashes: among the bounded number of hashes in a part these few bits hardly ever meet by chance, and such a hit finds no window."""
    return ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64), h & np.uint64((1 << 40) - 1)


def _key(part, low: np.ndarray) -> np.ndarray:
    """Both in one number. Beyond 2^24 parts (128 TB of text) two parts may share one: a hit more to extend, and no window more."""
    return np.asarray(part).astype(np.uint64) << np.uint64(40) | low


def _cuts(part: np.ndarray, of: np.ndarray) -> list[tuple[int, int]]:
    """Where the entries of each part in `of` begin and end in the sorted `part`."""
    return list(zip(np.searchsorted(part, of).tolist(), np.searchsorted(part, of, "right").tolist(), strict=True))


def _send(parts: int):
    def run(t: pa.Table) -> pa.Table:
        c, chunk = Chunk(t), t.column("chunk")[0].as_py()
        at = c.windows(ANCHOR)
        part, low = _low(c.rolled(ANCHOR, at), parts)
        doc = c.doc_of[at]
        block = (at - c.starts[doc]) % ANCHOR == 0

        def once(p, x, d, last: bool):
            """Each hash once, with its last (else first) document; by part, then document."""
            order = np.lexsort((x, p))  # stable: documents of a hash stay in order
            p, x, d = p[order], x[order], d[order]
            new = np.ones(len(x), bool)
            new[1:] = (x[1:] != x[:-1]) | (p[1:] != p[:-1])
            keep = np.append(new[1:], True)[: len(x)] if last else new
            p, x, d = p[keep], x[keep], d[keep]
            order = np.lexsort((d, p))
            return p[order], x[order], c.doc_ids[d[order]]

        w, b = once(part, low, doc, True), once(part[block], low[block], doc[block], False)
        of = np.unique(w[0])  # a block is a window too
        rows = {k: [] for k in ("part", "chunk", "n", "keys", "docs", "n_blocks", "block_keys", "block_docs")}
        for p, (i, j), (k, m) in zip(of.tolist(), _cuts(w[0], of), _cuts(b[0], of), strict=True):
            for name, value in zip(rows, (p, chunk, j - i, _planes(w[1][i:j], 5), _planes(w[2][i:j]), m - k, _planes(b[1][k:m], 5), _planes(b[2][k:m])), strict=True):
                rows[name].append(value)
        return pa.table(rows, schema=_schema(SENT))

    return run


def _schema(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    return pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in ddl.split(", ")])


def _hits(t: pa.Table) -> pa.Table:
    """Of one part's hashes, those that are a block of a document smaller than one that has them as a window."""
    part, rows = t.column("part")[0].as_py(), t.to_pylist()
    bx = np.concatenate([_from_planes(r["block_keys"], r["n_blocks"], np.uint64, 5) for r in rows])
    bd = np.concatenate([_from_planes(r["block_docs"], r["n_blocks"], np.int64) for r in rows])
    order = np.lexsort((bd, bx))
    bx, bd = bx[order], bd[order]
    first = np.ones(len(bx), bool)
    first[1:] = bx[1:] != bx[:-1]
    bx, lo = bx[first], bd[first]
    hi = np.full(len(bx), _LEAST)
    out, matched = {k: [] for k in ("chunk", "n", "keys", "lo", "hi")}, []
    for r in rows if len(bx) else []:
        x, d = _from_planes(r["keys"], r["n"], np.uint64, 5), _from_planes(r["docs"], r["n"], np.int64)
        k = np.minimum(np.searchsorted(bx, x), len(bx) - 1)
        same = bx[k] == x
        k = k[same]
        np.maximum.at(hi, k, d[same])
        matched.append((r["chunk"], k))
    for chunk, k in matched:
        k = k[lo[k] < hi[k]]
        if len(k):
            for name, value in zip(out, (chunk, len(k), _planes(_key(part, bx[k])), _planes(lo[k]), _planes(hi[k])), strict=True):
                out[name].append(value)
    return pa.table(out, schema=_schema(HITS))


def _extend(parts: int):
    def run(docs: pa.Table, hits: pa.Table) -> pa.Table:
        empty = pa.table({x.name: [] for x in _schema(WIDE)}, schema=_schema(WIDE))
        if not docs.num_rows or not hits.num_rows:
            return empty
        c, chunk, rows = Chunk(docs), docs.column("chunk")[0].as_py(), hits.to_pylist()
        key, lo, hi = (np.concatenate([_from_planes(r[k], r["n"], kind) for r in rows]) for k, kind in (("keys", np.uint64), ("lo", np.int64), ("hi", np.int64)))
        order = np.argsort(key)
        key, lo, hi = key[order], lo[order], hi[order]
        new = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        key, lo, hi = key[new], np.minimum.reduceat(lo, new), np.maximum.reduceat(hi, new)
        at = c.windows(ANCHOR)
        part, low = _low(c.rolled(ANCHOR, at), parts)
        mine = _key(part, low)
        k = np.minimum(np.searchsorted(key, mine), len(key) - 1)
        doc = c.doc_of[at]
        d = c.doc_ids[doc]
        block = (at - c.starts[doc]) % ANCHOR == 0
        hit = at[(key[k] == mine) & ((d > lo[k]) | (block & (d < hi[k])))]
        # a window of WINDOW words holds the hit if it starts up to WINDOW - ANCHOR words before it
        edge = np.zeros(len(c.hashes) + WINDOW, np.int32)
        np.add.at(edge, np.maximum(hit - (WINDOW - ANCHOR), 0), 1)
        np.add.at(edge, hit + 1, -1)
        wide = c.windows(WINDOW)
        wide = wide[np.cumsum(edge)[wide] > 0]
        if not len(wide):
            return empty
        a, b, d = c.rolled(WINDOW, wide, 0), c.rolled(WINDOW, wide, 1) & np.uint64((1 << 32) - 1), c.doc_ids[c.doc_of[wide]]
        part, _ = _low(a, parts)
        order = np.lexsort((d, b, a, part))
        a, b, d, part = a[order], b[order], d[order], part[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        last = np.append(new[1:], True)
        a, b, lo, hi, part = a[new], b[new], d[new], d[last], part[new]
        of, out = np.unique(part), {x.name: [] for x in _schema(WIDE)}
        for p, (i, j) in zip(of.tolist(), _cuts(part, of), strict=True):
            for name, value in zip(out, (p, chunk, j - i, _planes(a[i:j]), _planes(b[i:j], 4), _planes(lo[i:j]), _planes(hi[i:j])), strict=True):
                out[name].append(value)
        return pa.table(out, schema=_schema(WIDE))

    return run


def _firsts(t: pa.Table) -> pa.Table:
    """Of one part's WINDOW-word windows, those that a chunk has in a document larger than their smallest."""
    rows = t.to_pylist()
    a, b = (np.concatenate([_from_planes(r[k], r["n"], np.uint64, n) for r in rows]) for k, n in (("a", 8), ("b", 4)))
    lo, hi = (np.concatenate([_from_planes(r[k], r["n"], np.int64) for r in rows]) for k in ("lo", "hi"))
    of = np.repeat(np.arange(len(rows)), [r["n"] for r in rows])
    order = np.lexsort((lo, b, a))
    a, b, lo, hi, of = a[order], b[order], lo[order], hi[order], of[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    lo = lo[new][np.cumsum(new) - 1]
    late = hi > lo
    a, b, lo, of = a[late], b[late], lo[late], of[late]
    order = np.argsort(of, kind="stable")
    a, b, lo, of = a[order], b[order], lo[order], of[order]
    out = {x.name: [] for x in _schema(FOUND)}
    cut = np.searchsorted(of, np.arange(len(rows) + 1)).tolist()
    for k in np.unique(of).tolist():
        i, j = cut[k], cut[k + 1]
        for name, value in zip(out, (rows[k]["chunk"], j - i, _planes(a[i:j]), _planes(b[i:j], 4), _planes(lo[i:j])), strict=True):
            out[name].append(value)
    return pa.table(out, schema=_schema(FOUND))


def _remove(docs: pa.Table, found: pa.Table) -> pa.Table:
    c = Chunk(docs)
    gone = np.zeros(len(c.hashes) + WINDOW + 1, np.int32)
    if found.num_rows:
        rows = found.to_pylist()
        a, b, lo = (np.concatenate([_from_planes(r[k], r["n"], kind, n) for r in rows]) for k, kind, n in (("a", np.uint64, 8), ("b", np.uint64, 4), ("lo", np.int64, 8)))
        order = np.lexsort((b, a))
        a, b, lo = a[order], b[order], lo[order]
        at = c.windows(WINDOW)
        x = c.rolled(WINDOW, at)
        k = np.minimum(np.searchsorted(a, x), len(a) - 1)
        same = a[k] == x
        at, x, k = at[same], x[same], k[same]
        y = c.rolled(WINDOW, at, 1) & np.uint64((1 << 32) - 1)
        while True:  # past windows that share 64 bits with another one
            after = np.minimum(k + 1, len(a) - 1)
            on = (b[k] != y) & (a[after] == x) & (after > k)
            if not on.any():
                break
            k = np.where(on, after, k)
        hit = at[(b[k] == y) & (c.doc_ids[c.doc_of[at]] > lo[k])]
        np.add.at(gone, hit, 1)
        np.add.at(gone, hit + WINDOW, -1)
    gone = np.cumsum(gone)[: len(c.hashes)] > 0
    out = {k: [] for k in ("doc_id", "n_words", "n_removed", "spans", "kept_sha256")}
    for d, words, i, j in zip(c.ids, c.words, c.starts[:-1].tolist(), c.starts[1:].tolist(), strict=True):
        g = gone[i:j]
        n = int(g.sum())
        turns = np.flatnonzero(np.diff(np.concatenate([[0], g.view(np.int8), [0]]))) if n else np.zeros(0, np.int64)
        kept = words if not n else [w for w, x in zip(words, g.tolist(), strict=True) if not x]
        for name, value in zip(out, (d, j - i, n, [{"start": s, "end": e} for s, e in turns.reshape(-1, 2).tolist()], hashlib.sha256(b" ".join(kept)).hexdigest()), strict=True):
            out[name].append(value)
    kinds = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    return pa.table(out, schema=pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", kinds), ("kept_sha256", pa.string())]))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (SPANS) per row: the maximal runs of words covered by windows that also start in a document with a smaller id.

    Null texts have no words. Rows that share an id are one document to each other: a window is removed only for a smaller id. Rows with a null id
    keep all words and make no other row lose any. An empty table gives no rows. Other columns are not read. Windows of equal words are told by 96 bits
    of two hashes: among the 2e13 windows of 100 TB 3e-3 pairs of different ones are expected to share them.
    """
    size, count = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string"))), F.count("*")).first()
    chunks, parts = max(1, -(-(size or 0) // CHUNK_BYTES), count // 20_000), max(1, -(-(size or 0) // PART_BYTES))
    d = docs.select(F.pmod(F.xxhash64(id_col, text_col), F.lit(chunks)).alias("chunk"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    d = d.repartition("chunk")  # one shuffle of the texts: the three steps below reuse it
    hits = d.groupBy("chunk").applyInArrow(_send(parts), SENT).groupBy("part").applyInArrow(_hits, HITS)
    wide = d.groupBy("chunk").cogroup(hits.groupBy("chunk")).applyInArrow(_extend(parts), WIDE)
    found = wide.groupBy("part").applyInArrow(_firsts, FOUND)
    return d.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(_remove, SPANS)


def op5_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")
