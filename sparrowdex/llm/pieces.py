"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi search."""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

SPACE = "▁"
#: Units (runs of spaces with the word after them) whose ids a worker keeps, in each of two generations. A bound on memory only.
CACHE = 250_000
#: What an unknown character scores below the lowest piece.
UNKNOWN_PENALTY = 10.0
#: Kinds of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes):
    """(number, value) of the fields of a protocol buffer message; varints as int, the rest as bytes."""
    at = 0

    def varint():
        nonlocal at
        x = shift = 0
        while True:
            b = data[at]
            at += 1
            x |= (b & 127) << shift
            if b < 128:
                return x
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            value = varint()
        else:
            n = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            value = data[at : at + n]
            at += n
        yield tag >> 3, value


class PieceModel:
    """Pieces and scores of a SentencePiece model file, read as a unigram language model.

    The best segmentation has the highest sum of scores; of equal ones, at each position that with the longest last piece. A character that
    no piece covers becomes its UTF-8 bytes (or the unknown piece in models without bytes).
    """

    def __init__(self, path: str):
        import ahocorasick

        with open(path, "rb") as f:
            data = f.read()
        self.pieces, self.scores, kinds, normal = [], [], [], {}
        for number, value in _fields(data):
            if number == 1:
                p = dict(_fields(value))
                self.pieces.append(p[1].decode())
                self.scores.append(float(np.frombuffer(p.get(2, b"\0\0\0\0"), "<f4")[0]))
                kinds.append(p.get(3, NORMAL))
            elif number == 3:
                normal = dict(_fields(value))
        if normal.get(2) or normal.get(1, b"identity") != b"identity":
            raise ValueError("only models with the identity normalizer are supported")
        self.dummy_prefix, self.squeeze = bool(normal.get(3, 1)), bool(normal.get(4, 1))
        self.kinds = kinds
        self.bytes = {int(p[3:5], 16): k for k, p in enumerate(self.pieces) if kinds[k] == BYTE}
        self.byte_of = {k: b for b, k in self.bytes.items()}
        self.unknown = kinds.index(UNKNOWN)
        self.auto = ahocorasick.Automaton()
        usable = [k for k in range(len(kinds)) if kinds[k] in (NORMAL, USER)]
        for k in usable:
            self.auto.add_word(self.pieces[k], (len(self.pieces[k]), self.scores[k], k))
        self.auto.make_automaton()
        self.unknown_score = min(self.scores[k] for k in usable) - UNKNOWN_PENALTY
        # Text falls apart, whatever the best segmentation, where no piece goes on: before a space that follows another character,
        # and around a line break, if no piece has either inside.
        whole = all(SPACE not in self.pieces[k].lstrip(SPACE) for k in usable) and all("\n" not in self.pieces[k] for k in usable)
        self.units = re.compile(rf"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n") if whole else re.compile(r"[\s\S]+")
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def viterbi(self, unit: str) -> list[int]:
        """Ids of one unit. The automaton names the pieces that end at each position, longest first; each relaxes the best score there."""
        n = len(unit)
        low = float("-inf")
        best, back, ids = [0.0] + [low] * n, [0] * (n + 1), [-1] * (n + 1)
        at = 1
        unknown = self.unknown_score
        for end, (size, score, k) in self.auto.iter(unit):
            end += 1
            while at < end:  # positions that have been passed are settled: fill those that no single character piece reached
                if ids[at] < 0 or at - back[at] > 1:
                    self._cover(best, back, ids, at, unknown)
                at += 1
            new = best[end - size] + score
            if new > best[end]:
                best[end], back[end], ids[end] = new, end - size, k
        while at <= n:
            self._cover(best, back, ids, at, unknown)
            at += 1
        out = []
        while n:
            k, lo = ids[n], back[n]
            if k >= 0:
                out.append(k)
            elif self.bytes:
                out += [self.bytes[b] for b in reversed(unit[lo:n].encode())]
            elif not (out and out[-1] == self.unknown):  # a run of unknown characters is one unknown piece
                out.append(self.unknown)
            n = lo
        return out[::-1]

    def _cover(self, best, back, ids, at, unknown):
        new = best[at - 1] + unknown
        if new > best[at]:
            best[at], back[at], ids[at] = new, at - 1, -1

    def prepared(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        return (SPACE if self.dummy_prefix and text else "") + text.replace(" ", SPACE)

    def encode(self, text: str) -> np.ndarray:
        units = self.units.findall(self.prepared(text))
        get = self.cache.get
        out = list(map(get, units))
        if None in out:
            if len(self.cache) > CACHE:
                self.old, self.cache = self.cache, {}
            cache, old = self.cache, self.old
            for k, x in enumerate(out):
                if x is None:
                    u = units[k]
                    x = cache.get(u) or old.get(u) or np.array(self.viterbi(u), "<u4").tobytes()
                    if len(u) <= 64:
                        cache[u] = x
                    out[k] = x
        return np.frombuffer(b"".join(out), "<u4")

    def decode(self, ids) -> str:
        pieces, byte_of, out, run = self.pieces, self.byte_of, [], bytearray()
        for k in ids:
            b = byte_of.get(k)
            if b is not None:
                run.append(b)
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run = bytearray()
            if self.kinds[k] != CONTROL:
                out.append(pieces[k])
        out.append(run.decode("utf-8", "replace"))
        text = "".join(out).replace(SPACE, " ")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


@lru_cache(maxsize=2)
def model(path: str) -> PieceModel:
    return PieceModel(path)


def _parts(batches):
    for b in batches:
        for at in range(0, b.num_rows, 512):
            yield b.slice(at, 512)


def _encoded(m: PieceModel, texts: pa.Array) -> pa.ListArray:
    lists = [m.encode(t or "").astype(np.int32) for t in texts.to_pylist()]
    ends = np.cumsum([0, *map(len, lists)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *lists]), pa.int32()))


def _decoded(m: PieceModel, ids: pa.ListArray) -> pa.Array:
    flat, ends = ids.values.to_numpy(), ids.offsets.to_numpy()
    return pa.array([m.decode(flat[a:b].tolist()) for a, b in zip(ends, ends[1:])], pa.string())


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, ids array<int>) per row; a null text gives no ids. No shuffle."""

    def run(batches):
        m = model(path)
        for part in _parts(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), _encoded(m, part.column(1))], ["id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(id, ids) -> (id, text)."""

    def run(batches):
        m = model(path)
        for part in _parts(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), _decoded(m, part.column(1))], ["id", "text"])

    return encoded.mapInArrow(run, "id long, text string")


#: Columns that round_trip adds.
ROUND_TRIP = ("ids", "text", "n_tokens", "n_bytes", "ids_crc32", "decoded_sha256", "exact")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Encodes every text and decodes its ids: id, columns `keep` as they are, ids, text (decoded), and what follows from these columns: n_tokens, n_bytes (byte pieces), ids_crc32 (of the ids as little-endian unsigned 32-bit integers), decoded_sha256, exact (the text came back)."""
    import hashlib

    names = ["id", *keep, *ROUND_TRIP]

    def run(batches):
        m = model(path)
        is_byte = np.array([k == BYTE for k in m.kinds])
        for part in _parts(batches):
            ids = _encoded(m, part.column(1))
            text = _decoded(m, ids)
            flat, ends = ids.values.to_numpy(), ids.offsets.to_numpy()
            rows = []
            for k, (t, back) in enumerate(zip(part.column(1).to_pylist(), text.to_pylist(), strict=True)):
                x = flat[ends[k] : ends[k + 1]]
                rows.append((len(x), int(is_byte[x].sum()), zlib.crc32(x.astype("<u4").tobytes()), hashlib.sha256(back.encode()).hexdigest(), back == (t or "")))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([part.column(0), *part.columns[2:], ids, text, *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], names)

    kept = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    out = f"id long{kept}, ids array<int>, text string, n_tokens long, n_bytes long, ids_crc32 long, decoded_sha256 string, exact boolean"
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"), *[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)]).mapInArrow(run, out)


def op4_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """All documents encoded (ids), decoded (text) and compared, row by row.

    Null text counts as empty: no tokens, exact. A very long text is cut into units, never shortened; a null doc_id stays null; rows that repeat
    each have their row. Columns besides doc_id and text are not read. An empty table gives no rows.
    """
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")).withColumnRenamed("id", "doc_id")
