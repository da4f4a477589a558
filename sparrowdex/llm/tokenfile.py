"""Token ids in a fixed-width bit-packed file format: writing, reading back, random access."""

from __future__ import annotations

import json
import re
import struct
import unicodedata
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_folder, saved, table

MAGIC = b"SDXTOK1\x00"
#: Ids in a block: each block starts at a byte of its own, so that it can be read and unpacked alone.
BLOCK_IDS = 65536
END_ID = 2
#: Pre-tokens whose ids a worker keeps. Only a bound on memory: others are encoded again.
CACHE = 400_000
#: Bytes of text a file is planned to hold, and ids after which a task begins another file.
FILE_BYTES, FILE_IDS = 16 << 20, 8 << 20
#: Characters of a text that order rows of the same id; beyond them its hash does.
ORDER_CHARS = 64

# -- bit packing ----------------------------------------------------------------------------------------------------------------


def width_for(vocabulary: int) -> int:
    """Least bits that hold every id below `vocabulary`."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Little-endian bit packing: id k has the bits [k * width, (k + 1) * width)."""
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = np.unpackbits(np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width]
    return np.packbits(bits, bitorder="little").tobytes()


def unpack(data: bytes, n: int, width: int) -> np.ndarray:
    if width in (8, 16, 32):
        return np.frombuffer(data, f"<u{width // 8}", n).astype(np.uint32)
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n * width, bitorder="little").reshape(n, width)
    out = np.zeros((n, 32), np.uint8)
    out[:, :width] = bits
    return np.packbits(out, axis=1, bitorder="little").view("<u4").ravel()


# A file: MAGIC; header (width, block_ids, documents, ids: four unsigned 64-bit little-endian); doc ids (int64, with
# -2^63 for null); where each document's ids start (uint64, one more than documents); where each block starts in the
# file (uint64, one more than blocks); the blocks.


def file_bytes(doc_ids, lists: list[np.ndarray], width: int, block_ids: int = BLOCK_IDS) -> bytes:
    starts = np.zeros(len(lists) + 1, "<u8")
    np.cumsum([len(x) for x in lists], out=starts[1:])
    ids = np.concatenate([np.zeros(0, np.uint32), *lists])
    blocks = [pack(ids[i : i + block_ids], width) for i in range(0, len(ids), block_ids)]
    head = MAGIC + struct.pack("<4Q", width, block_ids, len(lists), len(ids)) + np.array(doc_ids, "<i8").tobytes() + starts.tobytes()
    at = np.zeros(len(blocks) + 1, "<u8")
    np.cumsum([len(b) for b in blocks], out=at[1:])
    at += np.uint64(len(head) + at.nbytes)
    return b"".join([head, at.tobytes(), *blocks])


class TokenFile:
    """Random access to a file of this format, given a function read(start, length)."""

    def __init__(self, read):
        self._read = read
        size = len(MAGIC) + 32
        head = read(0, size)
        if head[: len(MAGIC)] != MAGIC:
            raise ValueError("not a token file")
        self.width, self.block_ids, n, self.n_ids = struct.unpack("<4Q", head[len(MAGIC) :])
        self.doc_ids = np.frombuffer(read(size, 8 * n), "<i8")
        self.starts = np.frombuffer(read(size + 8 * n, 8 * (n + 1)), "<u8").astype(np.int64)
        n_blocks = -(-self.n_ids // self.block_ids)
        self.blocks = np.frombuffer(read(size + 16 * n + 8, 8 * (n_blocks + 1)), "<u8").astype(np.int64)

    def block(self, k: int) -> np.ndarray:
        n = min(self.block_ids, self.n_ids - k * self.block_ids)
        return unpack(self._read(int(self.blocks[k]), int(self.blocks[k + 1] - self.blocks[k])), n, self.width)

    def ids(self, lo: int, hi: int) -> np.ndarray:
        """Ids [lo, hi); reads only the blocks that hold them."""
        if hi <= lo:
            return np.zeros(0, np.uint32)
        first, last = lo // self.block_ids, (hi - 1) // self.block_ids
        return np.concatenate([self.block(k) for k in range(first, last + 1)])[lo - first * self.block_ids : hi - first * self.block_ids]

    def documents(self):
        """(doc id, start in the file, ids) in file order; each block is read once."""
        at, held = -1, np.zeros(0, np.uint32)
        for d, lo, hi in zip(self.doc_ids, self.starts[:-1], self.starts[1:], strict=True):
            parts = []
            while lo < hi:
                k = lo // self.block_ids
                if k != at:
                    at, held = k, self.block(k)
                to = min(hi, (k + 1) * self.block_ids)
                parts.append(held[lo - k * self.block_ids : to - k * self.block_ids])
                lo = to
            yield int(d), parts[0] if len(parts) == 1 else np.concatenate([np.zeros(0, np.uint32), *parts])


# -- encoding ------------------------------------------------------------------------------------------------------------------

# Texts of these characters alone are split here; any other text goes through the tokenizer as a whole.
_LETTERS = "a-zA-ZªµºÀ-ÖØ-öø-ſ"
_PLAIN = re.compile(rf"[\t\n\r\x20-\x7e¡-±´-¸»¿-ſ‐-‧‰-⁞€]*")
_SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\s0-9{_LETTERS}]+")


class WordEncoder:
    """Encodes texts as a tokenizers file with word-wise pre-tokens does, keeping the ids of pre-tokens seen before."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [x["content"] for x in spec["added_tokens"]]
        # the same model alone: its input comes as pre-tokens, one to a piece
        self.model = Tokenizer.from_file(path)
        from tokenizers import normalizers

        self.model.normalizer = normalizers.Sequence([])
        self.model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split("\n", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.fast = split == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+" and [x["type"] for x in spec["normalizer"]["normalizers"]] == ["NFC", "Replace", "Lowercase"]
        self.vocabulary = max(self.whole.get_vocab(True).values()) + 1
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}  # the generation before

    def encode_whole(self, text: str) -> np.ndarray:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)

    def _learn(self, new: list[str]) -> None:
        for at in range(0, len(new), 8192):
            some = new[at : at + 8192]
            got = self.model.encode("\n".join(some), add_special_tokens=False)
            ids = np.array(got.ids, "<u4").tobytes()
            ends = np.searchsorted(np.array(got.word_ids, np.int64), np.arange(len(some)), "right").tolist()
            lo = 0
            for w, hi in zip(some, ends, strict=True):
                self.cache[w] = ids[4 * lo : 4 * hi]
                lo = hi

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        split, out = [], []
        for t in texts:
            if not self.fast or not _PLAIN.fullmatch(t) or any(s in t for s in self.special):
                split.append(None)
            else:
                split.append(_SPLIT.findall(unicodedata.normalize("NFC", t).lower()))
        for k, (text, parts) in enumerate(zip(texts, split, strict=True)):
            if k % 64 == 0:  # some texts at a time, so that their new pre-tokens are encoded at one go
                if len(self.cache) > CACHE:
                    self.old, self.cache = self.cache, {}
                new = set().union(*filter(None, split[k : k + 64])).difference(self.cache)
                again = {x: self.old[x] for x in new if x in self.old}
                self.cache |= again
                self._learn(list(new.difference(again)))
            out.append(self.encode_whole(text) if parts is None else np.frombuffer(b"".join(map(self.cache.__getitem__, parts)), "<u4"))
        return out


@lru_cache(maxsize=4)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


# -- Spark --------------------------------------------------------------------------------------------------------------------

WRITTEN = "file string, first_doc long, first_text string, first_hash long, piece int, docs long, ids long"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long"
_NULL_ID = -(1 << 63)
_LISTED = pa.schema([("file", pa.string()), ("first_doc", pa.int64()), ("first_text", pa.string()), ("first_hash", pa.int64()), ("piece", pa.int32()), ("docs", pa.int64()), ("ids", pa.int64())])


def _open(folder: str):
    """(file system, path) of a folder named by a URI or a plain path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else "file://" + folder)


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, file_ids: int = FILE_IDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the ids of every text to files in `folder`, in ascending order of ids (null first), and returns the list of files (WRITTEN).

    Rows of the same id, or of none, follow each other by the first ORDER_CHARS characters of their texts, then by a hash of them: however many
    there are, many tasks share them. Texts are ranged by that order once; each task encodes its range and writes a file whenever file_ids ids
    are there, under a name of its own attempt, so a task that runs twice leaves files that the list does not name. The list, a row a file, is computed once.
    """

    def run(batches):
        import os

        tok = encoder(tokenizer)
        width = width_for(max(tok.vocabulary, end_id + 1))
        end = np.array([end_id], np.uint32)
        small = np.uint16 if width <= 16 else np.uint32
        where, path = _open(folder)
        piece, first, ids, lists, n_ids = 0, None, [], [], 0

        def flush():
            where.create_dir(path, recursive=True)
            name = f"ids-{ids[0] + (1 << 63):020d}-{os.urandom(6).hex()}.bin"
            with where.open_output_stream(f"{path}/{name}") as f:
                f.write(file_bytes(ids, lists, width))
            row = {"file": name, "first_doc": ids[0], "first_text": first[0], "first_hash": first[1], "piece": piece, "docs": len(ids), "ids": n_ids}
            return pa.RecordBatch.from_pylist([row], _LISTED)

        for b in batches:
            for at in range(0, b.num_rows, 256):
                some = b.slice(at, 256)
                if not ids:
                    first = some.column(2)[0].as_py(), some.column(3)[0].as_py()
                ids += [_NULL_ID if x is None else x for x in some.column(0).to_pylist()]
                new = [np.append(x, end).astype(small) for x in tok.encode_batch([t or "" for t in some.column(1).to_pylist()])]
                lists += new
                n_ids += sum(map(len, new))
                if n_ids >= file_ids:
                    yield flush()
                    piece, ids, lists, n_ids = piece + 1, [], [], 0
        if ids:
            yield flush()

    text = F.col(text_col).cast("string")
    ranged = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.substring(text, 1, ORDER_CHARS).alias("first_text"), F.xxhash64(text).alias("first_hash"))
    size = ranged.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    order = [F.asc_nulls_first(c) for c in ("doc_id", "first_text", "first_hash")]
    ordered = ranged.repartitionByRange(max(1, -(-size // FILE_BYTES)), *order).sortWithinPartitions(*order)
    return saved(ordered.mapInArrow(run, WRITTEN))


def read_token_files(files: DataFrame, folder: str) -> DataFrame:
    """One row (READ) per document of the listed files, read block by block where they lie; `start` counts the ids of all documents before it."""
    from pyspark.sql.window import Window as W

    before = F.coalesce(F.sum("ids").over(W.orderBy("first_doc", "first_text", "first_hash", "piece").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    listed = saved(files.withColumn("at", before).select("file", "at"))  # one row a file: a window over all of them is small

    def run(batches):
        where, path = _open(folder)
        for b in batches:
            for name, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with where.open_input_file(f"{path}/{name}") as f:
                    rows = {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": []}
                    for d, ids in TokenFile(lambda start, n, f=f: f.read_at(n, start)).documents():
                        rows["doc_id"].append(None if d == _NULL_ID else d)
                        rows["start"].append(at)
                        rows["n_tokens"].append(len(ids))
                        rows["ids_crc32"].append(zlib.crc32(ids.astype("<u4").tobytes()))
                        at += len(ids)
                yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([(k, pa.int64()) for k in rows]))

    n = max(1, listed.count())
    return listed.repartition(min(n, 4096), "file").mapInArrow(run, READ)


def op6_token_files(spark, sf_dir: str) -> DataFrame:
    """All documents through the file format. Null text: the end id alone; rows with the same doc_id, or none, follow each other by text (see write_token_files); an empty table: no file, no rows."""
    import public_tokenizers

    folder = new_folder(spark, "token-files")
    files = write_token_files(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"))
    return read_token_files(files, folder)
