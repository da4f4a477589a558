"""Embedding near-dedup: PCA-ordered tiles, with suffix-norm bounds that end a comparison early."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, saved, table

THRESHOLD = 0.95
#: Bytes of vectors (as doubles) in a tile, and leading axes by which tiles are cut and bounded.
TILE_BYTES, AXES = 8 << 20, 16
#: Vectors by which the cuts between tiles are chosen, about: they decide how even tiles are, not which pairs are found.
SAMPLE = 8192
#: Leading dimensions after which bounds are tested.
STEPS = (8, 12, 16, 24, 32, 64, 128, 256)
#: Cosines this near the threshold are computed again from the vectors as given.
MARGIN = 1e-9
#: Rows and columns of the blocks that a pair of tiles is compared in.
BLOCK = 1024, 4096
PARTIAL = "node long, links long, other long"


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, v (array of doubles, or of floats where the column has floats) and whether the vector can link: not null, not empty, all finite, not zero."""
    kind = "float" if df.schema[vec_col].dataType.simpleString() == "array<float>" else "double"
    v = F.col(vec_col).cast(f"array<{kind}>")
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.select(F.col(id_col).cast("long").alias("id"), v.alias("v"), F.coalesce(ok, F.lit(False)).alias("ok"))


def _by_length(column) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, unit vectors as doubles) for each length of vectors in the column."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes, values = np.diff(flat.offsets.to_numpy()), flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    out = []
    for n in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == n)
        out.append((rows, _unit(values[starts[rows][:, None] + np.arange(n)])))
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """By length of vectors: the principal axes of all unit vectors of that length, as columns by falling variance. Sums of products per task, added up row by row of the matrix."""

    def products(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for _, x in _by_length(b.column(0)):
                total[x.shape[1]] = total.get(x.shape[1], 0) + x.T @ x
        for n, m in total.items():
            yield pa.RecordBatch.from_pydict({"dim": [n] * n, "i": list(range(n)), "s": [r.tobytes() for r in m]}, schema=rows)

    def add(t: pa.Table) -> pa.Table:
        s = np.sum([np.frombuffer(x) for x in t.column("s").to_pylist()], axis=0)
        return pa.table({"dim": t.column("dim")[:1], "i": t.column("i")[:1], "s": [s.tobytes()]}, schema=rows)

    rows = pa.schema([("dim", pa.int32()), ("i", pa.int32()), ("s", pa.binary())])
    ddl = "dim int, i int, s binary"
    found: dict[int, np.ndarray] = {}
    for r in vectors.select("v").mapInArrow(products, ddl).groupBy("dim", "i").applyInArrow(add, ddl).collect():  # a row for each dimension
        found.setdefault(r["dim"], np.zeros((r["dim"], r["dim"])))[r["i"]] = np.frombuffer(r["s"])
    return {n: np.ascontiguousarray(np.linalg.eigh((m + m.T) / 2)[1][:, ::-1]) for n, m in found.items()}


class Cuts:
    """A k-d tree over leading coordinates: cell numbers of vectors."""

    def __init__(self, sample: np.ndarray, cells: int):
        self.axis, self.cut, self.left, self.cell = [], [], [], []
        self.n = 0
        self._split(sample, cells)

    def _split(self, y: np.ndarray, cells: int) -> int:
        k = len(self.axis)
        for x, v in ((self.axis, 0), (self.cut, 0.0), (self.left, (0, 0)), (self.cell, -1)):
            x.append(v)
        a = int(np.argmax(y.var(axis=0))) if len(y) > 1 else 0
        cut = float(np.quantile(y[:, a], (cells // 2) / cells)) if len(y) > 1 and cells > 1 else 0.0
        low = y[:, a] < cut
        if cells < 2 or not low.any() or low.all():
            self.cell[k], self.n = self.n, self.n + 1
        else:
            self.axis[k], self.cut[k] = a, cut
            self.left[k] = self._split(y[low], cells // 2), self._split(y[~low], cells - cells // 2)
        return k

    def place(self, y: np.ndarray) -> np.ndarray:
        at, cell = np.zeros(len(y), np.int64), np.array(self.cell)
        while (open_ := np.flatnonzero(cell[at] < 0)).size:
            k = at[open_]
            low = y[open_, np.array(self.axis)[k]] < np.array(self.cut)[k]
            at[open_] = np.array(self.left)[k, np.where(low, 0, 1)]
        return cell[at]


def _tails(y: np.ndarray, k: int) -> np.ndarray:
    return np.sqrt((y[:, k:] ** 2).sum(axis=1))


def near_cells(boxes: np.ndarray, mine: np.ndarray, threshold: float) -> np.ndarray:
    """Which of `boxes` may hold a vector that links with one in `mine`. A box: lowest and highest leading coordinates, largest suffix norm."""
    n = (boxes.shape[1] - 1) // 2
    lo, hi, tail = boxes[:, :n], boxes[:, n : 2 * n], boxes[:, -1]
    a, b, t = mine[:n], mine[n : 2 * n], mine[-1]
    most = np.max([lo * a, lo * b, hi * a, hi * b], axis=0).sum(axis=1) + tail * t
    gap = np.maximum(0, np.maximum(lo - b, a - hi))
    return np.flatnonzero((most >= threshold - MARGIN) & ((gap**2).sum(axis=1) <= 2 - 2 * threshold + MARGIN))


class Forest:
    """Components of the vectors of two tiles, joined by links as they come; keeps the edges that joined two."""

    def __init__(self, n: int):
        self.label, self.edges = np.arange(n), []

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            apart = np.flatnonzero(self.label[i] != self.label[j])
            if not len(apart):
                return
            i, j = i[apart], j[apart]
            some = np.union1d(np.unique(i, return_index=True)[1], np.unique(j, return_index=True)[1])
            root: dict[int, int] = {}

            def find(x):
                while x in root:
                    x = root[x]
                return x

            for a, b in zip(i[some].tolist(), j[some].tolist(), strict=True):
                x, y = find(int(self.label[a])), find(int(self.label[b]))
                if x != y:
                    root[max(x, y)] = min(x, y)
                    self.edges.append((a, b))
            names = np.unique(self.label)
            self.label = np.array([find(x) for x in names.tolist()])[np.searchsorted(names, self.label)]


def linked(a: np.ndarray, b: np.ndarray, ya: np.ndarray, yb: np.ndarray, threshold: float, same: bool):
    """Links of unit vectors a with b, block by block, as pairs of row numbers (i < j if they are the same vectors). ya, yb: along the principal axes.

    The product over the leading dimensions with the suffix norms as one more coordinate is an upper bound of the cosine. It is first taken of a whole
    block, in single precision with its rounding allowed for; pairs that may still reach the threshold go on to further dimensions, and the
    cosine of the vectors as given, in double precision, decides.
    """
    dim = a.shape[1]
    steps = [k for k in STEPS if k < dim]

    def bounded(y: np.ndarray, k: int, kind) -> np.ndarray:
        return np.concatenate([y[:, :k], _tails(y, k)[:, None]], axis=1).astype(kind)

    # the fewest dimensions that leave few pairs of some vectors: only the speed depends on it
    first = dim
    for k in steps:
        some = bounded(ya[:: max(1, len(ya) // 128)], k, float) @ bounded(yb[:: max(1, len(yb) // 128)], k, float).T >= threshold
        if some.mean() < 0.01:
            first = k
            break
    else:
        first = steps[-1] if steps else dim
    la, lb = bounded(ya, first, np.float32), bounded(yb, first, np.float32)
    least = np.float32(threshold - MARGIN - (first + 16) * 2.0**-23)
    more = [k for k in steps if k > first]
    for at in range(0, len(a), BLOCK[0]):
        for bt in range(at if same else 0, len(b), BLOCK[1]):
            x, y = slice(at, min(at + BLOCK[0], len(a))), slice(bt, min(bt + BLOCK[1], len(b)))
            width = y.stop - y.start
            i, j = np.divmod(np.flatnonzero(la[x] @ lb[y].T >= least), width)
            if len(i) > 0.02 * (x.stop - x.start) * width:  # many: the whole cosines
                r, c = np.unique(i), np.unique(j)
                p, q = np.nonzero(a[x][r] @ b[y][c].T >= threshold)
                i, j = r[p] + at, c[q] + bt
                if same:
                    i, j = i[i < j], j[i < j]
            else:
                i, j = i + at, j + bt
                if same:
                    i, j = i[i < j], j[i < j]
                for k in more:
                    if not len(i):
                        break
                    keep = np.einsum("ij,ij->i", ya[i, :k], yb[j, :k]) + _tails(ya[i], k) * _tails(yb[j], k) >= threshold - MARGIN
                    i, j = i[keep], j[keep]
                keep = np.einsum("ij,ij->i", a[i], b[j]) >= threshold
                i, j = i[keep], j[keep]
            if len(i):
                yield i, j


def _compare(turns: dict[int, np.ndarray], threshold: float):
    def run(key, t):
        low, high = key[0].as_py(), key[1].as_py()
        tile = t.column("tile").to_numpy()
        sides = []
        for k in (low,) if low == high else (low, high):
            some = t.filter(pa.array(tile == k))
            x = _by_length(some.column("v"))[0][1]
            sides.append((some.column("node").to_numpy().astype(np.int64), some.column("copies").to_numpy().astype(np.float64), x, x @ turns[x.shape[1]]))
        a, b, same = sides[0], sides[-1], low == high
        shift = 0 if same else len(a[0])
        node, copies = (a[0], a[1]) if same else (np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]]))
        counts, forest = np.zeros(len(node)), Forest(len(node))
        for i, j in linked(a[2], b[2], a[3], b[3], threshold, same):
            j = j + shift
            counts += np.bincount(i, copies[j], len(node)) + np.bincount(j, copies[i], len(node))
            forest.join(i, j)
        k = np.flatnonzero(counts)
        e = np.array(forest.edges, np.int64).reshape(-1, 2)
        none = np.zeros(len(k), np.int64)
        return pa.table({
            "node": np.concatenate([node[k], node[e[:, 0]]]), "links": np.concatenate([counts[k].astype(np.int64), np.zeros(len(e), np.int64)]),
            "other": pa.array(np.concatenate([none, node[e[:, 1]]]), pa.int64(), mask=np.concatenate([none == 0, np.zeros(len(e), bool)])),
        })

    return run


def _compared(classes: DataFrame, threshold: float) -> DataFrame:
    """classes (node, v, copies) -> PARTIAL: counts of links by class and pair of tiles, and edges of spanning forests.

    Cells of a k-d tree along the principal axes, cut into tiles of bounded size. A tile meets the tiles of those cells whose box of leading
    coordinates and largest suffix norms leave a link possible; only then are its vectors sent there.
    """
    turns = axes(classes)
    sizes = {r[0]: r[1] for r in classes.groupBy(F.size("v")).count().collect()}  # a row for each length of vectors
    m = max(1, sum(sizes.values()) // SAMPLE)
    lead = {n: turns[n][:, :AXES] for n in turns}
    sample: dict[int, list[np.ndarray]] = {n: [] for n in turns}
    for b in classes.where(F.pmod(F.xxhash64("node"), F.lit(m)) == 0).select("v").toArrow().to_batches():
        for _, x in _by_length(b.column(0)):
            sample[x.shape[1]].append(x @ lead[x.shape[1]])
    most = {n: max(256, TILE_BYTES // (8 * n)) for n in turns}
    cuts, first, total = {}, {}, 0
    for n in sorted(turns):
        cuts[n] = Cuts(np.concatenate([np.zeros((0, lead[n].shape[1])), *sample[n]]), -(-sizes[n] // most[n]))
        first[n], total = total, total + cuts[n].n

    def place(batches):
        for b in batches:
            cell = np.zeros(b.num_rows, np.int64)
            for rows, x in _by_length(b.column("v")):
                cell[rows] = first[x.shape[1]] + cuts[x.shape[1]].place(x @ lead[x.shape[1]])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int64())], names=[*b.schema.names, "cell"])

    def box(batches):
        found: dict[tuple[int, int], np.ndarray] = {}
        count: dict[tuple[int, int], int] = {}
        for b in batches:
            cell = b.column("cell").to_numpy()
            for rows, x in _by_length(b.column("v")):
                n = x.shape[1]
                y = x @ turns[n]
                k = min(AXES, n)
                one = np.concatenate([-y[:, :k], y[:, :k], _tails(y, k)[:, None]], axis=1)
                order = np.argsort(cell[rows], kind="stable")
                names, at = np.unique(cell[rows][order], return_index=True)
                for c, r, size in zip(names.tolist(), np.maximum.reduceat(one[order], at), np.diff([*at, len(rows)]).tolist(), strict=True):
                    found[n, c] = np.maximum(found[n, c], r) if (n, c) in found else r
                    count[n, c] = count.get((n, c), 0) + size
        if found:
            yield pa.RecordBatch.from_pydict({"dim": [n for n, _ in found], "cell": [c for _, c in found], "n": [count[k] for k in found], "box": [r.tolist() for r in found.values()]}, schema=pa.schema([("dim", pa.int32()), ("cell", pa.int64()), ("n", pa.int64()), ("box", pa.list_(pa.float64()))]))

    ddl = f"node long, v {classes.schema['v'].dataType.simpleString()}, copies long"
    placed = saved(classes.select("node", "v", "copies").mapInArrow(place, f"{ddl}, cell long"))
    # a row for each cell: a cell stands for megabytes of vectors
    by_cell: dict[int, list] = {}
    for r in placed.mapInArrow(box, "dim int, cell long, n long, box array<double>").collect():
        x = by_cell.setdefault(r["cell"], [r["dim"], 0, np.full(len(r["box"]), -np.inf)])
        x[1], x[2] = x[1] + r["n"], np.maximum(x[2], r["box"])
    tiles, start, at = {}, {}, 0
    for c in sorted(by_cell):
        tiles[c], start[c], at = -(-by_cell[c][1] // most[by_cell[c][0]]), at, at + -(-by_cell[c][1] // most[by_cell[c][0]])
    boxes = {}
    for n in turns:
        names = np.array([c for c in sorted(by_cell) if by_cell[c][0] == n])
        k = min(AXES, n)
        boxes[n] = names, np.array([np.concatenate([-by_cell[c][2][:k], by_cell[c][2][k:]]) for c in names.tolist()]).reshape(len(names), 2 * k + 1)

    def deal(batches):
        near: dict[int, np.ndarray] = {}
        for b in batches:
            cell, spread = b.column("cell").to_numpy(), b.column("spread").to_numpy()
            for c in np.unique(cell).tolist():
                if c not in near:
                    names, all_ = boxes[by_dim[c]]
                    met = near_cells(all_, all_[np.searchsorted(names, c)], threshold)
                    near[c] = np.concatenate([np.zeros(0, np.int64), *(np.arange(start[x], start[x] + tiles[x]) for x in names[met].tolist())])
            own = np.array([start[c] for c in cell.tolist()], np.int64) + spread % np.array([tiles[c] for c in cell.tolist()], np.int64)
            n = np.array([len(near[c]) for c in cell.tolist()], np.int64)
            other = np.concatenate([np.zeros(0, np.int64), *(near[c] for c in cell.tolist())])
            row, tile = np.repeat(np.arange(b.num_rows), n), np.repeat(own, n)
            for lo in range(0, len(row), 8192):
                some = slice(lo, lo + 8192)
                sent = b.select(["node", "v", "copies"]).take(pa.array(row[some]))
                yield pa.RecordBatch.from_arrays([*sent.columns, pa.array(tile[some]), pa.array(np.minimum(tile, other)[some]), pa.array(np.maximum(tile, other)[some])], names=["node", "v", "copies", "tile", "low", "high"])

    by_dim = {c: x[0] for c, x in by_cell.items()}
    pairs = placed.withColumn("spread", F.pmod(F.xxhash64("node"), F.lit(1 << 40))).mapInArrow(deal, f"{ddl}, tile long, low long, high long")
    return pairs.groupBy("low", "high").applyInArrow(_compare(turns, threshold), PARTIAL)


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """One row (id, n_links, component_id) per row; vectors link at cosine >= threshold, in double precision.

    Equal vectors form one class first, so that a group of copies costs one comparison. Every row is a vector of its own: rows that share an id
    have their own links, and n_links counts rows. component_id is the smallest id in the component; rows without an id link like others, and have
    none if no row of their component has one. Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do
    vectors of different lengths. Other columns, whatever their names, are not read. An empty table gives no rows.
    """
    rows = saved(usable(df, id_col, vec_col))
    grouped = rows.where("ok").groupBy("v").agg(F.min("id").alias("least"), F.count("*").alias("copies"))
    classes = saved(grouped.withColumn("node", F.monotonically_increasing_id()))
    alone = rows.where("NOT ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    if classes.isEmpty():
        return alone
    partial = saved(_compared(classes, threshold))
    counts = partial.where("other IS NULL").groupBy("node").agg(F.sum("links").alias("links"))
    roots = connected_components(partial.where("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")))
    named = classes.join(counts, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = named.select("v", "root", "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    found = rows.where("ok").join(named.join(smallest, "root").drop("root", "least"), "v").select("id", "n_links", "component_id")
    return found.union(alone)


def op1_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    """All vectors with links and components; `kept` also where a row has no id and nothing that it links with has one."""
    found = near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
