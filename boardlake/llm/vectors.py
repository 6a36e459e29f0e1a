"""Near-duplicate embeddings: int8 tile products with an error bound for each vector, exact where the bound leaves doubt.

A unit vector u is stored as q int8 numbers and a scale s; e = |u - s q| is measured. For two of them
|u.v - s t (q.r)| <= e + f + e f, so the whole-number product q.r tells most pairs apart for certain: those that can't reach the
limit and those that surely do. Only the pairs between are multiplied again in double precision. No link is missed or made up.

Equal vectors are one class from the start. Classes are dealt to cells around centres that are fitted on a bounded sample
(SAMPLE vectors of least hash). A vector at home in one cell also visits every later cell that a vector near enough to it can
be at home in: the cell lies beyond the plane midway between both centres, and near vectors are at most sqrt(2 - 2 LEAST)
apart. So every pair meets once, whatever the centres are; they decide only how many pairs are looked at. The number of cells
is the one of least work on the sample: one alone for vectors without any clusters, where each pair must be looked at.
A cell is cut into lanes of SIDE vectors at most and a task multiplies two lanes, so a cell of any size is spread out. A tile
gives counts and one link for each vector to its component in the tile, never its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardlake.llm.common import drop, materialise, small_enough
from boardlake.llm.partenum import components

LEAST = 0.9
#: Vectors that cells are fitted on, at most; they don't decide what is found.
SAMPLE = 8192
CELLS = (1, 4, 16, 64, 256, 1024)
#: Numbers of a lane's vectors, and vectors of a lane, at most.
NUMBERS, SIDE = 1 << 20, 16384
#: Rows of the products made at once.
TILE = (1024, 2048)
#: Products that cost as much as sending a vector to one more cell.
SENT = 20_000
#: Room for rounding of double precision in bounds.
ROUNDING = 1e-9


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one in double precision; scaled first, so that no square overflows."""
    rows = rows.astype(np.float64)
    rows /= np.abs(rows).max(1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def quantised(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, and how far each row is from scale times code."""
    scale = np.abs(u).max(1) / 127
    code = np.rint(u / scale[:, None]).astype(np.int8)
    return code, scale, np.sqrt(((u - scale[:, None] * code) ** 2).sum(1)) + ROUNDING


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def linked(x: np.ndarray, y: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of the rows of x and of y (units) whose cosine is least or more, tile by tile."""
    sides = []
    for u in (x, y):
        code, scale, error = quantised(u)
        order = np.argsort(scale, kind="stable")  # like scales in a tile make its one limit for products tight
        sides.append((order, code[order].astype(np.float32 if u.shape[1] < 1000 else np.float64), scale[order], error[order]))
    (ox, qx, sx, ex), (oy, qy, sy, ey) = sides
    for a in range(0, len(x), TILE[0]):
        i = slice(a, a + TILE[0])
        for b in range(0, len(y), TILE[1]):
            j = slice(b, b + TILE[1])
            p = qx[i] @ qy[j].T  # whole numbers, exact in this type
            e, f = ex[i].max(), ey[j].max()
            low = (least - e - f - e * f) / (sx[i].max() * sy[j].max()) if e + f + e * f < least else -math.inf
            m, n = np.nonzero(p >= low * (1 - ROUNDING))
            if not len(m):
                continue
            about = p[m, n].astype(np.float64) * sx[i][m] * sy[j][n]
            off = ex[i][m] + ey[j][n] + ex[i][m] * ey[j][n]
            sure, maybe = about - off >= least, np.flatnonzero(np.abs(about - least) < off)
            m, n = ox[i][m], oy[j][n]
            for k in range(0, len(maybe), 1 << 16):
                some = maybe[k : k + (1 << 16)]
                sure[some] = (x[m[some]] * y[n[some]]).sum(1) >= least
            yield m[sure], n[sure]


def _merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """label (each one's least known fellow, closed) after joining i and j."""
    while True:
        u, v = label[i], label[j]
        apart = u != v
        if not apart.any():
            return
        i, j, u, v = i[apart], j[apart], u[apart], v[apart]
        np.minimum.at(label, np.maximum(u, v), np.minimum(u, v))
        while (up := label[label] != label).any():
            label[up] = label[label[up]]


def tile(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray, wx: np.ndarray, wy: np.ndarray, same: bool, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Node, documents linked to it here, node of its component here, for each node with links; wx, wy: copies of each.

    same: both sides are one lane, and pairs count once."""
    label = np.arange(len(nx) + len(ny))
    count = np.zeros(len(label), np.int64)
    for i, j in linked(x, y, least):
        if same:
            once = nx[i] < ny[j]
            i, j = i[once], j[once]
        count[: len(nx)] += np.bincount(i, wy[j], len(nx)).astype(np.int64)
        count[len(nx) :] += np.bincount(j, wx[i], len(ny)).astype(np.int64)
        _merge(label, i, j + len(nx))
    node = np.concatenate([nx, ny])
    has = count > 0
    return node[has], count[has], node[label[has]]


def centres(sample: np.ndarray, many: int) -> np.ndarray:
    """Unit centres of as many cells (spherical k-means from the first rows on)."""
    found = sample[:many]
    for _ in range(4):
        at = (sample @ found.T).argmax(1)
        sums = np.zeros_like(found)
        np.add.at(sums, at, sample)
        size = np.sqrt((sums * sums).sum(1, keepdims=True))
        found = np.where(size > 1e-6, sums / np.maximum(size, 1e-6), found)
    return found


def places(u: np.ndarray, found: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Home cell of each row; row and cell of each visit to a later cell."""
    near = u @ found.T
    home = near.argmax(1)
    apart = np.sqrt(np.maximum(0, 2 - 2 * found @ found.T))[home]
    reach = near.max(1)[:, None] - near <= math.sqrt(2 - 2 * least) * apart + 1e-7
    row, cell = np.nonzero(reach & (np.arange(len(found)) > home[:, None]))
    return home, row, cell


def fitted(sample: np.ndarray, n: int, least: float) -> np.ndarray:
    """The centres of least work for n vectors like the sample's."""
    best, work = sample[:1], math.inf
    for many in CELLS:
        if many > 1 and (many * 8 > len(sample) or many * 64 > n):
            break
        found = centres(sample, many)
        home, row, cell = places(sample, found, least)
        scale = n / len(sample)
        at_home, visits = np.bincount(home, minlength=many) * scale, np.bincount(cell, minlength=many) * scale
        took = (at_home * (at_home / 2 + visits)).sum() + SENT * (at_home.sum() + visits.sum())
        if took < work:
            best, work = found, took
    return best


def _placed(classes: DataFrame, found: np.ndarray, least: float) -> DataFrame:
    """_cell, _home, _node, _copies, _vec: each class at home and on its visits. Vectors of another size have a cell by size."""
    kind = dict(classes.dtypes)["_vec"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            sizes = np.diff(whole.column(2).offsets.to_numpy())
            for size in np.unique(sizes).tolist():
                batch = whole.filter(pa.array(sizes == size))
                if size == found.shape[1]:
                    home, row, cell = places(unit(_matrix(batch.column(2))), found, least)
                else:
                    home, row, cell = np.full(batch.num_rows, -size), np.empty(0, np.int64), np.empty(0, np.int64)
                at = np.concatenate([np.arange(batch.num_rows), row])
                out = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([home, cell]), pa.int64()), pa.array(np.arange(len(at)) < batch.num_rows), *out.columns],
                    names=["_cell", "_home", "_node", "_copies", "_vec"],
                )

    return classes.select("_node", "_copies", "_vec").mapInArrow(run, f"_cell bigint, _home boolean, _node bigint, _copies bigint, _vec {kind}")


def _tiles(placed: DataFrame, side: int, least: float) -> DataFrame:
    """_node, _links, _near of all tiles. Lanes 0 to h - 1 of a cell are its own vectors, later ones its visitors; lane a meets
    lanes a and later, so each row goes to as many tasks as there are lanes to meet."""
    own = F.col("_home").cast("long")
    cells = placed.groupBy(F.col("_cell").alias("_c")).agg(
        F.ceil(F.sum(own) / side).alias("_lanes"), F.ceil(F.sum(1 - own) / side).alias("_others")
    )
    lane = F.when(F.col("_home"), F.pmod(F.xxhash64("_node"), F.col("_lanes"))).otherwise(
        F.col("_lanes") + F.pmod(F.xxhash64("_node"), F.greatest("_others", F.lit(1)))
    )
    dealt = placed.join(small_enough(materialise(cells)), F.col("_cell") == F.col("_c")).filter("_lanes > 0").withColumn("_lane", lane)
    last = F.col("_lanes") + F.col("_others") - 1
    meets = F.when(F.col("_home"), F.transform(F.sequence("_lane", last), lambda b: F.struct(F.col("_lane").alias("_a"), b.alias("_b")))).otherwise(F.array())
    met = F.transform(F.sequence(F.lit(0).cast("long"), F.least("_lane", F.col("_lanes")) - 1), lambda a: F.struct(a.alias("_a"), F.col("_lane").alias("_b")))
    met = F.when(F.col("_lane") > 0, met).otherwise(F.array())
    lanes = dealt.select("_cell", "_lane", "_node", "_copies", "_vec", F.explode(F.concat(meets, met)).alias("_t")).select("_cell", "_t._a", "_t._b", "_lane", "_node", "_copies", "_vec")

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        a, b = key[1].as_py(), key[2].as_py()
        lane = rows.column("_lane").to_numpy()
        sides = [rows.filter(pa.array(lane == k)) for k in ((a, b) if a != b else (a,))]
        out = [np.empty(0, np.int64)] * 3
        if all(t.num_rows for t in sides):
            x, y = ((unit(_matrix(t.column("_vec"))), t.column("_node").to_numpy(), t.column("_copies").to_numpy()) for t in (sides[0], sides[-1]))
            out = tile(x[0], y[0], x[1], y[1], x[2], y[2], a == b, least)
        return pa.table([pa.array(c, pa.int64()) for c in out], names=["_node", "_links", "_near"])

    return lanes.groupBy("_cell", "_a", "_b").applyInArrow(run, "_node bigint, _links bigint, _near bigint")


def near_duplicates(embeddings: DataFrame, least: float = LEAST, side: int = SIDE) -> DataFrame:
    """Per vector (vec_id, embedding; other columns are left out): vec_id, n_links, component_id, kept.

    Two vectors link when their cosine in double precision is least or more. Null vectors, those of no numbers or zeros alone, and
    those that hold null, NaN or infinite numbers link with nothing, nor do vectors of different sizes. Rows of equal vectors
    are linked like others, also under one vec_id. A null vec_id counts as a vector but names no component; its row is kept where
    its component has no name. An empty table gives none.
    """
    v = F.col("_vec")
    sound = F.size(v).isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("_vec"))
    rows = materialise(rows.withColumn("_vec", F.when(sound, v)))
    classes = materialise(
        rows.filter("_vec is not null").groupBy("_vec").agg(F.min("vec_id").alias("_least"), F.count("*").alias("_copies")).withColumn("_node", F.monotonically_increasing_id())
    )
    sizes = classes.groupBy(F.size("_vec").alias("_size")).agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), "_size").first()
    if sizes is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    sample = classes.filter(F.size("_vec") == sizes["_size"]).orderBy(F.xxhash64("_vec")).limit(SAMPLE).select("_vec").toArrow()
    found = fitted(unit(_matrix(sample.column(0))), sizes["_n"], least)
    placed = materialise(_placed(classes, found, least))
    near = materialise(_tiles(placed, min(side, max(1024, NUMBERS // sizes["_size"])), least))
    comps = components(near.select(F.col("_node").alias("_x"), F.col("_near").alias("_y")))
    counts = near.groupBy("_node").agg(F.sum("_links").alias("_links"))
    told = classes.join(counts, "_node", "left").join(comps, "_node", "left").filter("_copies > 1 or _links > 0")
    told = materialise(told.select("_vec", "_least", (F.coalesce("_links", F.lit(0)) + F.col("_copies") - 1).alias("_n"), F.coalesce("_comp", "_node").alias("_comp")))
    names = told.groupBy("_comp").agg(F.min("_least").alias("_name"))
    named = small_enough(materialise(told.join(names, "_comp").select("_vec", "_n", "_name")))
    drop(classes, placed, near, comps)
    out = rows.join(named, "_vec", "left")
    name = F.when(F.col("_n").isNull(), F.col("vec_id")).otherwise(F.col("_name"))
    return out.select("vec_id", F.coalesce("_n", F.lit(0)).cast("long").alias("n_links"), name.alias("component_id"), F.col("vec_id").eqNullSafe(name).alias("kept"))
