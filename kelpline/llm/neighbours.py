"""Most similar vectors by randomly rotated one-bit codes.

A unit vector o is rotated into ``bits`` dimensions and stored as the signs of its coordinates, packed,
with one scalar f = <rotated o, sign vector> / sqrt(bits).  For a query q, <rotated q, sign vector> /
(sqrt(bits) * f) estimates <o, q>.  Over random rotations the error has the deviation
sqrt((1 - f^2) / f^2 / (bits - 1)) * sqrt(1 - <o, q>^2), so a pair of at least the wanted similarity s is estimated below
s - z * sqrt((1 - f^2) / f^2 / (bits - 1)) * sqrt(1 - s^2) with the probability of a normal value beyond z.  Only
vectors above that, where s is the floor or the k-th best so far, are reranked with the vectors themselves.

Three plans share these codes:

* :func:`nearest_to_queries`: a set of queries, in blocks, against one scan of all codes.
* :func:`similar_pairs`: every vector against every other one above a similarity floor.  Vectors are
  put into cells around leaders of a bounded sample; vectors far from every leader stay open and are put
  into cells of a next level.  By the radius of each cell and its rows' leaning towards other leaders, both
  measured over all its rows, a vector must look into few cells.
  Cells are cut into blocks of bounded size and compared block by block, so a cell that holds a third
  of all rows is many tasks.
* :func:`nearest_in_cells`: the k best of every vector, each of which looks into the few cells nearest to it.

Equal vectors are collapsed to one representative first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kelpline.llm.common import check_columns, latest_per_id
from kelpline.runtime import materialize, release

#: Deviations of the error bound where all pairs above a floor are wanted: one in three millions at the floor itself is missed.
Z_FLOOR = 5.0
#: The same where the k best are wanted.
Z_BEST = 3.0
#: Largest number of vectors on one side of a comparison task.
BLOCK = 1024
#: Angles of single precision are off by less.
ROUNDING = 1e-3
#: Cell number of the vectors that are far from every leader.
OPEN = -1


@lru_cache(maxsize=8)
def rotation(dim: int, seed: int = 11) -> np.ndarray:
    """dim x bits with orthonormal rows; at least 512 bits, so short vectors have tight bounds too.

    It follows from its arguments, so tasks make it themselves.
    """
    bits = max(512, -(-dim // 64) * 64)
    gauss = np.random.default_rng([seed, dim]).standard_normal((bits, dim))
    return np.ascontiguousarray(np.linalg.qr(gauss)[0].T, dtype=np.float32)


def _dim(grp: str) -> int:
    return int(grp.rsplit("/", 1)[1])


def encode(unit: np.ndarray, rot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign bits and correction scalars of unit vectors."""
    turned = unit.astype(np.float32) @ rot
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(1) / np.sqrt(rot.shape[1])


def estimate(query: np.ndarray, codes: np.ndarray, f: np.ndarray, rot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products (queries x vectors) and the error's deviation for every vector at similarity 0."""
    bits = rot.shape[1]
    signs = np.unpackbits(codes, axis=1, count=bits).astype(np.float32) * 2 - 1
    about = (query.astype(np.float32) @ rot) @ signs.T / (np.sqrt(bits) * f)[None, :].astype(np.float32)
    return about, np.sqrt(np.maximum(0, 1 - f**2) / f**2 / (bits - 1))


def _unit(vectors: pd.Series, dim: int = 0, kind: type = np.float64) -> np.ndarray:
    """Unit vectors; ``dim`` is needed where they are packed."""
    got = vectors.to_list()
    m = (_unpacked(got, dim) if got and isinstance(got[0], (bytes, bytearray)) else np.stack(got)).astype(kind)
    m /= np.abs(m).max(1, keepdims=True)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _unpack(codes: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(codes.to_list()), dtype=np.uint8).reshape(len(codes), -1)


def _unpacked(vectors: list, dim: int) -> np.ndarray:
    kind = np.float32 if len(vectors[0]) == 4 * dim else np.float64
    return np.frombuffer(b"".join(vectors), dtype=kind).reshape(-1, dim)


def packed(rows: DataFrame) -> DataFrame:
    """``rows`` with vec, an array of floats or doubles without nulls, as its bytes: such a vector is moved as one value, not entry by entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("vec")
            vec = batch.column(at)
            flat = np.ascontiguousarray(vec.flatten().to_numpy(zero_copy_only=False))
            ends = np.append(0, np.cumsum(vec.value_lengths().to_numpy(zero_copy_only=False))) * flat.itemsize
            whole = pa.Array.from_buffers(pa.binary(), len(vec), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(flat)])
            yield pa.RecordBatch.from_arrays([whole if c == at else batch.column(c) for c in range(batch.num_columns)], names=batch.schema.names)

    fields = ", ".join(f"{f.name} {'binary' if f.name == 'vec' else f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, fields)


# -- preparation ------------------------------------------------------------------------------------


def usable_vectors(df: DataFrame, id_col: str, vec_col: str, group_col: str | None, order: list[str] | None = None) -> DataFrame:
    """(grp, id, vec) without null, empty, all-zero vectors and those with null, NaN or infinite entries.

    grp joins the group with the number of dimensions: vectors of different length are never compared.
    """
    check_columns(df, id_col, vec_col, *([group_col] if group_col else []))
    group = F.col(group_col).cast("string") if group_col else F.lit("")
    rows = df.select(
        F.concat(F.coalesce(group, F.lit("")), F.lit("/"), F.size(vec_col)).alias("grp"),
        F.col(id_col).alias("id"),
        F.col(vec_col).cast("array<float>").alias("vec"),
        *[F.col(c).alias(f"_o{k}") for k, c in enumerate(order or [])],
    )
    # no lambda runs over the entries: NaN is the greatest value, and a search that meets a null finds nothing, not false
    least, most = F.array_min("vec"), F.array_max("vec")
    inf, nan = float("inf"), F.lit(float("nan")).cast("float")
    fine = ~F.isnan(most) & (most < inf) & (least > -inf) & ((most != 0) | (least != 0)) & F.array_contains("vec", nan).isNotNull()
    rows = rows.where(F.col("id").isNotNull() & (F.size("vec") > 0) & fine)
    ids = df.select(F.col(id_col).alias("id"))
    return latest_per_id(rows, "id", ["grp", "vec"], [f"_o{k}" for k in range(len(order or []))], ids).select("grp", "id", "vec")


@dataclass
class Collapsed:
    """``rows``: (grp, id, vec) of all vectors; ``reps``: (grp, id, vec, copies), one row per different vector;
    ``members``: (id, rep) of all vectors that have copies."""

    rows: DataFrame
    reps: DataFrame
    members: DataFrame


#: Up to so many copies are left out by a join at every reading of the vectors; if there are more, the rest is written.
FEW_COPIES = 100_000


def collapse(rows: DataFrame) -> Collapsed:
    """Equal vectors, told by 128 bits of hash, as one representative, the smallest id."""
    hashed = rows.select("grp", "id", "vec", F.xxhash64("vec", F.lit(1)).alias("h1"), F.xxhash64("vec", F.lit(2)).alias("h2"))
    hashed = materialize(hashed, "vectors")
    key = ["grp", "h1", "h2"]
    classes = hashed.groupBy(*key).agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    members = materialize(hashed.select("id", *key).join(classes, key).select("id", "rep", "copies"), "members")
    rows = hashed.select("grp", "id", "vec")
    reps = rows.join(members, "id", "left").where("rep IS NULL OR rep = id")
    reps = reps.select("grp", "id", "vec", F.coalesce("copies", F.lit(1)).cast("long").alias("copies"))
    if members.count() > FEW_COPIES:
        reps = materialize(reps, "representatives")
    return Collapsed(rows, reps, members.select("id", "rep"))


def fit_cells(sample: np.ndarray, cover: float) -> np.ndarray:
    """Leaders that cover the sample: a vector with no leader of similarity ``cover`` becomes one.

    Each leader then moves to the mean of the vectors that are nearest to it.
    """
    leaders = np.empty_like(sample)
    n = 0
    for lo in range(0, len(sample), 256):
        batch = sample[lo : lo + 256]
        old = n
        for v in batch[(batch @ leaders[:n].T).max(1, initial=-1) < cover]:
            if n == old or (leaders[old:n] @ v).max() < cover:
                leaders[n] = v
                n += 1
    leaders = leaders[:n].copy()
    sums = np.zeros_like(leaders)
    for lo in range(0, len(sample) if n else 0, 1024):
        sims = sample[lo : lo + 1024] @ leaders.T
        near = sims.max(1) >= cover
        np.add.at(sums, sims.argmax(1)[near], sample[lo : lo + 1024][near])
    return sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)


def _sample(rows: DataFrame, grp: str, n: int, size: int, level: int) -> np.ndarray:
    """At most ``size`` unit vectors of a group, chosen by a hash of the id."""
    part = rows.where(F.col("grp") == grp)
    if n > size:
        part = part.where(F.pmod(F.xxhash64("id", F.lit(5 + level)), F.lit(1_000_000)) < int(1.05e6 * size / n) + 1)
    got = part.select("vec").limit(size).toArrow()
    vec = got.column("vec")
    if pa.types.is_list(vec.type):
        flat = np.concatenate([np.zeros(0, np.float32), *[c.flatten().to_numpy() for c in vec.chunks]])
    else:
        flat = _unpacked(vec.to_pylist(), _dim(grp)).ravel() if len(vec) else np.zeros(0, np.float32)
    unit = flat.astype(np.float32, copy=False).reshape(-1, _dim(grp))
    if len(unit):
        unit = unit / np.abs(unit).max(1, keepdims=True)
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    return unit


# -- every vector against every vector above a floor -------------------------------------------------


def _cosines(unit: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.clip(unit.astype(np.float32) @ centres.T, -1, 1)


def _shapes(leaders, tight: float):
    """(grp, cell, radius, lean) of what a task's rows do to their cells.

    radius is the largest angle between a cell's leader c and its own rows y; lean holds, for every other leader
    h, the largest part of a row along h beside c, that is (y.h - (h.c)(y.c)) / |h - (h.c)c|, as a byte from -1 to 1
    that is rounded up.
    """
    reach = np.arccos(np.clip(tight, -1, 1))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        radius: dict[str, np.ndarray] = {}
        lean: dict[str, dict[int, np.ndarray]] = {}
        for batch in batches:
            for grp, whole in batch.groupby("grp", sort=False):
                centres = leaders.value.get(grp, ())
                if not len(centres):
                    continue
                far, rows_of = radius.setdefault(grp, np.full(len(centres), -np.inf)), lean.setdefault(grp, {})
                for lo in range(0, len(whole), 1024):
                    cosine = _cosines(_unit(whole["vec"].iloc[lo : lo + 1024], _dim(grp)), centres)
                    own = cosine.argmax(1)
                    angle = np.arccos(cosine[np.arange(len(own)), own]).astype(float)
                    near = np.flatnonzero(angle <= reach + ROUNDING)
                    near = near[np.argsort(own[near], kind="stable")]
                    if not len(near):
                        continue
                    cell, at = np.unique(own[near], return_index=True)
                    np.maximum.at(far, own[near], angle[near])
                    across = centres[cell] @ centres.T
                    beside = np.sqrt(np.maximum(1 - across**2, 1e-6))
                    code = np.repeat(np.arange(len(cell)), np.diff(np.append(at, len(near))))
                    part = (cosine[near] - across[code] * cosine[near, own[near]][:, None]) / beside[code]
                    for c, top in zip(cell.tolist(), np.maximum.reduceat(part, at, axis=0)):
                        rows_of[c] = np.maximum(rows_of[c], top) if c in rows_of else top
        for grp, rows_of in lean.items():
            cells = sorted(rows_of)
            for lo in range(0, len(cells), 256):
                some = cells[lo : lo + 256]
                packed = [np.ceil((np.clip(rows_of[c], -1, 1) + 1) * 127).astype(np.uint8).tobytes() for c in some]
                yield pd.DataFrame({"grp": grp, "cell": np.array(some, np.int32), "radius": radius[grp][some], "lean": packed})

    return run


def _joined_shapes(rows: pd.DataFrame) -> pd.DataFrame:
    """One row a cell of those of a bucket of cells."""
    out = []
    for grp, part in rows.groupby("grp", sort=False):
        part = part.sort_values("cell")
        cell, at = np.unique(part["cell"].to_numpy(), return_index=True)
        lean = np.maximum.reduceat(_unpack(part["lean"]), at, axis=0)
        radius = np.maximum.reduceat(part["radius"].to_numpy(), at)
        out.append(pd.DataFrame({"grp": grp, "cell": cell, "radius": radius, "lean": [x.tobytes() for x in lean]}))
    return pd.concat(out)


def reachable(x_c: np.ndarray, x_h: np.ndarray, h_c: np.ndarray, radius: np.ndarray, lean: np.ndarray) -> np.ndarray:
    """Upper bound of x.y over unit y within ``radius`` of c whose part along h beside c is at most ``lean``.

    Only x.c, x.h and h.c are known of x.  In the plane of c and h and the rest, x is a point of a sphere and so is y;
    the bound is the largest product over that region: at x itself, on either of its borders, or where these meet.
    """
    beside = np.sqrt(np.maximum(1 - h_c**2, 1e-6))
    along = (x_h - h_c * x_c) / beside
    rest = np.sqrt(np.maximum(0, 1 - x_c**2 - along**2))
    q, wide = np.cos(radius), np.sin(radius)
    thin, off_c, off_h = np.sqrt(np.maximum(0, 1 - lean**2)), np.sqrt(np.maximum(1e-12, 1 - x_c**2)), np.sqrt(np.maximum(1e-12, 1 - along**2))
    bound = np.where((x_c >= q) & (along <= lean), 1.0, -1.0)
    bound = np.where(along * wide <= lean * off_c, np.maximum(bound, x_c * q + off_c * wide), bound)
    bound = np.where(x_c * thin >= q * off_h, np.maximum(bound, along * lean + off_h * thin), bound)
    left = 1 - q**2 - lean**2
    return np.where(left >= 0, np.maximum(bound, x_c * q + along * lean + rest * np.sqrt(np.maximum(0, left))), bound)


def _assign(leaders, shapes, last: frozenset, tight: float, slack: float):
    """Rows of one level to its cells.  ``leaders`` and ``shapes`` are broadcasts of arrays by group."""
    reach = np.arccos(np.clip(tight, -1, 1))

    def place(unit: np.ndarray, centres: np.ndarray, radius: np.ndarray, lean: np.ndarray):
        """(row, cell, home) of a block of rows."""
        n = len(unit)
        if not len(centres):
            return np.arange(n), np.full(n, OPEN), np.ones(n, dtype=bool)
        cosine = _cosines(unit, centres)
        nearest = cosine.argmax(1)
        angle = np.arccos(cosine)
        near = angle[np.arange(n), nearest]
        is_open = near > reach
        # a partner in another cell is within its radius of its leader, and no farther from it than from this one's; of
        # two cells, the rows of the one with the larger number look into the other, and open rows look into all
        bound = np.where(is_open, np.inf, near + slack)
        look = angle <= np.minimum(bound[:, None], radius[None, :]) + (slack + ROUNDING)
        look &= np.arange(len(centres))[None, :] < np.where(is_open, len(centres), nearest)[:, None]
        row, cell = np.nonzero(look)
        # the nearest leader tells more about a row than its angle to the cell's leader does
        pivots, pivot = np.unique(nearest, return_inverse=True)
        across = centres[pivots] @ centres.T
        keep = np.ones(len(row), dtype=bool)
        for lo in range(0, len(row), 200_000):
            r, c = row[lo : lo + 200_000], cell[lo : lo + 200_000]
            top = np.minimum(lean[c, nearest[r]].astype(np.float32) / 127 - 1 + ROUNDING, 1)
            most = reachable(cosine[r, c], cosine[r, nearest[r]], across[pivot[r], c], radius[c] + ROUNDING, top)
            keep[lo : lo + 200_000] = (most >= np.cos(slack) - ROUNDING) | (c == nearest[r])
        rows = np.concatenate([np.arange(n), row[keep]])
        return rows, np.concatenate([np.where(is_open, OPEN, nearest), cell[keep]]), np.arange(len(rows)) < n

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for grp, whole in batch.groupby("grp", sort=False):
                centres = leaders.value.get(grp, np.zeros((0, _dim(grp)), dtype=np.float32))
                for lo in range(0, len(whole), 1024):
                    rows = whole.iloc[lo : lo + 1024]
                    row, cell, home = place(_unit(rows["vec"], _dim(grp)), centres, *shapes.value.get(grp, (None, None)))
                    for k in range(0, len(row), 4096):
                        s = slice(k, k + 4096)
                        onward = (cell[s] == OPEN) & (grp not in last)
                        yield rows.iloc[row[s]].assign(cell=cell[s].astype(np.int32), home=home[s], next=onward)

    return run


def in_cells(
    rows: DataFrame, floor: float, slack: float | None = None, tight: float = 0.6, sample_rows: int = 4_096, levels: int = 12
) -> tuple[DataFrame, list[DataFrame]]:
    """``rows`` (grp, id, vec, len, n) with level, cell and home, and the tables behind them, for release.

    Every vector is at home in one cell and looks into the other cells that may hold a partner of at least ``floor``: by the
    cell's radius, and by how far its rows lean towards the leader of the vector's own cell (see :func:`reachable`).
    The leaders of a level are fitted on at most ``sample_rows`` vectors of a group; every vector is placed.
    Vectors that are far from all leaders stay open: they look into this level's cells, and get leaders of their own on the
    next level, until at most ``sample_rows`` are open or a level takes in less than a tenth; these are one last cell.
    ``slack`` is the angle, in radians, by which a partner may differ; by default the angle of
    ``floor``, at which no pair is missed by the cells.
    """
    slack = float(np.arccos(np.clip(floor, -1, 1))) if slack is None else slack
    spark, id_type, vec_type = rows.sparkSession, *(rows.schema[c].dataType.simpleString() for c in ("id", "vec"))
    carried = f"grp string, id {id_type}, vec {vec_type}, len double, n long"
    todo, parts, tables, before = rows.select("grp", "id", "vec", "len", "n"), [], [], {}
    for level in range(levels):
        sizes = {r["grp"]: r["n"] for r in todo.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a group
        if not sizes:
            break
        stuck = {g for g, n in sizes.items() if g in before and (n <= sample_rows or n > 0.9 * before[g])}
        last = frozenset(sizes if level == levels - 1 else stuck)
        leaders = {g: fit_cells(_sample(todo, g, n, sample_rows, level), tight) for g, n in sizes.items() if g not in last}
        sent = spark.sparkContext.broadcast(leaders)
        schema = "grp string, cell int, radius double, lean binary"
        told = todo.select("grp", "vec").mapInPandas(_shapes(sent, tight), schema)
        shapes = {g: (np.full(len(c), -np.inf, np.float32), np.zeros((len(c), len(c)), np.uint8)) for g, c in leaders.items()}
        # at most one row a leader, with a byte a leader; a cell without rows is not looked into
        for r in told.groupBy("grp", F.pmod("cell", F.lit(64)).alias("_bucket")).applyInPandas(_joined_shapes, schema).toLocalIterator():
            radius, lean = shapes[r["grp"]]
            radius[r["cell"]], lean[r["cell"]] = r["radius"], np.frombuffer(r["lean"], np.uint8)
        del leaders
        sent_shapes = spark.sparkContext.broadcast(shapes)
        del shapes
        placed = materialize(todo.mapInPandas(_assign(sent, sent_shapes, last, tight, slack), f"{carried}, cell int, home boolean, next boolean"), "cells")
        tables.append(placed)
        sent.destroy()  # the cells are written
        sent_shapes.destroy()
        parts.append(placed.where("not next").select(F.lit(level).alias("level"), "grp", "cell", "id", "vec", "len", "n", "home"))
        todo = placed.where("next").select("grp", "id", "vec", "len", "n")
        before = sizes
        if last == frozenset(sizes):
            break
    placed = spark.createDataFrame([], f"level int, grp string, cell int, id {id_type}, vec {vec_type}, len double, n long, home boolean")
    for k, p in enumerate(parts):
        placed = placed.unionByName(p) if k else p
    return placed, tables


def cell_sizes(placed: DataFrame) -> DataFrame:
    """(grp, level, cell, homes, probes) of the cells with rows at home."""
    counts = placed.groupBy("grp", "level", "cell").agg(F.count_if("home").alias("homes"), F.count_if(~F.col("home")).alias("probes"))
    return counts.where(F.col("homes") > 0)


def in_tasks(placed: DataFrame, sizes: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rows of every comparison: (grp, level, cell, probe, i, j) names it, ``side`` is 0 or 1 within it.

    Cells are cut into blocks of about ``block`` rows.  Blocks at home meet each other once (probe false, i <= j); blocks that
    look in meet every block at home (probe true).
    """
    counts = sizes.where(F.col("homes") + F.col("probes") > 1).select(
        "grp", "level", "cell", F.ceil(F.col("homes") / block).cast("int").alias("homes"), F.ceil(F.col("probes") / block).cast("int").alias("probes")
    )
    # as many rows as there are cells: at most ``sample_rows`` per group and level
    rows = placed.join(F.broadcast(counts), ["grp", "level", "cell"])
    b = F.pmod(F.xxhash64("id", F.lit(3)), F.when(F.col("home"), F.col("homes")).otherwise(F.col("probes"))).cast("int")
    rows = rows.withColumn("blk", b)

    def task(probe, i, j, side):
        return F.struct(
            F.lit(probe).alias("probe"), i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("int").alias("side")
        )

    own = F.col("blk")
    with_homes = F.transform(
        F.sequence(F.lit(0), F.col("homes") - 1),
        lambda o: task(False, F.least(own, o), F.greatest(own, o), (own > o).cast("int")),
    )
    with_probes = F.when(
        F.col("probes") > 0, F.transform(F.sequence(F.lit(0), F.col("probes") - 1), lambda p: task(True, p, own, F.lit(1)))
    ).otherwise(F.slice(with_homes, 1, 0))
    as_probe = F.transform(F.sequence(F.lit(0), F.col("homes") - 1), lambda o: task(True, own, o, F.lit(0)))
    tasks = F.when(F.col("home"), F.concat(with_homes, with_probes)).otherwise(as_probe)
    return rows.select("grp", "level", "cell", "id", "vec", "len", F.explode(tasks).alias("t")).select(
        "grp", "level", "cell", "t.probe", "t.i", "t.j", "t.side", "id", "vec", "len"
    )


def _best_pairs(a: np.ndarray, b: np.ndarray, rot: np.ndarray, floor: float, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers in a and b and exact similarity of all pairs of at least ``floor``: codes choose, vectors decide."""
    about, error = estimate(a, *encode(b, rot), rot)
    maybe = about + Z_FLOOR * np.sqrt(1 - min(1.0, floor * floor)) * error[None, :] >= floor
    if same:
        maybe |= maybe.T  # either of a pair may have the tighter bound; keep what any of them admits
        maybe &= np.tri(len(a), dtype=bool, k=-1).T
    i, j = np.nonzero(maybe)
    sims = np.empty(len(i))
    for lo in range(0, len(i), 20_000):
        s = slice(lo, lo + 20_000)
        sims[s] = np.einsum("ij,ij->i", a[i[s]], b[j[s]])
    keep = sims >= floor
    return i[keep], j[keep], sims[keep]


def _compare(floor: float, k: int, seed: int):
    """Of every row of a comparison its ``k`` best partners of at least ``floor``."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        grp, _, _, probe, i, j = key
        ids, side = rows["id"].to_numpy(), rows["side"].to_numpy()
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        same = not probe and i == j
        if same:
            right = left
        if not len(left) or not len(right):
            return pd.DataFrame({"a": ids[:0], "b": ids[:0], "sim": np.zeros(0)})
        unit = _unit(rows["vec"])
        x, y, sims = _best_pairs(unit[left], unit[right], rotation(_dim(grp), seed), floor, same)
        out = pd.DataFrame(
            {"a": np.concatenate([ids[left[x]], ids[right[y]]]), "b": np.concatenate([ids[right[y]], ids[left[x]]]), "sim": np.concatenate([sims, sims])}
        )
        if not len(out):
            return out
        out = out.sort_values(["a", "sim", "b"], ascending=[True, False, True])
        return out[out.groupby("a").cumcount() < k]

    return run


def similar_pairs(
    reps: DataFrame,
    floor: float,
    k: int,
    slack: float | None = None,
    tight: float = 0.6,
    sample_rows: int = 4_096,
    levels: int = 12,
    block: int = BLOCK,
    seed: int = 11,
) -> DataFrame:
    """(a, b, sim) for every vector a: its ``k`` most similar vectors b with a similarity of at least ``floor``.

    ``reps`` has grp, id, vec (usable, different vectors).  Comparisons are those of :func:`in_cells` and :func:`in_tasks`; a
    task keeps k partners of each of its rows, so no cell emits all its pairs.  A smaller ``slack`` than the angle of the
    floor looks into fewer cells.  Ties are ordered by b.
    """
    id_type = reps.schema["id"].dataType.simpleString()
    rows = reps.select("grp", "id", "vec", F.lit(1.0).alias("len"), F.lit(1).cast("long").alias("n"))
    placed, tables = in_cells(rows, floor, slack, tight, sample_rows, levels)
    spread = in_tasks(placed, cell_sizes(placed), block)
    found = spread.groupBy("grp", "level", "cell", "probe", "i", "j").applyInPandas(
        _compare(floor, k, seed), f"a {id_type}, b {id_type}, sim double"
    )
    found = materialize(best_partners(found, k), "pairs")
    for t in tables:
        release(t)
    return found


# -- the k best of every vector, approximately --------------------------------------------------------


def centres_of(sample: np.ndarray, n: int, rounds: int = 6) -> np.ndarray:
    """At most ``n`` centres of a sample: directions that move to the mean of what is nearest to them, from evenly chosen rows."""
    centres = sample[np.linspace(0, len(sample) - 1, min(n, len(sample))).astype(int)].copy()
    for _ in range(rounds):
        near = np.concatenate([(sample[lo : lo + 2048] @ centres.T).argmax(1) for lo in range(0, len(sample), 2048)])
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 0, sums / np.maximum(length, 1e-12), centres)
    return centres


def _to_nearest(centres, probes: int):
    """Every row in its nearest cell, at home, and in the next ones, to look."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for grp, whole in batch.groupby("grp", sort=False):
                c = centres.value[grp]
                top = min(probes, len(c))
                for lo in range(0, len(whole), 1024):
                    rows = whole.iloc[lo : lo + 1024]
                    near = -_cosines(_unit(rows["vec"]), c)
                    cell = np.argpartition(near, top - 1, axis=1)[:, :top]
                    cell = np.take_along_axis(cell, np.argsort(np.take_along_axis(near, cell, axis=1), axis=1, kind="stable"), axis=1)
                    for p in range(top):
                        yield rows.assign(level=np.int32(0), cell=cell[:, p].astype(np.int32), home=p == 0)

    return run


def _best_of_codes(q: np.ndarray, v: np.ndarray, rot: np.ndarray, k: int, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of v, similarity) of the ``k`` best v of every q: codes choose what is compared exactly."""
    about, error = estimate(q, *encode(v, rot), rot)
    if same:
        np.fill_diagonal(about, -9)
    k = min(k, len(v) - same)
    if k <= 0:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    first = np.argpartition(-about, k - 1, axis=1)[:, :k]
    exact = np.einsum("id,ikd->ik", q, v[first])
    least = exact.min(1, keepdims=True)
    maybe = about + Z_BEST * np.sqrt(1 - np.clip(least, 0, 1) ** 2) * error[None, :] >= least
    np.put_along_axis(maybe, first, False, axis=1)
    if same:
        np.fill_diagonal(maybe, False)
    i, j = np.nonzero(maybe)
    sims = np.concatenate([np.einsum("ij,ij->i", q[i[lo : lo + 20_000]], v[j[lo : lo + 20_000]]) for lo in range(0, len(i), 20_000)] or [np.zeros(0)])
    x, y, s = np.concatenate([np.repeat(np.arange(len(q)), k), i]), np.concatenate([first.ravel(), j]), np.concatenate([exact.ravel(), sims])
    order = np.lexsort((y, -s, x))
    x, y, s = x[order], y[order], s[order]
    begins = np.flatnonzero(np.append(True, np.diff(x) != 0))
    keep = np.arange(len(x)) - np.repeat(begins, np.diff(np.append(begins, len(x)))) < k
    return x[keep], y[keep], s[keep]


def _compare_best(k: int, seed: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        grp, _, _, probe, i, j = key
        ids, side = rows["id"].to_numpy(), rows["side"].to_numpy()
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        same = not probe and i == j
        sides = [(left, left)] if same else [(left, right)] if probe else [(left, right), (right, left)]
        unit, out = _unit(rows["vec"]), [pd.DataFrame({"a": ids[:0], "b": ids[:0], "sim": np.zeros(0)})]
        for a, b in sides:
            if len(a) and len(b):
                x, y, sim = _best_of_codes(unit[a], unit[b], rotation(_dim(grp), seed), k, same)
                out.append(pd.DataFrame({"a": ids[a[x]], "b": ids[b[y]], "sim": sim}))
        return pd.concat(out)

    return run


def nearest_in_cells(
    reps: DataFrame, k: int, probes: int = 8, cell_rows: int = 200, most_cells: int = 4_096, sample_rows: int = 16_384, block: int = BLOCK, seed: int = 11
) -> DataFrame:
    """(a, b, sim): for every vector a its ``k`` most similar vectors b of the ``probes`` cells whose centres are nearest to a.

    Centres are fitted on at most ``sample_rows`` vectors of a group, one for about ``cell_rows`` vectors, at most ``most_cells``;
    every vector is placed, at home in one cell.  What is lost are partners in cells that a does not look into; more
    ``probes`` lose less.  Cells of any size are compared block by block, and a task keeps k partners a row.
    """
    spark, id_type = reps.sparkSession, reps.schema["id"].dataType.simpleString()
    rows = reps.select("grp", "id", "vec", F.lit(1.0).alias("len"), F.lit(1).cast("long").alias("n"))
    sizes = {r["grp"]: r["n"] for r in rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a group
    sent = spark.sparkContext.broadcast(
        {g: centres_of(_sample(rows, g, n, sample_rows, 0), min(most_cells, -(-n // cell_rows))) for g, n in sizes.items()}
    )
    schema = f"grp string, id {id_type}, vec array<float>, len double, n long, level int, cell int, home boolean"
    placed = materialize(rows.mapInPandas(_to_nearest(sent, probes), schema), "cells")
    sent.destroy()
    spread = in_tasks(placed, cell_sizes(placed), block)
    found = spread.groupBy("grp", "level", "cell", "probe", "i", "j").applyInPandas(_compare_best(k, seed), f"a {id_type}, b {id_type}, sim double")
    found = materialize(best_partners(found, k), "pairs")
    release(placed)
    return found


def best_partners(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best (b, sim) of every a; similarities are equal to nine digits, ties are ordered by b."""
    place = F.row_number().over(W.partitionBy("a").orderBy(F.desc(F.round("sim", 9)), "b"))
    return found.withColumn("_place", place).where(F.col("_place") <= k).drop("_place")


# -- queries against all rows ------------------------------------------------------------------------


def _coded(seed: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for grp, rows in batch.groupby("grp", sort=False):
                codes, f = encode(_unit(rows["vec"]), rotation(_dim(grp), seed))
                yield pd.DataFrame({"grp": grp, "id": rows["id"], "vec": rows["vec"], "code": [c.tobytes() for c in codes], "f": f})

    return run


def _scan(queries, k: int, seed: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for grp, rows in batch.groupby("grp", sort=False):
                if grp not in queries.value:
                    continue
                q_ids, q = queries.value[grp]
                rot = rotation(_dim(grp), seed)
                for lo in range(0, len(rows), BLOCK):
                    part = rows.iloc[lo : lo + BLOCK]
                    ids, unit = part["id"].to_numpy(), _unit(part["vec"])
                    about, error = estimate(q, _unpack(part["code"]), part["f"].to_numpy(), rot)
                    about[q_ids[:, None] == ids[None, :]] = -9
                    n = len(q)
                    if grp not in best:
                        best[grp] = (np.full((n, k), -2.0), np.zeros((n, k), dtype=ids.dtype), np.zeros(n))
                    sims, who, _ = best[grp]
                    # rerank the most promising first, then whatever may still beat the k-th best
                    order = np.argpartition(-about, min(k, about.shape[1] - 1), axis=1)[:, :k]
                    promising = np.zeros(about.shape, dtype=bool)
                    np.put_along_axis(promising, order, True, axis=1)
                    for chosen in (promising, ~promising):
                        least = sims[:, -1:]
                        spread = Z_BEST * np.sqrt(1 - np.clip(least, 0, 1) ** 2)
                        i, j = np.nonzero(chosen & (about + spread * error[None, :] >= least) & (about > -9))
                        exact = np.einsum("ij,ij->i", q[i], unit[j]) if len(i) else np.zeros(0)
                        for x in np.unique(i):
                            m = i == x
                            s, w = np.concatenate([sims[x], exact[m]]), np.concatenate([who[x], ids[j[m]]])
                            top = np.lexsort((w, -s))[:k]
                            sims[x], who[x] = s[top], w[top]
        for grp, (sims, who, _) in best.items():
            q_ids = queries.value[grp][0]
            x, y = np.nonzero(sims > -2)
            yield pd.DataFrame({"a": q_ids[x], "b": who[x, y], "sim": sims[x, y]})

    return run


def nearest_to_queries(reps: DataFrame, queries: DataFrame, k: int, query_block: int = 2048, seed: int = 11) -> DataFrame:
    """(a, b, sim): the ``k`` most similar vectors b of every query a, among all rows of ``reps``.

    ``queries`` has grp, id, vec.  Queries go in blocks of ``query_block`` through one scan of the codes
    each; the scan keeps k rows per query and partition.  A query is not its own neighbour.
    """
    spark, id_type = reps.sparkSession, reps.schema["id"].dataType.simpleString()
    empty = spark.createDataFrame([], f"a {id_type}, b {id_type}, sim double")
    coded = materialize(reps.mapInPandas(_coded(seed), f"grp string, id {id_type}, vec array<float>, code binary, f double"), "codes")
    parts: list[DataFrame] = []

    def search(block: list) -> None:
        frame = pd.DataFrame(block, columns=["grp", "id", "vec"])
        by = {g: (r["id"].to_numpy(), _unit(r["vec"])) for g, r in frame.groupby("grp")}
        parts.append(coded.mapInPandas(_scan(spark.sparkContext.broadcast(by), k, seed), f"a {id_type}, b {id_type}, sim double"))

    block: list = []
    for row in queries.select("grp", "id", "vec").toLocalIterator():
        block.append(tuple(row))
        if len(block) >= query_block:
            search(block)
            block = []
    if block:
        search(block)
    found = empty
    for p in parts:
        found = found.unionByName(p)
    return best_partners(found, k)


# -- the operator ------------------------------------------------------------------------------------


def most_similar(
    df: DataFrame,
    id_col: str,
    vec_col: str,
    k: int = 10,
    group_col: str | None = None,
    floor: float | None = None,
    queries: Callable[[Column], Column] | None = None,
    order: list[str] | None = None,
    probes: int = 8,
) -> DataFrame:
    """(a, b, sim): for every vector a the ``k`` most similar vectors b of its group, by cosine.

    With ``floor`` all vectors are queries and only partners of at least that similarity come out, by
    comparison within cells, and all of them.  With ``queries``, a condition on the id, the rows that meet it are queries, each
    block of which scans all codes.  With neither, all vectors are queries, each of which looks into the ``probes`` cells
    nearest to it, so a few partners are missed (see :func:`nearest_in_cells`).
    Equal vectors are compared once; their copies come out as partners of similarity 1, the smallest ids
    first, up to k.  Null, empty, all-zero vectors and those with null, NaN or infinite entries are
    neither queries nor partners; repeated ids count once (the greatest by ``order``); an empty table
    gives an empty result.  Other columns are ignored.
    """
    parts = collapse(usable_vectors(df, id_col, vec_col, group_col, order))
    reps, members = parts.reps, parts.members
    if floor is not None:
        found = similar_pairs(reps, floor, k)
    elif queries is None:
        found = nearest_in_cells(reps, k, probes)
    else:
        found = nearest_to_queries(reps, _representatives_of(parts, queries), k)
    own = reps.where("copies > 1").select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("sim"))
    found = found.unionByName(own)
    # k + 1 copies of a class are enough as partners, whatever its size
    first = members.withColumn("_n", F.row_number().over(W.partitionBy("rep").orderBy("id"))).where(F.col("_n") <= k + 1)
    partner = found.join(first.select(F.col("rep").alias("b"), F.col("id").alias("_copy")), "b", "left").select(
        "a", F.coalesce("_copy", "b").alias("b"), "sim"
    )
    best = F.row_number().over(W.partitionBy("a").orderBy(F.desc(F.round("sim", 9)), "b"))
    partner = partner.withColumn("_n", best).where(F.col("_n") <= k + 1).drop("_n")
    asker = partner.join(members.select(F.col("rep").alias("a"), F.col("id").alias("_copy")), "a", "left").select(
        F.coalesce("_copy", "a").alias("a"), "b", "sim"
    )
    asker = asker.where("a <> b")
    if floor is None and queries is not None:
        asker = asker.where(queries(F.col("a")))
    return asker.withColumn("_n", best).where(F.col("_n") <= k).drop("_n")


def _representatives_of(parts: Collapsed, queries: Callable[[Column], Column]) -> DataFrame:
    alone = parts.reps.where("copies = 1").where(queries(F.col("id"))).select("id")
    shared = parts.members.where(queries(F.col("id"))).select(F.col("rep").alias("id"))
    return parts.reps.join(alone.union(shared).distinct(), "id", "left_semi")
