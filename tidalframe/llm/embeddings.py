"""Operator 4: exact near-duplicates of embeddings by a metric range join.

Unit vectors lie at Euclidean distance sqrt(2 - 2 cos), a metric, so a cosine limit is a radius. Every
vector is at home in the cell of its nearest pivot. A vector that lies within the radius of another
cell's bounding plane is also sent to that cell: by the triangle inequality a linked vector at home
there can't lie farther off. Each cell then joins by itself, and all links of a vector are found, once
each, in its home cell. Cells of any size are cut into square blocks of bounded memory. A block counts
links and sends on one edge a vector at most, so groups of copies make no pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import share, shared_value, written
from .components import components

COSINE = 0.9
#: Vectors that a cell should be home to at most, and least and most pivots.
CELL, MIN_PIVOTS, MAX_PIVOTS = 8192, 4, 2048
#: Vectors that pivots are tried on, and the work of sending a vector to a cell in comparisons of two vectors.
TRIED, SENDING = 2000, 250
#: Most vectors on one side of a block.
SIDE = 8192
#: Rows of a block that are compared at once.
STEP = 512

_ROWS = T.StructType([T.StructField("node", T.LongType()), T.StructField("n_links", T.LongType()), T.StructField("label", T.LongType())])


def _unit(raw: np.ndarray) -> np.ndarray:
    return raw / np.sqrt((raw * raw).sum(axis=1, keepdims=True))


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, vector) to (id, key, vector): key is a digest of the unit direction's source, null if it can't link."""
    for batch in batches:
        keys, vectors = [], []
        for v in batch.column("vector"):
            key = raw = None
            if v.is_valid and len(v) and not v.values.null_count:
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
                norm = float(np.sqrt((x * x).sum())) if np.isfinite(x).all() else 0.0
                if norm > 0 and not np.isfinite(norm) or 0 < norm < 1e-150:  # squares leave the range of doubles
                    x = x / np.abs(x).max()
                    norm = 1.0
                if norm > 0:
                    raw = x.tobytes()
                    key = hashlib.blake2b(raw, digest_size=16).digest()
            keys.append(key)
            vectors.append(raw)
        yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "key": pa.array(keys, pa.binary()), "raw": pa.array(vectors, pa.binary())})


def _matrix(raws) -> np.ndarray:
    return np.frombuffer(b"".join(raws), np.float64).reshape(len(raws), -1)


def _cells(unit: np.ndarray, points: np.ndarray, apart: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Each vector's nearest pivot, and whether a vector within ``radius`` may be at home with each pivot."""
    square = np.maximum(0, 2 - 2 * unit @ points.T)
    nearest = square.argmin(axis=1)
    # Distance to the plane half-way between the home pivot and another one.
    plane = (square - square[np.arange(len(unit)), nearest][:, None]) / np.maximum(2 * apart[nearest], 1e-12)
    return nearest, plane <= radius + 1e-9


def _dealt(batches: Iterator[pa.RecordBatch], pivots, radius: float) -> Iterator[pa.RecordBatch]:
    """Each class to its home cell and to all cells that may hold a linked vector at home."""
    for batch in batches:
        raws = batch.column("raw").to_pylist()
        by_size: dict[int, list[int]] = {}
        for i, r in enumerate(raws):
            by_size.setdefault(len(r), []).append(i)
        rows, cells, home = [], [], []
        for size, members in by_size.items():
            at = np.array(members)
            own = pivots.get(size)
            if own is None:  # no pivot of this length: they share one cell
                rows.append(at), cells.append(np.full(len(at), size * 10_000)), home.append(np.ones(len(at), bool))
                continue
            points, apart = own
            nearest, reached = _cells(_unit(_matrix([raws[i] for i in members])), points, apart, radius)
            r, c = np.nonzero(reached)
            rows.append(at[r]), cells.append(size * 10_000 + c), home.append(nearest[r] == c)
        if rows:
            take = np.concatenate(rows)
            yield pa.RecordBatch.from_pydict({"cell": pa.array(np.concatenate(cells), pa.int64()), "home": pa.array(np.concatenate(home)), **{c: batch.column(c).take(pa.array(take)) for c in ("node", "n", "raw")}})


def _block(left: pd.DataFrame, right: pd.DataFrame, cosine: float) -> pd.DataFrame:
    """Links of the home vectors ``left`` among ``right``, and labels that connect what is linked."""
    a, b = _unit(_matrix(left["raw"].tolist())), _unit(_matrix(right["raw"].tolist()))
    a32, b32 = a.astype(np.float32), b.astype(np.float32)
    node_a, node_b, n_b = left["node"].to_numpy(), right["node"].to_numpy(), right["n"].to_numpy()
    nodes, place = np.unique(np.concatenate([node_a, node_b]), return_inverse=True)
    label = np.arange(len(nodes))
    in_a, in_b = place[: len(node_a)], place[len(node_a) :]
    links = np.zeros(len(node_a), np.int64)
    for at in range(0, len(a), STEP):
        i, j = np.nonzero(a32[at : at + STEP] @ b32.T > cosine - 1e-4)
        i += at
        near = node_a[i] != node_b[j]
        i, j = i[near], j[near]
        exact = np.empty(len(i), bool)
        for k in range(0, len(i), 65_536):
            exact[k : k + 65_536] = np.einsum("ij,ij->i", a[i[k : k + 65_536]], b[j[k : k + 65_536]]) >= cosine
        i, j = i[exact], j[exact]
        links += np.bincount(i, weights=n_b[j], minlength=len(a)).astype(np.int64)
        u, v = in_a[i], in_b[j]
        while len(u):  # least labels run through the links found so far until none changes
            u, v = label[u], label[v]
            apart = u != v
            if not apart.any():
                break
            u, v = u[apart], v[apart]
            low, high = np.minimum(u, v), np.maximum(u, v)
            least = np.arange(len(nodes))
            np.minimum.at(least, high, low)
            while True:
                further = least[least]
                if (further == least).all():
                    break
                least = further
            label = least[label]
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return pd.DataFrame(
        {
            "node": np.concatenate([node_a, nodes[moved]]),
            "n_links": np.concatenate([links, np.zeros(len(moved), np.int64)]),
            "label": np.concatenate([node_a, nodes[label[moved]]]),
        }
    )


def _pivots(classes: DataFrame, count: int, radius: float) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Pivots by length of vectors, and the distances between them.

    Up to MAX_PIVOTS are drawn by digest. How many of them are used is tried on TRIED vectors: with more
    pivots, cells are smaller, but a vector goes to more of them; the least work all in all wins.
    """
    least = max(MIN_PIVOTS, min(MAX_PIVOTS, -(-count // CELL)))
    most = max(least, min(MAX_PIVOTS, 4 * int(np.sqrt(count))))
    rows = classes.select("key", "raw").orderBy("key").limit(most + TRIED).collect()
    by_size: dict[int, list[bytes]] = {}
    for r in rows:
        by_size.setdefault(len(r.raw), []).append(bytes(r.raw))
    out = {}
    for size, raws in by_size.items():
        points, tried = _unit(_matrix(raws[:most])), _unit(_matrix(raws[-TRIED:]))
        apart = np.sqrt(np.maximum(0, 2 - 2 * points @ points.T))
        works, n = {}, least
        while n <= min(most, len(points)):
            sent = _cells(tried, points[:n], apart[:n, :n], radius)[1].sum(axis=1).mean()
            works[n] = sent * (SENDING + count / n)
            n *= 2
        best = min(works, key=works.get) if works else len(points)
        out[size] = points[:best], apart[:best, :best]
    return out


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """(id, n_links, component_id, kept) of every row of ``df``.

    n_links counts the other rows whose vectors have a cosine of at least ``cosine`` (over 0), exact
    copies included. Vectors that are null, empty, zero, or hold a null, NaN or infinity link with
    nothing and are their own component; so do vectors of different length. Rows with equal ids are
    rows each, whose vectors link or don't like any others. Rows with null ids link, too, but a null id
    is no one's component_id, and their ``kept`` is null. An empty table gives no rows. Other columns of
    ``df`` play no part.
    """
    radius = float(np.sqrt(2 - 2 * cosine))
    slim = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))
    keyed_type = T.StructType([T.StructField("id", T.LongType()), T.StructField("key", T.BinaryType()), T.StructField("raw", T.BinaryType())])
    keyed = written(slim.mapInArrow(_keyed, keyed_type), "vectors")
    # A class is a distinct vector, whatever ids its rows have; its number is fixed once it is written.
    classes = keyed.where("key is not null").groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.first("raw").alias("raw"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "vector-classes")
    count = classes.count()
    shared = share(df.sparkSession, _pivots(classes, count, radius))
    dealt_type = T.StructType([T.StructField("cell", T.LongType()), T.StructField("home", T.BooleanType()), T.StructField("node", T.LongType()), T.StructField("n", T.LongType()), T.StructField("raw", T.BinaryType())])
    dealt = written(classes.select("node", "n", "raw").mapInArrow(lambda b: _dealt(b, shared_value(shared), radius), dealt_type), "vector-cells")
    # One row for each pivot at most.
    sizes = dealt.groupBy("cell").agg(F.ceil(F.count_if("home") / SIDE).alias("rows"), F.ceil(F.count("*") / SIDE).alias("columns"))
    spread = dealt.join(F.broadcast(sizes), "cell").withColumns({"__i": F.pmod(F.xxhash64("node"), F.col("rows")), "__j": F.pmod(F.xxhash64("node", F.lit(1)), F.col("columns"))})
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    left = spread.where("home").select("cell", F.col("__i").alias("i"), every(F.col("columns")).alias("j"), "node", "n", "raw", F.lit(True).alias("mine"))
    right = spread.where("rows > 0").select("cell", every(F.col("rows")).alias("i"), F.col("__j").alias("j"), "node", "n", "raw", F.lit(False).alias("mine"))

    def joined(block: pd.DataFrame) -> pd.DataFrame:
        mine = block["mine"].to_numpy()
        if mine.all() or not mine.any():
            return pd.DataFrame({"node": block["node"][mine], "n_links": 0, "label": block["node"][mine]})
        return _block(block[mine], block[~mine], cosine)

    found = left.unionByName(right).groupBy("cell", "i", "j").applyInPandas(joined, _ROWS)
    found = written(found, "vector-links")
    groups = components(found.where("node <> label").select(F.col("node").alias("a"), F.col("label").alias("b"))).withColumnRenamed("node", "__node")
    placed = classes.select("key", "node", "rep", "n").join(groups, F.col("node") == F.col("__node"), "left").withColumn("c", F.coalesce("component", "node"))
    least = placed.groupBy("c").agg(F.min("rep").alias("component_id"))
    sums = found.groupBy("node").agg(F.sum("n_links").alias("__links"))
    totals = placed.join(sums, "node", "left").join(least, "c")
    totals = totals.select(F.col("key").alias("__key"), (F.coalesce("__links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    out = keyed.select("id", "key").join(totals, F.col("key") == F.col("__key"), "left")
    own = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), (F.col("id") == own).alias("kept"))


def op4_embeddings(spark, sf_dir: str) -> DataFrame:
    """Near-duplicates among all embeddings, whatever their labels."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


#: The same result by all pairs: for tables of some thousand vectors, of distinct ids.
OP4_SQL = f"""WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
u AS MATERIALIZED (SELECT vec_id, list_transform(x, lambda z: coalesce(z, 0)) AS x FROM v WHERE len(x) > 0 AND len(list_filter(x, lambda z: z IS NULL OR NOT isfinite(z))) = 0 AND len(list_filter(x, lambda z: z <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND CASE WHEN len(a.x) = len(b.x) THEN list_cosine_similarity(a.x, b.x) >= {COSINE} ELSE false END),
r(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)"""
