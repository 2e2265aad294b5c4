"""Centroid clustering of vectors in integers, by partial distances.

Components are made integers once. In a round every task holds the centroids, whose number and width are parameters, and
adds up squared differences a few dimensions at a time, those of high variance first; a centroid is given up for a vector once
its sum is strictly above the best so far. All is integer arithmetic, so neither the order of rows nor that of dimensions
changes a result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored, table

K, ROUNDS, DIMS, SCALE = 16, 3, 64, 64
#: Dimensions that are added up before centroids are given up.
STEP = 8
#: A component of this size isn't kept: its integer wouldn't fit a long.
HUGE = 2.0**56
#: Up to this size of components, distances of 64 dimensions fit 64 bits; beyond it Python's integers are used.
NARROW = 1 << 27
MOST = 2**63 - 1


@dataclass
class Clusters:
    """``assigned``: vec_id, cluster, distance of every kept vector; ``centroids``: the last ones; ``inertia``: by cluster."""

    assigned: DataFrame
    centroids: list[list[int]]
    inertia: list[int]


def kept_vectors(rows: DataFrame, *, dims: int = DIMS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, x (array<long>): floor(scale * component), of vectors with exactly ``dims`` components, none null, not finite or
    of HUGE size times ``scale``; other rows are left out. Ids may be null or repeated."""
    x = F.transform(F.col(vector_col), lambda v: v.cast("double"))
    kept = rows.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).where(
        (F.size("x") == dims) & F.forall("x", lambda v: v.isNotNull() & (F.abs(v) < HUGE))
    )
    return kept.select("vec_id", F.transform("x", lambda v: F.floor(v * F.lit(float(scale))).cast("long")).alias("x"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    x = column.flatten().to_numpy().reshape(-1, dims)
    return x if not x.size or max(abs(int(x.min())), abs(int(x.max()))) <= NARROW else x.astype(object)


def nearest(x: np.ndarray, centroids: np.ndarray, order: np.ndarray, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """For rows of integers the nearest centroid by squared distance (of equal ones the smaller number), and the distance.

    ``order`` has the dimensions as they are added up. The first ``step`` of them pick the centroid that each row starts
    from, whose distance is completed; every other centroid goes on from there until its sum is strictly above the best.
    """
    n, k, d = len(x), len(centroids), x.shape[1]
    wide = x.dtype == object or centroids.dtype == object
    x, c = x[:, order], centroids[:, order]
    kind = object if wide else np.int64
    begun = np.zeros((n, k), kind)
    for j in range(k):
        diff = x[:, :step] - c[j, :step]
        begun[:, j] = (diff * diff).sum(1)
    label = begun.argmin(1)
    rows = np.arange(n)
    diff = x[:, step:] - c[label, step:]
    best = begun[rows, label] + (diff * diff).sum(1)
    for j in range(k):
        live = rows[(begun[:, j] <= best) & (label != j)]
        part = begun[live, j]
        for a in range(step, d, step):
            if not len(live):
                break
            diff = x[live, a : a + step] - c[j, a : a + step]
            part = part + (diff * diff).sum(1)
            on = part <= best[live]
            live, part = live[on], part[on]
        better = (part < best[live]) | (j < label[live])
        label[live[better]], best[live[better]] = j, part[better]
    return label, best


def _exact(centroids: list[list[int]]) -> np.ndarray:
    big = max((abs(v) for c in centroids for v in c), default=0) > NARROW
    return np.array(centroids, object if big else np.int64)


def _moved(vectors: DataFrame, centroids: list[list[int]], order: np.ndarray) -> list[list[int]]:
    """The centroids after a round: floors of the means of their vectors; one without vectors stays.

    A task sends k * dims sums, whatever it has read, in two parts that fit longs.
    """
    dims = len(centroids[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums, counts = _exact(centroids), np.zeros((len(centroids), dims), object), np.zeros(len(centroids), np.int64)
        for b in batches:
            x = _matrix(b.column(0), dims)
            if len(x):
                label, _ = nearest(x, now, order)
                for j in np.unique(label):
                    own = x[label == j]
                    sums[j] += own.sum(0).astype(object)
                    counts[j] += len(own)
        found = [(int(j), i, int(counts[j]), int(s) >> 32, int(s) & 0xFFFFFFFF) for j in np.flatnonzero(counts) for i, s in enumerate(sums[j])]
        yield pa.RecordBatch.from_pylist([dict(zip(names, f)) for f in found], pa.schema([(c, pa.int64()) for c in names]))

    names = ["j", "i", "n", "high", "low"]
    told = vectors.select("x").mapInArrow(run, ", ".join(f"{c} long" for c in names))
    out = [list(c) for c in centroids]
    for r in told.groupBy("j", "i").agg(*(F.sum(c).alias(c) for c in names[2:])).collect():  # at most k * dims rows
        out[r["j"]][r["i"]] = ((r["high"] << 32) + r["low"]) // r["n"]
    return out


def _assigned(vectors: DataFrame, centroids: list[list[int]], order: np.ndarray) -> DataFrame:
    dims = len(centroids[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = _exact(centroids)
        for b in batches:
            label, far = nearest(_matrix(b.column(1), dims), now, order)
            far = np.minimum(far, MOST).astype(np.int64)
            yield pa.record_batch([b.column(0), pa.array(label, pa.int32()), pa.array(far, pa.int64())], names=["vec_id", "cluster", "distance"])

    return vectors.select("vec_id", "x").mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster(
    rows: DataFrame, *, k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding"
) -> Clusters:
    """Cluster the kept vectors (``kept_vectors``) of a table.

    Centroids start as the k kept vectors with the smallest sha256 of ``1:<id>``, ids repeated by their components, null ids
    last; fewer vectors make fewer centroids, none make no clusters. A distance beyond a long is the largest long.
    """
    vectors = stored(kept_vectors(rows, dims=dims, scale=scale, id_col=id_col, vector_col=vector_col), "vectors")
    name = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    seeds = vectors.select("x", name.alias("name")).orderBy(F.col("name").asc_nulls_last(), "x").limit(k).collect()
    centroids = [list(r["x"]) for r in seeds]
    if not centroids:
        return Clusters(rows.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long"), [], [])
    spread = vectors.agg(*(F.var_pop(F.col("x")[i].cast("double")) for i in range(dims))).first()
    order = np.array(sorted(range(dims), key=lambda i: -spread[i]))
    for _ in range(rounds):
        centroids = _moved(vectors, centroids, order)
    assigned = stored(_assigned(vectors, centroids, order), "assigned")
    sums = dict(map(tuple, assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()))  # at most k rows
    return Clusters(assigned, centroids, [int(sums.get(j, 0)) for j in range(len(centroids))])


def op12_centroids(spark, sf_dir: str) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept vector of ``embeddings``.

    Rows with another number of components, or null, infinite or NaN ones, are left out. Null and repeated ids are vectors
    like others; repeated rows stay repeated. Sums beyond a long are the largest long. No kept rows give none.
    """
    found = cluster(table(spark, sf_dir, "embeddings"))
    whole = sum(found.inertia)
    told = [
        (j, min(found.inertia[j], MOST), min(whole, MOST), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest())
        for j, c in enumerate(found.centroids)
    ]
    clusters = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.assigned.join(F.broadcast(clusters), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def _oracle() -> str:
    """The same in SQL: a row for each component of a vector or a centroid."""
    steps = [f"""
WITH q AS (SELECT vec_id, row_number() OVER () AS r, embedding AS e FROM embeddings
  WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda v: v IS NOT NULL AND isfinite(v))) = {DIMS}),
v AS (SELECT r, vec_id, unnest(range({DIMS})) AS i, unnest(list_transform(e, lambda v: CAST(floor({SCALE} * CAST(v AS DOUBLE)) AS BIGINT))) AS x FROM q),
s AS (SELECT r, row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS j FROM q QUALIFY j < {K}),
c0 AS (SELECT s.j, v.i, v.x FROM s JOIN v USING (r))"""]
    for n in range(ROUNDS + 1):
        steps.append(f"""d{n} AS (SELECT v.r, c.j, CAST(sum((v.x - c.x) * (v.x - c.x)) AS BIGINT) AS far FROM v JOIN c{n} c USING (i) GROUP BY 1, 2),
a{n} AS (SELECT r, j, far FROM d{n} QUALIFY row_number() OVER (PARTITION BY r ORDER BY far, j) = 1)""")
        if n < ROUNDS:
            steps.append(f"""m{n} AS (SELECT a.j, v.i, CAST(sum(v.x) AS BIGINT) AS t, count(*) AS n FROM a{n} a JOIN v USING (r) GROUP BY 1, 2),
c{n + 1} AS (SELECT c.j, c.i, coalesce((m.t - ((m.t % m.n) + m.n) % m.n) // m.n, c.x) AS x FROM c{n} c LEFT JOIN m{n} m USING (j, i))""")
    steps.append(f"""h AS (SELECT j, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY j)
SELECT q.vec_id, CAST(a.j AS INTEGER) AS cluster, a.far AS distance, CAST(sum(a.far) OVER (PARTITION BY a.j) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.far) OVER () AS BIGINT) AS inertia, h.centroid_sha256 FROM a{ROUNDS} a JOIN q USING (r) JOIN h ON h.j = a.j""")
    return ",\n".join(steps)


ORACLE = _oracle()
