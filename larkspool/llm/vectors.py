"""Near-duplicate vectors by cosine: randomised-rotation binary codes with correction factors.

Vectors are assigned to the nearest of some centroids, fitted on a bounded sample. Relative
to a centroid, the direction o of a vector is rotated at random and reduced to one sign per
dimension, o'. Stored with the code are the length of the residual, its product with the
centroid and the correction factor <o', o>. For another vector's direction q,
``<o', q> / <o', o>`` estimates <o, q> without bias, and with overwhelming probability errs by
no more than ``EPSILON sqrt((1 - f^2) / f^2 / (D - 1))`` with f = <o', o>. So a code gives an interval for
the cosine; only pairs whose interval reaches the threshold are computed exactly, in
double precision. No pair below the threshold is ever linked.

A vector is compared within its own cluster and in every cluster that a neighbour at the
threshold may belong to: the distance of such a neighbour in the direction of the other
centroid has standard deviation eps / sqrt(D) with eps the largest distance of linked
vectors, and clusters nearer than MARGIN such deviations are probed, however many they are.
Pairs beyond are missed, unless all clusters are probed; the tests measure recall against brute force.

Identical vectors are one class with a weight. A cluster is compared in blocks of bounded
size, so a hot one becomes many tasks; a block gives each vector's number of links and a
spanning forest, never its pairs. Only the sample, centroids, cluster sizes and lookup tables known
to be small pass through the driver.

Vectors that are null, zero or hold null or non-finite components link with nothing. Every
row counts as a vector; rows that repeat an id, with equal or different vectors, are counted
and linked each by its own vector. Vectors of different dimension are not compared. A null
id links with nothing and gets no component.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspool.llm.common import join_dealt, share, sized, stage
from larkspool.llm.graph import components

#: Vectors in the sample that centroids are fitted on, vectors per centroid aimed at, and centroids at most.
SAMPLE, PER_CENTROID, CENTROIDS = 20_000, 200, 1_024
#: Standard deviations of the margin within which clusters are probed, and of the estimates' bounds.
MARGIN, EPSILON = 3.0, 4.0
#: Vectors of one block on either side.
MEMBERS, PROBES = 512, 2_048
#: Vectors of the sample that are compared with all centroids at a time.
SLICE = 2_000
SEED = 42
_CODED = (
    "cluster int, member boolean, class_id long, weight long, home int, probes array<int>, code binary,"
    " factor float, length float, along float, vector binary"
)


@dataclass
class Codes:
    """Centroids (unit length) and the rotation, with the margin for probing."""

    centroids: np.ndarray
    rotation: np.ndarray
    margin: float

    def places(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cluster of each unit vector, and which clusters it probes."""
        near = unit @ self.centroids.T
        home = near.argmax(axis=1)
        apart = np.sqrt(np.maximum(2 - 2 * self.centroids @ self.centroids.T, 1e-12))
        behind = (near[np.arange(len(unit)), home][:, None] - near) / apart[home]
        probed = behind <= self.margin
        probed[np.arange(len(unit)), home] = True
        return home, probed

    def rotated(self, unit: np.ndarray, cluster: int | np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rotated directions of residuals, their lengths, and their products with the centroid."""
        centre = self.centroids[cluster]
        rest = unit - centre
        length = np.linalg.norm(rest, axis=1)
        direction = (rest @ self.rotation) / np.maximum(length, 1e-30)[:, None]
        return direction, length, np.sum(rest * centre, axis=1)


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, dim (null if it can't link), hi, lo of the components, and these as doubles."""
    for batch in batches:
        rows = []
        for values in batch.column(1).to_pylist():
            usable = values is not None and None not in values
            vector = np.array(values if usable else [], np.float64)
            norm = np.linalg.norm(vector) if len(vector) and np.isfinite(vector).all() else 0.0
            good = 0 < norm < np.inf
            hi, lo = np.frombuffer(xxhash.xxh3_128_digest(vector.tobytes()), ">i8").tolist()
            rows.append((len(vector) if good else None, hi, lo, vector.tobytes() if good else None))
        dim, hi, lo, data = zip(*rows, strict=True) if rows else [()] * 4
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(dim, pa.int32()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()),
             pa.array(data, pa.binary())], ["vec_id", "dim", "hi", "lo", "vector"],
        )


def _fitted(sample: np.ndarray, n: int, threshold: float, margin: float | None = MARGIN) -> Codes:
    rng = np.random.default_rng(SEED)
    dim = sample.shape[1]
    k = int(min(CENTROIDS, len(sample), max(1, n // PER_CENTROID)))
    centroids = sample[rng.choice(len(sample), k, replace=False)]
    for _ in range(8):
        home = np.concatenate([(sample[at : at + SLICE] @ centroids.T).argmax(axis=1) for at in range(0, len(sample), SLICE)])
        sums = np.zeros_like(centroids)
        np.add.at(sums, home, sample)
        norms = np.linalg.norm(sums, axis=1)
        centroids = np.where(norms[:, None] > 1e-9, sums / np.maximum(norms, 1e-9)[:, None], centroids)
    rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    return Codes(centroids, rotation, np.inf if margin is None else margin * np.sqrt(2 - 2 * threshold) / np.sqrt(dim))


def _matrix(column: pa.Array, dtype: type, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, dim)


def _coded(classes: DataFrame, codes: Codes, dim: int) -> DataFrame:
    """Every class as a member of its cluster (with its vector), and coded for every cluster it probes."""
    shared = share(classes.sparkSession, codes)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = shared()
        for whole in batches:
            for at in range(0, whole.num_rows, 2_000):
                batch = whole.slice(at, 2_000)
                raw = _matrix(batch.column("vector"), np.float64, dim)
                unit = raw / np.linalg.norm(raw, axis=1)[:, None]
                home, probed = codes.places(unit)
                lists = pa.array([np.flatnonzero(p) for p in probed], pa.list_(pa.int32()))
                row, cluster = np.nonzero(probed)
                direction, length, along = codes.rotated(unit[row], cluster)
                factor = np.abs(direction).sum(axis=1) / np.sqrt(dim)
                packed = np.packbits(direction > 0, axis=1)
                for member in (True, False):
                    take = np.arange(len(raw)) if member else row
                    where = pa.array(take)
                    n = len(take)
                    coded = [pa.nulls(n, t) for t in (pa.binary(), pa.float32(), pa.float32(), pa.float32())]
                    if not member:
                        coded = [pa.array([p.tobytes() for p in packed], pa.binary())]
                        coded += [pa.array(x.astype(np.float32)) for x in (factor, length, along)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array((home if member else cluster).astype(np.int32)), pa.array(np.full(n, member)),
                         batch.column("class_id").take(where), batch.column("weight").take(where),
                         pa.array(home[take].astype(np.int32)), lists.take(where), *coded,
                         batch.column("vector").take(where)],
                        [c.split()[0] for c in _CODED.split(", ")],
                    )

    return classes.select("class_id", "weight", "vector").mapInArrow(encode, _CODED)


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest place that links (a, b) lead each place 0..n-1 to."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _links_in_block(rows: pa.Table, codes: Codes, dim: int, threshold: float) -> pa.Table:
    """class_id, n, root: the links this block adds to a class, and the smallest class of its tree."""
    rows = rows.combine_chunks()
    member = rows.column("member").to_numpy()
    members, probes = rows.filter(pa.array(member)), rows.filter(pa.array(~member))
    empty = pa.table({"class_id": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
    if not members.num_rows or not probes.num_rows:
        return empty
    cluster = rows.column("cluster")[0].as_py()
    y, x = (_matrix(t.column("vector"), np.float64, dim) for t in (members, probes))
    y_norm, x_norm = np.linalg.norm(y, axis=1), np.linalg.norm(x, axis=1)
    direction, y_length, y_along = codes.rotated(y / y_norm[:, None], np.full(len(y), cluster))
    bits = np.unpackbits(_matrix(probes.column("code"), np.uint8, -(-dim // 8)), axis=1)[:, :dim]
    signs = bits.astype(np.float32) * 2 - 1
    factor, x_length, x_along = (probes.column(c).to_numpy().astype(np.float64) for c in ("factor", "length", "along"))
    factor = np.maximum(factor, 1e-6)
    bound = EPSILON * np.sqrt((1 - np.minimum(factor, 1) ** 2) / factor**2 / max(1, dim - 1))
    estimate = (signs @ direction.T.astype(np.float32)) / (np.sqrt(dim) * factor)[:, None]
    scale = x_length[:, None] * y_length[None, :]
    upper = 1 + x_along[:, None] + y_along[None, :] + scale * (estimate + bound[:, None])
    i, j = np.nonzero(upper >= threshold - 1e-5)
    kept = [np.zeros(0, bool)]
    for at in range(0, len(i), 200_000):
        a, b = i[at : at + 200_000], j[at : at + 200_000]
        kept.append(np.einsum("nd,nd->n", x[a], y[b]) / (x_norm[a] * y_norm[b]) >= threshold)
    kept = np.concatenate(kept)
    x_id, y_id = probes.column("class_id").to_numpy(), members.column("class_id").to_numpy()
    kept &= x_id[i] != y_id[j]
    i, j = i[kept], j[kept]
    if not len(i):
        return empty
    x_weight, y_weight = probes.column("weight").to_numpy(), members.column("weight").to_numpy()
    home = probes.column("home").to_numpy()
    probed_by_y = [set(p) for p in members.column("probes").to_pylist()]
    # Where the member probes the other's cluster too, it counts the link there; else here.
    alone = np.fromiter((home[a] not in probed_by_y[b] for a, b in zip(i, j, strict=True)), bool, len(i))
    n_x = np.bincount(i, y_weight[j], len(x))
    n_y = np.bincount(j[alone], x_weight[i[alone]], len(y))
    ids, place = np.unique(np.concatenate([x_id, y_id]), return_inverse=True)
    n = np.bincount(place, np.concatenate([n_x, n_y]), len(ids)).astype(np.int64)
    root = ids[_forest(place[: len(x)][i], place[len(x) :][j], len(ids))]
    some = (n > 0) | (root != ids)
    return pa.table({"class_id": ids[some], "n": n[some], "root": root[some]})


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, margin: float | None = MARGIN) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``vectors`` (vec_id, embedding).

    ``margin`` is in standard deviations; None probes every cluster, at the price of comparing
    all blocks with each other, so that only the bounds of the estimates can miss a pair.
    """
    vectors = vectors.select(F.col("vec_id").cast("bigint"), F.col("embedding").cast("array<double>"))
    schema = "vec_id long, dim int, hi long, lo long, vector binary"
    rows = stage(vectors.mapInArrow(_vectors, schema), "vectors")
    usable = rows.where("dim is not null and vec_id is not null")
    classes = usable.groupBy("dim", "hi", "lo").agg(
        F.min(F.struct("vec_id", "vector")).alias("least"), F.count(F.lit(1)).alias("weight")
    )
    classes = classes.select(
        F.monotonically_increasing_id().alias("class_id"), "dim", "hi", "lo", "weight", "least.vec_id", "least.vector"
    )
    classes = stage(classes, "vector-classes")  # once written, class ids are fixed

    links = None
    dims = sorted((r["dim"], r["n"]) for r in classes.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect())
    total = sum(n for _, n in dims)
    for dim, n in dims:
        some = _links(classes.where(F.col("dim") == dim), dim, n, threshold, margin)
        links = some if links is None else links.unionByName(some)
    if links is None:
        links = vectors.sparkSession.createDataFrame([], "class_id long, n long, root long")
    links = stage(links, "vector-links")
    found = components(links.select(F.col("class_id").alias("u"), F.col("root").alias("v")))
    found = found.withColumnsRenamed({"node": "class_id", "component": "tree"})
    counts = links.groupBy("class_id").agg(F.sum("n").alias("n"))
    per_class = (
        classes.drop("vector")
        .join(sized(counts, total), "class_id", "left")
        .join(sized(found, total), "class_id", "left")
        .withColumn("tree", F.coalesce("tree", "class_id"))
        .withColumn("n_links", F.coalesce("n", F.lit(0)) + F.col("weight") - 1)
        .select("hi", "lo", "dim", "tree", "vec_id", "n_links", "class_id")
    )
    per_class = stage(per_class, "vector-trees")
    # The least vector id of each tree; a tree with a third of all classes is spread, and so are the rows of one class.
    least = per_class.groupBy("tree").agg(F.min("vec_id").alias("component_id"))
    per_class = join_dealt(per_class, least, ["tree"], F.col("class_id"), total)
    per_class = per_class.select("hi", "lo", "dim", "n_links", "component_id")
    out = join_dealt(usable.select("vec_id", "dim", "hi", "lo"), per_class, ["dim", "hi", "lo"], F.xxhash64("vec_id"), total)
    out = out.select("vec_id", "n_links", "component_id")
    rest = rows.where("dim is null or vec_id is null")
    rest = rest.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(rest).withColumn("kept", F.coalesce(F.expr("vec_id = component_id"), F.lit(False)))


def _links(classes: DataFrame, dim: int, n: int, threshold: float, margin: float | None) -> DataFrame:
    spark = classes.sparkSession
    share_ = min(1.0, SAMPLE / n)
    chosen = classes.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int(share_ * (1 << 30)))
    sample = sorted((r["vec_id"], bytes(r["vector"])) for r in chosen.select("vec_id", "vector").collect())
    if not sample:
        sample = [(r["vec_id"], bytes(r["vector"])) for r in classes.select("vec_id", "vector").limit(1).collect()]
    raw = np.frombuffer(b"".join(v for _, v in sample), np.float64).reshape(-1, dim)
    codes = _fitted(raw / np.linalg.norm(raw, axis=1)[:, None], n, threshold, margin)
    coded = stage(_coded(classes, codes, dim), "vector-codes")

    # One row per centroid: into how many blocks its members and those who probe it are cut.
    sizes = coded.groupBy("cluster").agg(
        F.ceil(F.sum(F.expr("int(member)")) / MEMBERS).cast("int").alias("parts"),
        F.ceil(F.sum(F.expr("int(not member)")) / PROBES).cast("int").alias("chunks"),
    )
    sized = coded.join(F.broadcast(sizes), "cluster")
    number = F.pmod(F.xxhash64("class_id", F.lit("block")), F.lit(1 << 30))
    mine = F.pmod(number, F.when(F.col("member"), F.col("parts")).otherwise(F.col("chunks"))).cast("int")
    others = F.sequence(F.lit(0), F.when(F.col("member"), F.col("chunks")).otherwise(F.col("parts")) - 1)
    sized = sized.where("parts > 0 and chunks > 0").withColumn("mine", mine).withColumn("other", F.explode(others))
    blocks = sized.withColumn("part", F.when(F.col("member"), F.col("mine")).otherwise(F.col("other"))).withColumn(
        "chunk", F.when(F.col("member"), F.col("other")).otherwise(F.col("mine"))
    )
    shared = share(spark, codes)

    def compare(rows: pa.Table) -> pa.Table:
        return _links_in_block(rows, shared(), dim, threshold)

    blocks = blocks.drop("parts", "chunks", "mine", "other")
    return blocks.groupBy("cluster", "part", "chunk").applyInArrow(compare, "class_id long, n long, root long")
