"""Near-duplicate embeddings: Euclidean p-stable hashing, then exact cosines.

Vectors are normalised; for each table, k random Gaussian projections are
shifted, divided by a width and rounded down, and vectors with the same k
integers share a bucket. In a bucket all cosines are computed exactly, in double
precision, stripe by stripe. A pair that met in an earlier table is skipped, so
every pair counts once although no pair is ever written: a task emits counts
for rows, and links that connect them as all links would.

Hashing goes in two levels, so that few copies of a vector travel. A label whose
vectors fit into one task's memory is one cell. A larger label is cut into cells by
a few tables of few projections; a vector goes once to each of its cells, with
nothing but itself. In a cell, tables of more projections find the buckets, in
memory. The number of tables follows from k for the wanted recall at the threshold,
over both levels; k follows from the number of vectors. Projections are taken in
whole numbers that doubles hold exactly, so a vector's buckets follow from it alone
and can be computed again wherever they are needed.

Defined results: a vector that is null, empty, zero or has a null, infinite or
NaN component, or whose label is null, links with nothing; vectors of different
lengths don't link; equal vectors of one label are one class, whose members
count as linked without being compared; rows with a repeated vec_id count as
separate vectors; a null vec_id is never a component's smallest; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from palimpsest.llm.common import saved
from palimpsest.operators.components import connected_components
from palimpsest.operators.spread import join_large_keys, with_least

THRESHOLD = 0.93
RECALL = 0.97
WIDTH = 1.5
#: Vectors that share a bucket in a cell by chance, on average.
BUCKET_ROWS = 2048
#: The vectors of a cell's block take so many bytes as doubles.
CELL_BYTES = 64 << 20
#: A matrix of cosines holds so many at a time.
STRIPE = 1 << 22
#: Lists of large labels and cells are broadcast up to so many rows, else joined.
BROADCAST_ROWS = 100_000
SEED = 17
#: Units of a component and of a direction when projections are taken in whole numbers.
_UNIT, _DIRECTION = 2.0**20, 2.0**10


def _same_cell(distance: float, width: float) -> float:
    """Chance that one projection puts two vectors at this distance into one cell."""
    r = width / distance
    normal = 0.5 * math.erfc(r / math.sqrt(2))
    return 1 - 2 * normal - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan(vectors: int, threshold: float = THRESHOLD, recall: float = RECALL, width: float = WIDTH, bucket_rows: int = BUCKET_ROWS) -> tuple[int, int]:
    """(projections a table, tables) for so many vectors; one table without projections if they fit one bucket."""
    if vectors <= bucket_rows:
        return 0, 1
    close, far = _same_cell(math.sqrt(2 - 2 * threshold), width), _same_cell(math.sqrt(2), width)
    k = max(1, math.ceil(math.log(vectors / bucket_rows) / -math.log(far)))
    return k, math.ceil(math.log(1 - recall) / math.log(1 - close**k))


def expected_recall(k: int, tables: int, threshold: float = THRESHOLD, width: float = WIDTH) -> float:
    """The chance that a pair at the threshold shares a bucket."""
    return 1 - (1 - _same_cell(math.sqrt(2 - 2 * threshold), width) ** k) ** tables


def keys(unit: np.ndarray, k: int, tables: int, width: float = WIDTH, seed: int = SEED) -> np.ndarray:
    """Bucket keys [rows, tables] of normalised vectors; the projections depend on seed and dimension only.

    Components and directions are rounded to whole numbers whose products and
    sums are exact as doubles, so a key doesn't depend on the vectors around.
    """
    dim = unit.shape[1]
    # Drawn table by table, so that fewer tables are the first of more.
    directions = np.rint(np.random.default_rng([seed, dim, 0]).standard_normal((k * tables, dim)) * _DIRECTION).T
    shifts = np.rint(np.random.default_rng([seed, dim, 1]).uniform(0, width, k * tables) * (_UNIT * _DIRECTION))
    out = np.full((len(unit), tables), seed, np.uint64)
    for s in range(0, len(unit), 8192):
        cells = np.floor((np.rint(unit[s : s + 8192] * _UNIT) @ directions + shifts) / (width * _UNIT * _DIRECTION))
        cells = cells.astype(np.int64).reshape(-1, tables, k)
        part = out[s : s + 8192]
        for i in range(k):
            part = (part ^ cells[:, :, i].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            part ^= part >> np.uint64(29)
        out[s : s + 8192] = part
    return out.view(np.int64)


def _matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    """Vectors of one length as normalised rows, in double precision."""
    matrix = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)
    matrix /= np.abs(matrix).max(axis=1, keepdims=True)
    return matrix / np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))


def _deal(k: int, tables: int, seed: int, with_vectors: bool):
    """Each row of a large label once for each of its cells, any other in its label's only one."""

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            large, dims = batch.column("large").to_numpy(zero_copy_only=False), batch.column("dim").to_numpy()
            for is_large in (False, True):
                for dim in np.unique(dims[large == is_large]).tolist():
                    at = np.flatnonzero((large == is_large) & (dims == dim))
                    for s in range(0, len(at), 4096):
                        part = batch.take(pa.array(at[s : s + 4096]))
                        n, t = len(part), tables if is_large else 1
                        cell = keys(_matrix(part.column("embedding"), dim), k, t, seed=seed).ravel() if is_large else np.zeros(n, np.int64)
                        part = part.take(pa.array(np.repeat(np.arange(n), t)))
                        named = {name: part.column(name) for name in (("label", "dim", "node", "members", "embedding") if with_vectors else ("label", "dim"))}
                        named |= {"table": pa.array(np.tile(np.arange(t, dtype=np.int32), n)), "cell": pa.array(cell)}
                        yield pa.RecordBatch.from_arrays(list(named.values()), list(named))

    return dealt


GROUP = ["label", "dim", "table", "cell", "block_a", "block_b"]


def _components_of(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest row reachable from each of n rows, by repeated minima."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _bucket(unit: np.ndarray, at: np.ndarray, weight: np.ndarray, side: np.ndarray | None, met: list[np.ndarray], threshold: float, counts: np.ndarray) -> np.ndarray:
    """Compares the rows `at` with each other, adds to their counts, and returns their components as places in `at`.

    `met` holds all rows' keys in earlier tables: pairs that share one aren't
    counted again. With `side`, only rows of different sides are compared.
    """
    here, label = unit[at], np.arange(len(at))
    step = max(1, STRIPE // len(at))
    for s in range(0, len(at), step):
        near = here[s : s + step] @ here.T >= threshold
        near[np.arange(len(near)), np.arange(s, s + len(near))] = False
        if side is not None:
            near &= side[at[s : s + step], None] != side[at][None, :]
        i, j = np.nonzero(near)
        i += s
        if not len(i):
            continue
        apart = label[i] != label[j]
        if apart.any():
            label = _components_of(len(at), label[i[apart]], label[j[apart]])[label]
        left, right = at[i], at[j]
        new = np.ones(len(i), bool)
        for key in met:
            new &= key[left] != key[right]
        counts[at] += np.bincount(i[new], weight[right[new]], len(at)).astype(np.int64)
    return label


def compare(unit: np.ndarray, weight: np.ndarray, side: np.ndarray | None, earlier: list[np.ndarray], threshold: float, recall: float, bucket_rows: int = BUCKET_ROWS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Of a cell's rows: linked weight of each, and the smallest row of its component.

    `earlier` are the rows' keys in cells of earlier tables, where such pairs count.
    """
    n, counts = len(unit), np.zeros(len(unit), np.int64)
    k, tables = plan(n, threshold, recall, bucket_rows=bucket_rows)
    found = keys(unit, k, tables, seed=seed + 1) if k else np.zeros((n, 1), np.int64)
    met, ends = list(earlier), []
    for t in range(tables):
        key = np.ascontiguousarray(found[:, t])
        order = np.argsort(key, kind="stable")
        start = np.flatnonzero(np.concatenate(([True], key[order][1:] != key[order][:-1])))
        for a, b in zip(start.tolist(), [*start[1:].tolist(), n]):
            at = order[a:b]
            # Rows that were all in one bucket before have nothing new between them.
            if b - a == 1 or any((x[at] == x[at[0]]).all() for x in met):
                continue
            label = _bucket(unit, at, weight, side, met, threshold, counts)
            moved = np.flatnonzero(label != np.arange(len(at)))
            ends.append(np.stack([at[moved], at[label[moved]]]))
        met.append(key)
    i, j = np.concatenate(ends, axis=1) if ends else np.zeros((2, 0), np.int64)
    return counts, _components_of(n, i, j)


def _compare_groups(threshold: float, recall: float, k: int, seed: int, bucket_rows: int):
    """Feeds whole cells to `compare`; a cell may span Arrow batches."""

    def done(parts: list[pa.RecordBatch], dim: int, table: int) -> pa.RecordBatch:
        group = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        unit, node, weight = _matrix(group.column("embedding"), dim), group.column("node").to_numpy(), group.column("members").to_numpy()
        crossed = group.column("block_a")[0] != group.column("block_b")[0]
        side = group.column("block_own").to_numpy() if crossed else None
        earlier = [np.ascontiguousarray(x) for x in keys(unit, k, table, seed=seed).T] if table else []
        counts, label = compare(unit, weight, side, earlier, threshold, recall, bucket_rows, seed)
        hit, moved = np.flatnonzero(counts), np.flatnonzero(label != np.arange(len(label)))
        none = np.zeros(max(len(hit), len(moved)), np.int64)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([node[hit], node[moved]])), pa.array(np.concatenate([none[: len(hit)], node[label[moved]]])),
                pa.array(np.concatenate([counts[hit], none[: len(moved)]])), pa.array(np.arange(len(hit) + len(moved)) >= len(hit)),
            ],
            ["a", "b", "n", "is_link"],
        )

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        head: list = []
        for batch in batches:
            if not len(batch):
                continue
            change = np.zeros(len(batch) - 1, bool)
            for name in GROUP:
                values = batch.column(name).to_numpy(zero_copy_only=False)
                change |= values[1:] != values[:-1]
            cuts = [0, *(np.flatnonzero(change) + 1).tolist(), len(batch)]
            for a, b in zip(cuts, cuts[1:]):
                first = [batch.column(name)[a].as_py() for name in GROUP]
                if first != head:
                    if sum(map(len, held)) > 1:
                        yield done(held, head[1], head[2])
                    held, head = [], first
                held.append(batch.slice(a, b - a))
        if sum(map(len, held)) > 1:
            yield done(held, head[1], head[2])

    return compared


def _listed(table: DataFrame) -> DataFrame:
    """A table of large labels or cells for a join: broadcast where its checked size allows it."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def links(
    classes: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, cell_bytes: int = CELL_BYTES, bucket_rows: int = BUCKET_ROWS, seed: int = SEED
) -> DataFrame:
    """Linked weights (a, n) and links (a, b, is_link) of distinct vectors (label, dim, node, members, embedding)."""
    block_rows = F.greatest(F.floor(F.lit(cell_bytes) / (8 * F.col("dim"))), F.lit(1))
    sizes = classes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")).withColumn("times", F.col("n") / block_rows)
    most = sizes.agg(F.max("times")).first()[0] or 0
    k, tables = plan(math.ceil(most), threshold, recall**0.5, bucket_rows=1)
    own = recall / expected_recall(k, tables, threshold) if k else recall
    if k:
        large = saved(sizes.where("times > 1").select("label", "dim", F.lit(True).alias("large")), "large")
        marked = classes.join(_listed(large), ["label", "dim"], "left").withColumn("large", F.coalesce("large", F.lit(False)))
        kinds = {f.name: f for f in classes.schema}
        cell = [T.StructField("table", T.IntegerType()), T.StructField("cell", T.LongType())]
        schema = T.StructType([*(kinds[c] for c in ("label", "dim", "node", "members", "embedding")), *cell])
        dealt = marked.mapInArrow(_deal(k, tables, seed, True), schema)
        # Cells that are larger than a block all the same, as a group of near copies may be.
        narrow = marked.where("large").mapInArrow(_deal(k, tables, seed, False), T.StructType([kinds["label"], kinds["dim"], *cell]))
        crowded = narrow.groupBy("label", "dim", "table", "cell").agg(F.count(F.lit(1)).alias("n")).withColumn("blocks", F.ceil(F.col("n") / block_rows).cast("int"))
        crowded = saved(crowded.where("blocks > 1").drop("n"), "crowded")
        dealt = dealt.join(_listed(crowded), ["label", "dim", "table", "cell"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    else:
        dealt = classes.withColumn("table", F.lit(0)).withColumn("cell", F.lit(0).cast("bigint")).withColumn("blocks", F.lit(1))
    # A row of a crowded cell goes to the pairs of blocks that hold its own, so that two rows meet in one pair.
    dealt = dealt.withColumn("block_own", F.pmod(F.xxhash64(F.lit(911), "node"), F.col("blocks").cast("bigint")).cast("int"))
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(
        "label", "dim", "table", "cell", F.least("block_own", "_other").alias("block_a"), F.greatest("block_own", "_other").alias("block_b"),
        "block_own", "node", "members", "embedding",
    )
    dealt = dealt.repartition(*GROUP).sortWithinPartitions(*GROUP)
    return dealt.mapInArrow(_compare_groups(threshold, own, k, seed, bucket_rows), "a bigint, b bigint, n bigint, is_link boolean")


def _usable(embedding: Column, label: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    found = label.isNotNull() & embedding.isNotNull() & (F.size(embedding) > 0) & F.forall(embedding, finite) & F.exists(embedding, lambda x: x != 0)
    return F.coalesce(found, F.lit(False))


def report(
    vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, cell_bytes: int = CELL_BYTES, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """Per vector n_links, component_id and kept; recall is that of a pair at the threshold."""
    kind = vectors.schema["embedding"].dataType.elementType
    kind = kind if isinstance(kind, (T.FloatType, T.DoubleType)) else T.DoubleType()
    embedding = F.col("embedding").cast(T.ArrayType(kind))
    # Components equal as numbers are equal here: adding 0 makes -0 into 0.
    same = F.transform(embedding, lambda x: x + F.lit(0).cast(kind))
    rows = vectors.select("vec_id", F.col("label").alias("label"), same.alias("embedding"))
    usable = _usable(F.col("embedding"), F.col("label"))
    # Equal vectors meet by 128 bits of hash.
    hashes = [F.xxhash64(F.lit(n), "embedding").alias(f"h{n}") for n in (1, 2)]
    key = ["label", "h1", "h2"]
    classes = rows.where(usable).select("vec_id", "label", "embedding", *hashes).groupBy(*key).agg(
        F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("members"), F.first("embedding").alias("embedding")
    )
    classes = saved(classes.withColumn("dim", F.size("embedding")).withColumn("node", F.monotonically_increasing_id()), "classes")
    total = classes.agg(F.coalesce(F.sum("members"), F.lit(0))).first()[0]
    compared = saved(links(classes.select("label", "dim", "node", "members", "embedding"), threshold, recall, cell_bytes, bucket_rows), "links")
    counts = compared.where("NOT is_link").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    labels = connected_components(compared.where("is_link").select("a", "b"))
    named = classes.select(*key, "node", "low", "members").join(counts, "node", "left").join(labels, "node", "left")
    named = with_least(named.withColumn("component", F.coalesce("component", "node")), "component", "low", "component_id")
    named = named.select(*key, (F.coalesce("n", F.lit(0)) + F.col("members") - 1).alias("n_links"), "component_id", "members")
    own = rows.where(usable).select("vec_id", "label", *hashes)
    out = join_large_keys(own, named, key, "members", total, F.monotonically_increasing_id()).select("vec_id", "n_links", "component_id")
    none = rows.where(~usable).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = out.unionByName(none)
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id", F.col("n_links").cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept")
    )
