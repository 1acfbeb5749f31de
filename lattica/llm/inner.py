"""Exact top-k search by inner product, over vectors in descending length.

The longest vectors give every query a first threshold. Then the others are searched block
by block, longest first: by Cauchy and Schwarz a block whose longest vector times the query's
length stays below the threshold is never read for that query, and within a block the same
bound ends the search. What is left is compared in few coordinates: an SVD of a sample turns
the vectors so that the first ones hold most of their length, and the product of what remains
of both bounds the rest. Only pairs whose bound reaches the threshold get their exact product.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import discard, stage

#: Components of a block of targets at most; queries that a block meets in one task, at first and later; their rows a step.
COMPONENTS, FIRST_QUERIES, QUERIES, STEP = 1 << 23, 512, 8192, 512
#: Bytes of all rotations.
ROTATIONS = 64_000_000
#: Products below this are exact in double precision.
EXACT = 2.0**52
NONE = -(2.0**63)


def _integers(vectors: pa.Array, scale: int) -> np.ndarray:
    """floor(scale * x) of vectors of one length, as doubles, which hold them exactly."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(flat * scale).reshape(len(vectors), -1)


def _by_length(vectors: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(dims, rows that have as many components)."""
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
    for dims in np.unique(sizes):
        yield int(dims), np.flatnonzero(sizes == dims)


def _norms(x: np.ndarray) -> np.ndarray:
    """Lengths, a little too long rather than too short."""
    top = np.abs(x).max(axis=1, initial=0)
    scaled = x / np.where(top > 0, top, 1)[:, None]
    return top * np.sqrt((scaled * scaled).sum(axis=1)) * (1 + 1e-12)


def exact_products(q: np.ndarray, v: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Integer inner products of rows; beyond 53 bits in Python's integers, and held within 64."""
    out = np.zeros(len(q), dtype=np.int64)
    fine = bound < EXACT
    out[fine] = np.einsum("ij,ij->i", q[fine], v[fine]).astype(np.int64)
    for i in np.flatnonzero(~fine):
        total = sum(int(a) * int(b) for a, b in zip(q[i].tolist(), v[i].tolist(), strict=True))
        out[i] = max(-(2**63), min(2**63 - 1, total))
    return out


@dataclass
class Best:
    """The best so far of a run of queries, by (query, score descending, id, row)."""

    queries: int
    k: int
    least: np.ndarray  # the k-th score of each query, as far as known
    query: np.ndarray = field(default_factory=lambda: np.empty(0, dtype=np.int64))
    score: np.ndarray = field(default_factory=lambda: np.empty(0, dtype=np.int64))
    target: np.ndarray = field(default_factory=lambda: np.empty(0, dtype=np.int64))

    def take(self, query: np.ndarray, score: np.ndarray, target: np.ndarray, places: np.ndarray) -> None:
        """Add pairs; ``places`` are the targets' places in the order of ids."""
        query, score, target = (np.concatenate(x) for x in ((self.query, query), (self.score, score), (self.target, target)))
        order = np.lexsort((places[target], ~score, query))
        query, score, target = query[order], score[order], target[order]
        first = np.searchsorted(query, np.arange(self.queries))
        rank = np.arange(len(query)) - first[query]
        kept = rank < self.k
        self.query, self.score, self.target = query[kept], score[kept], target[kept]
        full = rank == self.k - 1
        self.least[query[full]] = np.maximum(self.least[query[full]], score[full])


class Targets:
    """Targets of one length of vector, longest first, with what the bounds need."""

    def __init__(self, ids: list, rows: np.ndarray, x: np.ndarray, rotation: np.ndarray | None):
        size = _norms(x)
        order = np.argsort(-size, kind="stable")
        self.x, self.size, self.rows = x[order], size[order], rows[order]
        self.ids = [ids[i] for i in order]
        self.rotation = rotation
        self.heads = sorted({max(1, x.shape[1] * n // 8) for n in (1, 2, 4, 6, 7)})
        self.first, self.rests = self.turned(self.x, self.size)
        by = sorted(range(len(ids)), key=lambda i: (self.ids[i] is None, 0 if self.ids[i] is None else self.ids[i], self.rows[i]))
        self.places = np.empty(len(ids), dtype=np.int64)
        self.places[by] = np.arange(len(ids))

    def turned(self, x: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """(the coordinates of all heads after the rotation, the length of what follows each head)."""
        first = x[:, : self.heads[-1]] if self.rotation is None else x @ self.rotation[:, : self.heads[-1]]
        with np.errstate(all="ignore"):
            return first, [np.sqrt(np.maximum(size * size * (1 + 1e-9) - (first[:, :n] * first[:, :n]).sum(axis=1), 0)) for n in self.heads]

    def reaching(self, first: np.ndarray, rests: list[np.ndarray], part: slice, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, target of ``part``) whose bound reaches the query's floor: partial sums over more and more coordinates, until few are left."""
        total, before = np.zeros((len(first), part.stop - part.start)), 0
        for n, rest, own in zip(self.heads, rests, self.rests, strict=True):
            total += first[:, before:n] @ self.first[part, before:n].T
            before = n
            open_ = ~(total + rest[:, None] * own[part] < floor[:, None])
            if np.count_nonzero(open_) * 64 < open_.size:
                break
        return np.nonzero(open_)

    def search(self, x: np.ndarray, rows: np.ndarray, least: np.ndarray, k: int) -> Best:
        """The ``k`` best targets of each query but its own row, of those that reach ``least``."""
        size = _norms(x)
        first, rests = self.turned(x, size)
        best = Best(len(x), k, least.copy())
        stop, step = 0, 64  # the first, small parts make thresholds for the others
        while stop < len(self.x):
            start, stop, step = stop, min(stop + step, len(self.x)), min(2 * step, 1024)
            part = slice(start, stop)
            with np.errstate(all="ignore"):
                open_ = np.flatnonzero(~(size * self.size[start] < best.least))
                if not len(open_):
                    break
                slack = 1e-9 * size[open_] * self.size[start] + 1e-6
                q, v = self.reaching(first[open_], [r[open_] for r in rests], part, best.least[open_] - slack)
            q, v = open_[q], v + start
            other = rows[q] != self.rows[v]
            q, v = q[other], v[other]
            for a in range(0, len(q), 100_000):
                i, j = q[a : a + 100_000], v[a : a + 100_000]
                with np.errstate(all="ignore"):
                    score = exact_products(x[i], self.x[j], size[i] * self.size[j])
                good = score >= best.least[i]
                best.take(i[good], score[good], j[good], self.places)
        return best


def _searched(cells: DataFrame, rotations: dict[int, np.ndarray], scale: int, k: int) -> DataFrame:
    """(query_row, query_id, id, row, score) of every cell; rows: block, part, least (null: a target), row, id, embedding."""
    shared = cells.sparkSession.sparkContext.broadcast(rotations)
    cells = cells.select("block", "part", "asks", "row", "id", "least", "embedding").repartition("block", "part").sortWithinPartitions("block", "part", "asks")
    kind = cells.schema["id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, ready = None, [], {}
        names = ["query_row", "query_id", "id", "row", "score"]
        for batch in batches:
            keys = np.stack([batch.column(i).cast(pa.int64()).to_numpy(zero_copy_only=False) for i in range(3)], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                key, part = tuple(keys[a, :2].tolist()), batch.slice(a, b - a)
                if key != last:
                    last, held, ready = key, [], {}
                if not keys[a, 2]:
                    held.append(part)
                    continue
                if held:
                    ready = _prepared(pa.Table.from_batches(held).combine_chunks(), shared.value, scale)
                    held = []
                for dims, at in _by_length(part.column(6)):
                    if dims not in ready:
                        continue
                    targets = ready[dims]
                    for step in range(0, len(at), STEP):
                        asks = part.take(pa.array(at[step : step + STEP]))
                        rows = asks.column(3).to_numpy()
                        best = targets.search(_integers(asks.column(6), scale), rows, asks.column(5).to_numpy(), k)
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(rows[best.query]), asks.column(4).take(pa.array(best.query)), pa.array([targets.ids[i] for i in best.target], batch.schema.field(4).type),
                                pa.array(targets.rows[best.target]), pa.array(best.score),
                            ],
                            names,
                        )

    return cells.mapInArrow(run, f"query_row long, query_id {kind}, id {kind}, row long, score long")


def _prepared(rows: pa.Table, rotations: dict[int, np.ndarray], scale: int) -> dict[int, Targets]:
    out = {}
    vectors = rows["embedding"].combine_chunks() if isinstance(rows["embedding"], pa.ChunkedArray) else rows["embedding"]
    vectors = vectors.chunk(0) if isinstance(vectors, pa.ChunkedArray) else vectors
    ids, numbers = rows["id"].to_pylist(), rows["row"].to_numpy()
    for dims, at in _by_length(vectors):
        out[dims] = Targets([ids[i] for i in at], numbers[at], _integers(vectors.take(pa.array(at)), scale), rotations.get(dims))
    return out


def _measured(vectors: DataFrame, scale: int) -> DataFrame:
    """Rows with dims and size, the length of their integer vectors."""
    place = vectors.columns.index("embedding")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(place).value_lengths().cast(pa.int32())
            size = np.zeros(batch.num_rows)
            with np.errstate(all="ignore"):
                for _, at in _by_length(batch.column(place)):
                    size[at] = _norms(_integers(batch.column(place).take(pa.array(at)), scale))
            yield pa.RecordBatch.from_arrays([*batch.columns, dims, pa.array(size)], [*batch.schema.names, "dims", "size"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.schema)
    return vectors.mapInArrow(run, f"{fields}, dims int, size double")


def _rotations(vectors: DataFrame, counts: dict[int, int], scale: int, sample: int) -> dict[int, np.ndarray]:
    """For lengths of vector, most frequent first, the right singular vectors of a sample, within ``ROTATIONS`` bytes."""
    rows = vectors.select("dims", "embedding").orderBy(F.xxhash64("row", "embedding")).limit(sample).toArrow()
    out, held = {}, 0
    for dims in sorted(counts, key=lambda d: (-counts[d], d)):
        held += 8 * dims * dims
        if not dims or held > ROTATIONS:
            break
        own = rows.filter(pc.equal(rows["dims"], dims))["embedding"].combine_chunks()
        own = own.chunk(0) if isinstance(own, pa.ChunkedArray) and own.num_chunks else own
        if len(own):
            x = _integers(own, scale)
            x = x / np.where((top := np.abs(x).max(axis=1)) > 0, top, 1)[:, None]
            out[dims] = np.linalg.svd(x.T @ x)[0]
    return out


def _parts(cells: DataFrame, queries: int) -> DataFrame:
    """Queries of a block in parts of ``queries``, and its targets once for each part."""
    sizes = cells.filter("asks").groupBy("block").agg(F.ceil(F.count(F.lit(1)) / queries).alias("parts"))
    check = F.hash("block").alias("check")
    cells = cells.select("*", check).join(sizes.select("*", check), ["block", "check"])
    every = F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)
    mine = F.array(F.pmod(F.xxhash64("row"), "parts"))
    return cells.withColumn("part", F.explode(F.when(F.col("asks"), mine).otherwise(every)))


def top_inner(
    vectors: DataFrame,
    queries: str = "vec_id % 50 = 0",
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 5,
    scale: int = 256,
    sample: int = 20_000,
) -> DataFrame:
    """The ``k`` best other rows of every query: query_id, rank (from 1), id_col, score.

    Components become floor(scale * x), x as double; a score is the integer inner product,
    ties go to the smaller id, a null id last. Queries are the rows for which the SQL condition
    ``queries`` holds, candidates all rows but the query's own; rows that repeat an id are each
    one of their own. Vectors that are null or hold null or non-finite components take no part;
    vectors meet those of their own length only. Scores beyond 64 bits become the largest or
    smallest long. Other columns are ignored, so none can clash; an empty table gives an empty one.

    The SVD learns from ``sample`` vectors at most, chosen by hash; it only turns the vectors,
    so results do not depend on it. Blocks are ranges of descending length, about the root of
    the rows in number and ``COMPONENTS`` large at most; a task holds one and streams queries.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[vector_col].dataType.simpleString()
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    rows = vectors.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(vector_col).cast(kind).alias("embedding"), F.coalesce(F.expr(queries), F.lit(False)).alias("query")
    )
    rows = rows.filter(F.col("embedding").isNotNull() & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    rows = stage(_measured(rows, scale), "measured-vectors")
    found = rows.groupBy("dims").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dims").limit(10_000).collect()  # for the rotations only
    counts = {r.dims: r.n for r in found}
    rotations = _rotations(rows, counts, scale, sample)
    n, components = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("dims").cast("long")), F.lit(0))).first()
    blocks = max(1, int(np.ceil(np.sqrt(n) / 16)), -(-components // COMPONENTS))
    ranged = rows.repartitionByRange(blocks, "dims", F.desc("size"), "row").withColumn("block", F.spark_partition_id().cast("long"))
    targets = stage(ranged.select("block", "row", "id", "embedding", "dims", "size"), "vector-blocks")
    highs = targets.groupBy("dims", "block").agg(F.max("size").alias("high"))  # one row a block and length
    asks = rows.filter("query").select("row", "id", "embedding", "dims", "size")
    columns = ["block", "asks", "row", "id", "least", "embedding"]
    gives = targets.withColumns({"asks": F.lit(False), "least": F.lit(NONE)}).select(*columns)

    first = highs.groupBy("dims").agg(F.min("block").alias("block"))
    seeds = asks.join(first, "dims").withColumns({"asks": F.lit(True), "least": F.lit(NONE)}).select(*columns)
    known = stage(_searched(_parts(gives.join(first.select("block").distinct(), "block", "left_semi").union(seeds), FIRST_QUERIES), rotations, scale, k), "first-products")

    reached = known.groupBy("query_row").agg(F.when(F.count(F.lit(1)) >= k, F.min("score").cast("double")).alias("least"))
    asks = asks.join(reached, F.col("row") == F.col("query_row"), "left").withColumn("least", F.coalesce("least", F.lit(NONE)))
    reach = F.col("size") * F.col("high") * (1 + 1e-9) >= F.col("least")
    later = highs.join(first.withColumnRenamed("block", "seed"), "dims").filter("block > seed").groupBy("dims")
    later = later.agg(F.array_sort(F.collect_list(F.struct("block", "high"))).alias("ahead"))  # one array a length, blocks in all
    further = asks.join(later, "dims").withColumn("ahead", F.explode("ahead")).select("*", "ahead.*").filter(reach | F.isnan("size") | F.isnan("high"))
    further = further.withColumn("asks", F.lit(True)).select(*columns)
    more = stage(_searched(_parts(gives.union(further), QUERIES), rotations, scale, k), "further-products")
    by = Window.partitionBy("query_row").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "row")
    ranked = known.union(more).withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)
    discard(rows, targets)
    return ranked.select(F.col("query_id"), "rank", F.col("id").alias(id_col), "score")
