"""Near-dedup of embeddings by product quantisation.

A coarse codebook deals unit vectors to cells, which are the inverted lists; within a cell
the residual's subspaces are replaced by codes. A query probes the cells nearest to it. In a
cell, distances to codes come from tables made for the query alone (the target is known by
its codes only); as a target's own quantisation error is kept with it, no target within the
wanted distance is lost there. What is left is ranked by exact cosine.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..session import discard, stage

#: Queries and targets of a cell that meet in one block.
QUERIES, TARGETS = 512, 1024
#: Coarse centres that are learnt at most; beyond, each has finer ones.
COARSE = 1024
KEYS = ("dims", "label", "block_cell")


def _nearest(x: np.ndarray, centres: np.ndarray, k: int = 1) -> np.ndarray:
    """The k nearest centres of each row, nearest first."""
    score = (centres * centres).sum(axis=1) - 2 * x @ centres.T
    if k == 1:
        return score.argmin(axis=1)[:, None]
    part = np.argpartition(score, min(k, len(centres)) - 1, axis=1)[:, :k]
    return np.take_along_axis(part, np.take_along_axis(score, part, 1).argsort(axis=1, kind="stable"), 1)


def _means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """k-means of rows; with fewer rows than k, the rows themselves."""
    centres = x[np.sort(rng.permutation(len(x))[:k])].copy()
    for _ in range(rounds):
        own = _nearest(x, centres)[:, 0]
        n = np.bincount(own, minlength=len(centres))
        for d in range(x.shape[1]):
            sums = np.bincount(own, x[:, d], len(centres))
            centres[:, d] = np.where(n > 0, sums / np.maximum(n, 1), centres[:, d])
    return centres


@dataclass
class Codebook:
    """Cells are pairs of a coarse centre and a finer one of its residuals, so their number can grow with the input while few centres are learnt."""

    coarse: np.ndarray  # (coarse cells, dims)
    fine: np.ndarray  # (cells of each, dims)
    codes: list[np.ndarray]  # for each subspace (codes, its dims)

    @classmethod
    def fit(cls, x: np.ndarray, cells: int, parts: int = 8, codes: int = 64, rounds: int = 8, seed: int = 5) -> Codebook:
        rng = np.random.default_rng(seed)
        coarse = _means(x, min(cells, COARSE), rounds, rng)
        rest = x - coarse[_nearest(x, coarse)[:, 0]]
        per = -(-cells // COARSE)
        fine = _means(rest, per, rounds, rng) if per > 1 else np.zeros((1, x.shape[1]))
        rest = rest - fine[_nearest(rest, fine)[:, 0]]
        return cls(coarse, fine, [_means(s, codes, rounds, rng) for s in np.array_split(rest, min(parts, x.shape[1]), axis=1)])

    @classmethod
    def plain(cls, dims: int) -> Codebook:
        """One cell and one code that say nothing: all pairs go to the exact cosine."""
        return cls(np.zeros((1, dims)), np.zeros((1, dims)), [np.zeros((1, dims))])

    def centre(self, cell: int) -> np.ndarray:
        return self.coarse[cell // len(self.fine)] + self.fine[cell % len(self.fine)]

    def near(self, x: np.ndarray, probes: int) -> np.ndarray:
        """The cells nearest to each row, nearest first; of the coarse cells only ``probes`` are asked."""
        first = _nearest(x, self.coarse, min(probes, len(self.coarse)))
        rest = x[:, None] - self.coarse[first]
        far = (rest * rest).sum(axis=2)[:, :, None] + (self.fine * self.fine).sum(axis=1) - 2 * rest @ self.fine.T
        cells = (first[:, :, None] * len(self.fine) + np.arange(len(self.fine))).reshape(len(x), -1)
        far = far.reshape(len(x), -1)
        best = np.argsort(far, axis=1, kind="stable")[:, :probes]
        return np.take_along_axis(cells, best, 1)

    def _split(self, x: np.ndarray) -> list[np.ndarray]:
        return np.array_split(x, len(self.codes), axis=1)

    def encode(self, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes of residuals, how far each is from what its codes say)."""
        found = np.stack([_nearest(s, c)[:, 0] for s, c in zip(self._split(rest), self.codes, strict=True)], axis=1)
        told = np.concatenate([c[found[:, i]] for i, c in enumerate(self.codes)], axis=1)
        return found.astype(np.uint8), np.sqrt(((rest - told) ** 2).sum(axis=1))

    def distances(self, rest: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Squared distances of queries' residuals to coded targets, by table lookup."""
        out = np.zeros((len(rest), len(codes)))
        for i, (part, book) in enumerate(zip(self._split(rest), self.codes, strict=True)):
            table = ((part[:, None, :] - book[None]) ** 2).sum(axis=2)
            out += table[:, codes[:, i]]
        return out


def _units(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(vectors in double precision, the same at length 1)."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = _scaled(flat.reshape(len(vectors), -1))
    return x, x / np.sqrt((x * x).sum(axis=1))[:, None]


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two that brings their greatest component near 1: exact, and squares neither vanish nor overflow."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def _placed(classes: DataFrame, books: dict[int, Codebook], probes: int) -> DataFrame:
    """Each class with its cell and the cells that it probes, both among vectors of its length."""
    shared = classes.sparkSession.sparkContext.broadcast(books)
    place = classes.columns.index("embedding")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(place).value_lengths().to_numpy(zero_copy_only=False)
            for dims in np.unique(sizes):
                at = np.flatnonzero(sizes == dims)
                book = shared.value.get(int(dims)) or Codebook.plain(int(dims))
                step = max(1, 4_000_000 // (int(dims) * probes))
                for part in range(0, len(at), step):
                    rows = batch.take(pa.array(at[part : part + step]))
                    near = book.near(_units(rows.column(place))[1], probes).astype(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [*rows.columns, pa.array(near[:, 0]), pa.array(list(near), pa.list_(pa.int64()))],
                        [*rows.schema.names, "cell", "probes"],
                    )

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema)
    return classes.mapInArrow(run, f"{fields}, cell long, probes array<long>")


def _roots(nodes: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node reachable from each node of a block."""
    root = np.arange(nodes)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _searched(blocks: DataFrame, books: dict[int, Codebook], least: float) -> DataFrame:
    """(id, links, root) of every class in every block: what links with it, with copies, and a tree of the block's links."""
    shared = blocks.sparkSession.sparkContext.broadcast(books)
    reach = np.sqrt(2 - 2 * least) + 1e-6
    kind = blocks.schema["id"].dataType.simpleString()

    def run(block: pd.DataFrame) -> pd.DataFrame:
        x = _scaled(np.stack(block["embedding"].to_numpy()).astype(np.float64))
        book = shared.value.get(x.shape[1]) or Codebook.plain(x.shape[1])
        size = np.sqrt((x * x).sum(axis=1))
        rest = x / size[:, None] - book.centre(int(block["block_cell"].iloc[0]))
        ids, copies = block["id"].to_numpy(), block["copies"].to_numpy()
        ask, give = (np.flatnonzero(block["query"] == flag) for flag in (True, False))
        codes, error = book.encode(rest[give])
        left, right = [], []
        for part in range(0, len(ask), 128):
            q = ask[part : part + 128]
            i, j = np.nonzero(np.sqrt(book.distances(rest[q], codes)) <= reach + error)
            i, j = q[i], give[j]
            for cut in range(0, len(i), 200_000):
                a, b = i[cut : cut + 200_000], j[cut : cut + 200_000]
                near = ((x[a] * x[b]).sum(axis=1) / (size[a] * size[b]) >= least) & (ids[a] != ids[b])
                left.append(a[near]), right.append(b[near])
        a, b = np.concatenate([give[:0], *left]), np.concatenate([give[:0], *right])
        names, place = np.unique(ids, return_inverse=True)
        links = np.bincount(place[a], copies[b], len(names)).astype(np.int64)
        root = _roots(len(names), place[a], place[b])
        some = (links > 0) | (root != np.arange(len(names)))
        return pd.DataFrame({"id": names[some], "links": links[some], "root": names[root[some]]})

    return blocks.groupBy("dims", "label", "block_cell", "q", "t").applyInPandas(run, f"id {kind}, links long, root {kind}")


def _sized(rows: DataFrame, name: str, per: int) -> DataFrame:
    sizes = rows.groupBy(*KEYS).agg(F.ceil(F.count(F.lit(1)) / per).alias(name))
    return sizes.withColumn("check", F.hash(*KEYS))


def near_dedup(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    least: float = 0.93,
    probes: int = 16,
    max_training: int = 20_000,
) -> DataFrame:
    """One row per row of ``vectors``: id_col, n_links, component_id, kept.

    Vectors link when their labels are equal and not null, their lengths are equal and their
    cosine, in double precision, is ``least`` or more. Vectors that are null, empty or zero or
    hold null or non-finite components link with nothing, nor do rows without an id. Rows that
    repeat an id are one node of the components and count as links of each other if their
    vectors link. Equal vectors of a label are searched once. Other columns are ignored, so
    none can clash; an empty table gives an empty one.

    The codebooks, one a vector length, learn from ``max_training`` vectors at most, chosen by
    a hash of their ids; every vector is indexed. Lengths too rare to be among these have one
    cell without codes, that is, exact search. Cells grow with the root of a length's vectors.
    ``probes`` is the number of cells that a query searches.
    """
    kind = vectors.schema[vector_col].dataType
    kind = kind if kind.simpleString() in ("array<float>", "array<double>") else "array<double>"
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast(kind).alias("embedding"), F.col(label_col).alias("label"))
    fine = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0)
    rows = rows.withColumn("fine", F.coalesce(fine & F.col("label").isNotNull() & F.col("id").isNotNull(), F.lit(False)))
    classes = rows.filter("fine").groupBy("label", "embedding").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"))
    classes = stage(classes.select("id", "copies", "label", F.size("embedding").alias("dims"), "embedding"), "vector-classes")
    sample = classes.select("id", "dims", "embedding").orderBy(F.xxhash64("id", "embedding")).limit(max_training).toArrow()
    if len(sample):
        counts = dict(classes.groupBy("dims").count().orderBy(F.desc("count"), "dims").limit(max_training).collect())
        books = {}
        for dims in sample["dims"].unique().to_pylist():
            _, units = _units(sample.filter(pc.equal(sample["dims"], dims))["embedding"].combine_chunks())
            books[dims] = Codebook.fit(units, max(1, int(np.sqrt(counts.get(dims, 1)))))
        placed = stage(_placed(classes, books, probes), "vector-cells")
        targets = placed.withColumnRenamed("cell", "block_cell").drop("probes")
        queries = placed.withColumn("block_cell", F.explode("probes")).drop("probes", "cell")
        sizes = _sized(targets, "t_parts", TARGETS).join(_sized(queries, "q_parts", QUERIES).drop("check"), list(KEYS))
        keys, check = [*KEYS, "check"], F.hash(*KEYS).alias("check")
        every = lambda parts: F.explode(F.sequence(F.lit(0).cast("long"), F.col(parts) - 1))
        mine = lambda parts: F.pmod(F.xxhash64("id", "embedding"), F.col(parts))
        queries = queries.select("*", check).join(sizes, keys).withColumn("q", mine("q_parts")).withColumn("t", every("t_parts"))
        targets = targets.select("*", check).join(sizes, keys).withColumn("t", mine("t_parts")).withColumn("q", every("q_parts"))
        columns = [*KEYS, "q", "t", "id", "copies", "embedding"]
        blocks = queries.select(*columns, F.lit(True).alias("query")).union(targets.select(*columns, F.lit(False).alias("query")))
        found = stage(_searched(blocks, books, least), "vector-links")
        discard(placed)
    else:
        kind = rows.schema["id"].dataType.simpleString()
        found = rows.sparkSession.createDataFrame([], f"id {kind}, links long, root {kind}")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    # An id of several vectors joins their classes, also where it is not searched itself.
    vectors_of = rows.filter("fine").select("id", "label", "embedding")
    several = vectors_of.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id")
    vectors_of = vectors_of.join(several, "id", "left_semi").distinct()
    firsts = classes.select("label", "embedding", F.col("id").alias("first"))
    bridges = vectors_of.join(firsts, ["label", "embedding"]).select("id", F.col("first").alias("root"))
    linked = found.filter("id != root").select("id", "root").union(bridges)
    parts = connected_components(linked, "id", "root").select(F.col("node").alias("id"), "component")
    results = classes.select("label", "embedding", "copies", "id").join(links, "id", "left").join(parts, "id", "left")
    results = results.select(
        F.hash("label", "embedding").alias("check"), F.col("label").alias("_label"), F.col("embedding").alias("_embedding"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "id").alias("component"),
    )
    own = rows.withColumn("check", F.when(F.col("fine"), F.hash("label", "embedding")))
    same = (own["check"] == results["check"]) & (F.col("label") == F.col("_label")) & (F.col("embedding") == F.col("_embedding"))
    out = own.join(results, same, "left").withColumn("component", F.coalesce("component", "id"))
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.col("component").alias("component_id"),
        F.col("id").eqNullSafe(F.col("component")).alias("kept"),
    )
