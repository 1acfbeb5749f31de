"""Context packets: what stands around search hits, by tiers, within a budget of tokens."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.paths import is_test_path
from ..functions.questions import identifiers
from ..functions.text import ancestors

# Relations that import, what a hit may keep in each tier, the order of tiers, the least budget for source text.
IMPORTS = ("imports", "imports_from", "depends_on", "includes", "extends", "requires")
CAPS = {"caller": 8, "test": 4, "defines": 8, "callee": 8, "import": 3, "container": 2, "ancestor": 16}
TIERS = ("caller", "test", "defines", "callee", "import", "container", "ancestor")
SUMMARY_BUDGET = 3000


def tier(relation: Column, direction: Column, path: Column, test: Column) -> Column:
    """Where an edge puts a neighbour."""
    incoming, imports = direction == "in", relation.isin(*IMPORTS)
    return (
        F.when(relation == "contains", F.when(incoming, "container").otherwise("defines"))
        .when(is_test_path(path, test), "test")
        .when(incoming, "caller")
        .otherwise(F.when(imports, "import").otherwise("callee"))
    )


def cap(tier_: Column, seed: Column, importer: Column) -> Column:
    """What the hit at rank ``seed`` (from 0) may keep in a tier; bulk tiers and importers decay with the rank."""
    most = F.element_at(F.create_map(*(F.lit(x) for pair in CAPS.items() for x in pair)), tier_)
    left = F.when(importer, CAPS["import"] - seed).when(tier_ == "defines", most - 2 * seed).when(tier_ == "import", most - seed).otherwise(most)
    return F.greatest(left, F.lit(0))


def capped(neighbours: DataFrame) -> DataFrame:
    """Neighbours with tier and place, those beyond their tier's cap gone.

    ``neighbours`` has packet, seed (the hit's rank), project, id, relation, direction, file_path, test.
    """
    rows = neighbours.withColumn("tier", tier(F.col("relation"), F.col("direction"), F.col("file_path"), F.col("test")))
    rows = rows.withColumn("importer", (F.col("direction") == "in") & F.col("relation").isin(*IMPORTS) & (F.col("tier") == "caller"))
    place = F.row_number().over(Window.partitionBy("packet", "seed", "tier", "importer").orderBy("relation", "id"))
    rows = rows.withColumn("place", place.cast("long"))
    return rows.filter(F.col("place") <= cap(F.col("tier"), F.col("seed"), F.col("importer")))


def detail(question: Column, budget: Column, wanted: Column) -> Column:
    """auto becomes source where the question names code and the budget has room, else summary."""
    named = F.exists(identifiers(question), lambda x: x["shaped"]) | question.rlike(r"[\w-]+/[\w.-]+|\w\(\)")
    return F.when(wanted != "auto", wanted).when(budget < SUMMARY_BUDGET, "summary").when(named, "source").otherwise("summary")


def ladder(hits: DataFrame, depth: int = 16) -> DataFrame:
    """(packet, seed, id, place): the folders above each hit, nearest first."""
    above = F.slice(ancestors(F.col("id")), 1, depth)
    rows = hits.select("packet", "seed", F.posexplode(above).alias("place", "id"))
    return rows.select("packet", "seed", "id", (F.col("place") + 1).alias("place"))


def attached(hits: DataFrame, ties: DataFrame) -> DataFrame:
    """(id, record, above): records tied to a hit or to a folder above it; of several ties of one record the nearest counts."""
    own = hits.select("id", F.posexplode(F.concat(F.array("id"), ancestors(F.col("id")))).alias("above", "node"))
    found = own.join(ties.select(F.col("id").alias("node"), "record"), "node")
    return found.groupBy("id", "record").agg(F.min("above").alias("above"))


def assembled(candidates: DataFrame, budget: int, chunks: bool = True) -> DataFrame:
    """The entries of each packet within its budget, in the order in which they are taken.

    ``candidates`` has packet, tier ("seed" for hits), place, seed, project, id, file_path,
    start_line, end_line, cost, and chunk_cost (null: no chunk). Hits come first, with their chunk
    if it fits, else bare. Then the tiers in order, without what overlaps kept lines of the same
    file. Last, chunks are added to what the tiers brought, until one does not fit. Returns
    packet, turn, id, tier, chunk, cut (whether the packet left something out).

    Each entry depends on all before, so a packet is one task's, which reads its rows sorted and
    keeps only the entries taken: no more than the budget has tokens.
    """
    order = F.element_at(F.create_map(F.lit("seed"), F.lit(0), *(F.lit(x) for i, t in enumerate(TIERS, 1) for x in (t, i))), F.col("tier"))
    rows = candidates.select("packet", order.alias("phase"), "place", "seed", "id", "project", "file_path", "start_line", "end_line", "tier", "cost", "chunk_cost")
    rows = rows.repartition("packet").sortWithinPartitions("packet", "phase", "place", "seed", "id")
    out = T.StructType([rows.schema["packet"], T.StructField("turn", T.LongType()), rows.schema["id"], T.StructField("tier", T.StringType()), T.StructField("chunk", T.BooleanType()), T.StructField("cut", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        kinds = None
        for batch in batches:
            kinds = batch.schema.field("packet").type, batch.schema.field("id").type
            done = []
            for row in batch.to_pylist():
                if held is None or row["packet"] != last:
                    if held is not None:
                        done += held.closed()
                    last, held = row["packet"], _Packet(row["packet"], budget, chunks)
                held.offer(row)
            yield _rows(done, kinds)
        if held is not None:
            yield _rows(held.closed(), kinds)

    return rows.mapInArrow(run, out)


def _rows(found: list[tuple], kinds: tuple[pa.DataType, pa.DataType]) -> pa.RecordBatch:
    types = [kinds[0], pa.int64(), kinds[1], pa.string(), pa.bool_(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], t) for i, t in enumerate(types)], ["packet", "turn", "id", "tier", "chunk", "cut"])


class _Packet:
    """What one packet has taken so far."""

    def __init__(self, name: object, budget: int, chunks: bool):
        self.name, self.left, self.chunks = name, budget, chunks
        self.entries: list[list] = []  # id, tier, with chunk
        self.lines: dict[tuple, list[tuple[int, int]]] = {}
        self.later: list[tuple[int, int]] = []  # entry, price of its chunk
        self.cut = False

    def offer(self, row: dict) -> None:
        price = row["cost"]
        if row["tier"] == "seed":
            both = price + row["chunk_cost"] if self.chunks and row["chunk_cost"] is not None else None
            if both is not None and both <= self.left:
                return self._take(row, both, True)
            self.cut |= both is not None or price > self.left
            if price <= self.left:
                self._take(row, price, False)
        elif not self._covered(row):
            if price > self.left:
                self.cut = True
                return None
            self._take(row, price, False)
            if self.chunks and row["chunk_cost"] is not None:
                self.later.append((len(self.entries) - 1, row["chunk_cost"]))
        return None

    def _take(self, row: dict, price: int, chunk: bool) -> None:
        self.left -= price
        self.entries.append([row["id"], row["tier"], chunk])
        if row["file_path"] is not None and row["start_line"] is not None and row["end_line"] is not None:
            self.lines.setdefault((row["project"], row["file_path"]), []).append((row["start_line"], row["end_line"]))

    def _covered(self, row: dict) -> bool:
        a, b = row["start_line"], row["end_line"]
        if row["file_path"] is None or a is None or b is None:
            return False
        return any(x <= b and a <= y for x, y in self.lines.get((row["project"], row["file_path"]), ()))

    def closed(self) -> list[tuple]:
        for entry, price in self.later:
            if price > self.left:
                self.cut = True
                break
            self.left -= price
            self.entries[entry][2] = True
        return [(self.name, n, *e, self.cut) for n, e in enumerate(self.entries, 1)]
