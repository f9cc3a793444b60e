"""Nearest neighbours over dense vectors: exact, by cells around centres and the angles that bound a cosine.

Every row of the index lies in the cell of its nearest centre and keeps its
angle to it; rows of a cell are packed in blocks by that angle. The angle
between a query and a row is at least the difference of their angles to the
same centre. So once a query has k rows of some block, blocks whose angles
differ by more than the angle of its k-th best row hold nothing for it and
are never read. What is left is scored by matrix products, block by block.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from mdmill.session import save

#: Rows of a block; queries that are scored against a block at a time.
BLOCK_ROWS, SLICE_ROWS = 1024, 2048
#: Rows, drawn by a hash of the key, that the centres are fitted on; all rows are indexed.
SAMPLE_ROWS, FEWEST_CELLS, MOST_CELLS, ROUNDS = 8192, 4, 1024, 4
#: Cells and blocks that a query reads first, for a bound.
FIRST_CELLS, FIRST_BLOCKS = 2, 3
#: Scores have so many decimals; angles are compared with this slack.
DECIMALS, SLACK = 6, 2e-6


class Cells(NamedTuple):
    """blocks (block, cell, lo, hi, keys, matrix), the centres, and the least and greatest angle in each cell."""

    blocks: DataFrame
    centres: np.ndarray
    lo: np.ndarray
    hi: np.ndarray


def _units(batch: pa.RecordBatch, first: int, dimension: int) -> np.ndarray:
    """Unit vectors of a batch whose columns from `first` on are an array of numbers, or arrays idx and w of a sparse one.

    Null vectors and vectors of another length are zero vectors.
    """
    out = np.zeros((batch.num_rows, dimension))
    columns = [c.to_pylist() for c in batch.columns[first:]]
    if len(columns) == 2:
        for i, (idx, w) in enumerate(zip(*columns)):
            if idx:
                out[i, idx] = w
    else:
        for i, vector in enumerate(columns[0]):
            if vector is not None and len(vector) == dimension:
                out[i] = vector
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norms, out=np.zeros_like(out), where=norms > 0)


def _angles(units: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(units @ centres.T, -1.0, 1.0))


def _fitted(units: np.ndarray, cells: int) -> np.ndarray:
    """Centres by spherical k-means; the first ones are rows evenly spread over the sample."""
    centres = units[np.unique(np.linspace(0, len(units) - 1, cells).astype(int))]
    for _ in range(ROUNDS):
        of = (units @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, of, units)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), centres)
    return centres


def build_cells(rows: DataFrame, dimension: int) -> Cells | None:
    """The index of rows (key, vector) or (key, idx, w), stored; None for an empty table.

    Rows are dealt to blocks by a range of (cell, angle, key), so a crowded
    cell spreads over tasks. Centres are fitted on about SAMPLE_ROWS rows.
    """
    spark, vector = rows.sparkSession, rows.columns[1:]
    n = rows.count()
    if not n:
        return None
    share = min(1.0, SAMPLE_ROWS / n)
    sample = rows.where(F.pmod(F.xxhash64("key", F.lit(7)), F.lit(1 << 30)) <= int(share * (1 << 30))).select("key", *vector)
    units = _units(sample.toArrow().combine_chunks().to_batches(max_chunksize=1 << 30)[0] if not sample.isEmpty() else rows.limit(1).toArrow().to_batches()[0], 1, dimension)
    centres = _fitted(units, int(np.clip(np.sqrt(n), FEWEST_CELLS, MOST_CELLS)))
    held = spark.sparkContext.broadcast(centres)

    def place(batches):
        for batch in batches:
            units = _units(batch, 1, dimension)
            angles = _angles(units, held.value)
            cell = angles.argmin(1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(cell, pa.int32()), pa.array(angles[np.arange(len(cell)), cell]), pa.array([u.tobytes() for u in units], pa.binary())],
                names=["key", "cell", "angle", "unit"],
            )

    key = rows.schema["key"]
    placed, _ = save(rows.select("key", *vector).mapInArrow(place, StructType([key]).add("cell", "integer").add("angle", "double").add("unit", "binary")), "placed")

    def pack(batches):
        rest: list[pa.Table] = []

        def blocks(final):
            nonlocal rest
            table = pa.concat_tables(rest)
            cell = table.column("cell").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(cell)]
            rest = []
            for a, b in zip(cuts[:-1], cuts[1:]):
                for i in range(a, b, BLOCK_ROWS):
                    part = table.slice(i, min(BLOCK_ROWS, b - i))
                    if b == len(cell) and i + BLOCK_ROWS > b and not final:
                        rest = [part]
                        continue
                    angle = part.column("angle").to_numpy()
                    part = part.take(pc.sort_indices(part, sort_keys=[("key", "ascending")]))
                    ids, unit = part.column("key").combine_chunks(), part.column("unit").to_pylist()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([int(cell[i])], pa.int32()), pa.array([angle.min()]), pa.array([angle.max()]), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([b"".join(unit)], pa.binary())],
                        names=["cell", "lo", "hi", "keys", "matrix"],
                    )

        for batch in batches:
            if batch.num_rows:
                rest.append(pa.Table.from_batches([batch]))
                yield from blocks(False)
        if rest:
            yield from blocks(True)

    ranged = placed.repartitionByRange(max(1, -(-n // (BLOCK_ROWS * 16))), "cell", "angle", "key").sortWithinPartitions("cell", "angle", "key")
    schema = StructType().add("cell", "integer").add("lo", "double").add("hi", "double").add("keys", ArrayType(key.dataType)).add("matrix", "binary")
    packed, _ = save(ranged.mapInArrow(pack, schema).withColumn("block", F.monotonically_increasing_id()), "blocks")
    lo, hi = np.full(len(centres), np.inf), np.full(len(centres), -np.inf)
    for row in packed.groupBy("cell").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect():  # MOST_CELLS rows at most
        lo[row["cell"]], hi[row["cell"]] = row["lo"], row["hi"]
    return Cells(packed, centres, lo, hi)


def _score(pairs: DataFrame, asked: DataFrame, cells: Cells, k: int, dimension: int, not_self: bool) -> DataFrame:
    """(query_id, key, score): of each pair (query_id, block) the k best rows, ties by key."""
    grouped = pairs.join(asked.select("query_id", "slice", "unit"), "query_id").groupBy("block", "slice").agg(F.collect_list(F.struct("query_id", "unit")).alias("asked"))
    met = grouped.join(cells.blocks.select("block", "keys", "matrix"), "block").select("asked", "keys", "matrix")
    query, key = asked.schema["query_id"], cells.blocks.schema["keys"].dataType.elementType

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                entries, keys = batch.column(0)[i].values, batch.column(1)[i].values
                ids, units = entries.field("query_id"), np.frombuffer(b"".join(entries.field("unit").to_pylist()), np.float64).reshape(-1, dimension)
                matrix = np.frombuffer(batch.column(2)[i].as_py(), np.float64).reshape(-1, dimension)
                score = np.round(np.clip(units @ matrix.T, -1.0, 1.0), DECIMALS) + 0.0
                if not_self:
                    at = {v: j for j, v in enumerate(keys.to_pylist())}
                    for r, v in enumerate(ids.to_pylist()):
                        if v in at:
                            score[r, at[v]] = -np.inf
                best = min(k, score.shape[1])
                least = -np.partition(-score, best - 1, axis=1)[:, best - 1 : best]
                over, tied = score > least, score == least
                keep = (over | (tied & (np.cumsum(tied, 1) <= best - over.sum(1, keepdims=True)))) & (score > -np.inf)
                r, c = np.nonzero(keep)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(r)), keys.take(pa.array(c)), pa.array(score[r, c])], names=["query_id", "key", "score"])

    return met.mapInArrow(run, StructType([query]).add("key", key).add("score", "double"))


def search_cells(queries: DataFrame, cells: Cells | None, k: int, dimension: int, not_self: bool = False) -> DataFrame:
    """(query_id, key, score, rank): the k rows of the index with the largest cosine to each query (query_id, vector), ties by key.

    Exact: a first look at the nearest blocks bounds the k-th score, then every
    block that can hold a row within that bound is read. A zero vector has
    cosine 0 with all rows. not_self leaves out the row whose key is the query's id.
    """
    spark = queries.sparkSession
    if cells is None:
        schema = StructType([queries.schema["query_id"]]).add("key", queries.schema["query_id"].dataType).add("score", "double").add("rank", "integer")
        return spark.createDataFrame([], schema)
    held = spark.sparkContext.broadcast((cells.centres, cells.lo, cells.hi))
    query = queries.schema["query_id"]

    def measure(batches):
        for batch in batches:
            units = _units(batch, 1, dimension)
            angles = _angles(units, held.value[0])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([u.tobytes() for u in units], pa.binary()), pa.array(units.any(1)), pa.array([a.tobytes() for a in angles], pa.binary())],
                names=["query_id", "unit", "some", "angles"],
            )

    slices = -(-queries.count() // SLICE_ROWS) or 1
    measured = queries.mapInArrow(measure, StructType([query]).add("unit", "binary").add("some", "boolean").add("angles", "binary"))
    asked, _ = save(measured.withColumn("slice", F.pmod(F.xxhash64("query_id"), F.lit(slices))), "asked")
    some = asked.where("some")

    def reach(batches):
        """(query_id, cell, angle, reach): the first cells, where no bound is known, else all that the bound leaves."""
        _, lo, hi = held.value
        for batch in batches:
            for i in range(batch.num_rows):
                angles, bound = np.frombuffer(batch.column(1)[i].as_py(), np.float64), batch.column(2)[i].as_py()
                if bound is None:
                    at = np.argsort(np.where(np.isinf(lo), np.inf, angles), kind="stable")[:FIRST_CELLS]
                    at, width = at[~np.isinf(lo[at])], np.pi
                else:
                    width = float(np.arccos(np.clip(bound - 10.0**-DECIMALS, -1.0, 1.0))) + SLACK
                    at = np.flatnonzero((lo <= angles + width) & (hi >= angles - width))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, 1).take(pa.array([0] * len(at), pa.int64())), pa.array(at, pa.int32()), pa.array(angles[at]), pa.array(np.full(len(at), width))],
                    names=["query_id", "cell", "angle", "reach"],
                )

    cut = StructType([query]).add("cell", "integer").add("angle", "double").add("reach", "double")
    ranges = cells.blocks.select("cell", "block", "lo", "hi")
    near = some.select("query_id", "angles", F.lit(None).cast("double").alias("bound")).mapInArrow(reach, cut).join(ranges, "cell")
    gap = F.greatest(F.col("lo") - F.col("angle"), F.col("angle") - F.col("hi"), F.lit(0.0))
    first = near.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(gap, "block"))).where(F.col("place") <= FIRST_BLOCKS)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "key")
    seen = _score(first.select("query_id", "block"), some, cells, k, dimension, not_self).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    bounds, _ = save(seen.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(-1.0).alias("bound")), "bounds")
    bounded = some.join(bounds, "query_id", "left").select("query_id", "angles", F.coalesce("bound", F.lit(-1.0)).alias("bound"))
    left = bounded.mapInArrow(reach, cut).join(ranges, "cell").where((F.col("lo") <= F.col("angle") + F.col("reach")) & (F.col("hi") >= F.col("angle") - F.col("reach")))
    pairs, _ = save(left.select("query_id", "block"), "pairs")
    found = _score(pairs, some, cells, k, dimension, not_self)
    # The rows with the smallest keys answer a zero vector; one more, as one may be the query itself.
    least = [F.lit(r["key"]) for r in cells.blocks.select(F.explode("keys").alias("key")).orderBy("key").limit(k + 1).collect()]
    zero = asked.where(~F.col("some")).select("query_id", F.explode(F.array(*least)).alias("key"), F.lit(0.0).alias("score"))
    zero = zero.where(F.col("key") != F.col("query_id")) if not_self else zero
    return found.unionByName(zero).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def nearest(queries: DataFrame, corpus: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, vec_id, score, rank): the k rows of corpus with the largest cosine, ties by id; self excluded.

    queries and corpus have (vec_id, embedding). The corpus's first vector that
    is not null gives the dimension; null vectors and those of another length
    count as zero vectors, whose cosine is 0.
    """
    one = corpus.where("embedding IS NOT NULL").select(F.size("embedding").alias("n")).first()
    dimension = one["n"] if one else 1
    cells = build_cells(corpus.select(F.col("vec_id").alias("key"), "embedding"), dimension)
    found = search_cells(queries.select(F.col("vec_id").alias("query_id"), "embedding"), cells, k, dimension, not_self=True)
    return found.select("query_id", F.col("key").alias("vec_id"), "score", "rank")
