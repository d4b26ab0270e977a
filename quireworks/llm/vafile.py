"""Exact top-k inner products by vector-approximation files.

Vectors become integers floor(256 * x). A block of the approximation file holds a quantised cell for each
component of its vectors, and the cell edges; the exact vectors lie in a table apart. A first pass over the
cells bounds every product from below; the kth best of these bounds is what a query's results reach for
certain. A second pass keeps the vectors whose upper bound reaches that. Those are read exactly in the order of
their bounds, most promising first, in rounds that double: a query stops when its kth exact score is above the
bound of the next vector. Bounds come from each block's own edges.

Equal vectors are one vector with its members, of which the k + 1 smallest ids (and of an id k rows) can be results;
so copies do not fill a block, a round or a rank.

Defined cases: vectors that are null, or hold null or non-finite components, and rows without an id take no
part; components beyond 2**56 and scores beyond 64 bits are held at those limits; vectors of different lengths
are not compared; ties go to the smaller id; repeated rows are candidates, and queries, of their own, and no
row with the query's id is a candidate; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quireworks.llm.common import durable, gives_back, small_batches

#: Vectors of a block, queries of a block, and bits of a cell; vectors that a query reads first, by k.
BLOCK_ROWS, BLOCK_QUERIES, CELL_BITS, FIRST_READ = 4096, 512, 6, 2
#: Vector blocks of a lane and query blocks of a part, so many lanes a core where there are as many blocks, and query blocks whose bounds a task holds.
LANE_BLOCKS, PART_BLOCKS, CORE_LANES, HELD_BLOCKS = 16, 80, 16, 1024
#: Largest size of a component; the square of it times any usual length stays below 10 ** 38.
LARGEST = 2**56


def integer_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, ints array<bigint> of the rows that take part."""
    whole = F.expr("vec_id is not null and embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(double(x)) < double('Infinity'))")
    return vectors.where(whole).select("vec_id", F.expr(f"transform(embedding, x -> bigint(floor(greatest(least(256 * double(x), {LARGEST}D), -{LARGEST}D))))").alias("ints"))


def _batches(batches: Iterable[pa.RecordBatch], columns: list[str], most: int) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Columns of numbers, and matrices of `ints`, of at most so many rows, each of vectors of one length."""
    kept: dict[int, list[tuple]] = {}

    def matrix(rows: list[tuple]) -> tuple[list[np.ndarray], np.ndarray]:
        *numbers, ints = zip(*rows)
        return [np.array(x) for x in numbers], np.array(ints, np.int64).reshape(len(rows), len(ints[0]))

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in [*columns, "ints"])):
            rows = kept.setdefault(len(row[-1]), [])
            rows.append(row)
            if len(rows) == most:
                yield matrix(kept.pop(len(row[-1])))
    for rows in kept.values():
        yield matrix(rows)


def distinct_vectors(rows: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """vectors(row, ints, only: the id of a vector with one id, else null) and members(row, vec_id, copies) of rows(vec_id, ints), as far as a result of k can need them. Limits hold within tasks first, so copies are not gathered."""
    ids = rows.groupBy("ints", "vec_id").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("copies"))
    some = ids.withColumn("n", F.row_number().over(Window.partitionBy("ints").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    # the members of a vector are k + 1 at most by now
    made = some.groupBy("ints").agg(F.collect_list(F.struct("vec_id", "copies")).alias("members")).withColumn("row", F.monotonically_increasing_id())
    made = durable(made, "va-exact")
    only = F.when(F.size("members") == 1, F.get("members", F.lit(0))["vec_id"])
    return made.select("row", "ints", only.alias("only")), made.select("row", F.inline("members"))


def build_index(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The approximation file of vectors(row, only, ints): a row for each block of them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (row, only), exact in _batches(batches, ["row", "only"], block_rows):
            low = exact.min(axis=0, initial=LARGEST)
            step = np.maximum(1, -(-(exact.max(axis=0, initial=-LARGEST) - low + 1) // 2**CELL_BITS))
            cells = ((exact - low) // step).astype(np.uint8)
            many = np.array([x is None for x in only])
            ids = np.array([0 if x is None else x for x in only], np.int64)
            raw = [[x.tobytes()] for x in (row, ids, many, cells, low, step)]
            yield pa.RecordBatch.from_arrays([pa.array([int(row[0])]), pa.array([exact.shape[1]], pa.int32()), *(pa.array(x, pa.binary()) for x in raw)], names)

    names = ["block", "width", "rows", "ids", "many", "cells", "low", "step"]
    return rows.mapInArrow(gives_back(run), "block long, width int, rows binary, ids binary, many binary, cells binary, low binary, step binary")


def query_blocks(rows: DataFrame) -> DataFrame:
    """Blocks of queries(row, vec_id, reach, ints); reach: the score that is certain."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (row, ids, reach), exact in _batches(batches, ["row", "vec_id", "reach"], BLOCK_QUERIES):
            kind = np.int16 if np.abs(exact).max(initial=0) < 1 << 15 else np.int64
            raw = [[x.tobytes()] for x in (row, ids.astype(np.int64), reach.astype(np.float64), exact.astype(kind))]
            yield pa.RecordBatch.from_arrays([pa.array([int(row[0])]), pa.array([exact.shape[1]], pa.int32()), *(pa.array(x, pa.binary()) for x in raw)], ["query_block", "width", "query_rows", "query_ids", "reach", "queries"])

    return rows.select("row", "vec_id", "reach", "ints").mapInArrow(gives_back(run), "query_block long, width int, query_rows binary, query_ids binary, reach binary, queries binary")


def bound(q: np.ndarray, cells: np.ndarray, low: np.ndarray, step: np.ndarray, upper: bool) -> np.ndarray:
    """Least or greatest product of each query with each cell vector, widened by what doubles may round."""
    q, side = q.astype(np.float64), step - 1.0
    floor = cells.astype(np.float64) * step + low
    rounded = np.abs(q) @ np.maximum(np.abs(low), np.abs(low + step.astype(np.float64) * 2**CELL_BITS)) * 1e-12
    out = q @ floor.T
    out += (np.maximum(q, 0) @ side + rounded if upper else np.minimum(q, 0) @ side - rounded)[:, None]
    return out


def _meet(index: DataFrame, queries: DataFrame, lanes: int, parts: int, upper: bool, found, schema: str) -> DataFrame:
    """found(pairs), in each task over its pairs of a query block and a vector block of one length: query rows, vector rows, other members than the query's id?, the upper or the lower bounds, reach.

    A query block is in one part and goes to every lane, a vector block is in one lane and goes to every part. What
    stands for the queries here grows with queries times lanes, whatever their table's size is, so it is not broadcast.
    """
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    laned = index.withColumn("lane", dealt("block", lanes)).withColumn("part", each(parts))
    asked = query_blocks(queries).withColumn("part", dealt("query_block", parts)).withColumn("lane", each(lanes))
    pairs = laned.join(asked.hint("merge"), ["lane", "part", "width"])

    def met(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for x in batch.to_pylist():
                rows, ids, low, step, query_rows, query_ids = (np.frombuffer(x[c], np.int64) for c in ("rows", "ids", "low", "step", "query_rows", "query_ids"))
                kind = np.int16 if len(x["queries"]) < 8 * x["width"] * len(query_rows) else np.int64
                q, cells = np.frombuffer(x["queries"], kind).reshape(len(query_rows), x["width"]), np.frombuffer(x["cells"], np.uint8).reshape(len(rows), x["width"])
                yield query_rows, rows, np.frombuffer(x["many"], bool)[None, :] | (ids[None, :] != query_ids[:, None]), bound(q, cells, low, step, upper), np.frombuffer(x["reach"], np.float64)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return (pa.RecordBatch.from_arrays(*x) for x in found(met(batches)))

    return pairs.drop("block", "query_block", "lane", "part").mapInArrow(gives_back(run), schema)


def top_k(vectors: DataFrame, is_query, k: int = 5, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer products of every row that is_query selects, against all rows.

    A query keeps k bounds of each block in the first pass, and in the second the vectors that may still be
    among its k best.
    """
    small_batches(vectors.sparkSession)
    rows = durable(integer_vectors(vectors).withColumn("row", F.monotonically_increasing_id()), "va-rows")
    kept, members = distinct_vectors(rows, k)
    index = durable(build_index(kept, block_rows), "va-index")
    blocks, queries = index.count(), rows.where(is_query).withColumn("reach", F.lit(float("-inf")))
    lanes = max(1, -(-blocks // LANE_BLOCKS), min(blocks, CORE_LANES * vectors.sparkSession.sparkContext.defaultParallelism))
    near, reaching = candidates(index, queries, lanes, k, max(1, -(-queries.count() // (BLOCK_QUERIES * PART_BLOCKS))))
    kind = _product(rows)
    best, _ = read_in_order(near, reaching, kept, members, k, kind)
    limit = lambda c: F.least(F.greatest(c, F.lit(-(2**63)).cast("decimal(38,0)")), F.lit(2**63 - 1).cast("decimal(38,0)")).cast("long") if "decimal" in kind else c
    return best.select("query_id", "rank", "vec_id", limit(F.col("exact")).alias("score"))


def candidates(index: DataFrame, queries: DataFrame, lanes: int, k: int, parts: int = 1) -> tuple[DataFrame, DataFrame]:
    """near(query_row, row, upper): the vectors that may be among a query's k best; and the queries with the score that is certain."""

    def largest(x: np.ndarray) -> np.ndarray:
        return x if x.shape[1] <= k else np.partition(x, x.shape[1] - k, axis=1)[:, -k:].copy()

    def least(pairs):
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for query_rows, _, other, lower, _ in pairs:
            lower[~other] = -np.inf
            at, best = int(query_rows[0]), largest(lower)
            held[at] = query_rows, largest(np.hstack([held[at][1], best])) if at in held else best
            if len(held) == HELD_BLOCKS:
                yield from told(held)
        yield from told(held)

    def told(held):
        for query_rows, best in held.values():
            keep = best > -np.inf
            yield [pa.array(np.repeat(query_rows, keep.sum(axis=1))), pa.array(best[keep])], ["row", "reach"]
        held.clear()

    kth = Window.partitionBy("row").orderBy(F.desc("reach"))
    certain = _meet(index, queries, lanes, parts, False, least, "row long, reach double").withColumn("n", F.row_number().over(kth)).where(F.col("n") <= k).where(F.col("n") == k).select("row", "reach")
    reaching = durable(queries.drop("reach").join(certain.hint("merge"), "row", "left").withColumn("reach", F.coalesce("reach", F.lit(float("-inf")))), "va-queries")

    def able(pairs):
        for query_rows, rows, other, upper, reach in pairs:
            r, c = np.nonzero(other & (upper >= reach[:, None]))
            yield [pa.array(query_rows[r]), pa.array(rows[c]), pa.array(upper[r, c])], ["query_row", "row", "upper"]

    return durable(_meet(index, reaching, lanes, parts, True, able, "query_row long, row long, upper double"), "va-near"), reaching


def _product(rows: DataFrame) -> str:
    """The type that products of these vectors fit into."""
    most, width = rows.agg(F.max(F.expr("array_max(transform(ints, x -> abs(x)))")), F.max(F.size("ints"))).first()
    return "long" if most is None or most * most * width < 2**62 else "decimal(38,0)"


def read_in_order(near: DataFrame, queries: DataFrame, kept: DataFrame, members: DataFrame, k: int, kind: str) -> tuple[DataFrame, int]:
    """The k best rows (query_id, rank, vec_id, exact) of each query, and how many vectors were read exactly.

    A round reads the next vectors of each query by their bounds from above, twice as many as before. What is left
    whose bound is under the kth exact score cannot be a result and is not read. Nothing is broadcast: vectors
    of small whole numbers take many times the room of their files, which Spark goes by.
    """
    step = "aggregate(zip_with(q, ints, (x, y) -> x * y), 0L, (a, b) -> a + b)"
    if kind != "long":
        step = "aggregate(zip_with(q, ints, (x, y) -> cast(x as decimal(18, 0)) * cast(y as decimal(18, 0))), cast(0 as decimal(38, 0)), (a, b) -> cast(a + b as decimal(38, 0)))"
    asked = queries.select(F.col("row").alias("query_row"), F.col("vec_id").alias("query_id"), F.col("ints").alias("q"))
    by_bound = Window.partitionBy("query_row").orderBy(F.desc("upper"), "row")
    by_score = Window.partitionBy("query_row").orderBy(F.desc("exact"), "vec_id", "copy")
    best, left, size, read = None, near, FIRST_READ * k, 0
    while True:
        now = durable(left.withColumn("n", F.row_number().over(by_bound)).where(F.col("n") <= size).select("query_row", "row"), "va-reads")
        some = now.count()
        if not some:
            break
        read += some
        exact = now.join(asked.hint("merge"), "query_row").join(kept.select("row", "ints").hint("merge"), "row").select("query_row", "query_id", "row", F.expr(step).alias("exact"))
        each = exact.join(members.hint("merge"), "row").where("vec_id <> query_id").select("query_row", "query_id", "vec_id", "exact", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))
        best = durable((each if best is None else each.unionByName(best.drop("rank"))).withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k), "va-best")
        # a double holds a long score up to one part in 2 ** 53: the margin keeps what might tie
        sure = best.where(F.col("rank") == k).select("query_row", F.col("exact").cast("double").alias("sure"))
        margin = F.col("sure") - F.abs("sure") * 1e-12
        left = left.join(now.hint("merge"), ["query_row", "row"], "left_anti").join(sure.hint("merge"), "query_row", "left").where(F.col("sure").isNull() | (F.col("upper") >= margin)).drop("sure")
        left, size = durable(left, "va-near"), size * 2
    return (best if best is not None else queries.sparkSession.createDataFrame([], f"query_row long, query_id {queries.schema['vec_id'].dataType.simpleString()}, vec_id long, exact {kind}, copy int, rank int")), read
