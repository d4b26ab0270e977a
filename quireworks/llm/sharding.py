"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

Equal texts form a group, which is placed whole. Large groups (by their share of all bytes or rows, so their number
is bounded) are placed first, largest first, each where the dot product of its vector with the residual capacity is
highest. All other groups are dealt to lots by a hash. A lot has its part of what the large groups leave of each
shard, and packs its groups into that in the same way; so tasks pack side by side, a lot is of bounded size, and
every group is placed by its own vector. The law that holds is `bytes`: sizes of shards are near equal. A group stays
whole unless that law forbids it: groups larger than a shard are sliced by a hash of their rows, and only if shards
must differ by more than TOLERANCE otherwise, groups of half a shard, a quarter and so on are sliced too.

Tokens are the words between white space, or what the caller names (as counts of a tokenizer, from
`tokens.token_counts`).

Defined cases: a null text has size 1; repeated rows are rows of their own, with slots of their own; an
empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quireworks.llm.common import durable

#: The inverse share of a shard above which a group is placed by itself, by how much of a shard sizes may differ before whole groups are sliced, groups of a lot and rows that are ranked together, about.
SLICES_PER_SHARD, TOLERANCE, LOT_GROUPS, RANKED_ROWS = 64, 0.005, 20_000, 100_000
#: Weights of bytes, tokens and rows in the dot product; bytes lead, as their balance is the law.
WEIGHTS = (4.0, 1.0, 1.0)


def place(vectors: np.ndarray, shards: int, weights: tuple[float, ...] = WEIGHTS, capacity: np.ndarray | None = None) -> np.ndarray:
    """The shard of each unit. Largest units first (of equal ones the first); a unit goes to the highest dot product with residual capacity among the shards that have room for its bytes, or else to the one with most room. capacity: of each shard in each dimension, equal if none is given."""
    total = np.maximum(vectors.sum(axis=0), 1)
    scaled = vectors / total * shards  # a full shard is 1 in each dimension
    residual = np.ones((shards, vectors.shape[1])) if capacity is None else capacity / np.maximum(capacity.sum(axis=0), 1e-9) * shards
    out = np.zeros(len(vectors), dtype=np.int64)
    w = np.asarray(weights)
    for k in np.lexsort((np.arange(len(vectors)), -scaled[:, 0])):
        fits = residual[:, 0] >= scaled[k, 0]
        score = np.where(fits, residual @ (w * scaled[k]), -np.inf) if fits.any() else residual[:, 0]
        out[k] = s = int(np.argmax(score))
        residual[s] -= scaled[k]
    return out


def room(loads: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """What each shard has left in each dimension when `rest` is spread so that shards become as equal as they can: loads are raised to one level."""
    left = np.zeros_like(loads)
    for d in range(loads.shape[1]):
        order = np.sort(loads[:, d])
        raised = np.arange(1, len(order) + 1) * order - np.cumsum(order)  # what it takes to raise the lowest to this one
        k = int(np.searchsorted(raised, rest[d], side="right"))
        level = (order[:k].sum() + rest[d]) / k
        left[:, d] = np.maximum(level - loads[:, d], 0)
    return left


def slices_of(groups: np.ndarray, rest: np.ndarray, shards: int) -> np.ndarray:
    """How many slices each group (a vector each) gets, as few as the law allows beside the other groups, whose vectors add up to rest."""
    shard_bytes = max(1.0, (groups[:, 0].sum() + rest[0]) / shards)
    parts = 1
    while True:
        slices = np.maximum(1, np.minimum(np.ceil(groups[:, 0] * parts / shard_bytes), groups[:, 2])).astype(np.int64)
        loads = _loads(np.repeat(groups / slices[:, None], slices, axis=0), shards)
        loads += room(loads, rest)
        if parts >= SLICES_PER_SHARD or loads[:, 0].max() - loads[:, 0].min() <= TOLERANCE * shard_bytes:
            return slices
        parts *= 2


def _loads(units: np.ndarray, shards: int) -> np.ndarray:
    at = place(units, shards)
    return np.stack([np.bincount(at, units[:, d], shards) for d in range(units.shape[1])], axis=1)


def pack_lots(groups: DataFrame, left: np.ndarray) -> DataFrame:
    """text_hash, shard of groups(lot, text_hash, bytes, tokens, n): each lot packs its groups into its part of the room that is left."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("text_hash")
        vectors = np.stack([table.column(c).to_numpy().astype(np.float64) for c in ("bytes", "tokens", "n")], axis=1)
        return pa.table({"text_hash": table.column("text_hash"), "home": pa.array(place(vectors, len(left), capacity=left), pa.int32())})

    return groups.groupBy("lot").applyInArrow(run, "text_hash long, home int")


def shard(docs: DataFrame, shards: int = 16, tokens: Column | None = None) -> DataFrame:
    """doc_id, size, n_tokens, text_crc32, shard, slot of every row of docs(doc_id, text).

    The text is read once; all later steps move a few numbers a row. What is collected is bounded by
    parameters: at most 2 * shards * SLICES_PER_SHARD large groups.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.size(F.split(F.trim(text), "[ \\t-\\r]+"))
    rows = durable(
        docs.select(
            "doc_id",
            (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
            F.coalesce(words if tokens is None else tokens, F.lit(0)).cast("long").alias("n_tokens"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("text_hash"),
        ).withColumn("row_hash", F.xxhash64("doc_id", "text_hash")),
        "shard-rows",
    )
    vector = [F.sum("size").alias("bytes"), F.sum("n_tokens").alias("tokens"), F.count("*").alias("n")]
    grouped = durable(rows.groupBy("text_hash").agg(*vector), "shard-groups")
    n_groups, *total = grouped.agg(F.count("*"), F.sum("bytes"), F.sum("tokens"), F.sum("n")).first()
    total = np.array([x or 0 for x in total], dtype=np.float64)
    parts = shards * SLICES_PER_SHARD
    is_large = (F.col("n") > 1) & ((F.col("bytes") > total[0] / parts) | (F.col("n") > max(1.0, total[2] / parts)))
    large = grouped.where(is_large).orderBy("text_hash").collect()  # their bytes, or their rows, add up to the total at most
    vectors = np.array([[r.bytes, r.tokens, r.n] for r in large], dtype=np.float64).reshape(-1, 3)
    rest = total - vectors.sum(axis=0)
    slices = slices_of(vectors, rest, shards)
    cut = spark.createDataFrame([(r.text_hash, int(n)) for r, n in zip(large, slices)], "text_hash long, slices int")
    marked = durable(rows.join(F.broadcast(cut), "text_hash", "left").withColumn("slice", F.pmod("row_hash", "slices").cast("int")), "shard-marked")
    units = marked.where("slices is not null").groupBy("text_hash", "slice").agg(*vector).orderBy("text_hash", "slice").collect()  # as many as slices, which the law bounds
    vectors = np.array([[r.bytes, r.tokens, r.n] for r in units], dtype=np.float64).reshape(-1, 3)
    homes, left = place(vectors, shards), room(_loads(vectors, shards), rest)
    hot = spark.createDataFrame([(r.text_hash, r.slice, int(h)) for r, h in zip(units, homes)], "text_hash long, slice int, shard int")
    lots = grouped.where(~is_large).withColumn("lot", F.pmod(F.xxhash64("text_hash"), F.lit(max(1, n_groups // LOT_GROUPS))))
    packed = durable(pack_lots(lots, left), "shard-homes")
    by_group = marked.where("slices is null").join(packed, "text_hash").withColumn("shard", F.col("home"))
    by_slice = marked.where("slices is not null").join(F.broadcast(hot), ["text_hash", "slice"])
    kept = ["doc_id", "size", "n_tokens", "text_crc32", "row_hash", "shard"]
    salts = max(1, int(total[2] // (shards * RANKED_ROWS)))
    placed = durable(by_group.select(*kept).unionByName(by_slice.select(*kept)).withColumn("salt", F.pmod(F.xxhash64("row_hash", "doc_id"), F.lit(salts)).cast("int")), "shard-placed")
    sums = placed.groupBy("shard", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("shard", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("shard", "salt").orderBy("doc_id", "text_crc32", "row_hash")
    ranked = placed.withColumn("rank", F.row_number().over(within)).join(bases, ["shard", "salt"])
    return ranked.select("doc_id", "size", "n_tokens", "text_crc32", "shard", (F.col("base") + F.col("rank") - 1).alias("slot"))
