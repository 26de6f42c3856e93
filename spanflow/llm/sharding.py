"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

The ring is cut into a fixed number of arcs.  Every row falls on an arc by the
hash of its key; Spark sums rows and bytes per arc, so what decides the
placement has a bounded size whatever the input.  An arc belongs to the next
virtual node clockwise; where that shard would exceed its capacity, the arc's
rows continue clockwise to the next shard with room.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ARC_BITS = 16
VIRTUAL_NODES = 256
#: A shard holds at most this many times the mean load.
CAPACITY = 1.01


def ring(shards: int, virtual_nodes: int = VIRTUAL_NODES, seed: int = 0) -> list[tuple[int, int]]:
    """(position, shard) of all virtual nodes in clockwise order; a shard's nodes never depend on the others."""
    def at(shard: int, node: int) -> int:
        return int.from_bytes(hashlib.blake2b(f"{seed}/{shard}/{node}".encode(), digest_size=8).digest(), "big")

    return sorted((at(s, v), s) for s in range(shards) for v in range(virtual_nodes))


def place(loads: dict[int, int], shards: int, capacity: float = CAPACITY, arc_bits: int = ARC_BITS,
          virtual_nodes: int = VIRTUAL_NODES, seed: int = 0) -> dict[int, int]:
    """Shard of every arc, given the arcs' loads.

    Heavier arcs are placed first, equal ones in ring order, so small arcs fill
    what large ones leave.  An arc that fits nowhere (a single row larger than
    any room left) goes to the least loaded shard.
    """
    nodes = ring(shards, virtual_nodes, seed)
    at = [p for p, _ in nodes]
    limit = capacity * sum(loads.values()) / shards
    load, out = [0] * shards, {}
    for arc in sorted(loads, key=lambda a: (-loads[a], a)):
        i = bisect_left(at, arc << (64 - arc_bits))
        tried: set[int] = set()
        while len(tried) < shards:
            shard = nodes[i % len(nodes)][1]
            if shard not in tried and load[shard] + loads[arc] <= limit:
                break
            tried.add(shard)
            i += 1
        else:
            shard = min(range(shards), key=lambda s: (load[s], s))
        load[shard] += loads[arc]
        out[arc] = shard
    return out


def shard(df: DataFrame, key: list[Column], size: Column, order: list[Column], shards: int,
          capacity: float = CAPACITY, arc_bits: int = ARC_BITS, seed: int = 0) -> DataFrame:
    """Add ``shard`` and ``slot`` (gapless from 0 in each shard, by arc and then ``order``) to every row.

    ``size`` is the load of a row.  Rows with equal keys share an arc, nulls in
    the key are values like any other, and an empty input gives an empty result.
    Columns of ``df`` named shard or slot are replaced; any other name is kept,
    whatever it is.  Only one row per arc, at most ``2**arc_bits``, reaches the
    driver and is broadcast again.
    """
    spark = df.sparkSession
    kept = [c for c in df.columns if c not in ("shard", "slot")]
    arc = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *key), 64 - arc_bits)
    rows = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)], arc.alias("arc"), size.alias("size"),
                     *[c.alias(f"o{i}") for i, c in enumerate(order)])
    sums = {r[0]: (r[1], r[2]) for r in
            rows.groupBy("arc").agg(F.sum("size").cast("long"), F.count("*")).collect()}
    where = place({a: s for a, (s, _) in sums.items()}, shards, capacity, arc_bits, seed=seed)
    base, table = [0] * shards, []
    for a in sorted(sums):
        table.append((a, where[a], base[where[a]]))
        base[where[a]] += sums[a][1]
    arcs = spark.createDataFrame(table, "arc long, shard int, base long")
    number = F.row_number().over(Window.partitionBy("arc").orderBy(*[f"o{i}" for i in range(len(order))]))
    return rows.withColumn("n", number).join(F.broadcast(arcs), "arc").select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(kept)], "shard", (F.col("base") + F.col("n") - 1).alias("slot"))
