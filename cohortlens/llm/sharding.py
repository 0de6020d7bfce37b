"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

The ring has ``segments`` equal slices. Each shard owns ``vnodes`` points on
it; a key belongs to the first point at or after its slice. Keys are taken in
ring order; one whose shard is full continues clockwise to the next point of a
shard with room. With ``slack`` 0 the row counts of two shards differ by one at
most; with more slack fewer keys leave their first shard.

How it runs: one aggregate counts the rows of each slice (a bounded number of
rows, whatever the input), the ring is filled from those counts alone, and one
window numbers the rows inside a slice. A row's place in its slice then says
which shard it went to. No step holds more than one slice of the keys.
"""

from __future__ import annotations

import json
import zlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ring_points(n_shards: int, vnodes: int, segments: int) -> list[int]:
    """Owner of each slice: the shard of the first point at or after it."""
    if n_shards < 1 or n_shards * vnodes > segments:
        raise ValueError("the ring needs a slice for each virtual node")
    owner: dict[int, int] = {}
    for shard in range(n_shards):
        for v in range(vnodes):
            at = zlib.crc32(f"shard {shard} point {v}".encode()) % segments
            while at in owner:
                at = (at + 1) % segments
            owner[at] = shard
    out, current = [0] * segments, owner[min(owner)]
    for at in range(segments - 1, -1, -1):
        current = owner.get(at, current)
        out[at] = current
    return out


def capacities(total: int, n_shards: int, slack: float = 0.0) -> list[int]:
    """Rows each shard may hold; they add up to ``total`` at least."""
    if slack > 0:
        return [-(-int(total * (1 + slack)) // n_shards) + 1] * n_shards
    return [total // n_shards + (shard < total % n_shards) for shard in range(n_shards)]


def fill_ring(counts: dict[int, int], owners: list[int], caps: list[int]) -> list[dict]:
    """Where the rows of each slice go: runs ``lo <= place < hi`` with their
    shard and the slot of the run's first row."""
    segments, load, out = len(owners), [0] * len(caps), []
    for s in sorted(counts):
        left, at, place = counts[s], s, 0
        while left:
            shard = owners[at]
            take = min(left, caps[shard] - load[shard])
            if take:
                out.append({"_run_g": s, "_run_lo": place, "_run_hi": place + take, "shard": shard, "_run_base": load[shard]})
                load[shard] += take
                place += take
                left -= take
            at = (at + 1) % segments
    return out


def ring_position(key: Column) -> Column:
    return F.xxhash64(key.cast("string"))


def assign_shards(df: DataFrame, key: str, n_shards: int, vnodes: int = 64, segments: int = 4096,
                  slack: float = 0.0, tiebreak: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``shard`` int and ``slot`` long (0, 1, 2 .. in each shard).

    ``segments`` is a power of two and bounds what reaches the driver. Equal
    keys lie side by side, ordered by ``tiebreak``; a null key is a key like
    any other; an empty table gives an empty one. Columns of ``df`` named like
    the two new ones are replaced.
    """
    bits = segments.bit_length() - 1
    if segments != 1 << bits:
        raise ValueError("segments must be a power of two")
    pos = ring_position(F.col(f"`{key}`"))
    slice_of = F.shiftrightunsigned(pos, 64 - bits).cast("int")
    counts = {r["g"]: r["n"] for r in df.groupBy(slice_of.alias("g")).agg(F.count(F.lit(1)).alias("n")).collect()}
    owners = ring_points(n_shards, vnodes, segments)
    runs = fill_ring(counts, owners, capacities(sum(counts.values()), n_shards, slack))
    keep = [c for c in df.columns if c not in ("shard", "slot")]
    in_slice = Window.partitionBy("_ring_g").orderBy("_ring_p", F.col(f"`{key}`"), *tiebreak)
    placed = (df.select(*[f"`{c}`" for c in keep], pos.alias("_ring_p"), slice_of.alias("_ring_g"))
              .withColumn("_ring_i", F.row_number().over(in_slice) - 1))
    schema = "array<struct<_run_g int, _run_lo long, _run_hi long, shard int, _run_base long>>"
    plan = df.sparkSession.range(1).select(F.inline(F.from_json(F.lit(json.dumps(runs)), schema)))
    # the plan has one or two rows a slice, however large the table is
    return (placed.join(F.broadcast(plan), (F.col("_ring_g") == F.col("_run_g")) & (F.col("_ring_i") >= F.col("_run_lo"))
                        & (F.col("_ring_i") < F.col("_run_hi")))
            .select(*[f"`{c}`" for c in keep], "shard", (F.col("_run_base") + F.col("_ring_i") - F.col("_run_lo")).alias("slot")))
