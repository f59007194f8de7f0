"""Sharding on a consistent-hash ring with virtual nodes and bounded loads, in DataFrame functions alone.

A key's place on the ring is a hash of its doc_id.  The ring is cut into 8,192 cells and every shard owns 64 virtual
nodes, each at the end of a cell; a key belongs to the first virtual node clockwise.  A shard takes at most its
capacity, n // shards rows (the first n % shards one more), so counts differ by one at most.  Within a shard, keys are
accepted in ring order; the rest continue clockwise, in ring order, to the next shard with room.

Only counts per cell (8,192 rows at any input size) meet on the driver.  Rows get their rank inside their cell from a
window over that cell, 1/8,192 of the keys however sources or texts are distributed.

Nulls: a null text has size 1 and the crc32 of no bytes; a null doc_id is a key like any other.  Repeated rows each
get a slot of their own.  An empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CELLS = 8192


def ring(shards: int, virtual_nodes: int, cells: int = CELLS) -> list[int]:
    """The owner of each cell: the shard of the first virtual node at or after it."""
    owner: dict[int, int] = {}
    for shard in range(shards):
        for v in range(virtual_nodes):
            at = int.from_bytes(hashlib.sha256(f"{shard}/{v}".encode()).digest()[:4], "big") % cells
            owner.setdefault(at, shard)
    if not owner:
        raise ValueError("a ring needs shards and virtual nodes")
    out, now = [0] * cells, owner[min(owner)]
    for cell in range(cells - 1, -1, -1):
        now = owner.get(cell, now)
        out[cell] = now
    return out


def deal(counts: dict[int, int], owners: list[int], shards: int) -> list[dict]:
    """For each cell the pieces [from_rank, shard, first slot] that its keys, in rank order, are dealt to."""
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used, pieces, over = [0] * shards, {}, []
    for cell in sorted(counts):
        s = owners[cell]
        n = min(counts[cell], room[s])
        if n:
            pieces[cell] = [(0, s, used[s])]
            used[s] += n
            room[s] -= n
        if n < counts[cell]:
            over.append((cell, n))
    clockwise: dict[int, list[int]] = {}
    for cell, placed in over:
        if cell not in clockwise:
            clockwise[cell] = list(dict.fromkeys(owners[cell:] + owners[:cell])) + list(range(shards))
        for s in clockwise[cell]:
            n = min(counts[cell] - placed, room[s])
            if n:
                pieces.setdefault(cell, []).append((placed, s, used[s]))
                used[s] += n
                room[s] -= n
                placed += n
            if placed == counts[cell]:
                break
    return [{"cell": c, "froms": [x[0] for x in p], "shards": [x[1] for x in p], "slots": [x[2] for x in p]} for c, p in sorted(pieces.items())]


def shard_rows(docs: DataFrame, shards: int = 16, virtual_nodes: int = 64) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of docs(doc_id, text)."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(F.col("doc_id").cast("string")).alias("place"),
    ).withColumn("cell", F.shiftrightunsigned("place", 51).cast("int"))
    # Counting needs only the id column, so the scan of the texts happens once.
    cells = docs.select(F.shiftrightunsigned(F.xxhash64(F.col("doc_id").cast("string")), 51).cast("int").alias("cell"))
    counts = {r["cell"]: r["n"] for r in cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = json.dumps(deal(counts, ring(shards, virtual_nodes), shards), separators=(",", ":"))
    kind = "array<struct<cell:int,froms:array<bigint>,shards:array<int>,slots:array<bigint>>>"
    pieces = spark.range(1).select(F.inline(F.from_json(F.lit(plan), F.lit(kind))))
    order = Window.partitionBy("cell").orderBy(F.shiftrightunsigned("place", 1), "place", "doc_id", "text_crc32", "size")
    ranked = keyed.withColumn("rank", F.row_number().over(order).cast("long") - 1)
    # The broadcast side has at most CELLS rows and one piece more for each shard: under 1 MB at any input size.
    piece = F.expr("size(filter(froms, f -> f <= rank))")
    return (
        ranked.join(F.broadcast(pieces), "cell")
        .withColumn("piece", piece)
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("rows").alias("law"),
            F.expr("element_at(shards, piece)").alias("shard"),
            F.expr("element_at(slots, piece) + rank - element_at(froms, piece)").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
