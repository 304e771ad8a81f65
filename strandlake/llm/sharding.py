"""Sharding on a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandlake.llm._store import cut, pick

#: The ring has this many cells; a virtual node stands at the end of a cell, so a cell has one owner.
CELLS = 4096
#: Rows of a cell are counted in this many parts, by the CRC of their text, so that one repeated key does not meet in one task.
PARTS = 8
#: Slots of one repeated row are dealt in runs of this many, so that no array grows with the row's copies.
RUN = 1 << 16


def ring(shards: int, vnodes: int, cells: int = CELLS) -> list[int]:
    """The virtual nodes in clockwise order as (cell, shard) pairs, flattened to an owner list: walk[i] is the shard of the i-th node, cell by cell."""
    nodes = []
    for shard in range(shards):
        for v in range(vnodes):
            at = int.from_bytes(hashlib.sha256(f"shard-{shard}/node-{v}".encode()).digest()[:8], "big") % cells
            nodes.append((at, hashlib.sha256(f"{shard}:{v}".encode()).digest(), shard))
    return [(at, shard) for at, _, shard in sorted(nodes)]


def capacities(home: list[int], slack: float) -> list[int]:
    """The most rows that each shard takes: floor or ceiling of the mean (the larger ones to the fullest), or (1 + slack) times the mean."""
    n, s = sum(home), len(home)
    if slack > 0:
        return [int(-(-n * (1 + slack) // s))] * s
    order = sorted(range(s), key=lambda i: (-home[i], i))
    more = set(order[: n % s])
    return [n // s + (i in more) for i in range(s)]


def assign(counts: dict[int, int], shards: int, vnodes: int, slack: float, cells: int = CELLS, parts: int = PARTS) -> list[tuple[int, int, int, int, int, int]]:
    """(cell, from, to, shard, slot of from, home shard): which rows of a cell, by rank, go to which shard.

    counts: rows by cell * parts + part.  Every cell first fills its own shard;
    what finds it full continues clockwise, past full shards, until all rows have
    a place.  The work depends on cells and shards only, not on rows.
    """
    nodes = ring(shards, vnodes, cells)
    at, after = 0, []
    for cell in range(cells):
        while at < len(nodes) and nodes[at][0] < cell:
            at += 1
        after.append(at % len(nodes))
    home = [0] * shards
    for key, n in counts.items():
        home[nodes[after[key // parts]][1]] += n
    room = capacities(home, slack)
    used = [0] * shards
    out, over = [], []

    def put(key: int, begin: int, end: int, shard: int) -> int:
        take = min(end - begin, room[shard] - used[shard])
        if take:
            out.append((key, begin, begin + take, shard, used[shard], nodes[after[key // parts]][1]))
            used[shard] += take
        return begin + take

    for key in sorted(counts):
        begin = put(key, 0, counts[key], nodes[after[key // parts]][1])
        if begin < counts[key]:
            over.append((key, begin, counts[key]))
    for key, begin, end in over:
        i = after[key // parts]
        while begin < end:
            i = (i + 1) % len(nodes)
            begin = put(key, begin, end, nodes[i][1])
    return out


def shard(docs: DataFrame, shards: int = 16, vnodes: int = 64, slack: float = 0.0) -> DataFrame:
    """Give every row a shard and a gapless slot in it.

    A row's place on the ring is the hash of its doc_id.  With slack 0 shard
    counts differ by one at most (law ``rows``); with more, no shard exceeds
    (1 + slack) times the mean and fewer rows leave their home shard.

    Returns doc_id, size (UTF-8 bytes plus 1; null text: none plus 1), text_crc32,
    shard, slot, home_shard (the ring's owner before loads are bounded).

    A null doc_id hashes like any value.  Repeated rows are interchangeable: they
    are counted before the shuffle, ranked as one, and take a range of ranks that
    is dealt over shards and then slot by slot.  Extra columns are ignored; an empty table gives an empty
    one.  The driver holds one count for each of CELLS * PARTS ring parts, and
    that many rows and one more a shard are broadcast, at any input size.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = pick(docs, "doc_id", "text").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.xxhash64("doc_id").alias("h"))
    place = (F.pmod(F.shiftrightunsigned("h", 20), F.lit(CELLS)) * PARTS + F.pmod("text_crc32", F.lit(PARTS))).cast("int")
    rows = cut(rows.withColumn("place", place), "ring-rows")
    counts = {r[0]: r[1] for r in rows.groupBy("place").count().collect()}
    table = spark.createDataFrame(assign(counts, shards, vnodes, slack), "place int, first long, last long, shard int, base long, home_shard int")
    # a row that occurs c times is one row here, with the ranks from k to k + c - 1
    ranked = rows.groupBy("place", "h", "doc_id", "text_crc32", "size").agg(F.count("*").alias("c"))
    before = Window.partitionBy("place").orderBy("h", "doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumn("k", F.coalesce(F.sum("c").over(before), F.lit(0)))
    joined = ranked.join(F.broadcast(table), (ranked["place"] == table["place"]) & (F.col("k") < F.col("last")) & (F.col("k") + F.col("c") > F.col("first")))
    shift = F.col("base") - F.col("first")
    out = joined.select("doc_id", "size", "text_crc32", "shard", (F.greatest("k", "first") + shift).alias("begin"), (F.least(F.col("k") + F.col("c"), "last") + shift).alias("end"), "home_shard")
    runs = out.select("*", F.explode(F.sequence("begin", F.col("end") - 1, F.lit(RUN).cast("long"))).alias("run"))
    slots = F.sequence("run", F.least(F.col("run") + RUN, "end") - 1)
    return runs.select("doc_id", "size", "text_crc32", "shard", F.explode(slots).alias("slot"), "home_shard")


def query(spark, sf_dir: str) -> DataFrame:
    """Every document in one of 16 shards whose row counts differ by one at most: nulls, repeated rows and empty tables as shard() states."""
    out = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"), shards=16)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "home_shard")
