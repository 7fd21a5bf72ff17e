"""Sharding by Karmarkar-Karp differencing: shards of near-equal bytes from indivisible groups.

A group is all rows with one text.  Groups are summed by Spark (a text that a third of all
rows share arrives once per task) and dealt by hash to bins.  Each bin differences its
groups: it repeatedly combines the two partial partitions with the largest spread,
oppositely ordered, and ends with one partial partition into shards.  The bins' partitions
are then differenced the same way, at most ``FAN`` in one task and level by level, so no
task or driver holds more than ``FAN`` partitions.

Slots number a shard's rows by running sums over hash ranges of doc_id, never in one window per shard.

Defined results: a null text has 0 bytes (size 1) and no crc32, and all null texts are
one group; an empty text is a group of its own; rows are told apart by doc_id, size and
crc32 only, so equal rows share a shard and get different slots; a null doc_id is
numbered first; an empty table gives no rows.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

FAN = 4096
#: Groups that one bin differences.
BIN_GROUPS = 20_000


def difference(sums: list[list[int]], shards: int) -> list[list[int]]:
    """For each partial partition (one sum per local slot, missing ones 0), the shard of each local slot.

    Karmarkar and Karp's largest differencing for many parts: a heap holds the partitions
    by spread; the two of largest spread merge, largest sum onto smallest.
    """
    heap, members = [], {}
    for i, s in enumerate(sums):
        order = sorted(range(len(s)), key=lambda k: (-s[k], k))
        parts = [(s[k], [(i, k)]) for k in order] + [(0, []) for _ in range(shards - len(s))]
        parts.sort(key=lambda p: -p[0])
        members[i] = parts
        heap.append((parts[-1][0] - parts[0][0], i))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        one, two = members[a], members.pop(b)
        merged = []
        for (x, p), (y, q) in zip(one, reversed(two), strict=True):
            if len(p) < len(q):
                p, q = q, p
            p.extend(q)  # small into large: every slot moves at most log times
            merged.append((x + y, p))
        merged.sort(key=lambda p: -p[0])
        members[a] = merged
        heapq.heappush(heap, (merged[-1][0] - merged[0][0], a))
    out = [[0] * len(s) for s in sums]
    for shard, (_, slots) in enumerate(next(iter(members.values())) if members else []):
        for i, k in slots:
            out[i][k] = shard
    return out


def _bin(shards: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "group"], ascending=[False, True], kind="stable")
        local = [x[0] for x in difference([[int(b)] for b in pdf["bytes"]], shards)]
        return pd.DataFrame({"group": pdf["group"], "bytes": pdf["bytes"], "bin": pdf["bin"], "local": local})

    return run


def _combine(shards: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bin", "local"])
        bins = pdf["bin"].drop_duplicates().tolist()
        sums = {b: [0] * shards for b in bins}
        for b, k, x in zip(pdf["bin"], pdf["local"], pdf["bytes"], strict=True):
            sums[b][k] += int(x)
        to = difference([sums[b] for b in bins], shards)
        place = dict(zip(bins, to, strict=True))
        return pd.DataFrame({"parent": pdf["parent"], "bin": pdf["bin"], "local": pdf["local"], "bytes": pdf["bytes"], "shard": [place[b][k] for b, k in zip(pdf["bin"], pdf["local"], strict=True)]})

    return run


def shard_documents(docs: DataFrame, shards: int = 8, bin_groups: int = BIN_GROUPS, fan: int = FAN) -> DataFrame:
    """doc_id, size (UTF-8 bytes and 1), text_crc32, law, shard, slot and grown_shard (null) of every row."""
    text = docs["text"].cast("string")
    rows = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.coalesce(F.sha2(text, 256), F.lit("null")).alias("group"),
    )
    rows = materialise(rows)
    groups = rows.groupBy("group").agg(F.sum("size").alias("bytes"))
    n_rows = rows.count()
    bins = n_rows // bin_groups + 1
    local = groups.withColumn("bin", F.pmod(F.xxhash64("group"), F.lit(bins))).groupBy("bin").applyInPandas(_bin(shards), "group string, bytes long, bin long, local int")
    local = materialise(local)
    # level by level: up to ``fan`` partial partitions become one
    level = local.groupBy("bin", "local").agg(F.sum("bytes").alias("bytes"))
    place = local.select("bin", "local").distinct().withColumn("top", F.col("bin")).withColumn("slot_in_top", F.col("local"))
    while True:
        joined = materialise(level.withColumn("parent", F.floor(F.col("bin") / fan).cast("long")).groupBy("parent").applyInPandas(_combine(shards), "parent long, bin long, local int, bytes long, shard int"))
        step = joined.select(F.col("bin").alias("s_bin"), F.col("local").alias("s_local"), "parent", "shard")
        place = place.join(step, (F.col("top") == F.col("s_bin")) & (F.col("slot_in_top") == F.col("s_local"))).select("bin", "local", F.col("parent").alias("top"), F.col("shard").alias("slot_in_top"))
        if bins <= fan:
            break
        bins = -(-bins // fan)
        level = joined.groupBy(F.col("parent").alias("bin"), F.col("shard").alias("local")).agg(F.sum("bytes").alias("bytes"))
    final = local.join(place.select(F.col("bin").alias("p_bin"), F.col("local").alias("p_local"), F.col("slot_in_top").alias("shard")), (F.col("bin") == F.col("p_bin")) & (F.col("local") == F.col("p_local")))
    final = final.select(F.col("group").alias("g"), "shard")
    placed = rows.join(final, F.col("group") == F.col("g")).drop("g")
    return number_slots(placed, n_rows).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))


def number_slots(placed: DataFrame, n_rows: int, part_rows: int = 20_000) -> DataFrame:
    """``slot``: gapless numbers from 0 in each shard; parts are hash ranges of doc_id."""
    parts = n_rows // part_rows + 1
    placed = placed.withColumn("part", F.pmod(F.xxhash64("doc_id", "group"), F.lit(parts)))
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part")
    offsets = counts.select(F.col("shard").alias("o_shard"), F.col("part").alias("o_part"), (F.sum("n").over(before) - F.col("n")).alias("offset"))
    inside = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "group"))
    numbered = placed.withColumn("inside", inside).join(offsets, (F.col("shard") == F.col("o_shard")) & (F.col("part") == F.col("o_part")))
    return numbered.withColumn("slot", (F.col("offset") + F.col("inside") - 1).cast("long"))
