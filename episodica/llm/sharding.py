"""Shards by balanced label propagation, with sizes near equal.

Linked documents start in shards by hash. In each round those that would rather be in
another shard, where most of their neighbours are, may move: all of them in the first round, a random
half by hash later. If two neighbours would only change places, the smaller id stays. A shard
admits movers only up to its free capacity: with more demand than room, a mover
enters with probability room / demand, decided by a hash. Rounds end when nobody wishes to move to a shard
with room, or when the wishes have not become fewer for some rounds. Afterwards linked documents
beyond a shard's capacity leave it, and the free documents fill all shards up to equal
sizes, so links decide where they can and sizes hold in any case.

Documents above a fixed fraction of a shard are few by that definition
(``shards * HEAVY`` at most) and are placed one by one, largest first; the rest is laid along
the shards' remaining room by running sums.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episodica.llm.shared import BROADCAST_ROWS, running, staged

#: A document of more than 1 / HEAVY of a shard's size is placed by the driver; there are fewer than shards * HEAVY.
HEAVY = 256
#: Rounds without fewer wishes than before after which propagation has settled.
PATIENCE = 8
#: The smallest documents, so many a shard, are placed last and one by one.
FILLERS = 16
#: Tasks that write a round's wishes if the linked documents are few (``BROADCAST_ROWS``): a file for each partition would take most of the round.
FEW_TASKS = 8
#: Share of a shard that linked documents may fill; the rest evens out sizes.
LINKED_SHARE = 0.97


def _draw(key: Column, salt: int) -> Column:
    """A number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def _loads(placed: DataFrame) -> dict[int, int]:
    return {r["shard"]: int(r["s"]) for r in placed.groupBy("shard").agg(F.sum("size").alias("s")).collect()}


def propagate(vertices: DataFrame, edges: DataFrame, shards: int, capacity: float, patience: int = PATIENCE) -> DataFrame:
    """(id, size, shard) of linked ``vertices`` (id, size) after label propagation over ``edges`` (u, v)."""
    both = staged(edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    placed = staged(vertices.select("id", "size", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard")), "labels")
    # a table of few rows meets the links without a shuffle; beyond that the same joins shuffle
    few = placed.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    turn, fewest, since = 0, None, 0
    while True:
        beside = placed.select(F.col("id").alias("v"), F.col("shard").alias("near"))
        votes = both.join(F.broadcast(beside) if few else beside, "v").select(
            "u", "near", F.lit(1).cast("long").alias("n"), F.lit(None).cast("long").alias("size"))
        # a row of its own shard and size for each vertex, so that votes and place meet in one aggregation
        votes = votes.union(placed.select("id", "shard", F.lit(0).cast("long"), "size"))
        votes = votes.groupBy("u", "near").agg(F.sum("n").alias("n"), F.max("size").alias("size"))
        own = F.col("size").isNotNull()
        best = votes.groupBy(F.col("u").alias("id")).agg(
            F.max("size").alias("size"), F.max(F.when(own, F.col("near"))).alias("shard"), F.max(F.when(own, F.col("n"))).alias("here"),
            F.max(F.struct("n", (-F.col("near")).alias("near"))).alias("best")).where("shard IS NOT NULL")
        target = (-F.col("best.near")).cast("int")
        wish = F.when((target != F.col("shard")) & (F.col("best.n") > F.col("here")), target)
        now = best.select("id", "size", "shard", wish.alias("target"))
        now = staged(now.coalesce(FEW_TASKS) if few else now, "wishes")
        wishes = now.where("target IS NOT NULL")
        load, wanted = defaultdict(int), defaultdict(int)
        for r in now.groupBy("shard", "target").agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n")).collect():
            load[r["shard"]] += int(r["s"])
            if r["target"] is not None:
                wanted[r["target"]] += r["n"]
        count = sum(wanted.values())
        fewest, since = (count, 0) if fewest is None or count < fewest else (fewest, since + 1)
        if not any(load[t] < capacity for t in wanted) or since >= patience:
            return placed
        # who would change places with a neighbour of a greater id stays
        held = F.broadcast if count <= BROADCAST_ROWS else lambda df: df
        mine = wishes.select(F.col("id").alias("u"), "shard", "target")
        theirs = wishes.select(F.col("id").alias("v"), F.col("shard").alias("target"), F.col("target").alias("shard"))
        swaps = both.where("u < v").join(held(mine), "u").join(held(theirs), ["v", "shard", "target"]).select(F.col("u").alias("id")).distinct()
        movers = wishes.join(held(swaps), "id", "left_anti").where((_draw(F.col("id"), turn) < 0.5) if turn else F.lit(True))
        movers = staged(movers, "movers")
        demand = {r["target"]: int(r["s"]) for r in movers.groupBy("target").agg(F.sum("size").alias("s")).collect()}
        turn += 1
        if not demand:
            continue
        # room that leavers make counts in the next round only
        share = {t: max(0.0, min(1.0, (capacity - load[t]) / max(s, 1))) for t, s in demand.items()}
        admitted = F.element_at(F.create_map(*[F.lit(x) for kv in share.items() for x in kv]), F.col("target"))
        moved = movers.where(_draw(F.col("id"), turn + 1000) < admitted).select("id", "target")
        placed = staged(placed.join(held(moved), "id", "left").select("id", "size", F.coalesce("target", "shard").alias("shard")), "labels")


def cut_links(placed: DataFrame, edges: DataFrame) -> int:
    """Links between different shards."""
    side = placed.select(F.col("id").alias("u"), F.col("shard").alias("a"))
    ends = edges.where("u != v").join(side, "u").join(side.select(F.col("u").alias("v"), F.col("a").alias("b")), "v")
    return ends.where("a != b").count()


def balanced(vertices: DataFrame, edges: DataFrame, shards: int, patience: int = PATIENCE) -> DataFrame:
    """(id, size, shard) of all ``vertices`` (id, size): linked ones by propagation, all sizes near equal.

    ``edges`` (u, v) name ids of vertices; loops are ignored. Ids must be unique and not null. An empty table gives
    an empty result. A vertex larger than total / shards makes its shard larger than the others.
    """
    edges = edges.where("u != v").select("u", "v")
    total = vertices.agg(F.sum("size")).first()[0] or 0
    even = total / shards
    ends = edges.select(F.col("u").alias("id")).union(edges.select(F.col("v").alias("id"))).distinct()
    linked = propagate(vertices.join(ends, "id", "left_semi"), edges, shards, even * LINKED_SHARE, patience)
    # beyond capacity the last in hash order leave
    linked = running(linked.withColumn("h", F.xxhash64("id")), "shard", ["h", "id"], "upto", "size")
    stay = staged(linked.where(F.col("upto") + F.col("size") <= max(even * LINKED_SHARE, 0)).select("id", "size", "shard"), "stay")
    free = staged(vertices.join(stay.select("id"), "id", "left_anti").select("id", "size"), "free")

    load = {s: 0 for s in range(shards)} | _loads(stay)
    big = free.where(F.col("size") * HEAVY > even).orderBy(F.desc("size"), "id").collect()
    heavy = []
    for r in big:
        s = min(load, key=lambda k: (load[k], k))
        load[s] += r["size"]
        heavy.append((r["id"], r["size"], s))
    schema = "id long, size long, shard int"
    placed = stay.union(free.sparkSession.createDataFrame(heavy, schema))
    light = free.where(F.col("size") * HEAVY <= even)
    # the smallest are kept back, a fixed number for each shard, to even out what the limits between shards leave
    back = light.orderBy("size", "id").limit(shards * FILLERS).select("id", "size").collect()
    light = light.join(F.broadcast(free.sparkSession.createDataFrame([(r["id"],) for r in back], "id long")), "id", "left_anti")
    # fill the emptiest up to one level that takes all of the rest
    level, left = 0.0, total - sum(load.values()) - sum(r["size"] for r in back)
    order = sorted(load.values())
    for k, x in enumerate(order):
        nxt = order[k + 1] if k + 1 < len(order) else float("inf")
        if left <= (nxt - x) * (k + 1):
            level = x + left / (k + 1)
            break
        left -= (nxt - x) * (k + 1)
    bounds, upto = [], 0.0
    for s in range(shards):
        upto += max(0.0, level - load[s])
        bounds.append((upto, s))
    middle = F.col("upto") + F.col("size") / 2
    shard = F.lit(bounds[-1][1])
    for bound, s in reversed(bounds[:-1]):
        shard = F.when(middle < bound, s).otherwise(shard)
    laid = running(light.select("id", "size", F.lit(0).alias("all"), F.xxhash64("id").alias("h")), "all", ["h", "id"], "upto", "size")
    laid = staged(laid.select("id", "size", shard.cast("int").alias("shard")), "laid")
    for s, size in _loads(laid).items():
        load[s] += size
    rest = []
    for r in reversed(back):
        s = min(load, key=lambda k: (load[k], k))
        load[s] += r["size"]
        rest.append((r["id"], r["size"], s))
    return placed.union(laid).union(free.sparkSession.createDataFrame(rest, schema))


def shard_documents(docs: DataFrame, shards: int = 40, patience: int = PATIENCE) -> DataFrame:
    """All documents in shards of near-equal bytes, equal texts together where sizes allow.

    Every row is a vertex of its own; links join it to the first row of its text. Defined cases: null
    text has size 16 and checksum 0; rows that share a doc_id or have none are placed by their texts alone;
    further columns are ignored; slots are numbered by doc_id (nulls first), then size, checksum and row; an empty table gives an empty result.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"),
                       F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("same"))
    rows = staged(rows.withColumn("id", F.monotonically_increasing_id()), "sizes")
    leaders = rows.groupBy("same", "text_crc32", "size").agg(F.min("id").alias("v"), F.count(F.lit(1)).alias("n")).where("n > 1")
    edges = rows.join(leaders, ["same", "text_crc32", "size"]).where("id != v").select(F.col("id").alias("u"), "v")
    placed = balanced(rows.select("id", "size"), staged(edges, "links"), shards, patience)
    out = rows.join(placed.select("id", "shard"), "id").select("doc_id", "size", "text_crc32", "shard", "id")
    out = running(out, "shard", ["doc_id", "size", "text_crc32", "id"], "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
