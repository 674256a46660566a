import collections
import zlib

from pyspark.sql import functions as F

from episodica.llm import sharding
from episodica.llm.shared import running


def check(rows, got, shards):
    assert len(got) == len(rows)
    want = collections.Counter((i, len((x or "").encode()) + 16, zlib.crc32((x or "").encode())) for i, x in rows)
    assert collections.Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    by = collections.defaultdict(list)
    for r in got:
        assert 0 <= r.shard < shards and r.law == "bytes" and r.grown_shard is None
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    return by


def test_sizes_are_even_and_copies_stay_together(make, prose):
    rows = [(k, prose(k, 20 + k % 60)) for k in range(400)] + [(1000 + k, prose(k % 40, 50)) for k in range(200)]
    got = sharding.shard_documents(make(rows), shards=8).collect()
    check(rows, got, 8)
    size = collections.Counter()
    for r in got:
        size[r.shard] += r["size"]
    assert max(size.values()) - min(size.values()) <= 0.02 * sum(size.values()) / 8
    at = {r.doc_id: r.shard for r in got}
    groups = collections.defaultdict(list)
    for i, x in rows[400:]:
        groups[x].append(at[i])
    assert all(len(set(g)) == 1 for g in groups.values())


def test_group_beyond_a_shard_is_split(make, prose):
    rows = [(k, "same text again") for k in range(300)] + [(1000 + k, prose(k, 3)) for k in range(300)]
    got = sharding.shard_documents(make(rows), shards=4).collect()
    check(rows, got, 4)
    size = collections.Counter()
    for r in got:
        size[r.shard] += r["size"]
    assert max(size.values()) <= 1.02 * sum(size.values()) / 4 + 100


def test_odd_rows(make, odd):
    check(odd, sharding.shard_documents(make(odd), shards=3).collect(), 3)


def test_empty_table(make):
    assert sharding.shard_documents(make([]), shards=4).count() == 0


def spread(got):
    size = collections.Counter()
    for r in got:
        size[r.shard] += r["size"]
    return max(size.values()) - min(size.values())


def test_many_small_documents(spark):
    docs = spark.range(60_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), (F.xxhash64("id") % 20 + 20).cast("int")).alias("text"))
    docs = docs.withColumn("text", F.concat("text", F.col("doc_id").cast("string")))
    got = sharding.shard_documents(docs, shards=40).collect()
    assert len(got) == 60_000 and spread(got) <= max(r["size"] for r in got)


def test_rows_without_an_id(make, prose):
    rows = [(None if k % 3 else 2**60 + k, prose(k, 20)) for k in range(900)] + [(7, prose(k, 20)) for k in range(2000, 2100)]
    got = sharding.shard_documents(make(rows), shards=8).collect()
    check(rows, got, 8)
    assert spread(got) <= max(r["size"] for r in got)


def test_running_sums_below_a_union(spark):
    rows = spark.range(5000).select((F.col("id") % 3).alias("g"), F.xxhash64("id").alias("h"), (F.col("id") % 7).alias("v"))
    sums = running(rows, "g", ["h"], "upto", "v")
    other = spark.range(10).select("id", F.lit(0).alias("h"), F.lit(0).alias("v"), F.lit(-1).alias("upto"))
    found = [r for r in other.select(F.col("id").alias("g"), "h", "v", "upto").union(sums).collect() if r["upto"] >= 0]
    upto = collections.Counter()
    for r in sorted(found, key=lambda r: (r["g"], r["h"])):
        assert r["upto"] == upto[r["g"]]
        upto[r["g"]] += r["v"]


def test_propagation_settles(spark):
    # twelve groups of eight in a ring: a group ends together, a link between groups may be cut
    edges = [(100 * c + i, 100 * c + j) for c in range(12) for i in range(8) for j in range(i)] + [(100 * c, 100 * ((c + 1) % 12) + 7) for c in range(12)]
    vertices = spark.createDataFrame([(100 * c + k, 10) for c in range(12) for k in range(8)], "id long, size long")
    links = spark.createDataFrame(edges, "u long, v long")
    before = sharding.cut_links(vertices.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(4))), links)
    placed = sharding.propagate(vertices, links, 4, 300.0)
    assert sharding.cut_links(placed, links) < before / 3


def test_a_round_over_few_links_shuffles_votes_only(spark, monkeypatch):
    # each join of a round was a shuffle, and each shuffle's partitions a file: hundreds of tasks for a few rows
    seen, real = [], sharding.staged

    def staged(df, name):
        seen.append((name, df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")))
        out = real(df, name)
        if name == "wishes":
            assert len(out.inputFiles()) <= sharding.FEW_TASKS
        return out

    monkeypatch.setattr(sharding, "staged", staged)
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "32"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        vertices = spark.range(600).selectExpr("id", "10L AS size")
        links = spark.range(600).selectExpr("id AS u", "id - id % 6 AS v").where("u != v")
        placed = {r.id: r.shard for r in sharding.propagate(vertices, links, 4, 6000.0).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert all(placed[k] == placed[k - k % 6] for k in range(600))
    assert max(n for name, n in seen if name == "wishes") <= 2 and max(n for name, n in seen if name == "movers") <= 1


def test_propagation_by_shuffles_alone_gives_the_same(spark, monkeypatch):
    vertices = spark.range(200).selectExpr("id", "id % 7 + 1 AS size")
    links = spark.range(200).selectExpr("id AS u", "id - id % 5 AS v").union(spark.range(1, 200, 9).selectExpr("id AS u", "id - 1 AS v")).where("u != v")
    want = sorted(map(tuple, sharding.propagate(vertices, links, 4, 250.0).collect()))
    monkeypatch.setattr(sharding, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, sharding.propagate(vertices, links, 4, 250.0).collect())) == want and len(want) == 200
