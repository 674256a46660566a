"""Greedy matching against a direct sequential search."""

import random

import pytest

from episodica.operators import matching
from episodica.operators.matching import match_nearest, matched_rows
from episodica.sources.tables import checkpointed


def sequential(rows):
    treated = sorted((-s, i, s) for i, t, s in rows if t == 1)
    control = sorted((-s, i, s) for i, t, s in rows if t == 0)
    free, pairs = [True] * len(control), {}
    for _, i, s in treated:
        above = [k for k, c in enumerate(control) if free[k] and c[2] > s]
        below = [k for k, c in enumerate(control) if free[k] and c[2] <= s]
        if not above and not below:
            continue
        if not above or (below and s - control[below[0]][2] <= control[above[-1]][2] - s):
            k = below[0]
        else:
            k = above[-1]
        free[k] = False
        pairs[i] = control[k][1]
    return pairs


CASES = {
    "balanced": dict(n=160, share=0.5, grid=10**6, block=17),
    "many treated": dict(n=120, share=0.85, grid=1000, block=11),
    "few treated": dict(n=150, share=0.1, grid=1000, block=23),
    "coarse scores": dict(n=120, share=0.4, grid=4, block=9),
    "one hot score": dict(n=150, share=0.5, grid=500, block=13, hot=0.4),
    "treated above": dict(n=100, share=0.5, grid=300, block=8, shift=300),
    "treated below": dict(n=60, share=0.5, grid=300, block=12, shift=-300),
}


def rows_of(n, share, grid, hot=0.0, shift=0, seed=1, **_):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        treated = int(rnd.random() < share)
        score = grid // 2 if rnd.random() < hot else rnd.randrange(grid)
        out.append((i, treated, float(score + (shift if treated else 0))))
    return out


@pytest.mark.parametrize("name", list(CASES))
def test_equals_sequential_search(spark, name):
    case = CASES[name]
    rows = rows_of(**case)
    df = spark.createDataFrame(rows, "id bigint, t int, distance double")
    got = match_nearest(df, "id", "t", block_units=case["block"]).collect()
    assert {r.treated_id: r.control_id for r in got} == sequential(rows)
    assert len({r.control_id for r in got}) == len(got)


def test_block_size_does_not_matter(spark):
    rows = rows_of(n=200, share=0.6, grid=50, hot=0.3, seed=5)
    df = spark.createDataFrame(rows, "id bigint, t int, distance double")
    small, large = (
        {(r.treated_id, r.control_id) for r in match_nearest(df, "id", "t", block_units=b).collect()} for b in (10, 1000)
    )
    assert small == large


def test_matched_rows(spark):
    df = spark.createDataFrame([(1, 1, 0.5), (2, 0, 0.4), (3, 0, 0.9)], "id bigint, t int, distance double")
    out = {r.id: (r.pair, r.weights) for r in matched_rows(df, match_nearest(df, "id", "t"), "id").collect()}
    assert out == {1: (1, 1.0), 2: (1, 1.0)}


def store_of(spark, rows, unit):
    df = spark.createDataFrame(rows, "id bigint, t int, distance double")
    groups = checkpointed(matching._score_groups(df, "t", "distance"))
    pieces, ahead = (checkpointed(x) for x in matching._pieces(groups, unit))
    return matching._flows(pieces, ahead, unit)


def test_rounds_write_little_more_than_the_result(spark):
    # every block takes from what the blocks before left, so no start is foreseen
    rnd = random.Random(7)
    rows = [(i, int(rnd.random() < 0.5 + 0.2 * ((i // 40) % 2) - 0.1), 10_000.0 - i + rnd.random()) for i in range(1200)]
    flows, store = store_of(spark, rows, 40)
    blocks = 30
    written = store.rows()
    assert written.where("kind = 'summary'").select("block").distinct().count() == blocks
    latest = store.latest([(r["block"], r["m"]) for r in written.groupBy("block").agg({"round": "max"}).toDF("block", "m").collect()], "")
    assert written.count() <= 2 * latest.count()
    assert written.where("round > 0 AND kind = 'summary'").groupBy("block").count().where("count > 1").isEmpty()
    assert store.rounds <= 1 + -(-blocks // matching.CHAIN)
    assert {r.treated_id: r.control_id for r in match_nearest(
        spark.createDataFrame(rows, "id bigint, t int, distance double"), "id", "t", block_units=40).collect()} == sequential(rows)


def test_foreseen_starts_widen_the_round(spark):
    # as many controls as treated in every stretch: what a block leaves hardly matters to the next but one
    rnd = random.Random(2)
    rows = [(i, i % 2, float(10_000 - 10 * (i // 2)) + (0.5 if i % 2 else rnd.random() * 0.1)) for i in range(1600)]
    flows, store = store_of(spark, rows, 20)
    assert store.rounds < 1 + 80 // matching.CHAIN


def test_blocks_lie_in_folders_of_their_own(spark, monkeypatch):
    seen = []
    chain = matching._round

    def watched(pieces, ahead, store, blocks, starts, chains, unit):
        out = chain(pieces, ahead, store, blocks, starts, chains, unit)
        inputs = {f.rsplit("block=", 1)[1].split("/")[0] for f in pieces.inputFiles() if "block=" in f}
        seen.append((len(inputs), len(chains)))
        return out

    monkeypatch.setattr(matching, "_round", watched)
    rnd = random.Random(11)
    rows = [(i, int(rnd.random() < 0.5), rnd.random()) for i in range(400)]
    store_of(spark, rows, 10)
    assert seen[0] == (40, 40) and len(seen) > 1
