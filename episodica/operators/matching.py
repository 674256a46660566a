"""Exact greedy 1:1 nearest-neighbour matching on a score, without replacement.

Rule: treated rows choose in descending score order (equal scores: ascending
id); each takes the free control nearest in score. Candidates are the nearest
free control with a higher score and the nearest with a score not higher; at
equal distance the latter wins. Among equal scores the smallest id is taken
from below and the largest from above. Treated rows left without a control
stay unmatched.

The rule is sequential, but what one stretch of scores passes to the next is
little: how far down controls are already used, and which higher controls are
still free. Scores are reduced to counts and cut into blocks of a fixed number
of units, so a score shared by very many rows is spread over several blocks.
All blocks are worked on in parallel once, with an assumed start. From then on a
round takes the first block whose start turned out different and a chain of its
successors, one after another in one task, so that all of the chain is right
afterwards; as long as starts prove to be foreseen rightly, twice as many later chains as
before are repeated along with it. Results of a round are added to a store and
never written again: the latest result of a block counts. The result is exact whatever the
data. The driver keeps a few numbers per block, and a task never holds more than
a chain of blocks.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from episodica.operators.ranks import ordered, repeat_rows, running_totals
from episodica.session import ensure_checkpoint_dir
from episodica.sources.tables import checkpointed

BLOCK_UNITS = 50_000
#: Blocks that one task settles one after another: less than a million units, which a task can hold.
CHAIN = 16

#: Blocks whose numbers are written into a filter.
FEW = 400

_OUTPUT = "block bigint, kind string, score double, t_start bigint, c_start bigint, n bigint, step int, pos bigint"


@dataclass
class _Block:
    """What the driver knows of one block."""

    treated: int
    first_control: int
    end_control: int
    popped: int = 0
    kept: int = 0
    kept_mark: int = 0
    used_to: int = -1
    seen: tuple | None = field(default=None, repr=False)
    round: int = -1


def _score_groups(scored: DataFrame, treatment: str, score: str) -> DataFrame:
    """Per distinct score, best first: how many treated and controls, and their first ranks."""
    rows = scored.select(
        (-F.col(score)).alias("order"), F.col(treatment).cast("int").alias("t")
    )
    hist = rows.groupBy("order").agg(F.count_if(F.col("t") == 1).alias("nt"), F.count_if(F.col("t") == 0).alias("nc"))
    ranked = running_totals(ordered(hist, [], ["order"]), [], {"nt": "nt", "nc": "nc"})
    return ranked.select(
        (-F.col("order")).alias("score"), "nt", "nc",
        (F.col("nt_upto") - F.col("nt")).alias("t0"), (F.col("nc_upto") - F.col("nc")).alias("c0"),
    )


def _cut(df: DataFrame, first: str, count: str, unit: int, part: str) -> DataFrame:
    """Cuts runs of units at multiples of ``unit``: adds the part number and the overlap."""
    last = F.col(first) + F.col(count) - 1
    parts = F.sequence(F.floor(F.col(first) / unit), F.floor(last / unit))
    low = F.greatest(F.col(first), F.col(part) * unit)
    high = F.least(last, (F.col(part) + 1) * unit - 1)
    return (
        df.where(F.col(count) > 0).withColumn(part, F.explode(parts))
        .withColumn("skip", low - F.col(first)).withColumn("size", high - low + 1)
    )


def _pieces(groups: DataFrame, unit: int) -> tuple[DataFrame, DataFrame]:
    """Treated and control runs per block, and control runs per chunk of control ranks."""
    placed = groups.withColumn("m0", F.col("t0") + F.col("c0"))
    treated = _cut(placed, "m0", "nt", unit, "block").select(
        "block", F.lit("T").alias("role"), "score", (F.col("t0") + F.col("skip")).alias("start"), F.col("size").alias("n")
    )
    control = _cut(placed.withColumn("m1", F.col("m0") + F.col("nt")), "m1", "nc", unit, "block").select(
        "block", F.lit("C").alias("role"), "score", (F.col("c0") + F.col("skip")).alias("start"), F.col("size").alias("n")
    )
    ahead = _cut(placed, "c0", "nc", unit, "chunk").select(
        "chunk", "score", (F.col("c0") + F.col("skip")).alias("start"), F.col("size").alias("n")
    )
    return treated.unionByName(control), ahead


def _run_chain(pdf: pd.DataFrame) -> pd.DataFrame:
    """Matches the treated units of a chain of blocks from a given start of the first.

    Roles: B a block, T its treated, C its controls, A controls after the chain, S free controls
    before it (pos orders them, last is nearest). ``used`` is the first control rank that is still free at
    or after the chain's own. Every block gets the rows it would get alone.
    """
    used = int(pdf["used"].iloc[0])
    roles = {r: part for r, part in pdf.groupby("role")}
    empty = pdf.iloc[:0]
    own = roles.get("C", empty)
    controls = pd.concat([own, roles.get("A", empty)]).sort_values("start")
    below = [
        [s, max(a, used), a + n - max(a, used)]
        for s, a, n in controls[["score", "start", "n"]].itertuples(index=False) if a + n > used
    ]
    behind = roles.get("S", empty).sort_values("pos")
    above = [[s, a, n] for s, a, n in zip(behind.score, behind.start, behind.n)]
    ends = (own.start + own.n).groupby(own.block).max().to_dict()
    treated = dict(list(roles.get("T", empty).groupby("block")))
    rows, here = [], 0
    for block in sorted(roles["B"].block.tolist()):
        depth = len(above)  # entries of the incoming stack that are still there
        popped, flows = 0, []
        mine = treated.get(block, empty).sort_values("start")
        for s, t, n in mine[["score", "start", "n"]].itertuples(index=False):
            while here < len(below) and below[here][0] > s:
                above.append(below[here])
                here += 1
            while n > 0:
                low = below[here] if here < len(below) else None
                high = above[-1] if above else None
                if low is None and high is None:
                    break
                if high is None or (low is not None and s - low[0] <= high[0] - s):
                    k = min(n, low[2])
                    flows.append((s, t, low[1], k, 1))
                    low[1] += k
                    low[2] -= k
                    here += low[2] == 0
                else:
                    k = min(n, high[2])
                    high[2] -= k
                    flows.append((s, t, high[1] + high[2] + k - 1, k, -1))
                    if len(above) <= depth:
                        popped += k
                    if high[2] == 0:
                        above.pop()
                        depth = min(depth, len(above))
                t += k
                n -= k
        # controls of the block that nobody reached are above all that follows
        while here < len(below) and block in ends and below[here][1] < ends[block]:
            above.append(below[here])
            here += 1
        next_free = below[here][1] if here < len(below) else max([used, *(b[1] + b[2] for b in below[-1:])])
        kept = above[depth:]
        positions = np.cumsum([0, *(n for _, _, n in kept)])
        mark = int(pd.util.hash_pandas_object(pd.DataFrame(kept), index=False).sum() % (2**62)) if kept else 0
        rows += [(block, "flow", s, t, c, k, d, 0) for s, t, c, k, d in flows]
        rows += [(block, "free", s, 0, a, n, 0, int(p)) for (s, a, n), p in zip(kept, positions)]
        rows.append((block, "summary", 0.0, popped, next_free, int(positions[-1]), 0, mark))
    return pd.DataFrame(rows, columns=["block", "kind", "score", "t_start", "c_start", "n", "step", "pos"])


def _starts(blocks: list[_Block], needs: dict[int, int] | None = None) -> dict[int, tuple[int, tuple]]:
    """Start of every block from the latest results: (first free control, free runs behind).

    Runs behind reach as far as the block can take controls from them, or as far as ``needs`` says.
    """
    starts, stack, used = {}, [], 0
    last = blocks[-1].end_control if blocks else 0
    for b, info in enumerate(blocks):
        used = max(used, info.first_control)
        refs, need = [], needs.get(b, 0) if needs else info.treated
        for origin, left in reversed(stack):
            if need <= 0:
                break
            refs.append((origin, left, blocks[origin].kept_mark))
            need -= left
        starts[b] = (used, tuple(refs))
        gone = info.popped
        while gone > 0 and stack:
            origin, left = stack.pop()
            if left > gone:
                stack.append((origin, left - gone))
            gone -= left
        if info.kept:
            stack.append((b, info.kept))
        # A block not yet run is assumed to take all its controls from below.
        used = max(info.end_control, info.used_to if info.round >= 0 else min(last, used + info.treated))
    return starts


class _Store:
    """Results of all rounds, each written once; the latest result of a block counts."""

    def __init__(self, spark: SparkSession):
        self._spark = spark
        self._path = f"{ensure_checkpoint_dir(spark)}/matching-{uuid.uuid4().hex}"
        self.rounds = 0

    def keep(self, rows: DataFrame, name: str, part: str) -> DataFrame:
        """Input of the rounds in a folder per block or chunk, so that a round reads only its own."""
        path = f"{self._path}-{name}"
        rows.repartitionByRange(part, "start").write.partitionBy(part).parquet(path)
        return self._spark.read.schema(rows.schema).parquet(path).select(*rows.columns)

    def add(self, rows: DataFrame) -> list:
        """Keeps a round and returns its summaries: one short row per block."""
        path = f"{self._path}/round={self.rounds}"
        rows.write.partitionBy("kind").parquet(path)
        self.rounds += 1
        return self._read([self.rounds - 1], "summary").collect()

    def _read(self, rounds: Iterable[int], kind: str | None) -> DataFrame:
        paths = [f"{self._path}/round={r}" for r in sorted(set(rounds))]
        found = self._spark.read.schema(f"{_OUTPUT}, round int").option("basePath", self._path).parquet(*paths)
        return found.where(F.col("kind") == kind) if kind else found

    def rows(self) -> DataFrame:
        """All that was ever written."""
        return self._spark.read.schema(f"{_OUTPUT}, round int").parquet(self._path)

    def latest(self, blocks: list[tuple], schema: str, kind: str | None = None) -> DataFrame:
        """Rows (of a kind) of given (block, round, ...): blocks are few, so their list is broadcast; other rounds are not opened."""
        wanted = self._spark.createDataFrame(blocks, f"block bigint, round int{schema}")
        rows = self._read((b[1] for b in blocks), kind)
        if len(blocks) <= FEW:
            rows = rows.where(F.col("block").isin([b[0] for b in blocks]))
        return rows.join(F.broadcast(wanted), ["block", "round"])


def _chains(blocks: list[_Block], starts: dict, window: int) -> list[list[int]]:
    """Blocks to repeat: the chain from the first one whose start is new, and ``window`` later chains that have such a block."""
    new = [b for b in range(len(blocks)) if starts[b] != blocks[b].seen]
    out: list[list[int]] = []
    for b in new:
        if not out or b > out[-1][-1]:
            if len(out) > window:
                break
            out.append(list(range(b, min(b + CHAIN, len(blocks)))))
    return out


def _round(pieces: DataFrame, ahead: DataFrame, store: _Store, blocks: list[_Block], starts: dict, chains: list[list[int]], unit: int) -> DataFrame:
    """Results of the blocks of some chains, from the starts of their first blocks."""
    spark = pieces.sparkSession
    total = blocks[-1].end_control
    members, look, refs = [], [], []
    behind = _starts(blocks, {chain[0]: sum(blocks[b].treated for b in chain) for chain in chains})
    for chain in chains:
        first, used = chain[0], starts[chain[0]][0]
        members += [(b, first, used) for b in chain]
        low = max(used, blocks[chain[-1]].end_control)
        high = min(total, low + sum(blocks[b].treated for b in chain))
        look += [(first, c, used, low, high) for c in range(low // unit, -(-high // unit)) if high > low]
        refs += [(o, blocks[o].round, first, used, left) for o, left, _ in behind[first][1]]
    members_df = F.broadcast(spark.createDataFrame(members, "block bigint, chain bigint, used bigint"))
    nothing = F.lit(0).cast("bigint")
    if len(members) <= FEW:
        pieces = pieces.where(F.col("block").isin([m[0] for m in members]))
    parts = pieces.join(members_df, "block").select("chain", "block", "role", "score", "start", "n", nothing.alias("pos"), "used")
    parts = parts.unionByName(spark.createDataFrame(members, "block bigint, chain bigint, used bigint").select(
        "chain", "block", F.lit("B").alias("role"), F.lit(0.0).alias("score"), nothing.alias("start"), nothing.alias("n"), nothing.alias("pos"), "used"))
    if look:
        if len({x[1] for x in look}) <= FEW:
            ahead = ahead.where(F.col("chunk").isin(sorted({x[1] for x in look})))
        look_df = spark.createDataFrame(look, "chain bigint, chunk bigint, used bigint, low bigint, high bigint")
        begin, end = F.greatest("start", "low"), F.least(F.col("start") + F.col("n"), F.col("high"))
        parts = parts.unionByName(
            ahead.join(F.broadcast(look_df), "chunk").where(end > begin).select(
                "chain", F.lit(-1).cast("bigint").alias("block"), F.lit("A").alias("role"), "score", begin.alias("start"),
                (end - begin).alias("n"), nothing.alias("pos"), "used",
            )
        )
    if refs:
        free = store.latest(refs, ", chain bigint, used bigint, left bigint", "free").where("pos < left")
        parts = parts.unionByName(free.select(
            "chain", "block", F.lit("S").alias("role"), "score", F.col("c_start").alias("start"),
            F.least(F.col("n"), F.col("left") - F.col("pos")).alias("n"), (F.col("block") * F.lit(4 * unit) + F.col("pos")).alias("pos"), "used",
        ))
    return parts.groupBy("chain").applyInPandas(_run_chain, _OUTPUT)


def _flows(pieces: DataFrame, ahead: DataFrame, unit: int) -> tuple[DataFrame, _Store]:
    """Runs of matched ranks, after repeating blocks until all starts agree, and the store they are in."""
    spark = pieces.sparkSession
    store = _Store(spark)
    pieces, ahead = store.keep(pieces, "pieces", "block"), store.keep(ahead, "ahead", "chunk")
    is_t, is_c = F.col("role") == "T", F.col("role") == "C"
    facts = pieces.groupBy("block").agg(
        F.sum(F.when(is_t, F.col("n")).otherwise(0)).alias("treated"),
        F.min(F.when(is_c, F.col("start"))).alias("first"),
        F.max(F.when(is_c, F.col("start") + F.col("n"))).alias("end"),
    )
    blocks: list[_Block] = []
    reached = 0
    for row in facts.orderBy("block").collect():  # one short row per block
        first = reached if row.first is None else row.first
        reached = reached if row.end is None else row.end
        blocks.append(_Block(row.treated, first, reached))
    window = 0
    starts = _starts(blocks)
    chains = [[b] for b in range(len(blocks))]
    while chains:
        for row in store.add(_round(pieces, ahead, store, blocks, starts, chains, unit)):
            info = blocks[row.block]
            info.popped, info.used_to, info.kept, info.kept_mark = row.t_start, row.c_start, row.n, row.pos
            info.round = store.rounds - 1
        after = _right_starts(blocks, starts, chains)
        if store.rounds > 1:
            # was the start of the block behind the first chain foreseen?
            beyond = chains[0][-1] + 1
            window = max(1, 2 * window) if beyond < len(blocks) and after[beyond] == starts[beyond] else 0
        starts, chains = after, _chains(blocks, after, window)
    if not blocks:
        return spark.createDataFrame([], f"{_OUTPUT}, round int"), store
    return store.latest([(b, info.round) for b, info in enumerate(blocks)], "", "flow"), store


def _right_starts(blocks: list[_Block], starts: dict, chains: list[list[int]]) -> dict[int, tuple[int, tuple]]:
    """The starts after a round. Blocks of a chain ran from each other's results, so if the first one's start was right, so were theirs."""
    for chain in chains:
        blocks[chain[0]].seen = starts[chain[0]]
    after = _starts(blocks)
    for chain in chains:
        for b in chain[1:]:
            blocks[b].seen = after[b] if after[chain[0]] == starts[chain[0]] else None
    return after


def _ranked_rows(scored: DataFrame, id_col: str, treatment: str, score: str) -> tuple[DataFrame, DataFrame]:
    """Treated and control ids with their rank by descending score and ascending id.

    Range partitions over (side, score, id) split a score shared by many rows;
    positions inside the partitions are shifted by the sizes of earlier ones.
    """
    keys = scored.select(
        (1 - F.col(treatment).cast("int")).alias("side"), (-F.col(score)).alias("order"), F.col(id_col).alias("id")
    )
    sort = ["side", "order", "id"]
    placed = checkpointed(
        keys.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("at", F.monotonically_increasing_id())
    )
    part, index = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    placed = placed.select("side", "order", "id", part.alias("part"), index.alias("index"))
    sizes = placed.groupBy("part").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("side") == 0).alias("nt")
    ).orderBy("part").collect()  # one short row per partition
    treated_total = sum(r.nt for r in sizes)
    offsets, so_far = [], 0
    for r in sizes:
        offsets.append((r.part, so_far))
        so_far += r.n
    shifts = scored.sparkSession.createDataFrame(offsets, "part bigint, shift bigint")
    ranked = placed.join(F.broadcast(shifts), "part").withColumn("rank", F.col("index") + F.col("shift"))
    treated = ranked.where("side = 0").select("rank", F.col("id").alias("treated_id"), (-F.col("order")).alias("treated_score"))
    control = ranked.where("side = 1").select(
        (F.col("rank") - treated_total).alias("c_rank"), F.col("id").alias("control_id"),
        (-F.col("order")).alias("control_score"),
    )
    return treated, control


def match_nearest(
    scored: DataFrame, id_col: str, treatment: str, score: str = "distance", block_units: int = BLOCK_UNITS
) -> DataFrame:
    """Matched pairs: pair number, ids and scores of both rows, and their distance.

    ``id_col`` must be unique; treatment is 0/1 and the score known on all rows.
    """
    groups = checkpointed(_score_groups(scored, treatment, score))
    flows, _ = _flows(*_pieces(groups, block_units), block_units)
    units = repeat_rows(flows, "n", "i", ["t_start"]).select(
        (F.col("t_start") + F.col("i")).alias("rank"), (F.col("c_start") + F.col("step") * F.col("i")).alias("c_rank")
    )
    treated, control = _ranked_rows(scored, id_col, treatment, score)
    return (
        units.join(treated, "rank").join(control, "c_rank")
        .select(
            (F.col("rank") + 1).alias("pair"), "treated_id", "control_id", "treated_score", "control_score",
            F.abs(F.col("treated_score") - F.col("control_score")).alias("gap"),
        )
    )


def matched_rows(df: DataFrame, pairs: DataFrame, id_col: str) -> DataFrame:
    """The rows of both sides of every pair, with pair number and weight 1."""
    members = pairs.select(
        F.explode(F.array(
            F.struct(F.col("treated_id").alias(id_col), "pair"), F.struct(F.col("control_id").alias(id_col), "pair"),
        )).alias("m")
    ).select("m.*")
    return df.join(members, id_col).withColumn("weights", F.lit(1.0))
