"""Tests and estimates against textbook values and brute force."""

import math
import random
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from episodica.functions.normal import normal_quantile_sql
from episodica.functions.pvalues import chi2_tail, normal_two_sided, t_two_sided
from episodica.operators import hypothesis, ranks, summary, survival, windows
from episodica.operators.models import Design, fit_logistic


def test_tail_probabilities():
    assert chi2_tail(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-12)
    assert chi2_tail(9.487729036781154, 4) == pytest.approx(0.05, abs=1e-12)
    assert chi2_tail(11.070497693516351, 5) == pytest.approx(0.05, abs=1e-12)
    assert t_two_sided(2.2281388519649385, 10) == pytest.approx(0.05, abs=1e-9)
    assert t_two_sided(12.706204736432095, 1) == pytest.approx(0.05, abs=1e-9)
    assert normal_two_sided(1.959963984540054) == pytest.approx(0.05, abs=1e-12)


def test_normal_quantile(spark):
    ps = [1e-9, 0.001, 0.02, 0.3, 0.5, 0.77, 0.999, 1 - 1e-9]
    df = spark.createDataFrame([(p,) for p in ps], "p double").select(F.expr(normal_quantile_sql("p")))
    for p, (got,) in zip(ps, df.collect()):
        assert got == pytest.approx(NormalDist().inv_cdf(p), abs=1e-9)


@pytest.fixture(scope="module")
def sample(spark):
    rnd = random.Random(4)
    rows = [(i, rnd.choice("abc"), float(rnd.choice([rnd.randrange(20), 7, 7, rnd.random() * 30])), rnd.random() < 0.1)
            for i in range(600)]
    rows = [(i, g, None if gap else x) for i, g, x, gap in rows]
    return rows, spark.createDataFrame(rows, "id int, g string, x double").cache()


def test_quartiles_equal_numpy(sample):
    rows, df = sample
    got = {r.stratum: r for r in summary.numeric_table(df, "g", ["x"]).collect()}
    for g in ("a", "b", "c", "Total"):
        xs = [x for _, h, x in rows if x is not None and g in (h, "Total")]
        assert (got[g].q1, got[g].median, got[g].q3) == pytest.approx(tuple(np.quantile(xs, [0.25, 0.5, 0.75])))
        assert got[g].sd == pytest.approx(np.std(xs, ddof=1))
        assert got[g].n + got[g].missing == sum(1 for _, h, _ in rows if g in (h, "Total"))
    rough = {r.stratum: r for r in summary.numeric_table(df, "g", ["x"], approximate=True).collect()}
    assert rough["Total"].median == pytest.approx(got["Total"].median, abs=1)


def test_kruskal_equals_brute_force(sample):
    rows, df = sample
    data = sorted((x, g) for _, g, x in rows if x is not None)
    xs = np.array([x for x, _ in data])
    mid = np.array([(np.sum(xs < x) + np.sum(xs <= x) + 1) / 2 for x in xs])
    n = len(xs)
    h = 12 / (n * (n + 1)) * sum(
        mid[[i for i in range(n) if data[i][1] == g]].sum() ** 2 / sum(1 for _, k in data if k == g) for g in "abc"
    ) - 3 * (n + 1)
    _, ties = np.unique(xs, return_counts=True)
    h /= 1 - (ties**3 - ties).sum() / (n**3 - n)
    row = hypothesis.kruskal(df, "g", ["x"]).collect()[0]
    assert (row.statistic, row.df) == (pytest.approx(h), 2)
    assert row.p == pytest.approx(math.exp(-h / 2))


@pytest.fixture
def many_parts(spark):
    """Range partitions stay as many as asked for, however small the table."""
    keep = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "7"}
    before = {k: spark.conf.get(k) for k in keep}
    for k, v in keep.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_running_totals_with_one_hot_value(spark, many_parts):
    values = [("v", 5.0)] * 400 + [("v", float(i)) for i in range(300)] + [("w", 1.5)] * 9 + [("u", float(i % 3)) for i in range(50)]
    long = spark.createDataFrame(values, "variable string, value double")
    cut = ranks.ordered(ranks.histogram(long, ["variable"]), ["variable"], ["value"])
    out = ranks.with_group_totals(ranks.running_totals(cut, ["variable"], {"n": "n", "half": F.col("n") / 2}), ["variable"], {"n": "n"}).collect()
    assert len({r._part for r in out}) > 4 and len(out) == 304
    for r in out:
        mine = [x for v, x in values if v == r.variable]
        assert r.n_upto == sum(1 for x in mine if x <= r.value) == 2 * r.half_upto and r.n_all == len(mine)


def test_running_totals_of_rows_in_order(spark, many_parts):
    rnd = random.Random(12)
    rows = [(rnd.choice("aab"), rnd.randrange(10**6), i, rnd.choice([None, 1, 5])) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, v long, id long, w long")
    cut = ranks.ordered(df, ["k"], [F.desc("v"), "id"])
    # totals of totals, over the same partitions
    twice = ranks.running_totals(ranks.running_totals(cut, ["k"], {"w": "w"}), ["k"], {"both": "w_upto"})
    got = {r.id: (r.w_upto, r.both_upto) for r in twice.collect()}
    for k in "ab":
        upto = both = 0
        for _, _, i, w in sorted((r for r in rows if r[0] == k), key=lambda r: (-r[1], r[2])):
            upto += w or 0
            both += upto
            assert got[i] == (upto, both)
    assert ranks.running_totals(ranks.ordered(df.limit(0), ["k"], ["v"]), ["k"], {"w": "w"}).count() == 0


def test_number_rows_equals_a_window(spark, many_parts):
    rnd = random.Random(3)
    rows = [(rnd.choice(["x", "x", "x", "", None]), rnd.choice([1, None]), rnd.choice([None, 1.5, 2.5, 3.5]), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, j int, v double, id long")
    order = [F.desc_nulls_last("v"), F.asc("id")]
    got = windows.number_rows(df, ["k", "j"], order, "n")
    assert got.columns == [*df.columns, "n"]
    window = df.withColumn("n", F.row_number().over(Window.partitionBy("k", "j").orderBy(*order)).cast("bigint"))
    assert sorted(map(str, got.collect())) == sorted(map(str, window.collect()))


def test_quartiles_and_ranks_in_many_parts(sample, many_parts):
    test_quartiles_equal_numpy(sample)
    test_kruskal_equals_brute_force(sample)


def test_kruskal_with_a_value_of_a_third_of_all_rows(spark, many_parts):
    rows = [(g, 7.0) for g in "aabc" for _ in range(250)] + [(g, float(i)) for i in range(500) for g in "abbc"]
    df = spark.createDataFrame(rows, "g string, x double")
    got = hypothesis.kruskal(df, "g", ["x"])
    plan = got._jdf.queryExecution().toString()
    assert plan.split("== Physical Plan ==")[1].count("Exchange") <= 6
    xs = np.array([x for _, x in rows])
    mid = np.array([(np.sum(xs < x) + np.sum(xs <= x) + 1) / 2 for x in (0.0, *sorted(set(xs)))])
    rank = dict(zip((0.0, *sorted(set(xs))), mid))
    n = len(rows)
    h = 12 / (n * (n + 1)) * sum(sum(rank[x] for k, x in rows if k == g) ** 2 / sum(1 for k, _ in rows if k == g) for g in "abc") - 3 * (n + 1)
    _, ties = np.unique(xs, return_counts=True)
    assert got.collect()[0].statistic == pytest.approx(h / (1 - (ties**3 - ties).sum() / (n**3 - n)))


@pytest.mark.parametrize("k", [2, 7, 300])
def test_log_rank_of_many_groups(spark, many_parts, monkeypatch, k):
    monkeypatch.setattr(survival, "BLOCK", 2000)
    rnd = random.Random(k)
    rows = [(float(rnd.randrange(1, 60)), int(rnd.random() < 0.5), f"g{rnd.randrange(k):03d}") for _ in range(3000)]
    rows += [(1.0, 0, "early")] * 2  # never at risk when somebody dies, unless at the first time
    df = spark.createDataFrame(rows, "t double, d int, g string").repartition(5)
    names = sorted({g for _, _, g in rows})
    at = {g: i for i, g in enumerate(names)}
    observed, expected, cov = np.zeros(len(names)), np.zeros(len(names)), np.zeros((len(names),) * 2)
    gap, var = np.zeros((len(names),) * 2), np.zeros((len(names),) * 2)
    for t in sorted({t for t, _, _ in rows}):
        n, dead = np.zeros(len(names)), np.zeros(len(names))
        for u, d, g in rows:
            n[at[g]] += u >= t
            dead[at[g]] += u == t and d
        observed += dead
        total, d = n.sum(), dead.sum()
        expected += d * n / total
        if total > 1:
            cov += d * (total - d) / (total - 1) / total**2 * (np.diag(n) * total - np.outer(n, n))
        r, e = n[:, None] + n[None], dead[:, None] + dead[None]
        gap += dead[:, None] - np.where(r > 0, e * n[:, None] / np.maximum(r, 1), 0)
        var += np.where(r > 1, e * (r - e) / np.maximum(r - 1, 1) / np.maximum(r, 1) ** 2 * n[:, None] * n[None], 0)
    terms = {r.group: r for r in survival.logrank_terms(df, "t", "d", "g").collect()}
    for g in names:
        assert (terms[g].observed, terms[g].n) == (observed[at[g]], sum(1 for r in rows if r[2] == g))
        assert terms[g].expected == pytest.approx(expected[at[g]]) and terms[g].variance == pytest.approx(cov[at[g], at[g]])
    test = survival.logrank_test(df, "t", "d", "g").collect()[0]
    z = (observed - expected)[1:]
    assert test.df == len(names) - 1 and test.statistic == pytest.approx(z @ np.linalg.solve(cov[1:, 1:], z), rel=1e-8)
    if k < 300:
        pairs = {(r.level_a, r.level_b): r.statistic for r in survival.pairwise_logrank(df, "t", "d", "g").collect()}
        assert len(pairs) == len(names) * (len(names) - 1) // 2
        for (a, b), got in pairs.items():
            i, j = at[a], at[b]
            assert got == pytest.approx(gap[i, j] ** 2 / var[i, j]) if var[i, j] > 0 else got is None


def test_chi_square_with_empty_cell(spark):
    cells = [("r1", "c1", 10), ("r1", "c2", 20), ("r2", "c1", 15), ("r3", "c2", 5)]
    rows = [(r, c) for r, c, n in cells for _ in range(n)]
    df = spark.createDataFrame(rows, "r string, c string")
    table = np.array([[10, 20], [15, 0], [0, 5]], dtype=float)
    e = table.sum(1, keepdims=True) * table.sum(0, keepdims=True) / table.sum()
    got = hypothesis.independence(df, "r", "c").collect()[0]
    assert (got.statistic, got.df) == (pytest.approx(((table - e) ** 2 / e).sum()), 2)
    square = hypothesis.independence(df.where("r <> 'r3'"), "r", "c").collect()[0]
    a, b, c, d = 10, 20, 15, 0
    n = a + b + c + d
    yates = n * (abs(a * d - b * c) - n / 2) ** 2 / ((a + b) * (c + d) * (a + c) * (b + d))
    assert square.statistic == pytest.approx(yates)


def test_p_adjustment(spark):
    ps = [0.01, 0.04, 0.03, 0.005]
    df = spark.createDataFrame([("f", p) for p in ps], "f string, p double")
    holm = {r.p: r.p_adjusted for r in hypothesis.adjust_p(df, ["f"], "p", "holm").collect()}
    bh = {r.p: r.p_adjusted for r in hypothesis.adjust_p(df, ["f"], "p", "bh").collect()}
    assert [holm[p] for p in ps] == pytest.approx([0.03, 0.06, 0.06, 0.02])
    assert [bh[p] for p in ps] == pytest.approx([0.02, 0.04, 0.04, 0.02])


def test_repeat_rows_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(ranks, "CHUNK", 10)
    df = spark.createDataFrame([("a", 25), ("b", 1), ("c", 10)], "k string, n bigint")
    out = ranks.repeat_rows(df, "n", "i", ["k"]).collect()
    assert sorted((r.k, r.i) for r in out) == sorted((k, i) for k, n in (("a", 25), ("b", 1), ("c", 10)) for i in range(n))


def test_survival_against_brute_force(spark):
    rnd = random.Random(9)
    rows = [(float(rnd.randrange(1, 40)), int(rnd.random() < 0.5), rnd.choice("xyz")) for _ in range(300)]
    rows += [(60.0, 1, "z")]
    df = spark.createDataFrame(rows, "t double, d int, g string")
    curve = {(r.group, r.time): r for r in survival.km_curve(df, "t", "d", "g").collect()}
    for g in "xyz":
        s, last = 1.0, 100.0
        for t in sorted({t for t, _, h in rows if h == g}):
            risk = sum(1 for u, _, h in rows if h == g and u >= t)
            dead = sum(1 for u, e, h in rows if h == g and u == t and e)
            s *= 1 - dead / risk
            r = curve[(g, t)]
            assert (r.n_risk, r.n_event) == (risk, dead) and r.survival_pct == pytest.approx(100 * s, abs=1e-9)
            assert r.survival_pct <= last
            last = r.survival_pct
    times = sorted({t for t, e, _ in rows if e})
    gap, cov = np.zeros(3), np.zeros((3, 3))
    for t in times:
        n = np.array([sum(1 for u, _, h in rows if h == g and u >= t) for g in "xyz"], dtype=float)
        d = np.array([sum(1 for u, e, h in rows if h == g and u == t and e) for g in "xyz"], dtype=float)
        gap += d - d.sum() * n / n.sum()
        if n.sum() > 1:
            f = d.sum() * (n.sum() - d.sum()) / (n.sum() - 1)
            cov += f * (np.diag(n / n.sum()) - np.outer(n, n) / n.sum() ** 2)
    expected = gap[:2] @ np.linalg.solve(cov[:2, :2], gap[:2])
    test = survival.logrank_test(df, "t", "d", "g").collect()[0]
    assert (test.statistic, test.df) == (pytest.approx(expected), 2)
    terms = survival.logrank_terms(df, "t", "d", "g").collect()
    assert sum(r.observed - r.expected for r in terms) == pytest.approx(0, abs=1e-9)
    assert [r.variance for r in terms] == pytest.approx(list(np.diag(cov)))
    pair = survival.pairwise_logrank(df.where("g <> 'z'"), "t", "d", "g").collect()[0]
    two = survival.logrank_test(df.where("g <> 'z'"), "t", "d", "g").collect()[0]
    assert pair.statistic == pytest.approx(two.statistic)


def test_logistic_score_equations(spark):
    rnd = random.Random(2)
    rows = []
    for _ in range(800):
        age, sex = float(rnd.randrange(20, 90)), rnd.choice(["F", "M"])
        y = int(rnd.random() < 1 / (1 + math.exp(3 - 0.04 * age - (sex == "M") * 0.5)))
        rows.append((y, age if rnd.random() > 0.02 else None, sex))
    df = spark.createDataFrame(rows, "y int, age double, sex string")
    design = Design(numeric=("age",), factors={"sex": (("F", "M"), "F")})
    fit = fit_logistic(df, "y", design)
    merged = fit_logistic(df, "y", design, collapse=True)
    assert fit.estimates == pytest.approx(merged.estimates, abs=1e-7)
    assert fit.errors == pytest.approx(merged.errors, abs=1e-7)
    scored = fit.score(design.complete(df)).collect()
    assert sum(r.y - r.distance for r in scored) == pytest.approx(0, abs=1e-6)
    assert sum((r.y - r.distance) * r.age for r in scored) == pytest.approx(0, abs=1e-4)
    assert fit.names == ["(Intercept)", "age", "sex=M"]
    assert fit.z == pytest.approx([e / s for e, s in zip(fit.estimates, fit.errors)])


def test_level_without_cases_has_no_estimate(spark):
    rows = [(i % 2, float(i % 7), "a" if i % 3 else "b") for i in range(60)]
    df = spark.createDataFrame(rows, "y int, x double, g string")
    fit = fit_logistic(df, "y", Design(numeric=("x",), factors={"g": (("a", "b", "c"), "a")}))
    table = {r.term: r.estimate for r in fit.coefficients().collect()}
    assert table["g=c"] is None and table["g=b"] is not None
    assert fit.score(df).where("distance BETWEEN 0 AND 1").count() == 60
