import random
import re

import pytest

from episodica.llm import jaccard
from episodica.session import ensure_checkpoint_dir

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sets_of(rows, size):
    out = []
    for i, x in rows:
        w = [re.sub("[A-Z]", lambda m: m.group().lower(), y) for y in WORD.findall(x or "")]
        out.append((i, {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()))
    return out


def brute(rows, size, percent):
    """Smallest id reachable by links; rows of one id are one document."""
    sets = [s for s in sets_of(rows, size) if s[0] is not None]
    up = {i: i for i, _ in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((root(i), root(j)))
                up[y] = x
    return {i: root(i) for i in up}


def check(make, rows, size=3, percent=90):
    got = jaccard.similar_groups(make(rows), size, percent / 100).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles) for r in got) == sorted((i is None, i or 0, len(s)) for i, s in sets_of(rows, size))
    want = brute(rows, size, percent)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    assert all(r.component_id is None for r in got if r.doc_id is None)
    return want


def family(prose, seed, members, first, edits):
    rng, base = random.Random(seed), prose(seed, 120).split()
    rows = []
    for k in range(members):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(len(w))] = f"edit{seed}x{rng.randrange(10**6)}"
        rows.append((first + k, " ".join(w)))
    return rows


@pytest.mark.parametrize("size,percent", [(3, 90), (5, 80)])
def test_equals_brute_force(make, prose, size, percent):
    rows = family(prose, 1, 60, 0, 6) + family(prose, 2, 8, 100, 3) + family(prose, 3, 3, 200, 1)
    rows += [(300 + k, prose(500 + k, 90)) for k in range(20)]
    rows += [(400, prose(2, 119)), (401, prose(2, 119).upper()), (402, "two words"), (403, "Two  Words"), (404, "one")]
    # a shared passage alone is no link
    rows += [(500 + k, prose(9, 30) + " " + prose(600 + k, 40)) for k in range(40)]
    want = check(make, rows, size, percent)
    assert len(set(want.values())) < len(want)


def test_chain_of_links(make, prose):
    w = prose(5, 200).split()
    rows = [(k, " ".join(w[: 100 + 4 * k])) for k in range(20)]
    check(make, rows)


def test_frequent_tokens(make, prose, monkeypatch):
    monkeypatch.setattr(jaccard, "HOT_LEAST", 2)
    check(make, family(prose, 4, 40, 0, 5) + family(prose, 6, 20, 100, 4))


def test_odd_rows(make, odd, prose):
    check(make, odd)
    check(make, [*odd, (8, prose(1, 119)), (10, prose(3, 100)), (10, prose(1, 118))])


def test_empty_table(make):
    assert jaccard.similar_groups(make([])).count() == 0


def test_long_sets_move_only_for_pairs_that_wide_marks_allow(make, prose, monkeypatch):
    # a document's 2048 marks are full at this length: they allow every pair, and each moved a whole set
    base = prose(11, 6000).split()
    near = [w if k % 200 else f"edit{k}" for k, w in enumerate(base)]
    rows = [(1, " ".join(base)), (2, " ".join(near))] + [(10 + k, " ".join(base[:2000] + prose(20 + k, 4000).split())) for k in range(6)]
    moved, real = [], jaccard.staged

    def staged(df, name):
        out = real(df, name)
        if name == "sets":
            moved.extend(r.doc for r in out.select("doc").collect())
        return out

    monkeypatch.setattr(jaccard, "staged", staged)
    docs = make(rows).selectExpr("doc_id AS doc", "text")
    pairs = docs.selectExpr("doc AS x").join(docs.selectExpr("doc AS y")).where("x > y")
    got = jaccard._links(pairs, docs, 5, jaccard.Fraction("0.8"))
    assert [(r.x, r.y) for r in got.collect()] == [(2, 1)] and sorted(moved) == [1, 2]
    check(make, rows, 5, 80)


def test_marks_of_sets_on_both_sides_of_a_power_of_two(make, prose):
    rows = [(k, " ".join(prose(31, 700).split()[: 490 + 6 * k])) for k in range(12)] + [(20 + k, prose(32, 126 + k)) for k in range(8)]
    check(make, rows, 3, 90)
    check(make, rows, 3, 30)


def test_stages_go_when_they_are_used_up(spark, make, prose):
    def kept():
        jvm = spark._jvm
        here = jvm.org.apache.hadoop.fs.Path(ensure_checkpoint_dir(spark))
        return {s.getPath().getName() for s in here.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(here)}

    ensure_checkpoint_dir(spark)
    before = kept()
    out = jaccard.similar_groups(make(family(prose, 7, 30, 0, 4)), 3, 0.9)
    left = {name.rsplit("-", 1)[0] for name in kept() - before if "-" in name and len(name.rsplit("-", 1)[1]) == 32}
    assert left <= {"member", "links"} and out.count() == 30
