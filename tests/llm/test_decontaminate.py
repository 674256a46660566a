import re

import numpy as np
import pytest

from episodica.llm import decontaminate as dc


def words(text):
    return [w.lower() for w in re.findall("[A-Za-z0-9\x80-\U0010ffff]+", text or "")]


def best_score(item, text):
    """Smith-Waterman cell by cell."""
    rows = [[0] * (len(text) + 1)]
    top = 0
    for w in item:
        row = [0]
        for j, v in enumerate(text, 1):
            row.append(max(0, rows[-1][j - 1] + (dc.MATCH if w == v else dc.MISMATCH), rows[-1][j] + dc.GAP, row[-1] + dc.GAP))
        rows.append(row)
        top = max(top, max(row))
    return top


def test_alignment_equals_plain_version():
    rng = np.random.default_rng(1)
    for _ in range(40):
        a, b = rng.integers(0, 6, rng.integers(1, 20)).astype(np.uint64), rng.integers(0, 6, rng.integers(0, 40)).astype(np.uint64)
        assert dc.align(a, b)[0] == best_score(a.tolist(), b.tolist())


@pytest.fixture()
def tables(spark, make, prose, odd):
    items = [(k, prose(900 + k, 30)) for k in range(6)] + [(50, "too short an item"), (53, "Thing!"), (54, "wide gates"), (55, "a seven word item that is whole"), (51, None), (None, prose(1, 40)), (52, ""), (0, prose(900, 30))]
    benchmark = spark.createDataFrame([(i, x, "clash") for i, x in items], "item_id long, text string, doc string")
    rows = list(odd)
    for k in range(6):
        w = prose(900 + k, 30).split()
        rows.append((100 + k, prose(k, 40) + "\n" + " ".join(w) + " " + prose(50 + k, 40)))  # exact
        w[4], w[13], w[22] = "changed", "words", "here"
        rows.append((200 + k, prose(10 + k, 10) + " " + ", ".join(w).upper()))  # edited, other case and marks
        rows.append((300 + k, " ".join(prose(900 + k, 30).split()[:15]) + " " + prose(60 + k, 30)))  # half
    rows += [(400 + k, prose(2000 + k, 200)) for k in range(30)]
    rows += [(500, " ".join(prose(900 + k, 30) for k in range(6)))]
    rows += [(600, "Too short: an item."), (601, "too short a thing an item"), (602, prose(1, 60) + " wide gates " + prose(2, 60) + " wide gates"), (603, "gates wide"),
             (604, prose(3, 33) + " a seven word item that is whole " + prose(4, 9)), (605, "a seven word item that was whole"), (606, "a seven word item")]
    return make(rows), benchmark, rows


def test_equals_brute_force(tables):
    docs, benchmark, rows = tables
    items = {r.item_id: words(r.text) for r in benchmark.collect() if r.item_id is not None and words(r.text)}
    got = {(r.doc_id, r.item_id): r.score for r in dc.contaminated(docs, benchmark).collect()}
    for i, x in rows:
        if len(x or "") > 10_000:
            continue
        for k, item in items.items():
            score = best_score(item, words(x)) / (dc.MATCH * len(item))
            if score >= (dc.THRESHOLD if len(item) >= dc.LEAST_WORDS else 1):
                assert abs(got[i, k] - score) < 1e-6, (i, k)
            else:
                assert (i, k) not in got
    assert {(100 + k, k) for k in range(6)} | {(200 + k, k) for k in range(6)} <= set(got)
    assert {(600, 50), (602, 54), (604, 55), (601, 53)} == {p for p in got if p[1] >= 50}


def test_spans_hold_the_copy(tables):
    docs, benchmark, rows = tables
    texts = dict(rows)
    for r in dc.contaminated(docs, benchmark).where("score = 1").collect():
        found = words(texts[r.doc_id])[r.first_word : r.end_word]
        assert found in [words(x.text) for x in benchmark.collect() if x.item_id == r.item_id]


def test_shuffle_path_gives_the_same(tables, monkeypatch):
    docs, benchmark, _ = tables
    want = sorted(map(tuple, dc.contaminated(docs, benchmark).collect()))
    monkeypatch.setattr(dc, "SEED_ROWS", 0)
    assert sorted(map(tuple, dc.contaminated(docs, benchmark).collect())) == want


def test_drop(tables):
    docs, benchmark, rows = tables
    left = dc.drop_contaminated(docs, benchmark)
    bad = {r.doc_id for r in dc.contaminated(docs, benchmark).collect()}
    assert left.columns == docs.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(i) for i, _ in rows if i not in bad)


def test_a_passage_in_very_many_documents_is_caught(spark, make, prose):
    passage = prose(77, 25)
    docs = make([(k, prose(k, 20) + " " + passage) for k in range(200)] + [(1000 + k, prose(5000 + k, 50)) for k in range(20)])
    benchmark = spark.createDataFrame([(1, passage), (2, prose(78, 25))], "item_id long, text string")
    assert {r.doc_id for r in dc.contaminated(docs, benchmark).collect()} == set(range(200))


def test_truncated_copies_in_very_many_documents_beside_a_whole_one(spark, make, prose):
    passage = prose(79, 22).split()
    rows = [(k, prose(k, 20) + " " + " ".join(passage[:14]) + " " + prose(3000 + k, 20)) for k in range(300)]
    rows += [(k, prose(k, 20) + " " + " ".join(passage[:9] + ["changed"] + passage[10:14]) + " " + prose(3000 + k, 20)) for k in range(300, 400)]
    rows += [(1000, prose(8, 20) + " " + " ".join(passage))] + [(2000 + k, prose(6000 + k, 60)) for k in range(20)]
    benchmark = spark.createDataFrame([(1, " ".join(passage)), (2, prose(80, 25))], "item_id long, text string")
    got = {r.doc_id: r.score for r in dc.contaminated(make(rows), benchmark).collect()}
    assert set(got) == set(range(400)) | {1000}
    items = [words(x.text) for x in benchmark.collect()]
    assert all(abs(got[i] - best_score(items[0], words(x)) / (dc.MATCH * 22)) < 1e-6 for i, x in rows if i in (0, 299, 300, 399, 1000))


def test_empty_tables(spark, make, prose):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, prose(1, 30))], "item_id long, text string")
    assert dc.contaminated(make([]), some).count() == 0
    assert dc.contaminated(make([(1, prose(1, 30))]), none).count() == 0
    assert dc.drop_contaminated(make([(1, prose(1, 30))]), none).count() == 1
