"""Source divergence against plain counting, and against its SQL twin."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from episodica.llm import divergence, oracles
from episodica.llm.queries import op11_source_divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
SCHEMA = "doc_id long, text string, lang string, source string, term string, n string, at string"


def plain(rows, least, top):
    """rows: (text, lang, source)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    count, documents = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        terms = [w.translate(lower) for w in TERM.findall(text)]
        count[lang, source].update(terms)
        documents[lang].update(set(terms))
    out = []
    for lang in {r[1] for r in rows}:
        kept = sorted(t for t, n in documents[lang].items() if n >= least)
        sources = [s for x, s in count if x == lang]
        all_ = sum((count[lang, s] for s in sources), Counter())

        def shares(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}

        p, q = {s: shares(count[lang, s]) for s in sources}, shares(all_)
        for s in sources:
            pair = [(sum((p[s][t] - p[o][t]) ** 2 // (p[s][t] + p[o][t]) for t in kept), o) for o in sources if o != s]
            term = [((p[s][t] - q[t]) ** 2 // (p[s][t] + q[t]), t) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for part, items in (("pair", pair), ("term", term)):
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, k) for k, (v, item) in enumerate(items[: None if part == "pair" else top], 1)]
    return sorted(out)


@pytest.fixture
def made():
    rng = random.Random(4)
    stems = ["the", "river", "riverbank", "riverban", "ABCDEFGH", "abcdefghi", "abcdefgh", "é", "漢字", "x" * 70, "x" * 70 + "y", "x" * 64, "x" * 65, "don't", "a1b"]
    texts = lambda: " ".join(rng.choice(stems[: rng.randrange(3, 16)]) + rng.choice(["", "S", ",", "\n", "_z"]) for _ in range(rng.randrange(30)))
    rows = [(texts(), rng.choice(["en", "en", "de", None]), rng.choice(["a", "a", "b", "c", None, "ü"])) for _ in range(300)]
    return rows + [(None, "en", "empty"), ("123", "numbers", "n1"), ("", "numbers", "n2"), ("rare words", "few", "f1"), ("z", "few", "f2"), ("alone", "one", "s")] + [rows[0]] * 40


def test_equals_plain_counting(spark, made):
    docs = spark.createDataFrame([(i, *r, "x", "y", "z") for i, r in enumerate(made)], SCHEMA).repartition(5)
    for least, top in ((10, 10), (1, 3)):
        found = divergence.audit(docs, least, top)
        assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
        assert sorted(map(tuple, found.collect())) == plain(made, least, top)


def test_slices_change_nothing(spark, made, monkeypatch):
    monkeypatch.setattr(divergence, "SLICE_BYTES", 200)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([r[k] for r in made], pa.string()) for k in (1, 2, 0)], ["lang", "source", "text"])
    found = Counter()
    for part in divergence._count(iter([batch])):
        for r in part.to_pylist():
            found[r["lang"], r["source"], r["term"]] += np.array([r["n"], r["documents"]])
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    expected = Counter()
    for text, lang, source in made:
        terms = Counter(w.translate(lower) for w in TERM.findall(text or ""))
        expected[lang or "", source or "", None] += np.array([0, 0])
        for t, n in terms.items():
            expected[lang or "", source or "", t] += np.array([n, 1])
    assert {k: tuple(v) for k, v in found.items()} == {k: tuple(v) for k, v in expected.items()}


def test_pointer_sort_orders_terms():
    rng = random.Random(8)
    terms = [bytes(rng.choice(b"ab") for _ in range(rng.choice([1, 7, 8, 9, 16, 17, 64, 65, 90]))) for _ in range(600)] + [b"a" * 80] * 9
    rng.shuffle(terms)
    data = np.frombuffer(b" ".join(terms), np.uint8)
    starts, ends = divergence.term_starts(data, np.array([0, len(data)]))
    order, opens = divergence.pointer_sort(data, starts, ends)
    assert order.tolist() == sorted(range(len(terms)), key=lambda i: (terms[i], i))
    ordered = sorted(terms)
    assert opens.tolist() == [i for i in range(len(terms)) if i == 0 or ordered[i] != ordered[i - 1]]


def test_large_counts_stay_exact(spark):
    n, total, kept = 7 * 10**12 + 11, 8 * 10**13 + 3, 10**9
    row = spark.createDataFrame([(n, total, kept)], "n long, total long, kept long")
    import pyspark.sql.functions as F

    found = row.select(divergence._probability(F.col("n"), F.col("total"), F.col("kept"))).first()[0]
    assert found == 1 + 10**9 * (n + 2) // (total + 2 * kept)


def test_rows_of_any_kind(spark, make, odd):
    docs = make(odd)
    assert sorted(map(tuple, divergence.audit(docs, 2).collect())) == plain([(t, "en", "s") for _, t in odd], 2, 10)
    assert divergence.audit(docs.limit(0)).count() == 0


def test_query_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    expected = con.execute(oracles.oracle_sql()["op11_source_divergence"])
    names = [d[0] for d in expected.description]
    found = op11_source_divergence(spark, sf_dir)
    assert found.columns == names and dict(found.dtypes)["value"] == "bigint" and dict(found.dtypes)["rank"] == "int"
    assert sorted(map(tuple, found.collect())) == sorted(expected.fetchall())
