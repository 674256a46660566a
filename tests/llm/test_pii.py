import hashlib
import random
import re

import numpy as np

from episodica.llm import pii
from episodica.llm.trees import fit_trees

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes(kind, s):
    d = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(x) <= 255 for x in s.split("."))
    if kind == "card":
        odd = [int(c) for c in d[::-1]]
        return 14 <= len(d) <= 19 and sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(odd)) % 10 == 0
    return kind == "email" or 10 <= len(d) <= 15


def base_spans(text):
    found = [(m.start(), list(BASE).index(k), m.end(), k) for k, p in BASE.items() for m in re.finditer(p, text) if passes(k, m.group())]
    return [(a, b, k) for a, _, b, k in sorted(found)]


def listed(spans):
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


SAMPLES = ["mail a.b+c@x-y.example.com, ok", "@@a@b@c.d.e@f.g x@y z@.com q@w..e", "1.2.3.4.5.6.7.8 999.1.1.1 01.02.003.255 1..2.3.4 1.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1112",
           "+1 (415) 555-2671 +12 +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 +4 ((((( 5", "1" * 40 + " 5555555555554444", "é😀 10.0.0.1 ü@a.b a@b.c", "a@b.c@d.e 1-2-3 4 5"]


def test_base_formats_equal_the_patterns():
    rng = random.Random(3)
    texts = SAMPLES + ["".join(rng.choice("0123456789.@ab -+()%") for _ in range(300)) for _ in range(300)]
    for t in texts:
        got = sorted(((a, list(BASE).index(k), b) for k, a, b, ok in pii.shaped(t) if ok))
        assert got == [(a, list(BASE).index(k), b) for a, b, k in base_spans(t)], t


def test_long_runs_take_linear_time():
    for t in ("a" * 200_000, "a@" * 50_000, "1" * 200_000, "1." * 100_000, "+1" + " " * 200_000, "@" * 100_000):
        pii.shaped(t)
        pii.candidates(t)


def corpus(prose):
    rng = random.Random(5)
    rows = []
    for k in range(400):
        card = "4" + "".join(str(rng.randrange(10)) for _ in range(14))
        card += next(str(c) for c in range(10) if pii.luhn(card + str(c)))
        bits = [f"user{k}@mail.example.com", f"{rng.randrange(1, 255)}.{rng.randrange(255)}.3.{rng.randrange(255)}", card, f"+1 ({200 + k}) 555-{1000 + k}",
                f"{rng.randrange(300, 900)}.{k}.1.2", card[:-1] + str((int(card[-1]) + 1) % 10), f"version {k % 9}.{k % 7}"]
        rows.append((k, prose(k, 10) + " " + " and ".join(rng.sample(bits, 3)) + " " + prose(k + 1000, 5)))
    return rows


def test_result_and_added_spans(make, prose, odd):
    rows = corpus(prose) + [(1000 + k, x) for k, x in enumerate(SAMPLES)] + odd
    docs = make(rows)
    detector = pii.train(docs)
    assert detector.trees is not None
    got = pii.find(docs, detector).collect()
    assert len(got) == len(rows)
    by = {}
    for i, x in rows:
        by.setdefault(i, []).append(x or "")
    for r in got:
        options = []
        for t in by[r.doc_id]:
            base = base_spans(t)
            options.append((*(sum(k == n for _, _, k in base) for n in BASE), hashlib.sha256(listed(base).encode()).hexdigest()))
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) in options
    t = "write to jo.doe (at) mail (dot) example.org or 10.0.0.1 now"
    base, every = detector.spans(t)
    assert set(base) <= set(every) and base == [(t.index("10.0"), t.index("10.0") + 8, "ip")]


def test_numbers_side_by_side_are_found(make, prose):
    cards = ["4111111111111111", "5555555555554444", "4012 8888 8888 1881", "4111-1111-1111-1111"]
    phones = ["1 (415) 555-2671", "1 (212) 555-1234", "+1 (646) 555-9876"]
    detector = pii.train(make(corpus(prose)))
    for numbers, kind in ((cards, "card"), (phones, "phone"), (["(415) 555-2671", "212-555-1234", "415 555 2671"], None)):
        for one in numbers:
            for other in numbers:
                t = f"pay with {one} {other} or more"
                spans = {(9, 9 + len(one)), (10 + len(one), 10 + len(one) + len(other))}
                assert {(kind or "phone", a, b) for a, b in spans} <= set(pii.candidates(t)), t
                if kind:  # numbers as the corpus has them; its phones have eleven digits
                    assert {(a, b, kind) for a, b in spans} == set(detector.spans(t)[1]), t


def test_chosen_spans_cover_most():
    spans = [(0, 10, "phone", 10.0), (5, 18, "card", 13.0), (11, 21, "phone", 10.0), (30, 40, "card", 1.0)]
    assert sorted(pii._apart(spans)) == [(0, 10, "phone"), (11, 21, "phone"), (30, 40, "card")] and pii._apart([]) == []


def test_runs_of_a_cluster_are_linear_and_keep_the_whole():
    t = "+1 (415) 555-2671"
    assert {("phone", 0, len(t)), ("phone", 3, len(t))} <= set(pii.candidates(t))
    assert len(pii.candidates("1." * 2000)) <= 19 * 2 * 2000


def test_training_sample_is_bounded_and_stable(make, prose):
    docs = make(corpus(prose))
    a, b = pii.train(docs, rows=500), pii.train(docs.repartition(7), rows=500)
    x = np.array([pii.features("call +1 (415) 555-2671 now", "phone", 5, 22)])
    assert a.thresholds == b.thresholds and np.allclose(a.trees.probability(x), b.trees.probability(x))


def test_every_candidate_counts_wherever_sums_are_taken(make, prose, monkeypatch):
    weights = []
    grow = pii._grow

    def seen(rows, cuts, share, local):
        weights.append(rows.agg({"n": "sum"}).first()[0])
        return grow(rows, cuts, share, local)

    monkeypatch.setattr(pii, "_grow", seen)
    monkeypatch.setattr("episodica.llm.trees.ROUNDS", 4)
    docs = make(corpus(prose))
    own = docs.select("text").mapInArrow(pii._learnable, "h long, x array<double>, y double, n double").dropDuplicates(["h", "y"])
    whole = own.where("shiftright(h, 1) & 1 = 0").agg({"n": "sum"}).first()[0]
    by_tasks, here = pii.train(docs, rows=10), pii.train(docs.repartition(5))
    assert weights == [whole, whole] and whole > 200
    assert by_tasks.thresholds == here.thresholds
    assert all((a == b).all() for s, t in zip(by_tasks.trees.trees, here.trees.trees, strict=True) for a, b in zip(s, t))


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = fit_trees(x[:3000], y[:3000])
    assert ((model.probability(x[3000:]) > 0.5) == y[3000:]).mean() > 0.95


def test_redaction(make):
    docs = make([(1, "mail a@b.com, card 4111 1111 1111 1111."), (2, None), (3, ""), (3, "x")])
    out = pii.redact(docs, pii.Detector(None, {}))
    assert out.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in out.collect() if r.text is not None) == [(1, "mail <EMAIL>, card <CARD>."), (3, ""), (3, "x")]


def test_empty_table(make):
    assert pii.find(make([])).count() == 0
