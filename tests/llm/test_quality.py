import collections
import math
import re

from episodica.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    t = text or ""
    w = WORD.findall(t)
    seen = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    covered = {k + d for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for d in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def fields(r):
    return r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words


def test_counts_and_base_rules(make, odd, prose):
    rows = odd + [(20, "a b c a b c"), (21, "a b c d a b c\nx\nx\n \n"), (22, "# $ <b> |"), (23, "x y " * 60), (24, prose(4, 49)), (25, prose(4, 50)),
                  (26, "one two three " * 200 + prose(8, 900))]
    got = quality.assess(make(rows)).collect()
    assert len(got) == len(rows)
    assert collections.Counter(map(fields, got)) == collections.Counter(counts(x) for _, x in rows)
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)


def test_distances(make, prose):
    rows = [(k, prose(k, 150)) for k in range(30)] + [(50, "@@@ ### 123 " * 40 + prose(70, 20)), (51, "zzz" + " qqqx" * 0 + " ".join(f"vv{k}kk" for k in range(150)))]
    docs = make(rows)
    refs = quality.references(docs)
    assert set(refs) == {"en"} and math.isclose(sum(refs["en"][0]), 1) and math.isclose(sum(refs["en"][1]), 1)
    got = {r.doc_id: r for r in quality.assess(docs).collect()}
    text = dict(rows)[0]
    classes = [sum(1 for c in text if re.match(p, c)) for p in ("[a-z]", "[A-Z]")]
    p = [classes[0], classes[1], 0, sum(c.isdigit() for c in text), text.count(" "), 0, 0]
    p = [x / sum(p) for x in p]
    q = refs["en"][0]
    m = [(a + b) / 2 for a, b in zip(p, q)]
    kl = lambda a: sum(x * math.log2(x / y) for x, y in zip(a, m) if x)
    assert abs(got[0].class_distance - math.sqrt(max(0, (kl(p) + kl(q)) / 2))) < 1e-4
    assert got[0].kept and got[50].class_distance > got[0].class_distance
    assert got[51].word_distance == 1.0 and not got[51].kept


def test_filter_keeps_columns_and_rows(make, odd, prose):
    docs = make(odd + [(30, prose(11, 200)), (30, prose(11, 200)), (None, prose(12, 200))])
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    judged = [r.doc_id for r in quality.assess(docs).collect() if r.kept]
    assert sorted(map(str, judged)) == sorted(str(r.doc_id) for r in kept.collect())
    assert judged.count(30) == 2


def test_native_plan(make, odd):
    for df in (quality.assess(make(odd)), quality.keep_good(make(odd))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def test_empty_table(make):
    assert quality.assess(make([])).count() == 0 and quality.keep_good(make([])).count() == 0


def test_other_languages_and_scripts_pass_on_the_basic_rules(make, prose):
    import random

    rng = random.Random(1)
    russian = lambda n: " ".join("".join(rng.choice("абвгдежзиклмнопрстуя") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    rows = [(k, russian(180), "ru" if k % 2 else None) for k in range(40)]
    rows += [(100 + k, prose(k, 150), "en") for k in range(40)]
    rows += [(200, "zq xv " * 10 + " ".join(f"qx{k}zv" for k in range(150)), "pl"), (201, "zq xv " * 10 + " ".join(f"qx{k}zv" for k in range(150)), "en")]
    kept = {r.doc_id: r.kept for r in quality.assess(make(rows)).collect()}
    assert all(kept[k] for k in range(40)) and kept[200] and not kept[201]
    assert {r.doc_id for r in quality.keep_good(make(rows)).collect()} == {k for k, v in kept.items() if v}
