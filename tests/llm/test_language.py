import random
import zlib

from episodica.llm import language

STEMS = {"en": "the of and to in ing tion er ed ly th wh ou sh", "fr": "le la les des eau oir eux é è tion ment qu aux ch", "de": "der die und sch ung keit ein ß ü ä ver ge zu lich"}


def text(lang, seed, n):
    rng = random.Random(f"{lang}{seed}")
    stems = STEMS[lang].split()
    return " ".join("".join(rng.choice(stems) for _ in range(rng.randint(1, 3))) for _ in range(n))


def table(make, odd):
    rows = [(100 + k, text(lang, k, 20 + k), lang) for k in range(60) for lang in STEMS]
    rows = [(i * 3 + j, x, lang) for j, lang in enumerate(STEMS) for i, x in ((k, text(lang, k, 20 + k)) for k in range(80)) ]
    return make([(10_000 + i, x, lang) for i, x, lang in rows] + [(i, x, None) for i, x in odd] + [(1, "12 %% 34", "en")])


def test_held_out_accuracy(make, odd):
    docs = table(make, odd)
    got = language.learn_and_identify(docs).collect()
    assert len(got) == docs.count()
    langs = {r.doc_id: r.lang for r in docs.collect()}
    held = [r for r in got if r.held_out and langs[r.doc_id]]
    assert held and sum(r.lang_pred == langs[r.doc_id] for r in held) >= 0.95 * len(held)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.lang_pred in {*STEMS, "und"}


def test_und(make, odd):
    docs = table(make, odd)
    for r in docs.join(language.learn_and_identify(docs), "doc_id").collect():
        if r.text is None or not any(c.isalpha() for c in r.text):
            if r.doc_id not in (4, 1):
                assert r.lang_pred == "und"
    alone = make([(1, None), (2, ""), (3, "123 %"), (4, "_ _")])
    assert {r.lang_pred for r in language.learn_and_identify(alone).collect()} == {"und"}


def test_number_signs_are_no_letters(make):
    spark = make([]).sparkSession
    rows = [(k, False, x) for k, x in enumerate(["\u00b2 \u00bd", "\u2460 \u0663", "\u216b", "x\u00b2", "\u4e2d", "\u00aa"])]
    out = language.identify(spark, spark.createDataFrame(rows, "doc_id long, held_out boolean, text string"), {"en": b"the of and"}).collect()
    assert [r.lang_pred for r in sorted(out, key=lambda r: r.doc_id)] == ["und", "und", "und", "en", "en", "en"]


def test_ties_take_the_language_that_sorts_first(make):
    spark = make([]).sparkSession
    rows = [(1, False, text("en", 3, 50)), (1, False, text("en", 3, 5000))]
    same = text("en", 1, 400).encode()
    out = language.identify(spark, spark.createDataFrame(rows, "doc_id long, held_out boolean, text string"), {"b": same, "a": same}).collect()
    assert len(out) == 2 and {(r.lang_pred, r.score, r.confident) for r in out} == {("a", 0.0, False)}


def test_only_text_decides(make):
    content = {k: text(k, "dict", 3000).encode() for k in STEMS}
    spark = make([]).sparkSession
    rows = [(k, k % 2 == 0, text("fr", 5, 60)) for k in range(6)]
    out = language.identify(spark, spark.createDataFrame(rows, "doc_id long, held_out boolean, text string"), content).collect()
    assert {(r.lang_pred, r.score) for r in out} == {("fr", out[0].score)}


def test_dictionaries_are_bounded_and_stable(make):
    rows = make([(k, text("en", k, 500), "en") for k in range(30)])
    a = language.dictionaries(rows.select("text", "lang"), pieces=5, chars=40)
    b = language.dictionaries(rows.repartition(9).select("text", "lang"), pieces=5, chars=40)
    assert a == b and len(a["en"].decode()) <= 5 * 41


def test_copies_count_once_in_a_dictionary(make):
    rows = [(k, text("en", k, 30), "en") for k in range(60)] + [(1000 + k, text("fr", k, 30), "fr") for k in range(60)]
    alone = language.dictionaries(make(rows).select("text", "lang"), pieces=40, chars=200)
    h = {r.text: r.h for r in make(rows).selectExpr("text", "xxhash64(text) AS h").collect()}
    first = min((x for _, x, lang in rows if lang == "en"), key=h.get)  # always among the chosen
    copies = rows + [(5000 + k, first, "en") for k in range(60)]
    assert language.dictionaries(make(copies).select("text", "lang"), pieces=40, chars=200) == alone
    assert len(set(alone["en"].decode().split("\n"))) == 40


def test_nothing_learned(make):
    out = language.learn_and_identify(make([(1, "some text", None)])).collect()
    assert [(r.lang_pred, r.score) for r in out] == [("und", 0.0)]
    assert language.learn_and_identify(make([])).count() == 0
