"""The tokenization automaton against plain merging and against the tokenizers library."""

import hashlib
import json
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from episodica.llm import bpe
from episodica.llm.queries import op12_tokenization_automaton

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def merged(word, pairs):
    """Plain merging: the first pair by priority, everywhere from the left, again and again."""
    parts = [bytes([b]) for b in word]
    for u, v in pairs:
        out, i = [], 0
        while i < len(parts):
            if i + 1 < len(parts) and (parts[i], parts[i + 1]) == (u, v):
                out.append(u + v)
                i += 2
            else:
                out.append(parts[i])
                i += 1
        parts = out
    return parts


@pytest.mark.parametrize("seed", range(12))
def test_automaton_equals_plain_merging(seed):
    rng = random.Random(seed)
    tokens, pairs = [bytes([b]) for b in b"ab" + (b"c" if seed % 2 else b"")], []
    while len(pairs) < 12:
        u, v = rng.choice(tokens), rng.choice(tokens)
        if u + v not in tokens:
            tokens.append(u + v)
            pairs.append((u, v))
    ids = {bytes([b]): b for b in range(256)} | {u + v: 256 + k for k, (u, v) in enumerate(pairs)}
    automaton = bpe.Automaton({t: s for s, t in ids.items()}, [(ids[u], ids[v], ids[u + v]) for u, v in pairs])
    words = [bytes(rng.choice(b"abc") for _ in range(n)) for n in [0, 1, 2, 3, 5, 8, 12, 20] * 40 + [65, 90, 200]]
    found, counts = automaton.encode(words)
    expected = [[ids[p] for p in merged(w, pairs)] for w in words]
    assert found.tolist() == [t for w in expected for t in w] and counts.tolist() == [len(w) for w in expected]
    # exactly the produced neighbours are arcs
    for w in expected:
        assert all(automaton.allowed(a, b) for a, b in zip([None, *w], w))


def test_arcs_are_the_pairs_that_stay_apart():
    with open(PATH, encoding="utf-8") as file:
        spec = json.load(file)
    made = bpe.codec(PATH)
    library = Tokenizer.from_file(PATH)
    rng = random.Random(5)
    letters = {t: s for s, t in spec["model"]["vocab"].items() if s.isascii() and s.isalpha()}
    for a, b in (rng.sample(sorted(letters), 2) for _ in range(3000)):
        apart = library.encode(letters[a] + letters[b], add_special_tokens=False).ids == [a, b]
        assert made.automaton.allowed(a, b) == apart


def test_texts_equal_the_library(library):
    rng = random.Random(3)
    alphabets = ["the and ing ed ' \n\t", "éüñ漢字😀　\xa0՘​", "0123456789ⅷ²", "aaaab", "ABC<|endoftext|>", "\x00\x1c\x85 '' 's'll"]
    texts = ["", " ", "  a", "a  ", "it's they'LL 'd", "<|endoftext|>", "a <|endoftext|> b", "<|endoftext", "x" * 5000, "ab" * 3000 + "é" * 100]
    for _ in range(2000):
        pool = rng.choice(alphabets) + rng.choice(alphabets)
        texts.append("".join(rng.choice(pool) for _ in range(rng.randrange(60))) + rng.choice(["", "", "<|endoftext|> "]))
    made = bpe.codec(PATH)
    for text, ids in zip(texts, made.encode(texts)):
        assert np.frombuffer(ids, "<i4").tolist() == library.encode(text, add_special_tokens=False).ids, text
        assert made.decode(np.frombuffer(ids, "<i4").tolist()) == text


def test_split_tables_agree_where_they_are_used(library):
    made = bpe.codec(PATH)
    settled = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and bpe._SETTLED.fullmatch(chr(c))]
    texts = [f"a{c}b1{c}2 {c}{c} x.{c}" for c in settled[:: 1 if len(settled) < 5000 else 7]]
    from tokenizers import pre_tokenizers

    plain = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    for t in texts:
        assert made._words(t) == [t[i:j] for _, (i, j) in plain.pre_tokenize_str(t)]


def test_decode_of_any_ids(library):
    rng = random.Random(9)
    made = bpe.codec(PATH)
    for _ in range(500):  # broken UTF-8 included
        ids = [rng.randrange(50_257) if rng.random() < 0.5 else rng.randrange(256) for _ in range(rng.randrange(12))]
        assert made.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_rows_of_any_kind(spark, make, odd, library):
    docs = make(odd)
    rows = bpe.round_trip(docs, PATH).collect()
    assert len(rows) == len(odd)
    texts = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["text"]) for r in rows)
    assert texts == sorted((i is not None, i or 0, t or "") for i, t in odd)
    for r in rows:
        assert r["ids"] == library.encode(r["text"], add_special_tokens=False).ids
    apart = bpe.decode(bpe.encode(docs, PATH), PATH)
    assert sorted(map(str, apart.collect())) == sorted(str(r) for r in bpe.round_trip(docs, PATH).select("doc_id", "text").collect())
    assert bpe.encode(docs.limit(0), PATH).count() == 0
    assert bpe.decode(spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>"), PATH).select("text").distinct().collect()[0][0] == ""


def test_query_equals_the_library(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    expected = {}
    for r in docs:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        expected[r["doc_id"]] = (len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), text)))
    found = op12_tokenization_automaton(spark, sf_dir)
    assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert {r[0]: tuple(r[1:]) for r in found.collect()} == expected


def test_other_files_are_refused():
    with pytest.raises(ValueError):
        bpe.Codec(str(public_tokenizers.path("word_bpe_49k.json")))
