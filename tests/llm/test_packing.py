import collections
import os
import random
import zlib

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from episodica.llm import packing
from episodica.llm.queries import tokenizer_path


def check(make, rows, window):
    tokenizer = Tokenizer.from_file(tokenizer_path())
    want = collections.Counter()
    for i, x in rows:
        ids = np.array(tokenizer.encode(x or "", add_special_tokens=False).ids + [2], "<u4")
        want[(i, zlib.crc32(ids.tobytes()), len(ids))] += 1
    whole = {(i, n): zlib.crc32(b"") for i, _, n in want}
    got = packing.pack(make(rows), tokenizer_path(), window=window, open_windows=4).collect()
    sequences, covered = collections.defaultdict(list), collections.Counter()
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
        covered[(r.doc_id, r.doc_tokens)] += r.length
        if r.length == r.doc_tokens:
            assert (r.doc_id, r.ids_crc32, r.doc_tokens) in want
    for spans in sequences.values():
        upto = 0
        for offset, length in sorted(spans):
            assert offset == upto and length > 0
            upto += length
        assert upto <= window
    assert covered == collections.Counter({k: k[1] * sum(n for w, n in want.items() if (w[0], w[2]) == k) for k in whole})
    return got, sequences


def test_round_trip(make, prose):
    rows = [(k, prose(k, 5 + 37 * k % 400)) for k in range(150)]
    got, sequences = check(make, rows, 256)
    used = sum(r.length for r in got)
    assert used / (256 * len(sequences)) > 0.95
    tokenizer = Tokenizer.from_file(tokenizer_path())
    texts = dict(rows)
    for r in got:
        ids = np.array(tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids + [2], "<u4")
        assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32


def test_odd_rows(make, odd):
    check(make, odd, 128)


def test_special_texts_equal_the_tokenizer(make):
    rows = [(1, "a<|endoftext|>b <|startoftext|>"), (2, "ÉCOLE é é ǅ"), (3, "x\x1cy z\x85w\xa0v"), (4, "it's  DON'T 12 3.5%%% ́x")]
    check(make, rows, 64)


def test_remembered_words_are_bounded(make, prose, monkeypatch):
    encoder = packing.Encoder(tokenizer_path())
    monkeypatch.setattr(packing, "REMEMBERED", 10)
    plain = Tokenizer.from_file(tokenizer_path())
    for k in range(5):
        text = prose(k, 30)
        assert encoder.encode([text])[0] == np.array(plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert len(encoder._words) <= 40 and len(encoder._parts) <= 60


def test_encoder_equals_the_tokenizer_on_any_characters():
    rng = random.Random(2)
    plain, encoder = Tokenizer.from_file(tokenizer_path()), packing.Encoder(tokenizer_path())
    pools = ["abcXYZ01 ,.#$'<|>", "éÈßÿŒœŞşıİſŉǆªº²½×÷ ", "".join(map(chr, range(33, 0x250))) + " ", "ΣσςЖ中文ا\u0301\u200d😀 \x1c\x85\xa0\u2003\n"]
    texts = ["".join(rng.choice(pool) for _ in range(60)) for pool in pools for _ in range(300)]
    for t, got in zip(texts, encoder.encode(texts)):
        assert got == np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), repr(t)


def test_empty_table(make):
    assert packing.pack(make([]), tokenizer_path()).count() == 0


def test_tasks_of_one_worker_share_an_encoder(spark):
    path = tokenizer_path()

    def task(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([os.getpid()] * len(batch)), pa.array([id(packing.encoder(path))] * len(batch))], ["pid", "at"])

    seen = spark.range(0, 64, 1, 16).mapInArrow(task, "pid long, at long").distinct().collect()
    assert len(seen) == len({r.pid for r in seen})


def test_a_word_that_is_its_own_part_is_remembered_once():
    encoder = packing.Encoder(tokenizer_path())
    encoder.encode(["stone river garden stone"])
    kept = {id(d): d for d in (encoder._words, encoder._parts)}
    assert sorted(w for d in kept.values() for w in d if w) == ["garden", "river", "stone"]
