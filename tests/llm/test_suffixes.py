import hashlib

import pytest

from episodica.llm import suffixes


def brute(rows, t=100):
    """Removed spans judged window by window; rows of one id and text are one document."""
    seen, out = {}, {}
    for key in sorted({(i if i is not None else -(1 << 63), x or "") for i, x in rows}):
        raw = key[1].encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - t + 1):
            w = raw[p : p + t]
            if w in seen:
                gone[p : p + t] = b"\1" * t
            else:
                seen[w] = key
        spans = sum(1 for p in range(len(raw)) if gone[p] and (p == 0 or not gone[p - 1]))
        left = bytes(c for c, g in zip(raw, gone) if not g)
        out[key] = (len(raw), sum(gone), spans, hashlib.sha256(left).hexdigest())
    return out


def check(make, rows):
    got = suffixes.remove_repeats(make(rows)).collect()
    want = brute(rows)
    texts = {}
    for i, x in rows:
        texts.setdefault(i, []).append(want[(i if i is not None else -(1 << 63), x or "")])
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) in texts[r.doc_id]
        assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256


def cases(prose):
    passage = prose(7, 60)
    rows = [(i, prose(100 + i, 30) + " " + passage + " " + prose(200 + i, 30)) for i in range(12)]
    rows += [(20, "ab" * 400), (21, "a" * 350), (22, passage), (23, passage[:99]), (24, passage[:100]), (25, passage + passage)]
    return rows


def test_equals_brute_force(make, prose):
    check(make, cases(prose))


def test_large_groups_are_dealt_by_window(make, prose, monkeypatch):
    monkeypatch.setattr(suffixes, "GROUP_ROWS", 3)
    check(make, cases(prose))


def test_without_broadcast(make, prose, monkeypatch):
    import episodica.llm.shared as shared
    monkeypatch.setattr(shared, "BROADCAST_ROWS", 1)
    monkeypatch.setattr(suffixes, "BROADCAST_ROWS", 1)
    check(make, cases(prose))


def test_odd_rows(make, odd):
    check(make, odd)


def test_empty_table(make):
    assert suffixes.remove_repeats(make([])).count() == 0


def test_threshold_bounds(make):
    with pytest.raises(ValueError):
        suffixes.remove_repeats(make([]), threshold=30)
