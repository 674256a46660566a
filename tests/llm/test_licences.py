import collections
import math
import re

from episodica.llm import licences as lic

TERM = re.compile(lic.TERM)


def brute(files):
    """Best licence and score of each path, from dense vectors over all lines."""
    lines = [(p, k, TERM.findall(x.lower())) for p, t in files for k, x in enumerate((t or "").split("\n"))]
    lines = [x for x in lines if x[2]]
    templates = [(n, collections.Counter(TERM.findall(x.lower()))) for n, x in lic.TEMPLATES]
    vocabulary = {w for _, t in templates for w in t}
    df = collections.Counter(w for *_, ws in lines for w in set(ws) & vocabulary)
    idf = lambda w: math.log((len(lines) + 1) / (df[w] + 1 if w in vocabulary else 1)) + 1
    vec = lambda c: {w: n * idf(w) for w, n in c.items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    best = {}
    for p, _, ws in lines:
        v = vec(collections.Counter(ws))
        for name, t in templates:
            u = vec(t)
            cos = round(sum(v.get(w, 0) * x for w, x in u.items()) / (norm(v) * norm(u)), 6)
            if cos >= lic.THRESHOLD and (-cos, name) < best.get(p, (0, "~")):
                best[p] = (-cos, name)
    return {p: (n, -s) for p, (s, n) in best.items()}


def files_of(prose):
    plain = "\n".join(prose(k, 12) for k in range(4))
    return [("/a/LICENSE", "Released under the MIT License."), ("/a/b/x.txt", plain), ("/a/b/c/y.txt", plain + "\nLicensed under the Apache License, Version 2.0!"),
            ("/a/b/c/COPYING", "This work is licensed under the GNU General Public License version 3"), ("/a/b/c/d/z.txt", plain), ("/q/w.txt", plain),
            ("/q/long.txt", "\n".join(prose(50 + k, 30) for k in range(8)) + "\nAll rights reserved."), ("/q/v.txt", "permission to reserve rights in the version"),
            ("/e/none.txt", None), ("/e/empty.txt", ""), (None, "Released under the MIT License.")] + [(f"/z/{k}.txt", prose(100 + k, 40)) for k in range(120)]


def frame(spark, rows):
    return spark.createDataFrame([(p, t, "c", 1.0) for p, t in rows], "path string, text string, licence string, score double")


def test_notices_equal_brute_force(spark, prose):
    rows = files_of(prose)
    got = {r.path: (r.licence, round(r.score, 6)) for r in lic.notices(frame(spark, [r for r in rows if r[0]])).collect()}
    assert got == brute([r for r in rows if r[0]])
    assert got["/a/b/c/y.txt"][0] == "Apache-2.0" and "/q/v.txt" not in got


def test_inheritance(spark, prose):
    got = {r.path: r for r in lic.scan(frame(spark, files_of(prose))).collect()}
    pick = {p: (got[p].licence, got[p].origin, got[p].licence_dir) for p in got}
    assert pick["/a/LICENSE"] == ("MIT", "own", None)
    assert pick["/a/b/x.txt"] == ("MIT", "inherited", "/a")
    assert pick["/a/b/c/d/z.txt"] == ("GPL-3.0", "inherited", "/a/b/c")
    assert pick["/a/b/c/y.txt"][:2] == ("Apache-2.0", "own")
    assert pick["/q/w.txt"] == (None, None, None) and pick["/q/long.txt"][0] == "proprietary"
    assert pick["/e/none.txt"] == (None, None, None) and pick[None] == (None, None, None)
    assert len(got) == len(files_of(prose))


def test_repeated_paths_and_empty(spark, prose):
    rows = files_of(prose) + [("/a/LICENSE", "Released under the MIT License.")] * 2
    assert lic.scan(frame(spark, rows)).count() == len(rows)
    assert lic.scan(frame(spark, [])).count() == 0


def test_documents_as_files(make, odd):
    out = lic.scan(lic.document_files(make(odd + [(21, "Released under the MIT License."), (7, "x")])))
    got = {r.doc_id: r for r in out.collect()}
    assert out.count() == len(odd) + 2
    assert got[21].origin == "own" and got[21].path == "/s/21.txt" and got[7].licence == "MIT"
