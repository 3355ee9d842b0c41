import random
import re
import string

import numpy as np
from edges import check_edges, documents
from timing import growth

from ridgeline.llm import secrets as S


def test_held_out_findings():
    forest = S.learn(S.labelled_findings(3000, seed=1))
    rest = S.labelled_findings(1500, seed=2)
    score = forest.score(np.array([S.features(*f[:5]) for f in rest]))
    y = np.array([f[5] for f in rest])
    right = ((score >= 0.5) == y).mean()
    print("accuracy", right)
    assert right >= 0.95


def test_planted_tokens_of_the_table(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = S.op10_secrets(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = {m.start(1) for m in re.finditer(r'token = "([0-9a-f]{40})"', texts[r.doc_id])}
        assert want <= {f.start for f in r.findings}
        assert r.n_secrets == len(r.findings) <= r.n_candidates
    assert sum(r.n_secrets > 0 for r in rows) < len(rows) / 10


def test_false_positives_go():
    forest = S.learn()
    texts = ["commit 9fceb02d0ae598e95dc970b74767f19372d61af8 fixed", "password = changeme", "id=123e4567-e89b-12d3-a456-426614174000", "see http://www.example.com/some/long/path/here", "=" * 40]
    for t in texts:
        x = [S.features(t[a:b], *S.around(t, a, b), "", c) for a, b, c in S.candidates(t)]
        assert x and (forest.score(np.array(x)) < 0.5).all(), t


def test_chosen_passwords():
    forest, r = S.learn(), random.Random(21)
    texts = ['password = "hunter2xyz!!"'] + [f'passwd: "{"".join(r.choice(string.ascii_lowercase) for _ in range(7))}{r.randint(10, 9999)}{r.choice("!#$")}"' for _ in range(100)]
    got = 0
    for t in texts:
        x = [S.features(t[a:b], *S.around(t, a, b), "", c) for a, b, c in S.candidates(t)]
        score = forest.score(np.array(x))
        got += bool((score >= S.LEAST_SCORE).any())
        assert t != texts[0] or got == 1, score
    print("passwords found", got)
    assert got >= 95


def test_brute_force_forest():
    rng = np.random.default_rng(0)
    x = rng.random((400, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    f = S.train_forest(x, y, trees=15)
    assert ((f.score(x) >= 0.5) == y).mean() > 0.97
    walk = lambda tree, row: (lambda go: go(go, 0))(lambda go, i: tree[4][i] if tree[0][i] < 0 else go(go, tree[2][i] if row[tree[0][i]] <= tree[1][i] else tree[3][i]))
    assert np.allclose(f.score(x[:50]), [np.mean([walk(t, r) for t in f.trees]) for r in x[:50]])


def test_candidates_overlap():
    assert S.candidates(None) == S.candidates("") == S.candidates("plain words only: here") == []
    t = 'token = "' + "a1" * 20 + '"'
    assert S.candidates(t) == [(9, 49, True)]


def test_keys_inside_longer_values(spark):
    r = random.Random(8)
    pick = lambda a, k: "".join(r.choice(a) for _ in range(k))
    alnum = string.ascii_letters + string.digits
    forest, rows, keys = S.learn(), [], {}
    for k in range(40):
        aws, other, password = "AKIA" + pick(string.ascii_uppercase + string.digits, 16), pick(alnum, 40), pick(alnum, 16)
        rows += [(4 * k, f"url=https://host/v1?page=2&access_key={aws}"), (4 * k + 1, f"curl https://api.host.com/v1?page=2&token={other}&sort=asc now")]
        rows += [(4 * k + 2, f"DATABASE_URL=postgres://app:{password}@host"), (4 * k + 3, f"see https://host/v1?key={aws}&token={other}")]
        keys |= {4 * k: {aws}, 4 * k + 1: {other}, 4 * k + 2: {password}, 4 * k + 3: {aws, other}}
    texts = dict(rows)
    got = {d.doc_id: {texts[d.doc_id][f.start : f.stop] for f in d.findings} for d in S.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string"), forest).collect()}
    assert sum(len(keys[d] - got[d]) for d in keys) <= 4 and all(keys[d] <= got[d] for d in keys if d % 4 == 0), [(d, got[d]) for d in keys if keys[d] - got[d]]
    clean = ["see https://www.host.com/news?page=introduction&ref=homepage_banner", "DATABASE_URL=postgres://app:password@localhost/db", "x:" * 3000, "=a" * 3000]
    for t in clean:
        x = [S.features(t[a:b], *S.around(t, a, b), "", c) for a, b, c in S.candidates(t)]
        assert len(x) < 10 and (not x or (forest.score(np.array(x)) < 0.5).all()), t
    assert S.without_overlaps([(0, 50, 1), (20, 40, 2), (30, 60, 0), (60, 70, 0), (61, 69, 0), (70, 99, 0), (80, 90, 1)]) == [1, 3, 6]


def test_edges(spark):
    forest = S.learn(S.labelled_findings(400))
    rows = {r.doc_id: r for r in check_edges(spark, lambda d: S.scan_secrets(d, forest))}
    assert rows[3].n_candidates == rows[4].n_candidates == 0 and rows[3].max_score is None
    assert S.scan_secrets(documents(spark).drop("source"), forest).count() == 13
    table = spark.createDataFrame(S.labelled_findings(300), "value string, before string, after string, path string, assigned boolean, label int")
    assert len(S.learn_from_table(table, 200).trees) == S.TREES


def test_signed_tokens_equal_the_pattern_in_linear_time():
    pattern = re.compile(r"(?<![A-Za-z0-9])eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}")
    r = random.Random(4)
    parts = ["eyJ", "-eyJ", ".", ".", " ", "abcDEF123_", "0123456789abc", "x", "é", "-"]
    hits = 0
    for _ in range(12000):
        text = "".join(r.choice(parts) for _ in range(r.randint(1, 30)))
        want = [m.span() for m in pattern.finditer(text)]
        assert S.signed_tokens(text) == want, text
        hits += len(want)
    assert hits > 100
    for unit in ("-eyJ", "-eyJ" + "a" * 12, "-eyJabcdefghijk."):
        assert growth(S.candidates, unit * 4000, unit * 32000) < 24, unit
