import hashlib

import numpy as np
import pytest
from oracle import check_oracle

from ridgeline.llm import centroids as K
from ridgeline.llm import vector_codes as C
from ridgeline.llm import vectors as V
from ridgeline.llm.common import written

ROWS = "vec_id long, embedding array<float>, label int"


def vectors(spark, rows):
    return spark.createDataFrame(rows, ROWS)


def some(n, dims=64, seed=1, spread=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 0.3, (5, dims))
    return [(i, (centres[i % 5] + rng.normal(0, 0.05 * spread, dims)).astype(np.float32).tolist(), i % 3 if i % 7 else None) for i in range(n)]


def plain_codes(rows, parts, entries, rounds, scale, dims):
    """Lloyd over all parts in every round, in Python integers."""
    kept = sorted((i, [int(np.floor(scale * float(c))) for c in v], lab) for i, v, lab in rows)
    width = dims // parts
    cut = [[x[p * width : (p + 1) * width] for p in range(parts)] for _, x, _ in kept]
    books = [[list(cut[e][p]) for e in range(min(entries, len(kept)))] for p in range(parts)]

    def near(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            got = {}
            for row in cut:
                got.setdefault(near(row[p], books[p])[1], []).append(row[p])
            for e, members in got.items():
                books[p][e] = [sum(c) // len(members) for c in zip(*members)]
    out = []
    for (i, _, lab), row in zip(kept, cut):
        best = [near(row[p], books[p]) for p in range(parts)]
        out.append((i, "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best), lab))
    return out, books


def plain_clusters(rows, k, rounds, scale):
    kept = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), i, [int(np.floor(scale * float(c))) for c in v]) for i, v, _ in rows)
    centres = [list(x) for _, _, x in kept[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), e) for e, c in enumerate(centres))

    for _ in range(rounds):
        got = {}
        for _, _, x in kept:
            got.setdefault(near(x)[1], []).append(x)
        for e, members in got.items():
            centres[e] = [sum(c) // len(members) for c in zip(*members)]
    return sorted((i, near(x)[1], near(x)[0]) for _, i, x in kept), centres


@pytest.mark.parametrize("query", [(C.op11_vector_codes, C.OP11_SQL), (K.op13_centroids, K.OP13_SQL)], ids=["op11", "op13"])
def test_oracle(spark, sf, query):
    check_oracle(spark, *query, sf)


def test_codes_equal_a_plain_iteration(spark):
    rows = some(150, 8)
    want, books = plain_codes(rows, 4, 6, 5, 100, 8)
    for n in (1, 7):
        got, found, moved = C.compress(vectors(spark, rows).repartition(n), 4, 6, 5, 100, 8)
        assert sorted((r.vec_id, r.code, r.error, r.label) for r in got.collect()) == want
        assert found.tolist() == books
        assert len(moved) <= 5
    sums = {}
    for _, _, e, lab in want:
        sums[lab] = sums.get(lab, 0) + e
    for most in (100, 0):  # broadcast and salted
        assert {(r.label, r.label_error) for r in C.with_label_error(got, "label", most).collect()} == set(sums.items())
        assert C.with_label_error(got, "label", most).count() == 150


def test_only_changes_are_shuffled_and_rounds_end(spark):
    rows = [(i, [float(i % 4)] * 8, 0) for i in range(200)]
    out, books, moved = C.compress(vectors(spark, rows), 4, 4, 50, 16, 8)
    assert moved[-1] == 0 and len(moved) < 6  # settled long before round 50
    assert {r.error for r in out.collect()} == {0} and sorted(books[0][:, 0].tolist()) == [0, 16, 32, 48]


def test_moves_keep_sums_exact():
    rng = np.random.default_rng(0)
    x, old, moves = rng.integers(-9, 9, (500, 3)), np.full(500, -1), V.Moves(1, 4, 3)
    for _ in range(6):
        new = rng.integers(0, 4, 500)
        at = np.flatnonzero(new != old)
        moves.add(0, old[at], new[at], x[at])
        old = new
    for e in range(4):
        assert moves.n[0, e] == (old == e).sum() and (moves.sums[0, e] == x[old == e].sum(0)).all()


def test_large_components_stay_exact():
    x = np.array([[V.MOST, -V.MOST], [V.MOST - 1, 5]], np.int64)
    c = np.array([[-V.MOST, V.MOST], [0, 0]], np.int64)
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(u, w)) for w in c] for u in x]
    assert V.squared_distances(x, c).tolist() == want


def test_clusters_equal_plain_rounds_and_scan_less(spark):
    rows = some(600, 64)
    want, centres = plain_clusters(rows, 12, 8, 1024)
    for n in (1, 5):
        out, found, passes = K.cluster_vectors(vectors(spark, rows).repartition(n), 12, 8)
        assert sorted((r.vec_id, r.cluster, r.distance) for r in out.collect()) == want
        assert found.tolist() == centres
    assert passes[0]["scans"] == 600 * 12
    assert sum(p["scans"] for p in passes[1:]) < 0.5 * 600 * 12 * len(passes[1:])


def test_search_sees_ties_and_never_skips_wrongly():
    rng = np.random.default_rng(3)
    for trial in range(60):
        k = int(rng.integers(1, 9))
        x = rng.integers(-3, 4, (80, 2)).astype("<i4")  # a coarse lattice: many ties
        centres = rng.integers(-3, 4, (k, 2)).astype(np.int64)
        at = K.Lists.of(centres, centres)
        cluster, upper, lower, _ = K.search(x, np.full(80, -1), np.empty(0), np.empty(0), at)
        for _ in range(5):
            before, centres = centres, centres + rng.integers(-1, 2, (k, 2))
            cluster, upper, lower, _ = K.search(x, cluster, upper, lower, K.Lists.of(centres, before))
            d = V.squared_distances(x, centres)
            assert (cluster == d.argmin(axis=1)).all()
            assert (upper**2 >= d.min(axis=1) * (1 - 1e-9)).all()


@pytest.mark.parametrize("run", [lambda df: C.compress(df)[0], lambda df: K.cluster_vectors(df)[0]], ids=["op11", "op13"])
def test_edges(spark, run):
    good = [(i, [0.01 * ((i * 7 + j) % 11) for j in range(64)], i % 2) for i in range(30)]
    odd = [
        (100, None, 1), (101, [], 1), (102, [0.5] * 63, 1), (103, [0.5] * 63 + [None], 1), (104, [0.5] * 63 + [float("nan")], 1),
        (105, [0.5] * 63 + [float("inf")], None), (None, [0.1] * 64, None), (29, good[29][1], 1), (29, good[29][1], 1), (106, [3e38] * 64, 2),
    ]
    rows = run(vectors(spark, good + odd)).collect()
    assert sorted(str(r.vec_id) for r in rows) == sorted([*map(str, range(30)), "None", "29", "29", "106"])
    assert len({tuple(r)[1:] for r in rows if r.vec_id == 29}) == 1
    clash = vectors(spark, good + odd).selectExpr("*", "'y' AS x", "'c' AS code", "1 AS cluster", "2 AS part", "'e' AS error", "'n' AS n")
    assert sorted(map(repr, run(clash).collect())) == sorted(map(repr, rows))
    assert run(vectors(spark, [])).count() == 0
    assert run(vectors(spark, [(None, [0.1] * 64, None)])).count() == 1
    few = run(vectors(spark, good[:3])).collect()
    assert len(few) == 3


def test_query_edges(spark, tmp_path):
    for name, rows in (("empty", []), ("few", [(i, [float(i)] * 64, None) for i in range(3)])):
        vectors(spark, rows).write.parquet(f"{tmp_path}/{name}/embeddings.parquet")
        for q in (C.op11_vector_codes, K.op13_centroids):
            assert q(spark, f"{tmp_path}/{name}").count() == len(rows)
    got = K.op13_centroids(spark, f"{tmp_path}/few").collect()
    assert {r.inertia for r in got} == {0} and len({r.centroid_sha256 for r in got}) == 3


def test_packed_columns_survive_slices(spark):
    import pyarrow as pa

    x = np.arange(24, dtype="<i4").reshape(6, 4)
    assert (V.unpacked(V.packed(x).slice(2, 3), "<i4", 4) == x[2:5]).all()
    assert V.unpacked(pa.array([], pa.binary()), "<i4", 4).shape == (0, 4)
    again = written(spark.createDataFrame([(bytes(x[0]),)], "x binary"), "packed").collect()
    assert np.frombuffer(again[0].x, "<i4").tolist() == [0, 1, 2, 3]
