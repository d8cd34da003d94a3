"""Vector codes against brute force over all entries."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerops.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    """({row number: (code, error, label error)}, digest) of rows (vec_id, vector, label), all of one length."""
    kept = [(i, v, [math.floor(1024 * float(np.float32(x))) for x in e], lab) for i, (v, e, lab) in enumerate(rows)
            if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    size = len(kept[0][2]) // 4
    ints = np.array([k[2] for k in kept], np.int64).reshape(len(kept), 4, size)
    order = sorted(range(len(kept)), key=lambda j: (kept[j][1] is None, kept[j][1] or 0, kept[j][2]))[:256]
    books = ints[order].transpose(1, 0, 2).copy()

    def assigned():
        d = np.stack([((ints[:, p, None, :] - books[p][None]) ** 2).sum(axis=2) for p in range(4)], axis=1)
        return d.argmin(axis=2), d.min(axis=2)

    for _ in range(4):
        codes, _ = assigned()
        for p in range(4):
            for e in set(codes[:, p]):
                mine = ints[codes[:, p] == e, p]
                books[p, e] = [int(s) // len(mine) for s in mine.sum(axis=0)]
    codes, errors = assigned()
    errors = errors.sum(axis=1)
    labels = {}
    for k, e in zip(kept, errors):
        labels[k[3]] = labels.get(k[3], 0) + int(e)
    digest = hashlib.sha256(",".join(str(x) for x in books.ravel()).encode()).hexdigest()
    return {k[0]: ("".join(f"{c:02x}" for c in codes[j]), int(errors[j]), labels[k[3]]) for j, k in enumerate(kept)}, digest


@pytest.fixture()
def run(spark, monkeypatch):
    def go(rows, schema=SCHEMA, extra=()):
        df = spark.createDataFrame(rows, schema).repartition(3)
        df = df.select("*", *[F.lit(1).alias(c) for c in extra])
        monkeypatch.setattr(V, "read_table", lambda *_: df)
        return V.op11_vector_codes(spark, "").collect()

    return go


def random_rows(n, dim=16, seed=1, clusters=20):
    pick = np.random.default_rng(seed)
    centres = pick.normal(size=(clusters, dim)) * 0.3
    values = (centres[pick.integers(clusters, size=n)] + pick.normal(size=(n, dim)) * 0.05).astype(np.float32)
    return [(int(i), v.tolist(), None if i % 11 == 0 else int(i % 3)) for i, v in zip(pick.permutation(n), values)]


def test_random_vectors_equal_brute_force(run):
    rows = random_rows(900)
    want, digest = brute(rows)
    got = {r.vec_id: r for r in run(rows)}
    assert len(got) == 900
    for i, (v, _, _) in enumerate(rows):
        assert (got[v].code, got[v].error, got[v].label_error) == want[i] and got[v].codebooks_sha256 == digest


def test_ties_copies_and_few_vectors(run):
    grid = [(i, [float(i % 2), 0.0, float(i // 2 % 2), 0.5, 0.0, 0.0, 1.0, -1.0], i % 2) for i in range(40)]
    want, digest = brute(grid)
    got = {r.vec_id: r for r in run(grid)}
    assert all((got[i].code, got[i].error, got[i].label_error) == want[i] for i in range(40))
    assert got[0].codebooks_sha256 == digest


def test_odd_rows(run):
    rows = random_rows(300, dim=8, seed=4)
    rows += [(1000, None, 1), (1001, [float("nan")] * 8, 1), (1002, [1.0, None] * 4, 1), (1003, [float("inf")] + [0.0] * 7, 2),
             (None, [0.25] * 8, None), (None, [0.25] * 8, None), (5, [0.5] * 8, 1), (5, [0.5] * 8, 1)]
    want, digest = brute(rows)
    rows += [(2000, [1.0] * 6, 1), (2001, [], 1), (2002, [1e30] * 8, 1), (2003, [3e5] * 12, 9)]
    got = run(rows, extra=("code", "error", "part", "_label", "sums", "dim", "count"))
    assert len(got) == len(want) + 4
    assert sorted((r.code, r.error, r.label_error) for r in got if r.code) == sorted(want.values())
    assert {r.codebooks_sha256 for r in got} == {digest}
    misfits = {r.vec_id: r for r in got if r.code is None}
    assert set(misfits) == {2000, 2001, 2002, 2003} and misfits[2000].error is None
    assert misfits[2000].label_error == next(w[2] for i, w in want.items() if rows[i][2] == 1)


def test_no_rows(run):
    assert run([]) == []
    assert run([(1, None, 1)]) == []
    assert [r.code for r in run([(1, [1.0, 2.0, 3.0], 1)])] == [None]


def test_large_components(run):
    rows = [(i, [float((i * 37 + j * 101) % 1000 * 100 - 50_000) for j in range(8)], 0) for i in range(300)]
    want, digest = brute(rows)
    got = {r.vec_id: r for r in run(rows, "vec_id long, embedding array<double>, label long")}
    assert all((got[i].code, got[i].error, got[i].label_error) == want[i] for i in range(300))


def test_pivots_prune_and_stay_exact():
    pick = np.random.default_rng(2)
    centres = pick.integers(-800, 800, size=(40, 16))
    book = centres[pick.integers(40, size=256)] + pick.integers(-30, 30, size=(256, 16))
    book[17] = book[200]  # a tie
    points = np.concatenate([centres[pick.integers(40, size=1500)] + pick.integers(-30, 30, size=(1500, 16)), book[200:201]])
    pivots = V.choose_pivots(book)
    away = V.distances(points, pivots).astype(np.float32).astype(np.float64)
    code, error, pairs = V.nearest(points, away, book, V.distances(book, pivots))
    full = ((points[:, None, :] - book[None]) ** 2).sum(axis=2)
    assert (code == full.argmin(axis=1)).all() and (error == full.min(axis=1)).all() and code[-1] == 17
    assert pairs < 0.25 * full.size


def test_query_equals_brute_force_on_the_whole_table(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    want, digest = brute(rows)
    got = {r.vec_id: r for r in V.op11_vector_codes(spark, sf_dir).collect()}
    assert len(got) == len(want) == len(rows)
    assert all((got[r[0]].code, got[r[0]].error, got[r[0]].label_error) == want[i] for i, r in enumerate(rows))
    assert {r.codebooks_sha256 for r in got.values()} == {digest}
