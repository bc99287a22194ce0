import math
import random

import numpy as np
import pytest

from tallyloom.llm import ann, vecdedup
from tallyloom.llm.scratch import Scratch

SCHEMA = "vec_id long, embedding array<float>, label int, score double, rep string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, lab, 1.0, "x") for i, v, lab in rows], SCHEMA)


def planted(seed=4, dim=16):
    rng = np.random.default_rng(seed)
    rows = []
    for centre in rng.standard_normal((12, dim)):
        label = int(rng.integers(3))
        for _ in range(25):
            v = centre + rng.standard_normal(dim) * rng.choice([0.05, 0.2, 0.35])
            rows.append((v * rng.choice([0.5, 1, 3])).astype(np.float32).tolist())
    rows = [(i, v, i % 3 if i % 5 else 1) for i, v in enumerate(rows)]
    rows += [(1000 + i, rows[7][1], 1) for i in range(40)]  # copies
    bad = [None, [], [0.0] * dim, [float("nan")] + [1.0] * (dim - 1), [float("inf")] + [1.0] * (dim - 1), [None] + [1.0] * (dim - 1)]
    rows += [(2000 + i, v, 1) for i, v in enumerate(bad)]
    rows += [(3000, rows[7][1], None), (3001, [1.0, 2.0], 1), (3002, [2.0, 4.0], 1), (3003, [5.0], 1), (3004, [7.0], 1)]
    random.Random(1).shuffle(rows)
    return rows


def fine(v):
    return bool(v) and None not in v and np.isfinite(v).all() and np.any(v)


@pytest.mark.parametrize("block", [2000, 9])
def test_links_and_components(spark, monkeypatch, block):
    monkeypatch.setattr(vecdedup, "BLOCK", block)
    rows = planted()
    rows += rows[:20]  # repeated rows
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vecdedup.near_duplicate_vectors(table(spark, rows), target=1.0).collect()}
    rows = list({r[0]: r for r in rows}.values())
    good = [(i, np.array(v, float), lab) for i, v, lab in rows if fine(v) and lab is not None]
    near = {i: set() for i, *_ in rows}
    for i, v, a in good:
        for j, w, b in good:
            if i != j and a == b and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.93:
                near[i].add(j)
    root = {}
    for start in sorted(near):
        todo = [start]
        while todo:
            x = todo.pop()
            if x not in root:
                root[x] = start
                todo += near[x]
    assert sum(map(len, near.values())) > 2000
    assert got == {i: (len(near[i]), root[i], root[i] == i) for i in near}


def test_multi_sequence_visits_by_sum():
    rng = np.random.default_rng(0)
    a, b = rng.random(6), rng.random(5)
    sums = [a[i] + b[j] for i, j in vecdedup.multi_sequence(a, b, 1.2)]
    assert sums == sorted(sums) and len(sums) == (a[:, None] + b[None] <= 1.2).sum()


def test_recall_and_share_of_pairs_compared(spark):
    """Clusters whose links spread down to the threshold: recall, no link below it, and how many pairs met."""
    rng = np.random.default_rng(2)
    base = rng.standard_normal((1500, 32))
    near = base[:500] + rng.standard_normal((500, 32)) * (rng.random((500, 1)) * 0.45)
    x = np.concatenate([base, near]).astype(np.float32)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    got = sum(r.n_links for r in vecdedup.near_duplicate_vectors(table(spark, rows)).collect()) / 2
    u = x.astype(np.float64) / np.sqrt((x.astype(np.float64) ** 2).sum(1, keepdims=True))
    want = (np.triu(u @ u.T, 1) >= 0.93).sum()
    assert 0.98 * want <= got <= want and want > 150
    grid = vecdedup.Grid(u, math.ceil(vecdedup.GROWTH * len(u) ** 0.25), 0.93, 0.998)
    own, visits = grid.cells(u)
    size = np.bincount(own, minlength=own.max() + 1)
    met = sum(size[c] for v in visits for c in v if c <= own.max())
    assert met / (len(u) * (len(u) + 1) / 2) < 0.3


def test_rows_that_share_an_id_are_judged_by_their_vectors(spark):
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.01], 1), (2, [0.0, 1.0], 1), (2, [0.0, 1.0], 1), (4, [0.0, 1.0], 1)]
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in vecdedup.near_duplicate_vectors(table(spark, rows)).collect())
    assert got == [(1, 1, 1, True), (2, 1, 1, False), (2, 1, 2, True), (2, 1, 2, True), (4, 1, 2, False)]


def test_nearest_by_inner_product(spark, monkeypatch):
    monkeypatch.setattr(ann, "CANDIDATE_BLOCK", 120)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 7)
    rows = planted(seed=8)
    got = {}
    for r in ann.nearest(table(spark, rows), "vec_id % 20 = 0", k=20).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    good = [(i, np.array(v, np.float64)) for i, v, _ in rows if fine(v)]
    hits = total = 0
    for q, x in good:
        if q % 20 == 0:
            best = sorted((-float(x @ y), i) for i, y in good if i != q and len(x) == len(y))[:20]
            mine = got.get(q, [])
            assert len(mine) == len(best) and mine == sorted(mine, key=lambda m: (-m[1], m[0]))
            hits += len({i for i, _ in mine} & {i for _, i in best})
            total += len(best)
    assert hits / total > 0.98


def test_repeats_of_a_row_leave_places_for_others(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(8).tolist(), 0) for i in range(30)]
    rows += [(30, [9 * v for v in rows[0][1]], 0)] * 25
    got = ann.nearest(table(spark, rows), "vec_id = 0", k=20).collect()
    assert len(got) == 20 and sorted(r.rank for r in got) == list(range(1, 21)) and len({r.vec_id for r in got}) == 20


def test_bounds_hold_and_estimates_are_unbiased():
    rng = np.random.default_rng(6)
    x, y = rng.standard_normal((4000, 40)) * rng.uniform(0.2, 5, (4000, 1)), rng.standard_normal((30, 40))
    turn = ann.rotation(40)
    value, reach = ann.estimates(*ann.encode(x, turn), *ann.quantise(y, turn), np.sqrt((y * y).sum(1)))
    exact = y @ x.T
    scale = np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1))[:, None]
    assert abs(((value - exact) / scale).mean()) < 2e-3
    assert (reach < exact).mean() < 1e-3 and ((reach - exact) / scale).mean() < 0.3


def test_more_equal_vectors_than_neighbours(spark):
    """Sixty copies, some of them queries, and a near one: ties go to the smallest ids, the own row left out."""
    rows = [(i, [1.0, 2.0, 2.0], 0) for i in range(60)] + [(60, [2.0, 4.0, 4.1], 0), (61, [-1.0, 0.0, 0.0], 0)]
    got = {}
    for r in ann.nearest(table(spark, rows), "vec_id % 20 = 0", k=5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {0: [60, 1, 2, 3, 4], 20: [60, 0, 1, 2, 3], 40: [60, 0, 1, 2, 3], 60: [0, 1, 2, 3, 4]}


def test_neighbours_in_clusters_leave_cells_out(spark):
    rng = np.random.default_rng(9)
    centres = rng.standard_normal((40, 24)) * 3
    x = (centres[rng.integers(40, size=4000)] + rng.standard_normal((4000, 24))).astype(np.float32)
    rows, met, save = [(i, v.tolist(), 0) for i, v in enumerate(x)], {}, Scratch.save

    def counted(self, df, name, **more):
        out = save(self, df, name, **more)
        if name == "visits":
            met["visits"] = out.selectExpr("explode(cells)").count()
        if name == "cells":
            met["cells"] = out.select("cell", "level").distinct().count()
        return out

    Scratch.save = counted
    try:
        got = ann.nearest(table(spark, rows), "vec_id % 100 = 0", k=20).collect()
    finally:
        Scratch.save = save
    wide = x.astype(np.float64)
    hits = 0
    for q in range(0, 4000, 100):
        score = wide @ wide[q]
        score[q] = -np.inf
        best = set(np.argsort(-score)[:20].tolist())
        hits += len(best & {r.vec_id for r in got if r.query_id == q})
    assert hits / (40 * 20) > 0.99
    assert met["visits"] < 0.5 * 40 * met["cells"]


def test_empty_tables(spark):
    empty = table(spark, [])
    assert vecdedup.near_duplicate_vectors(empty).count() == 0
    assert ann.nearest(empty, "vec_id % 20 = 0").count() == 0
    nothing = table(spark, [(1, None, 1), (None, [1.0], 1)])
    assert vecdedup.near_duplicate_vectors(nothing).where("n_links = 0").count() == 2
    assert ann.nearest(nothing, "true").count() == 0


def test_no_neighbour_is_lost_where_scores_are_near_zero(spark):
    """Queries orthogonal to every candidate but for rounding: floors are near zero, and many scores tie with them."""
    rng = np.random.default_rng(3)
    plane, rest = rng.standard_normal((400, 8)), rng.standard_normal((40, 8))
    turn = np.linalg.qr(rng.standard_normal((16, 16)))[0]
    x = (np.hstack([plane, np.zeros((400, 8))]) @ turn).astype(np.float32)
    y = (np.hstack([np.zeros((40, 8)), rest]) @ turn).astype(np.float32)
    rows = [(1000 + i, v.tolist(), 1) for i, v in enumerate(x)] + [(i, v.tolist(), 1) for i, v in enumerate(y)]
    got = {}
    for r in ann.nearest(table(spark, rows), "vec_id < 40", k=20).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    all_ = {i: np.array(v, np.float32).astype(np.float64) for i, v, _ in rows}
    for q in range(40):
        scores = {i: float(ann.inner_products(v[None], all_[q][None])[0]) for i, v in all_.items() if i != q}
        assert got[q] == sorted(scores.items(), key=lambda m: (-m[1], m[0]))[:20]


def test_rows_under_one_id_widen_only_its_own_search(spark):
    rng = np.random.default_rng(6)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(rng.standard_normal((300, 16)).astype(np.float32))]
    rows += [(0, (8 * v).tolist(), 1) for v in rng.standard_normal((60, 16)).astype(np.float32)]
    got = {}
    for r in ann.nearest(table(spark, rows), "vec_id in (0, 1)", k=20).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert len(got[1]) == 20 and 0 in got[1] and 0 not in got[0]


def test_candidates_travel_as_codes(spark):
    rows = spark.createDataFrame([(i, i, 8, [float(i + j) for j in range(8)]) for i in range(5)], "row long, vec_id long, dim int, embedding array<float>")
    assert not {"embedding", "vec_id"} & set(ann.placed(rows, {}).columns)


def test_byte_codes_bound_their_error():
    rng = np.random.default_rng(9)
    x, y = rng.standard_normal((500, 32)) * 10.0 ** rng.integers(-6, 7, (500, 1)), rng.standard_normal((500, 32))
    fine, step, left = ann.byte_codes(x)
    about = (fine * step[:, None] * y).sum(1)
    assert (np.abs(about - (x * y).sum(1)) <= left * np.sqrt((y * y).sum(1)) * (1 + 1e-9)).all()
    assert (left < 0.03 * np.sqrt((x * x).sum(1))).all()


def test_codes_leave_few_pairs_open_and_travel_once_to_a_tile(spark, monkeypatch):
    """Many labels and tiles: links as by brute force, rows sent for each vector, and pairs verified on their vectors."""
    monkeypatch.setattr(vecdedup, "TILE", 60)
    rng = np.random.default_rng(12)
    base = rng.standard_normal((900, 24))
    near = base[:300] + rng.standard_normal((300, 24)) * (rng.random((300, 1)) * 0.45)
    x = np.concatenate([base, near]).astype(np.float32)
    label = np.arange(len(x)) % 3
    written, save = {}, Scratch.save

    def counted(self, df, name, **more):
        out = save(self, df, name, **more)
        if name == "cells":
            written["tiles"] = out.select("tile").distinct().count()
            written["sent"] = out.selectExpr("sum(size(visits))").first()[0]
            written["cells"] = out.selectExpr("sum(aggregate(visits, 0, (n, v) -> n + size(v.cells)))").first()[0]
            assert "embedding" not in out.columns
        if name == "found":
            written["open"] = out.where("n < 0").count()
        return out

    monkeypatch.setattr(Scratch, "save", counted)
    got = sum(r.n_links for r in vecdedup.near_duplicate_vectors(table(spark, [(i, v.tolist(), int(label[i])) for i, v in enumerate(x)])).collect()) / 2
    u = x.astype(np.float64) / np.sqrt((x.astype(np.float64) ** 2).sum(1, keepdims=True))
    want = (np.triu(u @ u.T, 1) >= 0.93)[label[:, None] == label[None, :]].sum()
    assert 0.95 * want <= got <= want and want > 40
    assert written["tiles"] > 4 and written["sent"] < 0.6 * written["cells"] and written["open"] < 20


def test_pairs_that_codes_leave_open_are_verified(spark):
    """Cosines a few units of rounding about the threshold."""
    angle = math.acos(0.93)
    rows = [(0, [1.0, 0.0], 1)] + [(i, [math.cos(angle + d), math.sin(angle + d)], 1) for i, d in enumerate((-3e-6, -1e-7, 1e-7, 3e-6), 1)]
    got = {r.vec_id: r.n_links for r in vecdedup.near_duplicate_vectors(table(spark, rows), target=1.0).collect()}
    v = {i: np.array(x, np.float32).astype(np.float64) for i, x, _ in rows}
    want = {i: sum(j != i and v[i] @ v[j] / math.sqrt((v[i] @ v[i]) * (v[j] @ v[j])) >= 0.93 for j in v) for i in v}
    assert got == want
