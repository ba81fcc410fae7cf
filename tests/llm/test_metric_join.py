import math
import random

import numpy as np
import pytest

from tillcast.llm.metric_join import cells, metric_components

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, least=0.98):
    def fit(r):
        e = r[1]
        return (
            r[2] is not None and e and all(x is not None and math.isfinite(x) for x in e) and any(e)
        )

    ids, n = list(range(len(rows))), len(rows)
    links = [set() for _ in rows]
    for i in range(n):
        for j in range(i):
            a, b = rows[i], rows[j]
            if not (fit(a) and fit(b)) or a[2] != b[2] or len(a[1]) != len(b[1]):
                continue
            x, y = (np.array(r[1], np.float32).astype(float) for r in (a, b))
            if x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= least:
                links[i].add(j)
                links[j].add(i)
    seen = {}
    for start in ids:
        if start not in seen:
            group, todo = {start}, [start]
            while todo:
                for k in links[todo.pop()] - group:
                    group.add(k)
                    todo.append(k)
            known = [rows[k][0] for k in group if rows[k][0] is not None]
            for k in group:
                seen[k] = min(known, default=None)
    return sorted(
        ((r[0], len(links[i]), seen[i], r[0] == seen[i]) for i, r in enumerate(rows)), key=repr
    )


def found(spark, rows, **options):
    result = metric_components(spark.createDataFrame(rows, SCHEMA), **options).collect()
    return sorted((tuple(r) for r in result), key=repr)


@pytest.mark.parametrize("options", [{}, {"cell_rows": 12, "pivots": 30, "block": 16}])
def test_same_as_brute_force(spark, options):
    rng = random.Random(3)
    rows = []
    for i in range(260):
        if rows and rng.random() < 0.6:
            base = rng.choice(rows)
            vector = [x + rng.gauss(0, 0.07) for x in base[1]]
            rows.append((i, vector if rng.random() < 0.8 else base[1], base[2]))
        else:
            rows.append((i, [rng.gauss(0, 1) for _ in range(6)], rng.randrange(3)))
    rows += [(300 + i, [1.0, 1.0, 0.0, 0.0, 0.0, 0.0], 1) for i in range(40)]
    expected = brute([(a, np.float32(b).tolist(), c) for a, b, c in rows])
    assert found(spark, rows, **options) == expected
    assert len({r[2] for r in expected}) > 20


def test_edges(spark):
    rows = [
        (0, None, 1), (1, [], 1), (2, [0.0, 0.0], 1), (3, [float("nan"), 1.0], 1),
        (4, [float("inf"), 1.0], 1), (5, [None, 1.0], 1), (6, [1.0, 0.0], None),
        (7, [1.0, 0.0], 1), (8, [2.0, -0.0], 1), (8, [1.0, 0.0], 1), (9, [1.0, 0.0, 0.0], 1),
        (10, [1.0, 0.0], 2), (None, [1.0, 0.0], 1), (None, [5.0, 5.0], 2), (None, None, None),
        (11, [3e38, 0.0], 1),
    ]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == []


def test_clashing_columns(spark):
    vectors = spark.createDataFrame([(1, [1.0, 2.0], 1), (2, [1.0, 2.0], 1)], SCHEMA)
    for name in ("node", "n", "v1", "size", "cell", "root"):
        vectors = vectors.withColumn(name, vectors.vec_id)
    assert sorted(r.n_links for r in metric_components(vectors).collect()) == [1, 1]


def test_cells_miss_no_link():
    rng = np.random.default_rng(1)
    points = rng.normal(size=(400, 5))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    home, within = cells(points[:20], points, 0.2)
    near = np.linalg.norm(points[:, None] - points[None], axis=2) <= 0.2
    assert all(within[j, home[i]] for i, j in np.argwhere(near))
    assert within.mean() < 0.5
