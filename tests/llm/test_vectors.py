"""Codebooks and centroids against brute force."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillomics.llm import catalog, centroids, codebooks
from tools.check import compare, connect

NAN, INF = float("nan"), float("inf")


@pytest.mark.parametrize("name", ["op11_dual_tree_codes", "op12_literal_centroids"])
def test_vector_query(spark, sf_dir, name):
    _, problem = compare(connect(sf_dir), catalog.QUERIES[name](spark, sf_dir), catalog.ORACLES[name])
    assert problem is None


def vectors(spark, rows, kind="float"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int")
    return df.withColumns({c: F.lit("clash") for c in ("v", "code", "error", "cluster", "distance", "values", "n", "__label", "__part", "entry")})


ODD = [
    (100, None, 1), (101, [1.0, None, 2.0, 3.0], 1), (102, [NAN, 0.0, 0.0, 0.0], 1), (103, [INF, 0.0, 0.0, 0.0], None),
]


# --- codebooks

def brute_codes(rows, parts, size, rounds, scale):
    """vec_id, code, error and label of the finite rows, by comparing every part with every entry."""
    kept = [(i, [int(np.floor(scale * float(x))) for x in v], l) for i, v, l in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    width = len(kept[0][1]) // parts
    cut = [[v[p * width:(p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:size]] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), j) for j, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            members = defaultdict(list)
            for c in cut:
                members[near(c[p], books[p])[1]].append(c[p])
            for j, m in members.items():
                books[p][j] = [sum(x) // len(m) for x in zip(*m)]
    out = []
    for (i, _, label), c in zip(kept, cut):
        found = [near(c[p], books[p]) for p in range(parts)]
        out.append((i, "".join(f"{j:02x}" for _, j in found), sum(d for d, _ in found), label))
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return out, digest


def fitting(x):
    """What does not fit a long is null."""
    return x if x < 1 << 63 else None


def check_codes(spark, rows, kind="float", **kw):
    kw = {"parts": 4, "size": 16, "rounds": 3, "scale": 8} | kw
    want, digest = brute_codes(rows, **kw)
    by_label = defaultdict(int)
    for _, _, e, label in want:
        by_label[label] += e
    got = codebooks.compress(vectors(spark, rows, kind), **kw).collect()
    assert sorted((r.vec_id is None, r.vec_id or 0, r.code, r.error, r.label_error, r.codebooks_sha256) for r in got) == sorted(
        (i is None, i or 0, c, fitting(e), fitting(by_label[label]), digest) for i, c, e, label in want
    )


def test_codes_of_clusters_ties_and_copies(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 16)) * 5
    rows = [(i, (centres[i % 6] + rng.normal(size=16) * (0.02 if i % 2 else 1.0)).tolist(), i % 3 or None) for i in range(400)]
    rows += [(500 + i, rows[7][1], 2) for i in range(150)]  # one vector many times: whole nodes
    rows += [rows[3], (None, rows[5][1], None)]  # a repeated row, a row without an id
    rows += [(900 + i, [float(i % 2)] * 16, 1) for i in range(40)]
    check_codes(spark, rows)


def test_codes_of_large_components(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=8) * 10.0 ** (i % 8)).tolist(), 1) for i in range(60)]
    check_codes(spark, rows, "double", size=5, scale=1024)


def test_code_edges(spark):
    rows = [*ODD, (1, [1.0, 2.0, 3.0, 4.0], 1), (2, [1.0, 2.0], None), (3, [1.0, 2.0, 3.0, 5.0], None)]
    got = {r.vec_id: r for r in codebooks.compress(vectors(spark, rows), size=2, rounds=1).collect()}
    assert set(got) == {1, 2, 3}
    assert (got[1].code, got[1].error, got[2].code, got[2].error, got[3].code) == ("00000000", 0, None, None, "00000001")
    assert got[2].label_error == 0 and got[1].label_error == 0
    nothing = codebooks.compress(vectors(spark, ODD))
    assert nothing.columns == ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"] and not nothing.collect()
    uneven = codebooks.compress(vectors(spark, [(1, [1.0, 2.0, 3.0], 1)])).collect()
    assert [(r.vec_id, r.code, r.codebooks_sha256) for r in uneven] == [(1, None, None)]


def test_whole_nodes_equal_single_comparisons():
    rng = np.random.default_rng(3)
    points = np.concatenate([rng.integers(-9, 9, (300, 3)), np.tile([[50, 50, 50]], (200, 1)), np.tile([[-60, 2, 9]], (77, 1))]).astype(np.int32)
    book = np.concatenate([points[:40], [[50, 50, 49], [-60, 2, 10]]]).astype(np.int32)
    tree = codebooks.tree_of(points, codebooks.LEAF)
    code, whole, by_row = codebooks.assign(tree, codebooks.tree_of(book, 1))
    distance = ((points[:, None].astype(int) - book[None]) ** 2).sum(-1)
    assert (by_row == distance.argmin(1)).all()
    assert len(whole) and (whole[:, 1] - whole[:, 0]).sum() > 200
    count, total = codebooks._sums(tree, code, whole, len(book))
    for j in range(len(book)):
        assert count[j] == (by_row == j).sum() and (total[j] == points[by_row == j].sum(0)).all()


# --- centroids

def brute_clusters(rows, k, rounds, dims, scale):
    kept = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v, _ in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    centres = [v for _, v in order[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centres))

    for _ in range(rounds):
        members = defaultdict(list)
        for _, v in kept:
            members[near(v)[1]].append(v)
        for j, m in members.items():
            centres[j] = [sum(x) // len(m) for x in zip(*m)]
    found = [(i, *near(v)) for i, v in kept]
    inertia = defaultdict(int)
    for _, d, c in found:
        inertia[c] += d
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted((i is None, i or 0, c, fitting(d), fitting(inertia[c]), fitting(sum(inertia.values())), names[c]) for i, d, c in found)


@pytest.mark.parametrize("scale, most", [(64, 1.0), (64, 1e6)])
def test_clusters(spark, scale, most):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=4) * most).tolist(), None) for i in range(80)]
    rows += [(7, [0.5] * 4, 1), (7, [0.5] * 4, 1), (None, [1.0, 2.0, 3.0, 4.0], None), (200, [1.0] * 5, 1), *ODD]
    got = centroids.cluster(vectors(spark, rows, "double"), k=5, rounds=3, dims=4, scale=scale).collect()
    assert sorted((r.vec_id is None, r.vec_id or 0, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in got) == brute_clusters(rows, 5, 3, 4, scale)


def test_cluster_edges(spark):
    assert not centroids.cluster(vectors(spark, ODD), dims=4).collect()
    one = centroids.cluster(vectors(spark, [(1, [1.0, 2.0], 1)]), dims=2).collect()
    assert [(r.cluster, r.distance, r.inertia) for r in one] == [(0, 0, 0)]
    # Beyond the limits of a long components count as the limit and nothing fails.
    far = centroids.cluster(vectors(spark, [(1, [1e300, 0.0], 1), (2, [-1e300, 0.0], 1), (3, [0.0, 0.0], 1)], "double"), k=1, rounds=1, dims=2).collect()
    assert len(far) == 3 and None in [r.distance for r in far]


def test_centroids_stay_in_the_jvm(spark, sf_dir):
    plan = catalog.QUERIES["op12_literal_centroids"](spark, sf_dir)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct", plan)
