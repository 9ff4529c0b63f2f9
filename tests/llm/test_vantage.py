"""Clusters by the vantage-point tree against SQL and against looking at every centroid."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from matchloom.llm import queries, vantage
from oracle import connect, difference

SCHEMA = "vec_id long, embedding array<float>, label int, cluster int, id string"


def plain(vectors, count, rounds):
    """``(id, cluster, distance)`` by looking at every centroid."""
    ranked = sorted(vectors, key=lambda v: hashlib.sha256(f"1:{v[0]}".encode()).hexdigest())
    centroids = [list(v) for _, v in ranked[:count]]

    def choose(v):
        least, k = min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(centroids))
        return k, least

    for _ in range(rounds):
        own = {}
        for _, v in vectors:
            own.setdefault(choose(v)[0], []).append(v)
        for k, members in own.items():
            centroids[k] = [sum(c) // len(members) for c in zip(*members, strict=True)]
    return sorted((i, *choose(v)) for i, v in vectors), centroids


def test_query_matches_sql(spark, sf_dir):
    name = "op12_vantage_point_clusters"
    assert difference(queries.QUERIES[name](spark, sf_dir), connect(sf_dir), queries.ORACLE[name]) is None


@settings(max_examples=200, deadline=None)
@given(
    st.integers(1, 3).flatmap(
        lambda width: st.tuples(
            st.lists(st.lists(st.integers(-6, 6), min_size=width, max_size=width), min_size=1, max_size=17),
            st.lists(st.lists(st.integers(-8, 8), min_size=width, max_size=width), min_size=1, max_size=8),
        )
    )
)
def test_tree_finds_the_nearest_and_of_ties_the_first(both):
    centroids, vectors = (np.array(x, dtype=np.int64) for x in both)
    number, away = vantage.nearest(vantage.build(centroids), vectors)
    all_away = ((vectors[:, None, :] - centroids[None, :, :]) ** 2).sum(axis=2)
    assert number.tolist() == all_away.argmin(axis=1).tolist()
    assert away.tolist() == all_away.min(axis=1).tolist()


def test_tree_leaves_out_what_is_far():
    """Best first and pruned: well-apart centroids are not all looked at."""
    centroids = np.array([[1000 * k, 0] for k in range(64)], dtype=np.int64)
    tree, looked = vantage.build(centroids), []
    points = tree.points

    class Points:
        def __getitem__(self, k):
            looked.append(k)
            return points[k]

    number, _ = vantage.nearest(vantage.Tree(Points(), tree.numbers, tree.children), np.array([[17_003, 1]]))
    assert number.tolist() == [17]
    assert len(looked) < 32


def test_clusters_of_all_vectors(spark):
    rng = np.random.default_rng(7)
    rows = [(int(i), [float(x) for x in rng.normal(0, 0.2, 4)]) for i in range(300)]
    rows += [(500, [0.25] * 4), (500, [0.25] * 4), (501, [0.25] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(7)
    kept = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in rows]
    want, centroids = plain(kept, 5, 3)
    out = vantage.clusters(df, count=5, rounds=3, width=4).collect()
    assert sorted((r["id"], r["cluster"], r["distance"]) for r in out) == want
    inertia = sum(w[2] for w in want)
    for r in out:
        assert r["centroid"] == centroids[r["cluster"]]
        assert r["inertia"] == inertia
        assert r["cluster_inertia"] == sum(w[2] for w in want if w[1] == r["cluster"])


def test_odd_vectors(spark):
    good, nan, inf = [0.5] * 64, [0.5] * 63 + [float("nan")], [float("-inf")] + [0.0] * 63
    rows = [
        (1, good, 1, 9, "x"), (1, good, 1, 9, "x"), (None, good, None, None, None), (2, nan, 1, 9, "x"), (3, inf, 1, 9, "x"),
        (4, [0.5] * 63, 1, 9, "x"), (5, [0.5] * 63 + [None], 1, 9, "x"), (6, None, 1, 9, "x"), (7, [], 1, 9, "x"),
        (8, [-0.001] * 64, None, 9, "x"),
    ]
    out = vantage.clusters(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r["id"] or 0, r["distance"]) for r in out) == [(0, 0), (1, 0), (1, 0), (8, 0)]
    by_id = {r["id"]: r for r in out}
    assert by_id[1]["cluster"] == by_id[None]["cluster"] and by_id[8]["centroid"] == [-1] * 64


def test_no_rows_and_too_large_numbers(spark):
    assert vantage.clusters(spark.createDataFrame([], SCHEMA)).collect() == []
    large = spark.createDataFrame([(1, [1e30] * 64, 1, 1, "x")], SCHEMA)
    with pytest.raises(Exception, match="too large"):
        vantage.clusters(large).collect()
