import numpy as np
import pytest

from latticeworks.operators import nearest


def brute(q, t, k, skip_same=False):
    out = {}
    for qi, qx, qy in q:
        d = sorted((np.hypot(tx - qx, ty - qy), ti) for ti, tx, ty in t if not (skip_same and ti == qi))
        out[qi] = d[:k]
    return out


@pytest.fixture(scope="module")
def scene(spark):
    """A dense cluster, copies on one spot, and far-off queries."""
    rng = np.random.default_rng(3)
    t = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.normal(500, 2, (300, 2)).round(3))]
    t += [(1000 + i, 40.0, 40.0) for i in range(50)]
    t += [(2000 + i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(0, 10_000, (60, 2)).round(1))]
    q = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-2000, 12_000, (120, 2)).round(1))]
    q += [(500 + i, 501.0, 499.5) for i in range(30)]
    return q, t, spark.createDataFrame(q, "qid long, x double, y double"), spark.createDataFrame(t, "tid long, x double, y double")


@pytest.mark.parametrize("k", [1, 5])
def test_matches_brute_force(scene, k):
    q, t, qdf, tdf = scene
    got = nearest.nearest(qdf, tdf, "qid", "tid", k).collect()
    want = brute(q, t, k)
    assert len(got) == len(q)
    for r in got:
        have = [(n.distance, n.id) for n in r.neighbours]
        assert [i for _, i in have] == [i for _, i in want[r.qid]]
        assert [d for d, _ in have] == pytest.approx([d for d, _ in want[r.qid]])


def test_graph_excludes_the_unit_itself(scene):
    _, t, _, tdf = scene
    got = {}
    for r in nearest.knn_edges(tdf, "tid", 4).collect():
        got.setdefault(r.i, []).append((r.distance, r.j))
    want = brute(t, t, 4, skip_same=True)
    for i, found in got.items():
        assert sorted(d for d, _ in found) == pytest.approx([d for d, _ in want[i]])
        assert i not in [j for _, j in found]
    assert len(got) == len(t)


def test_groups_and_missing_coordinates(spark):
    q = spark.createDataFrame([(1, 0.0, 0.0), (2, None, 3.0)], "qid long, x double, y double")
    t = spark.createDataFrame([(1, "a", 3.0, 4.0), (2, "b", 6.0, 8.0)], "tid long, kind string, x double, y double")
    rows = nearest.nearest(q, t, "qid", "tid", group=["kind"]).where("qid = 1").collect()
    assert {r.kind: r.neighbours[0].distance for r in rows} == {"a": 5.0, "b": 10.0}
    one = {r.qid: r.nearest_distance for r in nearest.nearest_one(q, t, "qid", "tid").collect()}
    assert one == {1: 5.0, 2: None}


def test_close_targets_are_looked_into_where_they_lie(spark):
    """Targets a millimetre apart in a plane of 1,000 km, dense clusters, far-off queries."""
    rng = np.random.default_rng(8)
    t = [(i, 500_000 + 0.001 * (i % 3), 500_000 + 0.001 * (i // 3)) for i in range(6)]
    t += [(100 + i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(0, 1_000_000, (200, 2)))]
    t += [(1000 + i, 200_000 + float(x), 700_000 + float(y)) for i, (x, y) in enumerate(rng.normal(0, 0.01, (300, 2)))]
    q = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(0, 1_000_000, (150, 2)))]
    q += [(1000 + i, 500_000 + 0.0004 * i, 500_000.0007) for i in range(8)] + [(2000 + i, 200_000 + 0.003 * i, 700_000 - 0.002 * i) for i in range(-5, 6)]
    qdf, tdf = spark.createDataFrame(q, "qid long, x double, y double"), spark.createDataFrame(t, "tid long, x double, y double")
    for k in (1, 4):
        want = brute(q, t, k)
        for r in nearest.nearest(qdf, tdf, "qid", "tid", k).collect():
            assert [n.distance for n in r.neighbours] == pytest.approx([d for d, _ in want[r.qid]], rel=1e-9, abs=1e-9)


def test_more_wanted_than_there_are(spark):
    q = spark.createDataFrame([(1, 0.0, 0.0), (2, 5.0, 5.0)], "qid long, x double, y double")
    t = spark.createDataFrame([(1, 3.0, 4.0), (2, 6.0, 8.0)], "tid long, x double, y double")
    rows = nearest.nearest(q, t, "qid", "tid", k=100).collect()
    assert all(len(r.neighbours) == 2 for r in rows)


def test_far_off_queries_do_not_meet_every_target(spark, monkeypatch):
    """A long strip of queries beside one small cluster: pairs of tiles stay few, results exact."""
    rng = np.random.default_rng(9)
    t = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(0, 1000, (900, 2)).round(2))]
    q = [(i, float(x), float(y)) for i, (x, y) in enumerate(zip(rng.uniform(0, 1000, 1500).round(1), np.linspace(0, 2_000_000, 1500).round(1)))]
    written, cut = [], nearest.checkpointed

    def counted(df):
        out = cut(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(nearest, "checkpointed", counted)
    qdf, tdf = spark.createDataFrame(q, "qid long, x double, y double"), spark.createDataFrame(t, "tid long, x double, y double")
    want = brute(q, t, 3)
    for r in nearest.nearest(qdf, tdf, "qid", "tid", 3).collect():
        assert [n.id for n in r.neighbours] == [i for _, i in want[r.qid]], r.qid
    assert max(written) < 15_000, written
