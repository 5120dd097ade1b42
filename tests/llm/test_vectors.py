"""Vector dedup against brute force, components, and the queries that SQL can express."""

import random

import numpy as np
import pytest

from compare import compare, connect
from corpora import components
from trialweave.llm import projection_passes, queries
from trialweave.llm.components import connected_components

SF = "/root/testdata/sf0.001"


def vectors():
    r = np.random.default_rng(3)
    rows = []
    for g in range(40):
        base = r.normal(size=16)
        for _ in range(int(r.integers(1, 6))):
            rows.append((base + 0.05 * r.normal(size=16)).astype(np.float32).tolist())
    hot = r.normal(size=16)
    rows += [(hot + 0.02 * r.normal(size=16)).astype(np.float32).tolist() for _ in range(150)]
    rows += [hot.astype(np.float32).tolist()] * 60
    rows += [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0] * 8, [2.0] * 8, [1e-30] * 16, [1e30] * 16]
    labels = [i % 2 if i < len(rows) - 10 else 0 for i in range(len(rows))]
    labels[5] = None
    return [(7 * i % 1009, v, label) for i, (v, label) in enumerate(zip(rows, labels, strict=True))]


@pytest.mark.parametrize("window", [4, 32])
def test_near_duplicates(spark, window, monkeypatch):
    rows = vectors()
    monkeypatch.setattr(projection_passes, "BLOCK", 40)
    df = spark.createDataFrame([(i, v, label, "x") for i, v, label in rows], "vec_id bigint, embedding array<float>, label int, component string").repartition(3)
    got = {r.vec_id: r for r in projection_passes.near_duplicates(df, 0.93, window=window).collect()}
    ok = {}
    for i, v, label in rows:
        if v and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float32).astype(float)
            x = x / np.abs(x).max()
            ok[i] = (label, x / np.linalg.norm(x))
    pairs = [(a, b) for a in ok for b in ok if a < b and ok[a][0] == ok[b][0] and len(ok[a][1]) == len(ok[b][1]) and ok[a][1] @ ok[b][1] >= 0.93]
    want = components(pairs, [r[0] for r in rows])
    assert {i: r.component_id for i, r in got.items()} == want
    for i, r in got.items():
        assert r.n_links == sum(i in p for p in pairs) and r.kept == (r.component_id == i)


def test_passes_follow_the_largest_label(spark):
    r = np.random.default_rng(5)
    base = r.normal(size=(4000, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    aside = r.normal(size=base.shape)
    aside -= (aside * base).sum(1, keepdims=True) * base
    aside /= np.linalg.norm(aside, axis=1, keepdims=True)
    cosine = r.uniform(0.931, 0.95, size=(4000, 1))
    x = np.concatenate([base, cosine * base + np.sqrt(1 - cosine**2) * aside])
    df = spark.createDataFrame([(i, v, 0) for i, v in enumerate(x.tolist())], "vec_id bigint, embedding array<double>, label int")
    got = {row.vec_id: row for row in projection_passes.near_duplicates(df, 0.93, window=4).collect()}
    # blockwise brute force: every vector against all
    pairs = [(a, int(b)) for low in range(0, 8000, 1000) for a, near in enumerate(x[low : low + 1000] @ x.T >= 0.93, low) for b in np.flatnonzero(near) if a < b]
    assert len(pairs) >= 4000
    assert np.mean([got[a].component_id == got[b].component_id for a, b in pairs]) > 0.98


def test_passes_for():
    assert [projection_passes.passes_for(n, 32, 0.93, 0.99) for n in (0, 32, 2000)] == [8, 8, 8]
    assert projection_passes.passes_for(1_000_000, 32, 0.93, 0.99) > 25
    assert projection_passes.passes_for(1_000_000, 32, 1.0, 0.99) == 8


def test_empty_vectors_and_null_key(spark):
    empty = spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")
    assert projection_passes.near_duplicates(empty).count() == 0
    one = spark.createDataFrame([(None, [1.0, 2.0], 1), (3, [1.0, 2.0], 1), (3, [1.0, 2.0], 1)], "vec_id bigint, embedding array<float>, label int")
    got = sorted(projection_passes.near_duplicates(one).collect(), key=str)
    assert [(r.vec_id, r.n_links, r.component_id, r.kept) for r in got] == [(3, 1, 3, True), (3, 1, 3, True), (None, 0, None, True)]


def test_components(spark):
    r = random.Random(8)
    pairs = [(r.randint(0, 400), r.randint(0, 400)) for _ in range(220)] + [(i, i + 1) for i in range(500, 600)] + [(700, i) for i in range(701, 900)]
    found = connected_components(spark.createDataFrame([*pairs, (None, 5), (6, 6)], "a bigint, b bigint"))
    ids = {i for p in pairs if p[0] != p[1] for i in p}
    assert {x.id: x.component for x in found.collect()} == components([p for p in pairs if p[0] != p[1]], ids)
    assert found.count() == len(ids)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    assert compare(queries.QUERIES[name](spark, SF), connect(SF), queries.SQL[name]) is None


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = queries.table(spark, sf, "documents"), queries.table(spark, sf, "labels")
    right = queries.QUERIES["op10_language_id"](spark, sf).where("held_out").join(docs, "doc_id").selectExpr("avg(int(lang = lang_pred)) AS a").first().a
    assert right > 0.97
    right = queries.QUERIES["op8_quality_trees"](spark, sf).where("held_out").join(labels, "doc_id").selectExpr("avg(int(quality = predicted)) AS a").first().a
    assert right > 0.95


@pytest.mark.parametrize("name", ["op2_sketches", "op3_licence_scan", "op5_projection_passes", "op6_signature_trees", "op7_window_dedup", "op9_piece_codec"])
def test_query_runs(spark, name):
    rows = queries.QUERIES[name](spark, SF)
    first = rows.columns[0]
    assert first in ("doc_id", "vec_id")
    if name != "op3_licence_scan":
        whole = "embeddings" if name.startswith("op5") else "documents"
        assert rows.count() == queries.table(spark, SF, whole).count()
