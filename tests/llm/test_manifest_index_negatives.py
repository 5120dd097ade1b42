"""Merkle manifest, digest index and hard negatives against brute force, with awkward rows."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpora import SCHEMA, UPPER, clashing, corpus
from trialweave.llm import bit_planes, digest_index, postorder_log


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree_levels(digests):
    levels = [digests]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha("".join(last[k : k + 8])) for k in range(0, len(last), 8)])
    return levels


def way(levels, i):
    out = []
    for level in levels[:-1]:
        first = i // 8 * 8
        out.append(("".join(level[first:i]), "".join(level[i + 1 : first + 8])))
        i //= 8
    return out


def brute_manifest(rows):
    def leaf(key, text, lang, source, n_chars):
        return sha("".join(map(field, (key, source, lang, n_chars, text))))

    groups = defaultdict(list)
    for key, text, lang, source, n_chars in rows:
        own = leaf(key, text, lang, source, n_chars)
        other = own
        if key is not None and zlib.crc32(str(key).encode()) % 3 == 0:
            other = leaf(key, text and text.translate(UPPER), lang, source, n_chars)
        groups[lang].append(((key is not None, key or 0), own, other, key))
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {g: tree_levels([x[1] for x in sorted(groups[g], key=lambda x: x[:2])]) for g in names}
    top = tree_levels([trees[g][-1][0] for g in names])
    out = []
    for t, g in enumerate(names):
        for i, (_, own, other, key) in enumerate(sorted(groups[g], key=lambda x: x[:2])):
            steps = way(trees[g], i) + way(top, t)
            folded = other
            for before, after in steps:
                folded = sha(before + folded + after)
            out.append((key, own, trees[g][-1][0], top[-1][0], sha("".join(b + a for b, a in steps)), folded, folded == top[-1][0]))
    return out


def manifest(docs, **more):
    return postorder_log.manifest(
        docs,
        ["doc_id", "source", "lang", "n_chars", "text"],
        tampered={"text": F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")},
        when=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0,
        **more,
    )


def shown(rows):
    return sorted(map(str, rows))


@pytest.mark.parametrize("levels", [1, 2, 4])
def test_manifest(spark, levels):
    rows = corpus()
    rows = rows + [(10_000 + i, "Aé" * (i % 3), f"lang{i % 11:02}" if i % 5 else "en", None, None) for i in range(300)]
    rows += [(20_000, None, "-", "s", 1), (20_001, "", "", "s", 1)]
    got = manifest(clashing(spark, rows).repartition(7), levels=levels)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert shown(tuple(r) for r in got.collect()) == shown(brute_manifest(rows))


def test_manifest_of_few_rows(spark):
    for rows in ([], [(1, "A", "en", "s", 1)], [(1, "A", "en", "s", 1), (None, None, None, None, None)]):
        got = manifest(spark.createDataFrame(rows, SCHEMA)).collect()
        assert shown(tuple(r) for r in got) == shown(brute_manifest(rows))


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 64, 65, 100, 513])
def test_positions_are_the_order_of_completion(n):
    order = []

    def visit(level, i):
        if level:
            for child in range(8 * i, min(8 * i + 8, -(-n // 8 ** (level - 1)))):
                visit(level - 1, child)
        order.append((level, i))

    visit(postorder_log.height(n), 0)
    for level in range(postorder_log.height(n) + 1):
        width = -(-n // 8**level)
        places = postorder_log.positions(level, np.arange(width), n)
        assert [order[p] for p in places] == [(level, i) for i in range(width)]


def test_log_is_contiguous(spark):
    leaves = spark.range(700).selectExpr("'=x' AS tree", "700L AS n", "id AS i", "unhex(sha2(cast(id AS string), 256)) AS digest")
    parts = postorder_log.append_log(leaves, levels=2)
    places = sorted(r.position for part in parts for r in part.select("position").collect())
    assert len(parts) == 2 and places == list(range(700 + 88 + 11 + 2 + 1))
    assert postorder_log.roots(parts).count() == 1


def brute_copies(rows):
    groups = defaultdict(list)
    for key, text, *_ in rows:
        groups[text or ""].append(key)
    out = []
    for key, text, *_ in rows:
        own = groups[text or ""]
        keep = max(own, key=lambda k: (k is not None, k or 0))
        out.append((key, keep, len(own), key == keep, sha(text or "")))
    return out


def test_digest_index_one_batch(spark, monkeypatch):
    rows = corpus() + [(30_000 + i, "hot copy", None, None, None) for i in range(90)]
    docs = clashing(spark, rows).repartition(5)
    for share in (1000, 3):  # with 3 the large groups are matched without a shuffle
        monkeypatch.setattr(digest_index, "HOT_SHARE", share)
        got = [tuple(r) for r in digest_index.deduplicate(docs).collect()]
        assert shown(got) == shown(brute_copies(rows))
    kept = digest_index.keep_one(docs)
    assert kept.columns == docs.columns
    want = {(k, t or "") for k, t, *_ in rows} & {(x[1], t) for x, (_, t, *_) in zip(brute_copies(rows), rows) if t is not None} | {(x[1], "") for x, (_, t, *_) in zip(brute_copies(rows), rows) if not t}
    assert {(r.doc_id, r.text or "") for r in kept.collect()} == want
    assert digest_index.deduplicate(clashing(spark, [])).count() == 0


def test_digest_index_over_batches(spark, tmp_path):
    first = [(1, "a"), (2, "b"), (9, "b"), (3, None)]
    second = [(4, "b"), (5, "c"), (6, ""), (7, "c"), (10, "a")]
    kinds = "doc_id bigint, text string"
    index = digest_index.DigestIndex(spark, str(tmp_path / "index"), buckets=3)
    one, two = spark.createDataFrame(first, kinds), spark.createDataFrame(second, kinds)
    assert {r.doc_id for r in digest_index.keep_one(one, index, "one").collect()} == {1, 9, 3}
    # another session's view of the same folder; new data loses to what is there
    again = digest_index.DigestIndex(spark, str(tmp_path / "index"), buckets=99)
    assert again.buckets == 3
    assert {r.doc_id for r in digest_index.keep_one(two, again, "two").collect()} == {7}
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in digest_index.deduplicate(two, again, "two").collect()}
    assert got == {4: (9, 3, False), 5: (7, 2, False), 6: (6, 2, True), 7: (7, 2, True), 10: (10, 2, True)}
    assert again.rows().count() == 3 + 4  # the batch added twice counts once
    small = again.compact(str(tmp_path / "compact"))
    assert shown(map(tuple, small.state().collect())) == shown(map(tuple, again.state().collect()))
    assert small.rows().count() == 4


def test_index_is_not_shuffled(spark, tmp_path):
    index = digest_index.DigestIndex(spark, str(tmp_path / "index"), buckets=8)
    index.add(spark.range(50).selectExpr("id AS k", "unhex(sha2(cast(id AS string), 256)) AS digest"), "a")
    plan = index.state()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def brute_negatives(rows, positives=5, negatives=10):
    vectors = []
    for key, v, label in rows:
        if key is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        vectors.append((key, (label + 1) % 10 if key % 7 == 0 else label, [int(np.floor(256 * float(x))) for x in v]))
    out = []
    done = set()
    for a, label, q in vectors:
        if a % 100 or (a, label, tuple(q)) in done:
            continue
        done.add((a, label, tuple(q)))
        scored = sorted((-sum(x * y for x, y in zip(q, w)), k, other) for k, other, w in vectors if k != a)
        for s, p, _ in [x for x in scored if x[2] == label][:positives]:
            near = [x for x in scored if x[2] != label and -30 * s <= -100 * x[0] <= -90 * s][:negatives]
            out += [(a, p, r + 1, k, -s, -t) for r, (t, k, _) in enumerate(near)]
    return out


@pytest.mark.parametrize("block", [1 << 17, 60])
def test_hard_negatives(spark, block, monkeypatch):
    monkeypatch.setattr(bit_planes, "BLOCK", block)
    r = np.random.default_rng(11)
    centre = r.normal(size=(4, 19))
    rows = []
    for i in range(420):
        v = centre[i % 4] + 0.8 * r.normal(size=19)
        rows.append((5 * i - 100, np.float32(v).tolist(), i % 3 if i % 4 else 9))
    rows += [(3001 + i, rows[24][1], i % 2) for i in range(30)]  # ties
    rows += [(400, None, 1), (401, [], 1), (403, [float("nan")] * 19, 1), (404, [None] + [1.0] * 18, 1), (406, [float("inf")] * 19, 1), (None, [1.0] * 19, 2), (407, [1.0] * 19, None)]
    rows += [(4100, [], 1), (4200, [0.5] * 8, 1), (4300, [-0.3] * 19, 7), (4301, [-0.3] * 19, 7)]
    rows += [rows[9], rows[9], (rows[20][0], [0.1] * 19, 2), rows[20]]  # repeated rows, one of them an anchor's
    df = spark.createDataFrame([(*x, "x", 1) for x in rows], "vec_id bigint, embedding array<float>, label int, id string, block int").repartition(5)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = bit_planes.mine(df.withColumn("label", label), F.col("vec_id") % 100 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = brute_negatives(rows)
    assert len(want) > 500
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_no_vectors_and_large_components(spark):
    kinds = "vec_id bigint, embedding array<float>, label int"
    assert bit_planes.mine(spark.createDataFrame([], kinds), F.col("vec_id") % 100 == 0).count() == 0
    with pytest.raises(ValueError):
        bit_planes.mine(spark.createDataFrame([(0, [1e30], 1)], kinds), F.col("vec_id") % 100 == 0)


def test_scores_are_exact():
    r = np.random.default_rng(2)
    x = r.integers(-900, 900, size=(50, 21))
    planes = int(np.abs(x).max()).bit_length() + 1
    for a in x[:5]:
        assert (bit_planes.scores(bit_planes.subset_sums(a), bit_planes.pack(x, planes)) == x @ a).all()
