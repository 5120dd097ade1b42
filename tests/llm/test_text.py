"""Text operators against brute force, on awkward rows and on empty tables."""

import hashlib
import random

import numpy as np
import pytest

import corpus_pipeline
from corpora import SCHEMA, clashing, corpus, linked, removed_words, shingle_set, words
from trialweave.llm import language, licences, line_chunks, mixing, pieces, quality_trees, signature_trees, sketches, window_dedup
from trialweave.llm.queries import levels, model_file
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return clashing(spark, rows).repartition(5).cache()


@pytest.fixture(scope="module")
def none(spark):
    return clashing(spark, [])


def test_windows(docs, rows):
    got = window_dedup.remove_repeats(docs, width=13).collect()
    assert len(got) == len(rows)
    texts = {r[0]: r[1] for r in rows}
    once = {k for k in texts if k is not None and sum(r[0] == k for r in rows) == 1}
    # the null key comes first, and rows of one key count together
    first = {}
    for key, text, *_ in rows:
        w = words(text)
        for j in range(len(w) - 12):
            x = tuple(w[j : j + 13])
            rank = -(1 << 62) if key is None else key
            first[x] = min(first.get(x, rank), rank)
    for r in got:
        if r.doc_id not in once:
            continue
        w = words(texts[r.doc_id])
        gone = [False] * len(w)
        for j in range(len(w) - 12):
            if first[tuple(w[j : j + 13])] < r.doc_id:
                gone[j : j + 13] = [True] * 13
        spans = [False] * len(w)
        for i in r.intervals:
            assert i.begin == 0 or not spans[i.begin - 1]
            spans[i.begin : i.end] = [True] * (i.end - i.begin)
        assert spans == gone and r.n_words == len(w)
        assert r.kept == " ".join(x for x, y in zip(w, gone) if not y)
    assert removed_words({1: "a b c", 2: "x a b c"}, 2)[2] == [False, True, True, True]


@pytest.mark.parametrize("leaf", [256, 3])
def test_signature_trees(docs, rows, leaf, monkeypatch):
    monkeypatch.setattr(signature_trees, "LEAF", leaf)
    got = signature_trees.link_documents(docs, width=4, percent=85).collect()
    assert len(got) == len(rows)
    keys = [r[0] for r in rows]
    named = {}
    for i, r in enumerate(rows):
        rank = -(1 << 62) if r[0] is None else r[0]
        named[(rank, i)] = r[1]
    found = linked(named, 4, 85)
    # rows of one key are one document
    groups = {}
    for (rank, i), root in found.items():
        groups.setdefault(root, set()).add(rank)
    merged = [set(g) for g in groups.values()]
    for key in {k for k in keys if keys.count(k) > 1}:
        touching = [g for g in merged if key in g]
        merged = [g for g in merged if key not in g] + [set().union(*touching)]
    least = {k: min(g) for g in merged for k in g}
    for r in got:
        rank = -(1 << 62) if r.doc_id is None else r.doc_id
        want = least[rank]
        assert r.component == (None if want == -(1 << 62) else want)
    for r in got:
        if r.doc_id is not None and keys.count(r.doc_id) == 1:
            assert r.n_shingles == len(shingle_set(dict((x[0], x[1]) for x in rows)[r.doc_id], 4))
    kept = signature_trees.keep_one(docs, 4, 85)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {None if k == -(1 << 62) else k for k in set(least.values())}


def test_large_cluster_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(signature_trees, "LEAF", 4)
    r = random.Random(4)
    base = [f"w{r.randint(0, 10**6)}" for _ in range(150)]
    texts = {}
    for i in range(60):
        own = list(base[: 150 - i // 3])
        own[r.randrange(len(own))] = f"e{i}"
        texts[i] = " ".join(own)
    got = signature_trees.link_documents(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string"), 4, 85)
    assert {x.doc_id: x.component for x in got.collect()} == linked(texts, 4, 85)


def test_common_passage_and_loose_cluster(spark, monkeypatch):
    """Several hundred documents share rare shingles; some link, some only nearly, sizes differ."""
    monkeypatch.setattr(signature_trees, "LEAF", 4)
    r = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    texts = {}
    for i in range(420):
        own = list(base[: r.choice([120, 118, 112, 60])])
        for _ in range(r.choice([0, 1, 2, 3, 4, 6])):
            own[r.randrange(len(own))] = f"e{r.randrange(40)}"
        texts[i] = " ".join(own + [f"t{i}" for _ in range(r.choice([0, 0, 3]))])
    long = [f"l{r.randrange(10**9)}" for _ in range(3000)]
    for i in range(30):  # wider signatures
        own = list(long[: 3000 - 40 * (i % 5)])
        for _ in range(r.choice([5, 60, 130])):
            own[r.randrange(len(own))] = f"x{i}"
        texts[1000 + i] = " ".join(own)
    got = signature_trees.link_documents(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string"), 4, 85)
    want = linked(texts, 4, 85)
    assert {x.doc_id: x.component for x in got.collect()} == want
    assert 20 < len(set(want.values())) < 440


def test_signatures_bound_the_overlap():
    r = np.random.default_rng(5)
    for n, m in ((3, 500), (900, 700), (5000, 600), (70_000, 4000)):
        pool = r.integers(0, 1 << 63, size=n + m, dtype=np.uint64) * np.uint64(2)
        a, b = np.unique(pool[:n]), np.unique(pool[n // 2 : n // 2 + m])
        (x, slack_a), (y, slack_b) = signature_trees.signature(a), signature_trees.signature(b)
        while len(x) != len(y):
            x, y = (signature_trees.fold(x), y) if len(x) > len(y) else (x, signature_trees.fold(y))
        w = (len(x) * 8).bit_length() - 1 - signature_trees.BITS
        common = int(np.bitwise_count(x & y).sum())
        overlap = len(np.intersect1d(a, b))
        assert overlap <= min(common + slack_a[w], common + slack_b[w])
        assert common + slack_a[w] < 0.8 * len(a) or overlap > 0.3 * len(a) or n < 10 or n > 60_000


def test_sketches(spark, docs, rows):
    got = sketches.fingerprints(docs).collect()
    by_text = {}
    for r in got:
        by_text.setdefault(r.doc_id, []).append(tuple(r.sketch))
    assert len(got) == len(rows)
    texts = [x for x in rows if [y[0] for y in rows].count(x[0]) == 1]
    seen = {}
    for key, text, *_ in texts:
        own = by_text[key][0]
        assert list(own) == sorted(set(own)) and len(own) == min(sketches.K, len({tuple(s) for s in _cased(text)}))
        assert seen.setdefault(tuple(words(text)), own) == own
    pairs = [(texts[i][1] or "", texts[j][1] or "") for i in range(0, len(texts), 3) for j in (i, (i + 1) % len(texts))]
    pairs += [(a, a[: len(a) // 2]) for a, _ in pairs[:10]]
    df = spark.createDataFrame(pairs, "a string, b string").select("*", sketches.sketch(F.col("a")).alias("x"), sketches.sketch(F.col("b")).alias("y"))
    df = df.select("*", sketches.resemblance(F.col("x"), F.col("y")).alias("r"), sketches.containment(F.col("y"), F.col("x")).alias("c"), sketches.distinct_shingles(F.col("x")).alias("d"))
    for r in df.collect():
        a, b = _cased(r.a), _cased(r.b)
        assert abs(r.r - (len(a & b) / len(a | b) if a | b else 1)) < 0.2
        assert abs(r.c - (len(a & b) / len(b) if b else 1)) < 0.35
        assert abs(r.d - len(a)) <= 0.35 * len(a)


def test_sketches_merge(spark):
    rows = [(g, " ".join(f"w{(7 * g + i * j) % 211}" for i in range(60))) for g in range(3) for j in range(1, 9)]
    df = spark.createDataFrame(rows, "g int, text string").select("g", sketches.sketch(F.col("text")).alias("s"))
    whole = {r.g: list(r.s) for r in sketches.merge_all(df, ["g"], "s").collect()}
    for g in range(3):
        parts = [r.s for r in df.where(F.col("g") == g).collect()]
        assert whole[g] == sorted({h for p in parts for h in p})[: sketches.K]


def _cased(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


@pytest.mark.parametrize("per_part", [4, 1000])
def test_next_row(spark, per_part):
    ids = [5, 9, -3, 100, 4, 8, 77, 12, 1000, 6, 7]
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "k bigint, text string")
    got = {r.k: r.next.k for r in sketches.with_next(df, "k", per_part=per_part).collect()}
    down = sorted(ids, reverse=True)
    assert got == {k: down[(i + 1) % len(down)] for i, k in enumerate(down)}


def _chunks(text):
    lines = text.split("\n")
    h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
    out, start = [], 0
    for i in range(len(lines)):
        if i == len(lines) - 1 or (i >= 1 and (h[i - 1] * 31 + h[i]) % 2 == 0):
            out.append(lines[start : i + 1])
            start = i + 1
    return out


def test_line_chunks(docs, rows):
    got = line_chunks.remove_repeats(docs)
    assert set(got.columns) == {*docs.columns} and got.count() == len(rows)
    order = sorted(rows, key=lambda r: -(1 << 62) if r[0] is None else r[0])
    place = {}
    for key, text, *_ in order:
        for idx, c in enumerate(_chunks(text) if text is not None else []):
            rank = (-(1 << 62) if key is None else key, idx)
            place[tuple(c)] = min(place.get(tuple(c), rank), rank)
    want = []
    for key, text, *_ in rows:
        if text is None:
            want.append((key, None, 0, 0))
            continue
        left = [(len(c) > 1 and place[tuple(c)] != (-(1 << 62) if key is None else key, i), c) for i, c in enumerate(_chunks(text))]
        kept = "\n".join("\n".join(c) for gone, c in left if not gone)
        want.append((key, kept, text.count("\n") + 1, sum(len(c) for gone, c in left if gone)))
    out = [(r.doc_id, r.text, r.n_lines, r.n_removed) for r in got.collect()]
    assert sorted(map(repr, out)) == sorted(map(repr, want))
    assert sum(x[3] for x in out) > 0


def _spaced_chunks(text):
    lines = text.split("\n")
    h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
    meets = [i >= 1 and (h[i - 1] * 31 + h[i]) % 2 == 0 for i in range(len(lines))]
    out, start = [], 0
    for i in range(len(lines)):
        if i == len(lines) - 1 or (meets[i] and not meets[i - 1] and i < len(lines) - 2):
            out.append(lines[start : i + 1])
            start = i + 1
    return out


def test_whole_copies_of_long_texts_go(spark):
    r = random.Random(6)
    texts = ["\n".join(f"line {r.random()}" for _ in range(r.randint(4, 40))) for _ in range(60)]
    passage = "\n".join(f"shared {r.random()}" for _ in range(30))
    mixed = [f"{a}\n{passage}\n{b}" for a, b in zip(texts[:6], texts[6:12], strict=True)]
    rows = list(enumerate([*texts, *texts, *mixed]))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("n_chars", F.length("text"))
    got = {x.doc_id: x for x in corpus_pipeline.lines(spark, df, "").collect()}
    first = {}
    for key, text in rows:
        parts = _spaced_chunks(text)
        assert all(len(c) > 1 for c in parts)
        left = [c for i, c in enumerate(parts) if len(c) < 2 or first.setdefault(tuple(c), (key, i)) == (key, i)]
        assert got[key].text == "\n".join("\n".join(c) for c in left)
        if 60 <= key < 120:
            assert got[key].text == "" and got[key].n_chars == 0


def test_mixing(spark, docs, rows):
    levels = (
        mixing.Level("lang", F.col("lang"), F.when(F.col("lang") == "en", 5).otherwise(1)),
        mixing.Level("source", F.col("source"), F.when(F.col("source") == "src1", 0).otherwise(1)),
    )
    got = mixing.mix(docs, levels, share=(9, 10), epochs=3, seed=1).collect()
    total = sum(len(words(r[1])) for r in rows)
    supply = {}
    for r in rows:
        if r[3] != "src1":
            supply[(r[2], r[3])] = supply.get((r[2], r[3]), 0) + len(words(r[1]))
    capacity = 3 * sum(supply.values())
    taken = {}
    for r in got:
        assert r.source != "src1" and r.epoch < 3
        assert len(words(r.text)) == r.n_taken <= r.n_tokens
        taken[(r.lang, r.source)] = taken.get((r.lang, r.source), 0) + r.n_taken
    assert all(taken[k] <= 3 * supply[k] for k in taken)
    repeated = max(len(words(r[1])) for r in rows if [x[0] for x in rows].count(r[0]) > 1)
    assert abs(sum(taken.values()) - min(total * 9 // 10, capacity)) <= 12 + 3 * repeated


def test_budgets(spark):
    leaves = spark.createDataFrame([("a", "x", 10), ("a", "y", 100), ("b", "x", 1000), (None, "x", 50)], "d string, s string, supply bigint")
    levels = (mixing.Level("d", F.col("d"), F.lit(1)), mixing.Level("s", F.col("s"), F.when(F.col("s") == "x", 3).otherwise(1)))
    got = {(r.d, r.s): r.granted for r in mixing.budgets(leaves, levels, 600, 1).collect()}
    # null can hold 50 and a 110 of their 200; b gets the rest; in a, x is short before y
    assert got == {(None, "x"): 50, ("a", "x"): 10, ("a", "y"): 100, ("b", "x"): 440}


def test_pieces_equal_the_library(spark, docs, rows):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=model_file())
    odd = ["   a", "a  b   c ", "▁▁a▁b", "<s> </s>", "<0x0A>", "x" * 3000, " " * 40, "ﬁ²½ ​�", "zq" * 99 + "    " + "ab" * 99, "=" * 80]
    texts = {r[0]: r[1] for r in rows if r[0] is not None and [x[0] for x in rows].count(r[0]) == 1} | {10_000 + i: t for i, t in enumerate(odd)}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    encoded = pieces.encode(df, model_file())
    back = {r.doc_id: r.text for r in pieces.decode(encoded, model_file()).collect()}
    for r in encoded.collect():
        text = texts[r.doc_id]
        if text is None:
            assert r.ids is None and back[r.doc_id] is None
            continue
        assert r.ids == library.encode(text) and back[r.doc_id] == library.decode(r.ids)
        data = text.encode()
        assert all(b <= e for b, e in zip(r.begins, r.ends)) and (not r.ids or (r.begins[0] == 0 and r.ends[-1] == len(data)))
        assert r.ends[:-1] == r.begins[1:]
    assert pieces.encode(docs, model_file()).count() == len(rows)


def test_character_map():
    # a hand-made double array: "a" -> "xy", "ab" -> "q"
    units = [0] * 512
    offset = lambda n: n << 10
    units[0] = offset(1)
    at_a = 1 ^ ord("a")
    units[at_a] = offset(256 ^ at_a) | 0x100 | ord("a")
    value_a = at_a ^ (256 ^ at_a)
    units[value_a] = 0x80000000 | 0
    at_b = value_a ^ ord("b")
    units[at_b] = offset(300 ^ at_b) | 0x100 | ord("b")
    units[300] = 0x80000000 | 3
    trie = np.array(units, "<u4").tobytes()
    m = pieces.CharacterMap(len(trie).to_bytes(4, "little") + trie + b"xy\0q\0")
    assert m.longest(b"abc", 0) == (2, b"q") and m.longest(b"ac", 0) == (1, b"xy") and m.longest(b"c", 0) is None
    own = pieces.Pieces(open(model_file(), "rb").read())
    own.map, own.squeeze = m, True
    text, origin = own.normalise("  ac  ab ")
    assert text == b" xyc q" and origin.tolist() == [2, 2, 2, 3, 4, 6, 8]


def test_language(spark, docs, rows):
    texts = ["the of and to " * 3, "le la des et ", "the with of", "la le un des"] * 5
    model = language.fit_model([language.grams(t) for t in texts], ["en", "fr", "en", "fr"] * 5, np.ones(language.BUCKETS))
    got = {(r.doc_id, r.lang_pred) for r in language.identify(spark.createDataFrame([(1, "and the of"), (2, "des la et le"), (3, None), (4, "12 !"), (5, "")], "doc_id bigint, text string"), model).collect()}
    assert got == {(1, "en"), (2, "fr"), (3, "und"), (4, "und"), (5, "und")}
    fitted = language.fit(docs)
    assert fitted.languages == ["en", "fr"]
    out = language.identify(docs, fitted).collect()
    assert len(out) == len(rows)
    # predictions again, densely, from the model's arrays
    by_id = {}
    for r in out:
        by_id.setdefault(r.doc_id, set()).add((r.lang_pred, round(r.score, 9)))
    for key, text, *_ in rows:
        if not text or not any(c.isalpha() for c in text):
            assert ("und", 0.0) in by_id[key]
            continue
        counts = np.zeros(language.BUCKETS)
        at, n = language.grams(text)
        counts[at] = n
        x = np.log1p(counts) * fitted.idf
        z = x / np.linalg.norm(x) @ fitted.weights / fitted.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert (fitted.languages[int(p.argmax())], round(float(p.max()), 9)) in by_id[key]


def test_language_frequencies_and_sample(spark):
    """Frequencies count every row and whole texts; a rare language is in the sample of a few rows."""
    texts = [f"the of and to w{i}" for i in range(300)] + ["x" * 70_000 + " zzq"] + ["jeg ikke og det er", "og det er ikke"]
    langs = ["en"] * 301 + ["da"] * 2
    df = spark.createDataFrame(list(zip(range(303), texts, langs)), "doc_id bigint, text string, lang string").repartition(7)
    want = np.zeros(language.BUCKETS)
    for t in texts:
        want[language.grams(t)[0]] += 1
    got = language.inverse_frequencies(df.selectExpr("text AS t"))
    assert np.allclose(got, np.log(304 / (1 + want)) + 1)
    model = language.fit(df, sample_rows=20)
    assert model.languages == ["da", "en"] and np.allclose(model.idf, got)
    assert model.predict("det er ikke og")[0] == "da"


def test_grams_of_long_texts_are_whole():
    text = "".join(random.Random(1).choice("abcdefgh ") for _ in range((1 << 18) * 2 + 77))
    total = sum(language.grams(text)[1])
    assert total == 3 * len(text) - 3


@pytest.mark.parametrize(
    "notice, family",
    [
        ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "lgpl"),
        ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "agpl"),
        ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "gpl"),
        ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", "cc-by-nc-sa"),
        ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "cc-by-nc"),
        ("SPDX-License-Identifier: MIT", "mit"),
        ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", "unknown"),
        ("This is free and unencumbered software released into the public domain.", "unknown"),
        ("All rights reserved. No part of this publication may be reproduced or transmitted in any form", "unknown"),
        ("Released under the MIT License. Distributed under the Boost Software License, Version 1.0.", "mit unknown"),
    ],
)
def test_families_that_differ_in_few_words(spark, docs, notice, family):
    model = licences.fit_model([t for t in ("some plain words about the weather", "nothing to see in this line of text", "ba ne tor li um")] * 5)
    df = spark.createDataFrame([(1, "plain words before\n" + notice + "\nand after")], "doc_id int, text string")
    got = {r.family for r in licences.scan(df, model).collect()}
    assert got == set(family.split())


def test_licences(spark, docs, rows):
    model = licences.fit(docs)
    notices = ["Released under the MIT License.", "so it goes\nLicensed under CC BY-NC 4.0.\nend", "just some prose", "", None, "This work is licensed under the GNU General Public License, version 2."]
    df = spark.createDataFrame(list(enumerate(notices)), "doc_id int, text string")
    got = {(r.doc_id, r.paragraph, r.family): notices[r.doc_id].encode()[r.begin : r.end].decode() for r in licences.scan(df, model).collect()}
    assert got == {(0, 0, "mit"): notices[0], (1, 1, "cc-by-nc"): "Licensed under CC BY-NC 4.0.", (5, 0, "gpl"): notices[5]}
    assert licences.scan(docs, model).count() == 0
    vague = spark.createDataFrame([(1, "This work is licensed under some other public terms, version 3.")], "doc_id int, text string")
    assert {r.family for r in licences.scan(vague, model).collect()} <= {"unknown"}


def test_wrapped_and_embedded_notices(spark):
    prose = "the house by the river was sold in spring and nobody of the family came back to it " * 12
    model = licences.fit_model([prose[k : k + 80] for k in range(0, 900, 60)])
    gpl = licences.TEMPLATES["gpl"][1]
    bsd = licences.TEMPLATES["bsd"][1]
    mit = "Released under the MIT License."
    wanted = [
        ("gpl", gpl.replace("modify it", "modify\nit"), "", "\nas published"),
        ("bsd", bsd.replace("without mod", "without\nmod"), "intro\n\n", ":\n"),
        ("gpl", gpl.replace("modify it", "modify\n# it"), "# ", "\n#\n# more"),
        ("mit", mit, prose, " " + prose),
        ("gpl", gpl, prose, ", " + prose),
        ("bsd", bsd, "h\u00e9 " + prose + "\n" + prose, "\n" + prose),
    ]
    df = spark.createDataFrame([(i, a + t + b) for i, (_, t, a, b) in enumerate(wanted)], "doc_id int, text string")
    got = [(r.doc_id, r.family, r.begin, r.end) for r in licences.scan(df, model).orderBy("doc_id", "begin").collect()]
    assert got == [(i, f, len(a.encode()), len((a + t).encode())) for i, (f, t, a, _) in enumerate(wanted)]
    apart = spark.createDataFrame([(1, gpl.replace("modify it", "modify\n\nit"))], "doc_id int, text string")
    assert "gpl" not in {r.family for r in licences.scan(apart, model).collect()}


def test_quality(spark, docs, rows):
    r = np.random.default_rng(0)
    x = r.normal(size=(800, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality_trees.fit_trees(x[:600], y[:600])
    assert ((model.score(x[600:]) > 0.5) == y[600:]).mean() > 0.9
    walked = []
    for row in x[600:610]:
        total = model.base
        for feature, threshold, leaf in zip(model.feature, model.threshold, model.leaf):
            node = 0
            while node < len(feature):
                node = 2 * node + 1 + int(row[feature[node]] > threshold[node])
            total += leaf[node - len(feature)]
        walked.append(1 / (1 + np.exp(-total)))
    assert np.allclose(walked, model.score(x[600:610]))
    labels = spark.createDataFrame([(r[0], i % 2) for i, r in enumerate(rows)] + [(1, None)], "doc_id bigint, quality int")
    fitted = quality_trees.fit(docs, labels)
    scores = quality_trees.score(docs, fitted).collect()
    assert len(scores) == len(rows) and all(0 <= s.score <= 1 for s in scores)
    kept = quality_trees.keep(docs, fitted, 0.5)
    assert kept.columns == docs.columns and kept.count() == sum(s.score >= 0.5 for s in scores)
    assert quality_trees.fit(docs, labels.where("false")).score(np.zeros((2, 23))).tolist() == [0.5, 0.5]


def test_empty_tables(spark, none):
    assert window_dedup.remove_repeats(none).count() == 0
    assert signature_trees.link_documents(none).count() == 0
    assert sketches.fingerprints(none).count() == 0
    assert sketches.with_next(none.select(F.col("doc_id").alias("k"), "text"), "k").count() == 0
    assert line_chunks.remove_repeats(none).count() == 0
    assert mixing.mix(none, levels()).count() == 0
    assert pieces.encode(none, model_file()).count() == 0
    assert language.identify(none, language.fit(none)).count() == 0
    assert licences.scan(none, licences.fit(none)).count() == 0
    assert quality_trees.score(none, quality_trees.fit(none, none.selectExpr("doc_id", "1 AS quality"))).count() == 0


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, rows):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    labels = [(r[0], int(i % 4 > 0), 0) for i, r in enumerate(rows)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_pipeline_stages(spark, docs, none, folder):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_trees", "line_chunks", "signature_trees", "mixing", "piece_codec"]
    for table in (docs, none):
        for k, (_, apply) in enumerate(corpus_pipeline.STAGES):
            out = apply(spark, table, folder)
            out.collect()
            assert k == len(corpus_pipeline.STAGES) - 1 or out.columns == table.columns


def test_pipeline(spark, folder):
    out = corpus_pipeline.run(spark, folder).collect()
    assert out and all(r.decoded is None or len(r.ids) == len(r.begins) for r in out)


def test_a_cluster_is_not_paired_with_itself(spark):
    nodes = [(7, a, 1, 1) for a in range(40)] + [(7, 40, 1, 9)]
    spots = spark.createDataFrame(nodes, "token bigint, node bigint, first bigint, last bigint")
    left = spots.selectExpr("token", "node a", "first a_first", "last a_last")
    got = sorted((r["a"], r["b"]) for r in signature_trees._apart(left, spots, ["token"]).collect())
    assert got == [(a, 40) for a in range(41)]


def test_tokens_of_nearly_the_same_leaves_are_followed_as_one(spark):
    r = random.Random(3)
    cluster = [(t, leaf, leaf % 2, 2 + leaf % 3) for t in range(30) for leaf in range(64) if r.random() < 0.97]
    others = [(100 + t, 1000 + 10 * t + i, i, i) for t in range(20) for i in range(2)]
    spots = spark.createDataFrame(cluster + others, "token bigint, node bigint, first bigint, last bigint")
    rows = signature_trees._merged(spots).collect()
    assert len({(x.token, x.node) for x in rows}) == len(rows)
    held = {}
    for x in rows:
        held.setdefault(x.token, {})[x.node] = (x["first"], x["last"])
    assert sum(len(x) ** 2 for x in held.values()) < 10 * 64**2  # one by one: 27 * 64^2
    for t in {x[0] for x in cluster + others}:  # the nodes of a token stay together, with its components
        own = [x for x in cluster + others if x[0] == t]
        assert any(all(n in x and x[n][0] <= a and b <= x[n][1] for _, n, a, b in own) for x in held.values())
    assert sum(100 <= t for t in held) == 20
