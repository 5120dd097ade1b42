"""Small inputs with every awkward case, and brute-force versions of the operators."""

from __future__ import annotations

import random
import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    out = []
    for _ in range(n):
        out.append("".join(r.choice(["ba", "ne", "tor", "li", "qué", "ß", "um"]) for _ in range(r.randint(1, 4))))
        out.append("\n" if r.random() < 0.08 else " ")
    return "".join(out).strip()


def corpus() -> list[tuple]:
    texts = [prose(i, 30 + 11 * i) for i in range(24)]
    texts += [texts[3], texts[3], texts[5].upper(), texts[7] + " one more end", prose(99, 3) + "\n" + texts[9]]
    shared = prose(500, 60)
    texts += [prose(600 + i, 20) + "\n" + shared + "\n" + prose(700 + i, 20) for i in range(5)]
    near = prose(800, 120).split(" ")
    for i in range(12):
        own = list(near)
        own[10 * i % len(own)] = f"edit{i}"
        texts.append(" ".join(own))
    texts += ["", None, " \t\n ", "one", "One two", "one two", "a b c d", "x" * 300, "word " * 400, "\n\n\n", "▁ 日本 \u0000 é\r\n\x0b"]
    texts.append(prose(900, 30_000))
    rows = [(3 * i - 4, t, ("en", "fr", None)[i % 3], f"src{i % 5}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[2], rows[2], (rows[4][0], "another text of the same key " + prose(901, 40), "en", "src1", 1), (None, texts[6], "en", "src0", 5)]
    return rows


def clashing(spark, rows):
    """The rows with columns that have the names the operators work with."""
    names = "k t v n row gone near part place comp size set token digest epoch score n_taken n_lines n_removed full rest cut_key next".split()
    df = spark.createDataFrame(rows, SCHEMA)
    return df.selectExpr("*", *(f"'{c}' AS {c}" for c in names))


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def shingle_set(text: str | None, width: int) -> set[tuple]:
    w = words((text or "").translate(UPPER))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def components(pairs, ids) -> dict:
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {i: root(i) for i in ids}


def removed_words(rows: dict, width: int) -> dict:
    """For each integer key the intervals of words to remove."""
    first: dict = {}
    for key in sorted(rows):
        w = words(rows[key])
        for j in range(len(w) - width + 1):
            first.setdefault(tuple(w[j : j + width]), key)
    out = {}
    for key, text in rows.items():
        w = words(text)
        gone = [False] * len(w)
        for j in range(len(w) - width + 1):
            if first[tuple(w[j : j + width])] < key:
                gone[j : j + width] = [True] * width
        out[key] = gone
    return out


def linked(texts: dict, width: int, percent: int) -> dict:
    sets = {k: shingle_set(t, width) for k, t in texts.items()}
    holders = defaultdict(set)
    for k, s in sets.items():
        for x in s:
            holders[x].add(k)
    pairs = set()
    for k, s in sets.items():
        for other in {j for x in s for j in holders[x] if j < k}:
            o = len(s & sets[other])
            if 100 * o >= percent * (len(s) + len(sets[other]) - o):
                pairs.add((other, k))
    return components(pairs, sets)
