"""Leaked passages against a plain search, and tiles against a plain greedy tiling."""

from __future__ import annotations

import random
import re
import time

import numpy as np

from linkloom.llm import leaks as L

DOCS, ITEMS = "doc_id bigint, text string, item_id string, longest int", "item_id bigint, text string, doc_id string"


def plain(docs, items, k):
    find, out = re.compile(r"[^\W_]+").findall, set()
    for i, it in items:
        if it is None:
            continue
        w = find(it.lower())
        grams = {tuple(w[a : a + k]) for a in range(len(w) - k + 1)}
        for d, text in docs:
            v = find((text or "").lower())
            if any(tuple(v[a : a + k]) in grams for a in range(len(v) - k + 1)):
                out.add((d, i))
    return out


def test_against_plain_search(spark, monkeypatch):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rng.choices(words, k=rng.randrange(5, 60)))) for i in range(20)] + [(50, None), (51, ""), (52, "Ein Wort"), (3, "repeat " * 14)]
    docs = [(100, None), (101, ""), (102, "?!"), (103, "repeat, " * 40)]
    for d in range(60):
        parts = []
        for _ in range(rng.randrange(4)):
            src = items[rng.randrange(20)][1].split()
            a = rng.randrange(len(src))
            parts += [", ".join(src[a : a + rng.randrange(5, 30)]).upper(), "filler_text", *rng.choices(words + ["new"], k=rng.randrange(6))]
        docs.append((d, " ".join(parts)))
    want = plain(docs, items, 12)
    assert len(want) > 20
    for most in (L.MAX_WORDS, 10):
        monkeypatch.setattr(L, "MAX_WORDS", most)
        d = spark.createDataFrame([(*x, "clash", 1) for x in docs], DOCS)
        i = spark.createDataFrame([(*x, "clash") for x in items], ITEMS)
        assert {(r["doc_id"], r["item_id"]) for r in L.leaked(d, i, min_coverage=2.0).collect()} == want
        got = L.leaked(d, i, min_tile=5, min_coverage=0.4).collect()
        wide = {(r["doc_id"], r["item_id"]): tuple(r)[2:] for r in got}
        assert want < set(wide) and len(got) == len(wide) and all(x >= 12 or c >= 0.4 for x, _, c in wide.values())
        assert wide == one_by_one(docs, items, 5, 0.4)
    assert L.leaked(d.limit(0), i).count() == 0 == L.leaked(d, i.limit(0)).count()


def test_rolling_hashes_agree_where_windows_do():
    codes = np.array([random.Random(4).randrange(1, 4) for _ in range(500)])
    for width in (1, 2, 3, 7, 12, 16):
        h = L.rolling(codes, width)
        assert len(h) == 501 - width
        groups = {}
        for a, x in enumerate(h.tolist()):
            groups.setdefault(x, set()).add(tuple(codes[a : a + width]))
        assert all(len(g) == 1 for g in groups.values())
        assert len(groups) == len({tuple(codes[a : a + width]) for a in range(501 - width)})
    assert len(L.rolling(codes[:3], 12)) == 0


def tiles(doc, item, width):
    code = L.Codes()
    return L.tiles(code.of(doc), code.of(item), width)


def plain_tiles(doc, item, width):
    a, b, out = L.words(doc), L.words(item), []
    while True:
        best = (0, 0, 0)
        for d in range(len(a)):
            for t in range(len(b)):
                n = 0
                while d + n < len(a) and t + n < len(b) and a[d + n] is not None and a[d + n] == b[t + n]:
                    n += 1
                if n > best[2]:
                    best = (d, t, n)
        if best[2] < width:
            return out
        out.append(best)
        a[best[0] : best[0] + best[2]] = [None] * best[2]
        b[best[1] : best[1] + best[2]] = [0] * best[2]


def one_by_one(docs, items, width, coverage):
    out = {}
    for i, it in items:
        n = len(L.words(it or ""))
        for d, text in docs:
            own = plain_tiles(text or "", it or "", width)
            longest, covered = max((x[2] for x in own), default=0), sum(x[2] for x in own)
            if own and (longest >= 12 or covered >= coverage * n):
                out[d, i] = (longest, covered, covered / n)
    return out


def test_reordered_passage_is_several_tiles():
    w = [f"t{i}" for i in range(40)]
    own = tiles("x " + " ".join(w[20:40]) + " y " + " ".join(w[0:18]), " ".join(w), 12)
    assert own == [(1, 20, 20), (22, 0, 18)]


def test_pieces_of_six_words_are_found_by_coverage(spark, monkeypatch):
    rng = random.Random(5)
    w = [f"t{i}" for i in range(48)]
    pieces = [w[i : i + 6] for i in range(0, 48, 6)]
    rng.shuffle(pieces)
    docs = spark.createDataFrame([(1, " filler ".join(" ".join(p) for p in pieces), "", 0), (2, " ".join(pieces[0] + ["x"] + pieces[2]), "", 0)], DOCS)
    items = spark.createDataFrame([(9, " ".join(w), "")], ITEMS)
    for most in (L.MAX_WORDS, 1):
        monkeypatch.setattr(L, "MAX_WORDS", most)
        assert [tuple(r) for r in L.leaked(docs, items).collect()] == [(1, 9, 6, 48, 1.0)]
        assert L.leaked(docs, items, min_tile=12).count() == 0


def test_tiles_do_not_overlap():
    assert tiles("a b c d e f g h i j k l m n a b c d e f g h i j k l", "a b c d e f g h i j k l m n", 12) == [(0, 0, 14)]


def test_tiles_against_plain_tiling():
    rng = random.Random(6)
    for _ in range(150):
        a, b = (" ".join(rng.choices("abc", k=rng.randrange(30))) for _ in range(2))
        want, got = plain_tiles(a, b, 3), tiles(a, b, 3)
        assert sorted(x[2] for x in got) == sorted(x[2] for x in want) and got[:1] == want[:1]


def test_text_that_repeats_itself():
    began = time.time()
    assert tiles("same " * 8000, "same " * 300, 6) == [(0, 0, 300)]
    assert len(tiles("one two " * 4000, "one two three " * 100, 2)) == 100
    assert time.time() - began < 5
