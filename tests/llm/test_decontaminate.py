import random
import re
import time

import numpy as np
import pytest

from weftgraph.llm import decontaminate as D


def brute(a, t, least):
    least = min(least, len(a))
    free_a, free_t, total = [True] * len(a), [True] * len(t), 0
    while least:
        best, found = 0, []
        for i in range(len(a)):
            for j in range(len(t)):
                k = 0
                while i + k < len(a) and j + k < len(t) and free_a[i + k] and free_t[j + k] and a[i + k] == t[j + k]:
                    k += 1
                if k > best:
                    best, found = k, [(i, j)]
                elif k == best and k:
                    found.append((i, j))
        if best < least:
            break
        for i, j in found:
            if all(free_a[i : i + best]) and all(free_t[j : j + best]):
                free_a[i : i + best] = free_t[j : j + best] = [False] * best
                total += best
    return total


def test_tiles_equal_brute_force():
    rnd = random.Random(1)
    for k in range(400):
        a, t = ([rnd.choice("abc"[: 1 + k % 3]) for _ in range(rnd.randint(0, n))] for n in (14, 25))
        ours = D.tiles(*(np.array([ord(c) for c in x], np.uint64) for x in (a, t)), 3)
        assert sum(x[2] for x in ours) == brute(a, t, 3), (a, t)
        for i, j, k in ours:
            assert a[i : i + k] == t[j : j + k]


ITEM = "Alpha beta gamma delta epsilon zeta. Eta theta iota kappa lambda mu nu; xi omicron pi rho sigma tau upsilon."
PARTS = ["Alpha beta gamma delta epsilon zeta.", "Eta theta iota kappa lambda mu nu;", "xi omicron pi rho sigma tau upsilon."]


def test_passages_in_one_piece_reordered_and_partial(spark):
    rows = [
        (1, f"before {ITEM} after"),
        (2, f"x {PARTS[2]} y {PARTS[0]} z {PARTS[1]} w"),
        (3, f"x {PARTS[2].upper()} y*** {PARTS[0]}!!"),
        (4, PARTS[0]),
        (5, "nothing of that kind is to be found in here at all"),
        (6, ITEM.upper().replace(" ", "*** ")),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(10, ITEM), (11, None), (12, ""), (13, "Short one"), (14, "other words that never come up anywhere else")], "item_id long, text string")
    found = {r.doc_id: r for r in D.contamination(docs, items).collect()}
    assert set(found) == {1, 2, 6} and all(r.item_id == 10 for r in found.values())
    assert found[1].coverage == 1 and found[1].n_tiles == 1 and found[2].coverage == 1 and found[2].n_tiles == 3
    assert {r.doc_id for r in D.contamination(docs, items, coverage=0.6).collect()} == {1, 2, 3, 6}
    assert {r.doc_id for r in D.decontaminated(docs, items).collect()} == {3, 4, 5}


@pytest.mark.parametrize("size", [32 << 20, 150])
def test_short_items_and_ties_items_and_ties(spark, monkeypatch, size):
    monkeypatch.setattr(D, "BROADCAST_BYTES", size)
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    items = [(k, " ".join(word() for _ in range(rnd.randint(2, 20)))) for k in range(12)] + [(20, "ab cd"), (21, "ab cd")]
    docs = [(k, " ".join([word() for _ in range(30)] + items[k][1].split() + [word() for _ in range(30)])) for k in range(12)] + [(30, "x ab cd y"), (31, None), (32, "")]
    found = {(r.doc_id, r.item_id) for r in D.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert found == {(k, k) for k in range(12)} | {(30, 20), (30, 21)}


def test_repeated_words_take_no_quadratic_time():
    started = time.process_time()
    one = np.full(20000, 7, np.uint64)
    assert D.tiles(one[:2000], one) == [(0, 0, 2000)]
    two = np.tile(np.array([7, 7, 9], np.uint64), 5000)
    assert sum(x[2] for x in D.tiles(one[:2000], two)) == 0 and sum(x[2] for x in D.tiles(two[:999], two[1:])) == 999
    assert time.process_time() - started < 5


@pytest.mark.parametrize("size", [32 << 20, 10])
def test_both_ways_give_the_same_rows(spark, monkeypatch, size):
    monkeypatch.setattr(D, "BROADCAST_BYTES", size)
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcd") for _ in range(3))
    items = [(k, " ".join(word() for _ in range(rnd.randint(1, 30)))) for k in range(30)] + [(None, "only in one, and of no id at all"), (5, "only in one, and of no id at all")]
    docs = []
    for k in range(60):
        parts = rnd.choice(items)[1].split()
        cut = rnd.randint(0, len(parts))
        docs.append((k if k % 9 else None, " ".join([word() for _ in range(20)] + parts[cut:] + [word() for _ in range(20)] + parts[:cut])))
    docs += [docs[1], (90, None), (91, ""), (92, "x only in one and of no id at all x")]
    tokens = lambda t: re.findall(r"[a-z0-9]+", (t or "").lower())
    code = {}
    coded = lambda t: np.array([code.setdefault(w, len(code) + 1) for w in tokens(t)], np.uint64)
    expected = []
    for i, text in docs:
        for item, test in items:
            a, t = coded(test), coded(text)
            seeds = lambda x, n: {tuple(x[k : k + n].tolist()) for k in range(len(x) - n + 1)}
            if seeds(a, min(5, len(a))) & seeds(t, min(5, len(a))) and brute(a.tolist(), t.tolist(), 5) >= 0.8 * len(a):
                expected.append((i, item))
    d = spark.createDataFrame([(None if i is None else i, t) for i, t in docs], "doc_id smallint, text string")
    b = spark.createDataFrame(items, "item_id smallint, text string")
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted(((r.doc_id, r.item_id) for r in D.contamination(d, b).collect()), key=key) == sorted(expected, key=key)
    clean = [(i, t) for i, t in docs if (i, t) not in {(x, y) for x, y in docs if any(e[0] == x for e in expected) and x is not None}]
    left = {(r.doc_id, r.text) for r in D.decontaminated(d, b).collect() if r.doc_id is not None}
    assert left == {(i, t) for i, t in clean if i is not None}


def test_defined_cases(spark):
    rows = [(1, ITEM, 0, "a"), (1, ITEM, 0, "a"), (None, ITEM, 0, "a"), (2, "q " * 200000 + ITEM, 0, "a"), (3, None, 0, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id int, coverage string")
    items = spark.createDataFrame([(10, ITEM)], "item_id long, text string")
    assert sorted((r.doc_id or 0) for r in D.contamination(docs, items).collect()) == [0, 1, 1, 2]
    assert [(r.doc_id, r.n_items, r.items) for r in D.contaminated(docs, items).orderBy("doc_id").collect()] == [(None, 1, [10]), (1, 1, [10]), (2, 1, [10])]
    left = D.decontaminated(docs, items)
    assert left.columns == docs.columns and [r.doc_id for r in left.collect()] == [3]
    assert D.contamination(docs, items.where("item_id < 0")).count() == 0 and D.contamination(docs.where("doc_id < 0"), items).count() == 0
