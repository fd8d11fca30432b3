import random
from collections import defaultdict

import numpy as np
import pytest

from weftgraph.llm import near_dedup as N


def sets_of(rows):
    out = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        out[i] = frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()
    return out


def brute(rows, percent):
    sets = sets_of(rows)
    parent = {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in ids}


def corpus(seed=5, n=160):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdef") for _ in range(rnd.randint(1, 6)))
    texts = []
    for _ in range(n):
        kind = rnd.random()
        if texts and kind < 0.25:
            texts.append(rnd.choice(texts))
        elif texts and kind < 0.7:
            w = rnd.choice(texts).split(" ")
            for _ in range(rnd.randint(1, 4)):
                w[rnd.randrange(len(w))] = word()
            texts.append(" ".join(w))
        else:
            texts.append(" ".join(word() for _ in range(rnd.choice([1, 3, 4, 5, 60, 120, 300]))))
    return [(7 * k + 3, t) for k, t in enumerate(texts)]


@pytest.mark.parametrize("percent", [80, 85])
def test_groups_equal_brute_force(spark, percent):
    rows = corpus()
    found = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent).collect()
    expected = brute(rows, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == expected
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_large_group_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 8)
    rnd = random.Random(1)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(3):
            w[rnd.randrange(150)] = f"x{rnd.randrange(999)}"
        rows.append((i, " ".join(w)))
    found = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 85).collect()
    assert {r.doc_id: r.component_id for r in found} == {i: c for i, (_, c) in brute(rows, 85).items()}


def test_defined_cases(spark):
    long = "so long a text " * 30000
    rows = [(1, None, 1, "x"), (2, "", 2, "x"), (3, " \n\t ", 3, "x"), (4, "A b", 4, "x"), (5, "a B", 5, "x"), (6, "a b", 6, "x"), (6, "a b", 6, "x"), (7, long, 7, "x"), (8, long, 8, "x"), (None, "zz", 9, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component long, keys string")
    found = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in N.near_duplicates(df).collect()}
    assert found == {(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 1, 4, False), (7, 4, 7, True), (8, 4, 7, False), (None, 1, None, False)}
    assert N.near_duplicates(df).count() == len(rows)
    assert N.near_duplicates(df.where("doc_id < 0")).count() == 0


def test_words_end_at_ascii_white_space_only(spark):
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (3, "É b c d e f"), (4, "é b c d e f")]
    found = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in found} == {1: 1, 2: 2, 3: 3, 4: 4}


def test_odd_sketches_estimate_similarity():
    rng = np.random.default_rng(0)
    for share in (0.7, 0.85, 0.95):
        n, errors = 600, []
        for _ in range(20):
            pool = np.unique(rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64))
            common = int(2 * n * share / (1 + share) / 2 * 2) // 2 * 2 // 2
            a, b = np.sort(pool[:n]), np.sort(np.concatenate([pool[:common], pool[n : 2 * n - common]]))
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            begin = np.array([0, len(a), len(a) + len(b)])
            x, y = N.odd_sketches(N.min_hashes(np.concatenate([a, b]), begin)).view(np.uint64)
            bits = int(np.bitwise_count(x ^ y).sum())
            errors.append(1 + N.SKETCH_BITS / (4 * N.PLACES) * np.log(1 - 2 * min(bits, 255) / N.SKETCH_BITS) - true)
        assert abs(np.mean(errors)) < 0.05


def test_components_are_exact(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(80), rnd.randrange(80)) for _ in range(60)] + [(k, k + 1) for k in range(100, 160)]
    found = {r.id: r.component for r in N.components(spark.createDataFrame(edges, "a long, b long"), "test").collect()}
    near = defaultdict(set)
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    for start in near:
        seen, stack = {start}, [start]
        while stack:
            for x in near[stack.pop()] - seen:
                seen.add(x)
                stack.append(x)
        assert found[start] == min(seen)
    assert set(found) == set(near)


@pytest.mark.parametrize("shuffled", [False, True])
def test_long_paths_take_few_rounds(spark, monkeypatch, shuffled):
    ids = list(range(1001))
    if shuffled:
        random.Random(1).shuffle(ids)
    tables, own = [], N.stored
    monkeypatch.setattr(N, "stored", lambda df, name: tables.append(name) or own(df, name))
    edges = spark.createDataFrame(list(zip(ids[:-1], ids[1:], strict=True)), "a long, b long").coalesce(1)
    found = N.components(edges, "path").collect()
    assert len(found) == 1001 and all(r.component == 0 for r in found)
    assert len(tables) <= (40 if shuffled else 14)
