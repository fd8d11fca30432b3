import hashlib
import random

import pyarrow as pa

from weftgraph.llm import fingerprints as P


def one(text):
    return P.prints(pa.array([text], pa.string()))[0]


def slow_chunks(data):
    """Boundaries byte by byte."""
    out, start = [], 0
    while start < len(data):
        end = len(data)
        for i in range(start, len(data)):
            h, size = 0, i - start + 1
            for k in range(16):
                if i - k >= 0:
                    h = (h + (int(P._GEAR[data[i - k]]) << (2 * k))) & 0xFFFFFFFF
            if size >= P.LEAST and h & int(P._STRICT) == 0 and size < P.NORMAL or size >= P.NORMAL and h & int(P._LOOSE) == 0 or size == P.MOST:
                end = i + 1
                break
        out.append((start, end))
        start = end
    return out


def test_chunks_equal_the_slow_way():
    rnd = random.Random(1)
    for n in (0, 1, 15, 16, 17, 31, 32, 33, 95, 96, 97, 700):
        text = "".join(rnd.choice("abcdefgh ,.") for _ in range(n))
        chunks = {text[s:e] for s, e in slow_chunks(text.encode())}
        assert sorted(one(text)[1].tolist()) == sorted(map(len, chunks))


def test_context_does_not_matter():
    rnd = random.Random(2)
    texts = ["".join(rnd.choice("abcde éü") for _ in range(rnd.randint(0, 400))) for _ in range(50)]
    for text, own in zip(texts, P.prints(pa.array(texts, pa.string())), strict=True):
        assert P.as_string(own) == P.as_string(one(text))
        back = P.from_string(P.as_string(own))
        assert (back[0] == own[0]).all() and (back[1] == own[1]).all()


def test_likeness_follows_what_is_shared():
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    a, b = " ".join(word() for _ in range(400)), " ".join(word() for _ in range(400))
    assert P.likeness(one(a), one(a)) == 1 and P.likeness(one(a), one(b)) < 0.05
    assert P.likeness(one(a), one(b + a)) > 0.9
    assert P.likeness(one(a), one("xyz " + a[:1000] + " q " + a[1000:])) > 0.8
    assert 0.55 < P.likeness(one(a), one(P.edited(a, b))) < 0.75
    assert P.likeness(one(""), one("")) == 1 and P.likeness(one(""), one(a)) == 0


def test_next_documents_and_defined_cases(spark):
    rnd = random.Random(4)
    rows = [(rnd.randrange(10**6) * 2, "".join(rnd.choice("ab é😀") for _ in range(rnd.randint(0, 90)))) for _ in range(300)]
    rows = list({i: (i, t) for i, t in rows}.values()) + [(2000001, None), (2000003, ""), (2000005, "z" * 300000)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, part string").repartition(5)
    found = {r.doc_id: r for r in P.compared_with_next(df).collect()}
    ordered = sorted(rows, reverse=True)
    assert len(found) == len(rows)
    for (i, text), (_, after) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        text, after = text or "", after or ""
        changed = P.edited(text, after)
        r = found[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (P.as_string(one(text)), P.as_string(one(changed)))
        assert r.near_edited == P.likeness(one(text), one(changed)) and r.near_next == P.likeness(one(text), one(after))


def test_repeated_and_single_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a" * 40), (1, "a" * 40), (1, "b" * 40), (None, "c")], "doc_id long, text string")
    assert P.compared_with_next(df).count() == 4
    (r,) = P.compared_with_next(df.where("text = 'c'")).collect()
    assert r.near_next == 1 and r.doc_id is None
    assert P.compared_with_next(df.where("doc_id > 5")).count() == 0
    assert [len(r.fingerprint) > 0 for r in P.fingerprints(df).collect()] == [True] * 4
