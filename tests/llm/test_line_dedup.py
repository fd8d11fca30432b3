import random
import re

import numpy as np
import pyarrow as pa

from weftgraph.llm import line_dedup as L
from weftgraph.llm._text import text_slices, words


def units(text):
    return [" ".join(u.split()) for line in text.split("\n") for u in re.split(r"(?<=[.!?])\s+", line) if u.split()]


def sentence(rnd, n=9):
    return " ".join("".join(rnd.choice("abcdefghijklm") for _ in range(rnd.randint(2, 7))) for _ in range(n)) + "."


def run(spark, rows):
    return {r.doc_id: r for r in L.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def test_later_passages_go_and_the_first_stays(spark):
    rnd = random.Random(1)
    passage = [sentence(rnd) for _ in range(6)]
    own = [[sentence(rnd) for _ in range(8)] for _ in range(20)]
    rows = [(k, "\n".join(o[:4]) + "\n" + " ".join(passage) + "\n" + "\n".join(o[4:])) for k, o in enumerate(own)]
    found = run(spark, rows)
    assert found[0].text == rows[0][1] and found[0].n_removed_words == 0
    for k in range(1, 20):
        assert units(found[k].text) == own[k] and found[k].n_removed_words == 54


def test_passages_inside_of_lines(spark):
    rnd = random.Random(2)
    passage = [sentence(rnd) for _ in range(7)]
    own = [[sentence(rnd, 5).rstrip(".") for _ in range(2)] for _ in range(6)]
    found = run(spark, [(k, f"{a} {' '.join(passage)} {b}.") for k, (a, b) in enumerate(own)])
    assert all(passage[3] in found[0].text for k in range(1))
    for k, (a, b) in enumerate(own):
        assert a in found[k].text and b in found[k].text
        assert k == 0 or not any(p in found[k].text for p in passage[1:])


def test_every_deleted_line_stays_somewhere_and_long_runs_are_found(spark):
    rnd = random.Random(3)
    pool = [sentence(rnd, rnd.choice([2, 5, 9, 14])) for _ in range(60)]
    rows = []
    for k in range(60):
        text = []
        for _ in range(rnd.randint(1, 4)):
            if rnd.random() < 0.5:
                s = rnd.randrange(50)
                text += pool[s : s + rnd.randint(1, 9)]
            text += [sentence(rnd) for _ in range(rnd.randint(0, 4))]
        rows.append((k, rnd.choice(["\n", " "]).join(text)))
    found = run(spark, rows)
    before, after = {u for _, t in rows for u in units(t)}, {u for r in found.values() for u in units(r.text)}
    assert before == after
    seen = {}
    for k, r in sorted(found.items()):
        u = units(r.text)
        for j in range(len(u) - 3):
            key = tuple(u[j : j + 4])
            if sum(len(x.split()) for x in key) >= L.MIN_WORDS:
                assert seen.setdefault(key, (k, j)) == (k, j)
    assert all(len(rows[k][1].split()) - len(r.text.split()) == r.n_removed_words for k, r in found.items())


def test_short_whole_lines_and_repeats_inside_a_document(spark):
    line = "one two three four. Five six seven eight."
    found = run(spark, [(1, f"{line}\nAlone here."), (2, f"Other words.\n{line}\nEr."), (3, f"x {line}\nEr."), (4, f"{line}\n{line}\nq")])
    assert found[1].n_removed_words == 0 and found[3].n_removed_words == 0
    assert (found[2].text, found[2].n_removed_words) == ("Other words.\nEr.", 8)
    assert (found[4].text, found[4].n_removed_words) == ("q", 16)


def test_defined_cases(spark):
    rnd = random.Random(5)
    long = "\n".join(sentence(rnd) for _ in range(20000))
    rows = [(1, None, 5), (2, "", 5), (3, long, 5), (4, long, 5), (4, long, 5), (None, long, 5), (None, long, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    found = L.without_repeats(df)
    assert found.columns == ["doc_id", "text", "spans", "n_removed_words"]
    assert sorted((r.doc_id or 0, len(r.text or ""), r.n_removed_words) for r in found.collect()) == [(0, len(long), 0), (0, len(long), 0), (1, 0, 0), (2, 0, 0), (3, len(long), 0), (4, 0, 180000), (4, 0, 180000)]
    kept = L.dedup_lines(df)
    assert kept.columns == df.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 0, 1, 2, 3]
    assert L.without_repeats(df.where("doc_id < 0")).count() == 0


def test_every_repeat_of_enough_words_goes_wherever_it_stands(spark):
    rnd = random.Random(6)
    fresh = iter(range(10**9))
    own = lambda n: [f"own{next(fresh)}" for _ in range(n)]
    passages = [sentence(rnd, n).rstrip(".").split() for n in (25, 26, 30, 40, 60, 120)]
    rows = []
    for k in range(120):
        words = own(rnd.randint(0, 12))
        for _ in range(rnd.randint(1, 3)):
            p = rnd.choice(passages)
            s = rnd.randint(0, len(p) - 20)
            words += p[s : rnd.randint(s + 20, len(p))] + own(rnd.randint(1, 9))
        rows.append((k, " ".join(words)))
    found = run(spark, rows)
    seen = set()
    for k, text in rows:
        words = text.split()
        gone = [False] * len(words)
        for j in range(len(words) - L.MIN_WORDS + 1):
            window = tuple(words[j : j + L.MIN_WORDS])
            if window in seen:
                gone[j : j + L.MIN_WORDS] = [True] * L.MIN_WORDS
            seen.add(window)
        assert found[k].text.split() == [w for w, g in zip(words, gone, strict=True) if not g], k


def test_short_sentences_repeat_from_four_on(spark):
    line = "Yes it is. No it is not. Well then. Go on now."
    found = run(spark, [(1, f"Before all. {line} After all."), (2, f"Other words.\n{line}\nEr.")])
    assert found[1].n_removed_words == 0 and (found[2].text, found[2].n_removed_words) == ("Other words.\nEr.", 12)


def test_passages_whose_parts_came_up_before_in_other_company(spark):
    """Every pair of neighbouring sentences comes up in an earlier document, in other contexts; the whole passage goes at its second place all the same."""
    rnd = random.Random(9)
    six = [sentence(rnd, 14) for _ in range(6)]
    pairs = " ".join(f"{a} {b} {sentence(rnd, 11)}" for a, b in zip(six[:-1], six[1:], strict=True))
    found = run(spark, [(1, pairs), (2, f"{sentence(rnd)} {' '.join(six)} {sentence(rnd)}"), (3, f"{sentence(rnd)} {' '.join(six)} {sentence(rnd)}")])
    assert found[1].n_removed_words == 28 * 0 and found[3].n_removed_words == 84 and not any(x in found[3].text for x in six)


def test_places_of_whole_ids_meet_without_sorting(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c d")], "id long, text string")
    plan = L.repeats(docs)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "ShuffledHashJoin" in plan and "Sort" not in plan


def test_ids_of_any_kind_give_the_same(spark):
    rnd = random.Random(12)
    pool = [sentence(rnd, rnd.choice([3, 8, 13])) for _ in range(40)]
    texts = []
    for _ in range(30):
        s = rnd.randrange(30)
        texts.append(rnd.choice(["\n", " "]).join([sentence(rnd), *pool[s : s + rnd.randint(1, 9)], sentence(rnd), *pool[s : s + rnd.randint(0, 9)]]))
    expected = None
    for kind, name in (("long", int), ("int", lambda k: k - 15), ("long", lambda k: (k - 15) << 58), ("long", lambda k: k - (1 << 63)), ("tinyint", int), ("string", "{:03d}".format)):
        rows = spark.createDataFrame([(name(k), text) for k, text in enumerate(texts)], f"doc_id {kind}, text string")
        found = [(r.text, r.n_removed_words) for r in sorted(L.without_repeats(rows).collect(), key=lambda r: r.doc_id)]
        expected = expected or found
        assert found == expected and sum(n for _, n in found) > 100, kind


def test_hashes_of_words_depend_on_every_byte_and_on_nothing_else():
    texts = ["x" * n for n in range(1, 140)] + ["x" * k + "y" + "x" * (n - k - 1) for n in (1, 7, 8, 9, 16, 63, 64, 65, 130) for k in range(n)] + ["\0", "\0\0", "x\0"]
    texts = [text.encode() for text in sorted(set(texts))]

    def hashes(before, between):
        data = before + between.join(texts)
        size = np.array([len(text) for text in texts])
        end = len(before) + np.cumsum(size + len(between)) - len(between)
        return L._word_hashes(np.frombuffer(data, np.uint8), end - size, end)

    assert len(set(hashes(b"", b" ").tolist())) == len(texts)
    assert (hashes(b"", b" ") == hashes(b"before ", b"\n--\n")).all()


def test_words_are_those_of_the_shared_splitter():
    rnd = random.Random(13)
    for _ in range(300):
        rows = ["".join(rnd.choice("ab. \n\t\x0b\x0c\ré\0") for _ in range(rnd.choice([0, 0, 1, 3, 60]))) for _ in range(rnd.randint(1, 6))]
        for _, _, data, offsets in text_slices(pa.array(rows)):
            assert all((x == y).all() for x, y in zip(words(data, offsets), L._words(data, offsets), strict=True)), rows
