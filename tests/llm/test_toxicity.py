import random
import zlib

import numpy as np
import pytest

from weftgraph.llm import toxicity as T


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_matches_equal_brute_force():
    rnd = random.Random(1)
    terms = [w + T.END for w in ("idiot", "worthless", "scum", "ababa")]
    lexicon = T.Lexicon([*terms, "lowei"], ["weak" + T.END, "bobo"])
    for _ in range(6000):
        w = list(rnd.choice([*(t.strip(T.END) for t in terms), "lowei", "weak", "bobo"]))
        for _ in range(rnd.randint(0, 3)):
            k, what = rnd.randint(0, len(w)), rnd.random()
            if what < 0.3:
                w[k : k + 1] = []
            else:
                w[k : k + (what > 0.6)] = [rnd.choice("abiotxw")]
        word = "".join(w)
        exact = word + T.END in terms or word.startswith("lowei")
        near = any(distance(word, t[:-1]) <= T.edits_for(t[:-1]) for t in terms)
        expected = 1 if exact else 2 if near else 3 if word == "weak" or word.startswith("bobo") else 0
        assert lexicon.match(word) == expected, word


def test_quotations_count_apart():
    lexicon = T.Lexicon(["idiot" + T.END])
    assert lexicon.counts("you are an idiot.")[:5] == (1, 0, 0, 0, 0)
    assert lexicon.counts("you are an idoit or idjot")[:5] == (0, 1, 0, 0, 0)
    for text in ('he said "idiot" to them', "they used the word idiot in court", "er nannte ihn „ein großer idiot“, oder", "«quel idiot !» dit-elle", '"you are an idiot," he said', "( “idiot” )", 'so " idiot " it is'):
        assert lexicon.counts(text)[:5] == (0, 0, 0, 1, 0), text
    for text in ('"hello" you idiot "bye"', 'you idiot "bye" then', '"hello" you idiot', "in other words you are an idiot", 'you idiot" it', "don’t you idiot don’t"):
        assert lexicon.counts(text)[:5] == (1, 0, 0, 0, 0), text
    assert lexicon.counts("he said you are an idiot")[:5] == (1, 0, 0, 0, 1)
    rows = T.features(np.array([[0, 0, 0, 5, 0, 10], [0, 0, 0, 0, 0, 10], [1, 0, 0, 0, 1, 10], [1, 0, 0, 0, 0, 10]], float))
    assert rows.shape[1] == T.FEATURES and (rows[0] != rows[1]).any() and (rows[2] != rows[3]).any()


def test_labels_say_what_quotations_are_worth(spark):
    words = "ba do ki lu me na so ti".split()
    for worth in (0, 1):
        rows = []
        for i in range(600):
            rnd = random.Random(i)
            some = [rnd.choice(words) + rnd.choice(words) for _ in range(30)]
            kind = i % 3
            some[9:9] = [["zorgle"], ['"zorgle"'], []][kind]
            rows.append((i, " ".join(some), [1, worth, 0][kind]))
        docs = spark.createDataFrame([r[:2] for r in rows] + [(900, 'ki ba "zorgle" do'), (901, "ki ba zorgle do")], "doc_id long, text string")
        labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
        found = {r.doc_id: r.predicted for r in T.toxicity(docs, labels).collect()}
        assert (found[900], found[901]) == (worth, 1)


def test_counts_equal_brute_force():
    rnd = random.Random(6)
    terms = ["idiot", "scum"]
    lexicon = T.Lexicon([t + T.END for t in terms])
    parts = ["idiot", "scum", "idiott", '"', "ba", "do,", "word", "said", '"ba', 'do"', '"ki"', "scum.", '"scum"', '"idiot', 'idiot"']
    for _ in range(3000):
        tokens = [rnd.choice(parts) for _ in range(rnd.randint(0, 12))]
        expected = [0, 0, 0, 0, 0, len(tokens)]
        for i, t in enumerate(tokens):
            bare = t.strip('"., ')
            kind = 0 if bare in terms else 1 if any(distance(bare, x) <= T.edits_for(x) for x in terms) else None
            if kind is None:
                continue
            before, after = tokens[max(0, i - T.CONTEXT) : i], tokens[i + 1 : i + 1 + T.CONTEXT]
            # the nearest mark on either side, as a mark at the beginning or at the end of its word
            near = ["("] if t[0] == '"' else [x for b in reversed(before) for x in ((")" if b[-1:] == '"' and len(b) > 1 else "") or ("(" if b[0] == '"' else ""),) if x]
            far = [")"] if t.rstrip(".,")[-1] == '"' else [x for a in after for x in (("(" if a[0] == '"' and len(a) > 1 else "") or (")" if a.rstrip(".,")[-1:] == '"' else ""),) if x]
            quoted = near[:1] == ["("] and far[:1] == [")"] or before[-1:] == ["word"]
            expected[3 if quoted else kind] += 1
            expected[4] += not quoted and "said" in before
        assert lexicon.counts(" ".join(tokens)) == tuple(expected), tokens


def test_long_words_and_equal_runs(spark, tables):
    docs, labels = tables
    long = "z" * 60
    more = spark.createDataFrame([(5000 + i, f"ba do {long} ki {i}", "en", "s") for i in range(40)], docs.schema)
    told = spark.createDataFrame([(5000 + i, 1) for i in range(40)], labels.schema)
    both = [T.fitted(docs.unionAll(more).repartition(n), labels.unionAll(told)) for n in (3, 7)]
    assert both[0].weights == both[1].weights and both[0].made_of == both[1].made_of
    assert both[0].scores([f"me {long} na"])[0] >= 0.5 > both[0].scores(["me na"])[0]


@pytest.fixture(scope="module")
def tables(spark):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice(["ba", "do", "ki", "lu", "me", "na"]) for _ in range(rnd.randint(1, 4)))
    docs, labels = [], []
    for i in range(900):
        w = [word() for _ in range(rnd.randint(20, 80))]
        toxic = rnd.random() < 0.2
        if toxic:
            for _ in range(3):
                w.insert(rnd.randrange(len(w)), rnd.choice(["idiot", "worthless", "zorgle", "zorgly"]))
        docs.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    docs += [(2000, "you wortless idiiot"), (2001, "ba do ki lu"), (2002, None), (2003, ""), (2004, "ba " * 100000 + "idiot worthless"), (2004, "ba " * 100000 + "idiot worthless")]
    return spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "text", "'en' AS score", "'s' AS source"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_accuracy(tables):
    docs, labels = tables
    found = {r.doc_id: r for r in T.toxicity(docs, labels).collect()}
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    for i, y in truth.items():
        assert found[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
    held = [i for i in truth if found[i].held_out]
    assert len(held) > 100 and sum(found[i].predicted == truth[i] for i in held) >= 0.99 * len(held)
    assert all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in found.values())
    assert found[2000].predicted == 1 and found[2001].predicted == found[2002].predicted == found[2003].predicted == 0


def test_filter_keeps_clean_rows_and_all_columns(tables):
    docs, labels = tables
    kept = T.filtered(docs, labels)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert {2001, 2002, 2003} <= ids and 2000 not in ids and sum(r.toxic == 0 and r.doc_id in ids for r in labels.collect()) == labels.where("toxic = 0").count()


def test_held_out_labels_are_not_learned_from(spark, tables):
    docs, labels = tables
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(doc_id AS STRING)) % 5 = 0 THEN 1 - toxic ELSE toxic END AS toxic")
    assert T.fitted(docs, labels).weights == T.fitted(docs, flipped).weights


def test_labels_of_one_kind_or_none_and_empty_tables(spark, tables):
    docs, labels = tables
    for some in (labels.where("doc_id < 0"), labels.where("toxic = 0"), spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")):
        assert {r.predicted for r in T.toxicity(docs, some).collect()} == {0}
    assert T.toxicity(docs.where("doc_id < 0"), labels).count() == 0


def test_misspelt_stems_and_weak_terms():
    lexicon = T.Lexicon(["idiot", "scum" + T.END], ["worthless" + T.END, "zorgl"], clean_words=frozenset(["idiolt"]), loose=True)
    expected = {"idiots": 1, "idjot": 2, "idjots": 2, "idiott": 1, "iddiotic": 2, "idio": 2, "idiom": 2, "idiolt": 0, "idiosyncratic": 0, "scim": 0, "worthless": 3, "wortless": 4, "wrthles": 4, "wrthle": 0, "zorgly": 3, "zurgle": 4, "zurgel": 0}
    assert {w: lexicon.match(w) for w in expected} == expected
    assert lexicon.counts("idjots are wortless")[:4] == (0, 1, 1, 0)


def test_misspelt_words_of_a_learned_stem_are_toxic(spark, tables):
    docs, labels = tables
    more = spark.createDataFrame([(3000, "you zurgle zorgla zurgly", "en", "s"), (3001, "ba do zurna", "en", "s")], docs.schema)
    found = {r.doc_id: r.predicted for r in T.toxicity(docs.unionAll(more), labels).where("doc_id >= 3000").collect()}
    only = spark.createDataFrame([(3002, "you zurgle", "en", "s")], docs.schema)
    assert found == {3000: 1, 3001: 0} and [r.predicted for r in T.toxicity(docs.unionAll(only), labels).where("doc_id = 3002").collect()] == [1]


def test_rarer_siblings_of_a_term_are_terms():
    def counted(words):
        nodes = {}
        for w, n in words.items():
            for x in T._nodes(w):
                nodes[x] = nodes.get(x, 0) + n
        return nodes

    strong, weak = T.chosen_terms(counted({"idiot": 1000, "idiots": 40, "idiocy": 60, "scumbag": 500, "fool": 90, "foolish": 9}), counted({"idle": 300, "fool": 40}), 3000, 27000)
    lexicon = T.Lexicon(strong, weak)
    assert [lexicon.match(w) for w in ("idiot", "idiocy", "idiots", "scumbag", "idle")] == [1, 1, 1, 1, 0] and lexicon.match("fool") == 3
    assert len({*strong, *weak}) == len(strong) + len(weak)
