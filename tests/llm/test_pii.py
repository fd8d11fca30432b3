import hashlib
import random
import re

import numpy as np

from weftgraph.llm import pii as P

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
PARTS = ["a@b.c", "x.y@h-1.com.de", "..", "@", "1.2.3.4", "999.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1111", "+1 (017) 555-7713", "+44 20 7946 0958", "é", "😀", " ", "-", "5", "12", " 3 ", "\u0001", "b.", "%", "_", "+", "9807915762804490", "a(at)b(dot)com", "(030) 1234-567", "card ", "tel: "]


def valid(kind, value):
    digits = re.sub(r"[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        total = 0
        for i, c in enumerate(reversed(digits)):
            x = int(c) * (1 + i % 2)
            total += x - 9 * (x > 9)
        return 14 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def base(text):
    found = sorted((m.start(), i, m.end()) for i, k in enumerate(PATTERNS) for m in re.finditer(PATTERNS[k], text) if valid(k, m.group(0)))
    return [f"{P.KINDS[k]}:{s}:{e}" for s, k, e in found]


def check(spark, rows):
    found = {r.doc_id: r for r in P.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        expected = base((text or "").replace("\u0001", "\u0002"))
        r = found[i]
        assert r.base_sha256 == hashlib.sha256(",".join(expected).encode()).hexdigest(), text
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x.startswith(k) for x in expected) for k in P.KINDS]
        spans = r.spans.split(",") if r.spans else []
        assert set(expected) <= set(spans) and r.n_spans == len(spans)
        key = lambda x: (int(x.split(":")[1]), P.KINDS.index(x.split(":")[0]))
        assert spans == sorted(spans, key=key)
    return found


def test_base_spans_equal_brute_force(spark):
    rnd = random.Random(1)
    check(spark, [(i, "".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 14)))) for i in range(800)])


def extremes(n):
    return [None, "", "1" * n, "1 " * n, "a@" + "b." * n + "c", "x" * n + "@y", "+1" + "0 " * n, "12 12\n" * (n // 8)]


def test_extremes(spark):
    check(spark, list(enumerate(extremes(1500))))
    # the patterns of the brute force take quadratic time on longer ones
    rows = list(enumerate(extremes(60000)))
    found = {r.doc_id: r for r in P.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: r.n_email for i, r in found.items()} == {i: int(i == 4) for i in range(8)}
    assert all(r.n_ip == r.n_card == r.n_phone == 0 for r in found.values())


def test_native_plan(spark):
    plan = P.proposals(spark.createDataFrame([(1, "a@b.c")], "id long, text string"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_further_spans_follow_the_confirmed_ones(spark):
    cards = ["4111111111111111", "5500005555555559", "4012888888881881", "4222222222222220"]
    rows = [(i, f"pay by card {cards[i % 4]} today") for i in range(40)] + [(100, "pay by card 4111111111111112 today"), (101, "order number 123 of 4567")]
    found = check(spark, rows)
    assert found[100].n_card == 0 and found[100].spans == "card:12:28" and found[101].spans == ""


def test_trees_learn_and_limits_are_calibrated():
    cells = np.array([[2, 16, 0, 4, 0, 1, 1, h, 4] for h in (0, 1)])
    n, y = np.array([100.0, 100.0]), np.array([10.0, 99.0])
    trees = P.Trees(cells, n, y)
    assert trees.score[1] > 2 > 0 > trees.score[0] and np.allclose(trees.scores(cells), trees.score)
    limits = P.thresholds(cells, n, y, trees.score)
    assert trees.score[0] < limits[2] <= trees.score[1] and limits[0] == float("inf")


def test_calibration_equals_brute_force():
    rnd = np.random.default_rng(3)
    for _ in range(200):
        score, n = rnd.integers(0, 8, 12).astype(float), rnd.integers(1, 9, 12).astype(float)
        y = np.floor(n * rnd.random(12))
        low, high, p = P.calibrated(score, n, y)
        assert (np.diff(p) > 0).all() and (high[:-1] < low[1:]).all()
        for s in np.unique(score):  # the min-max formula of isotonic regression
            share = lambda a, b: y[(score >= a) & (score <= b)].sum() / n[(score >= a) & (score <= b)].sum()
            values = np.unique(score)
            best = max(min(share(a, b) for b in values if b >= s) for a in values if a <= s)
            assert abs(p[(low <= s) & (s <= high)][0] - best) < 1e-9


def common_rows(n=300):
    phones = [f"+1 ({200 + i}) 555-{1000 + 7 * i}" for i in range(n)]
    return [(i, f"one of them {p} or so, from {i % 250}.{i % 99}.7.{i % 200} or me.{i}@host{i}.example.com, paid {2000 + i % 20}-0{1 + i % 9}-11 there, user@host{i} too") for i, p in enumerate(phones)]


def test_wide_spans_are_caught_alike_in_any_number(spark):
    planted = "write john.doe (at) example (dot) com or call (555) 123-4567 for it"
    for n in (1, 20, 100):
        found = check(spark, common_rows() + [(1000 + i, planted) for i in range(n)])
        for i in range(n):
            s, e = planted.index("john"), planted.index(" or call")
            p = planted.index("(555)")
            assert found[1000 + i].spans == f"email:{s}:{e},phone:{p}:{p + 14}", n


def test_no_kind_is_added_over_another_ones_span_or_a_date(spark):
    found = check(spark, [*common_rows(), (1000, "at 55.148.143.52 since 2021-04-11 or 11.04.2021, user@hosts")])
    assert found[1000].spans == "ip:3:16"
    for i, text in common_rows():
        assert found[i].spans.count(":") == 6, text


def test_redaction_and_defined_cases(spark):
    rows = [(1, "mail é a@b.c now", 7), (2, None, 7), (3, "", 7), (4, "none", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, base int")
    out = P.redacted(df)
    assert out.columns == df.columns and {r.doc_id: r.text for r in out.collect()} == {1: "mail é [email] now", 2: None, 3: "", 4: "none"}
    assert P.personal_data(df.union(df)).count() == 8 and P.personal_data(df.where("doc_id < 0")).count() == 0


def test_cards_of_single_digits(spark):
    digits = "4111111111111111"
    found = check(spark, [(i, f"pay {sep.join(digits)} now") for i, sep in enumerate(" -")] + [(2, "a 1 b 2"), (3, "4-1 1-1 1 1 1 1 1 1 1 1 1 1 1-1")])
    assert [found[i].n_card for i in range(4)] == [1, 1, 0, 1]
