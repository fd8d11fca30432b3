r"""Personal data in texts: base patterns, and further spans that boosted trees select. DataFrame and SQL functions only.

Base spans are the leftmost non-overlapping matches of each kind, dropped without another try if they fail its check: e-mail addresses; IPv4 addresses (parts
up to 255); card numbers (14 to 19 digits that pass Luhn); phone numbers with a leading plus (10 to 15 digits). They always stay. Besides, wider
patterns propose spans, which may overlap others: addresses written with (at) and (dot), numbers grouped as phones are but without the plus, card-like numbers of
any checksum, dotted quads of any size, a name and host without a domain.

Trees boosted on the logistic loss see each proposal's format (digits, separators, how it begins and ends) and context (the
characters around it, and words such as tel or card before it). No labels are given, so they learn from proposals whose nature is known. Matches of the base patterns are
what their checks say. Phones without a plus are learned from views: what the wide pattern sees inside confirmed phones is a phone,
what it sees inside confirmed addresses and cards isn't, and neither are calendar dates and names at hosts without a domain. Other wide proposals are never learned from, so they are judged alike whether there is one
of them or many. A fifth of the documents (by a hash of the id) is kept from the trees: there, scores are calibrated for each kind by isotonic regression, and the kind's threshold is
where the calibrated probability reaches MIN_PRECISION. Selected proposals that overlap a base span are left out. Everything is counted
by combination of features, which are small whole numbers, so one aggregation over all proposals holds all that the trees need, and its size
is bounded by the number of combinations.

Patterns are written without repeated groups, which overflow the stack on long inputs in the JVM, after marking the separators that may stand inside a
match by a control character; and they begin only where a run of their characters does, so long words cost no quadratic time. A match's context reaches back
to the match of its kind before it, at most. Each proposal that is selected is compared with the base spans of its text.

Defined cases: null and empty texts have no spans (base_sha256 is that of the empty string). Rows that repeat an id are searched each. Positions count code points. Very
long texts are searched whole. Extra columns are ignored, or kept by redacted().
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import stored, unused, with_own_names

KINDS = ("email", "ip", "card", "phone")
MIN_PRECISION, TREES, RATE = 0.9, 24, 0.3
FEATURES = ("kind", "digits", "seps", "begins", "tail", "before", "after", "hint", "size")
#: What a proposal is: a confirmed match of a base pattern, one that failed its check, a wide match of unknown nature, or one that is only learned from.
CONFIRMED, FAILED, WIDE, VIEW = range(4)

_LOCAL = r"A-Za-z0-9._%+\u0001-"
_PATTERN = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++\u0001[A-Za-z0-9\u0001-]++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9][0-9\u0001]++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Dots inside host names, and separators between digits, which become U+0001 (an own U+0001 becomes U+0002 before).
_INNER = {"email": r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", "card": r"(?<=[0-9])[ -](?=[0-9])"}
_WIDE = {
    "email": r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ {0,2}[(\[{] {0,1}at {0,1}[)\]}] {0,2}[A-Za-z0-9-]{1,63}(?:(?: {0,2}[(\[{] {0,1}dot {0,1}[)\]}] {0,2}|\.)[A-Za-z0-9-]{1,63}){1,6}",
    "phone": r"(?<![0-9+.-])\(?[0-9]{2,4}\)?[ ./-]{1,2}[0-9]{2,4}[ ./-][0-9]{2,4}(?:[ ./-][0-9]{2,4})?(?![0-9.-])",
}
#: A name at a host without a domain.
_BARE = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]++(?!\.[A-Za-z0-9-])"
_DATE = r"^(?:(?:19|20)[0-9]{2}[./-](?:0?[1-9]|1[0-2])[./-](?:0?[1-9]|[12][0-9]|3[01])|(?:0?[1-9]|[12][0-9]|3[01])[./-](?:0?[1-9]|1[0-2])[./-](?:19|20)[0-9]{2})(?:[^0-9].*)?$"
_HINT = {
    "email": r"(?i)(?:mail|contact|correo|courriel|kontakt)[^A-Za-z0-9]*\S*[^A-Za-z0-9]*$",
    "ip": r"(?i)(?:\bip|host|server|addr|login)[^A-Za-z0-9]*\S*[^A-Za-z0-9]*$",
    "card": r"(?i)(?:card|visa|master|credit|karte|carte|tarjeta|konto|account)[^A-Za-z0-9]*\S*[^A-Za-z0-9]*$",
    "phone": r"(?i)(?:phone|tel|call|fax|fon|mobile|handy|tél)[^A-Za-z0-9]*\S*[^A-Za-z0-9]*$",
}


def _digit_count(x: str, least: int, most: int) -> str:
    return f"length(regexp_replace({x}, '[^0-9]', '')) between {least} and {most}"


def _quoted(pattern: str) -> str:
    return "r'" + pattern.replace("'", "\\'") + "'"


def _matches(text: str, pattern: str, gaps: str) -> str:
    """SQL for an array of a pattern's matches (m), each with what is between it and the one before (gap) and the one after (then); the last has no m. gaps: the
    column of what split() gives."""
    p = _quoted(pattern)
    pairs = f"zip_with(regexp_extract_all({text}, {p}, 0), {gaps}, (m, gap) -> named_struct('m', m, 'gap', gap))"
    return f"zip_with({pairs}, slice({gaps}, 2, size({gaps})), (x, then) -> named_struct('m', x.m, 'gap', x.gap, 'then', then))"


def _spans(matches: str, where: str) -> str:
    """SQL for an array of (start, end, value, before, after) of those matches for which a condition on x.m holds; before are up to 32 characters, after is one.
    Works in blocks, as appending to one long array would take quadratic time."""
    none = "cast(array() as array<struct<start:int,end:int,value:string,before:string,after:string>>)"
    width = f"cast(ceil(sqrt(size({matches}))) as int)"
    step = (
        f"(s, x) -> if(x.m is null, s, named_struct('at', s.at + length(x.gap) + length(x.m), 'out', if({where}, "
        "concat(s.out, array(named_struct('start', s.at + length(x.gap), 'end', s.at + length(x.gap) + length(x.m), 'value', x.m, 'before', right(x.gap, 32), 'after', left(coalesce(x.then, ''), 1)))), s.out)))"
    )
    block = f"aggregate(slice({matches}, k * {width} + 1, {width}), named_struct('at', r.at, 'out', {none}), {step})"
    return (
        f"if(size({matches}) < 2, {none}, aggregate(sequence(0, cast(ceil(size({matches}) / {width}) as int) - 1), named_struct('at', 0, 'out', {none}), "
        f"(r, k) -> aggregate(array({block}), r, (q, b) -> named_struct('at', b.at, 'out', concat(q.out, b.out))), r -> r.out))"
    )


def _luhn(digits: str) -> str:
    return f"aggregate(sequence(1, length({digits})), 0, (s, i) -> s + if(i % 2 = 1, cast(substr({digits}, -i, 1) as int), if(cast(substr({digits}, -i, 1) as int) > 4, 2 * cast(substr({digits}, -i, 1) as int) - 9, 2 * cast(substr({digits}, -i, 1) as int)))) % 10 = 0"


def _valid(kind: str) -> str:
    digits = "regexp_replace(x.value, '[^0-9]', '')"
    return {
        "email": "true",
        "ip": "x.value rlike r'^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})\\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})\\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})\\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})$'",
        "card": f"if(length({digits}) between 14 and 19, {_luhn(digits)}, false)",
        "phone": f"length({digits}) between 10 and 15",
    }[kind]


def _kind_of_char(c: str) -> str:
    return f"case when {c} = '' then 0 when {c} rlike r'^\\s' then 1 when {c} rlike '^[0-9]' then 2 when {c} rlike r'^\\p{{L}}' then 3 when {c} in ('.', ',', ';', ':', '!', '?', '(', ')', '\"') then 4 else 5 end"


def _described(kind: str) -> str:
    """SQL: a proposal x (a span with role and y) with its features."""
    digits = "regexp_replace(x.value, '[^0-9]', '')"
    seps = "regexp_replace(x.value, '[A-Za-z0-9]', '')"
    return (
        f"named_struct('start', x.start, 'end', x.end, 'role', x.role, 'y', x.y, 'kind', {KINDS.index(kind)}, 'digits', least(length({digits}), 20), "
        + ("'seps', 0, " if kind == "email" else f"'seps', case when {seps} = '' then 0 when {seps} rlike '^ +$' then 1 when {seps} rlike '^[\\u0001]+$' then 2 when {seps} rlike '^[.]+$' then 3 when {seps} rlike '^[-]+$' then 4 else 5 end, ")
        + "'begins', case when x.value rlike '^[+]' then 1 when x.value rlike '^[(]' then 2 when x.value rlike '^0' then 3 when x.value rlike '^[3456]' then 4 when x.value rlike '^[0-9]' then 5 else 0 end, "
        + ("'tail', least(length(regexp_extract(x.value, r'(?i)(?:[.\u0001]|[(\\[{] ?dot ?[)\\]}] {0,2})([a-z]+)$', 1)), 9), " if kind == "email" else "'tail', 0, ")
        + f"'before', {_kind_of_char('right(x.before, 1)')}, 'after', {_kind_of_char('x.after')}, "
        + f"'hint', if(x.before rlike {_quoted(_HINT[kind])}, 1, 0), 'size', "
        + ("least(cast(length(regexp_extract(x.value, r'^[^@(\\[{ ]+', 0)) / 4 as int), 12))" if kind == "email" else "least(cast(length(x.value) / 4 as int), 12))")
    )


def proposals(docs: DataFrame) -> DataFrame:
    """docs: id, text. Returns id and found, an array of proposals: start, end, role, y (whether it is of its kind; null if unknown) and the features."""
    df = docs.select("id", F.translate(F.coalesce("text", F.lit("")), "\u0001", "\u0002").alias("t"))
    guard = {"email": "t like '%@%'", "ip": "t rlike r'[0-9]\\.[0-9]'", "card": "t rlike '[0-9][ -]?[0-9]'", "phone": "t like '%+%'"}
    wide_guard = {"email": "lower(t) rlike r'[(\\[{] ?at ?[)\\]}]'", "phone": "t rlike r'[0-9][)]?[ ./-]{1,2}[0-9]'", "bare": guard["email"]}
    wide = _WIDE | {"bare": _BARE}
    few = {"email": "true", "ip": "true", "card": _digit_count("x.m", 13, 19), "phone": _digit_count("x.m", 7, 24), "bare": "true"}
    nothing = "cast(array() as array<struct<m:string,gap:string,then:string>>)"
    df = df.withColumns({k: F.expr(f"if({guard[k]}, regexp_replace(t, {_quoted(_INNER[k])}, '\\u0001'), '')") if k in _INNER else F.expr("t") for k in KINDS})
    df = df.withColumns({f"g_{k}": F.expr(f"if({guard[k]}, split({k}, {_quoted(_PATTERN[k])}, -1), array())") for k in KINDS} | {f"h_{k}": F.expr(f"if({wide_guard[k]}, split(t, {_quoted(p)}, -1), array())") for k, p in wide.items()})
    df = df.withColumns({f"m_{k}": F.expr(f"if(size(g_{k}) > 1, {_matches(k, _PATTERN[k], f'g_{k}')}, {nothing})") for k in KINDS} | {f"n_{k}": F.expr(f"if(size(h_{k}) > 1, {_matches('t', p, f'h_{k}')}, {nothing})") for k, p in wide.items()})
    df = df.withColumns({f"s_{k}": F.expr(_spans(f"m_{k}", few[k])) for k in KINDS} | {f"w_{k}": F.expr(_spans(f"n_{k}", few[k])) for k in wide})
    span = "'start', x.start, 'end', x.end, 'value', x.value, 'before', x.before, 'after', x.after"
    df = df.withColumns({f"s_{k}": F.expr(f"transform(s_{k}, x -> named_struct({span}, 'valid', {_valid(k)}))") for k in KINDS})
    parts = []
    for k in KINDS:
        both = [f"transform(s_{k}, x -> named_struct({span}, 'role', if(x.valid, {CONFIRMED}, {FAILED}), 'y', if(x.valid, 1, 0)))"]
        if k in _WIDE:
            again = f"filter(w_{k}, x -> not exists(s_{k}, y -> x.start < y.end and y.start < x.end))"
            role = f"if(x.value rlike {_quoted(_DATE)}, {VIEW}, {WIDE})" if k == "phone" else f"{WIDE}"
            both.append(f"transform({again}, x -> named_struct({span}, 'role', {role}, 'y', if({role} = {VIEW}, 0, cast(null as int))))")
        if k == "email":
            both.append(f"transform(w_bare, x -> named_struct({span}, 'role', {VIEW}, 'y', 0))")
        if k == "phone":
            both += [_views(other, int(other == "phone")) for other in ("ip", "card", "phone")]
        parts.append(f"transform(concat({', '.join(both)}), x -> {_described(k)})")
    return df.select("id", F.expr(f"concat({', '.join(parts)})").alias("found"))


def _views(kind: str, y: int) -> str:
    """SQL for what the wide pattern of phones sees inside the confirmed spans of a kind."""
    inner = f"regexp_extract(translate(x.value, '\\u0001', ' '), {_quoted(_WIDE['phone'])}, 0)"
    seen = f"transform(filter(s_{kind}, x -> x.valid), x -> named_struct('whole', x, 'inner', {inner}))"
    at = "locate(v.inner, translate(v.whole.value, '\\u0001', ' '))"
    end = f"({at} + length(v.inner) - 1)"
    return (
        f"transform(filter({seen}, v -> v.inner <> ''), v -> named_struct('start', v.whole.start + {at} - 1, 'end', v.whole.start + {end}, 'value', v.inner, "
        f"'before', right(concat(v.whole.before, left(v.whole.value, {at} - 1)), 32), "
        f"'after', if({end} = length(v.whole.value), v.whole.after, substr(v.whole.value, {end} + 1, 1)), 'role', {VIEW}, 'y', {y}))"
    )


class Trees:
    """Boosted trees of depth two over whole-number features, fitted on counts of combinations."""

    def __init__(self, cells: np.ndarray, n: np.ndarray, y: np.ndarray):
        """cells: a row of features for each combination; n: its proposals; y: those confirmed."""
        self.trees: list[tuple] = []
        self.prior = float(np.log((y.sum() + 1) / (n.sum() - y.sum() + 1)))
        z = np.full(len(cells), self.prior)
        for _ in range(TREES if len(cells) else 0):
            p = 1 / (1 + np.exp(-z))
            g, h = y - n * p, n * p * (1 - p)
            tree, out = self._grown(cells, g, h, np.arange(len(cells)), 2)
            z = z + out
            self.trees.append(tree)
        self.score = z

    def _grown(self, cells: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int) -> tuple[tuple, np.ndarray]:
        gain_of = lambda a: g[a].sum() ** 2 / (h[a].sum() + 1)
        best = (1e-6, None)
        for f in range(cells.shape[1]) if depth else ():
            for v in np.unique(cells[rows, f])[:-1].tolist():
                left = cells[rows, f] <= v
                gain = gain_of(rows[left]) + gain_of(rows[~left]) - gain_of(rows)
                best = max(best, (gain, (f, v)), key=lambda x: x[0])
        out = np.zeros(len(cells))
        if best[1] is None:
            value = RATE * float(g[rows].sum() / (h[rows].sum() + 1))
            out[rows] = value
            return (value,), out
        f, v = best[1]
        left = cells[rows, f] <= v
        a, x = self._grown(cells, g, h, rows[left], depth - 1)
        b, y = self._grown(cells, g, h, rows[~left], depth - 1)
        return (f, v, a, b), x + y

    def scores(self, cells: np.ndarray) -> np.ndarray:
        """The scores (log-odds) of rows of features."""

        def of(tree: tuple, rows: np.ndarray) -> np.ndarray:
            if len(tree) == 1:
                return np.full(len(rows), tree[0])
            left = rows[:, tree[0]] <= tree[1]
            return np.where(left, of(tree[2], rows), of(tree[3], rows))

        return sum((of(t, cells) for t in self.trees), np.full(len(cells), self.prior))

    def sql(self, row: str) -> str:
        """The score (log-odds) as SQL over a struct of the features."""

        def of(t: tuple) -> str:
            return f"{t[0]!r}D" if len(t) == 1 else f"if({row}.{FEATURES[t[0]]} <= {t[1]}, {of(t[2])}, {of(t[3])})"

        return " + ".join([f"{self.prior!r}D", *map(of, self.trees)])


def calibrated(score: np.ndarray, n: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Isotonic regression of y / n on the score: least score, greatest score and probability of each pool, in rising order."""
    values, at = np.unique(score, return_inverse=True)
    pools: list[list[float]] = []  # least and greatest score, n, y
    for v, total, good in zip(values, np.bincount(at, n), np.bincount(at, y), strict=True):
        pools.append([v, v, total, good])
        while len(pools) > 1 and pools[-2][3] * pools[-1][2] >= pools[-1][3] * pools[-2][2]:
            _, high, total, good = pools.pop()
            pools[-1] = [pools[-1][0], high, pools[-1][2] + total, pools[-1][3] + good]
    table = np.array(pools).reshape(-1, 4)
    return table[:, 0], table[:, 1], table[:, 3] / np.maximum(table[:, 2], 1)


def thresholds(cells: np.ndarray, n: np.ndarray, y: np.ndarray, score: np.ndarray) -> list[float]:
    """For each kind the score from which the calibrated probability is MIN_PRECISION at least: half-way between the scores that are less likely and those that aren't. If none is less
    likely, the score that stands for MIN_PRECISION itself counts too. Infinite if none is likely enough."""
    out = []
    for kind in range(len(KINDS)):
        own = (cells[:, 0] == kind) & (n > 0)
        low, high, p = calibrated(score[own], n[own], y[own])
        good = p >= MIN_PRECISION
        if not good.any():
            out.append(float("inf"))
        elif good.all():
            out.append(min(float(low[0]), float(np.log(MIN_PRECISION / (1 - MIN_PRECISION)))) - 1e-9)
        else:
            out.append((float(high[~good].max()) + float(low[good].min())) / 2)
    return out


def _joined(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))))
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", name(x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def detected(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, base and selected (arrays of spans: start, end, kind as an index of KINDS)."""
    found = stored(proposals(with_own_names(docs, id=id_col, text=text_col)), "proposals")
    known = found.select((F.crc32(F.coalesce(F.col("id").cast("string"), F.lit(""))) % 5 == 0).alias("apart"), F.explode("found").alias("x")).where("x.y is not null")
    counts = known.groupBy("apart", *[F.col(f"x.{f}").alias(f) for f in FEATURES]).agg(F.count("*").alias("n"), F.sum("x.y").alias("y")).collect()
    table = np.array(sorted(tuple(r) for r in counts), float).reshape(-1, len(FEATURES) + 3)
    apart, cells, n, y = table[:, 0] == 1, table[:, 1:-2].astype(int), table[:, -2], table[:, -1]
    trees = Trees(cells[~apart], n[~apart], y[~apart])
    limits = ", ".join(f"{v!r}D" if np.isfinite(v) else "double('infinity')" for v in thresholds(cells[apart], n[apart], y[apart], trees.scores(cells[apart])))
    confirmed = f"filter(found, x -> x.role = {CONFIRMED})"
    likely = f"filter(found, x -> x.role in ({FAILED}, {WIDE}) and ({trees.sql('x')}) >= element_at(array({limits}), x.kind + 1))"
    short = "x -> named_struct('start', x.start, 'end', x.end, 'kind', x.kind)"
    out = found.select("id", F.expr(f"transform({confirmed}, {short})").alias("base"), F.expr(f"transform({likely}, {short})").alias("likely"))
    return out.select(F.col("id").alias(id_col), "base", F.expr("concat(base, filter(likely, x -> not exists(base, y -> x.start < y.end and y.start < x.end)))").alias("selected"))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, n_email, n_ip, n_card, n_phone (base ones), base_sha256, spans (base and selected ones), n_spans (their number)."""
    d = detected(docs, id_col, text_col)
    counts = [F.expr(f"cast(size(filter(base, x -> x.kind = {i})) as long)").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return d.select(f"`{id_col}`", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("selected")).alias("spans"), F.size("selected").cast("long").alias("n_spans"))


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with every selected span of its texts replaced by its kind in brackets. Ids must be unique and not null; other rows keep their texts."""
    own_id, own_spans = unused(docs, "own_id"), unused(docs, "own_spans")
    spans = detected(docs, id_col, text_col).select(F.col(f"`{id_col}`").alias(own_id), F.array_sort("selected").alias(own_spans)).where(F.size(own_spans) > 0).dropDuplicates([own_id])
    t = f"`{text_col}`"
    names = "array(" + ", ".join(f"'[{k}]'" for k in KINDS) + ")"
    cut = F.expr(
        f"aggregate({own_spans}, named_struct('at', 0, 'out', ''), (s, x) -> if(x.start < s.at, s, named_struct('at', x.end, 'out', concat(s.out, substr({t}, s.at + 1, x.start - s.at), element_at({names}, x.kind + 1)))), s -> concat(s.out, substr({t}, s.at + 1)))"
    )
    joined = docs.join(spans, F.col(f"`{id_col}`") == F.col(own_id), "left")
    return joined.withColumn(text_col, F.when(F.col(own_id).isNull(), F.col(t)).otherwise(cut)).select(*[F.col(f"`{c}`") for c in docs.columns])
