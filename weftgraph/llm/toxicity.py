"""Toxicity by a learned lexicon, matched with misspellings, and by the context of each match.

Terms are learned from labelled documents: nodes of the trie of their words that come up in toxic documents alone (in clean ones only in quotations), far more often than
chance allows. Where one word carries a node's evidence the term is that word, else it is a stem, which any ending may follow. Nodes that come
up in clean documents too, but in toxic ones several times as often, are weak terms, which count apart.
At scoring time words run through the product of the lexicon's trie and Levenshtein automata (one edit for words of five letters,
two from nine; stems and weak terms alike, and what follows a stem is free if the stem's last letter is in place), built state by state as words need it, so
most words are rejected after two or three letters. Misspellings that clean labelled documents hold don't count. Every match is then
looked at with the six words on either side. A pair of quotation marks that opens before and closes after it, or a word such as "term" right before it, makes it a
quotation, which counts apart; verbs of saying before it are counted besides. A logistic model over the document's matches, exact, misspelt, weak, quoted and reported,
gives the score, so the labels say what quotations and reports are worth.

Labels are learned from at most TRAIN_ROWS labelled documents (picked by a hash of the id), of rows that aren't held out. Neither id, language nor source is an
input. Counts of words are taken on the executors; the driver gets the lexicon's candidates and five numbers for each labelled document.

Defined cases: null and empty texts score as documents without a match. Rows that repeat an id are scored each; if labels repeat an id, toxic wins. With no
label at all nothing is toxic. Of copies in the labelled documents the least id counts. Words of any length are terms; stems have up to STEM letters. Null labels are ignored. Very long texts are scored whole. Extra columns are ignored, or kept by filtered().
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import arrow_batches, lean, stored, with_own_names
from .near_dedup import min_hashes, shingle_sets

#: The bound of the sample that labels are learned from.
TRAIN_ROWS = 20_000
LEAST_DOCS, LEAST_PURITY, WEAK_PURITY, LEAST_STEM, CONTEXT = 4, 0.95, 0.4, 4, 6
#: A misspelt match's part of an exact one; a term of which more of the clean documents seem to hold misspellings is matched as it is.
MISSPELT, MISSPELT_CLEAN = 0.7, 0.002
FEATURES = 9
MEMO = 100_000
#: Letters of the longest stem.
STEM = 40
END = "\0"
_EDGE = " \t\n\r.,;:!?¡¿()[]{}<>|*#$%&@~^_=+/\\`´\"'“”„‟«»‹›‘’‚…·•-–—0123456789"
#: What closes each quotation mark.
_CLOSES = {'"': '"', "“": "”\"", "„": "“”\"", "‟": "”\"", "«": "»", "»": "«", "‹": "›", "›": "‹", "‘": "’", "‚": "‘’", "`": "`´'"}
_CLOSING = frozenset("".join(_CLOSES.values())) - {"'"}
_STOPS = ".,;:!?…)]}"
_MENTION = frozenset("word words term terms phrase phrases insult insults slur slurs epithet mot mots terme termes insulte wort worte begriff schimpfwort palabra palabras término insulto".split())
_SAYING = frozenset("said says say saying wrote writes called calls shouted quoted quotes reported reports alleged allegedly accused insulted dit écrit traité appelé sagte schrieb nannte dijo llamó escribió".split())


def edits_for(term: str) -> int:
    """Edits that a misspelling of the term may have."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Lexicon:
    """Terms in a trie (words end in END; others are stems), and its product with Levenshtein automata."""

    def __init__(self, terms: list[str], weak: list[str] = (), as_is: frozenset[str] = frozenset(), clean_words: frozenset[str] = frozenset(), loose: bool = False):
        """as_is: terms that take no edits; clean_words: words that are no misspellings; loose: stems and weak terms take edits too."""
        self.clean_words = clean_words
        self.children: list[dict[str, int]] = [{}]
        self.word: list[int] = [-1]  # most edits of the word that ends here
        self.stem: list[int] = [0]  # 1: a stem ends here, 3: a weak one
        self.weak_word: list[int] = [-1]
        self.stem_edits: list[int] = [0]
        for term, is_weak in [*((t, False) for t in terms), *((t, True) for t in weak)]:
            node = 0
            for c in term.removesuffix(END):
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.word.append(-1)
                    self.stem.append(0)
                    self.weak_word.append(-1)
                    self.stem_edits.append(0)
                node = self.children[node][c]
            edits = 0 if term in as_is else edits_for(term.removesuffix(END))
            if term.endswith(END) and is_weak:
                self.weak_word[node] = edits if loose else 0
            elif term.endswith(END):
                self.word[node] = edits
            elif not (is_weak and self.stem[node]):
                self.stem[node] = 3 if is_weak else 1
                self.stem_edits[node] = edits if loose else 0
        #: Most edits below each node, so that branches of short words take none.
        self.most = [max(0, *x) for x in zip(self.word, self.weak_word, self.stem_edits, strict=True)]
        for n in range(len(self.children) - 1, -1, -1):
            self.most[n] = max([self.most[n], *(self.most[c] for c in self.children[n].values())])
        self.known: dict[tuple[frozenset, int], int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.stems: list[int] = []
        self.accepts: list[set[int]] = []
        self.start = self._state({(0, 0)})
        self.memo: dict[str, int] = {}

    def _state(self, nodes: set[tuple[int, int]], stem: int = 0) -> int:
        """The number of a set of (trie node, edits), with a misspelt stem (as match() says it) that just ended; -1 is the dead one. Letters left out are followed here."""
        least: dict[int, int] = {}
        stack = sorted(nodes, key=lambda x: -x[1])
        while stack:
            n, e = stack.pop()
            if e > self.most[n] or least.get(n, 9) <= e:
                continue
            least[n] = e
            stack += [(c, e + 1) for c in self.children[n].values()]
        if not least:
            return -1
        key = frozenset(least.items())
        if (key, stem) not in self.known:
            self.known[key, stem] = len(self.sets)
            self.sets.append(key)
            self.moves.append({})
            self.stems.append(min((k for k in (stem, *(self.stem[n] for n, e in key if e == 0)) if k), default=0))
            found = {1 for n, e in key if e == 0 and self.word[n] >= 0} | {3 for n, e in key if e == 0 and self.weak_word[n] >= 0}
            found |= {2 for n, e in key if 0 < e <= self.word[n]} | {4 for n, e in key if 0 < e <= self.weak_word[n]}
            found |= {self.stem[n] + 1 for n, e in key if 0 < e <= self.stem_edits[n]}
            self.accepts.append(found)
        return self.known[key, stem]

    def _move(self, state: int, c: str) -> int:
        after, stem = set(), 0
        for n, e in self.sets[state]:
            if c in self.children[n]:
                to = self.children[n][c]
                after.add((to, e))
                if 0 < e <= self.stem_edits[to]:
                    stem = min(stem or 9, self.stem[to] + 1)
            after.add((n, e + 1))
            after |= {(k, e + 1) for k in self.children[n].values()}
        self.moves[state][c] = found = self._state(after, stem)
        return found

    def match(self, word: str) -> int:
        """0: no term; 1: a term as it is, or a word of a stem; 2: a misspelt term or stem; 3: a weak term, or a word of a weak stem; 4: a misspelt one of these."""
        state, found = self.start, set()
        for c in word:
            to = self.moves[state].get(c)
            state = self._move(state, c) if to is None else to
            if state < 0:
                break
            if self.stems[state]:
                if self.stems[state] == 1:
                    return 1
                found.add(self.stems[state])
        else:
            found |= self.accepts[state] if state >= 0 else set()
        if found and word in self.clean_words:
            found -= {2, 4}
        return min(found, default=0)

    def of_token(self, token: str) -> int:
        """match() for a token with its punctuation, kept in a bounded memo."""
        known = self.match(token.strip(_EDGE))
        if len(self.memo) >= MEMO:
            self.memo.clear()
        self.memo[token] = known
        return known

    def counts(self, text: str) -> tuple[int, int, int, int, int, int]:
        """Exact, misspelt and weak matches; those in quotations, which aren't among them; those after a verb of saying, which are; and words."""
        tokens = text.lower().split()
        found = list(map(self.memo.get, tokens))
        if None in found:
            found = [self.of_token(t) if k is None else k for t, k in zip(tokens, found, strict=True)]
        counts = [0, 0, 0, 0, 0]
        if any(found):
            for i, k in enumerate(found):
                if k:
                    quoted = _is_quoted(tokens, i)
                    counts[3 if quoted else min(k, 3) - 1] += 1
                    counts[4] += not quoted and any(t.strip(_EDGE) in _SAYING for t in tokens[max(0, i - CONTEXT) : i])
        return (*counts, len(tokens))


def features(counts: np.ndarray) -> np.ndarray:
    """The model's inputs from rows of counts()."""
    exact = counts[:, 0] + MISSPELT * counts[:, 1]
    weak, quoted, reported, words = counts[:, 2], counts[:, 3], counts[:, 4], np.maximum(1, counts[:, 5])
    matches = np.maximum(1, counts[:, :4].sum(axis=1))
    columns = [np.log1p(exact), np.minimum(1, 10 * exact / words), exact >= 0.5, np.log1p(weak), weak >= 2, np.minimum(1, 10 * weak / words)]
    return np.column_stack([*columns, np.log1p(quoted), quoted / matches, reported / matches]).astype(float)


def _is_quoted(tokens: list[str], i: int) -> bool:
    """Whether a pair of quotation marks encloses the token within the window, or the word before mentions it as a word."""
    if i and tokens[i - 1].strip(_EDGE) in _MENTION:
        return True
    mark = None
    for k in range(i, max(-1, i - CONTEXT - 1), -1):
        t = tokens[k]
        if k < i and t.rstrip(_STOPS)[-1:] in _CLOSING and (len(t.rstrip(_STOPS)) > 1 or t not in _CLOSES):
            return False  # a quotation ends before
        if t.lstrip("([{")[:1] in _CLOSES:
            mark = t.lstrip("([{")[0]
            break
    if mark is None:
        return False
    for k in range(i, min(len(tokens), i + CONTEXT + 1)):
        t = tokens[k].rstrip(_STOPS)
        if k > i and t[:1] in _CLOSES and t[0] not in _CLOSES[mark]:
            return False  # another begins
        if k > i and len(t) > 1 and t[0] == mark and t[:1] in _CLOSES:
            return False
        if t[-1:] and t[-1] in _CLOSES[mark] and (k > i or len(t) > 1):
            return True
    return False


def _nodes(text: str, quoted: bool = True) -> set[str]:
    """Nodes of a text's words. quoted: whether those in quotations are among them."""
    tokens = text.lower().split()
    if not quoted and (not _CLOSES.keys().isdisjoint(text) or not _MENTION.isdisjoint(tokens)):
        tokens = [t for i, t in enumerate(tokens) if not _is_quoted(tokens, i)]
    words = {t.strip(_EDGE) for t in tokens}
    out = set()
    for w in words:
        if w:
            out.add(w + END)
            out.update(w[:k] for k in range(LEAST_STEM, min(len(w), STEM) + 1))
    return out


def _counted(docs: DataFrame, only: set[str] | None) -> DataFrame:
    """Documents of each trie node, or of each of some, which quoted words don't count for; docs: id, text."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(1).to_pylist():
                found = _nodes(text or "", only is None)
                counts.update(found if only is None else found & only)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["node", "n"])

    return docs.select("id", "text").mapInArrow(lean(each), "node string, n long").groupBy("node").agg(F.sum("n").alias("n"))


def chosen_terms(toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int) -> tuple[list[str], list[str]]:
    """Terms and weak terms out of the counts of trie nodes in toxic and in clean documents."""
    share = n_toxic / max(1, n_toxic + n_clean)
    tests = max(1, len(toxic))
    below: dict[str, list[str]] = {}
    for n in toxic:
        below.setdefault(n[:-1], []).append(n)

    def purity(node: str) -> float:
        return toxic[node] / (toxic[node] + clean.get(node, 0))

    def by_chance(node: str) -> float:
        a, n = toxic[node], toxic[node] + clean.get(node, 0)
        if n > 1000:  # a normal tail is close enough
            return math.erfc((a - n * share) / math.sqrt(2 * n * share * (1 - share)))
        return sum(math.comb(n, k) * share**k * (1 - share) ** (n - k) for k in range(a, n + 1))

    def picked(least: float, but: set[str]) -> list[str]:
        found = {n for n, a in toxic.items() if a >= LEAST_DOCS and purity(n) >= max(least, 2 * share) and by_chance(n) * tests < 0.01}
        terms: list[str] = []
        covered, above = set(but), set()  # terms so far, and all nodes on the way to them
        for n in sorted(found):
            if n in above or n in covered or any(n[:k] in covered for k in range(1, min(len(n), STEM) + 1)):
                continue
            top = n
            while True:  # down to where the evidence parts
                heir = max(below.get(n, []), key=lambda x: (toxic[x], x), default=None)
                if heir is None or toxic[heir] < 0.9 * toxic[n]:
                    break
                n = heir
            # what else is below the node gets its own turn
            above.update(n[:k] for k in range(len(top), len(n)))
            if n not in covered:
                covered.add(n)
                terms.append(n)
        return terms

    strong = picked(LEAST_PURITY, set())
    return strong, picked(WEAK_PURITY, set(strong))


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a logistic model, the intercept last, by Newton's method with a small penalty."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    ridge = np.diag([0.05] * (x.shape[1] - 1) + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


class ToxicityModel:
    """A lexicon and the weights of its matches."""

    def __init__(self, lexicon: tuple, weights: list[float]):
        self.made_of, self.weights = lexicon, weights
        self.lexicon: Lexicon | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"lexicon": None}

    def scores(self, texts: list[str | None]) -> np.ndarray:
        self.lexicon = self.lexicon or Lexicon(*self.made_of)
        counts = np.array([self.lexicon.counts(t or "") for t in texts], float).reshape(-1, 6)
        w = np.array(self.weights)
        return 1 / (1 + np.exp(-np.clip(features(counts) @ w[:-1] + w[-1], -30, 30)))


def held_out(column: F.Column) -> F.Column:
    """Whether a row with that id is kept for tests."""
    return F.crc32(column.cast("string")) % 5 == 0


def fitted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_rows: int = TRAIN_ROWS) -> ToxicityModel:
    """Learns a model from up to about train_rows labelled documents that aren't held out."""
    own = with_own_names(docs, id=id_col, text=text_col)
    known = with_own_names(labels, id=id_col, y=label_col).where("id is not null and y is not null").where(~held_out(F.col("id"))).groupBy("id").agg(F.max("y").cast("int").alias("y"))
    n = known.count()
    if n > train_rows:
        known = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int((1 << 20) * train_rows / n))
    some = own.where("id is not null").join(F.broadcast(known), "id").groupBy("text", "y").agg(F.min("id").alias("id")).select("id", "text", "y")

    def each_marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, values, begin in shingle_sets(batch.column(1)):
                marks = min_hashes(values, begin)[:, :3].astype(np.int64)
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns), *map(pa.array, np.ascontiguousarray(marks.T))], names=["id", "text", "y", "m0", "m1", "m2"])

    kind = dict(own.dtypes)["id"]
    train = stored(some.mapInArrow(lean(each_marked), f"id {kind}, text string, y int, m0 long, m1 long, m2 long"), "labelled-marked")
    for m in ("m0", "m1", "m2"):  # near copies prove a term no more than one of them does
        train = train.join(train.groupBy(m, "y").agg(F.min("id").alias("id")), ["id", m, "y"], "left_semi")
    train = stored(train.select("id", "text", "y"), "labelled")
    sizes = {bool(r[0]): r[1] for r in train.groupBy("y").count().collect()}
    n_toxic, n_clean = sizes.get(True, 0), sizes.get(False, 0)
    if not n_toxic or not n_clean:
        return ToxicityModel(([],), [*[0.0] * FEATURES, math.log((n_toxic + 0.01) / (n_clean + 0.1))])
    toxic = dict(map(tuple, _counted(train.where("y = 1"), None).where(f"n >= {LEAST_DOCS}").collect()))
    clean = dict(map(tuple, _counted(train.where("y = 0"), set(toxic)).collect()))
    terms, weak = chosen_terms(toxic, clean, n_toxic, n_clean)

    def each_misspelt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(terms, weak, loose=True)
        for batch in batches:
            found = [w for t in batch.column(1).to_pylist() for w in {x.strip(_EDGE) for x in (t or "").lower().split() if lexicon.of_token(x) in (2, 4)}]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["word"])

    wrong = dict(map(tuple, train.where("y = 0").select("id", "text").mapInArrow(lean(each_misspelt), "word string").groupBy("word").count().collect()))
    as_is = set()
    for term in (*terms, *weak):
        if edits_for(term.removesuffix(END)):
            alone = Lexicon([term], loose=True)
            if sum(n for w, n in wrong.items() if alone.match(w) == 2) > MISSPELT_CLEAN * n_clean:
                as_is.add(term)
    made_of = (terms, weak, frozenset(as_is), frozenset(wrong), True)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(*made_of)
        for batch in batches:
            rows = np.array([lexicon.counts(t or "") for t in batch.column(1).to_pylist()], np.int64).reshape(-1, 6)
            yield pa.RecordBatch.from_arrays([batch.column(2), *map(pa.array, np.ascontiguousarray(rows.T))], names=["y", *(f"c{i}" for i in range(6))])

    rows = np.array(train.mapInArrow(lean(each), ", ".join(["y int", *(f"c{i} long" for i in range(6))])).collect(), dtype=float)
    rows = rows[np.lexsort(rows.T)]  # sums in the same order in every run
    return ToxicityModel(made_of, _logistic(features(rows[:, 1:]), rows[:, 0]).tolist())


def scored(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, held_out boolean, score double, predicted int (1 from 0.5)."""
    own = with_own_names(docs, id=id_col, text=text_col)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.scores(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["id", "score"])

    out = own.mapInArrow(lean(each), f"id {dict(own.dtypes)['id']}, score double")
    return out.select(F.col("id").alias(id_col), F.coalesce(held_out(F.col("id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """fitted() and scored()."""
    arrow_batches(docs.sparkSession)
    return scored(docs, fitted(docs, labels, id_col, text_col, label_col), id_col, text_col)


def filtered(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """The rows of docs, with all columns, that score below 0.5."""
    arrow_batches(docs.sparkSession)
    model = fitted(docs, labels, id_col, text_col, label_col)
    at = docs.columns.index(text_col)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.scores(batch.column(at).to_pylist()) < 0.5))

    return docs.mapInArrow(lean(each), docs.schema)
