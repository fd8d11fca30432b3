"""Token counts at every prefix of a text, for byte-level BPE tokenizers.

A text splits into pretokens, and the count of a prefix is the count of the pretoken boundary before it plus that of
the part of the pretoken inside it: count[i] = count[i - size of the last token] + 1. Within one pretoken the last token
of each prefix follows from those before it: of the vocabulary's tokens that end there, exactly one forms a stable pair with
the last token of the shorter prefix (encoding the two together gives the two again). So one pass stores the count of
every prefix by code points, table(), and all answers are read from it: the tokens of the text or of a part from its beginning, and how much of it fits a
budget. Where a prefix splits into other pretokens than the text does (runs of white space, contractions cut short, special strings cut short) the
table holds the prefix's own count. The counts inside pretokens that came before are kept in a bounded memo.

Defined cases: null and empty texts have no tokens. Rows that repeat an id are counted each. White space, control characters and
very long words are counted as the library counts them. Strings of special tokens inside a text are one token, as is
the library's default. Tokenizers that aren't byte-level BPE with the split below raise ValueError: their counts would be other ones.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ._spark import arrow_batches, lean, with_own_names

#: The split into pretokens of the byte-level family, with white space as Unicode defines it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Entries of each memo; a full one is emptied.
MEMO, HEADS = 600_000, 200_000
#: Bytes of the beginnings that pretokens are resumed from.
HEAD = 6
#: Code points of the longest unit in the memo.
SHORT = 100


def _byte_symbols() -> dict[str, int]:
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def _checked(path: str, spec: dict) -> None:
    """Raises ValueError if the pass wouldn't give the tokenizer's counts."""
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    steps = before.get("pretokenizers", [before])
    levels = [x for x in steps if x.get("type") == "ByteLevel"]
    plain = len(steps) == 1 and len(levels) == 1 and levels[0].get("use_regex", True) and not levels[0].get("add_prefix_space", True)
    if model.get("type") != "BPE" or not plain or spec.get("normalizer") is not None:
        raise ValueError(f"{path}: only tokenizers of the byte-level BPE kind, without normalising, an own split or a space put before texts, are supported")
    if model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("ignore_merges"):
        raise ValueError(f"{path}: dropout, affixes of subwords and whole words before merges aren't supported")
    if any(x.get(k) for x in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip")):
        raise ValueError(f"{path}: special tokens that take white space or whole words aren't supported")


class PrefixCounter:
    """Exact token counts of texts and of their prefixes. path: a tokenizer.json of the byte-level BPE kind."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        _checked(path, spec)
        symbols = _byte_symbols()
        as_bytes = lambda s: bytes(symbols[c] for c in s)
        special = {x["content"] for x in spec["added_tokens"]}
        self.tokens = [as_bytes(k) for k in spec["model"]["vocab"] if k not in special]
        self.number = {t: i for i, t in enumerate(self.tokens)}
        self.heads = {t[:k] for t in self.tokens for k in range(len(t) + 1)}
        self.longest = max(map(len, self.tokens))
        merges = [tuple(map(as_bytes, m if isinstance(m, list) else m.split(" "))) for m in spec["model"]["merges"]]
        #: By number: the rank of each token (single bytes first, then in the order of the merges), and the two parts of each. By left << 32 | right: the rank of a merge.
        parts = {a + b: (a, b) for a, b in reversed(merges)}
        rank = {a + b: i for i, (a, b) in reversed(list(enumerate(merges)))}
        self.rank = [rank.get(t, -1) for t in self.tokens]
        self.halves = [tuple(self.number[x] for x in parts[t]) if t in parts else () for t in self.tokens]
        self.joins = {self.number[a] << 32 | self.number[b]: i for i, (a, b) in reversed(list(enumerate(merges)))}
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.split = regex.compile(PATTERN)
        #: Where a space begins a pretoken in any text.
        self.cut = regex.compile(r"(?<=\P{White_Space})(?= \P{White_Space})")
        #: States of the search for tokens that end at a byte, by the longest head of a token that does: the moves by byte, and size and number of the tokens, the longest first.
        self.states: dict[bytes, tuple[dict, list[tuple[int, int]]]] = {}
        self.start = self._state(b"")
        #: By the number of the left token (-1: the pretoken's beginning), whether each right one forms a stable pair with it; and how many are known.
        self.stable: dict[int, dict[int, bool]] = {-1: {}}
        self.known_pairs = 0
        #: Counts after each code point of short units that begin with a space, by the rest of the unit, as 32-bit integers; and of short pretokens.
        self.memo: dict[str, bytes] = {}
        self.inside: dict[str, array] = {}
        #: What the pass holds after the beginnings of pretokens.
        self.begun: dict[bytes, tuple] = {}

    def _state(self, head: bytes) -> tuple[dict, list[tuple[int, int]]]:
        if head not in self.states:
            self.states[head] = {}, [(len(head) - k, self.number[head[k:]]) for k in range(len(head)) if head[k:] in self.number]
        return self.states[head]

    def _move(self, state: tuple, byte: int, data: bytes) -> tuple:
        """The state after a byte; data ends with it."""
        k = next(k for k in range(max(0, len(data) - self.longest), len(data) + 1) if data[k:] in self.heads)
        state[0][byte] = found = self._state(data[k:])
        return found

    def _pair_is_stable(self, left: int, right: int) -> bool:
        """Whether the merge rules keep the boundary between two tokens: undo the later merge at the boundary, again and again, and see
        whether a merge across it would have come first."""
        rank, halves, joins = self.rank, self.halves, self.joins
        bound, a, b = 1 << 60, rank[left], rank[right]
        while True:
            across = joins.get(left << 32 | right)
            if across is not None and across < bound:
                return False
            if a > b:
                bound, left = a, halves[left][1]
                a = rank[left]
            elif b < 0:
                return True
            else:
                bound, right = b + 1, halves[right][0]
                b = rank[right]

    def _fits(self, last: int, token: int) -> bool:
        """Whether a token may follow another (-1: the pretoken's beginning)."""
        if self.known_pairs > 2 * MEMO:
            for known in self.stable.values():
                known.clear()
            self.known_pairs = 0
        self.known_pairs += 1
        found = self.stable[last][token] = last < 0 or self._pair_is_stable(last, token)
        return found

    def prefix_counts(self, pretoken: str) -> list[int]:
        """Tokens of every prefix, by bytes, of one pretoken; entry 0 is 0."""
        data = pretoken.encode()
        if len(data) <= HEAD:
            return self._run(data, 0, self.start, [-1], [self.stable[-1]], [0])[3]
        head = data[:HEAD]
        begun = self.begun.get(head)
        if begun is None:
            if len(self.begun) >= HEADS:
                self.begun.clear()
            state, last, _, count = self._run(head, 0, self.start, [-1], [self.stable[-1]], [0])
            begun = self.begun[head] = state, array("i", last), array("i", count)
        state, last, count = begun
        last = last.tolist()
        return self._run(data, HEAD, state, last, list(map(self.stable.get, last)), count.tolist())[3]

    def _run(self, data: bytes, at: int, state: tuple, last: list[int], rows: list[dict], count: list[int]) -> tuple:
        """Goes on with the pass from a byte on. last: the last token of each prefix; rows: what may follow it; count: its tokens."""
        stable = self.stable
        for n in range(at + 1, len(data) + 1):
            byte = data[n - 1]
            to = state[0].get(byte)
            state = self._move(state, byte, data[:n]) if to is None else to
            for size, token in state[1]:
                fits = rows[n - size].get(token)
                if fits is None:
                    fits = self._fits(last[n - size], token)
                if fits:
                    last.append(token)
                    count.append(count[n - size] + 1)
                    row = stable.get(token)
                    rows.append(stable.setdefault(token, {}) if row is None else row)
                    break
        return state, last, rows, count

    def _after_each(self, pretoken: str) -> array:
        """Tokens of the pretoken's prefixes by code points, the empty one left out."""
        found = self.inside.get(pretoken)
        if found is None:
            counts = self.prefix_counts(pretoken)
            if len(counts) == len(pretoken) + 1:
                found = array("I", counts[1:])
            else:
                ends = accumulate(1 if c < "\x80" else len(c.encode()) for c in pretoken)
                found = array("I", [counts[i] for i in ends])
            if len(pretoken) < SHORT:
                if len(self.inside) >= MEMO:
                    self.inside.clear()
                self.inside[pretoken] = found
        return found

    def _unit(self, unit: str) -> bytes:
        """Counts after each code point of a text that begins and ends at pretokens' boundaries, as 32-bit integers."""
        if unit[unit[0] == " " :].isalpha():
            return self._after_each(unit).tobytes()
        pretokens = self.split.findall(unit)
        total, out = 0, array("I")
        for p in pretokens:
            own = self._after_each(p)
            out.extend([total + c for c in own] if total else own)
            total += own[-1]
        self._evened(pretokens, out)
        return out.tobytes()

    def _word(self, bare: str) -> bytes | None:
        """_unit() of a space and a word; None if a space and this would not begin and end at pretokens' boundaries in any text."""
        if not bare or bare[0].isspace() or bare[-1].isspace():
            return None
        found = self.memo.get(bare) or self._unit(" " + bare)
        if len(bare) < SHORT:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[bare] = found
        return found

    def _evened(self, pretokens: list[str], out: array) -> None:
        """Puts right the counts of prefixes that split in another way than the text does: "'r" of "'re" is two pretokens, and a run of white space that
        is followed by nothing is one."""
        at = 0
        for p, following in zip(pretokens, [*pretokens[1:], ""], strict=True):
            before = out[at - 1] if at else 0
            if p in ("'re", "'ve", "'ll"):
                out[at + 1] = before + 2
            elif p.isspace() and following[:1].isspace():
                out[at + len(p)] = before + self._after_each(p + following[0])[-1]
            at += len(p)

    def _plain(self, text: str) -> np.ndarray:
        """Counts after each code point of a text without special strings."""
        if not text:
            return np.zeros(0, np.uint32)
        first, *bare = text.split(" ")
        known = list(map(self.memo.get, bare))
        last = len(bare) - 1
        if None in known:
            known = [(self._unit(" " + w) if i == last and w and w[-1].isspace() and not w[0].isspace() else self._word(w)) if k is None else k for i, (w, k) in enumerate(zip(bare, known, strict=True))]
        if first[-1:].isspace() or not first and bare and not bare[0] or None in known:  # spaces beside other white space
            units = self.cut.split(text)
            sizes = np.fromiter(map(len, units), np.int64, len(units))
            known = [(self._word(u[1:]) if u[0] == " " else None) or self._unit(u) for u in units]
        else:
            sizes = np.fromiter(map(len, bare), np.int64, len(bare)) + 1
            if first:
                sizes = np.concatenate([[len(first)], sizes])
                known.insert(0, self._unit(first))
        out = np.frombuffer(bytearray().join(known), np.uint32)
        if len(sizes) > 1:
            totals = out[np.cumsum(sizes) - 1]
            out += np.repeat(np.cumsum(totals, dtype=np.uint32) - totals, sizes)
        return out

    def table(self, text: str) -> np.ndarray:
        """The tokens of text[:i] at every i from 0 to the text's length."""
        parts = self.special.split(text) if self.special else [text]
        if len(parts) == 1:
            return np.concatenate([np.zeros(1, np.uint32), self._plain(text)])
        out, total = [np.zeros(1, np.uint32)], 0
        for plain, special in zip(parts[::2], [*parts[1::2], ""], strict=True):
            own = self._plain(plain + special[:-1])  # a special string cut short is plain text
            if special:
                last = int(own[len(plain) - 1]) if plain else 0
                own = np.append(own, np.uint32(last + 1))
            out.append(own + np.uint32(total))
            total += int(own[-1]) if len(own) else 0
        return np.concatenate(out)

    def count(self, text: str) -> int:
        """Tokens of the text."""
        return int(self.table(text)[-1])

    def longest_prefix(self, text: str, budget: int, table: np.ndarray | None = None) -> int:
        """Code points of the longest prefix that has at most budget tokens."""
        table = self.table(text) if table is None else table
        return int(np.flatnonzero(table <= budget)[-1])


@lru_cache(maxsize=2)
def _counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def token_counts(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, n_bytes long (UTF-8), n_tokens long, over_limit boolean (n_tokens > limit), fits_chars long
    (code points of the longest prefix within the limit). See the module's notes for the defined cases."""
    arrow_batches(docs.sparkSession)
    own = with_own_names(docs, id=id_col, text=text_col)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for batch in batches:
            size, tokens, fits = [], [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                table = counter.table(text)
                size.append(len(text.encode()))
                tokens.append(int(table[-1]))
                fits.append(len(text) if table[-1] <= limit else counter.longest_prefix(text, limit, table))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_()), pa.array(fits, pa.int64())],
                names=[id_col, "n_bytes", "n_tokens", "over_limit", "fits_chars"],
            )

    return own.mapInArrow(lean(each), f"`{id_col}` {dict(own.dtypes)['id']}, n_bytes long, n_tokens long, over_limit boolean, fits_chars long")
