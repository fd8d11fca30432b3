"""SentencePiece encoding and decoding with a bounded window.

Encoding is a Viterbi pass over the text's characters. Each boundary keeps one backpointer, to the boundary where the best piece
that ends there begins. A piece is at most as long as the vocabulary's longest, so only that many boundaries are open at
a time; whenever the paths back from all of them meet in one boundary, the ids before it are final and leave the window.

The public models at hand are of the BPE kind, whose merges no sum of piece scores reproduces, so survivors are chosen by what
those merges keep: the encoding of a prefix ends in the one piece that forms a stable pair with the piece before it, that is,
encoding the two together gives the two again. This gives the library's ids exactly (the README has more on it). A run
of spaces and the word after it never share a piece with the text before them, so every path meets there: texts are cut
at such places and each word runs through stream(), whatever its length; ids of words are kept in a bounded memo.

Defined cases: null and empty texts have no ids. Characters out of the vocabulary become byte pieces. Decoding gives the text
again, but that U+2581 comes back as a space, as in the library. Rows that repeat an id are encoded each. Models that aren't of the BPE kind, or
that normalise texts or have no byte pieces, raise ValueError: their ids would be other ones.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import arrow_batches, lean

SPACE = "▁"
#: Entries of the memo of words and of that of pairs; a full one is emptied.
MEMO = 600_000
#: Characters of the longest word in the memo, and of the chunks that longer ones are read in.
SHORT = 64
#: The piece before the first one.
START = -1
_CUT = re.compile(f"(?<=[^{SPACE}])(?={SPACE})")


def _checked(path: str, model: sentencepiece.SentencePieceProcessor) -> None:
    """Raises ValueError if the pass wouldn't give the model's ids."""
    kind, rules, nested = 1, b"", {}
    with open(path, "rb") as f:
        top = _fields(f.read())
    for n, value in top:
        if n in (2, 3) and isinstance(value, bytes):
            nested[n] = dict(_fields(value))
    kind = nested.get(2, {}).get(3, 1)
    rules = nested.get(3, {}).get(2, b"")
    collapses = nested.get(3, {}).get(4, 1)
    if kind != 2:
        raise ValueError(f"{path}: only models of the BPE kind are supported")
    if rules or collapses or not nested.get(3, {}).get(3, 1):
        raise ValueError(f"{path}: models that normalise texts, or that put no space before them, aren't supported")
    if not model.is_byte(model.piece_to_id("<0x00>")):
        raise ValueError(f"{path}: models without byte pieces aren't supported")


def _fields(data: bytes) -> list[tuple[int, int | bytes]]:
    """Number and value of the fields of a protocol buffer message."""
    out, i = [], 0

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            b = data[i]
            i += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while i < len(data):
        tag = varint()
        if tag & 7 == 0:
            out.append((tag >> 3, varint()))
        elif tag & 7 == 2:
            n = varint()
            out.append((tag >> 3, data[i : i + n]))
            i += n
        else:
            n = 8 if tag & 7 == 1 else 4
            out.append((tag >> 3, data[i : i + n]))
            i += n
    return out


class StreamingEncoder:
    """path: a SentencePiece model of the BPE kind, with identity normalisation and byte fallback."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        _checked(path, model)
        size = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.ids = {self.pieces[i]: i for i in plain}
        self.score = {self.pieces[i]: model.get_score(i) for i in plain}
        self.byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.byte_of = {i: b for b, i in enumerate(self.byte_ids)}
        self.longest = max(map(len, self.ids))
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("pieces that hold a space after other characters aren't supported")
        self.heads = {p[:k] for p in self.ids for k in range(len(p) + 1)}
        #: States of the search for pieces that end at a character, by the longest head of a piece that does: the moves by character, and size and id of the pieces, the longest first.
        self.states: dict[str, tuple[dict, list[tuple[int, int]]]] = {}
        self.start = self._state("")
        self.surface = [p.replace(SPACE, " ") for p in self.pieces]
        #: By the id of the left piece, whether each right one forms a stable pair with it; and how many are known.
        self.stable: dict[int, dict[int, bool]] = {START: {}}
        self.known_pairs = 0
        self.halves: dict[str, tuple[str, str] | None] = {}
        #: Little-endian ids of short words, without the space that begins each.
        self.memo: dict[str, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text by the merges themselves: the adjacent pair of the highest score joins, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = max((self.score.get(a + b, -np.inf), -i) for i, (a, b) in enumerate(itertools.pairwise(parts)))
            if best == -np.inf:
                break
            parts[-at : 2 - at] = [parts[-at] + parts[1 - at]]
        return parts

    def _halves(self, piece: str) -> tuple[str, str] | None:
        """The two parts that merge last when the piece is encoded; None if it doesn't come out whole."""
        known = self.halves.get(piece, 0)
        if known == 0:
            parts, known = list(piece), None
            while len(parts) > 1:
                best, at = max((self.score.get(a + b, -np.inf), -i) for i, (a, b) in enumerate(itertools.pairwise(parts)))
                if best == -np.inf:
                    known = None
                    break
                known = (parts[-at], parts[1 - at])
                parts[-at : 2 - at] = [parts[-at] + parts[1 - at]]
            self.halves[piece] = known
        return known

    def _pair_is_stable(self, left: str, right: str) -> bool:
        """Whether the merges keep the boundary between two pieces: undo the later merge beside it, again and again, and see whether a
        merge across it would have come first. Of equal scores the one further left comes first."""
        score, bound, ties = self.score, -np.inf, False
        if any(len(x) > 1 and self._halves(x) is None for x in (left, right)):
            return False
        while True:
            across = score.get(left + right)
            if across is not None and (across > bound or ties and across == bound):
                return False
            if len(left) == 1 and len(right) == 1:
                return True
            if len(right) == 1 or len(left) > 1 and score[left] < score[right]:
                bound, ties, left = score[left], False, self._halves(left)[1]
            else:
                bound, ties, right = score[right], True, self._halves(right)[0]

    def _state(self, head: str) -> tuple[dict, list[tuple[int, int]]]:
        if head not in self.states:
            self.states[head] = {}, [(len(head) - k, self.ids[head[k:]]) for k in range(len(head)) if head[k:] in self.ids]
        return self.states[head]

    def _move(self, state: tuple, window: str) -> tuple:
        """The state after the last character of the window."""
        k = next(k for k in range(max(0, len(window) - self.longest), len(window) + 1) if window[k:] in self.heads)
        found = self._state(window[k:])
        if found[1]:  # characters out of the vocabulary are too many to be kept
            state[0][window[-1]] = found
        return found

    def _fits(self, left: int, right: int) -> bool:
        """Whether a piece may follow another (START: none; below that: a character out of the vocabulary, over which no piece reaches)."""
        piece = self.pieces[right]
        if left <= START:
            found = len(piece) == 1 or self._halves(piece) is not None
        else:
            found = self._pair_is_stable(self.pieces[left], piece)
        if self.known_pairs > 2 * MEMO:
            for known in self.stable.values():
                known.clear()
            self.known_pairs = 0
        self.known_pairs += 1
        self.stable.setdefault(max(left, START), {})[right] = found
        return found

    def stream(self, chunks: Iterable[str]) -> Iterator[list[int]]:
        """Ids of a word that comes in chunks, given as soon as they are final. Holds one backpointer (the piece) for each boundary since the ids given, of which
        only those of the longest piece's width are open; the state holds as many characters."""
        stable, pieces, longest, state = self.stable, self.pieces, self.longest, self.start
        tail, last, rows = "", [START], [stable[START]]  # last: the piece that ends at each boundary; rows: what may follow it
        chunks = iter(chunks)
        chunk = next(chunks, None)
        while chunk is not None:
            following = next(chunks, None)
            n = len(last)
            for at, c in enumerate(chunk, 1):
                to = state[0].get(c)
                state = self._move(state, (tail + chunk[:at])[-longest:]) if to is None else to
                for size, piece in state[1]:
                    fits = rows[n - size].get(piece)
                    if fits is None:
                        fits = self._fits(last[n - size], piece)
                    if fits:
                        last.append(piece)
                        row = stable.get(piece)
                        rows.append(stable.setdefault(piece, {}) if row is None else row)
                        break
                else:
                    last.append(-2 - ord(c))
                    rows.append(stable[START])
                n += 1
            meet = n - 1
            if following is not None:
                tail = (tail + chunk)[-longest:]
                heads = set(range(max(0, n - longest), n))
                while len(heads) > 1:  # the open paths, back to where they meet
                    i = max(heads)
                    heads.remove(i)
                    heads.add(i - (len(pieces[last[i]]) if last[i] >= 0 else 1))
                (meet,) = heads
            if meet:
                out, i = [], meet
                while i:
                    piece = last[i]
                    if piece >= 0:
                        out.append(piece)
                        i -= len(pieces[piece])
                    else:
                        out += [self.byte_ids[b] for b in reversed(chr(-2 - piece).encode())]
                        i -= 1
                out.reverse()
                yield out
                del last[:meet], rows[:meet]
            chunk = following

    def _word(self, bare: str) -> bytes:
        if len(bare) >= SHORT:
            word = SPACE + bare
            chunks = (word[i : i + SHORT] for i in range(0, len(word), SHORT))
            return b"".join(np.array(ids, "<i4").tobytes() for ids in self.stream(chunks))
        if len(self.memo) >= MEMO:
            self.memo.clear()
        (out,) = self.stream((SPACE + bare,))
        found = self.memo[bare] = struct.pack(f"<{len(out)}i", *out)
        return found

    def packed(self, text: str) -> bytes:
        """The library's ids of the text, as little-endian 32-bit integers."""
        if not text:
            return b""
        if SPACE in text or "  " in text or text[0] == " " or text[-1] == " ":
            words = [w[1:] for w in _CUT.split(SPACE + text.replace(" ", SPACE))]
        else:
            words = text.split(" ")
        known = list(map(self.memo.get, words))
        if None in known:
            known = [(self.memo.get(w) or self._word(w)) if k is None else k for w, k in zip(words, known, strict=True)]
        return b"".join(known)

    def encode(self, text: str) -> list[int]:
        """The library's ids of the text."""
        return np.frombuffer(self.packed(text), "<i4").tolist()

    def decode(self, ids: list[int], bytes_too: bool = True) -> str:
        """The text of ids; bytes that are no UTF-8 give U+FFFD, as in the library. bytes_too: whether byte pieces may be among them."""
        if not bytes_too or self.byte_of.keys().isdisjoint(ids):
            text = "".join(map(self.surface.__getitem__, ids))
        else:
            parts, held = [], bytearray()
            for i in ids:
                if i in self.byte_of:
                    held.append(self.byte_of[i])
                    continue
                parts.append(held.decode(errors="replace"))
                held.clear()
                parts.append(self.surface[i])
            text = "".join(parts) + held.decode(errors="replace")
        return text[1:] if text[:1] == " " else text


@lru_cache(maxsize=2)
def _encoder(path: str) -> StreamingEncoder:
    return StreamingEncoder(path)


def encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """docs with a column of ids more (of that name, instead of one that had it). See the module's notes for the defined cases."""
    return _with_column(docs, text_col, ids_col, "array<int>", lambda column: _encode_batch(path, column))


def decode(docs: DataFrame, path: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """docs with the texts of its ids as a column more. Null ids give an empty text."""
    return _with_column(docs, ids_col, text_col, "string", lambda column: pa.array([_encoder(path).decode(x or []) for x in column.to_pylist()], pa.string()))


def encoded_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, n_ids long, ids_sha256 string (lowercase hex of the ids as little-endian 32-bit integers),
    round_trip boolean (decoding gives the text, with U+2581 as a space)."""
    arrow_batches(docs.sparkSession)
    own = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(path)
        last_byte = max(coder.byte_ids)
        for batch in batches:
            size, digest, same = [], [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                packed = coder.packed(text)
                ids = np.frombuffer(packed, "<i4")
                size.append(len(ids))
                digest.append(hashlib.sha256(packed).hexdigest())
                same.append(coder.decode(ids.tolist(), bool((ids <= last_byte).any())) == text.replace(SPACE, " "))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(digest, pa.string()), pa.array(same, pa.bool_())], names=[id_col, "n_ids", "ids_sha256", "round_trip"])

    return own.mapInArrow(lean(each), f"`{id_col}` {dict(own.dtypes)['id']}, n_ids long, ids_sha256 string, round_trip boolean")


def _encode_batch(path: str, column: pa.Array) -> pa.Array:
    coder = _encoder(path)
    rows = [coder.packed(x.as_py() or "") for x in column]
    ends = np.cumsum([0, *map(len, rows)]) // 4
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(rows), "<i4")))


def _with_column(docs: DataFrame, source: str, target: str, kind: str, of) -> DataFrame:
    arrow_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c != target]
    at = docs.columns.index(source)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(i) for i, c in enumerate(docs_columns) if c != target]
            yield pa.RecordBatch.from_arrays([*columns, of(batch.column(at))], names=[*kept, target])

    docs_columns = docs.columns
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != target), f"`{target}` {kind}"])
    return docs.mapInArrow(lean(each), schema)
