"""Removes passages that repeat earlier ones, within and across documents, word by word.

Every run of 25 words or more that equals an earlier one, by id and position, is deleted, wherever it begins and ends. Hashes of eight words in a row are
winnowed: each window of 25 words is owned by the least of its 18 hashes, its anchor, which depends on the window's words alone, so equal windows
have equal anchors. A row for each anchor (one in about nine words) carries short hashes of all windows it owns. Anchors that come up once are dropped. Of the
others, rows with equal windows all repeat the first of them; of these first ones the windows are compared one by one, by anchor and hash. So
each window that has an earlier equal is found, whatever lies around it, and they join into runs of any length.

A place is one number, which holds id and position in their order, where ids are whole numbers that span less than 2^32, and a struct of both elsewhere. Numbers are
aggregated by hash; structs give the same result, but each aggregation sorts its rows.

Lines of text (from break to break) of eight to 24 words, and four sentences in a row that hold fewer than 25 words, are compared as a whole. A line is deleted
if it has eight words or more and all of it repeats. Every word that is deleted lies in a passage that equals an earlier one.

Only hashes meet in the shuffle, counts are summed before it, and no group of equal ones is gathered in one task.

Defined cases: null and empty texts stay as they are, and so do rows with a null id. Documents that lose every word are dropped by
dedup_lines(). Rows that repeat an id with the same text get the same deletions; other texts under the same id are compared in order of position.
In a text that repeats itself with some period the first period stays. Very long texts are handled whole. Extra columns stay, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import arrow_batches, lean, stored, unused, with_own_names
from ._text import _power, mix, spans_hash, text_slices

MIN_WORDS, MIN_LINE_WORDS = 25, 8
GRAM, SENTENCES = 8, 4
WINDOW = MIN_WORDS - GRAM + 1
_STOP = np.zeros(256, bool)
_STOP[[33, 46, 63]] = True
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
#: A text holds less than 2^31 words, so a place has that many bits for the position.
AT_BITS = 31
_WHOLE = {"tinyint", "smallint", "int", "bigint"}
#: Up to so many bytes of a word are hashed eight by eight.
_LONG_WORD = 64
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_BY_SIZE, _BY_STEP = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def _word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, which depends on its bytes alone."""
    size = end - start
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    out = mix((eight[start] & _LOW_BYTES[np.minimum(size, 8)]) + size.astype(np.uint64) * _BY_SIZE)
    rest, done = np.flatnonzero(size > 8), 8
    while len(rest) and done < _LONG_WORD:
        left = size[rest] - done
        out[rest] = mix(out[rest] * _BY_STEP + (eight[start[rest] + done] & _LOW_BYTES[np.minimum(left, 8)]))
        rest, done = rest[left > 8], done + 8
    if len(rest):
        out[rest] = spans_hash(data, start[rest], end[rest], fold=False)
    return out


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What words() gives, by one search for the changes between words and white space."""
    member = np.zeros(len(data) + 2, bool)
    np.logical_and(data != 32, data - np.uint8(9) > 4, out=member[1:-1])
    edges = np.flatnonzero(member[1:] != member[:-1])
    # words end with their row: where one goes on in the next row, it ends and another starts
    cuts = np.unique(offsets[1:-1])
    cuts = cuts[member[cuts] & member[cuts + 1]]
    if len(cuts):
        edges = np.insert(edges, np.repeat(np.searchsorted(edges, cuts), 2), np.repeat(cuts, 2))
    starts = edges[::2]
    return starts, edges[1::2], np.searchsorted(starts, offsets)


class Words:
    """The words of a slice of texts: start and end (bytes), newline (is the last of a line of text), and first (of each row, one entry more than rows)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = data
        self.start, self.end, self.first = _words(data, offsets)
        n = len(self.start)
        self.newline = np.zeros(n, bool)
        if n:
            before = np.searchsorted(self.start, np.flatnonzero(data == 10))
            self.newline[before[before > 0] - 1] = True
            self.newline[self.first[1:][np.diff(self.first) > 0] - 1] = True

    def hashes(self) -> np.ndarray:
        """Running sums that _run_hash() takes."""
        n = len(self.start)
        prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(_word_hashes(self.data, self.start, self.end) * _power("up", n), out=prefix[1:])
        return prefix


def _run_hash(prefix: np.ndarray, lo: np.ndarray, size: int | np.ndarray, kind: int) -> np.ndarray:
    """Hashes of size words from lo on."""
    salt = np.asarray(size).astype(np.uint64) * np.uint64(4) + np.uint64(kind)
    return mix((prefix[lo + size] - prefix[lo]) * _power("down", len(prefix))[lo] + salt)


def _every_run_hash(prefix: np.ndarray, size: int, kind: int) -> np.ndarray:
    """_run_hash() from every word on that has size words from it on. There is one at least."""
    count = len(prefix) - size
    return mix((prefix[size:] - prefix[:count]) * _power("down", count) + np.uint64(size * 4 + kind))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least value of each run of width values."""
    least, span = values, 1
    while span < width:
        step = min(span, width - span)
        least = np.minimum(least[: len(least) - step], least[step:])
        span += step
    return least


def _anchors(text: Words, with_windows: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first word, number of words, and the bounds of their windows in the array of windows' hashes that comes last, which is empty if they aren't wanted."""
    prefix, first = text.hashes(), text.first
    n = len(text.start)
    count = np.diff(first)
    row_end = np.repeat(first[1:], count)
    count = np.maximum(count - (MIN_WORDS - 1), 0)
    starts = np.arange(count.sum()) + np.repeat(first[:-1] - (np.cumsum(count) - count), count)
    fp = at = size = np.zeros(0, np.int64)
    fp, bounds, windows = fp.view(np.uint64), np.zeros(1, np.int64), np.zeros(0, np.uint32)
    if len(starts):
        grams = _every_run_hash(prefix, GRAM, 0)
        least = _least(grams, WINDOW)
        # the anchor is the first least one: it changes with the least value, and where the one that falls out had that value
        change = np.ones(len(least), bool)
        change[1:] = (least[1:] != least[:-1]) | (grams[: len(least) - 1] == least[:-1])
        change, anchor = change[starts], least[starts]
        change[1:] |= starts[1:] != starts[:-1] + 1
        change[0] = True
        begin = np.flatnonzero(change)
        bounds = np.append(begin, len(starts))
        fp, at, size = anchor[begin], starts[begin], np.diff(bounds) + (MIN_WORDS - 1)
        if with_windows:
            windows = (_every_run_hash(prefix, MIN_WORDS, 1)[starts] >> np.uint64(32)).astype(np.uint32)
    # lines of text and groups of sentences that are shorter than a window
    line_end = np.flatnonzero(text.newline) + 1
    line_at = np.concatenate([[0], line_end[:-1]]) if len(line_end) else line_end
    line_size = line_end - line_at
    ok = (line_size >= MIN_LINE_WORDS) & (line_size < MIN_WORDS)
    line_at, line_size = line_at[ok], line_size[ok]
    after = np.minimum(text.end, len(text.data) - 1)
    end = np.flatnonzero(text.newline | _STOP[text.data[text.end - 1]] & _BLANK[text.data[after]]) + 1 if n else line_end
    begin = np.concatenate([[0], end[:-1]]) if len(end) else end
    some_at, some_end = begin[: max(0, len(end) - SENTENCES + 1)], end[SENTENCES - 1 :]
    ok = (some_end - some_at < MIN_WORDS) & (some_end <= row_end[some_at])
    some_at, some_size = some_at[ok], (some_end - some_at)[ok]
    fp = np.concatenate([fp, _run_hash(prefix, line_at, line_size, 2), _run_hash(prefix, some_at, some_size, 3)])
    bounds = np.concatenate([bounds, np.full(len(line_at) + len(some_at), bounds[-1])])
    return fp, np.concatenate([at, line_at, some_at]), np.concatenate([size, line_size, some_size]), bounds, windows


def _fingerprints(docs: DataFrame) -> DataFrame:
    """docs: id, text. The fp of each row of _places(), alone."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in text_slices(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(_anchors(Words(data, offsets), False)[0].view(np.int64))], names=["fp"])

    return docs.where("id is not null and text <> ''").select("text").mapInArrow(lean(each), "fp long")


def _least_id(docs: DataFrame) -> int | None:
    """docs: id. The least id, if all of them from it on fit into the number of a place; 0 without ids."""
    if dict(docs.dtypes)["id"] not in _WHOLE:
        return None
    low, high = docs.agg(F.min("id"), F.max("id")).first()
    if low is None:
        return 0
    return low if high - low < 1 << 63 - AT_BITS else None


def _places(docs: DataFrame, least_id: int | None) -> DataFrame:
    """docs: id, text. A row for each anchor, and each short line or group of sentences: fp, place, size (words), windows (hashes, four bytes each; empty for the short ones)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            if least_id is not None:
                ids = ids.cast(pa.int64()).to_numpy(zero_copy_only=False) - least_id << AT_BITS
            for lo, _, data, offsets in text_slices(batch.column(1)):
                text = Words(data, offsets)
                fp, at, size, bounds, windows = _anchors(text)
                row = np.searchsorted(text.first, at, "right") - 1
                at -= text.first[row]
                if least_id is not None:
                    place = pa.array(ids[row + lo] + at)
                else:
                    place = pa.StructArray.from_arrays([ids.take(pa.array(row + lo)), pa.array(at.astype(np.int32))], ["id", "at"])
                packed = pa.Array.from_buffers(pa.binary(), len(fp), [None, pa.py_buffer((bounds * 4).astype(np.int32)), pa.py_buffer(windows)])
                yield pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)), place, pa.array(size.astype(np.int32)), packed], names=["fp", "place", "size", "windows"])

    kind = f"struct<id: {dict(docs.dtypes)['id']}, at: int>" if least_id is None else "long"
    return docs.where("id is not null and text <> ''").mapInArrow(lean(each), f"fp long, place {kind}, size int, windows binary")


def _each_window(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """fp, windows, place to a row for each window: key, place."""
    for batch in batches:
        fp, packed, place = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), batch.column(1), batch.column(2)
        wide = pa.types.is_large_binary(packed.type)
        _, offsets, data = packed.buffers()
        bounds = np.frombuffer(offsets, np.int64 if wide else np.int32, len(packed) + 1, packed.offset * (8 if wide else 4)).astype(np.int64) // 4
        hashes = np.frombuffer(data, np.uint32, int(bounds[-1]))[bounds[0] :]
        count = np.diff(bounds)
        row = np.repeat(np.arange(len(batch)), count)
        nth = np.arange(len(row)) - (bounds[:-1] - bounds[0])[row]
        key = mix(fp[row] + mix(hashes.astype(np.uint64) + np.uint64(1)))
        if pa.types.is_struct(place.type):
            at = place.field(1).to_numpy(zero_copy_only=False)[row] + nth
            place = pa.StructArray.from_arrays([place.field(0).take(pa.array(row)), pa.array(at.astype(np.int32))], ["id", "at"])
        else:
            place = pa.array(place.to_numpy(zero_copy_only=False)[row] + nth)
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), place], names=["key", "place"])


def repeats(docs: DataFrame) -> DataFrame:
    """docs: id, text. Returns id and spans, an array of numbers lo << 32 | hi of word numbers (hi exclusive) that equal words before them."""
    # both sides of each join are plain shuffles, which adaptive execution can split where one fingerprint is very common; the right ones have a row for each key
    # and a small part of the rows, so they are hashed, and the left ones needn't be sorted
    least_id = _least_id(docs)
    places = _places(docs, least_id)
    known = stored(_fingerprints(docs).groupBy("fp").agg(F.count("*").alias("total")).where("total > 1"), "known-lines")
    several = stored(places.join(known.hint("shuffle_hash"), "fp").withColumn("block", F.xxhash64("fp", "windows")).sortWithinPartitions("block"), "repeated-lines")
    blocks = stored(several.groupBy("block", "fp", "windows", "total").agg(F.min("place").alias("r"), F.count("*").alias("n")), "first-lines")
    whole = several.select("block", "place", "size").join(blocks.where("n > 1").select("block", "r").hint("shuffle_hash"), "block").where("place <> r").select("place", "size")
    # a window of a later block of equal ones is covered, and has an earlier equal in the first block
    kind = dict(places.dtypes)["place"]
    windows = blocks.where("n < total and length(windows) > 0").select("fp", "windows", "r").mapInArrow(lean(_each_window), f"key long, place {kind}")
    least = windows.groupBy("key").agg(F.min("place").alias("r"), F.count("*").alias("n")).where("n > 1").select("key", "r")
    single = windows.join(least.hint("shuffle_hash"), "key").where("place <> r").select("place", F.lit(MIN_WORDS).alias("size"))
    if least_id is None:
        own_id, at = F.col("place.id"), F.col("place.at").cast("long")
    else:
        own_id, at = (F.shiftright("place", AT_BITS) + F.lit(least_id)).cast(dict(docs.dtypes)["id"]), F.col("place").bitwiseAND(F.lit((1 << AT_BITS) - 1))
    spans = whole.unionAll(single).select(own_id.alias("id"), (F.shiftleft(at, 32) + at + F.col("size")).alias("span"))
    return spans.groupBy("id").agg(F.collect_set("span").alias("spans"))


def _deleted(text: Words, row: int, spans: np.ndarray) -> np.ndarray:
    """Which words of a row go."""
    a, b = int(text.first[row]), int(text.first[row + 1])
    n = b - a
    lo, hi = spans >> 32, spans & 0xFFFFFFFF
    lo, hi = lo[hi <= n], hi[hi <= n]
    change = np.bincount(lo, minlength=n + 1) - np.bincount(hi, minlength=n + 1)
    covered = np.cumsum(change)[:n] > 0
    out = np.zeros(n, bool)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
    text_line = np.cumsum(text.newline[a:b]) - text.newline[a:b]
    for s, e in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        if e - s >= MIN_WORDS:
            out[s:e] = True
            continue
        for t in np.unique(text_line[s:e]).tolist():
            x, y = np.searchsorted(text_line, [t, t + 1])
            if s <= x and y <= e and y - x >= MIN_LINE_WORDS:
                out[x:y] = True
    return out


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", removed_col: str = "n_removed_words") -> DataFrame:
    """docs with repeated runs cut out of its texts, and a column of the number of words removed more. Keeps every row."""
    arrow_batches(docs.sparkSession)
    spans = repeats(with_own_names(docs, id=id_col, text=text_col)).withColumnsRenamed({"id": (own_id := unused(docs, "id")), "spans": unused(docs, "spans")})
    joined = docs.drop(removed_col).join(spans.hint("shuffle_hash"), F.col(f"`{id_col}`") == F.col(own_id), "left").drop(own_id)
    names = [c for c in docs.columns if c != removed_col]
    at = names.index(text_col)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(len(names))
            rows = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
            removed = np.zeros(len(batch), np.int64)
            texts = batch.column(at)
            if len(rows):
                spans_of = [found[i].values.to_numpy(zero_copy_only=False) for i in rows.tolist()]
                some = texts.take(pa.array(rows))
                changed = {}
                for lo, hi, data, offsets in text_slices(some):
                    own = Words(data, offsets)
                    for k in range(lo, hi):
                        gone = _deleted(own, k - lo, spans_of[k])
                        if gone.any():
                            a = int(own.first[k - lo])
                            removed[rows[k]] = gone.sum()
                            changed[int(rows[k])] = _cut(data[offsets[k - lo] : offsets[k - lo + 1]].tobytes(), own, a, gone, int(offsets[k - lo]))
                if changed:
                    at_changed = np.zeros(len(batch), bool)
                    at_changed[list(changed)] = True
                    texts = pc.replace_with_mask(texts, pa.array(at_changed), pa.array(list(changed.values()), texts.type))
            columns = [batch.column(i) for i in range(len(names))]
            columns[at] = texts
            yield pa.RecordBatch.from_arrays([*columns, pa.array(removed)], names=[*names, removed_col])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    return joined.mapInArrow(lean(each), ", ".join([*(f"`{c}` {kinds[c]}" for c in names), f"`{removed_col}` long"]))


def _cut(text: bytes, found: Words, a: int, gone: np.ndarray, offset: int) -> str:
    """The text without the words that go; what stays keeps the white space before it."""
    n = len(gone)
    end = found.end[a : a + n] - offset
    edges = np.flatnonzero(np.diff(np.concatenate([[0], (~gone).astype(np.int8), [0]])))
    out = [text[(end[s - 1] if s else 0) : end[e - 1]] for s, e in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)]
    return b"".join(out).strip().decode()


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, of the same columns, with repeated runs cut out of its texts and without the documents that lose every word."""
    removed = unused(docs, "removed")
    out = without_repeats(docs, id_col, text_col, removed)
    return out.where((F.col(removed) == 0) | (F.length(F.trim(F.col(f"`{text_col}`"))) > 0)).drop(removed)
