"""Finds test passages in documents, in one piece or reordered, by greedy string tiling.

Tokens are runs of letters and digits after lower-casing (all characters beyond ASCII count as letters), so punctuation and case don't
hide a passage. A seed is five tokens in a row (a shorter item is one seed). Documents that share a seed with an item
are tiled against it: the longest common runs are marked first, where they overlap nothing marked yet, then the next
shorter ones, down to five tokens; equal windows are found by rolling hashes and extended. The item's tokens under tiles, over all its tokens, are its
coverage, and 0.8 or more contaminates the document.

Test items of up to BROADCAST_BYTES of text in all, measured first, travel to the scan of the documents, and nothing is shuffled. A larger benchmark stays
distributed: seeds of documents and items are joined, and texts meet the items that they share a seed with. Both ways give the same rows.

Defined cases: null or empty texts and items match nothing. Items of equal texts are found each. Rows that repeat an id are searched each. Very
long texts are searched whole; repeated words cost no quadratic time. An empty benchmark contaminates nothing. Ids of items and documents are of any type and may be null. Of equally long
matches the first in the item, then in the text, is marked. Extra columns are ignored by contamination() and kept by decontaminated().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ._spark import arrow_batches, lean, stored, unused, with_own_names
from ._text import TOKEN, _power, mix, shingles, spans_hash, text_slices, words

SEED, COVERAGE = 5, 0.8
#: Bytes of test items that are carried to the documents.
BROADCAST_BYTES = 32 << 20


def _runs(prefix: np.ndarray, blocked: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of size tokens begin that hold none marked, and their hashes. prefix: running sums of tokens; blocked: of marks."""
    n = len(prefix) - size
    at = np.flatnonzero(blocked[size:] == blocked[:n])
    return at, mix((prefix[at + size] - prefix[at]) * _power("down", len(prefix))[at])


def _sums(tokens: np.ndarray) -> np.ndarray:
    prefix = np.zeros(len(tokens) + 1, np.uint64)
    np.cumsum(mix(tokens) * _power("up", len(tokens)), out=prefix[1:])
    return prefix


def tiles(item: np.ndarray, text: np.ndarray, least: int = SEED) -> list[tuple[int, int, int]]:
    """Tiles (start in item, start in text, length) of two sequences of token hashes, the longest first; of equals the first in the item,
    then in the text.

    The length of the longest common run that overlaps no mark is found by bisection over rolling hashes; all such runs of that length are marked, then the next shorter ones."""
    n, m = len(item), len(text)
    least = min(least, n)
    if not n or m < least:
        return []
    marked_item, marked_text = np.zeros(n, bool), np.zeros(m, bool)
    prefix_item, prefix_text = _sums(item), _sums(text)
    out: list[tuple[int, int, int]] = []
    most = min(n, m)
    while True:
        blocked_item, blocked_text = (np.concatenate([[0], np.cumsum(x)]) for x in (marked_item, marked_text))
        common = lambda size: bool(np.isin(_runs(prefix_item, blocked_item, size)[1], _runs(prefix_text, blocked_text, size)[1]).any())  # noqa: B023, E731
        if most < least or not common(least):
            return out
        low, high = least, most
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if common(middle) else (low, middle - 1)
        size = low
        at_item, value_item = _runs(prefix_item, blocked_item, size)
        at_text, value_text = _runs(prefix_text, blocked_text, size)
        order = np.argsort(value_text, kind="stable")
        left, right = (np.searchsorted(value_text[order], value_item, side) for side in ("left", "right"))
        following: dict[int, int] = {}  # the first place of each hash that isn't tried yet; places that were marked stay so
        for i, a, b in zip(at_item.tolist(), left.tolist(), right.tolist(), strict=True):
            k = following.get(a, a)
            while k < b and not marked_item[i : i + size].any():
                j = int(at_text[order[k]])
                if not marked_text[j : j + size].any():
                    marked_item[i : i + size] = marked_text[j : j + size] = True
                    if np.array_equal(item[i : i + size], text[j : j + size]):
                        out.append((i, j, size))
                k += 1
            if a < b:
                following[a] = k
        most = size - 1


class Items:
    """Test items of one pass: their tokens' hashes, and their sorted seeds with the items that have each."""

    def __init__(self, ids: list, texts: list[str]):
        self.ids, self.tokens, seeds, owners = ids, [], [], []
        for lo, _, data, offsets in text_slices(pc.utf8_lower(pa.array(texts, pa.string()))):
            starts, ends, first = words(data, offsets, TOKEN)
            h = spans_hash(data, starts, ends)
            for k in range(len(first) - 1):
                own = h[first[k] : first[k + 1]]
                self.tokens.append(own)
                s = np.unique(shingles(own, np.array([0, len(own)]), SEED)[0])
                seeds.append(s)
                owners.append(np.full(len(s), lo + k))
        seeds, owners = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (seeds, owners))
        order = np.argsort(seeds, kind="stable")
        self.seeds, self.owners = seeds[order], owners[order].astype(np.int64)
        #: Lengths of items that are shorter than a seed.
        self.short = sorted({len(t) for t in self.tokens if 0 < len(t) < SEED})

    def found(self, tokens: np.ndarray, first: np.ndarray) -> list[tuple[int, int]]:
        """(row, item) pairs that share a seed."""
        out: set[tuple[int, int]] = set()
        for width in (SEED, *self.short):
            value, begin = shingles(tokens, first, width)
            left = np.searchsorted(self.seeds, value, "left")
            left[left == len(self.seeds)] = 0
            hit = np.flatnonzero(self.seeds[left] == value) if len(self.seeds) else np.zeros(0, np.int64)
            if len(hit):
                rows = np.searchsorted(begin, hit, "right") - 1
                row, lo = np.unique(np.column_stack([rows, left[hit]]), axis=0).T
                count = np.searchsorted(self.seeds, self.seeds[lo], "right") - lo
                at = np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                out.update(p for p in set(zip(np.repeat(row, count).tolist(), self.owners[at].tolist(), strict=True)) if len(self.tokens[p[1]]) == width or width == SEED and len(self.tokens[p[1]]) > SEED)
        return sorted(out)

    def covered(self, column: pa.Array, coverage: float) -> Iterator[tuple[int, int, float, int]]:
        """Row, item, coverage and number of tiles of each item that a text holds."""
        for lo, _, data, offsets in text_slices(pc.utf8_lower(column)):
            starts, ends, first = words(data, offsets, TOKEN)
            tokens = spans_hash(data, starts, ends)
            for r, k in self.found(tokens, first):
                got = tiles(self.tokens[k], tokens[first[r] : first[r + 1]])
                cover = sum(x[2] for x in got) / len(self.tokens[k])
                if cover >= coverage:
                    yield lo + r, k, cover, len(got)


def _carried(items: DataFrame) -> tuple[list, list[str]] | None:
    """Ids and texts of the items, if they are small enough to be carried to the documents."""
    size = items.agg(F.sum(F.octet_length("text") + F.coalesce(F.octet_length(F.col("id").cast("string")), F.lit(0)) + 16)).first()[0] or 0
    if size > BROADCAST_BYTES:
        return None
    rows = items.where("text <> ''").collect()
    return [r[0] for r in rows], [r[1] for r in rows]


def _seeds(texts: DataFrame, widths: list[int], whole: bool) -> DataFrame:
    """texts: key, text. The distinct seeds of each text: key, width, seed. whole: texts shorter than a seed are one (items), else all runs of each width are (documents)."""
    kind = dict(texts.dtypes)["key"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, data, offsets in text_slices(pc.utf8_lower(batch.column(1))):
                starts, ends, first = words(data, offsets, TOKEN)
                tokens, count = spans_hash(data, starts, ends), np.diff(first)
                for width in [SEED] if whole else widths:
                    value, begin = shingles(tokens, first, width)
                    row = np.repeat(np.arange(len(count)), np.diff(begin))
                    keep = np.ones(len(value), bool) if whole else count[row] >= width
                    pairs = np.unique(np.column_stack([row[keep].astype(np.uint64), value[keep]]), axis=0)
                    row = pairs[:, 0].astype(np.int64)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row + lo)), pa.array(np.minimum(count[row], width).astype(np.int32)), pa.array(pairs[:, 1].copy().view(np.int64))], names=["key", "width", "seed"])

    return texts.mapInArrow(lean(each), f"key {kind}, width int, seed long")


def _tiled_apart(own: DataFrame, items: DataFrame, coverage: float) -> DataFrame:
    """own: text; items: id, text. Distributed: text, item, coverage, n_tiles."""
    keys = lambda df, *more: df.where("text <> ''").select(F.struct(F.xxhash64("text").alias("a"), F.xxhash64("text", F.lit(1)).alias("b")).alias("key"), "text", *more)
    flat = lambda df: df.select(F.concat_ws(":", "key.a", "key.b").alias("key"), *[c for c in df.columns if c != "key"])
    texts = stored(flat(keys(own)).dropDuplicates(["key"]), "texts")
    tests = stored(flat(keys(items, "id")), "items")
    of_items = stored(_seeds(tests.select("key", "text").dropDuplicates(["key"]), [], True).withColumnRenamed("key", "item"), "item-seeds")
    widths = sorted(r[0] for r in of_items.select("width").distinct().collect())
    pairs = _seeds(texts, widths or [SEED], False).join(of_items, ["seed", "width"]).select("key", "item").distinct()
    meet = pairs.join(tests.select(F.col("key").alias("item"), F.col("text").alias("test")).dropDuplicates(["item"]), "item").join(texts, "key").select("key", "item", "test", "text")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i in range(len(batch)):
                test = Items([0], [batch.column(2)[i].as_py()])
                rows += [(i, cover, count) for _, _, cover, count in test.covered(batch.column(3).slice(i, 1), coverage)]
            at = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array([r[1] for r in rows], pa.float64()), pa.array([r[2] for r in rows], pa.int64())], names=["key", "item", "coverage", "n_tiles"])

    found = meet.mapInArrow(lean(each), "key string, item string, coverage double, n_tiles long")
    named = found.join(tests.select(F.col("key").alias("item"), F.col("id").alias("item_id")), "item").select("key", "item_id", "coverage", "n_tiles")
    return stored(named, "covered")


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """A row for each row of docs and test item of at least that coverage: id, item, coverage double, n_tiles long."""
    arrow_batches(docs.sparkSession)
    own, items = with_own_names(docs, id=id_col, text=text_col), with_own_names(benchmark, id=item_col, text=item_text_col)
    carried = _carried(items)
    if carried is None:
        found = _tiled_apart(own, items, coverage)
        key = F.concat_ws(":", F.xxhash64("text"), F.xxhash64("text", F.lit(1)))
        return own.withColumn("key", key).join(found, "key").select(F.col("id").alias(id_col), F.col("item_id").alias(item_col), "coverage", "n_tiles")
    kind, item_kind = own.schema["id"].dataType.simpleString(), items.schema["id"].dataType
    shared = docs.sparkSession.sparkContext.broadcast(carried)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test, id_kind = Items(*shared.value), to_arrow_type(item_kind)
        for batch in batches:
            rows = list(test.covered(batch.column(1), coverage))
            columns = [batch.column(0).take(pa.array([r[0] for r in rows], pa.int64())), pa.array([test.ids[r[1]] for r in rows], id_kind)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([r[2] for r in rows], pa.float64()), pa.array([r[3] for r in rows], pa.int64())], names=[id_col, item_col, "coverage", "n_tiles"])

    return own.mapInArrow(lean(each), f"`{id_col}` {kind}, `{item_col}` {item_kind.simpleString()}, coverage double, n_tiles long")


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """A row for each contaminated id: id, n_items long, coverage double (the largest), items (sorted)."""
    hits = contamination(docs, benchmark, id_col, text_col, item_col, item_text_col)
    return hits.groupBy(f"`{id_col}`").agg(F.countDistinct(f"`{item_col}`").alias("n_items"), F.max("coverage").alias("coverage"), F.sort_array(F.collect_set(f"`{item_col}`")).alias("items"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs, with all columns, whose text holds no test item. Ids aren't looked at."""
    arrow_batches(docs.sparkSession)
    items = with_own_names(benchmark, id=item_col, text=item_text_col)
    carried = _carried(items)
    if carried is None:
        bad = _tiled_apart(with_own_names(docs, id=id_col, text=text_col), items, COVERAGE).select(F.col("key").alias(name := unused(docs, "bad"))).distinct()
        text = F.col(f"`{text_col}`")
        return docs.join(bad, F.concat_ws(":", F.xxhash64(text), F.xxhash64(text, F.lit(1))) == F.col(name), "left_anti")
    shared = docs.sparkSession.sparkContext.broadcast(carried)
    at = docs.columns.index(text_col)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = Items(*shared.value)
        for batch in batches:
            clean = np.ones(len(batch), bool)
            clean[[r[0] for r in test.covered(batch.column(at), COVERAGE)]] = False
            yield batch.filter(pa.array(clean))

    return docs.mapInArrow(lean(each), docs.schema)
