"""Near-duplicate groups of documents: MinHash bands propose pairs, odd sketches screen them, full shingle sets confirm them.

Words are runs of bytes other than ASCII white space after lower-casing A-Z; a document's set holds its distinct
shingles of five words (a shorter document is one shingle). Texts with equal sets collapse to one representative
first, so a large group of copies costs one row each. Each representative's 160 MinHash values form 32 bands of five
and an odd sketch of 512 bits: a bit flips for each (place, value) that hashes to it, so the XOR of two sketches holds
the parity of the values in which two documents differ, which is precise when that is few.

Pairs come in two steps, as only groups are asked for and not all pairs within them. First every member of a band's
bucket is compared with the bucket's smallest id, which joins most of a large group. Then members of one bucket that are
still in different groups are compared, in blocks of up to 256 by 256, by sketch; no bucket is capped. What the sketch lets pass
(all but pairs that are estimated at 0.16 below the threshold or less, over five standard deviations) is confirmed on
the full sets, where texts are sent to blocks of pairs and not to each pair. Groups are the connected components, found by contracting edges in rounds.

Defined cases: null or empty texts (and texts of white space alone) have no shingle, are linked with nothing and are
their own group. Rows that repeat an id are one document. A null id keeps its row, with a null group. An empty table
gives an empty result. Columns besides the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import arrow_batches, lean, stored, with_own_names
from ._text import distinct_by_row, mix, shingles, spans_hash, text_slices, words

WIDTH, BANDS, ROWS, SKETCH_BITS = 5, 32, 5, 512
PLACES = BANDS * ROWS
#: How far below the threshold an estimate may be and still be confirmed; the deviation of 160 values is 0.03 at most.
SLACK = 0.16
#: Members of one block of a bucket.
BLOCK = 256
#: Ids that may be broadcast, 8 to 16 MB.
BROADCAST_IDS = 1_000_000

_rng = np.random.default_rng(7)
_A = _rng.integers(0, 1 << 31, PLACES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 1 << 32, PLACES, dtype=np.uint32)
_PLACE = mix(np.arange(1, PLACES + 1, dtype=np.uint64))
_IN_BAND = mix(np.arange(1000, 1000 + ROWS, dtype=np.uint64)) | np.uint64(1)
_BAND = mix(np.arange(2000, 2000 + BANDS, dtype=np.uint64))


def shingle_sets(column: pa.Array, width: int = WIDTH) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, distinct shingles, first shingle of each row) for slices of a column of texts."""
    for lo, hi, data, offsets in text_slices(column):
        starts, ends, first = words(data, offsets)
        yield lo, hi, *distinct_by_row(*shingles(spans_hash(data, starts, ends), first, width))


def min_hashes(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """PLACES MinHash values of each set."""
    out = np.full((len(begin) - 1, PLACES), 0xFFFFFFFF, np.uint32)
    short = (values >> np.uint64(32)).astype(np.uint32)
    for i, (s, e) in enumerate(zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)):
        for k in range(s, e, 512):
            np.minimum(out[i], (short[k : min(e, k + 512), None] * _A + _B).min(axis=0), out=out[i])
    return out


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One key for each band, which holds the band's number."""
    return mix((hashes.reshape(-1, BANDS, ROWS).astype(np.uint64) * _IN_BAND).sum(axis=2, dtype=np.uint64) ^ _BAND)


def odd_sketches(hashes: np.ndarray) -> np.ndarray:
    """SKETCH_BITS parity bits of each set, as 64-bit words."""
    n = len(hashes)
    at = (mix(hashes.astype(np.uint64) + _PLACE) % np.uint64(SKETCH_BITS)).astype(np.int64)
    odd = np.bincount((at + np.arange(n)[:, None] * SKETCH_BITS).ravel(), minlength=n * SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8).reshape(n, SKETCH_BITS), axis=1).view(np.int64).reshape(n, SKETCH_BITS // 64)


def most_differing_bits(threshold: float) -> int:
    """Bits in which sketches of a pair of that similarity may differ, with the slack."""
    differ = 2 * PLACES * (1 - (threshold - SLACK))
    return int(np.ceil(SKETCH_BITS / 2 * (1 - (1 - 2 / SKETCH_BITS) ** differ)))


def _long_lists(values: np.ndarray) -> pa.Array:
    values = np.ascontiguousarray(values).view(np.int64)
    n, k = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * k), pa.array(values.ravel()))


def signatures(docs: DataFrame) -> DataFrame:
    """docs: id, text. Returns id, n_shingles, d1 and d2 (a digest of the set), keys (a list for bands), sketch."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, values, begin in shingle_sets(batch.column(1)):
                n = np.diff(begin)
                safe = np.concatenate([values, np.zeros(1, np.uint64)])
                d1 = np.where(n > 0, np.add.reduceat(mix(safe), begin[:-1]), np.uint64(0))
                d2 = np.where(n > 0, np.bitwise_xor.reduceat(mix(safe + np.uint64(12345)), begin[:-1]), np.uint64(0))
                hashes = min_hashes(values, begin)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(n.astype(np.int64)), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), _long_lists(band_keys(hashes)), _long_lists(odd_sketches(hashes))],
                    names=["id", "n_shingles", "d1", "d2", "keys", "sketch"],
                )

    kind = dict(docs.dtypes)["id"]
    return docs.mapInArrow(lean(each), f"id {kind}, n_shingles long, d1 long, d2 long, keys array<long>, sketch array<long>")


def confirmed(pairs: DataFrame, docs: DataFrame, percent: int, name: str) -> DataFrame:
    """The pairs (a, b) of ids, of a stored table, whose full shingle sets have 100 * intersection >= percent * union.

    Pairs meet their texts in blocks: ids that pairs connect are dealt into blocks of about BLOCK, and each text is sent once to each pair of blocks that has
    pairs of it, instead of once to each pair."""
    groups = components(pairs, f"{name}-near")
    sizes = groups.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = groups.join(sizes, "component").select("id", "component", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"))
    of = lambda x: placed.select(F.col("id").alias(x), F.col("block").alias(f"block_{x}"), *(["component"] if x == "a" else []))
    keyed = pairs.join(of("a"), "a").join(of("b"), "b").select("component", F.least("block_a", "block_b").alias("i"), F.greatest("block_a", "block_b").alias("j"), "a", "b")
    keyed = stored(keyed, f"{name}-keyed")
    need = keyed.select("component", "i", "j", F.explode(F.array("a", "b")).alias("id")).distinct()
    texts = _of_ids(docs, keyed.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    rows = need.join(texts, "id").select("component", "i", "j", F.lit(0).alias("kind"), F.col("id").alias("a"), F.col("id").alias("b"), "text")
    rows = rows.union(keyed.select("component", "i", "j", F.lit(1), "a", "b", F.lit(None).cast("string")))
    rows = rows.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "kind", "a")

    def checked(texts: pa.Table, pairs: pa.Table) -> pa.RecordBatch:
        """Pairs of one key that are alike enough."""
        at: dict = {}
        sets = []
        for k, x in enumerate(texts.column("a").to_pylist()):
            at.setdefault(x, k)
        for _, _, values, begin in shingle_sets(texts.column("text")):
            sets += [values[s:e] for s, e in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]
        size = np.array([len(x) for x in sets])
        _, dense = np.unique(np.concatenate(sets), return_inverse=True)
        begin = np.concatenate([[0], np.cumsum(size)])
        mark = np.zeros(int(dense.max(initial=-1)) + 2, np.int32)
        left = np.array([at[x] for x in pairs.column("a").to_pylist()])
        right = np.array([at[x] for x in pairs.column("b").to_pylist()])
        good = np.zeros(len(left), bool)
        order = np.argsort(left, kind="stable")
        cuts = np.flatnonzero(np.diff(left[order])) + 1
        for some in np.split(order, cuts):
            own = dense[begin[left[some[0]]] : begin[left[some[0]] + 1]]
            mark[own] = 1
            for k in some.tolist():
                common = int(mark[dense[begin[right[k]] : begin[right[k] + 1]]].sum())
                good[k] = common > 0 and 100 * common >= percent * (len(own) + int(size[right[k]]) - common)
            mark[own] = 0
        return pa.RecordBatch.from_arrays([pairs.column(c).combine_chunks().filter(pa.array(good)) for c in "ab"], names=["a", "b"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in by_key(batches, ("component", "i", "j")):
            is_pair = group.column("kind").to_numpy() == 1
            if is_pair.any():
                first = int(is_pair.argmax())
                yield checked(group.slice(0, first), group.slice(first))

    kind = dict(docs.dtypes)["id"]
    return rows.mapInArrow(lean(each), f"a {kind}, b {kind}")


def by_key(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """The rows of each key, of batches that are sorted by it. Holds one key's rows and one batch."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not len(batch):
            continue
        codes = [batch.column(k).dictionary_encode().indices.to_numpy(zero_copy_only=False) for k in keys]
        cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in codes], axis=0)) + 1
        begin = [0, *cuts.tolist(), len(batch)]
        for s, e in zip(begin[:-1], begin[1:], strict=True):
            key = tuple(batch.column(k)[s].as_py() for k in keys)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(s, e - s))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _of_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs of some ids. The ids are broadcast if they are few, counted first; else both sides are shuffled."""
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "id", "left_semi")


def components(edges: DataFrame, name: str) -> DataFrame:
    """edges: a, b. Returns id, component (the smallest id reachable) for every id that has an edge.

    Each round points every vertex to its smallest neighbour, follows the pointers to their ends, doubling the steps, and contracts the edges to these ends, until none is
    left. So a path of n edges takes about log2(n) doublings, in one round if its ids ascend."""
    edges = stored(edges.where("a <> b").distinct(), f"{name}-edges")
    found = None
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        step = stored(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("component")), f"{name}-step")
        while True:
            up = step.where("id <> component").select(F.col("id").alias("component"), F.col("component").alias("next"))
            if step.join(up, "component", "left_semi").isEmpty():
                break
            step = stored(step.join(up, "component", "left").select("id", F.coalesce("next", "component").alias("component")), f"{name}-step")
        if found is None:
            found = step
        else:
            on = step.select(F.col("id").alias("component"), F.col("component").alias("next"))
            found = stored(found.join(on, "component", "left").select("id", F.coalesce("next", "component").alias("component")), f"{name}-found")
        to_a, to_b = (step.select(F.col("id").alias(x), F.col("component").alias(f"{x}2")) for x in "ab")
        edges = stored(edges.join(to_a, "a").join(to_b, "b").where("a2 <> b2").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct(), f"{name}-edges")
    if found is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return found


def _differing(x: str, y: str) -> str:
    return f"aggregate(zip_with({x}, {y}, (p, q) -> bit_count(p ^ q)), 0, (s, v) -> s + v)"


def _across(members: DataFrame, most: int) -> DataFrame:
    """members: key, n, id, component, sketch, of buckets that hold several components. Returns the pairs of ids of one bucket in different
    components whose sketches differ in up to most bits. Blocks of a bucket meet pair by pair; no bucket lands in one task as a whole."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    block = F.pmod(F.xxhash64("id"), blocks).cast("int")
    dealt = (
        members.withColumn("blocks", blocks)
        .withColumn("own", block)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "component", "sketch")
    )
    parts = dealt.repartition(F.col("key"), F.col("i"), F.col("j")).sortWithinPartitions("key", "i", "j")
    kind = dict(members.dtypes)["id"]

    def compared(group: pa.Table) -> pa.RecordBatch:
        i = group.column("i")[0].as_py()
        own = group.column("own").to_numpy()
        comp = pa.compute.rank(group.column("component").combine_chunks(), tiebreaker="min").to_numpy()
        sketch = group.column("sketch").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(group), -1)
        rows = np.flatnonzero(own == i) if group.column("j")[0].as_py() != i else np.arange(len(group))
        left, right = [], []
        for r in rows.tolist():
            if group.column("j")[0].as_py() == i:
                rest = np.arange(r + 1, len(group))
            else:
                rest = np.flatnonzero(own != i)
            rest = rest[comp[rest] != comp[r]]
            if len(rest):
                near = rest[np.bitwise_count(sketch[rest] ^ sketch[r]).sum(axis=1) <= most]
                left += [r] * len(near)
                right += near.tolist()
        ids = group.column("id").combine_chunks()
        a, b = ids.take(pa.array(left, pa.int64())), ids.take(pa.array(right, pa.int64()))
        swap = pa.compute.greater(a, b)
        return pa.RecordBatch.from_arrays([pa.compute.if_else(swap, b, a), pa.compute.if_else(swap, a, b)], names=["a", "b"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in by_key(batches, ("key", "i", "j")):
            yield compared(group)

    return parts.mapInArrow(lean(each), f"a {kind}, b {kind}").distinct()


def near_duplicates(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, n_shingles long, component_id (the smallest id of its group), kept boolean (it is that id).

    percent: the least similarity, 100 * intersection / union of the shingle sets. See the module's notes for the defined cases."""
    arrow_batches(docs.sparkSession)
    own = with_own_names(docs, id=id_col, text=text_col)
    most = most_differing_bits(percent / 100)
    sigs = stored(signatures(own), "signatures")
    alike = ["n_shingles", "d1", "d2"]
    reps = stored(sigs.where("n_shingles > 0").groupBy(*alike).agg(F.min("id").alias("rep")), "representatives")
    lone = sigs.where("n_shingles > 0").join(reps.select(*alike, F.col("rep").alias("id")), [*alike, "id"], "left_semi").dropDuplicates(["id"])
    lone = stored(lone.select("id", "keys", "sketch"), "distinct")
    rows = lone.select("id", F.explode("keys").alias("key"))
    pivots = rows.groupBy("key").agg(F.min("id").alias("a"), F.count("*").alias("n")).where("n > 1")
    pivots = stored(pivots, "pivots")
    in_buckets = rows.join(pivots, "key")
    pairs = in_buckets.where("a < id").select("a", F.col("id").alias("b")).distinct()
    side = lambda x: lone.select(F.col("id").alias(x), F.col("sketch").alias(f"sketch_{x}"))
    near = pairs.join(side("a"), "a").join(side("b"), "b").where(f"{_differing('sketch_a', 'sketch_b')} <= {most}").select("a", "b")
    near = stored(near, "pairs")
    links = stored(confirmed(near, own, percent, "pivots"), "links")
    groups = components(links, "groups")

    named = F.coalesce("component", "id")
    members = in_buckets.join(groups, "id", "left").select("key", "n", "id", named.alias("component"))
    split = members.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least < most").select("key")
    rest = members.join(split, "key", "left_semi").join(lone.select("id", "sketch"), "id")
    more = stored(_across(rest, most).join(near, ["a", "b"], "left_anti"), "pairs-across")
    links = links.union(confirmed(more, own, percent, "across"))
    groups = stored(components(links, "all-groups"), "components")

    of_rep = reps.join(groups.withColumnRenamed("id", "rep"), "rep", "left").select(*alike, F.coalesce("component", "rep").alias("component_id"))
    out = sigs.select("id", *alike).join(of_rep, alike, "left")
    group = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), "n_shingles", group.alias("component_id"), F.coalesce(F.col("id") == group, F.lit(False)).alias("kept"))
