"""Document fingerprints from content-defined chunks.

A gear hash over the last 16 bytes marks boundaries, normalised so that sizes gather near 32 bytes: a chunk takes at least 16;
up to 32 it ends where six bits of the hash are zero, from there where three are, and at 96 at the latest. Boundaries
follow from the content alone, so an insertion moves only the chunks around it. A fingerprint is the set of the chunks'
digests (40 bits) with their lengths in bytes. The likeness of two is containment: the bytes of shared chunks over those of the
smaller set.

Defined cases: a null or empty text has an empty fingerprint; two such are alike at 1, and 0 against any other. Equal texts have
equal fingerprints. Very long texts are chunked whole. Rows that repeat an id follow one another, ordered by text. A null id comes last. A single row is
its own next document. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import arrow_batches, lean, with_own_names
from ._text import spans_hash, text_slices

LEAST, NORMAL, MOST = 16, 32, 96
_GEAR = np.random.default_rng(11).integers(0, 1 << 32, 256, dtype=np.uint32)
_STRICT, _LOOSE = np.uint32(0b111111 << 26), np.uint32(0b111 << 29)
Print = tuple[np.ndarray, np.ndarray]


def _next_cuts(data: np.ndarray) -> np.ndarray:
    """For a chunk that begins at each byte, where it ends (maybe beyond the text)."""
    n = len(data)
    gear = _GEAR[data]
    for k in (1, 2, 4, 8):  # each byte moves the hash by two bits, so 16 bytes count
        gear[k:] += gear[:-k] << np.uint32(2 * k)
    none = np.iinfo(np.int32).max

    def following(mask: np.uint32) -> np.ndarray:
        at = np.where(gear & mask == 0, np.arange(1, n + 1, dtype=np.int32), none)
        return np.minimum.accumulate(at[::-1])[::-1]

    begin = np.arange(n, dtype=np.int32)
    out = begin + MOST
    for mask, least, most in ((_LOOSE, NORMAL, MOST), (_STRICT, LEAST, NORMAL)):
        cut = np.full(n, none, np.int32)
        cut[: max(0, n - least + 1)] = following(mask)[least - 1 :]
        out = np.where(cut < begin + most, cut, out)
    return out


def prints(column: pa.Array) -> list[Print]:
    """Sorted distinct chunk digests and the chunks' lengths, for each text."""
    out: list[Print] = []
    for _, _, data, offsets in text_slices(column):
        cuts = memoryview(_next_cuts(data)) if len(data) else None
        starts: list[int] = []
        ends: list[int] = []
        first = [0]
        for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            while s < e:
                starts.append(s)
                s = cuts[s]
                ends.append(s if s < e else e)
            first.append(len(starts))
        begin, end = np.array(starts, np.int64), np.array(ends, np.int64)
        digest = spans_hash(data, begin, end, fold=False) >> np.uint64(24) if len(begin) else np.zeros(0, np.uint64)
        size = end - begin
        for a, b in zip(first[:-1], first[1:], strict=True):
            own, at = np.unique(digest[a:b], return_index=True)
            out.append((own, size[a:b][at]))
    return out


def likeness(x: Print, y: Print) -> float:
    """Bytes of the chunks that both have over those of the smaller set."""
    if not len(x[0]) or not len(y[0]):
        return float(len(x[0]) == len(y[0]))
    if len(x[0]) > len(y[0]):
        x, y = y, x
    at = np.searchsorted(y[0], x[0])
    at[at == len(y[0])] = 0
    shared = x[1][y[0][at] == x[0]].sum()
    return min(1.0, float(shared) / float(min(x[1].sum(), y[1].sum())))


def as_string(x: Print) -> str:
    """Base64 of six bytes for each chunk: its digest, and its length."""
    packed = (x[0] << np.uint64(8) | x[1].astype(np.uint64)).astype("<u8")
    return base64.b64encode(packed.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()).decode()


def from_string(text: str) -> Print:
    """The inverse of as_string()."""
    packed = np.zeros((len(text) * 3 // 4 // 6, 8), np.uint8)
    packed[:, :6] = np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1, 6)
    value = packed.reshape(-1).view("<u8")
    return value >> np.uint64(8), (value & np.uint64(255)).astype(np.int64)


def fingerprints(docs: DataFrame, text_col: str = "text", name: str = "fingerprint") -> DataFrame:
    """docs with a column of fingerprints more."""
    arrow_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def of(text: pd.Series) -> pd.Series:
        return pd.Series([as_string(x) for x in prints(pa.array(text.fillna(""), pa.string()))], dtype=object)

    return docs.withColumn(name, of(F.col(f"`{text_col}`")))


def with_next(docs: DataFrame) -> DataFrame:
    """docs: id (a whole number), text. Returns rows (part, extra, id, text), in which each row of docs is followed by the one of the next
    smaller id, in parts that lie sorted in one partition each. A part's last row is an extra one, the first of the part after it.

    Only ids are read to find the parts' limits, one number for each goes to the driver, and texts are moved once."""
    spark = docs.sparkSession
    n = 3 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.coalesce(F.col("id").cast("long"), F.lit(-(1 << 63)))
    keys = docs.select(key.alias("key"))
    cuts = keys.agg(F.percentile_approx("key", [i / n for i in range(1, n)], 20 * n).alias("cuts")).first()["cuts"]
    limits = np.unique(np.array(cuts or [], np.int64))

    @F.pandas_udf("int")
    def part(k: pd.Series) -> pd.Series:
        return pd.Series(len(limits) - np.searchsorted(limits, k.to_numpy(np.int64), "right"), dtype="int32")

    firsts = sorted(tuple(r) for r in keys.groupBy(part("key").alias("part")).agg(F.max("key")).collect())
    after = {r[1]: firsts[i - 1][0] if i else firsts[-1][0] for i, r in enumerate(firsts)}
    rows = docs.select(part(key).alias("part"), F.lit(0).alias("extra"), "id", F.coalesce("text", F.lit("")).alias("text"))
    if not after:
        return rows
    heads = docs.where(key.isin([int(k) for k in after])) if len(after) < 2000 else docs.join(F.broadcast(spark.createDataFrame([(int(k),) for k in after], "head long")), key == F.col("head"), "left_semi")
    before = spark.createDataFrame([(int(k), int(p)) for k, p in after.items()], "head long, part int")
    text = F.coalesce("text", F.lit(""))
    extra = heads.groupBy(key.alias("head")).agg(F.max("id").alias("id"), F.min(text).alias("text")).join(F.broadcast(before), "head").select("part", F.lit(1).alias("extra"), "id", "text")
    return rows.union(extra).repartition("part").sortWithinPartitions("part", "extra", F.desc_nulls_last("id"), "text")


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by the beginning of another."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def compared_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. The next document is
    that of the next smaller id (after the smallest: the largest). See the module's notes for the defined cases."""
    arrow_batches(docs.sparkSession)
    own = with_own_names(docs, id=id_col, text=text_col)
    names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch]).combine_chunks() if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])]).combine_chunks()
            held = table.slice(len(table) - 1)
            texts = table.column("text").to_pylist()
            own = prints(table.column("text").combine_chunks())
            rows = [i for i, x in enumerate(table.column("extra").to_pylist()[:-1]) if not x]
            changed = [edited(texts[i], texts[i + 1]) for i in rows]
            other = prints(pa.array(changed, pa.string()))
            yield pa.RecordBatch.from_arrays(
                [
                    table.column("id").combine_chunks().take(pa.array(rows, pa.int64())),
                    pa.array([len(texts[i]) for i in rows], pa.int64()),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in changed], pa.string()),
                    pa.array([as_string(own[i]) for i in rows], pa.string()),
                    pa.array(map(as_string, other), pa.string()),
                    pa.array([likeness(own[i], x) for i, x in zip(rows, other, strict=True)], pa.float64()),
                    pa.array([likeness(own[i], own[i + 1]) for i in rows], pa.float64()),
                ],
                names=names,
            )

    kind = dict(own.dtypes)["id"]
    return with_next(own).mapInArrow(lean(each), f"`{id_col}` {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
