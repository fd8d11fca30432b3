"""Quality scores by co-training a text view and a metadata view.

The text view sees shares of kinds of characters and statistics of words and lines; the metadata view sees the other columns (language,
source, length), hashed. Each has a logistic model, fitted first on labelled documents. In every round each view scores the pool: all
documents without a label that aren't held out, equal ones (by all features) once. The view passes on pseudo-labels for the tenth of the pool that it is surest of, good and bad ones in the
labels' proportion. Sureness is relative: log-odds count from those of the labels' proportion, and the limits are quantiles of the view's own scores, so
either view passes on either label. Documents of which the other view is as sure the other way are left out, and those passed on leave the pool.
They join the other view's training set. At last each view is calibrated on labelled documents that none was fitted on, and a logistic model over both calibrated log-odds, from
the same documents, scores all documents.

At most about TRAIN_ROWS labelled documents, and about ADDED pseudo-labelled ones for each view, label and round (picked by a hash of the id out of all that are sure enough), reach the driver, as
short rows of features. Scores cover every document. Held-out rows (crc32 of the id mod 5 is 0) are never learned from, with a label or without.

Defined cases: null and empty texts and null metadata have features of their own (zeros, and the bucket of null). Rows that repeat an id are scored each; if
labels repeat an id, the higher one wins. Documents whose scores tie at a limit are all sure enough. Without labels of both kinds every document scores the share of good labels (0.5 with none). Very
long texts are measured whole. Extra columns are ignored, whatever their names, or kept by kept_documents().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import arrow_batches, lean, stored, unused, with_own_names
from ._text import WORD, spans_hash, text_slices, words
from .toxicity import _logistic, held_out

TRAIN_ROWS, ROUNDS, ADDED, SHARE, BUCKETS = 20_000, 3, 3_000, 0.1, 64
_KIND = np.full(256, 9, np.uint8)
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 0, 1, 2, 3
_KIND[[32, 9]], _KIND[10] = 4, 5
_PUNCTUATION = ".,;:!?\"'()[]{}<>|#$%&*@~^_=+-/\\`"
for _i, _c in enumerate(_PUNCTUATION):
    _KIND[ord(_c)] = 10 + _i
KINDS = 10 + len(_PUNCTUATION)
TEXT_FEATURES = 2 * KINDS + 8


def text_features(column: pa.Array) -> np.ndarray:
    """A row of features for each text."""
    out = []
    for _, _, data, offsets in text_slices(column):
        n = len(offsets) - 1
        size = np.maximum(1, np.diff(offsets))
        row = np.repeat(np.arange(n), np.diff(offsets))
        share = np.bincount(row * KINDS + _KIND[data], minlength=n * KINDS).reshape(n, KINDS) / size[:, None]
        starts, ends, first = words(data, offsets, WORD)
        count = np.diff(first)
        safe = np.maximum(1, count)
        h = spans_hash(data, starts, ends)
        owner = np.repeat(np.arange(n), count)
        order = np.lexsort((h, owner))
        new = np.ones(len(h), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (owner[order][1:] != owner[order][:-1])
        runs = np.diff(np.concatenate([np.flatnonzero(new), [len(h)]]))
        distinct = np.bincount(owner[order][new], minlength=n)
        most = np.zeros(n)
        np.maximum.at(most, owner[order][new], runs)
        length = np.bincount(owner, ends - starts, n) / safe
        last = data[ends - 1] if len(ends) else np.zeros(0, np.uint8)
        marked = np.bincount(owner, _KIND[last] >= 10, n) / safe
        feeds = np.bincount(row, data == 10, n)
        stats = np.column_stack([np.log1p(size), np.log1p(count), length / 10, distinct / safe, most / safe, marked, np.log1p(count / (feeds + 1)), np.diff(offsets) > 0])
        out.append(np.hstack([share, np.sqrt(share), stats]))
    return np.vstack(out) if out else np.zeros((0, TEXT_FEATURES))


def meta_features(columns: list[np.ndarray]) -> np.ndarray:
    """One-hot buckets of hashed values, and numbers as logarithms."""
    n = len(columns[0])
    out = [np.ones((n, 1))]
    for c in columns:
        if c.dtype.kind == "f":
            known = ~np.isnan(c)
            value = np.log1p(np.abs(np.where(known, c, 0)))
            out.append(np.column_stack([known, value, value**2 / 10]))
        else:
            hot = np.zeros((n, BUCKETS))
            hot[np.arange(n), c.astype(np.int64)] = 1
            out.append(hot)
    return np.hstack(out)


def _features(docs: DataFrame, meta: list[str]) -> DataFrame:
    """docs: id, text, and the metadata. Returns id, x (text features), the metadata as buckets or doubles, and h, a hash of all of these but the id."""
    numbers = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    columns = [F.col(m).cast("double").alias(m) if dict(docs.dtypes)[m] in numbers else F.coalesce(F.pmod(F.xxhash64(F.col(m).cast("string")), F.lit(BUCKETS - 1)), F.lit(BUCKETS - 1)).cast("int").alias(m) for m in meta]
    own = docs.select("id", "text", *columns)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = text_features(batch.column(1)).astype(np.float32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * TEXT_FEATURES), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, *batch.columns[2:]], names=["id", "x", *meta])

    kinds = dict(own.dtypes)
    return own.mapInArrow(lean(each), ", ".join([f"id {kinds['id']}", "x array<float>", *(f"{m} {kinds[m]}" for m in meta)])).withColumn("h", F.xxhash64("x", *meta))


def _views(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Both views' features of a batch of rows id, x, metadata, h."""
    x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(batch), TEXT_FEATURES)
    return x, meta_features([c.to_numpy(zero_copy_only=False) for c in batch.columns[2 : batch.schema.get_field_index("h")]])


class View:
    """A logistic model over standardised features, and its calibration."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        self.weights = _logistic((x - self.mean) / self.scale, y)
        self.slope, self.shift = 1.0, 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale @ self.weights[:-1] + self.weights[-1], -30, 30)

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        if 0 < y.sum() < len(y):
            self.slope, self.shift = _logistic(self.raw(x)[:, None], y)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.raw(x) * self.slope + self.shift, -15, 15)


class Round:
    """The views of a round, and how sure each must be: limits[view] holds the log-odds up to which documents are bad and those from which they are good."""

    def __init__(self, views: list[View], prior: float):
        self.views, self.prior, self.limits = views, prior, []

    def log_odds(self, batch: pa.RecordBatch) -> np.ndarray:
        """A column for each view; 0 is what the labels' proportion says."""
        return np.column_stack([v.raw(x) - self.prior for v, x in zip(self.views, _views(batch), strict=True)])

    def passed(self, batch: pa.RecordBatch) -> np.ndarray:
        """A column for each view: 1 where it passes the row on as good, -1 as bad, else 0."""
        z = self.log_odds(batch)
        sure = np.column_stack([np.where((own > 0) & (own >= high), 1, np.where((own < 0) & (own <= low), -1, 0)) for own, (low, high) in zip(z.T, self.limits, strict=True)])
        sure[sure[:, 0] * sure[:, 1] < 0] = 0
        return sure


def _rest(before: list[Round], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows that no earlier round has passed on."""
    for batch in batches:
        keep = np.ones(len(batch), bool)
        for r in before:
            keep &= ~r.passed(batch).any(axis=1)
        yield batch.filter(pa.array(keep))


def _limited(pool: DataFrame, before: list[Round], now: Round, share_good: float) -> None:
    """Sets the limits of a round from the quantiles of its views' scores over the rest of the pool."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _rest(before, batches):
            z = now.log_odds(batch)
            yield pa.RecordBatch.from_arrays([pa.array(z[:, 0]), pa.array(z[:, 1])], names=["z0", "z1"])

    parts = F.array(F.lit(SHARE * (1 - share_good)), F.lit(1 - SHARE * share_good))
    row = pool.mapInArrow(lean(each), "z0 double, z1 double").agg(*[F.percentile_approx(z, parts, 10_000) for z in ("z0", "z1")]).first()
    now.limits = [tuple(x) if x else (-np.inf, np.inf) for x in row]


def _passed(pool: DataFrame, before: list[Round], now: Round, added: int) -> tuple[dict[tuple[int, int], int], pa.Table]:
    """How many rows each view passes on with each label (1, -1), and up to about added of them, by a hash of the id, with both columns of passed() more."""
    names = pool.columns

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _rest(before, batches):
            sure = now.passed(batch).astype(np.int32)
            keep = pa.array(sure.any(axis=1))
            yield pa.RecordBatch.from_arrays([*(c.filter(keep) for c in batch.columns), *(pa.array(np.ascontiguousarray(c)).filter(keep) for c in sure.T)], names=[*names, "p0", "p1"])

    found = pool.mapInArrow(lean(each), ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in pool.schema), "p0 int", "p1 int"]))
    counts = found.agg(*[F.count_if(F.col(f"p{v}") == g) for v in (0, 1) for g in (1, -1)]).first()
    total = {(v, g): n for (v, g), n in zip(((v, g) for v in (0, 1) for g in (1, -1)), counts, strict=True)}
    at = F.pmod(F.xxhash64("id"), F.lit(1 << 20))
    part = {k: int((1 << 20) * min(1, added / max(1, n))) for k, n in total.items()}
    wanted = [(F.col(f"p{v}") == g) & (at < part[v, g]) for v, g in total]
    return total, found.where(wanted[0] | wanted[1] | wanted[2] | wanted[3]).orderBy("h").toArrow().combine_chunks()


class QualityModel:
    """Both calibrated views and the weights that join them; or a constant."""

    def __init__(self, views: list[View], weights: np.ndarray, rounds: list[dict] = ()):
        """rounds: for each round, by view and label (1, -1), the number of documents passed on and the ids of those that were learned from."""
        self.views, self.weights, self.rounds = views, weights, rounds

    def __getstate__(self) -> dict:
        return self.__dict__ | {"rounds": []}

    def scores(self, batch: pa.RecordBatch) -> np.ndarray:
        z = [v.log_odds(x) for v, x in zip(self.views, _views(batch), strict=True)] if self.views else [np.zeros(len(batch))] * 2
        return 1 / (1 + np.exp(-np.clip(np.column_stack(z) @ self.weights[:-1] + self.weights[-1], -30, 30)))


def fitted(rows: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, added: int = ADDED) -> QualityModel:
    """rows: _features(); labels: id, y. Co-trains on up to about train_rows labelled rows that aren't held out, and on all rows without a label that aren't."""
    every = labels.where("id is not null and y is not null")
    known = every.where(~held_out(F.col("id"))).groupBy("id").agg(F.max("y").cast("int").alias("y"))
    n = known.count()
    if n > train_rows:
        known = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int((1 << 20) * train_rows / n))
    # an id may come up in any number of rows; equal ones count once
    got = rows.join(F.broadcast(known), "id").groupBy("id", "h", "y").agg(*[F.first(c).alias(c) for c in rows.columns if c not in ("id", "h")])
    got = got.withColumn("fold", F.crc32(F.col("id").cast("string")) % 5).select(*rows.columns, "y", "fold").orderBy("h", "id").toArrow().combine_chunks()
    y = got.column("y").to_numpy().astype(float)
    constant = np.array([0, 0, np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))])
    if not 0 < y.sum() < len(y):
        return QualityModel([], constant)
    both = _views(got.select(rows.columns).to_batches()[0])
    apart = got.column("fold").to_numpy() == 1
    if not 0 < y[~apart].sum() < (~apart).sum():
        return QualityModel([], constant)
    share = float(y[~apart].mean())
    prior = float(np.log(share / (1 - share)))
    free = rows.where("id is not null").where(~held_out(F.col("id"))).join(every.select("id").distinct(), "id", "left_anti")
    least = free.groupBy("h").agg(F.min(F.struct(*[c for c in rows.columns if c != "h"])).alias("r"))
    pool = stored(least.select("r.*", "h").select(*rows.columns), "pool")
    sets = [[x[~apart]] for x in both], [[y[~apart]], [y[~apart]]]
    views, before, report = [View(x[~apart], y[~apart]) for x in both], [], []
    for _ in range(ROUNDS):
        now = Round(views, prior)
        _limited(pool, before, now, share)
        total, table = _passed(pool, before, now, added)
        report.append({})
        if len(table):
            new = _views(table.select(rows.columns).to_batches()[0])
            for view in (0, 1):
                sure = table.column(f"p{view}").to_numpy()
                sets[0][1 - view].append(new[1 - view][sure != 0])
                sets[1][1 - view].append((sure[sure != 0] > 0).astype(float))
                report[-1] |= {(view, g): (total[view, g], table.column("id").filter(pa.array(sure == g)).to_pylist()) for g in (1, -1)}
        before = [*before, now]
        views = [View(np.vstack(x), np.concatenate(t)) for x, t in zip(*sets, strict=True)]
    for v, x in zip(views, both, strict=True):
        v.calibrate(x[apart], y[apart])
    joined = np.column_stack([v.log_odds(x[apart]) for v, x in zip(views, both, strict=True)])
    weights = _logistic(joined, y[apart]) if 0 < y[apart].sum() < apart.sum() else np.array([1.0, 0.0, 0.0])
    return QualityModel(views, weights, report)


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", meta_cols: tuple[str, ...] = ("lang", "source", "n_chars")) -> DataFrame:
    """One row for each row of docs: id, held_out boolean, score double (higher: better), predicted int (1 from 0.5)."""
    arrow_batches(docs.sparkSession)
    meta = {f"m{i}": c for i, c in enumerate(meta_cols)}
    rows = stored(_features(with_own_names(docs, id=id_col, text=text_col, **meta), list(meta)), "features")
    model = fitted(rows, with_own_names(labels, id=id_col, y=label_col))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(batch))], names=["id", "score"])

    out = rows.mapInArrow(lean(each), f"id {dict(rows.dtypes)['id']}, score double")
    return out.select(F.col("id").alias(id_col), F.coalesce(held_out(F.col("id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def kept_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", meta_cols: tuple[str, ...] = ("lang", "source", "n_chars")) -> DataFrame:
    """The rows of docs, with all columns, that score 0.5 or more."""
    low = quality(docs, labels, id_col, text_col, label_col, meta_cols).where("predicted = 0").select(F.col(f"`{id_col}`").alias(name := unused(docs, "low"))).distinct()
    return docs.join(low, F.col(f"`{id_col}`") == F.col(name), "left_anti")
