"""Vector search and what ranks by it. Distances are small, similarities large, for near vectors; ties go by id."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V


def literal_vector(values: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def nearest(vectors: DataFrame, query: list[float], k: int | None = 15, metric: str = "l2", normalised: bool = False) -> DataFrame:
    """The k nearest vectors (all if k is None, none if k is 0 or less): the columns and distance. vectors: id, vector, ..."""
    q = literal_vector(query)
    v = V.as_doubles(F.col("vector"))
    found = vectors.withColumn("distance", V.l2_squared(v, q) if metric == "l2" else 1 - V.cosine_similarity(v, q))
    if k is not None:
        found = found.orderBy("distance", "id").limit(max(0, k))
    return found.withColumn("distance", V.min_max_normalised(F.col("distance"))) if normalised else found


def most_similar(vectors: DataFrame, query: list[float], k: int = 10, threshold: float | None = None, types: list[str] | None = None) -> DataFrame:
    """The k vectors of the highest cosine similarity, of some types, from a threshold on: the columns and similarity."""
    if types is not None:
        vectors = vectors.where(F.col("type").isin(types))
    found = vectors.withColumn("similarity", V.cosine_similarity(V.as_doubles(F.col("vector")), literal_vector(query)))
    if threshold is not None:
        found = found.where(F.col("similarity") >= threshold)
    return found.orderBy(F.desc("similarity"), "id").limit(k)


#: Similarities that a task holds at once, and by how much those of the screening may differ from exact ones.
CELLS, SLACK = 2_000_000, 1e-9


def _norms(x: np.ndarray) -> np.ndarray:
    """Sums of squares, added up in the order of the elements."""
    out = np.zeros(len(x))
    for j in range(x.shape[1]):
        out += x[:, j] * x[:, j]
    return out


def _by_size(vectors: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Rows by the length of their vectors, with the vectors as a matrix. Rows whose vector is null, holds a null or has no length are under -1."""
    offsets, flat = vectors.offsets.to_numpy().astype(np.int64), vectors.values
    sizes = np.where(np.asarray(vectors.is_valid()), np.diff(offsets), -1)
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    missing = np.append(0, np.cumsum(np.asarray(flat.is_null())))
    sizes[missing[offsets[1:]] > missing[offsets[:-1]]] = -1
    out, without = {}, [np.flatnonzero(sizes <= 0)]
    for size in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == size)
        x = values[offsets[rows][:, None] + np.arange(size)]
        empty = _norms(x) == 0
        without.append(rows[empty])
        out[size] = rows[~empty], x[~empty]
    return out | {-1: (np.concatenate(without), np.zeros((sum(map(len, without)), 0)))}


def _first(query: np.ndarray, key: np.ndarray, ids: pa.Array, k: int) -> np.ndarray:
    """Places of each query's first k by falling key, then id; in order."""
    order = np.lexsort((pc.rank(ids, "ascending", null_placement="at_start", tiebreaker="dense").to_numpy(), -key, query))
    q = query[order]
    return order[np.arange(len(q)) - np.searchsorted(q, q) < k]


def _best(sent, k: int):
    """Over rows id, vector: for each query its k best of the partition by similarity, then id. Products of matrices find which may be among them; these are computed in the order of elements."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, query_vectors = sent.value
        by_size = _by_size(query_vectors)
        held = {size: None for size in by_size}  # query, key, ids
        least = dict.fromkeys(by_size, np.full(len(queries), -np.inf))
        low: dict[int, pa.Array] = {}  # the first ids by length of vectors, for queries that too few vectors have a similarity with
        with np.errstate(all="ignore"):
            squares = {size: _norms(x) for size, (_, x) in by_size.items()}
            units = {size: x / np.sqrt(squares[size])[:, None] for size, (_, x) in by_size.items()}
            for batch in batches:
                ids = batch.column(0)
                for size, (rows, x) in _by_size(batch.column(1)).items():
                    some = pa.concat_arrays([low[size], ids.take(rows)]) if size in low else ids.take(rows)
                    low[size] = some.take(_first(np.zeros(len(some), int), np.zeros(len(some)), some, k))
                    if size < 0 or size not in by_size or not len(by_size[size][0]):
                        continue
                    q, n_q = by_size[size][1], len(by_size[size][0])
                    square, step = _norms(x), max(1, CELLS // n_q)
                    x_units = x / np.sqrt(square)[:, None]
                    limit = least[size][:n_q].copy()
                    pending, n_pending = [] if held[size] is None else [held[size]], 0

                    def pruned(parts, size=size, limit=limit):
                        query, key = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
                        own = pa.concat_arrays([p[2] for p in parts])
                        keep = _first(query, key, own, k)
                        query, key, own = query[keep], key[keep], own.take(keep)
                        full = np.flatnonzero(np.arange(len(query)) - np.searchsorted(query, query) == k - 1)
                        limit[query[full]] = key[full]
                        return query, key, own

                    for lo in range(0, len(x), step):
                        s = units[size] @ x_units[lo : lo + step].T
                        s[np.isnan(s)] = np.inf
                        bar = limit
                        if s.shape[1] > k and np.isneginf(limit).any():
                            bar = np.maximum(limit, np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k])
                        qi, vi = np.nonzero(s >= (bar - SLACK)[:, None])
                        if not len(qi):
                            continue
                        vi += lo
                        dot = np.zeros(len(qi))
                        for j in range(size):
                            dot += q[qi, j] * x[vi, j]
                        key = np.clip(dot / np.sqrt(squares[size][qi] * square[vi]), -1.0, 1.0)
                        pending.append((qi, np.where(np.isnan(key), np.inf, key), ids.take(rows[vi])))
                        n_pending += len(qi)
                        if n_pending > n_q * k:
                            pending, n_pending = [pruned(pending)], 0
                    if pending:
                        held[size] = pruned(pending)
                        least[size] = limit
        for size, (rows, _) in by_size.items():
            query, key, found = held[size] if held[size] is not None else (np.zeros(0, int), np.zeros(0), None)
            if found is not None:
                yield pa.RecordBatch.from_arrays([queries.take(rows[query]), found, pa.array(np.where(np.isinf(key), np.nan, key))], names=["query", "id", "similarity"])
            others = [v for n, v in low.items() if n != size or size < 0]
            few = np.flatnonzero(np.bincount(query, minlength=len(rows)) < k)
            if others and len(few):
                rest = pa.concat_arrays(others)
                rest = rest.take(_first(np.zeros(len(rest), int), np.zeros(len(rest)), rest, k))
                yield pa.RecordBatch.from_arrays([queries.take(np.repeat(rows[few], len(rest))), rest.take(np.tile(np.arange(len(rest)), len(few))), pa.nulls(len(few) * len(rest), pa.float64())], names=["query", "id", "similarity"])

    return each


def batch_nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, max_queries: int = 10_000) -> DataFrame:
    """The k nearest vectors of each query: query, id, similarity, rank. queries: id, vector. They are counted, dealt into blocks of about max_queries and sent block by block, so that
    every vector is read once for each block and only each task's best reach the final ranking. A similarity is null, and last, if a vector is null, holds a null, has no length or
    another number of elements than the query."""
    sc = vectors.sparkSession.sparkContext
    blocks = max(1, -(-queries.count() // max_queries))
    plain = lambda df: df.select("id", "vector" if dict(df.dtypes)["vector"] == "array<float>" else V.as_doubles(F.col("vector")).alias("vector"))
    rows = plain(vectors).repartition(3 * sc.defaultParallelism)
    schema = f"query {dict(queries.dtypes)['id']}, id {dict(vectors.dtypes)['id']}, similarity double"
    found = None
    for block in range(blocks):
        own = plain(queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block)).toArrow().combine_chunks()
        whole = lambda c, own=own: own.column(c).combine_chunks() if own.column(c).num_chunks != 1 else own.column(c).chunk(0)
        best = rows.mapInArrow(_best(sc.broadcast((whole("id"), whole("vector"))), k), schema)
        found = best if found is None else found.unionByName(best)
    order = Window.partitionBy("query").orderBy(F.desc("similarity"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def vector_of(vectors: DataFrame, entity) -> list[float]:
    """The vector of one entity; an error if there is none."""
    row = vectors.where(F.col("id") == entity).select(V.as_doubles(F.col("vector")).alias("v")).first()
    if row is None:
        raise KeyError(f"no vector of {entity!r}")
    return row["v"]


def similar_entities(vectors: DataFrame, entity, k: int = 10, threshold: float = 0.7, types: list[str] | None = None) -> DataFrame:
    """The nearest to an entity; the entity itself is taken out after the cut to k."""
    return most_similar(vectors, vector_of(vectors, entity), k, threshold, types).where(F.col("id") != entity)


def suggested_relations(vectors: DataFrame, entity, target_types: list[str], k: int = 5, factor: float = 0.8) -> DataFrame:
    """Candidates for a relation's other end, of the allowed types: id, similarity, confidence."""
    found = most_similar(vectors, vector_of(vectors, entity), 3 * k, None, target_types).where(F.col("id") != entity)
    return found.withColumn("confidence", F.col("similarity") * factor).orderBy(F.desc("similarity"), "id").limit(k)


def analogies(vectors: DataFrame, a, b, c, k: int = 5, threshold: float = 0.5, factor: float = 0.7) -> DataFrame:
    """What is to c as b is to a: the nearest to c + (b - a), without c."""
    va, vb, vc = (vector_of(vectors, x) for x in (a, b, c))
    target = [z + (y - x) for x, y, z in zip(va, vb, vc, strict=True)]
    return most_similar(vectors, target, k + 1, threshold).where(F.col("id") != c).withColumn("confidence", F.col("similarity") * factor).orderBy(F.desc("similarity"), "id").limit(k)


def inferred_types(vectors: DataFrame, entity, k: int = 3, neighbours: int = 50, threshold: float = 0.6) -> DataFrame:
    """Types of the nearest vectors by mean similarity: type, mean_similarity, n, examples (the first five ids)."""
    near = most_similar(vectors, vector_of(vectors, entity), neighbours, threshold).where(F.col("id") != entity)
    examples = F.slice(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("s"), "id"))), lambda x: x["id"]), 1, 5)
    return near.groupBy("type").agg(F.avg("similarity").alias("mean_similarity"), F.count("*").alias("n"), examples.alias("examples")).orderBy(F.desc("mean_similarity"), "type").limit(k)


def centrality(edges: DataFrame) -> DataFrame:
    """id, centrality: degree over the largest degree."""
    from .graph import degrees

    d = degrees(edges)
    return d.join(d.agg(F.max("degree").alias("most")), F.lit(True)).select("id", (F.col("degree") / F.col("most")).alias("centrality"))


def ranked(candidates: DataFrame, scores: DataFrame, vector_weight: float = 0.7, graph_weight: float = 0.3, k: int = 50) -> DataFrame:
    """Candidates (id, similarity) by the weighted sum of similarity and centrality, with an explanation."""
    total = vector_weight * F.col("similarity") + graph_weight * F.coalesce("centrality", F.lit(0.0))
    found = candidates.join(scores, "id", "left").withColumn("centrality", F.coalesce("centrality", F.lit(0.0))).withColumn("score", total)
    why = F.format_string("similarity %.2f | centrality %.2f | relevance %.2f", "similarity", "centrality", "score")
    return found.withColumn("explanation", why).orderBy(F.desc("score"), "id").limit(k)
