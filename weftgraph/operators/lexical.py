"""Lexical retrieval: set and multiset Jaccard scores of chunks against a query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import jaccard, tokens


def multiset_jaccard(a: Column, b: Column) -> Column:
    """Sum of the smaller counts over sum of the larger; 0 if both are empty. Only tokens of a, the query, can add to the former."""
    count = lambda c, w: F.size(c) - F.size(F.array_remove(c, w))
    low = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda s, w: s + F.least(count(a, w), count(b, w)))
    high = F.size(a) + F.size(b) - low
    return F.when(high > 0, low / high).otherwise(0.0)


def search(chunks: DataFrame, query: str, k: int = 10, scorer: Callable[[Column, Column], Column] = jaccard, tokenizer: Callable[[Column], Column] = tokens, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """The k chunks of the highest score, ties by id; chunks without tokens are left out. Scorer and tokenizer are functions of Columns.
    The query is cut into tokens once, not for every chunk."""
    own = chunks.sparkSession.range(1).select(tokenizer(F.lit(query))).first()[0] or []
    words = F.array(*[F.lit(w) for w in own]).cast("array<string>")
    found = chunks.withColumn("__tokens", tokenizer(F.col(text_col))).where(F.size("__tokens") > 0)
    scored = found.withColumn("score", F.coalesce(scorer(words, F.col("__tokens")), F.lit(0.0))).drop("__tokens")
    return scored.orderBy(F.desc("score"), id_col).limit(k)
