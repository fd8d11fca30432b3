"""Evaluation records: questions, answers and metrics, and adapters of multi-hop question sets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import exact_match, token_f1


def unnested(records: DataFrame, metrics: str = "metrics") -> DataFrame:
    """A row for each metric that has a score: question, metric, score, reason. metrics: map of name to struct (score, reason)."""
    return records.select("question", F.explode(metrics).alias("metric", "m")).where("m.score is not null").select("question", "metric", F.col("m.score").alias("score"), F.col("m.reason").alias("reason"))


def evaluated(answers: DataFrame, metrics: list[str], custom: dict[str, Callable[[Column, Column], Column]] | None = None, id_col: str = "id") -> DataFrame:
    """answers (id, answer, golden_answer) with a column for each metric: EM, F1, or a custom one. Unknown names are errors."""
    custom = custom or {}
    if unknown := set(metrics) - {"EM", "F1", *custom}:
        raise ValueError(f"no such metrics: {sorted(unknown)}")
    out = answers
    for m in metrics:
        if m == "F1":
            out = out.join(token_f1(answers, id_col, "answer", "golden_answer").withColumnRenamed("f1", "F1"), id_col)
        else:
            out = out.withColumn(m, (exact_match if m == "EM" else custom[m])(F.col("answer"), F.col("golden_answer")))
    return out


def golden_context(items: DataFrame) -> DataFrame:
    """Multi-hop items (id, supporting: array of (title, sentence), context: array of (title, sentences)) with their supporting sentences: id, golden_context."""
    context = items.select("id", F.inline("context")).select("id", "title", "sentences")
    facts = items.select("id", F.posexplode("supporting").alias("at", "fact")).select("id", "at", F.col("fact.title").alias("title"), F.col("fact.sentence").alias("sentence"))
    found = facts.join(context, ["id", "title"]).select("id", "at", F.get("sentences", F.col("sentence")).alias("text")).where("text is not null")
    return found.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), "\n").alias("golden_context"))


def sampled(items: DataFrame, n: int, seed: int = 42, key: str = "id") -> DataFrame:
    """n items, the same ones for the same seed, whatever the partitioning."""
    return items.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)


def coverage_score(answer: Column, golden: Column) -> Column:
    """The share of the golden text's words that an answer or context holds; 1 if there are none. A measure in the place of a judging model."""
    from ..functions.text import tokens

    words = F.array_distinct(tokens(golden))
    return F.when(F.size(words) == 0, 1.0).otherwise(F.size(F.array_intersect(words, tokens(answer))) / F.size(words))


def corpus_of(items: DataFrame, limit: int | None = None, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """A corpus and its questions from multi-hop items (id, question, answer, context: array of (title, sentences)): texts (title, text), each once, and questions."""
    some = items if limit is None else sampled(items, limit, seed)
    each = some.select(F.inline("context")).select("title", F.array_join("sentences", " ").alias("text"))
    return each.dropDuplicates(["title", "text"]), some.select("id", "question", "answer")


def metric_statistics(rows: DataFrame, samples: int = 1000) -> DataFrame:
    """Mean and interval of each metric (metric, score): metric, mean, low, high."""
    from .catalog import bootstrap

    return bootstrap(rows, "metric", "score", samples)
