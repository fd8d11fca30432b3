"""Datasets, permissions, history, pipeline runs, sessions and set differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def history(queries: DataFrame, results: DataFrame, limit: int = 10) -> DataFrame:
    """Distinct queries and results (id, text, user_id, created_at) in order of time."""
    rows = queries.withColumn("kind", F.lit("query")).unionByName(results.withColumn("kind", F.lit("result")))
    return rows.distinct().orderBy("created_at", "kind", "id").limit(limit)


def latest_runs(runs: DataFrame, *partition: str, order: str = "created_at", tie: str = "run_id") -> DataFrame:
    """The latest run of each dataset, or of each dataset and pipeline."""
    w = Window.partitionBy(*partition).orderBy(F.desc(order), F.desc(tie))
    return runs.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")


def permitted(acl: DataFrame, memberships: DataFrame, user, permission: str) -> DataFrame:
    """Datasets that a user may use by their own rights and by those of the groups they are in: dataset_id. acl: principal_id, dataset_id, permission."""
    principals = memberships.where(F.col("user_id") == user).select(F.col("group_id").alias("principal_id")).union(memberships.sparkSession.createDataFrame([(user,)], memberships.select("user_id").schema)).distinct()
    return acl.where(F.col("permission") == permission).join(principals, "principal_id", "left_semi").select("dataset_id").distinct()


def granted(acl: DataFrame, new: DataFrame) -> DataFrame:
    """Rights with new ones, once each."""
    keys = ["principal_id", "dataset_id", "permission"]
    return acl.unionByName(new.dropDuplicates(keys).join(acl, keys, "left_anti"))


def sync_plan(local: DataFrame, remote: DataFrame, key: str = "content_hash") -> DataFrame:
    """What either side lacks: key, action (upload or download)."""
    up = local.select(key).distinct().join(remote, key, "left_anti").withColumn("action", F.lit("upload"))
    return up.unionByName(remote.select(key).distinct().join(local, key, "left_anti").withColumn("action", F.lit("download")))


def latest_turns(turns: DataFrame, session: str = "conv_id", order: str = "turn", n: int = 5) -> DataFrame:
    """The last n entries of each session."""
    w = Window.partitionBy(session).orderBy(F.desc(order))
    return turns.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= n).drop("__rank")


def session_documents(turns: DataFrame, session: str = "conv_id", order: str = "turn", speaker: str = "role", text: str = "text") -> DataFrame:
    """Each session as one text, an entry a line: the session, text, n_turns."""
    lines = F.array_sort(F.collect_list(F.struct(order, F.concat_ws(": ", speaker, text).alias("line"))))
    return turns.groupBy(session).agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("text"), F.count("*").alias("n_turns"))


def feedback_pairs(feedback: DataFrame, interactions: DataFrame, edges: DataFrame, last_n: int | None = None) -> DataFrame:
    """Negative feedback (id, score, created_at) with the interaction it is about, the latest first."""
    pairs = (
        feedback.where("score < 0")
        .select(F.col("id").alias("src"), "score", "created_at")
        .join(edges.where(F.col("rel") == "gives_feedback_to").select("src", "dst"), "src")
        .join(interactions.select(F.col("id").alias("dst"), "question", "answer"), "dst")
        .select(F.col("src").alias("feedback_id"), F.col("dst").alias("interaction_id"), "score", "question", "answer", "created_at")
        .orderBy(F.desc("created_at"), "feedback_id")
    )
    return pairs.limit(last_n) if last_n else pairs


def bootstrap(scores: DataFrame, metric: str, score: str, samples: int = 1000, confidence: float = 0.95, seed: int = 42) -> DataFrame:
    """Mean and percentile interval of each metric's mean, by Poisson resampling: each row counts Poisson(1) times in each sample, so samples need no
    sorting, are formed where the rows are, and only sums are shuffled. metric, mean, low, high."""
    rows = scores.where(F.col(score).isNotNull()).select(metric, F.col(score).cast("double").alias("v"), F.explode(F.sequence(F.lit(1), F.lit(samples))).alias("sample"))
    u, e = F.rand(seed), 0.36787944117144233
    steps = [e, e * 2, e * 2.5, e * (2.5 + 1 / 6), e * (2.5 + 1 / 6 + 1 / 24)]
    weighted = rows.withColumn("u", u).withColumn("n", sum(((F.col("u") > s).cast("int") for s in steps), F.lit(0)))
    means = weighted.groupBy(metric, "sample").agg((F.sum(F.col("v") * F.col("n")) / F.nullif(F.sum("n"), F.lit(0))).alias("m"))
    ends = means.groupBy(metric).agg(F.percentile("m", (1 - confidence) / 2).alias("low"), F.percentile("m", (1 + confidence) / 2).alias("high"))
    return scores.where(F.col(score).isNotNull()).groupBy(metric).agg(F.avg(score).alias("mean")).join(ends, metric)


def token_total(data: DataFrame, tokens: str = "token_count") -> DataFrame:
    """One row, tokens: the sum, 0 without data."""
    return data.agg(F.coalesce(F.sum(tokens), F.lit(0)).alias("tokens"))


def run_metrics(runs: DataFrame, stored: DataFrame, metrics: DataFrame) -> DataFrame:
    """A row of metrics for each run: the stored one (run_id, ...) if there is one, else the given one row."""
    missing = runs.select("run_id").distinct().join(stored, "run_id", "left_anti")
    return stored.join(runs, "run_id", "left_semi").unionByName(missing.join(metrics, F.lit(True)).select(*stored.columns))


def deletion_counts(datasets: DataFrame, data: DataFrame, dataset: str | None = None, owner=None) -> DataFrame:
    """One row: how many datasets, data rows and owners a deletion would concern; of one dataset by name, of one owner, or of all. datasets: dataset_id, name, owner_id; data: data_id, dataset_id."""
    if dataset is not None:
        datasets = datasets.where(F.col("name") == dataset)
    if owner is not None:
        datasets = datasets.where(F.col("owner_id") == owner)
    n = datasets.agg(F.count("*").alias("n_datasets"), F.countDistinct("owner_id").alias("n_owners"))
    rows = data.join(datasets, "dataset_id", "left_semi").agg(F.countDistinct("data_id").alias("n_data"))
    return n.join(rows, F.lit(True)).select("n_datasets", "n_data", "n_owners")


def with_data(datasets: DataFrame, data: DataFrame) -> DataFrame:
    """Datasets (dataset_id) with whether they have any data: has_data."""
    some = data.select("dataset_id").distinct().withColumn("__some", F.lit(True))
    return datasets.join(some, "dataset_id", "left").withColumn("has_data", F.coalesce("__some", F.lit(False))).drop("__some")


def of_dataset(data: DataFrame, dataset, order: str = "created_at", tie: str = "data_id") -> DataFrame:
    """A dataset's data, the latest first."""
    return data.where(F.col("dataset_id") == dataset).orderBy(F.desc(order), tie)


def loaded_or_created(wanted: DataFrame, existing: DataFrame, user: str, tenant: str | None = None) -> DataFrame:
    """Datasets for names or ids (column name): those that exist by either, else new ones with the id that belongs to name and user: name, dataset_id, created."""
    from ..functions.ids import dataset_id

    by_name = existing.groupBy("name").agg(F.min("dataset_id").alias("by_name"))
    by_id = existing.select(F.col("dataset_id").cast("string").alias("name"), F.col("dataset_id").alias("by_id"), F.col("name").alias("named")).dropDuplicates(["name"])
    found = wanted.select("name").distinct().join(by_name, "name", "left").join(by_id, "name", "left")
    known = F.coalesce("by_id", "by_name")
    return found.select(F.coalesce("named", "name").alias("name"), F.coalesce(known, dataset_id(F.col("name"), F.lit(user), F.lit(tenant))).alias("dataset_id"), known.isNull().alias("created"))


def logged(entries: DataFrame, kind: str) -> DataFrame:
    """Rows of the search log from queries or results (id, text, user_id, created_at): the same with kind, each id once."""
    return entries.select("id", "text", "user_id", "created_at", F.lit(kind).alias("kind")).dropDuplicates(["id"])


def chosen_search(text, graph_words: tuple[str, ...] = ("related", "connected", "relation", "between", "why", "how"), summary_words: tuple[str, ...] = ("summary", "summarise", "summarize", "overview"), time_words: tuple[str, ...] = ("when", "before", "after", "since", "until")):
    """A kind of search for a question, by its words; RAG_COMPLETION if none decides. A rule in the place of a model."""
    words = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    has = lambda known: F.arrays_overlap(words, F.array(*map(F.lit, known)))
    return F.when(has(summary_words), "SUMMARIES").when(has(time_words), "TEMPORAL").when(has(graph_words), "GRAPH_COMPLETION").when(F.lower(text).rlike(r"\b(def|class|function|import)\b"), "CODE").otherwise("RAG_COMPLETION")


def pruned(remote: DataFrame, local: DataFrame, key: str = "content_hash") -> DataFrame:
    """What a remote dataset keeps: rows that the local one has too."""
    return remote.join(local.select(key).distinct(), key, "left_semi")


def run_summary(runs: DataFrame, status: str = "status") -> DataFrame:
    """Counts of runs by status."""
    return runs.groupBy(status).agg(F.count("*").alias("n"))
