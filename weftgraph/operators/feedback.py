"""Questions and answers as graph elements, and feedback on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import uuid5

USED = "used_graph_element_to_answer"


def interaction(question: str, answer: str, context: str, triplets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A node for an interaction, and edges to both ends of the triplets (src, dst) that it used, with weight 0."""
    spark = triplets.sparkSession
    node = spark.createDataFrame([(question, answer, context)], "question string, answer string, context string").withColumn("id", uuid5(F.concat("question", "answer", "context")))
    ends = triplets.select(F.explode(F.array("src", "dst")).alias("dst")).distinct()
    edges = node.select(F.col("id").alias("src")).join(ends, F.lit(True)).select("src", "dst", F.lit(USED).alias("rel"), F.lit(0.0).alias("weight"))
    return node, edges


def about_latest(feedback_id: str, interactions: DataFrame, k: int = 1) -> DataFrame:
    """Edges from a feedback to the k latest interactions (id, created_at)."""
    latest = interactions.orderBy(F.desc("created_at"), "id").limit(k)
    return latest.select(F.lit(feedback_id).alias("src"), F.col("id").alias("dst"), F.lit("gives_feedback_to").alias("rel"))


def rules_of(nodes: DataFrame, edges: DataFrame, nodeset: str, belongs: str = "belongs_to_set") -> DataFrame:
    """Texts of the rules in a set of nodes."""
    members = edges.where((F.col("rel") == belongs) & (F.col("dst") == nodeset)).select(F.col("src").alias("id"))
    return nodes.where("text is not null").join(members, "id", "left_semi").select("id", "text")


def origins(rules: DataFrame, chunks: DataFrame, max_rules: int = 10_000) -> DataFrame:
    """An edge from each rule to the chunk of the nearest vector: src, dst, rel. Rules are counted, as they are broadcast against all chunks."""
    from .search import batch_nearest

    best = batch_nearest(chunks, rules, 1, max_rules)
    return best.select(F.col("query").alias("src"), F.col("id").alias("dst"), F.lit("rule_associated_from").alias("rel"))


def numbered(rows: DataFrame, *partition: str, order: str) -> DataFrame:
    """rows with their number in each partition."""
    return rows.withColumn("number", F.row_number().over(Window.partitionBy(*partition).orderBy(order)))


def enriched(pairs: DataFrame, answer, report, nodeset: str = "feedback_enrichments") -> DataFrame:
    """A row for each negative feedback with a better answer and a report, both made by functions of Columns: id, feedback_id, interaction_id, improved_answer, text, nodeset.
    pairs: feedback_id, interaction_id, question, answer."""
    better = answer(F.col("question"), F.col("answer"))
    out = pairs.withColumn("improved_answer", better).where("improved_answer is not null")
    return out.select(uuid5(F.concat(F.col("feedback_id").cast("string"), F.lit("_enrichment"))).alias("id"), "feedback_id", "interaction_id", "improved_answer", report(F.col("question"), F.col("improved_answer")).alias("text"), F.lit(nodeset).alias("nodeset"))


def enrichment_edges(rows: DataFrame) -> DataFrame:
    """Two edges from each enrichment, to its feedback and to the interaction: src, dst, rel."""
    pair = F.array(F.struct(F.col("feedback_id").cast("string").alias("dst"), F.lit("enriches_feedback").alias("rel")), F.struct(F.col("interaction_id").cast("string").alias("dst"), F.lit("improves_interaction").alias("rel")))
    return rows.select(F.col("id").alias("src"), F.inline(pair))
