"""Text functions: tokens, titles, entities by pattern, claims and answer metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with")
#: Kinds of entities and the patterns that find them.
ENTITY_PATTERNS = {
    "EMAIL": r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    "PHONE": r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}",
    "URL": r"https?://[^\s<>\"')]+",
    "DATE": r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[/.][0-9]{1,2}[/.][0-9]{2,4}|(?:January|February|March|April|May|June|July|August|September|October|November|December) [0-9]{1,2},? [0-9]{4}",
    "TIME": r"(?:[01]?[0-9]|2[0-3]):[0-5][0-9](?::[0-5][0-9])?(?: ?[AaPp][Mm])?",
    "MONEY": r"[$€£] ?[0-9]+(?:,[0-9]{3})*(?:\.[0-9]{1,2})?|[0-9]+(?:\.[0-9]{2})? (?:USD|EUR|GBP|dollars|euros|pounds)",
    "PERSON": r"[A-Z][a-z]+(?: [A-Z]\.)?(?: [A-Z][a-z]+)+",
    "HASHTAG": r"#[a-zA-Z0-9_]+",
    "MENTION": r"@[a-zA-Z0-9_]+",
    "IP_ADDRESS": r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}",
}
RELATION_WORDS = ("is", "has", "was", "are", "works", "contains", "causes", "relates")


def loaded_patterns(spec: list[dict]) -> dict[str, str]:
    """Patterns from plain data (entity_name, regex), as read from JSON; an error if a field is missing or a pattern is none."""
    import re

    out = {}
    for x in spec:
        if not x.get("entity_name") or not x.get("regex"):
            raise ValueError(f"entity_name and regex are needed: {x}")
        try:
            re.compile(x["regex"])
        except re.error as e:
            raise ValueError(f"{x['entity_name']}: {e}") from e
        out[x["entity_name"]] = x["regex"]
    return out


def tokens(text: Column, stop_words: tuple[str, ...] = STOP_WORDS) -> Column:
    """Lower-case words of letters, digits and underscores in any script, without stop words."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"(?U)(\w+)"), F.lit(1))
    return F.array_except(found, F.array()) if not stop_words else F.filter(found, lambda w: ~w.isin(*stop_words))


def split_words(text: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct tokens; 0 if there are none."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def sentences(text: Column) -> Column:
    return F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.trim(s) != "")


def title(text: Column, words: int = 7) -> Column:
    """The first words, as a heading."""
    return F.array_join(F.slice(split_words(text), 1, words), " ")


def entities(docs: DataFrame, id_col: str, text_col: str, patterns: dict[str, str] | None = None) -> DataFrame:
    """A row for each match of each pattern: id, entity_type, value."""
    found = [_tagged(text_col, name, p) for name, p in (patterns or ENTITY_PATTERNS).items()]
    return docs.select(id_col, F.inline(F.flatten(F.array(*found))))


def _tagged(text_col: str, name: str, pattern: str) -> Column:
    return F.transform(F.regexp_extract_all(F.col(text_col), F.lit(pattern), F.lit(0)), lambda v: F.struct(F.lit(name).alias("entity_type"), v.alias("value")))


def frequent_words(docs: DataFrame, id_col: str, text_col: str, top: int = 3, stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """The most frequent words of each document, of equals the first one: id, words (joined by ', ')."""
    from pyspark.sql import Window

    bare = F.filter(F.transform(split_words(F.lower(text_col)), lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}_]", "")), lambda w: (w != "") & ~w.isin(*stop_words))
    counted = docs.select(id_col, F.posexplode(bare).alias("at", "word")).groupBy(id_col, "word").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    ranked = counted.withColumn("rank", F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc("n"), "first"))).where(F.col("rank") <= top)
    return ranked.groupBy(id_col).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]), ", ").alias("words"))


def exact_match(answer: Column, golden: Column) -> Column:
    return (F.lower(F.trim(answer)) == F.lower(F.trim(golden))).cast("double")


def answer_tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}_]", "") != "")


def token_f1(pairs: DataFrame, id_col: str, answer: str, golden: str) -> DataFrame:
    """F1 of bags of tokens for each row: id, f1. Both empty: 1; one empty: 0."""
    bare = lambda c: F.filter(F.transform(F.split(F.lower(c), r"\s+"), lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}_]", "")), lambda w: w != "")
    rows = pairs.select(id_col, bare(F.col(answer)).alias("a"), bare(F.col(golden)).alias("g"))
    shared = F.aggregate(F.array_distinct("a"), F.lit(0), lambda s, w: s + F.least(F.size(F.filter("a", lambda x: x == w)), F.size(F.filter("g", lambda x: x == w))))
    n, m = F.size("a"), F.size("g")
    return rows.select(id_col, F.when((n == 0) & (m == 0), 1.0).when(shared == 0, 0.0).otherwise(2.0 * shared / (n + m)).alias("f1"))
