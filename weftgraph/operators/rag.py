"""Grounding of answers in context, hallucination checks and context validation.

Claims meet context entities through rare words (an inverted index with counted frequencies), chosen so that no link is missed: a text that holds another one holds its rarest word too, and two
texts that share more than 0.4 of their words share one of the rarer 0.6 of either."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import sentences, split_words

QUOTE, PARAPHRASE, MENTION, OVERLAP = 0.95, 0.75, 0.6, 0.4


def claims(answers: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """A row for each sentence: id, claim_index, claim."""
    return answers.select(id_col, F.posexplode(sentences(F.col(text_col))).alias("claim_index", "claim"))


def bare_words(text: Column) -> Column:
    """Lower-case words without the punctuation around them, in order."""
    bare = F.transform(split_words(F.lower(text)), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    return F.filter(bare, lambda w: w != "")


def _in_order(words: Column) -> Column:
    return F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))


def _by_rarity(texts: DataFrame, keys: list[str], counts: DataFrame) -> DataFrame:
    """texts: keys, words. The distinct words of each, rarest first: keys, ranked."""
    each = texts.select(*keys, F.explode(F.array_distinct("words")).alias("w")).join(counts, "w")
    return each.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "w"))), lambda x: x["w"]).alias("ranked"))


def provenance(claimed: DataFrame, context: DataFrame, id_col: str = "id") -> DataFrame:
    """Links of claims to context entities (entity_id, name, content): id, claim_index, entity_id, kind, confidence; the strongest kind of each pair.

    Texts are compared as lower-case words without punctuation. quote: one text holds the other's words in a row; paraphrase: more than 0.4 of the larger word set is shared;
    mention: the claim holds the name's words in a row."""
    key = [id_col, "claim_index"]
    c = claimed.select(*key, bare_words(F.col("claim")).alias("words"))
    e = context.select("entity_id", bare_words(F.col("name")).alias("name_words"), bare_words(F.col("content")).alias("words"))
    counts = c.select(F.explode(F.array_distinct("words")).alias("w")).unionByName(e.select(F.explode(F.array_distinct(F.concat("words", "name_words"))).alias("w"))).groupBy("w").agg(F.count("*").alias("n"))
    claims_ranked = _by_rarity(c, key, counts)
    content_ranked = _by_rarity(e, ["entity_id"], counts)
    name_ranked = _by_rarity(e.select("entity_id", F.col("name_words").alias("words")), ["entity_id"], counts)
    rarest = lambda df, *k: df.select(*k, F.element_at("ranked", 1).alias("w"))
    every = lambda df, *k: df.select(*k, F.explode("ranked").alias("w"))
    # a set that shares more than 0.4 of n words shares one of the first n - floor(0.4 * n)
    rarer = lambda df, *k: df.select(*k, F.explode(F.slice("ranked", 1, F.size("ranked") - F.floor(F.size("ranked") * OVERLAP).cast("int"))).alias("w"))
    pairs = rarest(claims_ranked, *key).join(every(content_ranked, "entity_id"), "w")
    pairs = pairs.unionByName(every(claims_ranked, *key).join(rarest(content_ranked, "entity_id").unionByName(rarest(name_ranked, "entity_id")), "w"))
    pairs = pairs.unionByName(rarer(claims_ranked, *key).join(rarer(content_ranked, "entity_id"), "w")).select(*key, "entity_id").distinct()
    both = pairs.join(c, key).join(e.withColumnRenamed("words", "content_words"), "entity_id")
    claim, content, name = _in_order(F.col("words")), _in_order(F.col("content_words")), _in_order(F.col("name_words"))
    quote = (F.size("words") > 0) & (F.size("content_words") > 0) & (F.contains(content, claim) | F.contains(claim, content))
    a, b = F.array_distinct("words"), F.array_distinct("content_words")
    overlap = F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.size(b))
    kind = F.when(quote, "quote").when(overlap > OVERLAP, "paraphrase").when((F.size("name_words") > 0) & F.contains(claim, name), "mention")
    linked = both.withColumn("kind", kind).where("kind is not null")
    return linked.select(*key, "entity_id", "kind", F.when(F.col("kind") == "quote", QUOTE).when(F.col("kind") == "paraphrase", PARAPHRASE).otherwise(MENTION).alias("confidence"))


def grounded(claimed: DataFrame, links: DataFrame, id_col: str = "id") -> DataFrame:
    """Each claim with its best confidence and citations: confidence, citations (sorted ids), is_grounded."""
    best = links.groupBy(id_col, "claim_index").agg(F.max("confidence").alias("confidence"), F.array_sort(F.collect_set("entity_id")).alias("citations"))
    out = claimed.join(best, [id_col, "claim_index"], "left")
    return out.withColumn("is_grounded", F.col("confidence").isNotNull()).withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))


def coverage(claims_grounded: DataFrame, id_col: str = "id") -> DataFrame:
    """Share of grounded claims of each answer."""
    return claims_grounded.groupBy(id_col).agg(F.avg(F.col("is_grounded").cast("double")).alias("coverage"), F.count("*").alias("n_claims"))


def citation_numbers(links: DataFrame, id_col: str = "id") -> DataFrame:
    """Numbers of an answer's sources, by id: id, entity_id, number."""
    from pyspark.sql import Window

    return links.select(id_col, "entity_id").distinct().withColumn("number", F.row_number().over(Window.partitionBy(id_col).orderBy("entity_id")))


def risk(ungrounded: Column, critical: Column, total: Column) -> Column:
    """Hallucination risk of an answer: 0.6 of the share of detections, 0.4 of that of critical ones, 0.2 more if over half were detected; 1 without claims."""
    share = ungrounded / total
    base = 0.6 * share + 0.4 * critical / total
    return F.when(total == 0, 1.0).otherwise(F.least(F.lit(1.0), F.when(share > 0.5, base + 0.2).otherwise(base)))


def context_checks(entities: DataFrame, now: Column, level: str = "moderate", updated: str = "updated_at", max_age_days: int = 365) -> DataFrame:
    """Validity of context entities (name, content, ontology_valid, a time): checks_passed, validity_score, is_valid."""
    checks = [F.coalesce("ontology_valid", F.lit(False)), F.length(F.trim(F.coalesce("name", F.lit("")))) > 0, F.length(F.trim(F.coalesce("content", F.lit("")))) > 10]
    if level != "lenient":
        checks.append(F.coalesce(F.datediff(now, F.col(updated)) <= max_age_days, F.lit(False)))
    passed = sum((c.cast("int") for c in checks), F.lit(0))
    out = entities.withColumn("checks_passed", passed).withColumn("validity_score", passed / len(checks))
    valid = {"strict": F.col("validity_score") == 1, "moderate": F.col("ontology_valid") & (F.col("validity_score") >= 0.7), "lenient": F.col("validity_score") >= 0.5}[level]
    return out.withColumn("is_valid", F.coalesce(valid, F.lit(False)))


def trustworthy(confidence: Column, hallucination_risk: Column, n_warnings: Column) -> Column:
    return (confidence >= 0.7) & (hallucination_risk < 0.3) & (n_warnings == 0)


PROPER = r"[A-Z][a-z]+(?: [A-Z][a-z]+)*"


def mentions(claimed: DataFrame, id_col: str = "id", text_col: str = "claim") -> DataFrame:
    """Distinct proper nouns of each claim: id, claim_index, mention."""
    return claimed.select(id_col, "claim_index", F.explode(F.array_distinct(F.regexp_extract_all(F.col(text_col), F.lit(PROPER), F.lit(0)))).alias("mention"))


def fabricated(mentioned: DataFrame, names: DataFrame) -> DataFrame:
    """Mentions that are no known name (a column name), whatever the case."""
    return mentioned.withColumn("__key", F.lower("mention")).join(names.select(F.lower("name").alias("__key")).distinct(), "__key", "left_anti").drop("__key")


def detections(claims_grounded: DataFrame, fabricated_mentions: DataFrame, id_col: str = "id") -> DataFrame:
    """Claims with what speaks against them: detection (fabricated_entity before ungrounded, else null) and severity."""
    bad = fabricated_mentions.select(id_col, "claim_index").distinct().withColumn("__bad", F.lit(True))
    out = claims_grounded.join(bad, [id_col, "claim_index"], "left")
    kind = F.when(F.col("__bad"), "fabricated_entity").when(~F.col("is_grounded"), "ungrounded")
    return out.withColumn("detection", kind).withColumn("severity", F.when(F.col("detection") == "fabricated_entity", "critical").when(F.col("detection").isNotNull(), "warning")).drop("__bad")


def answer_risks(detected: DataFrame, id_col: str = "id") -> DataFrame:
    """Each answer's risk and whether it can be trusted: below 0.3 and nothing critical."""
    n = detected.groupBy(id_col).agg(F.count_if(F.col("detection").isNotNull()).alias("u"), F.count_if(F.col("severity") == "critical").alias("c"), F.count("*").alias("n"))
    value = risk(F.col("u"), F.col("c"), F.col("n"))
    return n.select(id_col, value.alias("risk"), ((value < 0.3) & (F.col("c") == 0)).alias("is_trustworthy"))


def annotated(claims_grounded: DataFrame, numbers: DataFrame, id_col: str = "id") -> DataFrame:
    """Each answer with its claims' citation numbers in brackets after them: id, text."""
    cited = claims_grounded.select(id_col, "claim_index", "claim", F.explode_outer("citations").alias("entity_id")).join(numbers, [id_col, "entity_id"], "left")
    marks = F.array_join(F.transform(F.array_sort(F.collect_set("number")), lambda x: F.concat(F.lit("["), x.cast("string"), F.lit("]"))), "")
    each = cited.groupBy(id_col, "claim_index", "claim").agg(marks.alias("m"))
    parts = F.array_sort(F.collect_list(F.struct("claim_index", F.concat_ws(" ", "claim", F.nullif("m", F.lit(""))).alias("t"))))
    return each.groupBy(id_col).agg(F.array_join(F.transform(parts, lambda x: x["t"]), " ").alias("text"))


def corrected(detected: DataFrame, id_col: str = "id", note: str = "Some statements were removed, as nothing supports them.") -> DataFrame:
    """Each answer without its critical claims, and a note if any went: id, text."""
    kept = F.filter(F.array_sort(F.collect_list(F.struct("claim_index", "claim", F.coalesce(F.col("severity") == "critical", F.lit(False)).alias("bad")))), lambda x: ~x["bad"])
    rows = detected.groupBy(id_col).agg(F.array_join(F.transform(kept, lambda x: x["claim"]), " ").alias("text"), F.bool_or(F.coalesce(F.col("severity") == "critical", F.lit(False))).alias("cut"))
    return rows.select(id_col, F.when(F.col("cut"), F.concat_ws(" ", F.nullif("text", F.lit("")), F.lit(note))).otherwise(F.col("text")).alias("text"))


def relation_claims(claimed: DataFrame, names: DataFrame, id_col: str = "id") -> DataFrame:
    """Pairs of known names (id, name) that a claim with a word of relation mentions: id, claim_index, src, dst."""
    from ..functions.text import RELATION_WORDS

    told = claimed.select(id_col, "claim_index", bare_words(F.col("claim")).alias("words")).where(F.arrays_overlap("words", F.array(*map(F.lit, RELATION_WORDS))))
    known = names.select(F.col("id").alias("entity"), F.array_join(bare_words(F.col("name")), " ").alias("n"), F.element_at(bare_words(F.col("name")), 1).alias("w")).where("w is not null")
    met = told.select(id_col, "claim_index", "words", F.explode(F.array_distinct("words")).alias("w")).join(known, "w").where(F.contains(_in_order(F.col("words")), F.concat(F.lit(" "), F.col("n"), F.lit(" "))))
    one = met.select(id_col, "claim_index", "entity").distinct()
    return one.withColumnRenamed("entity", "src").join(one.withColumnRenamed("entity", "dst"), [id_col, "claim_index"]).where("src < dst")


def relations_verified(claimed: DataFrame, names: DataFrame, edges: DataFrame, id_col: str = "id") -> DataFrame:
    """Each claim with whether the relations it tells of may exist: some edge, either way, joins two of the names it mentions; claims of fewer than two are not in doubt. id, claim_index, n_pairs, n_linked, is_supported."""
    pairs = relation_claims(claimed, names, id_col)
    linked = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct().withColumn("__linked", F.lit(1))
    counts = pairs.join(linked, ["src", "dst"], "left").groupBy(id_col, "claim_index").agg(F.count("*").alias("n_pairs"), F.count("__linked").alias("n_linked"))
    out = claimed.select(id_col, "claim_index").join(counts, [id_col, "claim_index"], "left").na.fill(0, ["n_pairs", "n_linked"])
    return out.withColumn("is_supported", (F.col("n_pairs") == 0) | (F.col("n_linked") > 0))


def validated_relations(nodes: DataFrame, edges: DataFrame, ontology) -> DataFrame:
    """Edges with a validity: 1 if the ontology allows them, 0.5 if it doesn't. src, dst, rel, issue (null if there is none), validity."""
    from .ontology import invalid_relations

    bad = invalid_relations(nodes, edges, ontology).distinct()
    out = edges.select("src", "dst", "rel").join(bad, ["src", "dst", "rel"], "left")
    return out.withColumn("validity", F.when(F.col("issue").isNull(), 1.0).otherwise(0.5))


def context_issues(checked: DataFrame, now: Column, id_col: str = "id", updated: str = "updated_at", max_age_days: int = 365, issue: str | None = None) -> DataFrame:
    """Why context entities fall short, a row for each reason (of one kind if given): id, issue."""
    reasons = F.array_compact(
        F.array(
            F.when(~F.coalesce("ontology_valid", F.lit(False)), "ontology"),
            F.when(F.length(F.trim(F.coalesce("name", F.lit("")))) == 0, "name"),
            F.when(F.length(F.trim(F.coalesce("content", F.lit("")))) <= 10, "content"),
            F.when(~F.coalesce(F.datediff(now, F.col(updated)) <= max_age_days, F.lit(False)), "stale"),
        )
    )
    out = checked.select(id_col, F.explode(reasons).alias("issue"))
    return out if issue is None else out.where(F.col("issue") == issue)


def explained_provenance(claimed: DataFrame, links: DataFrame, id_col: str = "id") -> DataFrame:
    """A line for each link of a claim, the surest first: id, claim_index, number, line; claims without a link get one that says so."""
    from pyspark.sql import Window

    out = claimed.join(links, [id_col, "claim_index"], "left")
    order = Window.partitionBy(id_col, "claim_index").orderBy(F.desc("confidence"), "entity_id")
    line = F.when(F.col("entity_id").isNull(), "no source").otherwise(F.format_string("%s of %s, confidence %.2f", "kind", F.col("entity_id").cast("string"), "confidence"))
    return out.select(id_col, "claim_index", F.row_number().over(order).alias("number"), line.alias("line"))
