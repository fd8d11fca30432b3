"""Registered queries of ontologies in RDF, retrieval in rounds, extraction, evolution, audit writing, guided answers, embeddings, chunking and the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import ids as I
from .functions import text as X
from .operators import audit as AW
from .operators import catalog as C
from .operators import chunking as K
from .operators import embeddings as EM
from .operators import evaluation as Y
from .operators import evolution as EV
from .operators import extraction as XT
from .operators import feedback as Z
from .operators import graph as G
from .operators import guided as GU
from .operators import models as Q
from .operators import ontology as O
from .operators import rag as R
from .operators import rdf as RD
from .operators import retrieval as RT
from .operators import search as S
from .plans import pipelines as J
from .queries import _E, _LINKS, _N, _ONTOLOGY, _VEC, _answers, _edges, _ids, _nodes, _t, _vectors, query
from .sources import files as B

_UUID = (
    "substr({h},1,8)||'-'||substr({h},9,4)||'-5'||substr({h},14,3)||'-'||lower(printf('%x', (('0x'||substr({h},17,2))::INT & 63) | 128))||substr({h},19,2)||'-'||substr({h},21,12)"
)
_SHA = "sha1(unhex('6ba7b8129dad11d180b400c04fd430c8') || encode({x}))"
_ID = _UUID.format(h=_SHA.format(x="{x}"))


# --- RDF


def _triples(spark: SparkSession, d: str) -> DataFrame:
    """Places and parties as RDF: classes, individuals and the object property located_in."""
    base = "http://example.org/trade#"
    t = lambda s, p, o: (s if "://" in s else base + s, p, o if "://" in o else base + o)
    fixed = [t(c, RD.TYPE, RD.CLASS) for c in ("Place", "Region", "Nation", "Party", "Customer", "Supplier")] + [t("located_in", RD.TYPE, RD.OBJECT_PROPERTY)]
    fixed += [t(a, RD.SUBCLASS, b) for a, b in (("Region", "Place"), ("Nation", "Place"), ("Customer", "Party"), ("Supplier", "Party"))]
    out = spark.createDataFrame(fixed, "s string, p string, o string")
    uri = lambda name, key: F.concat(F.lit(f"{base}{name} "), F.col(key).cast("string"))
    for table, name, key, parent in (("region", "Region", "r_regionkey", None), ("nation", "Nation", "n_nationkey", ("Region", "n_regionkey")), ("customer", "Customer", "c_custkey", ("Nation", "c_nationkey")), ("supplier", "Supplier", "s_suppkey", ("Nation", "s_nationkey"))):
        rows = _t(spark, d, table)
        out = out.unionByName(rows.select(uri(name, key).alias("s"), F.lit(RD.TYPE).alias("p"), F.lit(base + name).alias("o")))
        if parent:
            out = out.unionByName(rows.select(uri(name, key).alias("s"), F.lit(f"{base}located_in").alias("p"), uri(*parent).alias("o")))
    return out


_B = "'http://example.org/trade#"
_ONES = f"ones AS (SELECT {_B}Region '||r_regionkey AS uri, {_B}Region' AS type, NULL AS up FROM region UNION ALL SELECT {_B}Nation '||n_nationkey, {_B}Nation', {_B}Region '||n_regionkey FROM nation UNION ALL SELECT {_B}Customer '||c_custkey, {_B}Customer', {_B}Nation '||c_nationkey FROM customer UNION ALL SELECT {_B}Supplier '||s_suppkey, {_B}Supplier', {_B}Nation '||s_nationkey FROM supplier)"


@query(
    f"""WITH {_ONES} SELECT 'classes' AS category, lower(c) AS key, {_B}'||c AS uri FROM (VALUES ('Place'),('Region'),('Nation'),('Party'),('Customer'),('Supplier')) x(c)
UNION ALL SELECT 'individuals', replace(lower(regexp_extract(uri, '([^#/]+)/?$', 1)), ' ', '_'), uri FROM ones"""
)
def rdf_lookup(spark: SparkSession, d: str) -> DataFrame:
    return RD.lookup(_triples(spark, d))


@query(
    f"""WITH {_ONES}, up AS (SELECT DISTINCT up AS uri, 1 AS depth FROM ones WHERE uri = {_B}Customer 7'), top AS (SELECT o.up AS uri FROM ones o JOIN up ON o.uri = up.uri)
SELECT {_B}Customer 7' AS uri, 'customer_7' AS key, 0 AS depth UNION ALL SELECT uri, replace(lower(regexp_extract(uri, '([^#/]+)$', 1)), ' ', '_'), 1 FROM up UNION ALL SELECT {_B}Customer', 'customer', 1
UNION ALL SELECT uri, replace(lower(regexp_extract(uri, '([^#/]+)$', 1)), ' ', '_'), 2 FROM top UNION ALL SELECT {_B}Nation', 'nation', 2 UNION ALL SELECT {_B}Party', 'party', 2 UNION ALL SELECT {_B}Region', 'region', 3 UNION ALL SELECT {_B}Place', 'place', 3"""
)
def rdf_subgraph(spark: SparkSession, d: str) -> DataFrame:
    return RD.around(_triples(spark, d), "http://example.org/trade#Customer 7")[0]


@query(f"WITH {_ONES} SELECT c_custkey, lower(c_mktsegment) = 'x' AS wrong, 'customer_'||c_custkey AS match, {_B}Customer '||c_custkey AS uri FROM customer WHERE c_custkey <= 10")
def rdf_matches(spark: SparkSession, d: str) -> DataFrame:
    names = _t(spark, d, "customer").where("c_custkey <= 10").select("c_custkey", (F.lower("c_mktsegment") == "x").alias("wrong"), F.concat(F.lit("CUSTOMER "), "c_custkey").alias("name"))
    return RD.matched(names, RD.lookup(_triples(spark, d)), "individuals").select("c_custkey", "wrong", "match", "uri")


# --- retrieval


@query(
    f"""WITH {_E}, a AS (SELECT src, rel, dst FROM edges WHERE src = 'customer:7' OR dst = 'customer:7'), i1 AS (SELECT src AS id FROM a UNION SELECT dst FROM a), b AS (SELECT src, rel, dst FROM edges WHERE src IN (SELECT id FROM i1) OR dst IN (SELECT id FROM i1)),
nb AS (SELECT * FROM b EXCEPT SELECT * FROM a), i2 AS (SELECT src AS id FROM nb UNION SELECT dst FROM nb), c AS (SELECT src, rel, dst FROM edges WHERE src IN (SELECT id FROM i2) OR dst IN (SELECT id FROM i2)), nc AS (SELECT * FROM c EXCEPT SELECT * FROM a EXCEPT SELECT * FROM nb)
SELECT *, 0 AS round FROM (SELECT DISTINCT * FROM a) UNION ALL SELECT *, 1 FROM nb UNION ALL SELECT *, 2 FROM nc"""
)
def retrieval_rounds(spark: SparkSession, d: str) -> DataFrame:
    retrieve, ends = RT.around_ends(_edges(spark, d))
    return RT.rounds(retrieve, _ids(spark, "customer:7"), ends, 2)


@query(f"WITH {_E} SELECT DISTINCT src, rel, dst FROM edges WHERE rel = 'n_regionkey'")
def retrieval_until_nothing_is_new(spark: SparkSession, d: str) -> DataFrame:
    retrieve, ends = RT.around_ends(_edges(spark, d).where("rel = 'n_regionkey'"))
    start = _t(spark, d, "region").select(F.concat(F.lit("region:"), "r_regionkey").alias("id"))
    return RT.extended(retrieve, start, ends).select("src", "rel", "dst")


@query(
    f"""WITH {_N}, {_E}, t AS (SELECT src, rel, dst FROM edges WHERE dst = 'region:1' AND rel = 'n_regionkey'), i AS (SELECT src AS id FROM t UNION SELECT dst FROM t)
SELECT 'Nodes:' || chr(10) || (SELECT string_agg('Node: ' || id, chr(10) ORDER BY id) FROM i) || chr(10) || chr(10) || 'Connections:' || chr(10) || (SELECT string_agg(x, chr(10) ORDER BY x) FROM (SELECT DISTINCT src || ' --[' || rel || ']--> ' || dst AS x FROM t)) AS text"""
)
def triplets_as_text(spark: SparkSession, d: str) -> DataFrame:
    return RT.as_text(_nodes(spark, d).withColumn("text", F.lit(None).cast("string")), _edges(spark, d).where("dst = 'region:1' AND rel = 'n_regionkey'"))


@query(
    f"""WITH {_E}, t AS (SELECT DISTINCT src, rel, dst FROM edges WHERE rel = 'n_regionkey'), i AS (SELECT src AS id FROM t UNION SELECT dst FROM t)
SELECT '[' || (SELECT string_agg('{{"id":"'||id||'"}}', ',' ORDER BY id) FROM i) || ']' AS nodes, '[' || (SELECT string_agg('{{"src":"'||src||'","rel":"'||rel||'","dst":"'||dst||'"}}', ',' ORDER BY src, rel, dst) FROM t) || ']' AS edges"""
)
def context_graph(spark: SparkSession, d: str) -> DataFrame:
    return RT.context_graph(_edges(spark, d).where("rel = 'n_regionkey'"))


@query(
    f"""WITH {_E}, v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vector FROM embeddings), s AS (SELECT a.id AS query, 'customer:'||b.id AS id, round(1 - list_cosine_similarity(b.vector, a.vector), 6) AS distance FROM v a, v b WHERE a.id % 100 = 0 QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY list_cosine_similarity(b.vector, a.vector) DESC, b.id) <= 5),
h AS (SELECT DISTINCT query, src, rel, dst FROM edges JOIN s ON id = src OR id = dst), t AS (SELECT h.*, coalesce(x.distance, 3.5) + coalesce(y.distance, 3.5) + 3.5 AS score FROM h LEFT JOIN s x ON x.query = h.query AND x.id = src LEFT JOIN s y ON y.query = h.query AND y.id = dst)
SELECT query, src, rel, dst, round(score, 6) AS score FROM t QUALIFY row_number() OVER (PARTITION BY query ORDER BY t.score, src, rel, dst) <= 5"""
)
def triplets_per_entity(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    hits = S.batch_nearest(v, v.where("id % 100 = 0"), 5).select("query", F.concat(F.lit("customer:"), "id").alias("id"), F.round(1 - F.col("similarity"), 6).alias("distance"))
    return RT.per_entity(_edges(spark, d), hits).withColumn("score", F.round("score", 6))


@query(f"WITH {_E} SELECT DISTINCT a.src AS id, coalesce(b.dst, a.dst) AS other, CASE WHEN b.dst IS NULL THEN 'o_custkey' ELSE 'c_nationkey' END AS via FROM edges a LEFT JOIN edges b ON a.dst = b.src AND b.rel = 'c_nationkey' WHERE a.rel = 'o_custkey'")
def second_hop(spark: SparkSession, d: str) -> DataFrame:
    return RT.second_hop(_edges(spark, d), _nodes(spark, d).where("type = 'orders'").select("id"), "o_custkey", "c_nationkey")


@query(
    f"""WITH {_N}, {_E}, e AS (SELECT rel, a.type || ' -> ' || b.type AS e, count(*) AS n FROM edges JOIN nodes a ON src = a.id JOIN nodes b ON dst = b.id GROUP BY 1, 2)
SELECT 'node' AS kind, type AS label, '' AS ends, count(*) AS n FROM nodes GROUP BY type UNION ALL SELECT 'relation', rel, string_agg(e, ', ' ORDER BY e), sum(n)::BIGINT FROM e GROUP BY rel"""
)
def graph_schema(spark: SparkSession, d: str) -> DataFrame:
    return RT.graph_schema(_nodes(spark, d), _edges(spark, d))


@query("SELECT event_id AS id, distance FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN value END AS distance FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-09') ORDER BY distance NULLS LAST, event_id LIMIT 25")
def temporal_top_events(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events").select(F.col("event_id").alias("id"), "ts", "value")
    day = lambda s: F.lit(s).cast("timestamp_ntz")
    return RT.top_events(e, e.where("id % 3 = 0").select("id", F.col("value").alias("distance")), 25, day("2024-01-05"), day("2024-01-09")).select("id", "distance")


@query("SELECT event_id, (CAST(ts AS DATE))::VARCHAR AS since, (CAST(ts AS DATE) + 1)::VARCHAR AS until FROM events")
def asked_ranges(spark: SparkSession, d: str) -> DataFrame:
    day = F.date_format("ts", "yyyy-MM-dd")
    question = F.concat(F.lit("What happened between "), day, F.lit(" and "), F.date_format(F.date_add(F.to_date("ts"), 1), "yyyy-MM-dd"), F.lit("?"))
    r = RT.asked_range(question)
    return _t(spark, d, "events").select("event_id", r["since"].cast("string").alias("since"), r["until"].cast("string").alias("until"))


@query(f"WITH {_VEC}, r AS (SELECT id, type, list_cosine_similarity(vector, qv) AS s FROM v, q) SELECT id, type, round(s, 6) AS score FROM r WHERE type IN ('1', '2') ORDER BY s DESC, id LIMIT 10")
def top_entities_of_types(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    found = S.most_similar(v, S.vector_of(v, 0), 1_000_000).select("id", "type", F.col("similarity").alias("score"))
    return RT.top_entities(found, 10, ["1", "2"]).withColumn("score", F.round("score", 6))


# --- graph


@query(f"WITH {_N} SELECT x.id, n.id IS NOT NULL AS found FROM (VALUES ('nation:1'), ('nation:99'), ('orders:1')) x(id) LEFT JOIN nodes n ON x.id = n.id")
def known_nodes(spark: SparkSession, d: str) -> DataFrame:
    return G.known_ids(_nodes(spark, d), _ids(spark, "nation:1", "nation:99", "orders:1"))


@query(f"WITH {_N} SELECT id, type FROM nodes WHERE id IN ('nation:1', 'customer:7', 'region:99')")
def nodes_by_id(spark: SparkSession, d: str) -> DataFrame:
    return G.by_ids(_nodes(spark, d), _ids(spark, "nation:1", "customer:7", "region:99")).select("id", "type")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def node_properties(spark: SparkSession, d: str) -> DataFrame:
    return G.with_properties(_t(spark, d, "events"), "props", ["k"]).select("event_id", "k")


@query("SELECT l_orderkey||'-'||l_linenumber AS id, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def repeated_nodes(spark: SparkSession, d: str) -> DataFrame:
    return G.checked_nodes(_t(spark, d, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id")))


@query(f"WITH {_N}, {_E} SELECT src, dst, rel, CAST(NULL AS VARCHAR) AS weight FROM edges WHERE src IN (SELECT id FROM nodes WHERE type <> 'orders') AND dst IN (SELECT id FROM nodes WHERE type <> 'orders')")
def projected_graph(spark: SparkSession, d: str) -> DataFrame:
    return G.projected(_nodes(spark, d).where("type <> 'orders'"), _edges(spark, d), ["type", "name"], ["weight"])[1]


def _documented(spark: SparkSession, d: str) -> DataFrame:
    """Customers as chunks of their nations, which contain orders, and orders with their priority as a type; a nation is a document."""
    o, c = _t(spark, d, "orders"), _t(spark, d, "customer")
    parts = [
        c.select(F.concat(F.lit("c"), "c_custkey").alias("src"), F.concat(F.lit("n"), "c_nationkey").alias("dst"), F.lit("is_part_of").alias("rel")),
        c.select(F.concat(F.lit("s"), "c_custkey").alias("src"), F.concat(F.lit("c"), "c_custkey").alias("dst"), F.lit("made_from").alias("rel")),
        o.select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("d"), F.date_format("o_orderdate", "yyyyMMdd")).alias("dst"), F.lit("contains").alias("rel")),
        o.select(F.concat(F.lit("d"), F.date_format("o_orderdate", "yyyyMMdd")).alias("src"), F.concat(F.lit("m"), F.date_format("o_orderdate", "yyyyMM")).alias("dst"), F.lit("is_a").alias("rel")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


@query(
    """WITH ch AS (SELECT c_custkey FROM customer WHERE c_nationkey = 3), h AS (SELECT DISTINCT strftime(o_orderdate, '%Y%m%d') AS day, o_custkey IN (SELECT c_custkey FROM ch) AS mine FROM orders), e AS (SELECT day FROM h GROUP BY day HAVING bool_and(mine)), m AS (SELECT DISTINCT day, day[1:6] AS month FROM h)
SELECT 'n3' AS id, 'document' AS role UNION ALL SELECT 'c'||c_custkey, 'chunk' FROM ch UNION ALL SELECT 's'||c_custkey, 'summary' FROM ch UNION ALL SELECT 'd'||day, 'orphan_entity' FROM e
UNION ALL SELECT 'm'||month, 'orphan_type' FROM m GROUP BY month HAVING bool_and(day IN (SELECT day FROM e))"""
)
def document_subgraph(spark: SparkSession, d: str) -> DataFrame:
    return G.document_subgraph(_documented(spark, d), "n3")


# --- extraction


@query(
    """WITH t AS (SELECT item_id, list_distinct(regexp_extract_all(text, '[A-Z][a-z]+(?: [A-Z][a-z]+)*')) AS n FROM benchmark), o AS (SELECT item_id, regexp_extract_all(text, '[A-Z][a-z]+(?: [A-Z][a-z]+)*') AS n FROM benchmark)
SELECT item_id, len(n) AS n_nodes, greatest(len(n) - 1, 0) AS n_edges FROM t"""
)
def extracted_graphs(spark: SparkSession, d: str) -> DataFrame:
    found = XT.extracted(_t(spark, d, "benchmark"), XT.proper_names)
    return found.select("item_id", F.size("extraction.nodes").cast("long").alias("n_nodes"), F.size("extraction.edges").cast("long").alias("n_edges"))


@query(
    f"""WITH n AS (SELECT DISTINCT item_id::VARCHAR AS chunk, unnest(regexp_extract_all(text, '[A-Z][a-z]+(?: [A-Z][a-z]+)*')) AS name FROM benchmark), k AS (SELECT chunk, {_ID.format(x="replace(lower(name), ' ', '_')")} AS id FROM n)
SELECT id AS src, 'is_a' AS rel, {_ID.format(x="'name'")} AS dst FROM k UNION SELECT chunk, 'contains', id FROM k"""
)
def expanded_graph(spark: SparkSession, d: str) -> DataFrame:
    found = XT.extracted(_t(spark, d, "benchmark"), XT.proper_names)
    return XT.expanded(found, None, "item_id")[1].where("rel <> 'followed_by'")


@query(f"WITH {_E} SELECT src, rel, dst FROM edges WHERE rel = 'n_regionkey' OR rel = 'c_nationkey'")
def edges_with_ontology(spark: SparkSession, d: str) -> DataFrame:
    e = _edges(spark, d).select("src", "rel", "dst")
    return XT.with_ontology_edges(e.where("rel = 'n_regionkey'"), e.where("rel IN ('n_regionkey', 'c_nationkey')"))


@query(f"SELECT DISTINCT event_id::VARCHAR AS src, 'event_type' AS rel, {_ID.format(x='event_type')} AS dst FROM events")
def event_entities(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events").select(F.col("event_id").alias("id"), F.create_map(F.lit("event type"), "event_type", F.lit("none"), F.lit("")).alias("attributes"))
    return XT.event_entities(e)[1]


# --- evolution and audit

_NEWER = O.Ontology(
    {
        "Thing": O.EntityType({"p_name": O.Property("string", True, (O.Constraint("length", (1, 55)),)), "p_note": O.Property("string")}),
        "Part": O.EntityType({"p_brand": O.Property("string", True, (O.Constraint("regex", "Brand#[1-3]"),)), "p_size": O.Property("float", True, (O.Constraint("range", (1, 40)),))}, ("Thing",)),
        "region": O.EntityType(),
        "nation": O.EntityType(),
        "party": O.EntityType(abstract=True),
        "customer": O.EntityType(parents=("party",)),
        "orders": O.EntityType(),
        "invoice": O.EntityType(),
    },
    {"n_regionkey": O.RelationType(("nation",), ("region",), 1, 1), "c_nationkey": O.RelationType(("party", "orders"), ("nation",)), "s_nationkey": O.RelationType(("customer",), ("nation",), symmetric=True)},
)


@query(
    """SELECT * FROM (VALUES ('entity:supplier','removed','major'),('entity:invoice','added','minor'),('entity:Thing.p_name','constraints tightened','major'),('entity:Thing.p_note','property added','minor'),('entity:Part.p_type','property removed','major'),
('entity:Part.p_size','property type changed','major'),('entity:Part.p_size','property newly required','major'),('relation:n_regionkey','cardinality tightened','major'),('relation:c_nationkey','sources widened','minor'),('relation:s_nationkey','symmetric changed','minor')) x(element, change, severity)"""
)
def ontology_changes(spark: SparkSession, d: str) -> DataFrame:
    return EV.change_table(spark, _ONTOLOGY, _NEWER)


@query(
    """SELECT * FROM (VALUES ('removed','major',1::BIGINT,'entity:supplier'),('added','minor',1,'entity:invoice'),('constraints tightened','major',1,'entity:Thing.p_name'),('property added','minor',1,'entity:Thing.p_note'),('property removed','major',1,'entity:Part.p_type'),
('property type changed','major',1,'entity:Part.p_size'),('property newly required','major',1,'entity:Part.p_size'),('cardinality tightened','major',1,'relation:n_regionkey'),('sources widened','minor',1,'relation:c_nationkey'),('symmetric changed','minor',1,'relation:s_nationkey')) x(change, severity, n, text)"""
)
def change_log(spark: SparkSession, d: str) -> DataFrame:
    return EV.change_log(EV.change_table(spark, _ONTOLOGY, _NEWER))


def _parts(spark: SparkSession, d: str) -> DataFrame:
    p = _t(spark, d, "part")
    return p.select("p_partkey", F.split("p_type", " ").getItem(0).alias("type"), F.when(F.col("p_size") > 25, "1.0.0").otherwise("0.9.0").alias("version"), F.create_map(F.lit("brand"), "p_brand", F.lit("size"), F.col("p_size").cast("string")).alias("properties"))


_PLAN = EV.MigrationBuilder("1.0.0", "2.0.0").add("origin", "unknown").rename("brand", "maker").transform("size", lambda v: F.concat(v, F.lit(" cm"))).build()


@query(
    "SELECT p_partkey, CASE WHEN p_size > 25 THEN '2.0.0' ELSE '0.9.0' END AS version, CASE WHEN p_size > 25 THEN p_brand END AS maker, CASE WHEN p_size > 25 THEN 'unknown' END AS origin, CASE WHEN p_size > 25 THEN p_size||' cm' ELSE p_size::VARCHAR END AS size FROM part"
)
def migrated_entities(spark: SparkSession, d: str) -> DataFrame:
    return EV.applied(_parts(spark, d), _PLAN).select("p_partkey", "version", *[F.try_element_at("properties", F.lit(k)).alias(k) for k in ("maker", "origin", "size")])


@query("SELECT string_split(p_type, ' ')[1] AS type, count(*) AS n, count(*) FILTER (WHERE p_size > 25) AS n_concerned, count(*) FILTER (WHERE p_size > 25) AS n_changed FROM part GROUP BY 1")
def migration_dry_run(spark: SparkSession, d: str) -> DataFrame:
    return EV.dry_run(_parts(spark, d), _PLAN)


@query("SELECT p_partkey, CASE WHEN p_size > 25 THEN '1.0.0' ELSE '0.9.0' END AS version, p_brand AS brand, 2::INT AS n FROM part")
def migration_rolled_back(spark: SparkSession, d: str) -> DataFrame:
    plan = EV.MigrationBuilder("1.0.0", "2.0.0").add("origin", "unknown").rename("brand", "maker").build()
    back = EV.rolled_back(EV.applied(_parts(spark, d), plan), plan)
    return back.select("p_partkey", "version", F.try_element_at("properties", F.lit("brand")).alias("brand"), F.size("properties").alias("n"))


@query(
    """SELECT event_id::VARCHAR AS resource_id, coalesce(user_id::VARCHAR, 'unknown') AS actor, 'entity_update' AS event_type, 'update entity '||event_id AS description, CASE WHEN event_type <> 'error' THEN 'info' ELSE 'warning' END AS severity, event_type <> 'error' AS success FROM events"""
)
def audit_entity_events(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events").withColumn("ok", F.col("event_type") != "error")
    log = AW.entity_operations(e.withColumn("state", F.struct("props")), "update", "event_id", "user_id", "ts", after="state", success="ok")
    return log.select("resource_id", "actor", "event_type", "description", "severity", "success")


@query(
    """SELECT count(*) AS n_events, count(*) FILTER (WHERE event_type = 'error') AS n_failed, count(DISTINCT user_id) AS n_actors, date_trunc('second', min(ts))::VARCHAR AS first_ts, date_trunc('second', max(ts))::VARCHAR AS last_ts FROM events"""
)
def audit_stats(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events").withColumn("ok", F.col("event_type") != "error").withColumn("kind", F.when(F.col("event_type") == "error", "auth_failure").otherwise("access"))
    log = AW.security_events(e.withColumn("ts", F.to_timestamp(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))), "kind", "user_id", "ok", "ts")
    return AW.stats(log).select("n_events", "n_failed", "n_actors", F.date_format("first_ts", "yyyy-MM-dd HH:mm:ss").alias("first_ts"), F.date_format("last_ts", "yyyy-MM-dd HH:mm:ss").alias("last_ts"))


@query("SELECT CASE WHEN event_type = 'error' THEN 'critical' ELSE 'info' END AS severity, count(*) AS n FROM events GROUP BY 1")
def audit_security_events(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events").withColumn("ok", F.col("event_type") != "error").withColumn("kind", F.when(F.col("event_type") == "error", "auth_failure").otherwise("access"))
    return AW.security_events(e, "kind", "user_id", "ok", "ts").groupBy("severity").agg(F.count("*").alias("n"))


# --- guided answers and checks


def _knowledge(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Vectors, entities with contents, and edges between neighbouring ids."""
    v = _vectors(spark, d)
    entities = _t(spark, d, "documents").join(v.select("id", "type"), F.col("doc_id") == F.col("id")).select("id", "type", F.concat(F.lit("Doc "), "id").alias("name"), X.title(F.col("text")).alias("content"), F.when(F.col("id") % 5 == 4, 0.5).otherwise(1.0).alias("validity"))
    edges = v.select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit("next").alias("rel"))
    return v, entities, edges


@query(
    """WITH v AS (SELECT vec_id AS id, label::VARCHAR AS type, CAST(embedding AS DOUBLE[]) AS vector FROM embeddings), q AS (SELECT vector AS qv FROM v WHERE id = 0), h AS (SELECT id, list_cosine_similarity(vector, qv) AS r FROM v, q WHERE list_cosine_similarity(vector, qv) >= 0.8 ORDER BY r DESC, id LIMIT 20),
b AS (SELECT id, id + 1 AS other FROM v UNION SELECT id + 1, id FROM v), n AS (SELECT other AS id, max(r) * 0.8 AS r FROM b JOIN h USING (id) GROUP BY other), a AS (SELECT id, r, 0 AS hop FROM h UNION ALL SELECT id, r, 1 FROM n WHERE id NOT IN (SELECT id FROM h))
SELECT a.id, round(r, 6) AS relevance, hop FROM a JOIN documents ON doc_id = a.id JOIN v ON v.id = a.id ORDER BY r DESC, a.id LIMIT 20"""
)
def guided_context(spark: SparkSession, d: str) -> DataFrame:
    v, entities, edges = _knowledge(spark, d)
    return GU.retrieved(v, entities, edges, S.vector_of(v, 0)).entities.select("id", F.round("relevance", 6).alias("relevance"), "hop")


@query(
    """WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vector FROM embeddings), q AS (SELECT vector AS qv FROM v WHERE id = 0), h AS (SELECT id, list_cosine_similarity(vector, qv) AS r FROM v, q WHERE list_cosine_similarity(vector, qv) >= 0.8 ORDER BY r DESC, id LIMIT 20),
b AS (SELECT id, id + 1 AS other FROM v UNION SELECT id + 1, id FROM v), n AS (SELECT other AS id, max(r) * 0.8 AS r FROM b JOIN h USING (id) GROUP BY other), a AS (SELECT id, r FROM h UNION ALL SELECT id, r FROM n WHERE id NOT IN (SELECT id FROM h)),
k AS (SELECT a.id, r, 'Doc '||a.id||': '||array_to_string(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')[1:7], ' ') AS t FROM a JOIN documents ON doc_id = a.id JOIN v ON v.id = a.id ORDER BY r DESC, a.id LIMIT 20), g AS (SELECT * FROM k WHERE r >= 0.7 AND id % 5 <> 4)
SELECT (SELECT string_agg(t, ' ' ORDER BY r DESC, id) FROM (SELECT * FROM g ORDER BY r DESC, id LIMIT 3)) AS answer, (SELECT count(*) FROM g) AS n_sources"""
)
def guided_answer(spark: SparkSession, d: str) -> DataFrame:
    v, entities, edges = _knowledge(spark, d)
    return GU.explained(GU.answered(GU.retrieved(v, entities, edges, S.vector_of(v, 0)))).select("answer", "n_sources")


@query(
    """WITH c AS (SELECT n_nationkey AS id, 'Nation ' || n_name || CASE WHEN n_nationkey % 2 = 0 THEN ' has trade with ' ELSE ' near ' END || r_name || '.' AS claim, n_name, r_name, n_regionkey AS own, r_regionkey AS told FROM nation, region WHERE r_regionkey <= 1)
SELECT id * 2 + told AS id, 0 AS claim_index, CASE WHEN id % 2 = 0 THEN 1 ELSE 0 END::BIGINT AS n_pairs, CASE WHEN id % 2 = 0 AND own = told THEN 1 ELSE 0 END::BIGINT AS n_linked, id % 2 = 1 OR own = told AS is_supported FROM c"""
)
def relations_verified(spark: SparkSession, d: str) -> DataFrame:
    n, r = _t(spark, d, "nation"), _t(spark, d, "region")
    told = n.join(r.where("r_regionkey <= 1"), F.lit(True)).select((F.col("n_nationkey") * 2 + F.col("r_regionkey")).alias("id"), F.lit(0).alias("claim_index"), F.concat(F.lit("Nation "), "n_name", F.when(F.col("n_nationkey") % 2 == 0, " has trade with ").otherwise(" near "), "r_name", F.lit(".")).alias("claim"))
    names = n.select(F.concat(F.lit("nation:"), "n_nationkey").alias("id"), F.col("n_name").alias("name")).unionByName(r.select(F.concat(F.lit("region:"), "r_regionkey").alias("id"), F.col("r_name").alias("name")))
    return R.relations_verified(told, names, _edges(spark, d))


@query(f"WITH {_E} SELECT src, dst, rel, CASE rel WHEN 'o_custkey' THEN 'unknown relation' WHEN 's_nationkey' THEN 'types not allowed' END AS issue, CASE WHEN rel IN ('o_custkey', 's_nationkey') THEN 0.5 ELSE 1.0 END::DOUBLE AS validity FROM edges")
def validated_relations(spark: SparkSession, d: str) -> DataFrame:
    return R.validated_relations(_nodes(spark, d), _edges(spark, d), _ONTOLOGY)


@query("SELECT d.doc_id, 'ontology' AS issue FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE coalesce(quality, 0) <> 1 UNION ALL SELECT doc_id, 'content' FROM documents WHERE length(trim(text)) <= 10 UNION ALL SELECT doc_id, 'stale' FROM documents WHERE lang = 'de'")
def context_issues(spark: SparkSession, d: str) -> DataFrame:
    labels = _t(spark, d, "labels").select("doc_id", (F.col("quality") == 1).alias("ontology_valid"))
    rows = _t(spark, d, "documents").join(labels, "doc_id", "left").select("doc_id", F.lit("n").alias("name"), F.col("text").alias("content"), "ontology_valid", F.to_date(F.when(F.col("lang") == "de", "2020-01-01").otherwise("2024-01-01")).alias("updated_at"))
    return R.context_issues(rows, F.to_date(F.lit("2024-06-01")), "doc_id")


@query(f"WITH {_LINKS} SELECT id, claim_index, coalesce(n, 1)::INT AS n_lines FROM claims LEFT JOIN (SELECT id, claim_index, count(*) AS n FROM links GROUP BY 1, 2) USING (id, claim_index)")
def provenance_lines(spark: SparkSession, d: str) -> DataFrame:
    answers, context = _answers(spark, d)
    claimed = R.claims(answers)
    return R.explained_provenance(claimed, R.provenance(claimed, context)).groupBy("id", "claim_index").agg(F.count("line").cast("int").alias("n_lines"))


# --- embeddings


def _records(spark: SparkSession, d: str) -> DataFrame:
    v = _t(spark, d, "embeddings")
    return v.select(F.col("vec_id").alias("entity_id"), F.lit("content").alias("kind"), F.when(F.col("vec_id") % 50 == 0, 63).otherwise(64).alias("dimensions"), F.when(F.col("vec_id") % 70 != 1, F.col("embedding").cast("array<double>")).alias("vector"))


@query("SELECT vec_id AS entity_id, 'content' AS kind, CASE WHEN vec_id % 70 = 1 THEN 'no vector' ELSE 'wrong length' END AS issue FROM embeddings WHERE vec_id % 70 = 1 OR vec_id % 50 = 0 OR len(embedding) <> 64")
def embedding_problems(spark: SparkSession, d: str) -> DataFrame:
    return EM.problems(_records(spark, d))


@query("SELECT vec_id AS entity_id, 1 + (vec_id % 3 = 0)::INT AS version FROM embeddings")
def embedding_versions(spark: SparkSession, d: str) -> DataFrame:
    r = _records(spark, d)
    entities = r.select("entity_id", F.lit(1).alias("version"), F.to_timestamp(F.lit("2024-01-01")).alias("updated_at"))
    return EM.added(entities, r, r.where("entity_id % 3 = 0").withColumn("kind", F.lit("name")), F.to_timestamp(F.lit("2024-02-01")))[0].select("entity_id", "version")


@query("SELECT vec_id AS entity_id, CASE WHEN vec_id < 10 THEN 'name' ELSE 'content' END AS kind FROM embeddings")
def embeddings_replaced(spark: SparkSession, d: str) -> DataFrame:
    r = _records(spark, d)
    return EM.replaced(r, r.where("entity_id < 10").withColumn("kind", F.lit("name"))).select("entity_id", "kind")


@query("SELECT item_id, 64 AS dimensions, CASE WHEN len(regexp_extract_all(text, '[\\p{L}\\p{N}_\\p{M}]+')) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS norm FROM benchmark")
def hashed_embeddings(spark: SparkSession, d: str) -> DataFrame:
    v = _t(spark, d, "benchmark").select("item_id", EM.hashed(F.col("text")).alias("v"))
    return v.select("item_id", F.size("v").alias("dimensions"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x), 6).alias("norm"))


# --- texts and ids


@query("SELECT doc_id, len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]')) AS n FROM documents")
def offline_token_counts(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", K.count_tokens(F.col("text")).cast("long").alias("n"))


@query("WITH t AS (SELECT doc_id, text, regexp_extract_all(text, '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]') AS x FROM documents) SELECT doc_id, CASE WHEN len(x) <= 20 THEN len(x) ELSE 20 END AS n FROM t")
def trimmed_texts(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", K.count_tokens(K.trimmed(F.col("text"), 20)).cast("long").alias("n"))


@query("SELECT doc_id, text FROM documents")
def character_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Joined again, the chunks give the texts."""
    return K.joined_again(_t(spark, d, "documents"), "character", 300)


@query("SELECT doc_id, text FROM documents")
def code_chunks(spark: SparkSession, d: str) -> DataFrame:
    return K.joined_again(_t(spark, d, "documents"), "code", 200, 0, "python")


@query(f"SELECT n_name, {_ID.format(x=chr(39) + 'is_' + chr(39) + '||replace(lower(n_name), ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + '_' + chr(39) + ')')} AS edge_id, 'is_'||replace(lower(n_name), ' ', '_') AS edge_name FROM nation")
def edge_ids(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.lit("Is "), "n_name")
    return _t(spark, d, "nation").select("n_name", I.edge_id(name).alias("edge_id"), I.edge_name(name).alias("edge_name"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN md5(event_type)[1:8]||'-'||md5(event_type)[9:12]||'-'||md5(event_type)[13:16]||'-'||md5(event_type)[17:20]||'-'||md5(event_type)[21:32] ELSE event_type END AS value, event_id % 2 = 0 AS is_uuid FROM events")
def parsed_ids(spark: SparkSession, d: str) -> DataFrame:
    raw = F.when(F.col("event_id") % 2 == 0, F.upper(F.md5("event_type"))).otherwise(F.col("event_type"))
    return _t(spark, d, "events").select("event_id", I.parsed_id(raw).alias("p")).select("event_id", "p.value", "p.is_uuid")


@query(f"SELECT n_name, {_ID.format(x='n_name')} AS node_id, translate(replace({_ID.format(x='n_name')}, '-', ''), '0123456789abcdef', 'abcdefghijklmnop') AS letters FROM nation")
def lettered_ids(spark: SparkSession, d: str) -> DataFrame:
    u = I.uuid5(F.col("n_name"))
    return _t(spark, d, "nation").select("n_name", I.from_letters(I.letters(u)).alias("node_id"), I.letters(u).alias("letters"))


@query("SELECT r_regionkey, '{\"r_regionkey\":'||r_regionkey||',\"r_name\":\"'||r_name||'\"}' AS json FROM region")
def serialised_rows(spark: SparkSession, d: str) -> DataFrame:
    return Q.serialised(Q.own_properties(_t(spark, d, "region").withColumn("inner", F.struct("r_name"))), "r_regionkey")


# --- catalog, pipelines, evaluation


@query("SELECT sum(n_chars)::BIGINT AS tokens FROM documents")
def token_total(spark: SparkSession, d: str) -> DataFrame:
    return C.token_total(_t(spark, d, "documents"), "n_chars")


@query("SELECT count(*) AS n_datasets, (SELECT count(DISTINCT l_orderkey||'-'||l_linenumber) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey = 7)) AS n_data, count(DISTINCT o_custkey) AS n_owners FROM orders WHERE o_custkey = 7")
def deletion_counts(spark: SparkSession, d: str) -> DataFrame:
    datasets = _t(spark, d, "orders").select(F.col("o_orderkey").alias("dataset_id"), F.col("o_orderpriority").alias("name"), F.col("o_custkey").alias("owner_id"))
    data = _t(spark, d, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("data_id"), F.col("l_orderkey").alias("dataset_id"))
    return C.deletion_counts(datasets, data, owner=7)


@query("SELECT c_custkey AS dataset_id, c_custkey IN (SELECT o_custkey FROM orders) AS has_data FROM customer")
def datasets_with_data(spark: SparkSession, d: str) -> DataFrame:
    return C.with_data(_t(spark, d, "customer").select(F.col("c_custkey").alias("dataset_id")), _t(spark, d, "orders").select(F.col("o_custkey").alias("dataset_id")))


@query(
    f"""WITH w AS (SELECT n_name AS name FROM nation UNION SELECT 'id-'||n_nationkey FROM nation WHERE n_nationkey < 5), e AS (SELECT n_name AS name, 'id-'||n_nationkey AS id FROM nation WHERE n_nationkey < 10)
SELECT coalesce(b.name, w.name) AS name, coalesce(b.id, a.id, {_ID.format(x="w.name||'7t'")}) AS dataset_id, a.id IS NULL AND b.id IS NULL AS created FROM w LEFT JOIN e a ON w.name = a.name LEFT JOIN e b ON w.name = b.id"""
)
def loaded_or_created(spark: SparkSession, d: str) -> DataFrame:
    n = _t(spark, d, "nation").select(F.col("n_name").alias("name"), F.concat(F.lit("id-"), "n_nationkey").alias("dataset_id"), "n_nationkey")
    wanted = n.select("name").union(n.where("n_nationkey < 5").select("dataset_id"))
    return C.loaded_or_created(wanted, n.where("n_nationkey < 10").select("name", "dataset_id"), "7", "t")


@query("SELECT item_id, 'RAG_COMPLETION' AS kind FROM benchmark WHERE item_id % 2 = 0 UNION ALL SELECT item_id, 'SUMMARIES' FROM benchmark WHERE item_id % 2 = 1")
def chosen_searches(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "benchmark").select("item_id", C.chosen_search(F.when(F.col("item_id") % 2 == 1, "Give me an overview of it").otherwise("Tell me of it")).alias("kind"))


@query("SELECT event_type AS kind, count(*) AS n FROM events WHERE event_type IN ('view', 'click') GROUP BY 1")
def search_log(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("text"), "user_id", F.col("ts").alias("created_at"))
    log = C.logged(e.where("text = 'view'"), "view").unionByName(C.logged(e.where("text = 'click'"), "click"))
    return log.groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def pruned_remote(spark: SparkSession, d: str) -> DataFrame:
    return C.pruned(_t(spark, d, "orders").withColumnRenamed("o_custkey", "content_hash"), _t(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("content_hash"))).select("o_orderkey")


@query("SELECT run_id, n FROM (SELECT o_custkey AS run_id, 1 AS n FROM orders WHERE o_custkey % 2 = 0 GROUP BY 1 UNION ALL SELECT o_custkey, 0 FROM orders WHERE o_custkey % 2 = 1 GROUP BY 1)")
def run_metrics(spark: SparkSession, d: str) -> DataFrame:
    runs = _t(spark, d, "orders").select(F.col("o_custkey").alias("run_id")).distinct()
    return C.run_metrics(runs, runs.where("run_id % 2 = 0").withColumn("n", F.lit(1)), spark.createDataFrame([(0,)], "n int"))


@query("SELECT lang AS dataset, count(DISTINCT md5(text)) AS n FROM documents GROUP BY lang")
def added_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents")
    known = docs.where("lang = 'en'").select(F.md5("text").alias("content_hash"), F.col("lang").alias("dataset"), "text").dropDuplicates(["content_hash"])
    for lang in ("en", "de", "fr", "es"):
        known = J.add(known, docs.where(F.col("lang") == lang), lang)
    return known.groupBy("dataset").agg(F.count("*").alias("n"))


@query(f"WITH {_N}, {_E} SELECT count(DISTINCT src||rel||dst) AS n FROM edges")
def indexed_triplets(spark: SparkSession, d: str) -> DataFrame:
    return J.triplet_index(_nodes(spark, d), _edges(spark, d)).agg(F.countDistinct("id").alias("n"))


@query("SELECT doc_id::VARCHAR AS id, '> '||text AS text FROM documents WHERE lang = 'en' AND length(trim(text)) > 0")
def memified(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.when(F.col("lang") == "en", "DocumentChunk").otherwise("Other").alias("type"), "text")
    return J.memify(docs, docs.select("id"), J.subgraph_chunks, (lambda df: df.withColumn("text", F.concat(F.lit("> "), "text")),))


@query(f"SELECT {_ID.format(x='event_id||' + chr(39) + '_enrichment' + chr(39))} AS src, event_id::VARCHAR AS dst, 'enriches_feedback' AS rel FROM events WHERE event_type = 'error' UNION ALL SELECT {_ID.format(x='event_id||' + chr(39) + '_enrichment' + chr(39))}, (event_id - 1)::VARCHAR, 'improves_interaction' FROM events WHERE event_type = 'error'")
def feedback_enrichments(spark: SparkSession, d: str) -> DataFrame:
    pairs = _t(spark, d, "events").where("event_type = 'error'").select(F.col("event_id").alias("feedback_id"), (F.col("event_id") - 1).alias("interaction_id"), F.lit("q").alias("question"), F.lit("a").alias("answer"))
    return Z.enrichment_edges(Z.enriched(pairs, lambda q, a: F.concat(a, F.lit("!")), lambda q, a: F.concat_ws(": ", q, a)))


_WORDS = "list_distinct(list_filter(regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}_\\p{{M}}]+'), lambda w: w NOT IN (" + ", ".join(f"'{w}'" for w in X.STOP_WORDS) + ")))"


@query(f"SELECT a.item_id AS id, round(CASE WHEN len({_WORDS.format(x='b.text')}) = 0 THEN 1.0 ELSE len(list_intersect({_WORDS.format(x='b.text')}, {_WORDS.format(x='a.text')})) / len({_WORDS.format(x='b.text')}) END, 9) AS coverage FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id - a.item_id % 2")
def coverage_scores(spark: SparkSession, d: str) -> DataFrame:
    b = _t(spark, d, "benchmark")
    pairs = b.join(b.select(F.col("item_id").alias("other"), F.col("text").alias("golden_answer")), F.col("other") == F.col("item_id") - F.col("item_id") % 2).select(F.col("item_id").alias("id"), F.col("text").alias("answer"), "golden_answer")
    return Y.evaluated(pairs, ["coverage"], {"coverage": Y.coverage_score}).select("id", F.round("coverage", 9).alias("coverage"))


@query("SELECT r_name||'.'||n_name AS dataset, count(*) AS n_files FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def dataset_folders(spark: SparkSession, d: str) -> DataFrame:
    n = _t(spark, d, "customer").join(_t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(_t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return B.datasets_of(n.select(F.concat_ws("/", F.lit("/data"), "r_name", "n_name", F.concat("c_custkey", F.lit(".txt"))).alias("path")), "/data").select("dataset", "n_files")


@query(f"SELECT c_custkey AS id, x AS name, {_ID.format(x=chr(39) + 'NodeSet:' + chr(39) + '||x')} AS node_set_id FROM (SELECT c_custkey, unnest([c_mktsegment, 'all']) AS x FROM customer)")
def node_sets(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.to_json(F.struct(F.array("c_mktsegment", F.lit("all"), F.lit("all")).alias("node_set"))).alias("metadata"))
    return B.node_sets(rows)


@query("SELECT row_number() OVER (ORDER BY c_custkey) AS number, 'Row '||row_number() OVER (ORDER BY c_custkey)||': c_custkey: '||c_custkey||', c_name: '||c_name AS text FROM customer")
def numbered_rows(spark: SparkSession, d: str) -> DataFrame:
    return B.csv_text(_t(spark, d, "customer"), ["c_custkey", "c_name"], "c_custkey").withColumn("number", F.col("number").cast("long"))


@query("SELECT page_id, page_id % 3 <> 0 AS allowed FROM pages")
def allowed_pages(spark: SparkSession, d: str) -> DataFrame:
    p = _t(spark, d, "pages").select("page_id", F.concat(F.lit("https://site"), F.col("page_id") % 7, F.lit(".org/"), F.when(F.col("page_id") % 3 == 0, "private/").otherwise("public/"), "page_id").alias("url"))
    rules = p.select(B.base_url(F.col("url")).alias("base_url")).distinct().select("base_url", F.lit("*").alias("agent"), F.explode(F.array(F.struct(F.lit("/private").alias("path"), F.lit(False).alias("allow")), F.struct(F.lit("/").alias("path"), F.lit(True).alias("allow")))).alias("r")).select("base_url", "agent", "r.path", "r.allow")
    return p.join(B.allowed_urls(p.select("url"), rules), "url").select("page_id", "allowed")


@query("SELECT page_id, (row_number() OVER (PARTITION BY regexp_extract(url, '^(https?://[^/?#]+)', 1) ORDER BY url) - 1)::DOUBLE AS at FROM pages")
def crawl_times(spark: SparkSession, d: str) -> DataFrame:
    p = _t(spark, d, "pages").select("page_id", "url")
    return B.crawl_times(p, spark.createDataFrame([], "base_url string, delay double")).select("page_id", F.col("at").cast("double").alias("at"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'image' WHEN doc_id % 3 = 1 THEN 'table' ELSE 'text' END AS kind FROM documents")
def guessed_kinds(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.lit("f"), "doc_id", F.when(F.col("doc_id") % 3 == 0, ".PNG").when(F.col("doc_id") % 3 == 1, ".csv").otherwise(""))
    return _t(spark, d, "documents").select("doc_id", B.guessed_kind(name, F.encode("text", "UTF-8")).alias("kind"))
