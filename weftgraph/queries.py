"""Registered queries: operators over the driver's tables, each with SQL that gives the same rows where SQL can say it.

The graph of most of them has the rows of region, nation, customer, supplier and orders as nodes, and their references as edges."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import ids as I
from .functions import temporal as M
from .functions import text as X
from .functions import vectors as V
from .operators import catalog as C
from .operators import chunking as K
from .operators import evaluation as Y
from .operators import feedback as Z
from .operators import graph as G
from .operators import lexical as L
from .operators import matching as W
from .operators import models as Q
from .operators import ontology as O
from .operators import rag as R
from .operators import reasoning as N
from .operators import search as S
from .operators import versioning as A
from .plans import dispatch as P
from .plans import hybrid as H
from .plans import pipelines as J
from .sources import files as B
from .sources import relational as D
from .sources import tables as T
from .streaming import events as E

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with SQL for the same rows."""

    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _ORACLES[f.__name__] = sql.strip()
        return f

    return register


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


_GRAPH = tuple(t for t in D.CATALOG if t.name != "part")


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return D.row_nodes(spark, d, _GRAPH)


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return D.foreign_key_edges(spark, d, _GRAPH)


def _ids(spark: SparkSession, *ids: str) -> DataFrame:
    return spark.createDataFrame([(i,) for i in ids], "id string")


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("type"), F.col("embedding").alias("vector"))


_N = """nodes AS (
 SELECT 'region:'||r_regionkey AS id, 'region' AS type FROM region UNION ALL SELECT 'nation:'||n_nationkey, 'nation' FROM nation
 UNION ALL SELECT 'customer:'||c_custkey, 'customer' FROM customer UNION ALL SELECT 'supplier:'||s_suppkey, 'supplier' FROM supplier
 UNION ALL SELECT 'orders:'||o_orderkey, 'orders' FROM orders)"""
_E = """edges AS (
 SELECT 'nation:'||n_nationkey AS src, 'region:'||n_regionkey AS dst, 'n_regionkey' AS rel FROM nation
 UNION ALL SELECT 'customer:'||c_custkey, 'nation:'||c_nationkey, 'c_nationkey' FROM customer
 UNION ALL SELECT 'supplier:'||s_suppkey, 'nation:'||s_nationkey, 's_nationkey' FROM supplier
 UNION ALL SELECT 'orders:'||o_orderkey, 'customer:'||o_custkey, 'o_custkey' FROM orders)"""
_BOTH = "both_ways AS (SELECT src AS id, dst AS other, rel FROM edges UNION ALL SELECT dst, src, rel FROM edges)"
_VEC = "v AS (SELECT vec_id AS id, CAST(label AS VARCHAR) AS type, CAST(embedding AS DOUBLE[]) AS vector FROM embeddings), q AS (SELECT vector AS qv FROM v WHERE id = 0)"


# --- sources


@query(
    """SELECT 'table:'||n AS id, 'table' AS type, n AS name FROM (VALUES ('region'),('nation'),('customer'),('supplier'),('part'),('orders')) x(n)
UNION ALL SELECT 'region:'||r_regionkey, 'region', 'region:'||r_regionkey FROM region UNION ALL SELECT 'nation:'||n_nationkey, 'nation', 'nation:'||n_nationkey FROM nation
UNION ALL SELECT 'customer:'||c_custkey, 'customer', 'customer:'||c_custkey FROM customer UNION ALL SELECT 'supplier:'||s_suppkey, 'supplier', 'supplier:'||s_suppkey FROM supplier
UNION ALL SELECT 'part:'||p_partkey, 'part', 'part:'||p_partkey FROM part UNION ALL SELECT 'orders:'||o_orderkey, 'orders', 'orders:'||o_orderkey FROM orders
UNION ALL SELECT DISTINCT 'region:r_name:'||r_name, 'value', r_name FROM region UNION ALL SELECT DISTINCT 'nation:n_name:'||n_name, 'value', n_name FROM nation
UNION ALL SELECT DISTINCT 'customer:c_mktsegment:'||c_mktsegment, 'value', c_mktsegment FROM customer
UNION ALL SELECT DISTINCT 'part:p_brand:'||p_brand, 'value', p_brand FROM part UNION ALL SELECT DISTINCT 'part:p_type:'||p_type, 'value', p_type FROM part
UNION ALL SELECT DISTINCT 'orders:o_orderstatus:'||o_orderstatus, 'value', o_orderstatus FROM orders
UNION ALL SELECT DISTINCT 'orders:o_orderpriority:'||o_orderpriority, 'value', o_orderpriority FROM orders"""
)
def migrate_nodes(spark: SparkSession, d: str) -> DataFrame:
    return D.migrated_nodes(spark, d)


@query(
    f"""WITH {_E}, e AS (SELECT rel, src, dst FROM edges
 UNION ALL SELECT 'is_part_of', 'region:'||r_regionkey, 'table:region' FROM region UNION ALL SELECT 'is_part_of', 'nation:'||n_nationkey, 'table:nation' FROM nation
 UNION ALL SELECT 'is_part_of', 'customer:'||c_custkey, 'table:customer' FROM customer UNION ALL SELECT 'is_part_of', 'supplier:'||s_suppkey, 'table:supplier' FROM supplier
 UNION ALL SELECT 'is_part_of', 'part:'||p_partkey, 'table:part' FROM part UNION ALL SELECT 'is_part_of', 'orders:'||o_orderkey, 'table:orders' FROM orders
 UNION ALL SELECT 'r_name', 'region:'||r_regionkey, 'region:r_name:'||r_name FROM region UNION ALL SELECT 'n_name', 'nation:'||n_nationkey, 'nation:n_name:'||n_name FROM nation
 UNION ALL SELECT 'c_mktsegment', 'customer:'||c_custkey, 'customer:c_mktsegment:'||c_mktsegment FROM customer
 UNION ALL SELECT 'p_brand', 'part:'||p_partkey, 'part:p_brand:'||p_brand FROM part UNION ALL SELECT 'p_type', 'part:'||p_partkey, 'part:p_type:'||p_type FROM part
 UNION ALL SELECT 'o_orderstatus', 'orders:'||o_orderkey, 'orders:o_orderstatus:'||o_orderstatus FROM orders
 UNION ALL SELECT 'o_orderpriority', 'orders:'||o_orderkey, 'orders:o_orderpriority:'||o_orderpriority FROM orders)
SELECT src, dst, rel FROM e"""
)
def migrate_edges(spark: SparkSession, d: str) -> DataFrame:
    return D.migrated_edges(spark, d)


@query(
    """SELECT * FROM (VALUES ('table:region','database','is_part_of'),('table:nation','database','is_part_of'),('table:customer','database','is_part_of'),('table:supplier','database','is_part_of'),('table:part','database','is_part_of'),('table:orders','database','is_part_of'),
('table:nation','relationship:nation.n_regionkey','has_relationship'),('table:region','relationship:nation.n_regionkey','has_relationship'),('table:nation','table:region','foreign_key'),
('table:customer','relationship:customer.c_nationkey','has_relationship'),('table:nation','relationship:customer.c_nationkey','has_relationship'),('table:customer','table:nation','foreign_key'),
('table:supplier','relationship:supplier.s_nationkey','has_relationship'),('table:nation','relationship:supplier.s_nationkey','has_relationship'),('table:supplier','table:nation','foreign_key'),
('table:orders','relationship:orders.o_custkey','has_relationship'),('table:customer','relationship:orders.o_custkey','has_relationship'),('table:orders','table:customer','foreign_key')) x(src,dst,rel)"""
)
def migrate_schema(spark: SparkSession, d: str) -> DataFrame:
    return D.schema_edges(spark)


@query(
    """SELECT 'orders:'||l_orderkey AS src, 'part:'||l_partkey AS dst, 'l_partkey' AS rel, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem GROUP BY l_orderkey, l_partkey
UNION ALL SELECT 'orders:'||l_orderkey, 'supplier:'||l_suppkey, 'l_suppkey', count(*), sum(l_quantity) FROM lineitem GROUP BY l_orderkey, l_suppkey"""
)
def migrate_line_items(spark: SparkSession, d: str) -> DataFrame:
    return D.relationship_edges(spark, d).select("src", "dst", "rel", "n", "quantity")


@query(
    """SELECT 'region' AS table_name, count(*) AS n_rows, 2 AS n_columns, 'r_regionkey' AS primary_key, 0 AS n_references FROM region UNION ALL SELECT 'nation', count(*), 3, 'n_nationkey', 1 FROM nation
UNION ALL SELECT 'customer', count(*), 5, 'c_custkey', 1 FROM customer UNION ALL SELECT 'supplier', count(*), 4, 's_suppkey', 1 FROM supplier UNION ALL SELECT 'part', count(*), 6, 'p_partkey', 0 FROM part UNION ALL SELECT 'orders', count(*), 6, 'o_orderkey', 1 FROM orders"""
)
def schema_profile(spark: SparkSession, d: str) -> DataFrame:
    return D.profile(spark, d)


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH')")
def filtered_scan(spark: SparkSession, d: str) -> DataFrame:
    return D.filtered_rows(_t(spark, d, "orders"), o_orderstatus="F", o_orderpriority=["1-URGENT", "2-HIGH"]).select("o_orderkey", "o_custkey", "o_orderstatus")


@query("SELECT n_nationkey, 'n_nationkey: '||n_nationkey||', n_name: '||n_name||', n_regionkey: '||n_regionkey AS text FROM nation")
def rows_as_text(spark: SparkSession, d: str) -> DataFrame:
    return B.rows_as_text(_t(spark, d, "nation"), ["n_nationkey", "n_name", "n_regionkey"]).select("n_nationkey", "text")


@query(
    """SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS base_url, regexp_extract(url, '^https?://[^/?#]+(/[^?#]*)?', 1) AS path, sha256(html) AS content_hash, substr(html, 1, 500) AS preview,
count(*) OVER (PARTITION BY regexp_extract(url, '^(https?://[^/?#]+)', 1)) AS n_pages FROM pages"""
)
def web_page_nodes(spark: SparkSession, d: str) -> DataFrame:
    return B.page_nodes(_t(spark, d, "pages"))


@query("SELECT doc_id, md5(text) AS content_hash, octet_length(encode(text)) AS size, strpos(text, chr(0)) = 0 AS is_text FROM documents")
def content_metadata(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", F.md5("text").alias("content_hash"), F.octet_length("text").cast("long").alias("size"), (F.instr(F.col("text"), "\u0000") == 0).alias("is_text"))


@query(
    """WITH k AS (SELECT md5(text) AS h, bool_or(source = 'src1') AS here FROM documents WHERE lang = 'en' GROUP BY 1)
SELECT d.doc_id, CASE WHEN k.h IS NULL THEN 'new' WHEN k.here THEN 'known' ELSE 'other_dataset' END AS status FROM documents d LEFT JOIN k ON md5(d.text) = k.h"""
)
def ingest_status(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents").select("doc_id", "lang", F.md5("text").alias("h"), F.col("source").alias("dataset"))
    return B.new_and_known(docs.select("doc_id", "h"), docs.where("lang = 'en'").select("h", "dataset"), "h", "src1").select("doc_id", "status")


@query(
    """WITH s AS (SELECT n_name, sha1(unhex('6ba7b8129dad11d180b400c04fd430c8') || encode(lower(replace(n_name, ' ', '_')))) AS h FROM nation)
SELECT n_name, substr(h,1,8)||'-'||substr(h,9,4)||'-5'||substr(h,14,3)||'-'||lower(printf('%x', (('0x'||substr(h,17,2))::INT & 63) | 128))||substr(h,19,2)||'-'||substr(h,21,12) AS node_id FROM s"""
)
def node_ids(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "nation").select("n_name", I.node_id(F.col("n_name")).alias("node_id"))


# --- changes


def _customer_rows(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = _t(spark, d, "customer")
    old = c.where("c_acctbal >= 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit(1).alias("created_at"), F.lit(1).alias("updated_at"))
    new = c.where("c_mktsegment IN ('BUILDING', 'MACHINERY')").select(F.col("c_custkey").alias("id"), F.upper("c_mktsegment").alias("name"), F.lit(2).alias("created_at"), F.lit(2).alias("updated_at"))
    return old, new


_OLD_NEW = "o AS (SELECT c_custkey AS id, c_name AS name, 1 AS created_at, 1 AS updated_at FROM customer WHERE c_acctbal >= 0), n AS (SELECT c_custkey AS id, upper(c_mktsegment) AS name, 2 AS created_at, 2 AS updated_at FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY'))"


@query(f"WITH {_OLD_NEW} SELECT coalesce(n.id, o.id) AS id, coalesce(n.name, o.name) AS name, coalesce(o.created_at, n.created_at) AS created_at, coalesce(n.updated_at, o.updated_at) AS updated_at FROM o FULL JOIN n ON o.id = n.id")
def upsert_nodes(spark: SparkSession, d: str) -> DataFrame:
    return G.merged_nodes(*_customer_rows(spark, d))


@query(f"WITH {_OLD_NEW} SELECT * FROM o UNION ALL SELECT * FROM n WHERE id NOT IN (SELECT id FROM o)")
def insert_new_nodes(spark: SparkSession, d: str) -> DataFrame:
    return G.appended(*_customer_rows(spark, d))


@query(f"WITH {_E}, gone AS (SELECT 'nation:'||n_nationkey AS id FROM nation WHERE n_regionkey = 1) SELECT * FROM edges WHERE src NOT IN (SELECT id FROM gone) AND dst NOT IN (SELECT id FROM gone)")
def delete_nodes(spark: SparkSession, d: str) -> DataFrame:
    gone = _t(spark, d, "nation").where("n_regionkey = 1").select(F.concat(F.lit("nation:"), "n_nationkey").alias("id"))
    return G.without_nodes(_nodes(spark, d), _edges(spark, d), gone)[1]


@query(f"WITH {_E} SELECT * FROM edges WHERE NOT (rel = 'c_nationkey' AND dst IN ('nation:1', 'nation:2'))")
def delete_in_edges(spark: SparkSession, d: str) -> DataFrame:
    return G.without_in_edges(_edges(spark, d), _ids(spark, "nation:1", "nation:2"), "c_nationkey").select("src", "dst", "rel")


@query(f"WITH {_E} SELECT src, dst, rel, CASE WHEN rel = 'n_regionkey' AND dst = 'region:1' THEN 0.5 ELSE 0.0 END + CASE WHEN rel = 'n_regionkey' AND src = 'nation:1' THEN 1.0 ELSE 0.0 END AS weight FROM edges")
def feedback_weights(spark: SparkSession, d: str) -> DataFrame:
    edges = _edges(spark, d).withColumn("weight", F.lit(0.0))
    return G.feedback_applied(edges, spark.createDataFrame([("region:1", 0.5), ("nation:1", 0.75), ("nation:1", 0.25)], "id string, weight double"), "n_regionkey")


@query(f"WITH {_E} SELECT rel AS text, count(*) AS n_edges FROM edges GROUP BY rel")
def edge_type_index(spark: SparkSession, d: str) -> DataFrame:
    return G.edge_types(_edges(spark, d))


@query(f"WITH {_E} SELECT DISTINCT src, rel, dst, src||' -> '||rel||' -> '||dst AS text FROM edges")
def triplet_texts(spark: SparkSession, d: str) -> DataFrame:
    return G.triplets(_nodes(spark, d), _edges(spark, d))


@query("SELECT c_custkey AS id, 'customer_name' AS collection, c_name AS text FROM customer UNION ALL SELECT c_custkey, 'customer_segment', c_mktsegment FROM customer")
def index_rows(spark: SparkSession, d: str) -> DataFrame:
    c = _t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("customer_name"), F.col("c_mktsegment").alias("customer_segment"))
    return c.unpivot("id", ["customer_name", "customer_segment"], "collection", "text").where("text is not null")


@query("SELECT doc_id, count(*) OVER (PARTITION BY md5(text)) = 1 AS sole_referrer FROM documents")
def sole_referrers(spark: SparkSession, d: str) -> DataFrame:
    return T.sole_referrers(_t(spark, d, "documents"), "doc_id", F.md5("text"))


# --- vectors


@query(f"WITH {_VEC} SELECT id, round(list_distance(vector, qv) * list_distance(vector, qv), 6) AS distance FROM v, q ORDER BY list_distance(vector, qv), id LIMIT 15")
def knn_l2(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    return S.nearest(v, S.vector_of(v, 0)).select("id", F.round("distance", 6).alias("distance"))


@query(f"WITH {_VEC} SELECT id, round(1 - list_cosine_similarity(vector, qv), 6) AS distance FROM v, q ORDER BY list_cosine_similarity(vector, qv) DESC, id LIMIT 15")
def knn_cosine(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    return S.nearest(v, S.vector_of(v, 0), metric="cosine").select("id", F.round("distance", 6).alias("distance"))


@query(f"WITH {_VEC}, t AS (SELECT id, list_distance(vector, qv) ** 2 AS x FROM v, q ORDER BY 2, id LIMIT 15) SELECT id, round((x - min(x) OVER ()) / (max(x) OVER () - min(x) OVER ()), 6) AS distance FROM t")
def knn_normalised(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    return S.nearest(v, S.vector_of(v, 0), normalised=True).select("id", F.round("distance", 6).alias("distance"))


@query(
    f"""WITH {_VEC}, p AS (SELECT a.id AS query, b.id AS id, list_cosine_similarity(b.vector, a.vector) AS s FROM v a, v b WHERE a.id % 100 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, id) AS rank FROM p)
SELECT query, id, round(s, 6) AS similarity, rank FROM r WHERE rank <= 5"""
)
def knn_batch(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    return S.batch_nearest(v, v.where("id % 100 = 0"), 5).select("query", "id", F.round("similarity", 6).alias("similarity"), "rank")


@query("SELECT vec_id AS id, CAST(label AS VARCHAR) AS type, 0.0::DOUBLE AS score FROM embeddings WHERE vec_id IN (1, 5, 9)")
def retrieve_vectors(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, d).where(F.col("id").isin(1, 5, 9)).select("id", "type", F.lit(0.0).alias("score"))


@query(f"WITH {_VEC}, t AS (SELECT id, list_cosine_similarity(vector, qv) AS s FROM v, q WHERE list_cosine_similarity(vector, qv) >= 0.1 ORDER BY s DESC, id LIMIT 10) SELECT id, round(s, 6) AS similarity FROM t WHERE id <> 0")
def similar_entities(spark: SparkSession, d: str) -> DataFrame:
    return S.similar_entities(_vectors(spark, d), 0, 10, 0.1).select("id", F.round("similarity", 6).alias("similarity"))


@query(
    f"WITH {_VEC}, t AS (SELECT id, list_cosine_similarity(vector, qv) AS s FROM v, q WHERE type IN ('1', '2') ORDER BY s DESC, id LIMIT 15) SELECT id, round(s, 6) AS similarity, round(s * 0.8, 6) AS confidence FROM t WHERE id <> 0 ORDER BY s DESC, id LIMIT 5"
)
def suggested_relations(spark: SparkSession, d: str) -> DataFrame:
    return S.suggested_relations(_vectors(spark, d), 0, ["1", "2"]).select("id", F.round("similarity", 6).alias("similarity"), F.round("confidence", 6).alias("confidence"))


@query(
    f"""WITH {_VEC}, g AS (SELECT list_transform(list_zip(c.vector, b.vector, a.vector), lambda x: x[1] + (x[2] - x[3])) AS t FROM v a, v b, v c WHERE a.id = 1 AND b.id = 2 AND c.id = 3),
k AS (SELECT id, list_cosine_similarity(vector, t) AS s FROM v, g WHERE list_cosine_similarity(vector, t) >= 0.1 ORDER BY s DESC, id LIMIT 6)
SELECT id, round(s, 6) AS similarity, round(s * 0.7, 6) AS confidence FROM k WHERE id <> 3 ORDER BY s DESC, id LIMIT 5"""
)
def analogies(spark: SparkSession, d: str) -> DataFrame:
    return S.analogies(_vectors(spark, d), 1, 2, 3, threshold=0.1).select("id", F.round("similarity", 6).alias("similarity"), F.round("confidence", 6).alias("confidence"))


@query(
    f"""WITH {_VEC}, k AS (SELECT id, type, list_cosine_similarity(vector, qv) AS s FROM v, q WHERE list_cosine_similarity(vector, qv) >= 0.0 ORDER BY s DESC, id LIMIT 50)
SELECT type, round(avg(s), 6) AS mean_similarity, count(*) AS n FROM k WHERE id <> 0 GROUP BY type ORDER BY avg(s) DESC, type LIMIT 3"""
)
def inferred_types(spark: SparkSession, d: str) -> DataFrame:
    return S.inferred_types(_vectors(spark, d), 0, threshold=0.0).select("type", F.round("mean_similarity", 6).alias("mean_similarity"), "n")


# --- hybrid


def _similar_graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Customers with vectors, one for each key that has one, in the graph of all rows."""
    v = _vectors(spark, d).select(F.concat(F.lit("customer:"), "id").alias("id"), "type", "vector")
    return v, _nodes(spark, d), _edges(spark, d)


_CV = "v AS (SELECT 'customer:'||vec_id AS id, CAST(label AS VARCHAR) AS type, CAST(embedding AS DOUBLE[]) AS vector FROM embeddings)"
_SUB = """w1 AS (SELECT id, 0 AS depth FROM seeds UNION SELECT b.other, 1 FROM both_ways b JOIN seeds s ON b.id = s.id), w2 AS (SELECT id, depth FROM w1 UNION SELECT b.other, 2 FROM both_ways b JOIN w1 w ON b.id = w.id),
near AS (SELECT id, min(depth) AS depth FROM w2 JOIN nodes USING (id) GROUP BY id ORDER BY depth, id LIMIT 100), kept AS (SELECT src, dst, rel FROM edges WHERE src IN (SELECT id FROM near) AND dst IN (SELECT id FROM near) ORDER BY src, dst, rel LIMIT 200)"""
_CENTRAL = "deg AS (SELECT id, count(*) AS n FROM (SELECT src AS id FROM kept UNION ALL SELECT dst FROM kept) GROUP BY id), c AS (SELECT id, n / max(n) OVER () AS c FROM deg)"


@query(
    f"""WITH {_N}, {_E}, {_BOTH}, {_CV}, q AS (SELECT vector AS qv FROM v WHERE id = 'customer:1'), found AS (SELECT id, list_cosine_similarity(vector, qv) AS s FROM v, q ORDER BY s DESC, id LIMIT 50),
seeds AS (SELECT id FROM found ORDER BY s DESC, id LIMIT 10), {_SUB}, {_CENTRAL}, r AS (SELECT f.id, s, coalesce(c, 0.0) AS c, 0.7 * s + 0.3 * coalesce(c, 0.0) AS score FROM found f LEFT JOIN c ON f.id = c.id)
SELECT id, round(score, 6) AS score, round(c, 6) AS centrality, printf('similarity %.2f | centrality %.2f | relevance %.2f', s, c, score) AS explanation FROM r ORDER BY r.score DESC, id LIMIT 20"""
)
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    v, nodes, edges = _similar_graph(spark, d)
    q = H.HybridQueryBuilder().with_vector(S.vector_of(v, "customer:1")).with_top_k(50).with_max_results(20).build()
    return H.run(q, v, nodes, edges).select("id", F.round("score", 6).alias("score"), F.round("centrality", 6).alias("centrality"), "explanation")


@query(
    """WITH v AS (SELECT 'customer:'||vec_id AS id, CAST(embedding AS DOUBLE[]) AS vector FROM embeddings), q AS (SELECT vector AS qv FROM v WHERE id = 'customer:1'),
k AS (SELECT id, list_cosine_similarity(vector, qv) AS s FROM v, q ORDER BY s DESC, id LIMIT 50),
e AS (SELECT 'nation:'||n_nationkey AS src, 'region:'||n_regionkey AS dst FROM nation UNION ALL SELECT 'customer:'||c_custkey, 'nation:'||c_nationkey FROM customer UNION ALL SELECT 'supplier:'||s_suppkey, 'nation:'||s_nationkey FROM supplier UNION ALL SELECT 'orders:'||o_orderkey, 'customer:'||o_custkey FROM orders),
g AS (SELECT id, count(*) AS n FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY id), c AS (SELECT id, n / max(n) OVER () AS c FROM g)
SELECT k.id, round(0.7 * s + 0.3 * coalesce(c, 0), 6) AS score FROM k LEFT JOIN c ON k.id = c.id ORDER BY 0.7 * s + 0.3 * coalesce(c, 0) DESC, k.id LIMIT 20"""
)
def hybrid_ranked(spark: SparkSession, d: str) -> DataFrame:
    v, _, edges = _similar_graph(spark, d)
    found = S.most_similar(v, S.vector_of(v, "customer:1"), 50).select("id", "similarity")
    return S.ranked(found, S.centrality(edges), k=20).select("id", F.round("score", 6).alias("score"))


@query(
    f"""WITH {_N}, {_E}, {_BOTH}, a1 AS (SELECT 'nation:3' AS id UNION SELECT other FROM both_ways WHERE id = 'nation:3'), found AS (SELECT id FROM nodes WHERE id IN (SELECT id FROM a1 UNION SELECT b.other FROM both_ways b JOIN a1 ON b.id = a1.id)),
seeds AS (SELECT id FROM found ORDER BY id LIMIT 10), {_SUB}, {_CENTRAL} SELECT f.id, round(coalesce(c, 0.0), 6) AS score FROM found f LEFT JOIN c ON f.id = c.id ORDER BY coalesce(c, 0.0) DESC, f.id LIMIT 20"""
)
def graph_only_search(spark: SparkSession, d: str) -> DataFrame:
    v, nodes, edges = _similar_graph(spark, d)
    return H.run(H.HybridQueryBuilder().graph_only("nation:3").with_max_results(20).build(), v, nodes, edges).select("id", F.round("score", 6).alias("score"))


@query(
    f"""WITH {_N}, {_E}, d AS (SELECT 'customer:'||vec_id AS id, list_distance(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 1)) ** 2 AS x FROM embeddings),
h AS (SELECT id, x FROM d ORDER BY x, id LIMIT 100), s AS (SELECT id, (x - min(x) OVER ()) / (max(x) OVER () - min(x) OVER ()) AS x FROM h),
t AS (SELECT src, rel, dst, coalesce(a.x, 3.5) + coalesce(b.x, 3.5) + 3.5 AS score FROM edges LEFT JOIN s a ON src = a.id LEFT JOIN s b ON dst = b.id WHERE a.id IS NOT NULL OR b.id IS NOT NULL)
SELECT src, rel, dst, round(score, 6) AS score FROM t ORDER BY t.score, src, dst, rel LIMIT 5"""
)
def triplet_search(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: nearest entities, the edges around them, and the triplets that they make likeliest."""
    v = _vectors(spark, d).select(F.concat(F.lit("customer:"), "id").alias("id"), "vector")
    hits = S.nearest(v, S.vector_of(v, "customer:1"), 100, normalised=True).select("id", "distance")
    around = G.touching(_edges(spark, d), F.broadcast(hits.select("id")))
    none = spark.createDataFrame([], "id string, distance double")
    return G.top_triplets(around, hits, none, 5).select("src", "rel", "dst", F.round("score", 6).alias("score"))


# --- graph


@query(f"WITH {_E}, {_BOTH} SELECT DISTINCT id, other FROM both_ways WHERE id IN ('nation:1', 'customer:7')")
def neighbours(spark: SparkSession, d: str) -> DataFrame:
    return G.neighbours(_edges(spark, d), _ids(spark, "nation:1", "customer:7"))


@query(f"WITH {_E} SELECT dst AS id, src AS other, rel FROM edges WHERE dst = 'nation:1' AND rel = 's_nationkey'")
def predecessors(spark: SparkSession, d: str) -> DataFrame:
    return G.predecessors(_edges(spark, d), _ids(spark, "nation:1"), "s_nationkey")


@query(f"WITH {_E} SELECT src AS id, dst AS other, rel FROM edges WHERE src IN ('customer:7', 'nation:1')")
def successors(spark: SparkSession, d: str) -> DataFrame:
    return G.successors(_edges(spark, d), _ids(spark, "customer:7", "nation:1"))


@query(f"WITH {_N}, {_E} SELECT e.src, e.dst, e.rel, a.type AS src_type, b.type AS dst_type FROM edges e JOIN nodes a ON e.src = a.id JOIN nodes b ON e.dst = b.id WHERE src = 'nation:2' OR dst = 'nation:2'")
def connections(spark: SparkSession, d: str) -> DataFrame:
    return G.connections(_nodes(spark, d), _edges(spark, d), _ids(spark, "nation:2")).select("src", "dst", "rel", "src_type", "dst_type")


@query(f"WITH {_E} SELECT DISTINCT src, dst, rel FROM edges WHERE (src, dst, rel) IN (('nation:0', 'region:0', 'n_regionkey'), ('nation:0', 'region:1', 'n_regionkey'), ('nation:1', 'region:1', 'n_regionkey'))")
def has_edges(spark: SparkSession, d: str) -> DataFrame:
    wanted = spark.createDataFrame([("nation:0", "region:0", "n_regionkey"), ("nation:0", "region:1", "n_regionkey"), ("nation:1", "region:1", "n_regionkey")], "src string, dst string, rel string")
    return G.has_edges(wanted, _edges(spark, d))


@query(
    f"""WITH {_N}, {_E}, {_BOTH}, s AS (SELECT id FROM nodes WHERE type = 'nation' AND id IN ('nation:3', 'nation:4')), k AS (SELECT id FROM s UNION SELECT other FROM both_ways WHERE id IN (SELECT id FROM s))
SELECT src, dst, rel FROM edges WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k)"""
)
def nodeset_subgraph(spark: SparkSession, d: str) -> DataFrame:
    return G.nodeset_subgraph(_nodes(spark, d), _edges(spark, d), "nation", ["nation:3", "nation:4"])[1].select("src", "dst", "rel")


@query(f"WITH {_N}, {_E}, k AS (SELECT id FROM nodes WHERE type IN ('nation', 'region')) SELECT src, dst, rel FROM edges WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k)")
def filtered_graph(spark: SparkSession, d: str) -> DataFrame:
    return G.filtered_graph(_nodes(spark, d), _edges(spark, d), F.col("type").isin("nation", "region"))[1].select("src", "dst", "rel")


@query(f"WITH {_E} SELECT src, dst, rel FROM edges WHERE src IN ('nation:1', 'region:2') OR dst IN ('nation:1', 'region:2')")
def id_filtered_graph(spark: SparkSession, d: str) -> DataFrame:
    return G.touching(_edges(spark, d), _ids(spark, "nation:1", "region:2")).select("src", "dst", "rel")


@query(f"WITH {_N}, {_E} SELECT id, type FROM nodes WHERE id NOT IN (SELECT src FROM edges UNION SELECT dst FROM edges WHERE rel <> 'o_custkey') AND type = 'customer' UNION ALL SELECT id, type FROM nodes WHERE type <> 'customer' AND id NOT IN (SELECT src FROM edges UNION SELECT dst FROM edges)")
def disconnected_nodes(spark: SparkSession, d: str) -> DataFrame:
    return G.disconnected(_nodes(spark, d), _edges(spark, d)).select("id", "type")


@query(f"WITH {_N}, {_E}, g AS (SELECT id, count(*) AS n FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY id) SELECT nodes.id FROM nodes JOIN g ON nodes.id = g.id WHERE type = 'customer' AND n = 1")
def degree_one_nodes(spark: SparkSession, d: str) -> DataFrame:
    return G.degree_one(_nodes(spark, d), _edges(spark, d), "customer").select("id")


@query(f"WITH {_E} SELECT src, rel, dst FROM edges ORDER BY src, rel, dst LIMIT 25 OFFSET 50")
def triplet_page(spark: SparkSession, d: str) -> DataFrame:
    return G.page(_edges(spark, d).select("src", "rel", "dst"), ["src", "rel", "dst"], 50, 25)


@query("SELECT event_id, ts FROM events WHERE event_type = 'click' ORDER BY ts DESC, event_id LIMIT 10")
def last_interactions(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "events").where("event_type = 'click'").orderBy(F.desc("ts"), "event_id").limit(10).select("event_id", "ts")


@query("SELECT event_id, epoch_us(ts) // 1000 AS time_at FROM events WHERE epoch_us(ts) // 1000 BETWEEN 1704240000000 AND 1704326400000")
def time_ids(spark: SparkSession, d: str) -> DataFrame:
    at = M.epoch_millis(F.col("ts"))
    return _t(spark, d, "events").select("event_id", at.alias("time_at")).where(F.col("time_at").between(1704240000000, 1704326400000))


@query("SELECT event_id, epoch_us(ts) // 1000 AS time_at, year(ts)::INT AS year, month(ts)::INT AS month, day(ts)::INT AS day, hour(ts)::INT AS hour, strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp_str FROM events")
def timestamp_nodes(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "events").select("event_id", M.parts(F.col("ts")).alias("p")).select("event_id", "p.time_at", "p.year", "p.month", "p.day", "p.hour", "p.timestamp_str")


@query(f"WITH {_N}, {_E}, {_BOTH}, one AS (SELECT DISTINCT other AS id FROM both_ways WHERE id = 'nation:5'), two AS (SELECT DISTINCT other AS id FROM both_ways WHERE id IN (SELECT id FROM one)) SELECT id FROM nodes WHERE type = 'orders' AND id IN (SELECT id FROM one UNION SELECT id FROM two)")
def events_within_two_hops(spark: SparkSession, d: str) -> DataFrame:
    near = G.reached(_edges(spark, d), _ids(spark, "nation:5"), 2).where("depth > 0").select("id")
    return _nodes(spark, d).where("type = 'orders'").join(near, "id", "left_semi").select("id")


@query(
    f"""WITH RECURSIVE {_E}, {_BOTH}, walk AS (SELECT 'customer:7' AS id, 0 AS depth UNION SELECT b.other, depth + 1 FROM walk w JOIN both_ways b ON w.id = b.id WHERE depth < 2)
SELECT id, min(depth) AS depth FROM walk GROUP BY id"""
)
def breadth_first(spark: SparkSession, d: str) -> DataFrame:
    return G.reached(_edges(spark, d), _ids(spark, "customer:7"), 2)


@query(f"WITH {_N}, {_E}, {_BOTH}, seeds AS (SELECT 'nation:3' AS id), {_SUB} SELECT * FROM kept")
def bounded_subgraph(spark: SparkSession, d: str) -> DataFrame:
    return G.subgraph(_nodes(spark, d), _edges(spark, d), _ids(spark, "nation:3"), 2, 100, 200)[1].select("src", "dst", "rel")


@query(
    f"""WITH {_N}, {_E}, n AS (SELECT count(*) AS n FROM nodes), e AS (SELECT count(*) AS e FROM edges), r AS (SELECT 'region:'||r_regionkey AS r, 1 + count(DISTINCT n_nationkey) + count(DISTINCT c_custkey) + count(DISTINCT o_orderkey) AS s FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1),
p AS (SELECT 'region:'||n_regionkey AS r, count(*) AS s FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1)
SELECT n AS num_nodes, e AS num_edges, 2.0 * e / n AS mean_degree, e / (n * (n - 1.0)) AS edge_density, (SELECT count(*) FROM r) AS num_components, (SELECT max(r.s + coalesce(p.s, 0)) FROM r LEFT JOIN p ON r.r = p.r)::BIGINT AS largest_component, 0::BIGINT AS num_selfloops FROM n, e"""
)
def graph_metrics(spark: SparkSession, d: str) -> DataFrame:
    return G.metrics(_nodes(spark, d), _edges(spark, d))


@query(
    f"""WITH RECURSIVE {_N}, {_E}, up AS (SELECT id, id AS top FROM nodes UNION ALL SELECT u.id, e.dst FROM up u JOIN edges e ON u.top = e.src), t AS (SELECT id, max(top) FILTER (WHERE top LIKE 'region:%') AS r FROM up GROUP BY id)
SELECT id, min(id) OVER (PARTITION BY r) AS component FROM t"""
)
def connected_components(spark: SparkSession, d: str) -> DataFrame:
    return G.components(_nodes(spark, d), _edges(spark, d))


_CO = "pairs AS (SELECT DISTINCT a.l_suppkey AS a, b.l_suppkey AS b FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey)"


def _supplier_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers that share an order; an order has a few lines, so its pairs are few."""
    x = _t(spark, d, "lineitem").select("l_orderkey", "l_suppkey").distinct()
    return x.join(x.withColumnRenamed("l_suppkey", "other"), "l_orderkey").where("l_suppkey < other").select(F.col("l_suppkey").alias("src"), F.col("other").alias("dst"), F.lit("co").alias("rel")).distinct()


@query(
    f"""WITH {_CO}, bi AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs), k AS (SELECT a AS id, count(*) AS k FROM bi GROUP BY a),
t AS (SELECT x.a AS id, count(*) AS n FROM bi x JOIN bi y ON x.a = y.a AND x.b < y.b JOIN pairs p ON p.a = x.b AND p.b = y.b GROUP BY x.a)
SELECT k.id, coalesce(n, 0) AS triangles, round(2.0 * coalesce(n, 0) / (k * (k - 1)), 9) AS coefficient FROM k LEFT JOIN t ON k.id = t.id WHERE k > 1"""
)
def clustering(spark: SparkSession, d: str) -> DataFrame:
    return G.clustering(_supplier_pairs(spark, d)).select("id", F.col("triangles").cast("long").alias("triangles"), F.round("coefficient", 9).alias("coefficient"))


@query(
    f"""WITH RECURSIVE {_E}, {_BOTH}, w AS (SELECT 'nation:1' AS source, 'nation:1' AS id, 0 AS distance UNION SELECT source, other, distance + 1 FROM w JOIN both_ways b ON w.id = b.id WHERE distance < 4)
SELECT source, id, min(distance) AS distance FROM w WHERE id <> source GROUP BY source, id"""
)
def shortest_paths(spark: SparkSession, d: str) -> DataFrame:
    return G.path_lengths(_edges(spark, d), _ids(spark, "nation:1"), 4)


@query(f"WITH {_N} SELECT id, type, id AS label FROM nodes")
def formatted_nodes(spark: SparkSession, d: str) -> DataFrame:
    return G.formatted(_nodes(spark, d))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_shipdate, l_quantity) AS r FROM lineitem) WHERE r = 1")
def keep_first(spark: SparkSession, d: str) -> DataFrame:
    return G.first_of_each(_t(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_shipdate", "l_quantity"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


# --- reasoning and ontology


def _located(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d).where("rel <> 'o_custkey'").select("src", "dst", F.lit("LOCATED_IN").alias("rel"))


@query(
    f"""WITH {_E}, l AS (SELECT DISTINCT src, dst FROM edges WHERE rel <> 'o_custkey') SELECT DISTINCT a.src, b.dst, 'LOCATED_IN' AS rel, 2 AS depth FROM l a JOIN l b ON a.dst = b.src WHERE (a.src, b.dst) NOT IN (SELECT (src, dst) FROM l)"""
)
def transitive_inference(spark: SparkSession, d: str) -> DataFrame:
    return N.transitive(_located(spark, d), ["LOCATED_IN"])


_TRADE = "trade AS (SELECT c_nationkey AS src, s_nationkey AS dst, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2), p AS (SELECT src, dst FROM trade WHERE n > (SELECT avg(n) FROM trade))"


@query(f"WITH {_TRADE} SELECT dst AS src, src AS dst, 'RELATED_TO' AS rel FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b.src = a.dst AND b.dst = a.src)")
def symmetric_inference(spark: SparkSession, d: str) -> DataFrame:
    """Nations that trade more than pairs of nations do on average."""
    lines = _t(spark, d, "lineitem").join(_t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(_t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(_t(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    trade = lines.groupBy(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")).agg(F.count("*").alias("n"))
    often = trade.join(trade.agg(F.avg("n").alias("mean")), F.col("n") > F.col("mean"))
    return N.symmetric(often.select("src", "dst", F.lit("RELATED_TO").alias("rel")), ["RELATED_TO"])


@query(f"WITH {_E} SELECT dst AS src, src AS dst, 'has_nation' AS rel FROM edges WHERE rel = 'n_regionkey'")
def inverse_inference(spark: SparkSession, d: str) -> DataFrame:
    return N.inverse(_edges(spark, d), {"n_regionkey": "has_nation"})


@query(
    """SELECT 'nation:'||n_nationkey AS id, 'in_segment' AS rel, count(c_custkey) AS n, 1 AS least, 60 AS most FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey HAVING count(c_custkey) < 1 OR count(c_custkey) > 60"""
)
def cardinality(spark: SparkSession, d: str) -> DataFrame:
    e = _edges(spark, d).where("rel = 'c_nationkey'").select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("in_segment").alias("rel"))
    return N.cardinality_violations(_nodes(spark, d), e, [("nation", "in_segment", 1, 60)])


@query(
    f"""WITH {_E}, {_CV}, q AS (SELECT vector AS qv FROM v WHERE id = 'customer:1'), l AS (SELECT DISTINCT src, dst FROM edges), one AS (SELECT src, dst FROM l WHERE src = 'customer:1'), two AS (SELECT o.src, l.dst FROM one o JOIN l ON o.dst = l.src),
chains AS (SELECT src, dst FROM two UNION SELECT t.src, l.dst FROM two t JOIN l ON t.dst = l.src), near AS (SELECT id, list_cosine_similarity(vector, qv) AS s FROM v, q WHERE type IN ('1', '2') ORDER BY s DESC, id LIMIT 15)
SELECT 'transitive' AS kind, src, 'LOCATED_IN' AS rel, dst, 1.0::DOUBLE AS confidence FROM chains WHERE src <> dst AND (src, dst) NOT IN (SELECT (src, dst) FROM l)
UNION ALL SELECT * FROM (SELECT 'suggested', 'customer:1', 'RELATED_TO', id, round(0.8 * s, 6) FROM near WHERE id <> 'customer:1' ORDER BY s DESC, id LIMIT 5)"""
)
def hybrid_reasoning(spark: SparkSession, d: str) -> DataFrame:
    v, _, edges = _similar_graph(spark, d)
    located = edges.select("src", "dst", F.lit("LOCATED_IN").alias("rel"))
    return N.reasoned(v, located, "customer:1", ["LOCATED_IN"], ["RELATED_TO"], ["1", "2"]).withColumn("confidence", F.round("confidence", 6))


@query(
    f"""WITH {_E}, {_BOTH}, {_CV}, h0 AS (SELECT 'customer:1' AS id), k1 AS (SELECT b.id FROM v a, v b WHERE a.id = 'customer:1' ORDER BY list_cosine_similarity(b.vector, a.vector) DESC, b.id LIMIT 6),
h1 AS (SELECT id FROM (SELECT other AS id FROM both_ways WHERE id = 'customer:1' UNION SELECT id FROM k1) WHERE id <> 'customer:1'),
p AS (SELECT b.id, row_number() OVER (PARTITION BY a.id ORDER BY list_cosine_similarity(b.vector, a.vector) DESC, b.id) AS r FROM v a JOIN h1 ON a.id = h1.id, v b),
h2 AS (SELECT id FROM (SELECT other AS id FROM both_ways WHERE id IN (SELECT id FROM h1) UNION SELECT id FROM p WHERE r <= 6) WHERE id <> 'customer:1' AND id NOT IN (SELECT id FROM h1))
SELECT id, 0 AS hop FROM h0 UNION ALL SELECT id, 1 FROM h1 UNION ALL SELECT id, 2 FROM h2"""
)
def multi_hop(spark: SparkSession, d: str) -> DataFrame:
    v, _, edges = _similar_graph(spark, d)
    return N.hops(v, edges, "customer:1", 2)


_ONTOLOGY = O.Ontology(
    {
        "Thing": O.EntityType({"p_name": O.Property("string", True, (O.Constraint("length", (1, 40)),))}),
        "Part": O.EntityType(
            {
                "p_brand": O.Property("string", True, (O.Constraint("regex", "Brand#[1-3]"),)),
                "p_size": O.Property("integer", False, (O.Constraint("range", (1, 40)),)),
                "p_type": O.Property("string", False, (O.Constraint("custom", lambda c: ~F.endswith(c, F.lit("TIN"))),)),
            },
            ("Thing",),
        ),
        "region": O.EntityType(),
        "nation": O.EntityType(),
        "party": O.EntityType(abstract=True),
        "customer": O.EntityType(parents=("party",)),
        "supplier": O.EntityType(parents=("party",)),
        "orders": O.EntityType(),
    },
    {"n_regionkey": O.RelationType(("nation",), ("region",)), "c_nationkey": O.RelationType(("party",), ("nation",)), "s_nationkey": O.RelationType(("customer",), ("nation",))},
)


@query(
    """SELECT p_partkey, concat_ws(';', CASE WHEN p_brand IS NULL THEN 'p_brand: missing' END, CASE WHEN NOT regexp_matches(p_brand, '^(?:Brand#[1-3])') THEN 'p_brand: regex' END, CASE WHEN p_size < 1 OR p_size > 40 THEN 'p_size: range' END,
CASE WHEN p_type LIKE '%TIN' THEN 'p_type: custom' END, CASE WHEN p_name IS NULL THEN 'p_name: missing' END, CASE WHEN length(p_name) NOT BETWEEN 1 AND 40 THEN 'p_name: length' END) AS errors FROM part"""
)
def ontology_validation(spark: SparkSession, d: str) -> DataFrame:
    return O.validated(_t(spark, d, "part"), _ONTOLOGY, "Part").select("p_partkey", F.array_join("validation_errors", ";").alias("errors"))


@query(f"WITH {_E} SELECT src, dst, rel, CASE rel WHEN 'o_custkey' THEN 'unknown relation' ELSE 'types not allowed' END AS issue FROM edges WHERE rel IN ('o_custkey', 's_nationkey')")
def invalid_relations(spark: SparkSession, d: str) -> DataFrame:
    return O.invalid_relations(_nodes(spark, d), _edges(spark, d), _ONTOLOGY)


@query("SELECT * FROM (VALUES ('Part','Part'),('Part','Thing'),('Thing','Thing'),('region','region'),('nation','nation'),('party','party'),('customer','customer'),('customer','party'),('supplier','supplier'),('supplier','party'),('orders','orders')) x(type, ancestor)")
def type_closure(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(_ONTOLOGY.closure(), "type string, ancestor string")


@query("SELECT p_partkey, p_brand AS maker, 'unknown' AS origin, p_type IS NULL AS has_type FROM part")
def migrated_properties(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "part").select("p_partkey", F.create_map(F.lit("brand"), "p_brand", F.lit("type"), "p_type").alias("properties"))
    out = O.migrated(rows, [("rename", "brand", "maker"), ("add", "origin", "unknown"), ("remove", "type")])
    return out.select("p_partkey", F.col("properties")["maker"].alias("maker"), F.col("properties")["origin"].alias("origin"), F.map_contains_key("properties", "type").alias("has_type"))


@query()
def fuzzy_matches(spark: SparkSession, d: str) -> DataFrame:
    names = _t(spark, d, "part").select("p_partkey", F.regexp_replace("p_type", "A", "E").alias("name"))
    kinds = [r[0] for r in _t(spark, d, "part").select("p_type").distinct().collect()]
    return W.closest(names, kinds).select("p_partkey", "name", "match")


# --- versions and audit


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version_number FROM events")
def entity_versions(spark: SparkSession, d: str) -> DataFrame:
    return A.versions(_t(spark, d, "events"), "user_id", "ts", "event_id").select("user_id", "event_id", "version_number")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE ts <= TIMESTAMP '2024-01-15 12:00:00') WHERE r = 1")
def version_as_of(spark: SparkSession, d: str) -> DataFrame:
    return A.as_of(_t(spark, d, "events").drop("props"), "user_id", "ts", "event_id", F.lit("2024-01-15 12:00:00").cast("timestamp_ntz")).select("user_id", "event_id", "event_type")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 3")
def latest_versions(spark: SparkSession, d: str) -> DataFrame:
    return A.latest(A.versions(_t(spark, d, "events"), "user_id", "ts", "event_id"), "user_id", 3).select("user_id", "event_id")


@query(
    """WITH p AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY user_id, ts), c AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click')
SELECT c.event_id, p.value FROM c ASOF LEFT JOIN p ON c.user_id = p.user_id AND c.ts >= p.ts"""
)
def as_of_join(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events")
    bought = e.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    return A.as_of_join(e.where("event_type = 'click'").select("event_id", "user_id", "ts"), bought, "user_id", "ts", "ts", "value").select("event_id", "value")


@query(
    """WITH v AS (SELECT user_id, event_id, event_type AS t, CAST(CAST(json_extract(props, '$.k') AS INT) % 3 AS VARCHAR) AS k, row_number() OVER w AS version_number, lag(event_type) OVER w AS pt, lag(CAST(CAST(json_extract(props, '$.k') AS INT) % 3 AS VARCHAR)) OVER w AS pk FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, version_number, concat_ws(', ', CASE WHEN k IS DISTINCT FROM pk THEN 'k' END, CASE WHEN t IS DISTINCT FROM pt THEN 'type' END) AS description FROM v"""
)
def version_differences(spark: SparkSession, d: str) -> DataFrame:
    k = (F.get_json_object("props", "$.k").cast("int") % 3).cast("string")
    e = _t(spark, d, "events").withColumn("properties", F.create_map(F.lit("type"), "event_type", F.lit("k"), k))
    return A.differences(A.versions(e, "user_id", "ts", "event_id"), "user_id", "properties").select("user_id", "version_number", "description")


@query("SELECT event_id, user_id FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12' AND event_type IN ('purchase', 'signup')")
def changes_between(spark: SparkSession, d: str) -> DataFrame:
    day = lambda s: F.lit(s).cast("timestamp_ntz")
    return A.changes_between(_t(spark, d, "events"), "ts", day("2024-01-10"), day("2024-01-12"), ["purchase", "signup"], "event_type").select("event_id", "user_id")


_SEVERITY = "CASE WHEN event_type = 'error' AND value > 80 THEN 'critical' WHEN event_type = 'error' THEN 'warning' ELSE 'info' END"


@query(
    f"""SELECT 'type' AS dimension, event_type AS value, count(*) AS n FROM events GROUP BY event_type UNION ALL SELECT 'actor', coalesce(CAST(user_id AS VARCHAR), 'unknown'), count(*) FROM events GROUP BY 2
UNION ALL SELECT 'severity', {_SEVERITY}, count(*) FROM events GROUP BY 2"""
)
def audit_report(spark: SparkSession, d: str) -> DataFrame:
    return A.audit_report(_t(spark, d, "events").withColumn("severity", F.expr(_SEVERITY)), "event_type", "user_id", "severity")


@query("SELECT event_id, ts, user_id FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-20' ORDER BY ts DESC, event_id LIMIT 100")
def audit_query(spark: SparkSession, d: str) -> DataFrame:
    return A.query_log(_t(spark, d, "events"), "ts", since=F.lit("2024-01-20").cast("timestamp_ntz"), limit=100, event_type="error").select("event_id", "ts", "user_id")


# --- texts

_TOKENS = "list_filter(regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}_\\p{{M}}]+'), lambda w: w NOT IN (" + ", ".join(f"'{w}'" for w in X.STOP_WORDS) + "))"


@query(
    f"""WITH q AS (SELECT list_distinct({_TOKENS.format(x="text")}) AS q FROM benchmark WHERE item_id = 0), t AS (SELECT doc_id, list_distinct({_TOKENS.format(x="text")}) AS t FROM documents), s AS (SELECT doc_id, len(list_intersect(q, t)) / len(list_distinct(list_concat(q, t))) AS s FROM t, q WHERE len(t) > 0)
SELECT doc_id, round(s, 9) AS score FROM s ORDER BY s DESC, doc_id LIMIT 10"""
)
def lexical_search(spark: SparkSession, d: str) -> DataFrame:
    q = _t(spark, d, "benchmark").where("item_id = 0").first()["text"]
    return L.search(_t(spark, d, "documents"), q, 10, id_col="doc_id").select("doc_id", F.round("score", 9).alias("score"))


@query(
    f"""WITH q AS (SELECT {_TOKENS.format(x="text")} AS q FROM benchmark WHERE item_id = 1), t AS (SELECT doc_id, {_TOKENS.format(x="text")} AS t FROM documents), qc AS (SELECT w, count(*) AS n FROM (SELECT unnest(q) AS w FROM q) GROUP BY w),
tc AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(t) AS w FROM t) GROUP BY doc_id, w), low AS (SELECT doc_id, sum(least(qc.n, tc.n)) AS low FROM tc JOIN qc USING (w) GROUP BY doc_id)
SELECT t.doc_id, round(coalesce(low, 0) / (len(q) + len(t) - coalesce(low, 0)), 9) AS score FROM q, t LEFT JOIN low ON t.doc_id = low.doc_id WHERE len(t) > 0 ORDER BY coalesce(low, 0) / (len(q) + len(t) - coalesce(low, 0)) DESC, t.doc_id LIMIT 10"""
)
def lexical_multiset_search(spark: SparkSession, d: str) -> DataFrame:
    q = _t(spark, d, "benchmark").where("item_id = 1").first()["text"]
    return L.search(_t(spark, d, "documents"), q, 10, L.multiset_jaccard, id_col="doc_id").select("doc_id", F.round("score", 9).alias("score"))


@query("\nUNION ALL ".join(f"SELECT doc_id, '{k}' AS entity_type, unnest(regexp_extract_all(text, '{p}')) AS value FROM documents" for k, p in ((k, p.replace("'", "''")) for k, p in X.ENTITY_PATTERNS.items())))
def regex_entities(spark: SparkSession, d: str) -> DataFrame:
    return X.entities(_t(spark, d, "documents"), "doc_id", "text")


@query("WITH g AS (SELECT a.item_id AS id, lower(trim(a.text)) = lower(trim(b.text)) AS e FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id - a.item_id % 2) SELECT id, CAST(e AS DOUBLE) AS exact_match FROM g")
def exact_match(spark: SparkSession, d: str) -> DataFrame:
    b = _t(spark, d, "benchmark")
    pairs = b.join(b.select(F.col("item_id").alias("other"), F.col("text").alias("golden")), F.col("other") == F.col("item_id") - F.col("item_id") % 2)
    return pairs.select(F.col("item_id").alias("id"), X.exact_match(F.col("text"), F.col("golden")).alias("exact_match"))


@query(
    """WITH p AS (SELECT a.item_id AS id, regexp_replace(unnest(string_split_regex(lower(a.text), '\\s+')), '[^\\p{L}\\p{N}_]', '', 'g') AS w, 0 AS side FROM benchmark a
UNION ALL SELECT a.item_id, regexp_replace(unnest(string_split_regex(lower(b.text), '\\s+')), '[^\\p{L}\\p{N}_]', '', 'g'), 1 FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id - a.item_id % 2),
c AS (SELECT id, w, count(*) FILTER (WHERE side = 0) AS x, count(*) FILTER (WHERE side = 1) AS y FROM p WHERE w <> '' GROUP BY id, w) SELECT id, round(2.0 * sum(least(x, y)) / (sum(x) + sum(y)), 9) AS f1 FROM c GROUP BY id"""
)
def token_f1(spark: SparkSession, d: str) -> DataFrame:
    b = _t(spark, d, "benchmark")
    pairs = b.join(b.select(F.col("item_id").alias("other"), F.col("text").alias("golden")), F.col("other") == F.col("item_id") - F.col("item_id") % 2)
    return X.token_f1(pairs.withColumnRenamed("item_id", "id"), "id", "text", "golden").select("id", F.round("f1", 9).alias("f1"))


@query("SELECT doc_id, array_to_string(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')[1:7], ' ') AS title FROM documents")
def titles(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", X.title(F.col("text")).alias("title"))


@query("SELECT doc_id, unnest(range(0, length(text), 80)) // 80 AS i, array_to_string(string_split(text, '')[unnest(range(0, length(text), 80)) + 1 : unnest(range(0, length(text), 80)) + 100], '') AS chunk FROM documents")
def exact_chunks(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", F.posexplode(K.exact_windows(F.col("text"), 100, 20)).alias("i", "chunk")).withColumn("i", F.col("i").cast("long"))


@query(
    """WITH s AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.!?…]) +', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS s FROM documents),
w AS (SELECT doc_id, flatten(list_transform(s, lambda x: CASE WHEN length(x) > 200 THEN list_transform(range(0, length(x), 200), lambda k: substr(x, k + 1, 200)) ELSE [x] END)) AS c FROM s)
SELECT doc_id, unnest(range(0, len(c)))::INT AS i, unnest(c) AS chunk FROM w"""
)
def sentence_chunks(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", F.posexplode(K.by_sentence(F.col("text"), 200)).alias("i", "chunk"))


@query()
def paragraph_chunks(spark: SparkSession, d: str) -> DataFrame:
    return K.chunked(_t(spark, d, "documents"), "paragraph", 128)


@query()
def overlapping_chunks(spark: SparkSession, d: str) -> DataFrame:
    return K.chunked(_t(spark, d, "documents"), "overlap", 128, 0.25)


# --- grounding


def _answers(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = _t(spark, d, "conversations")
    answers = c.where("role = 'assistant'").select(F.concat_ws("-", "conv_id", "turn").alias("id"), "text")
    context = _t(spark, d, "benchmark").select(F.col("item_id").alias("entity_id"), X.title(F.col("text"), 3).alias("name"), F.col("text").alias("content"))
    return answers, context


_BARE = "list_filter(list_transform(string_split_regex(lower({x}), '\\s+'), lambda w: regexp_replace(w, '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g')), lambda w: w <> '')"
_ROW = "' ' || array_to_string({x}, ' ') || ' '"
_LINKS = f"""a AS (SELECT conv_id||'-'||turn AS id, list_filter(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s) <> '') AS c FROM conversations WHERE role = 'assistant'),
claims AS (SELECT id, unnest(range(0, len(c)))::INT AS claim_index, unnest(c) AS claim FROM a), cw AS (SELECT id, claim_index, {_BARE.format(x="claim")} AS w FROM claims),
ew AS (SELECT item_id AS entity_id, {_BARE.format(x="text")} AS w, {_BARE.format(x="array_to_string(list_filter(string_split_regex(text, '\\\\s+'), lambda y: y <> '')[1:3], ' ')".replace("\\\\", "\\"))} AS nw FROM benchmark),
c2 AS (SELECT *, {_ROW.format(x="w")} AS s, list_distinct(w) AS u FROM cw), e2 AS (SELECT *, {_ROW.format(x="w")} AS s, {_ROW.format(x="nw")} AS ns, list_distinct(w) AS u FROM ew),
scored AS (SELECT c2.id, claim_index, entity_id, CASE WHEN len(c2.w) > 0 AND len(e2.w) > 0 AND (contains(e2.s, c2.s) OR contains(c2.s, e2.s)) THEN 0.95 WHEN len(list_intersect(c2.u, e2.u)) > 0.4 * greatest(len(c2.u), len(e2.u)) AND len(c2.u) > 0 THEN 0.75
 WHEN len(nw) > 0 AND contains(c2.s, ns) THEN 0.6 END AS confidence FROM c2, e2), links AS (SELECT * FROM scored WHERE confidence IS NOT NULL), best AS (SELECT id, claim_index, max(confidence) AS confidence FROM links GROUP BY 1, 2),
g AS (SELECT claims.id, claims.claim_index, claim, confidence, confidence IS NOT NULL AS is_grounded FROM claims LEFT JOIN best USING (id, claim_index))"""


@query(f"WITH {_LINKS} SELECT id, round(avg(is_grounded::INT), 9) AS coverage, count(*) AS n_claims FROM g GROUP BY id")
def grounded_answers(spark: SparkSession, d: str) -> DataFrame:
    answers, context = _answers(spark, d)
    claimed = R.claims(answers)
    return R.coverage(R.grounded(claimed, R.provenance(claimed, context))).select("id", F.round("coverage", 9).alias("coverage"), "n_claims")


@query(
    """WITH e AS (SELECT d.doc_id, d.text, coalesce(l.quality = 1, false) AS ok FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id), c AS (SELECT doc_id, ok::INT + (length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) > 10)::INT + 1 + 1 AS n, ok FROM e)
SELECT doc_id, n AS checks_passed, round(n / 4, 9) AS validity_score, ok AND n / 4 >= 0.7 AS is_valid FROM c"""
)
def context_validation(spark: SparkSession, d: str) -> DataFrame:
    labels = _t(spark, d, "labels").select("doc_id", (F.col("quality") == 1).alias("ok"))
    entities = _t(spark, d, "documents").join(labels, "doc_id", "left").select("doc_id", F.lit("name").alias("name"), F.regexp_replace("text", r"\s+", " ").alias("content"), F.coalesce("ok", F.lit(False)).alias("ontology_valid"), F.to_date(F.lit("2024-01-01")).alias("updated_at"))
    return R.context_checks(entities, F.to_date(F.lit("2024-06-01"))).select("doc_id", "checks_passed", F.round("validity_score", 9).alias("validity_score"), "is_valid")


@query(
    """WITH m AS (SELECT DISTINCT conv_id||'-'||turn AS id, unnest(regexp_extract_all(text, '[A-Z][a-z]+(?: [A-Z][a-z]+)*')) AS mention FROM conversations WHERE role = 'assistant')
SELECT id, mention FROM m WHERE lower(mention) NOT IN (SELECT lower(unnest(regexp_extract_all(text, '[A-Z][a-z]+(?: [A-Z][a-z]+)*'))) FROM benchmark)"""
)
def fabricated_mentions(spark: SparkSession, d: str) -> DataFrame:
    answers, context = _answers(spark, d)
    claimed = answers.select("id", F.lit(0).alias("claim_index"), F.col("text").alias("claim"))
    names = context.select(F.explode(F.regexp_extract_all("content", F.lit(R.PROPER), F.lit(0))).alias("name"))
    return R.fabricated(R.mentions(claimed), names).select("id", "mention")


@query(
    f"""WITH {_LINKS}, known AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Z][a-z]+(?: [A-Z][a-z]+)*'))) AS n FROM benchmark), m AS (SELECT id, claim_index, unnest(regexp_extract_all(claim, '[A-Z][a-z]+(?: [A-Z][a-z]+)*')) AS mention FROM claims),
bad AS (SELECT DISTINCT id, claim_index FROM m WHERE lower(mention) NOT IN (SELECT n FROM known)), t AS (SELECT g.id, bad.id IS NOT NULL AS critical, bad.id IS NOT NULL OR NOT is_grounded AS detected FROM g LEFT JOIN bad USING (id, claim_index)),
n AS (SELECT id, sum(detected::INT) AS u, sum(critical::INT) AS c, count(*) AS n FROM t GROUP BY id), r AS (SELECT id, c, least(1.0, 0.6 * u / n + 0.4 * c / n + CASE WHEN u / n > 0.5 THEN 0.2 ELSE 0 END) AS risk FROM n)
SELECT id, round(risk, 9) AS risk, risk < 0.3 AND c = 0 AS is_trustworthy FROM r"""
)
def hallucination_risks(spark: SparkSession, d: str) -> DataFrame:
    answers, context = _answers(spark, d)
    claimed = R.claims(answers)
    names = context.select(F.explode(F.regexp_extract_all("content", F.lit(R.PROPER), F.lit(0))).alias("name"))
    found = R.detections(R.grounded(claimed, R.provenance(claimed, context)), R.fabricated(R.mentions(claimed), names))
    return R.answer_risks(found).select("id", F.round("risk", 9).alias("risk"), "is_trustworthy")


@query(
    f"""WITH {_LINKS}, num AS (SELECT id, entity_id, row_number() OVER (PARTITION BY id ORDER BY entity_id) AS number FROM (SELECT DISTINCT id, entity_id FROM links)), m AS (SELECT id, claim_index, string_agg('['||number||']', '' ORDER BY number) AS m FROM links JOIN num USING (id, entity_id) GROUP BY 1, 2)
SELECT id, string_agg(claim || coalesce(' '||m, ''), ' ' ORDER BY claim_index) AS text FROM claims LEFT JOIN m USING (id, claim_index) GROUP BY id"""
)
def annotated_answers(spark: SparkSession, d: str) -> DataFrame:
    answers, context = _answers(spark, d)
    claimed = R.claims(answers)
    links = R.provenance(claimed, context)
    return R.annotated(R.grounded(claimed, links), R.citation_numbers(links))


# --- catalog, sessions, streams


@query(
    """WITH q AS (SELECT event_id AS id, event_type AS text, user_id, ts AS created_at, 'query' AS kind FROM events WHERE event_type = 'view' UNION SELECT event_id, event_type, user_id, ts, 'result' FROM events WHERE event_type = 'click') SELECT * FROM q ORDER BY created_at, kind, id LIMIT 10"""
)
def search_history(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("text"), "user_id", F.col("ts").alias("created_at"))
    return C.history(e.where("text = 'view'"), e.where("text = 'click'"))


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_runs(spark: SparkSession, d: str) -> DataFrame:
    return C.latest_runs(_t(spark, d, "events"), "user_id", "event_type", order="ts", tie="event_id").select("user_id", "event_type", "event_id")


@query("SELECT DISTINCT o_orderkey AS dataset_id FROM orders WHERE o_orderstatus = 'F' AND (o_custkey = 7 OR o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = (SELECT c_nationkey FROM customer WHERE c_custkey = 7)))")
def permitted_datasets(spark: SparkSession, d: str) -> DataFrame:
    acl = _t(spark, d, "orders").select(F.col("o_custkey").alias("principal_id"), F.col("o_orderkey").alias("dataset_id"), F.col("o_orderstatus").alias("permission"))
    c = _t(spark, d, "customer")
    groups = c.select(F.col("c_custkey").alias("user_id"), "c_nationkey").join(c.select(F.col("c_custkey").alias("group_id"), "c_nationkey"), "c_nationkey").select("user_id", "group_id")
    return C.permitted(acl, groups, 7, "F")


@query("SELECT md5(text) AS content_hash, 'upload' AS action FROM documents WHERE lang <> 'de' EXCEPT SELECT md5(text), 'upload' FROM documents WHERE lang <> 'fr' UNION ALL (SELECT md5(text), 'download' FROM documents WHERE lang <> 'fr' EXCEPT SELECT md5(text), 'download' FROM documents WHERE lang <> 'de')")
def sync_plan(spark: SparkSession, d: str) -> DataFrame:
    h = _t(spark, d, "documents").select("lang", F.md5("text").alias("content_hash"))
    return C.sync_plan(h.where("lang <> 'de'"), h.where("lang <> 'fr'"))


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 5")
def latest_turns(spark: SparkSession, d: str) -> DataFrame:
    return C.latest_turns(_t(spark, d, "conversations")).select("conv_id", "turn", "role")


@query("SELECT conv_id, string_agg(role||': '||text, chr(10) ORDER BY turn) AS text, count(*) AS n_turns FROM conversations GROUP BY conv_id")
def session_documents(spark: SparkSession, d: str) -> DataFrame:
    return C.session_documents(_t(spark, d, "conversations"))


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def windowed_events(spark: SparkSession, d: str) -> DataFrame:
    return E.windowed_counts(_t(spark, d, "events")).withColumn("total", F.round("total", 4))


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS b FROM events), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS n FROM s GROUP BY user_id, k"""
)
def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    return E.sessions(_t(spark, d, "events"))


# --- dispatch, pipelines, evaluation, feedback


@query(
    """WITH d AS (SELECT vec_id AS id, list_distance(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)) ** 2 AS x FROM embeddings), k AS (SELECT id, x FROM d ORDER BY x, id LIMIT 10)
SELECT string_agg(text, chr(10) ORDER BY x, id) AS context FROM k JOIN documents ON id = doc_id"""
)
def chunk_context(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    texts = _t(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return P.context(P.run("CHUNKS", vectors=v, texts=texts, vector=S.vector_of(v, 0)))


@query(
    f"""WITH {_E}, d AS (SELECT 'customer:'||vec_id AS id, list_distance(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 1)) ** 2 AS x FROM embeddings),
h AS (SELECT id, x FROM d ORDER BY x, id LIMIT 100), s AS (SELECT id, (x - min(x) OVER ()) / (max(x) OVER () - min(x) OVER ()) AS x FROM h),
t AS (SELECT src, rel, dst, coalesce(a.x, 3.5) + coalesce(b.x, 3.5) + 3.5 AS score FROM edges LEFT JOIN s a ON src = a.id LEFT JOIN s b ON dst = b.id WHERE a.id IS NOT NULL OR b.id IS NOT NULL)
SELECT src||'|'||rel||'|'||dst AS id, src||' -> '||rel||' -> '||dst AS text, round(-score, 6) AS score FROM (SELECT * FROM t ORDER BY t.score, src, dst, rel LIMIT 5)"""
)
def graph_context(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d).select(F.concat(F.lit("customer:"), "id").alias("id"), "vector")
    return P.run("GRAPH_COMPLETION", vectors=v, nodes=_nodes(spark, d), edges=_edges(spark, d), vector=S.vector_of(v, "customer:1")).withColumn("score", F.round("score", 6))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def pending_items(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "orders")
    done = o.select("o_orderkey", F.lit("p").alias("pipeline"), F.lit("main").alias("dataset"), F.when(F.col("o_orderstatus") == "F", J.COMPLETED).otherwise(J.STARTED).alias("status"))
    return J.pending(o.select("o_orderkey"), done, "o_orderkey", "p", "main")


@query("SELECT CAST(event_id AS VARCHAR) AS question, m.metric, m.score FROM events, LATERAL (SELECT 'value' AS metric, value AS score UNION ALL SELECT 'error', CASE WHEN event_type = 'error' THEN 1.0 END) m WHERE m.score IS NOT NULL")
def metric_rows(spark: SparkSession, d: str) -> DataFrame:
    entry = lambda c: F.struct(c.cast("double").alias("score"), F.lit("r").alias("reason"))
    e = _t(spark, d, "events").select(F.col("event_id").cast("string").alias("question"), F.create_map(F.lit("value"), entry(F.col("value")), F.lit("error"), entry(F.when(F.col("event_type") == "error", 1.0))).alias("metrics"))
    return Y.unnested(e).select("question", "metric", "score")


@query("SELECT conv_id AS id, string_agg(text, chr(10) ORDER BY turn) AS golden_context FROM conversations WHERE role = 'user' GROUP BY conv_id")
def golden_contexts(spark: SparkSession, d: str) -> DataFrame:
    turn = F.struct("turn", "role", "text")
    c = _t(spark, d, "conversations").groupBy(F.col("conv_id").alias("id")).agg(F.array_sort(F.collect_list(turn)).alias("t"))
    context = F.array(F.struct(F.lit("all").alias("title"), F.transform("t", lambda x: x["text"]).alias("sentences")))
    users = F.filter(F.transform("t", lambda x, i: F.struct(F.lit("all").alias("title"), i.alias("sentence"), x["role"].alias("role"))), lambda x: x["role"] == "user")
    return Y.golden_context(c.select("id", users.alias("supporting"), context.alias("context")))


@query("SELECT vec_id AS src, (SELECT b.vec_id FROM embeddings b WHERE b.label <> 0 ORDER BY list_cosine_similarity(CAST(b.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[])) DESC, b.vec_id LIMIT 1) AS dst, 'rule_associated_from' AS rel FROM embeddings a WHERE label = 0")
def rule_origins(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    return Z.origins(v.where("type = '0'"), v.where("type <> '0'"))


@query()
def score_intervals(spark: SparkSession, d: str) -> DataFrame:
    return C.bootstrap(_t(spark, d, "events"), "event_type", "value", samples=200)


# --- nested records and collections


def _nested_orders(spark: SparkSession, d: str) -> DataFrame:
    """Customers with their orders as an array of structs."""
    o = _t(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_list(F.struct("o_orderkey", "o_orderstatus")).alias("placed"))
    return _t(spark, d, "customer").select("c_custkey", "c_name").join(o, "c_custkey", "left")


@query("SELECT 'customer:'||o_custkey AS src, 'order:'||o_orderkey AS dst, 'placed' AS rel FROM orders")
def nested_edges(spark: SparkSession, d: str) -> DataFrame:
    return Q.flattened(_nested_orders(spark, d), "customer", "c_custkey", {"placed": ("order", "o_orderkey")})[1]


@query("SELECT 'customer:'||c_custkey AS id, 'customer' AS type FROM customer UNION ALL SELECT 'order:'||o_orderkey, 'order' FROM orders")
def nested_nodes(spark: SparkSession, d: str) -> DataFrame:
    return Q.flattened(_nested_orders(spark, d), "customer", "c_custkey", {"placed": ("order", "o_orderkey")})[0].select("id", "type")


@query(f"WITH {_N}, {_E} SELECT n.id, coalesce(string_agg(e.dst, ',' ORDER BY e.dst), '') AS items FROM nodes n LEFT JOIN edges e ON n.id = e.src AND e.rel = 'c_nationkey' WHERE n.type IN ('customer', 'supplier') GROUP BY n.id")
def nested_instances(spark: SparkSession, d: str) -> DataFrame:
    return Q.nested(_nodes(spark, d).where("type IN ('customer', 'supplier')"), _edges(spark, d), "c_nationkey").select("id", F.array_join("items", ",").alias("items"))


@query(f"WITH {_N}, {_E} SELECT id, type FROM nodes WHERE id NOT IN (SELECT dst FROM edges)")
def root_nodes(spark: SparkSession, d: str) -> DataFrame:
    return Q.roots(_nodes(spark, d), _edges(spark, d)).select("id", "type")


@query("SELECT CAST(p_partkey AS VARCHAR) AS id, 'part_p_name' AS collection, trim(p_name) AS text FROM part WHERE trim(p_name) <> '' UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'part_p_brand', trim(p_brand) FROM part WHERE trim(p_brand) <> ''")
def index_collections(spark: SparkSession, d: str) -> DataFrame:
    return Q.collected(_t(spark, d, "part"), "part", "p_partkey", ["p_name", "p_brand"])


@query("SELECT doc_id AS id FROM documents WHERE lang <> 'en' OR text <> lower(text)")
def new_chunks(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents")
    return Q.new_chunks(docs.select(F.col("doc_id").alias("id"), "text"), docs.where("lang = 'en'").select(F.col("doc_id").alias("id"), F.lower("text").alias("text"))).select("id")


@query("SELECT o_orderkey, 'orders:'||o_orderkey AS source_node_id, 'customer:'||o_custkey AS target_node_id, o_totalprice > 100000 AS heavy FROM orders")
def edge_properties(spark: SparkSession, d: str) -> DataFrame:
    p = Q.edge_properties(F.concat(F.lit("orders:"), "o_orderkey"), F.concat(F.lit("customer:"), "o_custkey"), F.lit("placed_by"), F.lit(None).cast("double"), F.create_map(F.lit("price"), F.col("o_totalprice")))
    rows = _t(spark, d, "orders").select("o_orderkey", p.alias("p"))
    return rows.select("o_orderkey", F.col("p")["source_node_id"].alias("source_node_id"), F.col("p")["target_node_id"].alias("target_node_id"), (F.col("p")["weight_price"].cast("double") > 100000).alias("heavy"))


@query(f"WITH {_E} SELECT src AS source_node_id, dst AS destination_node_id, dst IN ('nation:1', 'nation:2') AS deleted FROM edges WHERE rel = 'c_nationkey'")
def change_ledger(spark: SparkSession, d: str) -> DataFrame:
    rows = Q.ledger(_edges(spark, d).where("rel = 'c_nationkey'"), "migrate", "u")
    gone = rows.where("destination_node_id IN ('nation:1', 'nation:2')")
    return Q.revoked(rows, gone).select("source_node_id", "destination_node_id", F.col("deleted_at").isNotNull().alias("deleted"))


def queries() -> dict[str, Query]:
    from . import knowledge_queries  # noqa: F401  (registers its own)

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import knowledge_queries  # noqa: F401

    return dict(_ORACLES)


__all__ = ["V", "oracle_sql", "queries"]
