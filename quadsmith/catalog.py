"""The registered queries: SPARQL over the test tables, typed, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .engine import Engine, Grants, Policy, overlay
from .functions import terms as T
from .operators import merge, rules, shacl
from .operators.search import TextSearch
from .sources.quads import BASE, QuadTable, tpch

PREFIX = "".join(f"PREFIX {a}: <{BASE}{t}#> " for a, t in (("r", "region"), ("n", "nation"), ("su", "supplier"), ("c", "customer"), ("p", "part"), ("o", "orders"), ("l", "lineitem"), ("e", "events"), ("d", "documents")))
TYPE = f"{BASE}type/"
Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def engine(spark: SparkSession, sf_dir: str, tables: list[str] | None = None, **options) -> Engine:
    return Engine(spark, tpch(spark, sf_dir, tables), **options)


def sparql(name: str, text: str, kinds: dict[str, str], sql: str, tables: list[str] | None = None) -> None:
    """Register a SELECT under a name, with the types of its columns and its SQL."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return engine(spark, sf_dir, tables).query(PREFIX + text).typed(**kinds)

    QUERIES[name] = run
    ORACLE[name] = sql


def frame(name: str, run: Query, sql: str | None) -> None:
    """Register any query."""
    QUERIES[name] = run
    if sql is not None:
        ORACLE[name] = sql


sparql(
    "j1_bgp_chain",
    'SELECT ?name WHERE { ?x n:n_regionkey ?r . ?r r:r_name "ASIA" . ?x n:n_name ?name }',
    {"name": "string"},
    "SELECT n_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'",
    ["nation", "region"],
)
sparql(
    "j5_property_star",
    "SELECT ?o ?total ?status WHERE { ?o o:o_totalprice ?total ; o:o_orderstatus ?status ; o:o_orderpriority \"1-URGENT\" FILTER(?total > 200000) }",
    {"o": "key", "total": "double", "status": "string"},
    "SELECT o_orderkey AS o, o_totalprice AS total, o_orderstatus AS status FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 200000",
    ["orders"],
)
sparql(
    "j1_six_way_join",
    'SELECT ?nation (SUM(?price * (1 - ?disc)) AS ?revenue) WHERE { ?l l:l_orderkey ?o ; l:l_suppkey ?s ; l:l_extendedprice ?price ; l:l_discount ?disc . ?o o:o_custkey ?c . ?c c:c_nationkey ?n . ?s su:s_nationkey ?n . ?n n:n_name ?nation ; n:n_regionkey ?r . ?r r:r_name "ASIA" } GROUP BY ?nation',
    {"nation": "string", "revenue": "double"},
    "SELECT n_name AS nation, sum(l_extendedprice * (1 - l_discount)) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey AND s_nationkey = c_nationkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY 1",
    ["lineitem", "orders", "customer", "supplier", "nation", "region"],
)
sparql(
    "a1_group_pricing",
    "SELECT ?flag ?status (SUM(?q) AS ?sum_qty) (SUM(?x) AS ?sum_price) (AVG(?d) AS ?avg_disc) (COUNT(*) AS ?n) WHERE { ?l l:l_returnflag ?flag ; l:l_linestatus ?status ; l:l_quantity ?q ; l:l_extendedprice ?x ; l:l_discount ?d ; l:l_shipdate ?t FILTER(?t <= \"1998-09-02T00:00:00Z\"^^xsd:dateTime) } GROUP BY ?flag ?status",
    {"flag": "string", "status": "string", "sum_qty": "double", "sum_price": "double", "avg_disc": "double", "n": "long"},
    "SELECT l_returnflag AS flag, l_linestatus AS status, sum(l_quantity) AS sum_qty, sum(l_extendedprice) AS sum_price, avg(l_discount) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2",
    ["lineitem"],
)

# --- scans

sparql("s1_scan_bound_predicate", "SELECT ?s ?seg WHERE { ?s c:c_mktsegment ?seg }", {"s": "key", "seg": "string"}, "SELECT c_custkey AS s, c_mktsegment AS seg FROM customer", ["customer"])
sparql("s2_scan_bound_object", 'SELECT ?s WHERE { ?s c:c_mktsegment "BUILDING" }', {"s": "key"}, "SELECT c_custkey AS s FROM customer WHERE c_mktsegment = 'BUILDING'", ["customer"])
sparql("s3_named_graph", f"SELECT ?s ?b WHERE {{ GRAPH <{BASE}g/customer/3> {{ ?s c:c_acctbal ?b }} }}", {"s": "key", "b": "double"}, "SELECT c_custkey AS s, c_acctbal AS b FROM customer WHERE c_nationkey = 3", ["customer"])
sparql("s4_rows_per_graph", "SELECT ?g ?s WHERE { GRAPH ?g { ?s su:s_acctbal ?b } }", {"g": "key", "s": "key"}, "SELECT s_nationkey::BIGINT AS g, s_suppkey AS s FROM supplier", ["supplier"])
sparql("s5_default_union", "SELECT ?s ?p ?o WHERE { ?s ?p ?o . ?s n:n_regionkey ?r }", {"s": "key", "p": "iri", "o": "string"}, f"""
SELECT n_nationkey::BIGINT AS s, p, o FROM (
 SELECT n_nationkey, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type' AS p, '{TYPE}nation' AS o FROM nation
 UNION ALL SELECT n_nationkey, '{BASE}nation#n_nationkey', n_nationkey::VARCHAR FROM nation
 UNION ALL SELECT n_nationkey, '{BASE}nation#n_name', n_name FROM nation
 UNION ALL SELECT n_nationkey, '{BASE}nation#n_regionkey', '{BASE}region/' || n_regionkey FROM nation)""", ["nation"])  # fmt: skip
sparql("s6_point_lookup", f'SELECT ?n WHERE {{ <{BASE}nation/7> n:n_name ?n }}', {"n": "string"}, "SELECT n_name AS n FROM nation WHERE n_nationkey = 7", ["nation"])
sparql("s9_inverse_walk", f"SELECT ?x WHERE {{ ?x n:n_regionkey <{BASE}region/2> }}", {"x": "key"}, "SELECT n_nationkey::BIGINT AS x FROM nation WHERE n_regionkey = 2", ["nation"])
sparql("s10_named_graphs", "SELECT ?g WHERE { GRAPH ?g {} }", {"g": "iri"}, f"SELECT DISTINCT '{BASE}g/supplier/' || s_nationkey AS g FROM supplier", ["supplier"])
sparql("s11_graph_list", f"SELECT ?s ?b FROM NAMED <{BASE}g/customer/1> FROM NAMED <{BASE}g/customer/2> WHERE {{ GRAPH ?g {{ ?s c:c_acctbal ?b }} }}", {"s": "key", "b": "double"}, "SELECT c_custkey AS s, c_acctbal AS b FROM customer WHERE c_nationkey IN (1, 2)", ["customer"])

# --- filters, projection, expressions as operators

sparql("p2_bind", "SELECT ?s ?half WHERE { ?s p:p_size ?z BIND(?z / 2 AS ?half) }", {"s": "key", "half": "double"}, "SELECT p_partkey AS s, p_size / 2.0 AS half FROM part", ["part"])
sparql("p3_filter_range", "SELECT ?s ?x WHERE { ?s p:p_retailprice ?x FILTER(?x >= 920 && ?x < 950) }", {"s": "key", "x": "double"}, "SELECT p_partkey AS s, p_retailprice AS x FROM part WHERE p_retailprice >= 920 AND p_retailprice < 950", ["part"])
sparql("p4_values_undef", 'SELECT ?s ?seg ?k WHERE { VALUES (?seg ?k) { ("BUILDING" 1) ("MACHINERY" UNDEF) } ?s c:c_mktsegment ?seg }', {"s": "key", "seg": "string", "k": "long"}, "SELECT c_custkey AS s, c_mktsegment AS seg, k::BIGINT AS k FROM customer JOIN (VALUES ('BUILDING', 1), ('MACHINERY', NULL)) v(seg, k) ON c_mktsegment = seg", ["customer"])
sparql("p5_equality_by_value", "SELECT ?s WHERE { ?s p:p_size ?z FILTER(?z = 7.0) }", {"s": "key"}, "SELECT p_partkey AS s FROM part WHERE p_size = 7", ["part"])
sparql("p6_in_list", "SELECT ?s ?z WHERE { ?s p:p_size ?z FILTER(?z IN (1, 2, 3) || ?z NOT IN (4, 5, 6, 7, 8, 9, 10, 11)) }", {"s": "key", "z": "long"}, "SELECT p_partkey AS s, p_size::BIGINT AS z FROM part WHERE p_size IN (1, 2, 3) OR p_size NOT IN (4, 5, 6, 7, 8, 9, 10, 11)", ["part"])
sparql("p7_exists", "SELECT ?c WHERE { ?c c:c_acctbal ?b FILTER EXISTS { ?o o:o_custkey ?c ; o:o_totalprice ?t FILTER(?t > 250000) } }", {"c": "key"}, "SELECT c_custkey AS c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)", ["customer", "orders"])
sparql("p7_not_exists", "SELECT ?c WHERE { ?c c:c_acctbal ?b FILTER NOT EXISTS { ?o o:o_custkey ?c ; o:o_orderpriority \"1-URGENT\" ; o:o_orderstatus \"F\" } }", {"c": "key"}, "SELECT c_custkey AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')", ["customer", "orders"])
sparql("p7_exists_correlated", "SELECT ?c WHERE { ?c c:c_acctbal ?b FILTER EXISTS { ?o o:o_custkey ?c ; o:o_totalprice ?t FILTER(?t > ?b * 40) } }", {"c": "key"}, "SELECT c_custkey AS c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > c_acctbal * 40)", ["customer", "orders"])
sparql("p7_exists_in_expression", "SELECT ?c ?rich WHERE { ?c c:c_nationkey ?n BIND(EXISTS { ?o o:o_custkey ?c ; o:o_orderstatus \"F\" } || ?c = <urn:d:customer/1> AS ?rich) }", {"c": "key", "rich": "boolean"}, "SELECT c_custkey AS c, (EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') OR c_custkey = 1) AS rich FROM customer", ["customer", "orders"])
sparql("p8_projection_limit", "SELECT ?s WHERE { ?s r:r_name ?n } ORDER BY ?n LIMIT 3", {"s": "key"}, "SELECT r_regionkey::BIGINT AS s FROM region ORDER BY r_name LIMIT 3", ["region"])
sparql("p9_from_dataset", f"SELECT ?s ?b FROM <{BASE}g/customer/4> WHERE {{ ?s c:c_acctbal ?b }}", {"s": "key", "b": "double"}, "SELECT c_custkey AS s, c_acctbal AS b FROM customer WHERE c_nationkey = 4", ["customer"])

# --- joins

sparql("j3_hash_join", "SELECT ?o ?name WHERE { ?o o:o_custkey ?c . ?c c:c_name ?name }", {"o": "key", "name": "string"}, "SELECT o_orderkey AS o, c_name AS name FROM orders JOIN customer ON o_custkey = c_custkey", ["orders", "customer"])
sparql("j6_disconnected_join", 'SELECT ?a ?b WHERE { ?x r:r_name ?a . ?y n:n_name ?b FILTER(STRSTARTS(?b, "NATION_2")) }', {"a": "string", "b": "string"}, "SELECT r_name AS a, n_name AS b FROM region, nation WHERE n_name LIKE 'NATION\\_2%' ESCAPE '\\'", ["region", "nation"])
sparql("j7_optional", "SELECT ?c ?o WHERE { ?c c:c_nationkey <urn:d:nation/5> OPTIONAL { ?o o:o_custkey ?c ; o:o_totalprice ?t FILTER(?t > 200000) } }", {"c": "key", "o": "key"}, "SELECT c_custkey AS c, o_orderkey AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 200000 WHERE c_nationkey = 5", ["customer", "orders"])
sparql("j7_optional_unbound_filter", "SELECT ?c WHERE { ?c c:c_mktsegment ?m OPTIONAL { ?o o:o_custkey ?c ; o:o_orderpriority \"1-URGENT\" } FILTER(!BOUND(?o)) }", {"c": "key"}, "SELECT c_custkey AS c FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')", ["customer", "orders"])
sparql("j7_nested_optional", "SELECT ?n ?s ?c WHERE { ?n n:n_regionkey <urn:d:region/1> OPTIONAL { ?s su:s_nationkey ?n OPTIONAL { ?c c:c_nationkey ?n ; c:c_acctbal ?b FILTER(?b > 9500) } } }", {"n": "key", "s": "key", "c": "key"}, "SELECT n_nationkey::BIGINT AS n, s_suppkey AS s, c_custkey AS c FROM nation LEFT JOIN (supplier LEFT JOIN customer ON c_nationkey = s_nationkey AND c_acctbal > 9500) ON s_nationkey = n_nationkey WHERE n_regionkey = 1", ["nation", "supplier", "customer"])
sparql("j6_join_on_maybe_unbound", "SELECT ?c ?o ?t WHERE { ?c c:c_nationkey <urn:d:nation/3> OPTIONAL { ?o o:o_custkey ?c ; o:o_orderstatus \"P\" } { ?o o:o_totalprice ?t FILTER(?t > 290000) } }", {"c": "key", "o": "key", "t": "double"}, "WITH l AS (SELECT c_custkey AS c, o_orderkey AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' WHERE c_nationkey = 3) SELECT c, r.o_orderkey AS o, r.o_totalprice AS t FROM l JOIN orders r ON (l.o IS NULL OR l.o = r.o_orderkey) WHERE r.o_totalprice > 290000", ["customer", "orders"])
sparql("j8_lateral", "SELECT ?n ?name WHERE { ?n n:n_regionkey ?r LATERAL { ?r r:r_name ?name } }", {"n": "key", "name": "string"}, "SELECT n_nationkey::BIGINT AS n, r_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey", ["nation", "region"])
sparql("j9_minus", "SELECT ?c WHERE { ?c c:c_nationkey ?n MINUS { ?o o:o_custkey ?c ; o:o_orderpriority \"1-URGENT\" } }", {"c": "key"}, "SELECT c_custkey AS c FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')", ["customer", "orders"])
sparql("j9_minus_disjoint", "SELECT ?r WHERE { ?r r:r_name ?n MINUS { ?x n:n_name ?y } }", {"r": "key"}, "SELECT r_regionkey::BIGINT AS r FROM region", ["region", "nation"])
sparql("j9_minus_maybe_unbound", "SELECT ?c ?o WHERE { ?c c:c_nationkey <urn:d:nation/2> OPTIONAL { ?o o:o_custkey ?c ; o:o_orderstatus \"P\" } MINUS { ?o o:o_orderpriority \"2-HIGH\" } }", {"c": "key", "o": "key"}, "SELECT c_custkey AS c, o_orderkey AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' WHERE c_nationkey = 2 AND (o_orderkey IS NULL OR o_orderpriority <> '2-HIGH')", ["customer", "orders"])
sparql("j10_semi_count", "SELECT (COUNT(*) AS ?n) WHERE { ?c c:c_nationkey ?k FILTER EXISTS { ?o o:o_custkey ?c } }", {"n": "long"}, "SELECT count(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)", ["customer", "orders"])
sparql("j10_anti_count", "SELECT (COUNT(*) AS ?n) WHERE { ?c c:c_nationkey ?k FILTER NOT EXISTS { ?o o:o_custkey ?c } }", {"n": "long"}, "SELECT count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)", ["customer", "orders"])
sparql("j11_graph_variable_join", "SELECT ?g (COUNT(*) AS ?n) WHERE { GRAPH ?g { ?a c:c_nationkey ?k . ?b c:c_nationkey ?k } } GROUP BY ?g", {"g": "key", "n": "long"}, "SELECT c_nationkey::BIGINT AS g, count(*) * count(*) AS n FROM customer GROUP BY 1", ["customer"])
sparql("j16_join_count", "SELECT (COUNT(*) AS ?n) WHERE { ?l l:l_orderkey ?o . ?m l:l_orderkey ?o }", {"n": "long"}, "SELECT sum(k * k)::BIGINT AS n FROM (SELECT count(*) AS k FROM lineitem GROUP BY l_orderkey)", ["lineitem"])
sparql("j17_chain_count", "SELECT (COUNT(*) AS ?n) WHERE { ?l l:l_orderkey ?o . ?o o:o_custkey ?c . ?c c:c_nationkey ?k }", {"n": "long"}, "SELECT count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey", ["lineitem", "orders", "customer"])
sparql("j18_optional_star_count", "SELECT (COUNT(*) AS ?n) WHERE { ?c c:c_nationkey ?k OPTIONAL { ?o o:o_custkey ?c } }", {"n": "long"}, "SELECT count(*) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey", ["customer", "orders"])
sparql("j22_theta_join", "SELECT ?a ?b WHERE { ?a su:s_nationkey ?n ; su:s_acctbal ?x . ?b su:s_nationkey ?n ; su:s_acctbal ?y FILTER(?x < ?y) }", {"a": "key", "b": "key"}, "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_acctbal < b.s_acctbal", ["supplier"])

# --- groups

sparql("a1_group_by_expression", "SELECT ?y (COUNT(*) AS ?n) WHERE { ?o o:o_orderdate ?d } GROUP BY (YEAR(?d) AS ?y)", {"y": "long", "n": "long"}, "SELECT year(o_orderdate)::BIGINT AS y, count(*) AS n FROM orders GROUP BY 1", ["orders"])
sparql("a1_group_unbound_key", "SELECT ?o (COUNT(*) AS ?n) WHERE { ?c c:c_nationkey <urn:d:nation/4> OPTIONAL { ?o o:o_custkey ?c ; o:o_orderstatus \"P\" } } GROUP BY ?o", {"o": "key", "n": "long"}, "SELECT o_orderkey AS o, count(*) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' WHERE c_nationkey = 4 GROUP BY 1", ["customer", "orders"])
sparql("a2_count_star_empty", 'SELECT (COUNT(*) AS ?n) WHERE { ?x r:r_name "NOWHERE" }', {"n": "long"}, "SELECT count(*) AS n FROM region WHERE r_name = 'NOWHERE'", ["region"])
sparql("a3_count_bound", "SELECT (COUNT(?o) AS ?n) (COUNT(*) AS ?m) WHERE { ?c c:c_nationkey ?k OPTIONAL { ?o o:o_custkey ?c ; o:o_orderstatus \"P\" } }", {"n": "long", "m": "long"}, "SELECT count(o_orderkey) AS n, count(*) AS m FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P'", ["customer", "orders"])
sparql("a4_count_distinct", "SELECT ?p (COUNT(DISTINCT ?c) AS ?n) WHERE { ?o o:o_orderpriority ?p ; o:o_custkey ?c } GROUP BY ?p", {"p": "string", "n": "long"}, "SELECT o_orderpriority AS p, count(DISTINCT o_custkey) AS n FROM orders GROUP BY 1", ["orders"])
sparql("a5_count_distinct_star", "SELECT (COUNT(DISTINCT *) AS ?n) WHERE { SELECT ?s ?p { ?o o:o_orderstatus ?s ; o:o_orderpriority ?p } }", {"n": "long"}, "SELECT count(*) AS n FROM (SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders)", ["orders"])
sparql("a7_union_count", "SELECT (COUNT(*) AS ?n) WHERE { ?s ?p ?o }", {"n": "long"}, "SELECT (SELECT count(*) FROM nation) * 4 + (SELECT count(*) FROM region) * 3 AS n", ["nation", "region"])
sparql("a8_star_count", "SELECT (COUNT(*) AS ?n) WHERE { ?c c:c_nationkey ?n1 . ?o o:o_custkey ?c . ?q o:o_custkey ?c }", {"n": "long"}, "SELECT sum(k * k)::BIGINT AS n FROM (SELECT count(*) AS k FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY o_custkey)", ["customer", "orders"])
sparql("a9_min_max_sum_avg", "SELECT ?b (MIN(?z) AS ?lo) (MAX(?z) AS ?hi) (SUM(?z) AS ?total) (AVG(?z) AS ?mean) WHERE { ?s p:p_brand ?b ; p:p_size ?z } GROUP BY ?b", {"b": "string", "lo": "long", "hi": "long", "total": "long", "mean": "double"}, "SELECT p_brand AS b, min(p_size)::BIGINT AS lo, max(p_size)::BIGINT AS hi, sum(p_size)::BIGINT AS total, avg(p_size) AS mean FROM part GROUP BY 1", ["part"])
sparql("a9_min_string", "SELECT ?r (MIN(?n) AS ?first) WHERE { ?x n:n_regionkey ?r ; n:n_name ?n } GROUP BY ?r", {"r": "key", "first": "string"}, "SELECT n_regionkey::BIGINT AS r, min(n_name) AS first FROM nation GROUP BY 1", ["nation"])
sparql("a10_sample", "SELECT ?r (SAMPLE(?r) AS ?same) WHERE { ?x n:n_regionkey ?r } GROUP BY ?r", {"r": "key", "same": "key"}, "SELECT DISTINCT n_regionkey::BIGINT AS r, n_regionkey::BIGINT AS same FROM nation", ["nation"])
sparql("a11_group_concat", 'SELECT ?r (GROUP_CONCAT(?n; SEPARATOR="|") AS ?names) WHERE { ?x n:n_regionkey ?r ; n:n_name ?n } GROUP BY ?r', {"r": "key", "names": "string"}, "SELECT n_regionkey::BIGINT AS r, string_agg(n_name, '|' ORDER BY n_name) AS names FROM nation GROUP BY 1", ["nation"])
sparql("a12_distinct_aggregates", "SELECT (SUM(DISTINCT ?z) AS ?total) (AVG(DISTINCT ?z) AS ?mean) WHERE { ?s p:p_size ?z }", {"total": "long", "mean": "double"}, "SELECT sum(DISTINCT p_size)::BIGINT AS total, avg(DISTINCT p_size) AS mean FROM part", ["part"])
sparql("a13_having", "SELECT ?c (SUM(?t) AS ?total) WHERE { ?o o:o_custkey ?c ; o:o_totalprice ?t } GROUP BY ?c HAVING (COUNT(*) > 15 && SUM(?t) > 2000000)", {"c": "key", "total": "double"}, "SELECT o_custkey AS c, sum(o_totalprice) AS total FROM orders GROUP BY 1 HAVING count(*) > 15 AND sum(o_totalprice) > 2000000", ["orders"])
sparql("a14_distinct", "SELECT DISTINCT ?s ?p WHERE { ?o o:o_orderstatus ?s ; o:o_orderpriority ?p }", {"s": "string", "p": "string"}, "SELECT DISTINCT o_orderstatus AS s, o_orderpriority AS p FROM orders", ["orders"])
sparql("a15_reduced", "SELECT REDUCED ?n WHERE { ?x r:r_name ?n }", {"n": "string"}, "SELECT r_name AS n FROM region", ["region"])
sparql("a16_graph_distinct", "SELECT DISTINCT ?m WHERE { GRAPH ?g { ?c c:c_mktsegment ?m ; c:c_nationkey ?k . ?d c:c_acctbal ?b FILTER(?b > 0) } }", {"m": "string"}, "SELECT DISTINCT c_mktsegment AS m FROM customer a WHERE EXISTS (SELECT 1 FROM customer b WHERE b.c_nationkey = a.c_nationkey AND b.c_acctbal > 0)", ["customer"])
sparql("a16_distinct_semi_join", "SELECT DISTINCT ?n WHERE { ?x n:n_name ?n . ?c c:c_nationkey ?x . ?o o:o_custkey ?c ; o:o_orderstatus \"F\" }", {"n": "string"}, "SELECT n_name AS n FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'F')", ["nation", "customer", "orders"])
sparql("a17_facet_counts", "SELECT ?m (COUNT(DISTINCT ?g) AS ?n) WHERE { GRAPH ?g { ?c c:c_mktsegment ?m } } GROUP BY ?m", {"m": "string", "n": "long"}, "SELECT c_mktsegment AS m, count(DISTINCT c_nationkey) AS n FROM customer GROUP BY 1", ["customer"])
sparql("a18_subquery", "SELECT ?name ?n WHERE { { SELECT ?k (COUNT(?c) AS ?n) WHERE { ?c c:c_nationkey ?k } GROUP BY ?k } ?k n:n_name ?name FILTER(?n > 50) }", {"name": "string", "n": "long"}, "SELECT n_name AS name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 HAVING count(*) > 50", ["customer", "nation"])

# --- order, slices, sets

sparql("o1_order_top", "SELECT ?o ?t WHERE { ?o o:o_totalprice ?t } ORDER BY DESC(?t) ?o LIMIT 20", {"o": "key", "t": "double"}, "SELECT o_orderkey AS o, o_totalprice AS t FROM orders ORDER BY t DESC, o::VARCHAR LIMIT 20", ["orders"])
sparql("o1_order_mixed_kinds", "SELECT ?v WHERE { { ?x n:n_name ?v FILTER(?v < \"C\") } UNION { ?x r:r_regionkey ?v } UNION { ?y n:n_regionkey ?v FILTER(?y = <urn:d:nation/0>) } } ORDER BY ?v LIMIT 5", {"v": "string"}, "SELECT v FROM (SELECT 'urn:d:region/' || n_regionkey AS v, 0 AS k, 0 AS n FROM nation WHERE n_nationkey = 0 UNION ALL SELECT r_regionkey::VARCHAR, 1, r_regionkey FROM region UNION ALL SELECT n_name, 2, 0 FROM nation WHERE n_name < 'C') ORDER BY k, n, v LIMIT 5", ["nation", "region"])
sparql("o2_offset_limit", "SELECT ?n WHERE { ?x n:n_name ?n } ORDER BY ?n LIMIT 7 OFFSET 9", {"n": "string"}, "SELECT n_name AS n FROM nation ORDER BY 1 LIMIT 7 OFFSET 9", ["nation"])
sparql("o6_union", "SELECT ?k ?b WHERE { { ?x c:c_nationkey ?k ; c:c_acctbal ?b } UNION { ?x su:s_nationkey ?k } }", {"k": "key", "b": "double"}, "SELECT c_nationkey::BIGINT AS k, c_acctbal AS b FROM customer UNION ALL SELECT s_nationkey::BIGINT, NULL FROM supplier", ["customer", "supplier"])
sparql("o8_intersect_by_join", "SELECT DISTINCT ?k WHERE { ?c c:c_nationkey ?k . ?s su:s_nationkey ?k }", {"k": "key"}, "SELECT c_nationkey::BIGINT AS k FROM customer INTERSECT SELECT s_nationkey::BIGINT FROM supplier", ["customer", "supplier"])

# --- paths

sparql("h1_inverse", "SELECT ?r ?n WHERE { ?r ^n:n_regionkey ?n }", {"r": "key", "n": "key"}, "SELECT n_regionkey::BIGINT AS r, n_nationkey::BIGINT AS n FROM nation", ["nation"])
sparql("h2_sequence", "SELECT ?o ?name WHERE { ?o o:o_custkey/c:c_nationkey/n:n_regionkey/r:r_name ?name }", {"o": "key", "name": "string"}, "SELECT o_orderkey AS o, r_name AS name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey", ["orders", "customer", "nation", "region"])
sparql("h3_alternative", "SELECT ?x ?k WHERE { ?x c:c_nationkey|su:s_nationkey ?k }", {"x": "iri", "k": "key"}, "SELECT 'urn:d:customer/' || c_custkey AS x, c_nationkey::BIGINT AS k FROM customer UNION ALL SELECT 'urn:d:supplier/' || s_suppkey, s_nationkey::BIGINT FROM supplier", ["customer", "supplier"])
sparql("h4_negated", "SELECT ?v WHERE { ?x !(n:n_name|n:n_regionkey|a) ?v }", {"v": "long"}, "SELECT n_nationkey::BIGINT AS v FROM nation", ["nation"])
sparql("h5_one_or_more", "SELECT ?x ?y WHERE { ?x (c:c_nationkey|n:n_regionkey)+ ?y }", {"x": "iri", "y": "iri"}, "WITH RECURSIVE e AS (SELECT 'urn:d:customer/' || c_custkey AS s, 'urn:d:nation/' || c_nationkey AS o FROM customer UNION SELECT 'urn:d:nation/' || n_nationkey, 'urn:d:region/' || n_regionkey FROM nation), c AS (SELECT s, o FROM e UNION SELECT c.s, e.o FROM c JOIN e ON c.o = e.s) SELECT s AS x, o AS y FROM c", ["customer", "nation"])
sparql("h5_reach_from_constant", "SELECT ?y WHERE { <urn:d:orders/7> (o:o_custkey|c:c_nationkey|n:n_regionkey)+ ?y }", {"y": "iri"}, "WITH o AS (SELECT * FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderkey = 7) SELECT 'urn:d:customer/' || o_custkey AS y FROM o UNION SELECT 'urn:d:nation/' || c_nationkey FROM o UNION SELECT 'urn:d:region/' || n_regionkey FROM o", ["orders", "customer", "nation"])
sparql("h6_zero_or_more_to_constant", "SELECT ?x WHERE { ?x (n:n_regionkey)* <urn:d:region/3> }", {"x": "iri"}, "SELECT 'urn:d:nation/' || n_nationkey AS x FROM nation WHERE n_regionkey = 3 UNION SELECT 'urn:d:region/3'", ["nation"])
sparql("h7_zero_or_one", "SELECT ?y WHERE { <urn:d:nation/3> n:n_regionkey? ?y }", {"y": "iri"}, "SELECT 'urn:d:region/' || n_regionkey AS y FROM nation WHERE n_nationkey = 3 UNION SELECT 'urn:d:nation/3'", ["nation"])

# --- functions

sparql("f1_logic_with_errors", 'SELECT ?s WHERE { ?s p:p_name ?n ; p:p_size ?z FILTER((?n > 3 || ?z > 40) && !(?z > 45)) }', {"s": "key"}, "SELECT p_partkey AS s FROM part WHERE p_size > 40 AND p_size <= 45", ["part"])
sparql("f3_same_term", 'SELECT ?s WHERE { ?s p:p_size ?z FILTER(sameTerm(?z, 7)) }', {"s": "key"}, "SELECT p_partkey AS s FROM part WHERE p_size = 7", ["part"])
sparql("f5_arithmetic", "SELECT ?s ?v WHERE { ?s p:p_size ?z ; p:p_retailprice ?x BIND((?z + 1) * 2 - ?x / 4 AS ?v) }", {"s": "key", "v": "double"}, "SELECT p_partkey AS s, (p_size + 1) * 2 - p_retailprice / 4 AS v FROM part", ["part"])
sparql("f8_if_coalesce", 'SELECT ?s ?k ?v WHERE { ?s p:p_size ?z BIND(IF(?z > 25, "big", "small") AS ?k) BIND(COALESCE(1 / (?z - ?z), ?z) AS ?v) }', {"s": "key", "k": "string", "v": "long"}, "SELECT p_partkey AS s, CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS k, p_size::BIGINT AS v FROM part", ["part"])
sparql("f10_term_kinds", "SELECT (COUNT(*) AS ?n) WHERE { ?s ?p ?o FILTER(isIRI(?o) && !isLiteral(?o) && !isBlank(?o)) }", {"n": "long"}, "SELECT (SELECT count(*) FROM nation) * 2 + (SELECT count(*) FROM region) AS n", ["nation", "region"])
sparql("f11_is_numeric", "SELECT (COUNT(*) AS ?n) WHERE { ?s ?p ?o FILTER(isNumeric(?o)) }", {"n": "long"}, "SELECT (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) AS n", ["nation", "region"])
sparql("f12_str_datatype_lang", "SELECT ?s ?t ?d ?l WHERE { ?x p:p_size ?z BIND(STR(?z) AS ?t) BIND(STR(DATATYPE(?z)) AS ?d) BIND(LANG(?z) AS ?l) BIND(STR(?x) AS ?s) }", {"s": "string", "t": "string", "d": "string", "l": "string"}, "SELECT 'urn:d:part/' || p_partkey AS s, p_size::VARCHAR AS t, 'http://www.w3.org/2001/XMLSchema#integer' AS d, '' AS l FROM part", ["part"])
sparql("f14_constructors", 'SELECT ?i ?l WHERE { ?x n:n_name ?n ; n:n_nationkey ?k BIND(STR(IRI(CONCAT("urn:x:", STR(?k)))) AS ?i) BIND(CONCAT(LANG(STRLANG(?n, "EN")), STR(DATATYPE(STRDT(STR(?k), xsd:int)))) AS ?l) }', {"i": "string", "l": "string"}, "SELECT 'urn:x:' || n_nationkey AS i, 'enhttp://www.w3.org/2001/XMLSchema#int' AS l FROM nation", ["nation"])
sparql("f16_strings", "SELECT ?s ?n ?u ?b ?c WHERE { ?s p:p_name ?x BIND(STRLEN(?x) AS ?n) BIND(UCASE(?x) AS ?u) BIND(SUBSTR(?x, 3, 4) AS ?b) BIND(LCASE(SUBSTR(?x, 2)) AS ?c) }", {"s": "key", "n": "long", "u": "string", "b": "string", "c": "string"}, "SELECT p_partkey AS s, length(p_name) AS n, upper(p_name) AS u, substring(p_name, 3, 4) AS b, lower(substring(p_name, 2)) AS c FROM part", ["part"])
sparql("f18_string_tests", 'SELECT ?s WHERE { ?s p:p_type ?x FILTER(CONTAINS(?x, "A") || STRSTARTS(?x, "S") || STRENDS(?x, "L")) }', {"s": "key"}, "SELECT p_partkey AS s FROM part WHERE contains(p_type, 'A') OR starts_with(p_type, 'S') OR suffix(p_type, 'L')", ["part"])
sparql("f19_before_after", 'SELECT ?s ?b ?a WHERE { ?s o:o_orderpriority ?x BIND(STRBEFORE(?x, "-") AS ?b) BIND(STRAFTER(?x, "-") AS ?a) }', {"s": "key", "b": "string", "a": "string"}, "SELECT o_orderkey AS s, split_part(o_orderpriority, '-', 1) AS b, substring(o_orderpriority, strpos(o_orderpriority, '-') + 1) AS a FROM orders", ["orders"])
sparql("f20_encode_for_uri", "SELECT ?s ?e WHERE { ?s p:p_name ?x BIND(ENCODE_FOR_URI(?x) AS ?e) }", {"s": "key", "e": "string"}, "SELECT p_partkey AS s, url_encode(p_name) AS e FROM part", ["part"])
sparql("f21_regex_replace", 'SELECT ?s ?y WHERE { ?s n:n_name ?x FILTER(REGEX(?x, "^nation_[0-7]$", "i")) BIND(REPLACE(?x, "[AEIOU]", "_") AS ?y) }', {"s": "key", "y": "string"}, "SELECT n_nationkey::BIGINT AS s, regexp_replace(n_name, '[AEIOU]', '_', 'g') AS y FROM nation WHERE regexp_matches(n_name, '^nation_[0-7]$', 'i')", ["nation"])
sparql("f22_rounding", "SELECT ?s ?a ?c ?f ?r WHERE { ?s c:c_acctbal ?b BIND(ABS(?b) AS ?a) BIND(CEIL(?b) AS ?c) BIND(FLOOR(?b) AS ?f) BIND(ROUND(?b) AS ?r) }", {"s": "key", "a": "double", "c": "double", "f": "double", "r": "double"}, "SELECT c_custkey AS s, abs(c_acctbal) AS a, ceil(c_acctbal) AS c, floor(c_acctbal) AS f, floor(c_acctbal + 0.5) AS r FROM customer", ["customer"])
sparql("f23_dates", "SELECT ?s ?y ?m ?d ?h WHERE { ?s e:ts ?t BIND(YEAR(?t) AS ?y) BIND(MONTH(?t) AS ?m) BIND(DAY(?t) AS ?d) BIND(HOURS(?t) AS ?h) }", {"s": "key", "y": "long", "m": "long", "d": "long", "h": "long"}, "SELECT event_id AS s, year(ts)::BIGINT AS y, month(ts)::BIGINT AS m, day(ts)::BIGINT AS d, hour(ts)::BIGINT AS h FROM events", ["events"])
sparql("f24_hashes", "SELECT ?s ?a ?b WHERE { ?s n:n_name ?x BIND(MD5(?x) AS ?a) BIND(SHA256(?x) AS ?b) }", {"s": "key", "a": "string", "b": "string"}, "SELECT n_nationkey::BIGINT AS s, md5(n_name) AS a, sha256(n_name) AS b FROM nation", ["nation"])
sparql("f25_casts", "SELECT ?s ?i ?b WHERE { ?s p:p_retailprice ?x ; p:p_name ?n BIND(xsd:integer(?x) AS ?i) BIND(xsd:integer(?n) AS ?none) BIND(BOUND(?none) AS ?b) }", {"s": "key", "i": "long", "b": "boolean"}, "SELECT p_partkey AS s, trunc(p_retailprice)::BIGINT AS i, false AS b FROM part", ["part"])

# --- query forms and updates

frame("q2_ask", lambda s, d: engine(s, d, ["region"]).query(PREFIX + 'ASK { ?x r:r_name "EUROPE" }'), "SELECT count(*) > 0 AS answer FROM region WHERE r_name = 'EUROPE'")
frame("j19_triangle_ask", lambda s, d: engine(s, d, ["supplier", "customer", "orders"]).query(PREFIX + "ASK { ?o o:o_custkey ?c . ?c c:c_nationkey ?n . ?s su:s_nationkey ?n }"), "SELECT count(*) > 0 AS answer FROM orders JOIN customer ON o_custkey = c_custkey JOIN supplier ON s_nationkey = c_nationkey")
frame("q3_construct", lambda s, d: engine(s, d, ["nation", "region"]).query(PREFIX + "CONSTRUCT { ?r <urn:x:has> ?name } WHERE { ?n n:n_regionkey ?r ; n:n_name ?name }"), "SELECT '<urn:d:region/' || n_regionkey || '>' AS s, '<urn:x:has>' AS p, '\"' || n_name || '\"' AS o FROM nation")
frame("q4_describe", lambda s, d: engine(s, d, ["region"]).query(PREFIX + 'DESCRIBE ?x WHERE { ?x r:r_name "ASIA" }'), f"SELECT '<urn:d:region/' || r_regionkey || '>' AS s, u.p, u.o FROM region, LATERAL (VALUES ('<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>', '<{TYPE}region>'), ('<urn:d:region#r_name>', '\"ASIA\"'), ('<urn:d:region#r_regionkey>', '\"' || r_regionkey || '\"^^<http://www.w3.org/2001/XMLSchema#integer>')) u(p, o) WHERE r_name = 'ASIA'")
frame("q8_insert_data", lambda s, d: engine(s, d, ["region"]).changes('INSERT DATA { GRAPH <urn:g> { <urn:a> <urn:p> "x", 1 } }'), "SELECT * FROM (VALUES ('insert', '<urn:g>', '<urn:a>', '<urn:p>', '\"x\"'), ('insert', '<urn:g>', '<urn:a>', '<urn:p>', '\"1\"^^<http://www.w3.org/2001/XMLSchema#integer>')) v(op, g, s, p, o)")
frame("q9_delete_insert_where", lambda s, d: engine(s, d, ["nation"]).changes(PREFIX + "DELETE { GRAPH ?g { ?x n:n_name ?n } } INSERT { GRAPH ?g { ?x n:n_name ?low } } WHERE { GRAPH ?g { ?x n:n_name ?n ; n:n_regionkey <urn:d:region/1> BIND(LCASE(?n) AS ?low) } }"), "SELECT op, '<urn:d:g/nation>' AS g, '<urn:d:nation/' || n_nationkey || '>' AS s, '<urn:d:nation#n_name>' AS p, '\"' || CASE op WHEN 'insert' THEN lower(n_name) ELSE n_name END || '\"' AS o FROM nation, (VALUES ('delete'), ('insert')) v(op) WHERE n_regionkey = 1")
frame("q10_clear_graph", lambda s, d: engine(s, d, ["region"]).changes("CLEAR GRAPH <urn:d:g/region>").groupBy("op", "g").count().withColumnRenamed("count", "n"), "SELECT 'delete' AS op, '<urn:d:g/region>' AS g, count(*) * 3 AS n FROM region")
frame("q13_applied_changes", lambda s, d: engine(s, d, ["nation"]).update(PREFIX + 'DELETE WHERE { GRAPH <urn:d:g/nation> { ?x n:n_regionkey <urn:d:region/0> } }').query(PREFIX + "SELECT (COUNT(*) AS ?n) WHERE { ?x n:n_regionkey ?r }").typed(n="long"), "SELECT count(*) AS n FROM nation WHERE n_regionkey <> 0")


def _customers(spark: SparkSession, sf_dir: str, **options) -> Engine:
    """Customers' quads as a table, a graph each nation."""
    return Engine(spark, QuadTable(tpch(spark, sf_dir, ["customer"]).scan(None)), **options)


def _readable(spark: SparkSession, sf_dir: str) -> Engine:
    policies = {f"<{BASE}g/customer/{i}>": Policy(i % 5 == 0, (f"/team/{i % 3}/n{i}",)) for i in range(25)}
    return _customers(spark, sf_dir, policies=policies)


frame("x3_visible_graphs_only", lambda s, d: _readable(s, d).query(PREFIX + "SELECT ?c ?b WHERE { ?c c:c_acctbal ?b }", Grants(read=("/team/1/*",))).typed(c="key", b="double"), "SELECT c_custkey AS c, c_acctbal AS b FROM customer WHERE c_nationkey % 5 = 0 OR c_nationkey % 3 = 1")
frame("x2_public_only", lambda s, d: _readable(s, d).query(PREFIX + "SELECT ?c WHERE { ?c c:c_acctbal ?b }", Grants()).typed(c="key"), "SELECT c_custkey AS c FROM customer WHERE c_nationkey % 5 = 0")
frame("q7_explicit_graphs", lambda s, d: _readable(s, d).query(PREFIX + "SELECT ?c WHERE { ?c c:c_acctbal ?b }", Grants(read=("/team/*",)), [f"<{BASE}g/customer/3>", f"<{BASE}g/customer/4>"]).typed(c="key"), "SELECT c_custkey AS c FROM customer WHERE c_nationkey IN (3, 4)")


def _twice(spark: SparkSession, sf_dir: str) -> Engine:
    """Suppliers' quads in two graphs each."""
    quads = tpch(spark, sf_dir, ["supplier"]).scan(None)
    return Engine(spark, QuadTable(quads.unionByName(quads.withColumn("g", F.lit("<urn:copy>")))))


frame("s5_union_of_copies", lambda s, d: _twice(s, d).query(PREFIX + "SELECT (COUNT(*) AS ?n) WHERE { ?s su:s_acctbal ?b }").typed(n="long"), "SELECT count(*) AS n FROM supplier")
frame("s4_copies_per_graph", lambda s, d: _twice(s, d).query(PREFIX + "SELECT (COUNT(*) AS ?n) WHERE { GRAPH ?g { ?s su:s_acctbal ?b } }").typed(n="long"), "SELECT 2 * count(*) AS n FROM supplier")
frame("s22_fingerprint", lambda s, d: merge.fingerprint(tpch(s, d, ["supplier"]).scan(None)).groupBy().agg(F.sum("n").alias("n"), F.count("g").alias("graphs")), "SELECT count(*)::BIGINT * (SELECT count(*) + 1 FROM (DESCRIBE supplier)) AS n, count(DISTINCT s_nationkey) AS graphs FROM supplier")
frame("s12_overlay", lambda s, d: overlay(tpch(s, d, ["region"]).scan(None), engine(s, d, ["region"]).changes('DELETE WHERE { GRAPH <urn:d:g/region> { ?x <urn:d:region#r_name> ?n } }')).groupBy("p").count().select("p", F.col("count").alias("n")), f"SELECT p, (SELECT count(*) FROM region) AS n FROM (VALUES ('<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>'), ('<urn:d:region#r_regionkey>')) v(p)")

# --- full-text search over documents

_TOKENS = "list_filter(regexp_split_to_array(translate(replace(replace(replace(lower(text), 'ß', 'ss'), 'æ', 'ae'), 'œ', 'oe'), 'àáâãäåçèéêëìíîïñòóôõöøùúûüýÿ', 'aaaaaaceeeeiiiinoooooouuuuyy'), '[^\\p{L}\\p{N}]+'), lambda t: t <> '' AND strlen(t) <= 40)"


def _search(spark: SparkSession, sf_dir: str) -> TextSearch:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return TextSearch(spark, docs.select(F.concat(F.lit(f"<{BASE}g/documents/"), F.col("source"), F.lit(">")).alias("g"), F.concat(F.lit(f"<{BASE}documents/"), F.col("doc_id").cast("string"), F.lit(">")).alias("s"), "text"))


def _bm25(words: list[str], where: str = "true", prefix: bool = True) -> str:
    tf = ", ".join(f"len(list_filter(tokens, lambda t: t = '{w}')) AS tf{i}" for i, w in enumerate(words))
    score = " + ".join(f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / av))" for i in range(len(words)))
    hit = " OR ".join(f"tf{i} > 0" for i in range(len(words)))
    longer = " OR ".join(f"len(list_filter(tokens, lambda t: starts_with(t, '{w}'))) > 0" for w in words if len(w) >= 3) or "false"
    return f"""WITH a AS (SELECT doc_id, {_TOKENS} AS tokens FROM documents WHERE {where}),
 b AS (SELECT doc_id, len(tokens) AS dl, {tf}, ({longer}) AS pre FROM a),
 c AS (SELECT count(*) AS n, avg(dl) AS av, {", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(words)))} FROM b)
 SELECT doc_id, round({score}, 6) AS score FROM b, c WHERE {hit}{" OR pre" if prefix else ""}"""


def _hits(df: DataFrame) -> DataFrame:
    return df.select(F.regexp_extract("s", r"/(\d+)>$", 1).cast("long").alias("doc_id"), F.round("score", 6).alias("score"))


frame("t4_bm25", lambda s, d: _hits(_search(s, d).ranked("trash AND idiot oument", None, prefixes=False)), _bm25(["trash", "idiot", "oument"], prefix=False))
frame("t5_prefixes", lambda s, d: _hits(_search(s, d).ranked("idio eant", None)), _bm25(["idio", "eant"]))
frame("t10_graph_scoped", lambda s, d: _hits(_search(s, d).ranked("ties", None, s.createDataFrame([(f"<{BASE}g/documents/src3>",)], "g string"))), _bm25(["ties"], "source = 'src3'"))
frame("t7_complete", lambda s, d: _search(s, d).complete("token trash").select(F.regexp_extract("s", r"/(\d+)>$", 1).cast("long").alias("doc_id")), f"SELECT doc_id FROM documents WHERE list_has_any({_TOKENS}, ['token', 'trash'])")
frame("t9_search_service", lambda s, d: engine(s, d, ["documents"], search=_search(s, d)).query(PREFIX + 'SELECT ?s ?lang WHERE { SERVICE <urn:quadsmith:fts> { ?s fts:query "token" ; fts:complete true } ?s d:lang ?lang }').typed(s="key", lang="string"), f"SELECT doc_id AS s, lang FROM documents WHERE list_contains({_TOKENS}, 'token')")
frame("t9_ranked_service", lambda s, d: engine(s, d, ["documents"], search=_search(s, d)).query(PREFIX + 'SELECT ?s ?score WHERE { SERVICE <urn:quadsmith:fts> { ?s fts:query "trash" ; fts:complete true ; fts:score ?score } FILTER(?score > 0) }').typed(s="key", score="double").select("s", F.round("score", 6).alias("score")), _bm25(["trash"], prefix=False).replace("SELECT doc_id, round", "SELECT doc_id AS s, round").replace("a AS (SELECT doc_id AS s, ", "a AS (SELECT doc_id, "))
frame("t1_postings", lambda s, d: _search(s, d).postings().groupBy("term").agg(F.count("s").alias("df"), F.sum("tf").alias("cf")).where("df > 50"), f"SELECT term, count(DISTINCT doc_id) AS df, count(*)::BIGINT AS cf FROM (SELECT doc_id, unnest({_TOKENS}) AS term FROM documents) GROUP BY 1 HAVING count(DISTINCT doc_id) > 50")

# --- validation: suppliers must have a balance of 0 to 9000 and a known nation

_SHAPES = f"""<urn:sh:S> <{shacl.SH}targetClass> <{TYPE}supplier>
<urn:sh:S> <{shacl.SH}property> _:b
<urn:sh:S> <{shacl.SH}property> _:n
<urn:sh:S> <{shacl.SH}property> _:m
_:b <{shacl.SH}path> <{BASE}supplier#s_acctbal>
_:b <{shacl.SH}minInclusive> "0"^^<{T.XSD}integer>
_:b <{shacl.SH}maxInclusive> "9000"^^<{T.XSD}integer>
_:b <{shacl.SH}datatype> <{T.XSD}double>
_:n <{shacl.SH}path> <{BASE}supplier#s_nationkey>
_:n <{shacl.SH}class> <{TYPE}nation>
_:n <{shacl.SH}node> <urn:sh:N>
<urn:sh:N> <{shacl.SH}property> _:r
_:r <{shacl.SH}path> <{BASE}nation#n_regionkey>
_:r <{shacl.SH}in> _:l
_:l <{T.RDF}first> <{BASE}region/0>
_:l <{T.RDF}rest> _:l2
_:l2 <{T.RDF}first> <{BASE}region/1>
_:l2 <{T.RDF}rest> <{T.RDF}nil>
_:m <{shacl.SH}path> <{BASE}supplier#s_name>
_:m <{shacl.SH}minCount> "1"^^<{T.XSD}integer>
_:m <{shacl.SH}maxLength> "17"^^<{T.XSD}integer>
_:m <{shacl.SH}pattern> "[13579]$\""""


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    shapes = shacl.Shapes([tuple(line.split(" ", 2)) for line in _SHAPES.split("\n")])
    quads = tpch(spark, sf_dir, ["supplier", "nation"]).scan(None)
    report = shacl.Validator(spark, quads, shapes).report()
    return report.select(F.regexp_extract("focus", r"/(\d+)>$", 1).cast("long").alias("focus"), "component")


frame("v15_shacl_report", _report, """SELECT s_suppkey AS focus, 'minInclusive' AS component FROM supplier WHERE s_acctbal < 0
 UNION ALL SELECT s_suppkey, 'maxInclusive' FROM supplier WHERE s_acctbal > 9000
 UNION ALL SELECT s_suppkey, 'node' FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey > 1
 UNION ALL SELECT s_suppkey, 'maxLength' FROM supplier WHERE length(s_name) > 17
 UNION ALL SELECT s_suppkey, 'pattern' FROM supplier WHERE NOT regexp_matches(s_name, '[13579]$')""")  # fmt: skip

# --- merging: events as operations of their users; an error removes what its user had added under the same key before


def _ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    e = e.withColumn("counter", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long"))
    actor = F.col("user_id").cast("string")
    return e.select(
        actor.alias("actor"),
        "counter",
        F.when(F.col("event_type") == "error", "remove").otherwise("add").alias("kind"),
        F.concat(F.lit("<urn:u:"), (F.col("user_id") % 8).cast("string"), F.lit(">")).alias("g"),
        F.concat(F.lit("<urn:k:"), F.get_json_object("props", "$.k"), F.lit(">")).alias("s"),
        F.lit("<urn:p>").alias("p"),
        F.concat(F.lit('"'), F.when(F.col("event_type") == "error", "click").otherwise(F.col("event_type")), F.lit('"')).alias("o"),
        F.create_map(actor, F.col("counter") - 1).alias("witnessed"),
        F.col("event_id").alias("id"),
        F.col("ts").alias("at"),
    )


_OPS = "WITH op AS (SELECT user_id::VARCHAR AS actor, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS counter, event_type = 'error' AS gone, '<urn:u:' || user_id % 8 || '>' AS g, '<urn:k:' || (props->>'$.k') || '>' AS s, '\"' || CASE event_type WHEN 'error' THEN 'click' ELSE event_type END || '\"' AS o FROM events), dot AS (SELECT g, s, o, actor, counter FROM op a WHERE NOT gone AND NOT EXISTS (SELECT 1 FROM op r WHERE r.gone AND r.g = a.g AND r.s = a.s AND r.o = a.o AND r.actor = a.actor AND r.counter > a.counter))"
frame("r2_dots", lambda s, d: merge.dots(_ops(s, d)).select("g", "s", "o", "actor", "counter"), f"{_OPS} SELECT g, s, o, actor, counter FROM dot")
frame("r3_live_view", lambda s, d: merge.live(merge.dots(_ops(s, d))).select("g", "s", "o"), f"{_OPS} SELECT DISTINCT g, s, o FROM dot")
frame("r6_replay", lambda s, d: merge.live(merge.dots(_ops(s, d).unionByName(_ops(s, d)))).groupBy("g").count().select("g", F.col("count").alias("n")), f"{_OPS} SELECT g, count(DISTINCT (s, o)) AS n FROM dot GROUP BY 1")
frame("r4_merged_clock", lambda s, d: merge.merge_clocks(merge.clock(_ops(s, d).where("counter < 20")), merge.clock(_ops(s, d))), f"{_OPS} SELECT g, actor, max(counter) AS counter FROM op GROUP BY 1, 2")


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One replica has the first 40 operations of each actor, the other all of the even actors."""
    ops = _ops(spark, sf_dir)
    a, b = ops.where("counter <= 40"), ops.where("CAST(actor AS long) % 2 = 0")
    return merge.merge(merge.dots(a), merge.clock(a), merge.dots(b), merge.clock(b)).select("g", "s", "o", "actor", "counter")


frame("r4_snapshot_join", _merged, _OPS.replace("FROM events)", "FROM events), part AS (SELECT * FROM op WHERE counter <= 40 OR actor::BIGINT % 2 = 0)").replace("FROM op a", "FROM part a").replace("FROM op r", "FROM part r") + " SELECT g, s, o, actor, counter FROM dot")
frame("r5_missing_dots", lambda s, d: merge.missing(_ops(s, d).where("counter % 10 = 0").select("g", F.col("id").alias("batch"), F.col("witnessed").alias("base")), merge.clock(_ops(s, d).where("counter <= 25"))).select("g", "batch", "actor", "from", "to"), 'WITH op AS (SELECT event_id AS batch, user_id::VARCHAR AS actor, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS counter, \'<urn:u:\' || user_id % 8 || \'>\' AS g FROM events), seen AS (SELECT actor, max(counter) AS have FROM op WHERE counter <= 25 GROUP BY 1) SELECT g, batch, actor, have + 1 AS "from", counter - 1 AS "to" FROM op JOIN seen USING (actor) WHERE counter % 10 = 0 AND counter - 1 > have')
frame("r7_policy_register", lambda s, d: merge.register(s.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("g"), F.col("event_type").alias("value"), F.struct("ts", "event_id").alias("tag"))).select("g", "value"), "SELECT user_id AS g, arg_max(event_type, (ts, event_id)) AS value FROM events GROUP BY 1")
frame("r8_tombstones", lambda s, d: merge.live(merge.without_deleted(merge.dots(_ops(s, d)), s.createDataFrame([("<urn:u:3>",)], "g string"))).groupBy("g").count().select("g", F.col("count").alias("n")), f"{_OPS} SELECT g, count(DISTINCT (s, o)) AS n FROM dot WHERE g <> '<urn:u:3>' GROUP BY 1")
frame("r14_history_compare", lambda s, d: merge.compare(merge.live(merge.dots(_ops(s, d).where("counter <= 30"))), merge.live(merge.dots(_ops(s, d)))).select("op", "g", "s", "o"), _OPS.replace("dot AS", "old AS (SELECT DISTINCT g, s, o FROM op a WHERE NOT gone AND counter <= 30 AND NOT EXISTS (SELECT 1 FROM op r WHERE r.gone AND r.counter <= 30 AND r.g = a.g AND r.s = a.s AND r.o = a.o AND r.actor = a.actor AND r.counter > a.counter)), dot AS") + ", new AS (SELECT DISTINCT g, s, o FROM dot) SELECT 'delete' AS op, * FROM (FROM old EXCEPT FROM new) UNION ALL SELECT 'insert', * FROM (FROM new EXCEPT FROM old)")

# --- structural rules: conversations as packages of their turns


def _packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph for each conversation; turns are chained by hasPart, but one in seven turns is not linked."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role").distinct()
    root = F.concat(F.lit("<urn:c:"), F.col("conv_id").cast("string"), F.lit(">"))
    node = lambda t: F.when(t < 0, root).otherwise(F.concat(F.lit("<urn:c:"), F.col("conv_id").cast("string"), F.lit("/"), t.cast("string"), F.lit(">")))
    turn = F.col("turn")
    part = lambda s, p, o: F.struct(s.alias("s"), F.lit(p).alias("p"), o.alias("o"))
    rows = [part(root, T.RDF_TYPE, F.lit(rules.DATASET)), part(node(turn), T.RDF_TYPE, F.lit(rules.MEDIA)), part(root, rules.REQUIRED[0], F.lit('"c"')), F.when(turn % 7 != 5, part(node(turn - 1), rules.HAS_PART, node(turn)))]
    return c.select(root.alias("g"), F.explode(F.array(*rows)).alias("q")).where("q IS NOT NULL").select("g", "q.s", "q.p", "q.o").distinct()


_TURNS = "WITH t AS (SELECT DISTINCT conv_id, turn FROM conversations)"
frame("c6_orphans", lambda s, d: rules.orphans(_packages(s, d)), f"{_TURNS} SELECT '<urn:c:' || conv_id || '>' AS g, '<urn:c:' || conv_id || '/' || turn || '>' AS entity FROM t a WHERE EXISTS (SELECT 1 FROM t b WHERE b.conv_id = a.conv_id AND b.turn <= a.turn AND b.turn % 7 = 5) OR (SELECT count(*) FROM t b WHERE b.conv_id = a.conv_id AND b.turn <= a.turn) <> turn + 1")
frame("c1_rules", lambda s, d: rules.violations(_packages(s, d)).where("rule <> 'orphan'").groupBy("rule").count().select("rule", F.col("count").alias("n")), "SELECT rule, (SELECT count(DISTINCT conv_id) FROM conversations) AS n FROM (VALUES ('descriptor-type'), ('descriptor-about'), ('required-description'), ('required-datePublished')) v(rule)")
frame("x3_orphans_hidden", lambda s, d: Engine(s, QuadTable(_packages(s, d)), hidden=rules.orphans(_packages(s, d))).query(f"SELECT (COUNT(*) AS ?n) WHERE {{ GRAPH ?g {{ ?x a {rules.MEDIA} }} }}").typed(n="long"), f"{_TURNS} SELECT count(*) AS n FROM t a WHERE NOT (EXISTS (SELECT 1 FROM t b WHERE b.conv_id = a.conv_id AND b.turn <= a.turn AND b.turn % 7 = 5) OR (SELECT count(*) FROM t b WHERE b.conv_id = a.conv_id AND b.turn <= a.turn) <> turn + 1)")

from . import coverage  # noqa: E402, F401  (registers more)
