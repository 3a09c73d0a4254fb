"""More registered queries: shapes, documents, entity edits, history and engine features, one for each operator of the survey."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import _TOKENS, BASE, PREFIX, TYPE, _ops, _packages, _search, engine, frame, sparql
from .engine import Engine
from .functions import terms as T
from .operators import merge, rules, shacl
from .operators.search import words_of
from .session import shared_dir
from .sources import jsonld
from .sources.quads import QuadTable, read_nquads, tpch, write_nquads

# --- validation, a component at a time, over the relational tables

_ACCTBAL, _NATION, _REGION = f"<{BASE}supplier#s_acctbal>", f"<{BASE}supplier#s_nationkey>", f"<{BASE}nation#n_regionkey>"
_SUPPLIER, _OF_NATION, _CUSTOMER = f"<{TYPE}supplier>", f"<{TYPE}nation>", f"<{TYPE}customer>"
_C = f"<{BASE}customer#c_"


def _n(x: int) -> str:
    return f'"{x}"^^<{T.XSD}integer>'


def _list(name: str, items: list[str]) -> list[tuple[str, str, str]]:
    cells = [name, *(f"{name}{i}" for i in range(1, len(items))), f"<{T.RDF}nil>"]
    return [t for i, x in enumerate(items) for t in ((cells[i], f"<{T.RDF}first>", x), (cells[i], f"<{T.RDF}rest>", cells[i + 1]))]


def _shapes(*triples: tuple[str, str, str]) -> shacl.Shapes:
    """Triples whose predicates and short objects are names of the shapes vocabulary."""
    whole = lambda x: f"<{shacl.SH}{x}>"
    return shacl.Shapes([(s, p if p.startswith("<") else whole(p), o) for s, p, o in triples])


def _property(target: str, path: str, *constraints: tuple[str, str]) -> list[tuple[str, str, str]]:
    return [("<urn:S>", "targetClass", target), ("<urn:S>", "property", "_:p"), ("_:p", "path", path), *(("_:p", c, o) for c, o in constraints)]


def shape(name: str, triples: list[tuple[str, str, str]], tables: list[str], sql: str, distinct: bool = False) -> None:
    """Register a report: (focus, component), each row as often as a value violates, or once."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        report = shacl.Validator(spark, tpch(spark, sf_dir, tables).scan(None), _shapes(*triples)).report()
        out = report.select(F.regexp_extract("focus", r"/(\d+)>$", 1).cast("long").alias("focus"), "component")
        return out.distinct() if distinct else out

    frame(name, run, sql)


_S, _SN, _CU = ["supplier"], ["supplier", "nation"], ["customer"]
_INVERSE = ("_:i", "inversePath", _NATION)
_RICH = ("<urn:R>", "property", "_:r"), ("_:r", "path", f"{_C}acctbal>"), ("_:r", "minExclusive", _n(5000))
_BUILDS = ("<urn:B>", "property", "_:m"), ("_:m", "path", f"{_C}mktsegment>"), ("_:m", "hasValue", '"BUILDING"')
shape("v1_target_node", [("<urn:S>", "targetNode", f"<{BASE}nation/3>"), ("<urn:S>", "class", f"<{TYPE}region>")], ["nation"], "SELECT 3::BIGINT AS focus, 'class' AS component")
shape("v1_target_subjects_of", [("<urn:S>", "targetSubjectsOf", _NATION), ("<urn:S>", "property", "_:p"), ("_:p", "path", _ACCTBAL), ("_:p", "maxInclusive", _n(5000))], _S, "SELECT s_suppkey AS focus, 'maxInclusive' AS component FROM supplier WHERE s_acctbal > 5000")
shape("v1_target_objects_of", [("<urn:S>", "targetObjectsOf", _NATION), ("<urn:S>", "property", "_:p"), ("_:p", "path", _REGION), ("_:p", "in", "_:l"), *_list("_:l", [f"<{BASE}region/0>", f"<{BASE}region/2>"])], _SN, "SELECT n_nationkey::BIGINT AS focus, 'in' AS component FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier) AND n_regionkey NOT IN (0, 2)")
shape("v3_sequence_path", [*_property(_SUPPLIER, "_:q", ("in", "_:l")), *_list("_:q", [_NATION, _REGION]), *_list("_:l", [f"<{BASE}region/0>", f"<{BASE}region/1>"])], _SN, "SELECT s_suppkey AS focus, 'in' AS component FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey > 1")
shape("v3_inverse_path", [*_property(_OF_NATION, "_:i", ("maxCount", _n(4))), _INVERSE], _SN, "SELECT n_nationkey::BIGINT AS focus, 'maxCount' AS component FROM nation WHERE (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) > 4")
shape("v4_min_count", [*_property(_OF_NATION, "_:i", ("minCount", _n(4))), _INVERSE], _SN, "SELECT n_nationkey::BIGINT AS focus, 'minCount' AS component FROM nation WHERE (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) < 4")
shape("v5_class", _property(_SUPPLIER, _NATION, ("class", f"<{TYPE}region>")), _SN, "SELECT s_suppkey AS focus, 'class' AS component FROM supplier")
shape("v6_datatype", _property(_SUPPLIER, f"<{BASE}supplier#s_name>", ("datatype", f"<{T.XSD}integer>")), _S, "SELECT s_suppkey AS focus, 'datatype' AS component FROM supplier")
shape("v6_node_kind", _property(_SUPPLIER, _NATION, ("nodeKind", f"<{shacl.SH}Literal>")), _S, "SELECT s_suppkey AS focus, 'nodeKind' AS component FROM supplier")
shape("v7_exclusive", _property(_CUSTOMER, f"{_C}acctbal>", ("minExclusive", _n(0)), ("maxExclusive", _n(9000))), _CU, "SELECT c_custkey AS focus, 'minExclusive' AS component FROM customer WHERE c_acctbal <= 0 UNION ALL SELECT c_custkey, 'maxExclusive' FROM customer WHERE c_acctbal >= 9000")
shape("v8_min_length", _property(_OF_NATION, f"<{BASE}nation#n_name>", ("minLength", _n(9))), ["nation"], "SELECT n_nationkey::BIGINT AS focus, 'minLength' AS component FROM nation WHERE length(n_name) < 9")
shape("v8_pattern", _property(_OF_NATION, f"<{BASE}nation#n_name>", ("pattern", '"_1[0-9]?$"')), ["nation"], "SELECT n_nationkey::BIGINT AS focus, 'pattern' AS component FROM nation WHERE NOT regexp_matches(n_name, '_1[0-9]?$')")
shape("v9_language_in", [*_property(f"<{TYPE}region>", f"<{BASE}region#r_name>", ("languageIn", "_:l")), *_list("_:l", ['"en"'])], ["region"], "SELECT r_regionkey::BIGINT AS focus, 'languageIn' AS component FROM region")
shape("v10_has_value", _property(_CUSTOMER, f"{_C}mktsegment>", ("hasValue", '"BUILDING"')), _CU, "SELECT c_custkey AS focus, 'hasValue' AS component FROM customer WHERE c_mktsegment <> 'BUILDING'")
shape("v11_equals", _property(f"<{TYPE}part>", f"<{BASE}part#p_brand>", ("equals", f"<{BASE}part#p_type>")), ["part"], "SELECT p_partkey AS focus, 'equals' AS component FROM part WHERE p_brand <> p_type", distinct=True)
shape("v11_less_than", _property(f"<{TYPE}part>", f"<{BASE}part#p_retailprice>", ("lessThan", f"<{BASE}part#p_size>")), ["part"], "SELECT p_partkey AS focus, 'lessThan' AS component FROM part WHERE p_retailprice >= p_size")
shape("v12_or", [("<urn:S>", "targetClass", _CUSTOMER), ("<urn:S>", "or", "_:l"), *_list("_:l", ["<urn:R>", "<urn:B>"]), *_RICH, *_BUILDS], _CU, "SELECT c_custkey AS focus, 'or' AS component FROM customer WHERE NOT (c_acctbal > 5000 OR c_mktsegment = 'BUILDING')")
shape("v12_and", [("<urn:S>", "targetClass", _CUSTOMER), ("<urn:S>", "and", "_:l"), *_list("_:l", ["<urn:R>", "<urn:B>"]), *_RICH, *_BUILDS], _CU, "SELECT c_custkey AS focus, 'and' AS component FROM customer WHERE NOT (c_acctbal > 5000 AND c_mktsegment = 'BUILDING')")
shape("v12_xone", [("<urn:S>", "targetClass", _CUSTOMER), ("<urn:S>", "xone", "_:l"), *_list("_:l", ["<urn:R>", "<urn:B>"]), *_RICH, *_BUILDS], _CU, "SELECT c_custkey AS focus, 'xone' AS component FROM customer WHERE (c_acctbal > 5000) = (c_mktsegment = 'BUILDING')")
shape("v12_not", [("<urn:S>", "targetClass", _CUSTOMER), ("<urn:S>", "not", "<urn:B>"), *_BUILDS], _CU, "SELECT c_custkey AS focus, 'not' AS component FROM customer WHERE c_mktsegment = 'BUILDING'")
shape("v13_qualified", [*_property(_OF_NATION, "_:i", ("qualifiedValueShape", "<urn:Q>"), ("qualifiedMinCount", _n(2))), _INVERSE, ("<urn:Q>", "property", "_:b"), ("_:b", "path", _ACCTBAL), ("_:b", "minInclusive", _n(5000))], _SN, "SELECT n_nationkey::BIGINT AS focus, 'qualifiedMinCount' AS component FROM nation WHERE (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal >= 5000) < 2")
shape("v14_closed", [("<urn:S>", "targetClass", _SUPPLIER), ("<urn:S>", "closed", f'"true"^^<{T.XSD}boolean>'), ("<urn:S>", "ignoredProperties", "_:l"), *_list("_:l", [T.RDF_TYPE, _NATION])], _S, "SELECT s_suppkey AS focus, 'closed' AS component FROM supplier", distinct=True)


def _delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the change of one nation's region can violate: its suppliers' shape looks two steps far."""
    shapes = _shapes(*_property(_SUPPLIER, "_:q", ("in", "_:l")), *_list("_:q", [_NATION, _REGION]), *_list("_:l", [f"<{BASE}region/9>"]))
    changed = spark.createDataFrame([(f"<{BASE}nation/4>", f"<{BASE}region/8>")], "s string, o string")
    report = shacl.Validator(spark, tpch(spark, sf_dir, _SN).scan(None), shapes).delta(changed)
    return report.select(F.regexp_extract("focus", r"/(\d+)>$", 1).cast("long").alias("focus")).where(F.col("focus").isNotNull()).join(spark.read.parquet(f"{sf_dir}/supplier.parquet").where("s_nationkey = 4").select(F.col("s_suppkey").alias("focus")), "focus", "left_semi").distinct()


frame("v19_incremental", _delta, "SELECT s_suppkey AS focus FROM supplier WHERE s_nationkey = 4")

# --- documents: conversations as JSON-LD packages of one entity a role

_SPEAKS = "WITH r AS (SELECT DISTINCT conv_id, role FROM conversations)"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(g, document): compact JSON-LD with a vocabulary, an entity for each role."""
    r = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "role").distinct()
    g = F.concat(F.lit("<urn:c:"), F.col("conv_id").cast("string"), F.lit(">"))
    node = F.struct(F.concat(F.lit("urn:r:"), "role").alias("@id"), F.lit("Role").alias("@type"), F.col("role").alias("name"))
    graph = F.to_json(F.struct(F.struct(F.lit("urn:v#").alias("@vocab")).alias("@context"), F.array_sort(F.collect_list(node)).alias("@graph")))
    return r.groupBy(g.alias("g")).agg(graph.alias("document"))


_READ = f"""{_SPEAKS} SELECT '<urn:c:' || conv_id || '>' AS g, '<urn:r:' || role || '>' AS s, '<urn:v#name>' AS p, '"' || role || '"' AS o FROM r
 UNION ALL SELECT '<urn:c:' || conv_id || '>', '<urn:r:' || role || '>', '{T.RDF_TYPE}', '<urn:v#Role>' FROM r"""
frame("s14_jsonld_read", lambda s, d: jsonld.read_documents(_documents(s, d)), _READ)
frame("s16_jsonld_round_trip", lambda s, d: jsonld.read_documents(jsonld.write_documents(jsonld.read_documents(_documents(s, d)))), _READ)
frame("s17_jsonld_summary", lambda s, d: jsonld.read_documents(jsonld.summary(_packages(s, d))), f"SELECT DISTINCT '<urn:c:' || conv_id || '>' AS g, '<urn:c:' || conv_id || '>' AS s, x.p, CASE x.p WHEN 'part' THEN '<urn:c:' || conv_id || '/0>' ELSE x.o END AS o FROM conversations, (VALUES ('{T.RDF_TYPE}', '{rules.DATASET}'), ('{rules.REQUIRED[0]}', '\"c\"')) x(p, o) UNION ALL SELECT DISTINCT '<urn:c:' || conv_id || '>', '<urn:c:' || conv_id || '>', '{rules.HAS_PART}', '<urn:c:' || conv_id || '/0>' FROM conversations WHERE turn = 0")


def _hub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One package of all nations."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    node = F.concat(F.lit("<urn:n:"), F.lpad(F.col("n_nationkey").cast("string"), 3, "0"), F.lit(">"))
    rows = F.array(F.struct(F.lit("<urn:hub>").alias("s"), F.lit(f"<{T.SCHEMA}hasPart>").alias("p"), node.alias("o")), F.struct(node.alias("s"), F.lit("<urn:v#name>").alias("p"), F.concat(F.lit('"'), "n_name", F.lit('"')).alias("o")))
    return n.select(F.lit("<urn:hub>").alias("g"), F.explode(rows).alias("q")).select("g", "q.*")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, total, after = jsonld.page(_hub(spark, sf_dir), "<urn:hub>", 5, 10)
    return rows.select("s", F.get_json_object("node", "$['urn:v#name'][0]['@value']").alias("name"), F.lit(total).cast("long").alias("total"), F.lit(after).cast("long").alias("after"))


def _cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    quads = _hub(spark, sf_dir)
    _, cursor = jsonld.page_after(quads, "<urn:hub>", None, 7)
    return jsonld.page_after(quads, "<urn:hub>", cursor, 7)[0].select("s", F.get_json_object("node", "$['urn:v#name'][0]['@value']").alias("name"))


frame("s18_jsonld_page", _pages, "SELECT '<urn:n:' || lpad(n_nationkey::VARCHAR, 3, '0') || '>' AS s, n_name AS name, (SELECT count(*) FROM nation) AS total, 15::BIGINT AS after FROM nation ORDER BY n_nationkey LIMIT 10 OFFSET 5")
frame("s19_jsonld_cursor", _cursor, "SELECT '<urn:n:' || lpad(n_nationkey::VARCHAR, 3, '0') || '>' AS s, n_name AS name FROM nation ORDER BY n_nationkey LIMIT 7 OFFSET 7")


def _nquads(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    write_nquads(_packages(spark, sf_dir), path)
    return read_nquads(spark, path).where(F.col("p") == rules.HAS_PART).select("g", "s", "o")


_CHAIN = "SELECT DISTINCT '<urn:c:' || conv_id || '>' AS g, CASE WHEN turn = 0 THEN '<urn:c:' || conv_id || '>' ELSE '<urn:c:' || conv_id || '/' || (turn - 1) || '>' END AS s, '<urn:c:' || conv_id || '/' || turn || '>' AS o FROM conversations WHERE turn % 7 <> 5"
frame("s15_nquads", _nquads, _CHAIN)


def _snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot is the quads as Parquet; an engine over what is read back."""
    path = shared_dir(spark)
    _packages(spark, sf_dir).write.parquet(path)
    found = Engine(spark, QuadTable(spark.read.parquet(path))).query(f"SELECT ?g ?s ?o WHERE {{ GRAPH ?g {{ ?s {rules.HAS_PART} ?o }} }}")
    return found.df.select("g", "s", "o")


frame("s20_snapshot", _snapshot, _CHAIN)


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = tpch(spark, sf_dir, ["customer"]).scan(f"{_C}acctbal>")
    return q.select(F.regexp_extract(T.iri_text(F.col("s")), r"(\d+)$", 1).cast("long").alias("s"), T.lex(F.col("o")).cast("double").alias("value"), T.datatype(F.col("o")).alias("datatype"))


frame("s13_term_decode", _terms, f"SELECT c_custkey AS s, c_acctbal AS value, '{T.XSD}double' AS datatype FROM customer")

# --- entity edits

_COLUMNS = ["op", "g", "s", "p", "o"]


def _replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packages' documents without the user's turns' types, and with a new name for each root."""
    old = jsonld.read_documents(_documents(spark, sf_dir))
    new = old.where("s <> '<urn:r:user>'").unionByName(old.select("g", F.col("g").alias("s"), F.lit("<urn:v#name>").alias("p"), F.lit('"new"').alias("o")).distinct())
    return rules.replacement(new, old).select(*_COLUMNS)


frame("c8_replacement", _replaced, f"""{_SPEAKS} SELECT 'delete' AS op, '<urn:c:' || conv_id || '>' AS g, '<urn:r:user>' AS s, x.p, x.o FROM r, (VALUES ('<urn:v#name>', '"user"'), ('{T.RDF_TYPE}', '<urn:v#Role>')) x(p, o) WHERE role = 'user'
 UNION ALL SELECT DISTINCT 'insert', '<urn:c:' || conv_id || '>', '<urn:c:' || conv_id || '>', '<urn:v#name>', '"new"' FROM r""")
frame("c10_scaffold", lambda s, d: s.createDataFrame(rules.scaffold("<urn:c:9/>", "n", "d", "2024-05-06"), "g string, s string, p string, o string").where(F.col("s") == "<urn:c:9/>").select("p", "o"), f"SELECT * FROM (VALUES ('{T.RDF_TYPE}', '{rules.DATASET}'), ('{rules.REQUIRED[0]}', '\"n\"'), ('{rules.REQUIRED[1]}', '\"d\"'), ('{rules.REQUIRED[2]}', '\"2024-05-06\"')) v(p, o)")
frame("c11_patch", lambda s, d: rules.patch(_hub(s, d), "<urn:hub>", "<urn:n:007>", {"<urn:v#name>": ['"seven"']}).select(*_COLUMNS), "SELECT 'delete' AS op, '<urn:hub>' AS g, '<urn:n:007>' AS s, '<urn:v#name>' AS p, '\"' || n_name || '\"' AS o FROM nation WHERE n_nationkey = 7 UNION ALL SELECT 'insert', '<urn:hub>', '<urn:n:007>', '<urn:v#name>', '\"seven\"'")
frame("c11_remove", lambda s, d: rules.remove(_hub(s, d), "<urn:hub>", "<urn:n:007>").select(*_COLUMNS), f"SELECT 'delete' AS op, '<urn:hub>' AS g, '<urn:n:007>' AS s, '<urn:v#name>' AS p, '\"' || n_name || '\"' AS o FROM nation WHERE n_nationkey = 7 UNION ALL SELECT 'delete', '<urn:hub>', '<urn:hub>', '<{T.SCHEMA}hasPart>', '<urn:n:007>'")
frame("c11_upsert", lambda s, d: rules.upsert(_hub(s, d), "<urn:hub>", "<urn:n:099>", [("<urn:v#name>", '"new"')], "<urn:hub>").select(*_COLUMNS), f"SELECT * FROM (VALUES ('insert', '<urn:hub>', '<urn:n:099>', '<urn:v#name>', '\"new\"'), ('insert', '<urn:hub>', '<urn:hub>', '{rules.HAS_PART}', '<urn:n:099>')) v(op, g, s, p, o)")
frame("c9_version", lambda s, d: s.createDataFrame([(jsonld.version_of('{"@context": "https://w3id.org/ro/crate/' + v + '/context", "@graph": []}'), v) for v in ("1.1", "1.2", "7.0")], "found string, said string"), "SELECT * FROM (VALUES ('1.1', '1.1'), ('1.2', '1.2'), (NULL, '7.0')) v(found, said)")

# --- history: each actor's operations are a chain, an actor's graph by itself


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = _ops(spark, sf_dir).withColumn("g", F.concat(F.lit("<urn:a:"), "actor", F.lit(">")))
    return ops.withColumn("parents", F.when(F.col("counter") > 1, F.array(F.col("counter") - 1)).otherwise(F.array().cast("array<bigint>"))).withColumn("id", F.col("counter"))


_ACTORS = "WITH op AS (SELECT user_id::VARCHAR AS actor, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS counter, event_type = 'error' AS gone, '<urn:a:' || user_id || '>' AS g, '<urn:k:' || (props->>'$.k') || '>' AS s, '\"' || CASE event_type WHEN 'error' THEN 'click' ELSE event_type END || '\"' AS o FROM events)"
frame("r13_heads", lambda s, d: merge.heads(_history(s, d)).select("g", "id"), f"{_ACTORS} SELECT g, max(counter) AS id FROM op GROUP BY 1")
frame("r13_log", lambda s, d: merge.log(_history(s, d), "<urn:a:3>", 5).select("id"), f"{_ACTORS} SELECT counter AS id FROM op WHERE g = '<urn:a:3>' ORDER BY counter DESC LIMIT 5")
frame("r15_project", lambda s, d: merge.project(_history(s, d), _history(s, d).where("counter = 4")).select("g", "s", "o"), f"{_ACTORS}, long AS (SELECT actor FROM op GROUP BY 1 HAVING count(*) >= 4), part AS (SELECT * FROM op WHERE counter <= 4 AND actor IN (SELECT actor FROM long)) SELECT DISTINCT g, s, o FROM part a WHERE NOT gone AND NOT EXISTS (SELECT 1 FROM part r WHERE r.gone AND r.g = a.g AND r.s = a.s AND r.o = a.o AND r.counter > a.counter)")

# --- forms of queries


def _prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = engine(spark, sf_dir, ["nation"])
    text = own.prepare(PREFIX + "SELECT ?s ?n WHERE { ?s n:n_name ?n }")
    first, second = (own.query(text).typed(s="key", n="string") for _ in range(2))
    return first.unionByName(second)


frame("q5_prepared_twice", _prepared, "SELECT n_nationkey::BIGINT AS s, n_name AS n FROM nation UNION ALL SELECT n_nationkey, n_name FROM nation")
frame("q6_explain", lambda s, d: s.createDataFrame([(x.startswith("algebra: "), "Physical Plan" in x) for x in [engine(s, d, ["nation"]).explain(PREFIX + "SELECT ?s WHERE { ?s n:n_name ?n }")]], "algebra boolean, plan boolean"), "SELECT true AS algebra, true AS plan")
sparql("f15_uuid", "SELECT ?s ?fits WHERE { ?s r:r_name ?n BIND(REGEX(STRUUID(), '^[0-9a-f]{8}-([0-9a-f]{4}-){3}[0-9a-f]{12}$') AS ?fits) }", {"s": "key", "fits": "boolean"}, "SELECT r_regionkey::BIGINT AS s, true AS fits FROM region", ["region"])
sparql("o4_slice_over_union", "SELECT ?s WHERE { { ?s r:r_name ?n } UNION { ?s n:n_name ?n } } ORDER BY ?n LIMIT 8", {"s": "iri"}, f"SELECT '{BASE}' || s AS s FROM (SELECT 'region/' || r_regionkey AS s, r_name AS n FROM region UNION ALL SELECT 'nation/' || n_nationkey, n_name FROM nation) ORDER BY n LIMIT 8", ["region", "nation"])
sparql("s8_bounded_count", "SELECT (COUNT(*) AS ?n) WHERE { { SELECT ?s WHERE { ?s o:o_orderstatus \"F\" } LIMIT 100 } }", {"n": "long"}, "SELECT count(*) AS n FROM (SELECT 1 FROM orders WHERE o_orderstatus = 'F' LIMIT 100)", ["orders"])
sparql("a6_predicate_count", "SELECT (COUNT(*) AS ?n) WHERE { ?s o:o_totalprice ?t }", {"n": "long"}, "SELECT count(*) AS n FROM orders", ["orders"])
sparql("j4_either_order", "SELECT ?c ?name WHERE { ?c c:c_nationkey ?n . ?n n:n_name ?name . ?n n:n_regionkey <urn:d:region/2> }", {"c": "key", "name": "string"}, "SELECT c_custkey AS c, n_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2", ["customer", "nation"])
frame("t2_sanitized", lambda s, d: s.createDataFrame([(w,) for w in words_of('trash AND "idiot" OR (Straße) -x:~2 trash')], "word string"), "SELECT * FROM (VALUES ('trash'), ('idiot'), ('strasse'), ('x'), ('2')) v(word)")
frame("t11_hydrated", lambda s, d: _search(s, d).hydrated(_search(s, d).complete("token"), tpch(s, d, ["documents"]).scan(f"<{BASE}documents#lang>")).select(F.regexp_extract("s", r"/(\d+)>$", 1).cast("long").alias("doc_id"), T.lex(F.col("o")).alias("lang")), f"SELECT doc_id, lang FROM documents WHERE lang IS NOT NULL AND list_contains({_TOKENS}, 'token')")
