"""Validation, rules, merging, documents and streams on small data."""

import json

import pytest

from quadsmith.functions import terms as T
from quadsmith.operators import merge, rules, shacl
from quadsmith.sources import jsonld
from quadsmith.streaming.oplog import OPS, OpLog

SCHEMA = "g string, s string, p string, o string"
SH = shacl.SH
CONTEXT = "https://w3id.org/ro/crate/1.1/context"


def n(x):
    return T.literal(str(x), f"{T.XSD}integer")


TRUE = T.literal("true", f"{T.XSD}boolean")


def sh(x):
    return f"<{SH}{x}>"


def lists(name, items):
    out, node = [], name
    for k, item in enumerate(items):
        rest = f"{name}_{k}" if k < len(items) - 1 else f"<{T.RDF}nil>"
        out += [(node, f"<{T.RDF}first>", item), (node, f"<{T.RDF}rest>", rest)]
        node = rest
    return out


DATA = [("<a>", T.RDF_TYPE, "<C>"), ("<b>", T.RDF_TYPE, "<C>"), ("<c>", T.RDF_TYPE, "<C>"), ("<a>", "<v>", n(5)), ("<b>", "<v>", n(50)), ("<b>", "<v>", '"x"@en'), ("<b>", "<w>", '"y"@en'), ("<b>", "<w>", '"z"@EN'.lower()), ("<c>", "<k>", "<a>"), ("<a>", "<k>", "<b>"), ("<c>", "<u>", n(9)), ("<c>", "<v>", n(9))]


def case(*triples):
    return [("<S>", sh("targetClass"), "<C>"), ("<S>", sh("property"), "_:p"), *triples]


CASES = {
    "minCount": (case(("_:p", sh("path"), "<k>"), ("_:p", sh("minCount"), n(1))), {"<b>"}),
    "maxCount": (case(("_:p", sh("path"), "<v>"), ("_:p", sh("maxCount"), n(1))), {"<b>"}),
    "maxInclusive": (case(("_:p", sh("path"), "<v>"), ("_:p", sh("maxInclusive"), n(9))), {"<b>"}),
    "datatype": (case(("_:p", sh("path"), "<v>"), ("_:p", sh("datatype"), f"<{T.XSD}integer>")), {"<b>"}),
    "class": (case(("_:p", sh("path"), "<v>"), ("_:p", sh("class"), "<C>")), {"<a>", "<b>", "<c>"}),
    "nodeKind": (case(("_:p", sh("path"), "<k>"), ("_:p", sh("nodeKind"), sh("Literal"))), {"<a>", "<c>"}),
    "minLength": (case(("_:p", sh("path"), "<v>"), ("_:p", sh("minLength"), n(2))), {"<a>", "<b>", "<c>"}),
    "pattern": (case(("_:p", sh("path"), "<v>"), ("_:p", sh("pattern"), '"^[0-9]+$"')), {"<b>"}),
    "uniqueLang": (case(("_:p", sh("path"), "<w>"), ("_:p", sh("uniqueLang"), TRUE)), {"<b>"}),
    "languageIn": (case(("_:p", sh("path"), "<w>"), ("_:p", sh("languageIn"), "_:l"), *lists("_:l", ['"de"'])), {"<b>"}),
    "in": (case(("_:p", sh("path"), "<v>"), ("_:p", sh("in"), "_:l"), *lists("_:l", [n(5), n(9)])), {"<b>"}),
    "hasValue": (case(("_:p", sh("path"), "<k>"), ("_:p", sh("hasValue"), "<a>")), {"<a>", "<b>"}),
    "equals": (case(("_:p", sh("path"), "<u>"), ("_:p", sh("equals"), "<v>")), {"<a>", "<b>"}),
    "disjoint": (case(("_:p", sh("path"), "<u>"), ("_:p", sh("disjoint"), "<v>")), {"<c>"}),
    "lessThan": (case(("_:p", sh("path"), "<u>"), ("_:p", sh("lessThan"), "<v>")), {"<c>"}),
    "lessThanOrEquals": (case(("_:p", sh("path"), "<u>"), ("_:p", sh("lessThanOrEquals"), "<v>")), set()),
    "inverse path": (case(("_:p", sh("path"), "_:i"), ("_:i", sh("inversePath"), "<k>"), ("_:p", sh("minCount"), n(1))), {"<c>"}),
    "path of two": (case(("_:p", sh("path"), "_:l"), *lists("_:l", ["<k>", "<k>"]), ("_:p", sh("maxCount"), n(0))), {"<c>"}),
    "zero or more": (case(("_:p", sh("path"), "_:z"), ("_:z", sh("zeroOrMorePath"), "<k>"), ("_:p", sh("maxCount"), n(2))), {"<c>"}),
    "alternative": (case(("_:p", sh("path"), "_:z"), ("_:z", sh("alternativePath"), "_:l"), *lists("_:l", ["<u>", "<k>"]), ("_:p", sh("minCount"), n(2))), {"<a>", "<b>"}),
    "not": ([("<S>", sh("targetClass"), "<C>"), ("<S>", sh("not"), "<N>"), ("<N>", sh("property"), "_:q"), ("_:q", sh("path"), "<k>"), ("_:q", sh("minCount"), n(1))], {"<a>", "<c>"}),
    "or": ([("<S>", sh("targetClass"), "<C>"), ("<S>", sh("or"), "_:l"), *lists("_:l", ["<N>", "<M>"]), ("<N>", sh("property"), "_:q"), ("_:q", sh("path"), "<k>"), ("_:q", sh("minCount"), n(1)), ("<M>", sh("property"), "_:r"), ("_:r", sh("path"), "<u>"), ("_:r", sh("minCount"), n(1))], {"<b>"}),
    "xone": ([("<S>", sh("targetClass"), "<C>"), ("<S>", sh("xone"), "_:l"), *lists("_:l", ["<N>", "<M>"]), ("<N>", sh("property"), "_:q"), ("_:q", sh("path"), "<k>"), ("_:q", sh("minCount"), n(1)), ("<M>", sh("property"), "_:r"), ("_:r", sh("path"), "<u>"), ("_:r", sh("minCount"), n(1))], {"<b>", "<c>"}),
    "qualified": (case(("_:p", sh("path"), "<v>"), ("_:p", sh("qualifiedValueShape"), "<Q>"), ("_:p", sh("qualifiedMinCount"), n(1)), ("<Q>", sh("maxInclusive"), n(9))), {"<b>"}),
    "closed": ([("<S>", sh("targetNode"), "<c>"), ("<S>", sh("closed"), TRUE), ("<S>", sh("ignoredProperties"), "_:l"), *lists("_:l", [T.RDF_TYPE, "<k>", "<u>"])], {"<c>"}),
    "subjects": ([("<S>", sh("targetSubjectsOf"), "<w>"), ("<S>", sh("class"), "<D>")], {"<b>"}),
    "objects": ([("<S>", sh("targetObjectsOf"), "<k>"), ("<S>", sh("class"), "<D>")], {"<a>", "<b>"}),
}


@pytest.fixture(scope="module")
def data(spark):
    return spark.createDataFrame([("<g>", *t) for t in DATA], SCHEMA).cache()


@pytest.mark.parametrize("name", list(CASES))
def test_constraints(spark, data, name):
    triples, want = CASES[name]
    assert {r["focus"] for r in shacl.Validator(spark, data, shacl.Shapes(triples)).report().collect()} == want


def test_shapes_that_are_refused():
    with pytest.raises(shacl.ShaclError):
        shacl.Shapes([("<S>", sh("node"), "<T>"), ("<T>", sh("node"), "<S>")])
    with pytest.raises(shacl.ShaclError):
        shacl.Shapes([("<S>", sh("sparql"), "_:x"), ("<S>", sh("targetClass"), "<C>")])


def test_delta_sees_what_changed(spark, data):
    v = shacl.Validator(spark, data, shacl.Shapes(CASES["maxCount"][0]))
    changed = spark.createDataFrame([("<b>", '"x"@en')], "s string, o string")
    assert {r["focus"] for r in v.delta(changed).collect()} == {"<b>"}
    assert not v.conforms() and v.report(worst="Violation").count() == 1


def package(spark, extra=()):
    rows = rules.scaffold("<urn:c/>", "n", "d", "2024-02-30") + list(extra)
    return spark.createDataFrame(rows, SCHEMA)


def test_rules_and_orphans(spark):
    link = rules.HAS_PART
    q = package(spark, [("<urn:c/>", "<urn:c/>", link, "<urn:f>"), ("<urn:c/>", "<urn:f>", T.RDF_TYPE, rules.MEDIA), ("<urn:c/>", "<urn:lost>", T.RDF_TYPE, rules.MEDIA), ("<urn:c/>", "<urn:x>", link, "<urn:y>"), ("<urn:c/>", "<urn:y>", link, "<urn:x>")])
    assert {r["entity"] for r in rules.orphans(q).collect()} == {"<urn:lost>", "<urn:x>", "<urn:y>"}
    found = {(r["rule"], r["entity"]) for r in rules.violations(q).collect()}
    assert ("date-form", "<urn:c/>") in found and ("untyped", "<urn:x>") in found and not any(r == "root-type" for r, _ in found)


def test_entity_changes(spark):
    q = package(spark, [("<urn:c/>", "<urn:f>", "<urn:p>", '"1"'), ("<urn:c/>", "<urn:f>", "<urn:q>", '"2"')])
    got = {(r["op"], r["p"], r["o"]) for r in rules.patch(q, "<urn:c/>", "<urn:f>", {"<urn:p>": ['"3"']}).collect()}
    assert got == {("delete", "<urn:p>", '"1"'), ("insert", "<urn:p>", '"3"')}
    got = {(r["op"], r["s"], r["p"]) for r in rules.upsert(q, "<urn:c/>", "<urn:f>", [("<urn:p>", '"1"')], "<urn:c/>").collect()}
    assert got == {("delete", "<urn:f>", "<urn:q>"), ("insert", "<urn:c/>", rules.HAS_PART)}
    assert rules.remove(q, "<urn:c/>", "<urn:f>").count() == 2


def ops(spark, rows):
    return spark.createDataFrame([(a, c, k, "<g>", s, "<p>", "<o>", w) for a, c, k, s, w in rows], OPS)


ROWS = [("a", 1, "add", "<s>", {}), ("b", 1, "add", "<s>", {}), ("a", 2, "remove", "<s>", {"a": 1}), ("a", 3, "add", "<t>", {}), ("b", 2, "remove", "<t>", {"a": 3}), ("b", 3, "add", "<u>", {})]


def live(df):
    return {r["s"] for r in df.collect()}


def test_removes_take_only_what_they_saw(spark):
    assert live(merge.live(merge.dots(ops(spark, ROWS)))) == {"<s>", "<u>"}
    assert live(merge.live(merge.dots(ops(spark, ROWS + ROWS)))) == {"<s>", "<u>"}


def test_merge_in_any_order_converges(spark):
    whole = ops(spark, ROWS)
    for cut in (1, 3, 4):
        a, b = ops(spark, [r for r in ROWS if r[0] == "a"][:cut] + [r for r in ROWS if r[0] == "b"]), whole
        one = merge.merge(merge.dots(a), merge.clock(a), merge.dots(b), merge.clock(b))
        two = merge.merge(merge.dots(b), merge.clock(b), merge.dots(a), merge.clock(a))
        assert live(merge.live(one)) == live(merge.live(two)) == {"<s>", "<u>"}


def test_history(spark):
    df = spark.createDataFrame([("<g>", i + 1, a, c, k, s, "<p>", "<o>", w, [i] if i else [], i) for i, (a, c, k, s, w) in enumerate(ROWS)], "g string, id long, actor string, counter long, kind string, s string, p string, o string, witnessed map<string,long>, parents array<long>, at long")
    assert [r["id"] for r in merge.heads(df).collect()] == [6]
    assert live(merge.project(df, df.where("id = 4"))) == {"<s>", "<t>"}
    assert {(r["op"], r["s"]) for r in merge.restore(df, df.where("id = 4")).collect()} == {("insert", "<t>"), ("delete", "<u>")}
    assert [r["id"] for r in merge.log(df, "<g>", 2).collect()] == [6, 5]


def test_op_log_in_any_batches(spark, tmp_path):
    for name, batches in (("one", [ROWS]), ("late", [[ROWS[4]], [ROWS[5]], ROWS[:2], ROWS[2:4]]), ("again", [ROWS[:3], ROWS[:5], ROWS])):
        log = OpLog(spark, str(tmp_path / name))
        for k, rows in enumerate(batches):
            log.apply(ops(spark, rows), k)
            log.apply(ops(spark, rows), k)  # a batch that comes twice
        assert live(log.live()) == {"<s>", "<u>"} and log.pending.count() == 0
    log.apply(spark.createDataFrame([("a", 9, "odd", "<g>", "<s>", "<p>", "<o>", {})], OPS), 9)
    assert log.rejected.first()["seen_count"] == 1


def test_op_log_follows_a_stream(spark, tmp_path):
    ops(spark, ROWS).repartition(3).write.parquet(str(tmp_path / "in"))
    log = OpLog(spark, str(tmp_path / "state"))
    stream = spark.readStream.schema(OPS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    log.follow(stream, str(tmp_path / "check")).awaitTermination(120)
    assert live(log.live()) == {"<s>", "<u>"}


DOC = {"@context": CONTEXT, "@graph": [{"@id": "ro-crate-metadata.json", "@type": "CreativeWork", "about": {"@id": "./"}, "conformsTo": {"@id": "https://w3id.org/ro/crate/1.1"}}, {"@id": "./", "@type": "Dataset", "name": "N", "hasPart": [{"@id": "a.txt"}, {"@id": "b.txt"}, {"@id": "c.txt"}]}, *[{"@id": f"{x}.txt", "@type": "File", "contentSize": 3, "description": {"@value": "été", "@language": "FR"}} for x in "abc"]]}


def test_json_ld(spark):
    g = "<urn:x:crate/>"
    quads = jsonld.read_documents(spark.createDataFrame([(g, json.dumps(DOC))], "g string, document string")).cache()
    rows = {tuple(r)[1:] for r in quads.collect()}
    assert (g, f"<{T.SCHEMA}name>", '"N"') in rows and ("<urn:x:crate/a.txt>", T.RDF_TYPE, f"<{T.SCHEMA}MediaObject>") in rows
    assert ("<urn:x:crate/a.txt>", f"<{T.SCHEMA}description>", '"été"@fr') in rows and ("<urn:x:crate/a.txt>", f"<{T.SCHEMA}contentSize>", n(3)) in rows
    assert jsonld.version_of(json.dumps(DOC)) == "1.1"
    out = jsonld.write_documents(quads).first()["document"]
    again = {t for t in jsonld.expand(out, g)}
    assert again == rows
    assert len(json.loads(jsonld.summary(quads).first()["document"])["@graph"]) == 2
    part, total, after = jsonld.page(quads, g, 0, 2)
    assert part.count() == 2 and total == 3 and after == 2
    first, cursor = jsonld.page_after(quads, g, None, 2)
    second, end = jsonld.page_after(quads, g, cursor, 2)
    assert first.count() == 2 and second.count() == 1 and end is None
    with pytest.raises(jsonld.JsonLdError):
        jsonld.page_after(quads, "<urn:other>", cursor, 2)
    with pytest.raises(jsonld.JsonLdError):
        jsonld.expand('{"@context": "https://example.org/x"}', g)
    with pytest.raises(jsonld.JsonLdError):
        jsonld.version_of(json.dumps(DOC | {"@context": CONTEXT.replace("1.1", "1.2")}))


def test_a_qualified_shape_names_the_bound_that_is_missed(spark, data):
    triples = case(("_:p", sh("path"), "<v>"), ("_:p", sh("qualifiedValueShape"), "<Q>"), ("_:p", sh("qualifiedMinCount"), n(1)), ("_:p", sh("qualifiedMaxCount"), n(0)), ("<Q>", sh("maxInclusive"), n(9)))
    got = {(r["focus"], r["component"]) for r in shacl.Validator(spark, data, shacl.Shapes(triples)).report().collect()}
    assert got == {("<a>", "qualifiedMaxCount"), ("<b>", "qualifiedMinCount"), ("<c>", "qualifiedMaxCount")}
