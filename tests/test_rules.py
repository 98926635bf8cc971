"""Rules one by one, readers and writers, plans, labelling, streaming."""

import json

import pytest
from pyspark.sql import functions as F

from ontoloom.operators import axioms, enrich, graph, knn, labelling, rdf, relations, tables, taxonomy, terms, textprep, turtle_text
from ontoloom.plans import pipeline
from ontoloom.sources import files
from ontoloom.streaming import ingest


def one(spark, col, value):
    return spark.createDataFrame([(value,)], "x string").select(col(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("text", "want"), [("a  b \n c  ", "a b\n c"), ("x y", "x\ny"), ("", ""), ("a \t b\n", "a b")]
)
def test_normalize_whitespace(spark, text, want):
    assert one(spark, textprep.normalize_whitespace, text) == want
    assert one(spark, textprep.normalize_whitespace, want) == want


def test_clean_document(spark):
    text = "Menu\nThis is the first proper line of all.\n12\nusage\n3 x\nint main(void);\n\n\n\nLast Updated: today\n"
    d = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    got = {x.doc_id: x for x in textprep.clean_documents(d, strict=True).collect()}
    assert got[1].cleaned_text == "This is the first proper line of all.\nusage:\nint main(void);" and got[1].lines_removed_leading == 1
    assert set(got) == {1, 3} and got[3].cleaned_text == ""


def test_normal_form(spark):
    d = spark.createDataFrame([(1, "This is the first proper line of all.\nＨｏｍｅ")], "doc_id long, text string")
    assert textprep.classify_lines(d, strict=True).where("key = 'Home'").count() == 0
    assert textprep.classify_lines(d, strict=True, normal_form=True).where("key = 'Home' and action = 'boilerplate'").count() == 1


def test_chunks_cover(spark):
    s = [(1, i, f"s{i}", "w " * (3 + i % 5), i, i + 1) for i in range(1, 40)]
    df = spark.createDataFrame(s, "doc_id long, sent_idx int, sentence_id string, sentence string, start_char int, end_char int")
    got = [x.sentence_ids.split(",") for x in textprep.chunk(df, 12, 30).orderBy("chunk_id").collect()]
    assert {x for c in got for x in c} == {f"s{i}" for i in range(1, 40)}
    assert all(a[-1] == b[0] or len(a) == 1 for a, b in zip(got, got[1:])) and len(got[-1]) == 1


@pytest.mark.parametrize(("term", "want"), [("https://a.b", "url"), ("/etc/x/y", "path"), ("libfoo.so", "binary"), ("A100", None), ("a=b", "assignment"), ("a_b_c", "symbol"), ("slurmV0043DeleteJobs", "method"), ("task/cgroup", None)])
def test_artifacts(spark, term, want):
    assert one(spark, terms.artifact_class, term) == want


@pytest.mark.parametrize(("term", "want"), [("running jobs", "runn jobs"), ("used boxes", "used box"), ("gas --flags v2s", "gas flag v2s"), ("a_b|c", "a b c"), ("nodes", "nod"), ("class", "clas")])
def test_suffix_canonical(spark, term, want):
    assert one(spark, enrich.suffix_canonical, term) == want


def test_definition_head(spark):
    assert one(spark, enrich.definition_head, "A slurm scheduler that runs jobs.") == "job scheduler"
    assert one(spark, enrich.definition_head, "The partition of") == "partition"
    assert one(spark, enrich.definition_head, "Something else") is None
    assert one(spark, enrich.definition_head, "A thing.") is None


def test_hearst(spark):
    s = spark.createDataFrame([(1, 1, "A job queue is a waiting list."), (1, 2, "clusters such as big iron"), (1, 3, "cats and other pets")], "doc_id int, sent_idx int, sentence string")
    k = spark.createDataFrame([(x,) for x in ("job queue", "waiting list", "clusters", "big iron", "cats", "pets")], "term string")
    got = {(x.child, x.parent, x.pattern) for x in taxonomy.hearst(s, k).collect()}
    assert got == {("job queue", "waiting list", "is_a"), ("big iron", "clusters", "such_as"), ("cats", "pets", "other")}


def test_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "b"), ("x", "a"), ("y", "y")], "child string, parent string")
    assert {tuple(x.nodes) for x in graph.cycles(e).collect()} == {("a", "b"), ("b", "c", "d")}
    left = graph.break_cycles(e).where("not removed")
    assert graph.cycles(left).count() == 0 and left.where("child = parent").count() == 0
    assert graph.components(e).where("component = 'a'").count() == 5


def test_closure_is_transitive(spark):
    e = spark.createDataFrame([(f"n{i}", f"n{j}") for i, j in ((1, 2), (2, 3), (3, 4), (2, 4))], "child string, parent string")
    c = {(x.node, x.ancestor): x.hops for x in graph.closure(e).collect()}
    assert c[("n1", "n4")] == 2 and all((a, d) in c for a, b in c for b2, d in c if b == b2)


def test_tables(spark):
    a = spark.createDataFrame([(1, 1, "x")], "k int, o int, v string")
    b = spark.createDataFrame([(1, 2, "y"), (2, 3, "z"), (2, 1, "w")], "k int, o int, v string")
    assert {tuple(x) for x in tables.insert_or_ignore(a, b, ["k"], ["o"]).collect()} == {(1, 1, "x"), (2, 1, "w")}
    assert {tuple(x) for x in tables.insert_or_replace(a, b, ["k"], ["o"]).collect()} == {(1, 2, "y"), (2, 3, "z")}
    assert tables.add_columns(a, {"n": ("long", 0), "v": ("string", "")}).columns == ["k", "o", "v", "n"]
    assert tables.update_column(a, "v", F.lit("q"), F.col("k") == 1).first().v == "q"
    assert tables.pick_column(["Term", "x"], "term", ["x"]) == "Term" and tables.pick_column(["a"], "b", ["c"]) is None
    assert tables.where_roles(b, "child > 1", {"child": "k"}).count() == 2


def test_relations(spark):
    f = lambda c: relations.relation_key(c, F.lit("on"))
    assert one(spark, f, "Run  fast!") == "run_fast_on" and one(spark, relations.axiom_relation_key, " -- ") == "related_to"
    assert one(spark, relations.generic_span, "the of") is True and one(spark, relations.generic_span, "the job") is False
    assert one(spark, relations.outer_json, 'x {"a": {"b": 1}} y') == '{"a": {"b": 1}}' and one(spark, relations.outer_json, '{"a": 1} }') is None


def test_local_names_are_unique(spark):
    df = spark.createDataFrame([(x,) for x in ("job queue", "Job-Queue", "job_queue", "", "2 x")], "label string")
    names = [x.name for x in axioms.local_names(df).collect()]
    assert len(set(names)) == 5 and {"JobQueue", "JobQueue_2", "JobQueue_3", "Unnamed", "N2X"} == set(names)


TTL = '@prefix h: <http://x/> .\nh:A a h:B ;\n  h:p "a\\"b"@en, 5, 2.5, true ; h:q [ h:r h:C ] .\n<http://y> h:p _:z . # note\n'


def test_turtle_reader(spark):
    t = rdf.parse_turtle(TTL)
    assert ("http://x/A", rdf.TYPE, "http://x/B", "iri", "") in t and ("http://x/A", "http://x/p", "5", "literal", rdf.XSD + "integer") in t and len(t) == 8
    with pytest.raises(rdf.TurtleError):
        rdf.parse_turtle("q:a q:b q:c .")
    rows = rdf.read_turtle(spark.createDataFrame([("1", TTL), ("2", "h:a"), ("3", None), ("4", "")], "id string, text string")).collect()
    assert sum(x.error is None for x in rows) == 8 and [x.id for x in rows if x.error] == ["2"]


def test_turtle_text(spark):
    raw = "Sure, here you go\n```turtle\n@prefix a: <b> .\nfoo:Job a Class ;\n  rdfs:label \"x\" .\n```"
    assert one(spark, turtle_text.sanitise, raw) == 'hpc:Job a owl:Class ;\n  rdfs:label "x" .'
    assert turtle_text.dots_in_brackets("h:a h:b [\n h:c 1 .\n] .") == "h:a h:b [\n h:c 1 ;\n] ."
    assert turtle_text.canonical_names("hpc:job_queue a owl:Class .") == "hpc:JobQueue a owl:Class ."
    assert turtle_text.canonical_names("hpc:runs_on a owl:ObjectProperty .") == "hpc:runsOn a owl:ObjectProperty ."


def test_labelling(spark):
    assert labelling.pick_json('x {"a": "}"} {"b": 2}') == '{"a": "}"}' and labelling.pick_json('{"a": 1} {"b": 2}', "last") == '{"b": 2}' and labelling.pick_json("{no}") is None
    assert labelling.parse_terms('{"terms": ["a", {"term": " b "}, 3]}') == ["a", "b"] and labelling.parse_terms('terms: "node one", "queue"') == ["node one", "queue"]
    df = spark.createDataFrame([(1, 'the term "x_1"'), (2, None)], "id int, prompt string")
    got = {x.id: x.answer for x in labelling.generate(df, "prompt", labelling.rule_labeller).collect()}
    assert json.loads(got[1])["ontology_role"] == "instance" and got[2] is None
    bad = labelling.with_retries(df, "prompt", labelling.rule_labeller, lambda a: "no")
    assert [x.error for x in bad.orderBy("id").collect()] == ["no", "no prompt"]
    assert one(spark, labelling.to_confidence, "85%") == 0.85 and one(spark, labelling.to_bool, "Yes") is True
    _, ledger = labelling.run_pending(df, df.where("id = 2").select("id"), ["id"], "prompt", labelling.rule_labeller, lambda d: d)
    assert [(x.id, x.status) for x in ledger.collect()] == [(1, "done")]


def test_knn(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0])], "id long, vec array<double>")
    got = {(x.id, x.rank): x.neighbour for x in knn.exact_top_k(df, df, 2, 3).collect()}
    assert got[(1, 1)] == 2 and got[(3, 1)] == 1 and len(got) == 8


def test_plans(spark, data, tmp_path):
    plan = pipeline.build()
    assert [s.key for s in pipeline.only(plan, ["Clean", "axioms"])] == ["clean", "axioms"]
    assert [s.key for s in pipeline.between(plan, "clean", "chunk")] == ["clean", "segment", "lemmatize", "chunk"]
    assert pipeline.between(plan, "chunk", "clean") == [] and len(pipeline.between(plan, "nothing")) == len(plan)
    c, log = pipeline.run_plan(plan, {"documents": spark.read.parquet(f"{data}/documents.parquet")}, str(tmp_path))
    assert [s for _, s, _ in log] == ["done"] * len(plan) and c["rdf"].count() > 0
    _, log = pipeline.run_plan([pipeline.Step("x", "x", lambda c: 1 / 0), *plan], {})
    assert len(log) == 1 and log[0][1].startswith("error")


def test_files(spark, tmp_path):
    (tmp_path / "b.txt").write_text("hello world")
    (tmp_path / "a.txt").write_text("  ")
    assert [x.title for x in files.text_folder(spark, str(tmp_path)).collect()] == ["b"]
    (tmp_path / "stop").write_text("# no\nThe, of\nA")
    assert {x.word for x in files.stop_words(spark, str(tmp_path / "stop")).collect()} == {"the", "of", "a"}
    assert [x.word for x in files.stop_words(spark, str(tmp_path / "none"), fallback=["is"]).collect()] == ["is"]
    html = spark.createDataFrame([("<ul><li>• Alpha</li><li>two words</li><li><b>don't</b></li></ul>",)], "html string")
    assert {x.word for x in files.list_words(html).collect()} == {"alpha", "don't"}
    (tmp_path / "p.json").write_text('{"system": "do", "examples": [{"input": 1, "output": 2}]}')
    assert files.PromptConfig.load(str(tmp_path / "p.json")).max_terms == 25
    (tmp_path / "q.json").write_text("{}")
    with pytest.raises(ValueError):
        files.PromptConfig.load(str(tmp_path / "q.json"))


def test_streaming_ingest(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    a = spark.createDataFrame([(1, "one text"), (2, "one  text"), (3, "other")], "doc_id long, text string")
    a.write.parquet(str(src))
    stream = spark.readStream.schema(a.schema).parquet(str(src))
    ingest.ingest_stream(stream, out, str(tmp_path / "cp")).awaitTermination()
    spark.createDataFrame([(9, "other"), (8, "new")], a.schema).write.mode("append").parquet(str(src))
    ingest.ingest_stream(spark.readStream.schema(a.schema).parquet(str(src)), out, str(tmp_path / "cp")).awaitTermination()
    assert sorted(x.doc_id for x in spark.read.parquet(out).collect()) == [1, 3, 8]


def test_turtle_escapes_tags_and_blank_nodes(spark):
    text = '@prefix e: <http://e/> . e:a e:p "caf\\u00e9 \\U0001F600\\r"@EN-gb , [ e:q _:b1 ] . <http://e/\\u0061> e:p "x" .'
    t = rdf.parse_turtle(text)
    assert ("http://e/a", "http://e/p", "café 😀\r", "literal", "@en-gb") in t and ("http://e/a", "http://e/p", "x", "literal", rdf.XSD + "string") in t
    assert ("_:b2", "http://e/q", "_:b1", "bnode", "") in t
    df = spark.createDataFrame([("1", text), ("2", text), ("3", "e:a e:p 1 .")], "id string, text string")
    got = rdf.read_turtle(df)
    nodes = [{x for r in got.where(f"id = '{i}'").collect() for x in (r.s, r.o) if x.startswith("_:")} for i in (1, 2)]
    assert len(nodes[0]) == len(nodes[1]) == 2 and not nodes[0] & nodes[1] and got.where("id = '3'").first().error
    lines = [r.line for r in rdf.n_triples(got.where("id = '1'")).collect()]
    assert any('"café 😀\\r"@en-gb' in x for x in lines) and not any("\r" in x for x in lines)


def test_json_objects_and_model_keys():
    assert labelling.json_objects('a {bad {"a": {"b": "}"}} x {"c": 1}') == ['{"a": {"b": "}"}}', '{"c": 1}'] and labelling.json_objects("") == []
    one, two = (lambda n: lambda: [n])(1), (lambda n: lambda: [n])(2)
    assert labelling.model_key("m", one) != labelling.model_key("m", two) and labelling.model_key("m", one) == labelling.model_key("m", one)


def test_predicates_are_renamed():
    assert turtle_text.canonical_names("hpc:x hpc:runs_on hpc:y .\nhpc:runs_on a owl:ObjectProperty .") == "hpc:X hpc:runsOn hpc:y .\nhpc:runsOn a owl:ObjectProperty ."


def test_turtle_comes_back(spark):
    rows = [("http://e/a", "http://e/p", 'x "q" \\ \n\r é', "literal", rdf.XSD + "string"), ("http://e/a", rdf.TYPE, "http://e/b c#1", "iri", ""), ("_:n1", "http://e/p", "5", "literal", rdf.XSD + "integer"),
            ("http://e/a", "http://e/9", "hola", "literal", "@es"), ("http://e/a", "http://e/p", "_:n1", "bnode", ""), ("http://e/a-b_1", "http://f/p", "12.50", "literal", "http://f/money")]
    t = spark.createDataFrame([r for r in rows if " " not in r[2] or r[3] == "literal"], rdf.COLUMNS)
    names = {"e": "http://e/", "xsd": rdf.XSD}
    lines = [x.line for x in rdf.turtle(t, names).collect()]
    assert sorted(rdf.parse_turtle(rdf.turtle_header(names) + "\n".join(lines))) == sorted(tuple(x) for x in t.collect()) and any(x.startswith("e:a-b_1 <http://f/p> \"12.50\"^^<http://f/money>") for x in lines)


def test_surfaces_of_objects(spark):
    df = spark.createDataFrame([('["A b", "c"]',), ('{"x": "One", "y": ["Two ", "three"], "z": 4}',), ("p, q; r",), ("p, q",), (None,), ("[bad",)], "v string")
    got = [x.s for x in df.select(relations.surfaces(F.col("v")).alias("s")).collect()]
    assert got == [["a b", "c"], ["one", "two", "three", "4"], ["p, q", "r"], ["p", "q"], None, None]


def test_tokens_in_normal_form(spark):
    df = spark.createDataFrame([(1, 1, "ﬁle Ａ１")], "doc_id long, sent_idx int, sentence string")
    assert [x.token for x in terms.tokens(df, normal_form=True).orderBy("pos").collect()] == ["file", "A1"]
