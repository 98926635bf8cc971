"""The branches of the pipeline on a few documents: positions, axioms, no cycles, quarantine."""

import pytest

from ontoloom.operators import graph, labelling, rdf, turtle_text
from ontoloom.plans import pipeline

TEXT = (
    "The job scheduler runs the batch queue on the compute node. The batch queue holds the array job. The backup scheduler runs the debug queue on the login node. "
    "A debug queue is a batch queue. The job scheduler starts the array job on the compute node. The backup scheduler starts the array job on the login node."
)


@pytest.fixture(scope="module")
def documents(spark):
    rows = [(i, f"title {i}", TEXT.replace("array", ("array", "batch", "serial")[i % 3]), "en", "wiki", len(TEXT)) for i in range(6)]
    return spark.createDataFrame(rows, "doc_id long, title string, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="module")
def prepared(documents):
    return pipeline.run_plan(pipeline.preprocessing(), {"documents": documents}, store=True)[0]


def test_chunks_keep_positions(prepared):
    text = {x.doc_id: x.cleaned_text for x in prepared["cleaned"].collect()}
    for c in prepared["chunks"].collect():
        assert text[c.doc_id][c.start_char : c.end_char].replace("\n", " ") == c.text


@pytest.mark.parametrize("branch", ["hybrid", "llm", "direct"])
def test_branch(prepared, branch):
    c, log = pipeline.run_plan(pipeline.BRANCHES[branch](), dict(prepared), store=True)
    assert all(s == "done" for _, s, _ in log), log
    t = c["rdf"].collect()
    links = c["rdf"].where(c["rdf"]["p"] == rdf.SUBCLASS).selectExpr("s as child", "o as parent")
    assert links.count() > 0 and graph.cycles(links).count() == 0
    if branch != "direct":
        named = {x.name: x for x in c["properties"].collect()}
        stated = {(x.s.removeprefix(pipeline.BASE), x.p): x.o.removeprefix(pipeline.BASE) for x in t if x.p in (rdf.DOMAIN, rdf.RANGE)}
        assert named and all(stated.get((n, rdf.DOMAIN), "") == x.domain for n, x in named.items())
        classes = {x.s.removeprefix(pipeline.BASE) for x in t if x.p == rdf.TYPE and x.o == rdf.OWL + "Class"}
        assert all(x.domain in classes | {""} for x in named.values())
    if branch == "hybrid":
        assert any(x.p == rdf.DOMAIN for x in t) and any(x.p == rdf.RANGE for x in t)


def test_links_in_a_ring_are_broken_and_axioms_are_stated(spark):
    links = spark.createDataFrame([("alpha queue", "beta queue"), ("beta queue", "alpha queue"), ("debug queue", "beta queue"), ("login node", "compute node")], "child string, parent string")
    triples = spark.createDataFrame([("debug queue", "runs_on", "login node"), ("debug queue", "runs_on", "other node"), ("alpha queue", "runs_on", "login node"), ("debug queue", "size_limit", "12"), ("alpha queue", "size_limit", "7")], "s string, rel string, o string")
    types = spark.createDataFrame([("debug queue", "beta queue"), ("alpha queue", "beta queue"), ("login node", "compute node"), ("other node", "compute node")], "term string, bucket string")
    c = pipeline._rdf(links, triples, types)
    t = {(x.s.removeprefix(pipeline.BASE), x.p, x.o.removeprefix(pipeline.BASE)) for x in c["rdf"].collect()}
    assert ("runs_on", rdf.DOMAIN, "BetaQueue") in t and ("runs_on", rdf.RANGE, "ComputeNode") in t and ("size_limit", rdf.RANGE, rdf.XSD + "integer") in t
    assert ("DebugQueue", pipeline.BASE + "runs_on", "LoginNode") in t and c["links"].count() == 3


def test_quarantine(spark):
    def stubborn():
        return lambda prompts: ["hpc:fixed a owl:Class ." if "mend" in p else "still [ wrong" for p in prompts]

    df = spark.createDataFrame([("1", "hpc:a a owl:Class ."), ("2", "hpc:b a mend ["), ("3", "no turtle at all ["), ("4", None), ("5", " ")], "id string, text string")
    good, bad = turtle_text.repair(df, stubborn, pipeline.PREFIXES)
    assert {x.id: x.text for x in good.collect()} == {"1": "hpc:a a owl:Class .", "2": "hpc:fixed a owl:Class ."}
    assert {x.id for x in bad.collect()} == {"3", "4", "5"} and all(x.error for x in bad.collect())


def test_salvaged_lines(spark):
    block = "hpc:A a owl:Class ;\n  rdfs:label \"a ;\n  rdfs:subClassOf hpc:B ."
    text, gone = turtle_text.salvage_lines(block, pipeline.PREFIXES)
    assert gone == 1 and len(rdf.parse_turtle(pipeline.PREFIXES + text)) == 2
    assert turtle_text.salvage_lines("a b c", pipeline.PREFIXES) == ("", 1) and turtle_text.salvage_lines("hpc:A a owl:Class ;", pipeline.PREFIXES)[1] == 0
    df = spark.createDataFrame([(pipeline.PREFIXES, block), (pipeline.PREFIXES, None)], "p string, b string")
    assert [x.r.dropped for x in df.select(turtle_text.salvage_lines_udf("p", "b").alias("r")).collect()] == [1, 0]


def test_mended_blocks(spark):
    text = "hpc:A a owl:Class .\n\nhpc:B a owl:Class ;\n  rdfs:label \"b ;\n  rdfs:subClassOf hpc:A .\n\nhpc:C a [ ."
    s = turtle_text.salvage(spark.createDataFrame([("1", text), ("2", None)], "id string, text string"), pipeline.PREFIXES)
    got = {x.block_no: x for x in turtle_text.mend(s, pipeline.PREFIXES).collect()}
    assert [got[i].dropped_lines for i in (0, 1, 2)] == [0, 1, 0] and got[0].problem is None and got[1].problem is None and got[2].problem == "brackets"
    assert len(rdf.parse_turtle(pipeline.PREFIXES + got[1].block)) == 2


def test_choose():
    assert pipeline.choose("LLM, hybrid,llm") == ["llm", "hybrid"] and pipeline.choose("all") == ["hybrid", "llm", "direct"] and pipeline.choose("") == []
    with pytest.raises(ValueError, match="no branch: x"):
        pipeline.choose("x")


def test_stand_in_models():
    ask = ["Input: the batch queue and main.conf\nOutput:"]
    assert labelling.parse_terms(labelling.rule_lister()(ask)[0]) == ["batch queue", "main.conf"]
    assert '"child_idx": 0, "parent_idx": 1' in labelling.rule_linker()(["0: batch queue\n1: queue"])[0]
    assert '"subject_idx": 0' in labelling.rule_relater()(["0: batch queue\n1: queue"])[0]
    assert "hpc:batch_queue" in labelling.rule_writer()(["Write:\nthe batch queue"])[0]
