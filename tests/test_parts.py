"""Sources, sinks and small operators that no query uses."""

import json

import pytest
from pyspark.sql import functions as F

from ontoloom.operators import axioms, knn, labelling, rdf, tables, taxonomy, terms, turtle_text
from ontoloom.sources import files
from ontoloom.streaming import ingest


def test_file_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "short"), (2, None, "x,y")], "term_id int, lemma string, reason string")
    files.write_csv(df, str(tmp_path / "c"))
    back = files.annotations(spark, str(tmp_path / "c"))
    assert back.columns == ["term_id", "lemma", "reason"] and {(x.term_id, x.reason) for x in back.collect()} == {("1", "short"), ("2", "x,y")}
    for append in (False, True):
        files.write_json(df, str(tmp_path / "j"), append)
    assert spark.read.json(str(tmp_path / "j")).count() == 4
    log = files.skipped_log(df)
    assert {x.value for x in log.collect()} == {"1\ta\tshort", "2\tx,y"}
    files.write_lines(log, "value", str(tmp_path / "t"))
    assert spark.read.text(str(tmp_path / "t")).count() == 2


def test_annotations_with_byte_order_mark(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿Term, Manual_Label \nqueue,valid\n", encoding="utf-8")
    assert files.annotations(spark, str(tmp_path / "a.csv")).columns == ["term", "manual_label"]


def test_stop_words_by_line(spark, tmp_path):
    (tmp_path / "s.txt").write_text("The\n# no\nas well as\n\n")
    assert {x.word for x in files.stop_words(spark, str(tmp_path / "s.txt"), by_line=True).collect()} == {"the", "as well as"}


def test_prompt_files(tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"system": "s", "max_terms": 3}))
    assert files.PromptConfig.load(str(tmp_path / "p.json")).max_terms == 3
    (tmp_path / "p.yaml").write_text("system: say\nexamples:\n- {input: a, output: b}\n")
    try:
        import yaml  # noqa: F401
    except ImportError:
        with pytest.raises(ValueError, match="yaml"):
            files.PromptConfig.load(str(tmp_path / "p.yaml"))
    else:
        assert files.PromptConfig.load(str(tmp_path / "p.yaml")).examples == [{"input": "a", "output": "b"}]
    (tmp_path / "q.json").write_text("[]")
    with pytest.raises(ValueError):
        files.PromptConfig.load(str(tmp_path / "q.json"))


def test_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    assert tables.create_if_missing(spark, path, "a int, b string").count() == 0
    spark.createDataFrame([(1, "x"), (2, "y")], "a int, b string").write.mode("append").parquet(path)
    assert tables.create_if_missing(spark, path, "a int, b string").count() == 2
    tables.reset(spark.read.parquet(path), str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r")).columns == ["a", "b"] and spark.read.parquet(str(tmp_path / "r")).count() == 0
    spark.range(3).createOrReplaceTempView("some_view")
    assert tables.has_table(spark, "some_view") and not tables.has_table(spark, "no_view")
    assert [tuple(x) for x in tables.columns_of(spark.range(1)).collect()] == [(0, "id", "bigint")]
    assert [x.id for x in tables.page(spark.range(10), ["id"], 4, 3).collect()] == [4, 5, 6] and tables.page(spark.range(3), ["id"], 1).count() == 2
    assert spark.range(1).select(tables.utc_now().alias("t")).first().t.endswith("Z")


def test_labelling_parts(spark):
    df = spark.createDataFrame([(["a", "b"], 'no {x} {"a": 1} then {"terms": ["job queue", {"term": "node"}, 3]}'), ([], "x"), (None, None)], "ts array<string>, raw string")
    got = df.select(labelling.indexed_list(F.col("ts")).alias("l"), labelling.last_json_udf("raw").alias("j"), labelling.parse_terms_udf("raw").alias("t")).collect()
    assert [x.l for x in got] == ["0: a\n1: b", "", None] and got[0].j.startswith('{"terms"') and got[1].j is None
    assert labelling.parse_terms('{"terms": ["job queue", {"term": "node"}, 3]}') == ["job queue", "node"] and got[2].t == []
    shots = [{"input": "q1", "output": "a1"}]
    one = spark.createDataFrame([("x",), (None,)], "q string").select(labelling.few_shot("Do.", shots, F.col("q")).alias("p"), labelling.few_shot("Do.", shots, F.col("q"), chat=True).alias("c")).collect()
    assert one[0].p == "Do.\n\nInput: q1\nOutput: a1\n\nInput: x\nOutput:" and [m["role"] for m in json.loads(one[1].c)] == ["system", "user", "assistant", "user"]


def test_turtle_parts(spark):
    df = spark.createDataFrame([("b", " two "), ("a", "one"), ("c", " "), ("d", None)], "id string, text string")
    assert [(x.part, x.text) for x in turtle_text.merge_fragments(df, "head").orderBy("part").collect()] == [("", "head"), ("a", "one"), ("b", "two")]
    names = spark.createDataFrame([("hpc:big_queue a owl:Class .",), (None,)], "t string").select(turtle_text.canonical_names_udf("t").alias("t")).collect()
    assert [x.t for x in names] == ["hpc:BigQueue a owl:Class .", None]
    counts = turtle_text.drop_counts(spark.createDataFrame([(None,), ("brackets",), (None,)], "problem string"))
    assert {x.problem: x.n for x in counts.collect()} == {"kept": 2, "brackets": 1}


def test_samples_and_reports(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(20)], "x int, g string")
    got = rdf.ranked_sample(df, 3, "g").collect()
    assert sorted(x.g for x in got) == list("aaabbb") and got == rdf.ranked_sample(df, 3, "g").collect()
    report = spark.createDataFrame([("s2", "m", 1), ("s1", "b", 2), ("s1", "a", 3)], "section string, metric string, value int")
    assert [x.line for x in rdf.markdown(report, "T").orderBy("line_no").collect()] == ["# T", "## s1", "- a: **3**", "- b: **2**", "## s2", "- m: **1**"]


def test_vectors(spark, tmp_path):
    df = spark.createDataFrame([(["a", "b", "c"],)] * 5, "words array<string>")
    model = knn.train_skipgram(df, dim=4, min_count=1, partitions=1)
    knn.save_model(model, str(tmp_path / "m"))
    assert knn.load_model(str(tmp_path / "m")).getVectors().count() == 3
    with pytest.raises(ValueError, match="missing: seeds, eligible"):
        knn.evaluate_k(df, None, None)


def test_scheduler_names_and_kept_occurrences(spark):
    df = spark.createDataFrame([("host LSF",), ("lsf host",), ("big  host",), (None,), ("",)], "t string")
    assert [x.r for x in df.select(taxonomy.swap_scheduler(F.col("t")).alias("r")).collect()] == ["lsf host", "lsf host", "big host", None, ""]
    cands = spark.createDataFrame([(1, 0, 0, "x y", "x y", 2), (2, 0, 0, "x y", "x y", 2), (1, 1, 0, "z", "z", 1)], "doc_id long, sent_idx int, token_start int, text string, lemma string, n_tokens int")
    kept = terms.aggregate(cands, 2)
    assert {x.lemma for x in kept.collect()} == {"x y"} and terms.kept_occurrences(cands, kept).count() == 2


def test_axiom_loads_with_nulls(spark):
    t = spark.createDataFrame([(" a ", "Runs - On", "b"), ("a", None, "b"), (None, "r", "b"), ("a", " ", "b")], "s string, rel string, o string")
    assert [tuple(x) for x in axioms.load_triples(t).collect()] == [("a", "runs_on", "b")]
    assert axioms.known_assertions(t, spark.createDataFrame([(None,)], "rel string")).count() == 0
    lab = spark.createDataFrame([("x", "class", "b", None, 1), ("x", " ", "c", "k", 2), (None, "class", "b", "k", 3)], "term string, role string, bucket string, category string, at int")
    assert [tuple(x) for x in axioms.term_types(lab, "at").collect()] == [("x", None, "c", "k")]


def test_event_counts(spark):
    ev = spark.createDataFrame([("2024-01-01 00:00:10", "a", 1.5), ("2024-01-01 00:00:50", "a", 2.0), ("2024-01-01 02:00:00", "b", None)], "ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    got = ingest.event_counts(ev).collect()
    assert sorted((x.start.hour, x.event_type, x.n, x.value) for x in got) == [(0, "a", 2, 3.5), (2, "b", 1, None)]
