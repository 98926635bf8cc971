"""Sentences of the pipeline: scripts without blanks, abbreviations, positions."""

from ontoloom.plans import pipeline


def test_sentences_of_all_scripts_with_positions(spark):
    texts = {
        1: "调度器在计算节点上运行作业。队列按照优先级排列全部作业。用户随后提交新的作业！",
        2: "The scheduler was written by Dr. Miller in the old lab. It runs all jobs of the cluster.",
        3: "ノードはジョブを順番に実行します。キューは優先度で並びます。",
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, cleaned_text string")
    step = pipeline.only(pipeline.build(), ["segment"])
    got = pipeline.run_plan(step, {"cleaned": docs})[0]["sentences"].collect()
    for x in got:
        assert texts[x.doc_id][x.start_char : x.end_char] == x.sentence
    assert len({(x.doc_id, x.start_char) for x in got}) == len(got)
    assert sorted(x.sentence for x in got if x.doc_id == 2) == ["It runs all jobs of the cluster.", "The scheduler was written by Dr. Miller in the old lab."]
    marks = [x.sentence for x in got if any(m in x.sentence[:-1] for m in "。！")]
    assert not marks, marks
