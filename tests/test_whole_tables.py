"""Queries over whole tables, where a SQL twin covers a part only: against brute force."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from ontoloom.plans import registry


def tables(folder, **frames):
    for name, cols in frames.items():
        pq.write_table(pa.table(cols), folder / f"{name}.parquet")
    return str(folder)


def test_phrase_vectors_of_all_parts(spark, tmp_path):
    keys = list(range(1, 1201))
    words = ["ab", "abc", "abcd"]
    names = [f"{words[k % 3]} {words[k % 2]}" if k % 5 else "abcdefg" for k in keys]
    vec = {n: np.random.default_rng(n).normal(size=4) for n in (2, 3, 4)}
    d = tables(tmp_path, part={"p_partkey": keys, "p_name": names}, embeddings={"vec_id": [1, 2, 3], "label": pa.array([2, 3, 4], pa.int32()), "embedding": [vec[n].tolist() for n in (2, 3, 4)]})
    got = {x.term_id: x for x in registry.QUERIES["phrase_vectors"](spark, d).collect()}
    assert sorted(got) == keys
    for k, name in zip(keys, names):
        known = [vec[len(w)][0] for w in name.split() if len(w) in vec]
        assert got[k].n_known == len(known) and got[k].reason == ("ok" if known else "no_vector")
        assert abs(got[k].v0 - (np.mean(known) if known else 0)) < 2e-5


def test_technical_tokens_of_all_scripts(spark, tmp_path):
    terms = ["job queue", "größe_x", "ÜBER_LAST", "узел", "узел.conf", "节点 slurm", "क्षेत्र", None, "a.ini"]
    got = {x.term: (x.term_type, x.technical) for x in registry.QUERIES["technical_tokens"](spark, tables(tmp_path, term_candidates={"term_text": terms}, nation={"n_name": ["FRANCE"]})).collect()}
    for t in terms:
        if t is not None:
            assert {t, t.replace(" ", "_").upper(), t + ".cfg"} <= set(got)
            assert got[t + ".cfg"] == ("file", True)
    assert got["узел.conf"] == ("file", True) and got["节点 slurm"] == ("none", True)
    assert got["क्षेत्र"] == got["größe_x"] == got["узел"] == ("none", False)


def test_embed_expand_of_all_seeds(spark, tmp_path):
    lemmas = {1: "job cache", 2: "big tree", 3: "old tree", 4: "деревo дуб", 5: "lone", 6: None}
    near = [(1, 2, 0.9), (2, 1, 0.9), (2, 3, 0.95), (2, 5, 0.8), (2, 4, 0.7), (3, 4, 0.85), (4, 5, 0.9), (4, 1, 0.99), (5, 3, None), (6, 1, 0.9)]
    d = tables(
        tmp_path, term_candidates={"term_id": list(lemmas), "term_lemma": list(lemmas.values())}, term_enrichment={"canonical_id": [2, 3, 4, 5, 1], "is_generic": [0, 0, 0, 0, 1]},
        skipgram_neighbors={"term_id": [a for a, _, _ in near], "neighbor_term_id": [b for _, b, _ in near], "similarity": [s for _, _, s in near]},
    )
    got = {(x.child_id, x.parent, x.similarity) for x in registry.QUERIES["embed_expand"](spark, d).collect()}
    assert got == {(2, "cache", 0.9), (5, "tree", 0.8), (4, "tree", 0.85), (5, "дуб", 0.9)}
