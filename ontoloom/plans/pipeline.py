"""Stage plans in one session: steps as functions on a catalog of frames, with filters, timing and stored results."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ontoloom.functions.text import last
from ontoloom.operators import axioms, enrich, graph, knn, labelling, rdf, relations, sentences, taxonomy, terms, textprep, turtle_text
from ontoloom.session import materialise

Catalog = dict[str, DataFrame]
Factory = Callable[[], labelling.Labeller]


@dataclass(frozen=True)
class Step:
    """``run`` takes the catalog and returns the frames that the step adds."""

    key: str
    name: str
    run: Callable[[Catalog], Catalog]


def only(plan: list[Step], names: list[str]) -> list[Step]:
    """The steps whose key or name is asked for (case aside)."""
    want = {n.strip().lower() for n in names if n.strip()}
    return [s for s in plan if s.key.lower() in want or s.name.lower() in want]


def between(plan: list[Step], start: str | None = None, end: str | None = None) -> list[Step]:
    """From the first step that matches ``start`` to the last that matches ``end``; a name that matches none is ignored; empty if reversed."""
    hit = lambda n: [i for i, s in enumerate(plan) if n and n.lower() in (s.key.lower(), s.name.lower())]
    a, b = hit(start), hit(end)
    return plan[a[0] if a else 0 : (b[-1] if b else len(plan) - 1) + 1]


def run_plan(plan: list[Step], catalog: Catalog, folder: str | None = None, stop_on_failure: bool = True, store: bool = False) -> tuple[Catalog, list[tuple[str, str, float]]]:
    """The catalog after all steps and (key, status, seconds) of each. With ``folder`` results are stored as Parquet and read back, so that a
    later run can resume from them; with ``store`` they are kept in the session's shared folder until the process ends."""
    log = []
    for s in plan:
        began = time.time()
        try:
            new = s.run(catalog)
            if folder:
                for name, df in new.items():
                    df.write.mode("overwrite").parquet(f"{folder}/{name}")
                    new[name] = df.sparkSession.read.parquet(f"{folder}/{name}")
            elif store:
                new = {name: materialise(df, name) for name, df in new.items()}
            catalog = catalog | new
            log.append((s.key, "done", time.time() - began))
        except Exception as e:
            log.append((s.key, f"error: {e}"[:200], time.time() - began))
            if stop_on_failure:
                break
    return catalog, log


def preprocessing() -> list[Step]:
    """documents -> ingested -> cleaned -> sentences -> tokens -> chunks. ``sentences`` may be given in the catalog as raw units."""

    def clean(c: Catalog) -> Catalog:
        return {"cleaned": textprep.clean_documents(c["ingested"])}

    def segment(c: Catalog) -> Catalog:
        # Rule-based units with their positions in the cleaned text; the catalog can bring others as raw_units.
        raw = c["raw_units"] if "raw_units" in c else sentences.segment(c["cleaned"], text="cleaned_text")
        return {"sentences": textprep.emit_sentences(raw)}

    return [
        Step("ingest", "Ingest", lambda c: {"ingested": textprep.ingest(c["documents"])}),
        Step("clean", "Clean", clean),
        Step("segment", "Segment", segment),
        Step("lemmatize", "Tag and lemmatise", lambda c: {"tokens": terms.tokens(c["sentences"])}),
        Step("chunk", "Chunk", lambda c: {"chunks": textprep.chunk(c["sentences"])}),
    ]


BASE = "http://example.org/onto#"


def _rdf(links: DataFrame, triples: DataFrame, types: DataFrame) -> Catalog:
    """Axioms and triples of an ontology: admitted links without cycles, properties with domain and range, assertions. ``types``: term, bucket."""
    ax = axioms.domains_and_ranges(triples, types)
    admitted = links.where(axioms.link_problem(F.col("child"), F.col("parent"), F.lit(True)).isNull()).select("child", "parent").distinct()
    tree = graph.break_cycles(admitted).where("not removed").select("child", "parent")
    ends = ax.select(F.explode(F.array("domain", "range")).alias("label")).where("label <> '' and label <> 'Literal'")
    names = axioms.local_names(axioms.class_set(tree, triples).select(F.col("term").alias("label")).unionByName(ends))
    names = materialise(names, "names")
    n = lambda a, b: names.select(F.col("label").alias(a), F.col("name").alias(b))
    named = tree.join(n("child", "cn"), "child").join(n("parent", "pn"), "parent").select(F.col("cn").alias("child"), F.col("pn").alias("parent"))
    kinds = axioms.property_kinds(triples).select("rel", F.coalesce("datatype", F.lit("string")).alias("datatype"))
    lit = F.col("kind") == "datatype"
    props = ax.join(n("domain", "dn"), "domain", "left").join(n("range", "rn"), "range", "left").join(kinds, "rel")
    props = props.select("rel", axioms.snake_name(F.col("rel")).alias("name"), "kind", F.coalesce("dn", F.lit("")).alias("domain"), F.when(lit, F.col("datatype")).otherwise(F.coalesce("rn", F.lit(""))).alias("range"))
    kept = axioms.keep_assertions(triples, ax).join(n("s", "sn"), "s").join(n("o", "on"), "o", "left").join(kinds, "rel")
    facts = kept.select(F.col("sn").alias("s"), axioms.snake_name(F.col("rel")).alias("rel"), F.when(lit, F.col("o")).otherwise(F.col("on")).alias("o"), lit.alias("literal"), "datatype").where("o is not null")
    return {"axioms": ax, "links": tree, "properties": props, "rdf": rdf.ontology(names, named, props.select("name", "kind", "domain", "range"), facts, BASE)}


def hybrid(labeller: Factory = labelling.rule_labeller, dim: int = 32) -> list[Step]:
    """Terms, enrichment, labels, vectors, taxonomy, its validation, relations, their validation, axioms and triples, from the tokens and sentences.

    ``labeller`` makes the model that labels terms and judges links and relations; the default decides by rules.
    """

    def extract(c: Catalog) -> Catalog:
        cands = materialise(terms.candidates(c["tokens"]), "candidates")
        kept = terms.aggregate(cands, 2)
        t, ids = terms.tf_idf(kept, cands), F.xxhash64("lemma", "n_tokens")
        return {"term_candidates": t.select(ids.alias("term_id"), "term_text", F.col("lemma").alias("term_lemma"), "n_tokens", "freq_total", "freq_docs", "idf", "tf_idf"), "occurrences": terms.kept_occurrences(cands, kept)}

    def enriched(c: Catalog) -> Catalog:
        return {"enriched": enrich.generic_score(enrich.canonical_groups(c["term_candidates"]))}

    def label(c: Catalog) -> Catalog:
        asked = c["enriched"].where("not is_generic").withColumn("prompt", labelling.prompt_column('Label the term "{canonical_term}"'))
        raw = labelling.generate(asked, "prompt", labeller, "labels", output="raw").select("canonical_id", "canonical_term", "raw")
        return {"labels": enrich.validate_labels(raw).select("canonical_id", F.col("canonical_term").alias("term"), F.col("ontology_role").alias("role"), "is_domain", "confidence", F.lit(None).cast("string").alias("definition"))}

    def vectors(c: Catalog) -> Catalog:
        model = knn.train_skipgram(knn.corpus(c["tokens"]), dim=dim)
        t = c["enriched"].where("not is_generic").select(F.col("canonical_id").alias("term_id"), F.col("canonical_term").alias("term"))
        v = materialise(knn.phrase_vectors(t, model.getVectors().select("word", vector_to_array("vector").alias("vec"))).where("vec is not null"), "term-vectors")
        near = knn.exact_top_k(v.select(F.col("term_id").alias("id"), "vec"), v.select(F.col("term_id").alias("id"), "vec"), k=10)
        return {"vectors": v, "neighbours": near.select(F.col("id").alias("term_id"), F.col("neighbour").alias("neighbor_term_id"), "similarity")}

    def is_a(c: Catalog) -> Catalog:
        t = taxonomy.class_terms(c["labels"]).select("term")
        heads = c["enriched"].select(last(taxonomy.words(F.col("canonical_term"))).alias("term")).where("term is not null")
        seed = materialise(taxonomy.head_match(t, heads).select("child", "parent", F.lit("head_match").alias("method")), "seed")
        found = taxonomy.hearst(c["sentences"], c["enriched"].select(F.col("canonical_term").alias("term"))).select("child", "parent", F.lit("hearst").alias("method"))
        ids = c["enriched"].select(F.col("canonical_id").alias("term_id"), F.lower("canonical_term").alias("child")).distinct()
        seeds = seed.withColumn("child", F.lower("child")).join(ids, "child").select("term_id", "parent")
        near = taxonomy.expand_by_neighbours(seeds, c["neighbours"], ids.select("term_id")).join(ids.withColumnRenamed("term_id", "child_id"), "child_id").select("child", "parent", F.lit("embedding").alias("method"))
        return {"taxonomy_found": seed.unionByName(found).unionByName(near).where("child <> parent").distinct()}

    def judge_links(c: Catalog) -> Catalog:
        e = materialise(c["taxonomy_found"].select("child", "parent").distinct().withColumn("edge_id", F.xxhash64("child", "parent")), "links")
        asked = e.withColumn("prompt", labelling.prompt_column('Is every "{child}" a "{parent}"?'))
        v = labelling.generate(asked, "prompt", labeller, "links", output="raw").select("edge_id", "raw")
        return {"taxonomy": relations.accept_edges(e, v).where("decision = 'accept'").select("child", "parent")}

    def open_relations(c: Catalog) -> Catalog:
        s = relations.svo(c["tokens"])
        key = relations.relation_key(F.col("verb"), F.col("prep"))
        t = s.select(F.col("subj").alias("s"), key.alias("rel"), F.col("obj").alias("o")).where(~relations.generic_span(F.col("subj")) & ~relations.generic_span(F.col("obj")) & relations.valid_relation(F.col("verb")))
        like = relations.taxonomy_like(t, graph.closure(c["taxonomy"])).where("like is null").drop("like")
        like = materialise(like, "relations")
        return {"triples_found": like.join(relations.diverse_relations(like).select("rel"), "rel").select("s", "rel", "o").distinct()}

    def judge_relations(c: Catalog) -> Catalog:
        t = materialise(c["triples_found"].withColumn("edge_id", F.xxhash64("s", "rel", "o")), "triples")
        asked = t.withColumn("prompt", labelling.prompt_column('Does "{s}" {rel} "{o}"?'))
        v = labelling.generate(asked, "prompt", labeller, "relations", batch=10, output="raw").select("edge_id", "raw")
        return {"triples": relations.accept_edges(t, v).where("decision = 'accept'").select("s", "rel", "o")}

    def to_rdf(c: Catalog) -> Catalog:
        return _rdf(c["taxonomy"], c["triples"], c["taxonomy"].select(F.col("child").alias("term"), F.col("parent").alias("bucket")))

    return [
        Step("terms", "Term extraction", extract), Step("enrich", "Enrichment", enriched), Step("label", "Labels by the model", label), Step("vectors", "Skip-gram vectors and neighbours", vectors),
        Step("taxonomy", "Taxonomy", is_a), Step("judge_links", "Validation of links", judge_links), Step("relations", "Relations", open_relations),
        Step("judge_relations", "Validation of relations", judge_relations), Step("axioms", "Axioms and RDF", to_rdf),
    ]


def llm(labeller: Factory = labelling.rule_labeller, lister: Factory = labelling.rule_lister, linker: Factory = labelling.rule_linker, relater: Factory = labelling.rule_relater) -> list[Step]:
    """Terms listed by a model for each chunk, their labels, is-a links and relations between listed terms by number, axioms and triples. The default models decide by rules."""

    def listed(c: Catalog) -> Catalog:
        asked = c["chunks"].select("doc_id", "chunk_id", "text").withColumn("prompt", labelling.few_shot("List the technical terms of the text as JSON.", [{"input": "The job queue.", "output": '{"terms": ["job queue"]}'}], F.col("text")))
        raw = labelling.generate(asked, "prompt", lister, "lister", output="raw")
        t = terms.accumulate_terms(raw.select("doc_id", "chunk_id", F.explode(labelling.parse_terms_udf("raw")).alias("term")))
        places = raw.select("doc_id", "chunk_id", F.explode(labelling.parse_terms_udf("raw")).alias("term")).select("doc_id", "chunk_id", F.trim("term").alias("term")).distinct()
        return {"llm_terms": places.join(t.select("term", "freq_total"), "term").select(F.xxhash64("term").alias("term_id"), "term", "doc_id", "chunk_id", "freq_total")}

    def label(c: Catalog) -> Catalog:
        t = c["llm_terms"].select("term_id", "term").distinct().withColumn("canonical", enrich.suffix_canonical(F.col("term")))
        one = t.groupBy("canonical").agg(F.min("term").alias("term")).where("canonical <> ''").withColumn("prompt", labelling.prompt_column('Label the term "{term}"'))
        v = enrich.validate_labels(labelling.generate(one, "prompt", labeller, "labels", output="raw").select("canonical", "raw"))
        v = v.select("canonical", F.xxhash64("canonical").alias("label_id"), F.col("ontology_role").alias("role"), "is_domain", "confidence")
        return {"llm_labels": t.join(v, "canonical").select("term_id", "term", "canonical", "label_id", "is_domain", "role", F.col("role").alias("category"), "confidence")}

    def numbered(c: Catalog, strict: bool) -> tuple[DataFrame, DataFrame]:
        lab = c["llm_labels"].select("term_id", "label_id", "is_domain", "role", "category")
        cands = materialise(taxonomy.chunk_candidates(c["llm_terms"], lab, ["class", "instance"], strict=strict), "numbered")
        lists = cands.groupBy("doc_id", "chunk_id").agg(F.array_sort(F.collect_list(F.struct("idx", "term")))["term"].alias("ts")).where(F.size("ts") > 1)
        return cands, lists.select("doc_id", "chunk_id", labelling.indexed_list(F.col("ts")).alias("prompt"))

    def links(c: Catalog) -> Catalog:
        cands, lists = numbered(c, False)
        raw = labelling.generate(lists, "prompt", linker, "linker", output="raw").select("doc_id", "chunk_id", "raw")
        return {"llm_links": taxonomy.indexed_edges(raw, cands).select(F.lower("left_term").alias("child"), F.lower("right_term").alias("parent")).where("child <> parent").distinct()}

    def related(c: Catalog) -> Catalog:
        cands, lists = numbered(c, True)
        raw = labelling.generate(lists, "prompt", relater, "relater", output="raw").select("doc_id", "chunk_id", "raw")
        t = relations.indexed_relations(raw, cands)
        return {"llm_triples": t.select(F.lower("subj").alias("s"), F.col("predicate").alias("rel"), F.lower("obj").alias("o"))}

    def to_rdf(c: Catalog) -> Catalog:
        types = c["llm_links"].select(F.col("child").alias("term"), F.col("parent").alias("bucket"))
        return _rdf(c["llm_links"], c["llm_triples"], types)

    return [Step("list", "Terms by the model", listed), Step("label", "Labels by the model", label), Step("links", "Is-a links by the model", links), Step("relate", "Relations by the model", related), Step("axioms", "Axioms and RDF", to_rdf)]


PREFIXES = "".join(f"@prefix {p}: <{ns}> .\n" for p, ns in (("rdf", rdf.RDF), ("rdfs", rdf.RDFS), ("owl", rdf.OWL), ("xsd", rdf.XSD), ("hpc", BASE)))


def direct(writer: Factory = labelling.rule_writer, attempts: int = 2) -> list[Step]:
    """Turtle written by a model for each chunk: cleaned, names made alike, repaired or put into quarantine, read. The default model writes by rules."""

    def written(c: Catalog) -> Catalog:
        asked = c["chunks"].select(F.col("chunk_id").alias("id"), F.concat(F.lit("Write the ontology of this text in Turtle:\n"), "text").alias("prompt"))
        raw = labelling.generate(asked, "prompt", writer, "writer", output="raw")
        clean = materialise(raw.select("id", turtle_text.canonical_names_udf(turtle_text.dots_in_brackets_udf(turtle_text.sanitise(F.col("raw")))).alias("text")), "fragments")
        good, bad = turtle_text.repair(clean.where("text <> ''"), writer, PREFIXES, attempts)
        return {"fragments": good, "quarantine": bad, "rdf": rdf.read_turtle(good, prefixes=PREFIXES).where("error is null").select("s", "p", "o", "o_kind", "o_datatype").distinct()}

    return [Step("write", "Turtle by the model", written)]


BRANCHES: dict[str, Callable[..., list[Step]]] = {"hybrid": hybrid, "llm": llm, "direct": direct}


def build(branch: str = "hybrid", **models) -> list[Step]:
    """Preprocessing and the chosen branch; ``models`` are the factories that the branch takes."""
    return preprocessing() + BRANCHES[branch](**models)


def choose(names: str) -> list[str]:
    """The branches in a list such as 'hybrid, llm'; 'all' for every one; raises ValueError for a name that is none."""
    want = [n.strip().lower() for n in names.split(",") if n.strip()]
    if "all" in want:
        return list(BRANCHES)
    if unknown := [n for n in want if n not in BRANCHES]:
        raise ValueError(f"no branch: {', '.join(unknown)}; there are {', '.join(BRANCHES)}")
    return list(dict.fromkeys(want))


def describe(plan: list[Step]) -> list[str]:
    return [f"{i}. {s.key}: {s.name}" for i, s in enumerate(plan, 1)]


def main(spark: SparkSession, documents: DataFrame, folder: str, branch: str = "hybrid", keep: list[str] | None = None) -> Catalog:
    plan = build(branch)
    catalog, log = run_plan(only(plan, keep) if keep else plan, {"documents": documents}, folder)
    for key, status, seconds in log:
        print(f"{key}: {status} ({seconds:.1f} s)")
    return catalog
