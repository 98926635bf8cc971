"""All queries of the library, without those of the llm subpackage."""

from __future__ import annotations

from ontoloom.plans import general_queries, graph_queries, model_queries, ontology_queries, rdf_queries, term_queries, text_queries

FLAGSHIP = "top_terms"
QUERIES: dict = {}
ORACLE: dict[str, str] = {}
for _m in (general_queries, text_queries, term_queries, ontology_queries, graph_queries, rdf_queries, model_queries):
    QUERIES |= _m.QUERIES
    ORACLE |= _m.ORACLE
