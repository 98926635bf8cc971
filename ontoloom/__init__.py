"""ontoloom: text-to-ontology analytics as Spark DataFrame operators."""
