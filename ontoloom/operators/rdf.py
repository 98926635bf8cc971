"""Ontologies as frames of triples: writing, a reader for the Turtle subset, structure, schema and usage checks, samples, precision.

A triple is (s, p, o, o_kind, o_datatype): s, p and resource objects are IRIs without brackets or blank nodes ('_:x'), o_kind is iri, bnode or literal, and
literals carry their lexical value in o and the IRI of their datatype, or '@' and their language, in o_datatype.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

RDF, RDFS, OWL, XSD = (
    "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2000/01/rdf-schema#", "http://www.w3.org/2002/07/owl#", "http://www.w3.org/2001/XMLSchema#",
)
TYPE, SUBCLASS, DOMAIN, RANGE, LABEL = RDF + "type", RDFS + "subClassOf", RDFS + "domain", RDFS + "range", RDFS + "label"
#: Types that declare, predicates of the schema.
DECLARATIONS = [OWL + x for x in ("Class", "ObjectProperty", "DatatypeProperty", "AnnotationProperty", "Ontology", "NamedIndividual")] + [RDFS + "Class", RDF + "Property"]
SCHEMA_PREDICATES = [TYPE, SUBCLASS, DOMAIN, RANGE, LABEL, RDFS + "comment", RDFS + "subPropertyOf", OWL + "inverseOf", OWL + "disjointWith", OWL + "equivalentClass", OWL + "imports"]
COLUMNS = "s string, p string, o string, o_kind string, o_datatype string"


def triple(s: Column, p: Column | str, o: Column | str, kind: str = "iri", datatype: str = "") -> list[Column]:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return [s.alias("s"), lit(p).alias("p"), lit(o).alias("o"), F.lit(kind).alias("o_kind"), F.lit(datatype).alias("o_datatype")]


def ontology(classes: DataFrame, links: DataFrame, properties: DataFrame, assertions: DataFrame, base: str) -> DataFrame:
    """The triples of an ontology, each once: ``classes`` (name, label), ``links`` (child, parent), ``properties`` (name, kind, domain, range), ``assertions`` (s, rel, o, literal, datatype)."""
    iri = lambda c: F.concat(F.lit(base), F.col(c))
    xsd = lambda c: F.concat(F.lit(XSD), F.col(c))
    parts = [
        classes.select(*triple(iri("name"), TYPE, OWL + "Class")), classes.select(*triple(iri("name"), LABEL, F.col("label"), "literal", XSD + "string")), links.select(*triple(iri("child"), SUBCLASS, iri("parent"))),
        properties.select(*triple(iri("name"), TYPE, F.when(F.col("kind") == "datatype", OWL + "DatatypeProperty").otherwise(OWL + "ObjectProperty"))),
        properties.where("domain <> ''").select(*triple(iri("name"), DOMAIN, iri("domain"))),
        properties.where("range <> ''").select(*triple(iri("name"), RANGE, F.when(F.col("kind") == "datatype", xsd("range")).otherwise(iri("range")))),
        assertions.where("not literal").select(*triple(iri("s"), iri("rel"), iri("o"))),
        assertions.where("literal").select(iri("s").alias("s"), iri("rel").alias("p"), F.col("o"), F.lit("literal").alias("o_kind"), xsd("datatype").alias("o_datatype")),
    ]
    t = parts[0]
    for x in parts[1:]:
        t = t.unionByName(x)
    return t.distinct()


def node_text(c: Column) -> Column:
    return F.when(c.startswith("_:"), c).otherwise(F.concat(F.lit("<"), c, F.lit(">")))


def n_triples(triples: DataFrame) -> DataFrame:
    """``line``: one N-Triples line per triple."""
    obj = F.when(F.col("o_kind") == "literal", literal_text()).otherwise(node_text(F.col("o")))
    return triples.select(F.concat_ws(" ", node_text(F.col("s")), node_text(F.col("p")), obj, F.lit(".")).alias("line"))


def literal_text() -> Column:
    """The literal of a triple, escaped, with its datatype or language."""
    esc = F.regexp_replace(F.regexp_replace(F.regexp_replace("o", r"\\", r"\\\\"), '"', r'\\"'), "\n", r"\\n")
    esc = F.regexp_replace(esc, "\r", r"\\r")
    tag = F.col("o_datatype")
    return F.concat(F.lit('"'), esc, F.lit('"'), F.when(tag.startswith("@"), tag).when(tag != "", F.concat(F.lit("^^<"), tag, F.lit(">"))).otherwise(""))


_LOCAL = r"^[A-Za-z_][A-Za-z0-9_-]*$"


def turtle(triples: DataFrame, prefixes: dict[str, str]) -> DataFrame:
    """``line``: one Turtle statement per triple, names abbreviated by the prefixes, 'a' for types; the header is ``turtle_header``."""
    m = {p: ns for p, ns in sorted(prefixes.items(), key=lambda x: -len(x[1]))}

    def name(c: Column) -> Column:
        out = F.when(c.startswith("_:"), c)
        for p, ns in m.items():
            local = F.substr(c, F.lit(len(ns) + 1))
            out = out.when(c.startswith(ns) & local.rlike(_LOCAL), F.concat(F.lit(f"{p}:"), local))
        return out.otherwise(F.concat(F.lit("<"), c, F.lit(">")))

    full = literal_text()
    tag = F.col("o_datatype")
    quoted = F.regexp_extract(full, r'(?s)^("(?:[^"\\]|\\.)*")', 1)
    lit = F.when(tag.startswith("@") | (tag == ""), full).when(tag == XSD + "string", quoted).otherwise(F.concat(quoted, F.lit("^^"), name(tag)))
    obj = F.when(F.col("o_kind") == "literal", lit).otherwise(name(F.col("o")))
    pred = F.when(F.col("p") == TYPE, "a").otherwise(name(F.col("p")))
    return triples.select(F.concat_ws(" ", name(F.col("s")), pred, obj, F.lit(".")).alias("line"))


def turtle_header(prefixes: dict[str, str]) -> str:
    return "".join(f"@prefix {p}: <{ns}> .\n" for p, ns in prefixes.items())


def reified_edges(edges: DataFrame, base: str) -> DataFrame:
    """The links (child, parent, method) as subClassOf triples with a blank node each that tells the method."""
    iri = lambda c: F.concat(F.lit(base), F.col(c))
    node = F.concat(F.lit("_:e"), F.md5(F.concat_ws("|", "child", "parent", "method")))
    e = edges.select("child", "parent", "method").distinct()
    parts = [(iri("child"), SUBCLASS, iri("parent"), "iri"), (node, OWL + "annotatedSource", iri("child"), "iri"), (node, OWL + "annotatedTarget", iri("parent"), "iri"), (node, base + "method", F.col("method"), "literal")]
    t = None
    for s, p, o, k in parts:
        x = e.select(*triple(s, p, o, k, XSD + "string" if k == "literal" else ""))
        t = x if t is None else t.unionByName(x)
    return t.distinct()


# --- reading ----------------------------------------------------------------------------------------------------------------

_TOKEN = re.compile(
    r"""\s+|\#[^\n]*|(?P<iri><(?:[^<>"{}|^`\\\s]|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8})*>)|(?P<lit>\"\"\"(?:[^"\\]|\\.|"(?!""))*\"\"\"|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|(?P<at>@[A-Za-z][\w-]*)|(?P<dt>\^\^)|(?P<num>[+-]?(?:\d+\.\d+|\d+)(?![\w]))"""
    r"""|(?P<bn>_:[\w-]+)|(?P<pn>[A-Za-z][\w.-]*?:[\w.%-]*[\w%-]|[A-Za-z][\w.-]*?:|:[\w.%-]*[\w%-]|:)|(?P<kw>a(?![\w:])|true|false)|(?P<pc>[.;,\[\]()])""",
    re.S,
)


class TurtleError(ValueError):
    """The text is outside the subset of Turtle that is read here."""


#: The one-letter escapes of strings.
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}
_ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", re.S)


def unescape(s: str) -> str:
    """The text that an escaped string or IRI stands for."""

    def one(m: re.Match) -> str:
        code = m.group(1) or m.group(2)
        if code is None:
            return _ESCAPES.get(m.group(3), m.group(3))
        if int(code, 16) > 0x10FFFF:
            raise TurtleError(f"no character: {m.group()}")
        return chr(int(code, 16))

    return _ESCAPE.sub(one, s) if "\\" in s else s


def parse_turtle(text: str, scope: str = "") -> list[tuple[str, str, str, str, str]]:
    """The triples of a text in the subset of Turtle without collections: prefixes, IRIs, names, blank nodes (also in brackets), literals.

    ``scope`` begins the labels of blank nodes, so that those of different texts stay apart.
    """
    prefixes, out, pos, toks, n_anon = {}, [], 0, [], 0
    while pos < len(text):
        m = _TOKEN.match(text, pos)
        if not m:
            raise TurtleError(f"unreadable at {pos}: {text[pos : pos + 20]!r}")
        pos = m.end()
        if m.lastgroup:
            toks.append((m.lastgroup, m.group()))
    at, labels = 0, {v for k, v in toks if k == "bn"}

    def peek() -> tuple[str, str]:
        return toks[at] if at < len(toks) else ("end", "")

    def take(want: str | None = None) -> tuple[str, str]:
        nonlocal at
        t = peek()
        if t[0] == "end" or (want and t[1] != want):
            raise TurtleError(f"expected {want or 'more'}, found {t[1] or 'the end'!r}")
        at += 1
        return t

    def name(t: tuple[str, str]) -> str:
        kind, v = t
        if kind == "iri":
            return unescape(v[1:-1])
        if kind == "bn":
            return f"_:{scope}{v[2:]}"
        if kind == "pn":
            p, _, local = v.partition(":")
            if p not in prefixes:
                raise TurtleError(f"unknown prefix {p!r}")
            return prefixes[p] + local
        raise TurtleError(f"no name: {v!r}")

    def node() -> tuple[str, str, str]:
        nonlocal n_anon
        t = take()
        if t[1] == "[":
            n_anon += 1
            while f"_:b{n_anon}" in labels:
                n_anon += 1
            b = f"_:{scope}b{n_anon}"
            if peek()[1] != "]":
                predicates(b)
            take("]")
            return b, "bnode", ""
        if t[0] == "lit":
            q = 3 if t[1][:3] == '"""' else 1
            v = unescape(t[1][q:-q])
            if peek()[0] == "dt":
                take()
                return v, "literal", name(take())
            if peek()[0] == "at":
                return v, "literal", take()[1].lower()
            return v, "literal", XSD + "string"
        if t[0] == "num":
            return t[1], "literal", XSD + ("decimal" if "." in t[1] else "integer")
        if t[0] == "kw" and t[1] != "a":
            return t[1], "literal", XSD + "boolean"
        x = name(t)
        return x, "bnode" if x.startswith("_:") else "iri", ""

    def predicates(s: str) -> None:
        while True:
            t = take()
            p = TYPE if t == ("kw", "a") else name(t)
            while True:
                out.append((s, p, *node()))
                if peek()[1] != ",":
                    break
                take()
            if peek()[1] != ";":
                return
            while peek()[1] == ";":
                take()
            if peek()[1] in (".", "]") or peek()[0] == "end":
                return

    while peek()[0] != "end":
        if peek() == ("at", "@prefix"):
            take()
            p = take()[1]
            prefixes[p[:-1]] = name(take())
            take(".")
            continue
        s, kind, _ = node()
        if kind == "literal":
            raise TurtleError("a literal as subject")
        if peek()[1] != ".":
            predicates(s)
        take(".")
    return out


def read_turtle(texts: DataFrame, column: str = "text", key: str = "id", prefixes: str = "") -> DataFrame:
    """``<key>, error`` and the triple columns: the triples of each text; a text that can't be read gives one row with its error instead.

    Labels of blank nodes begin with a hash of key and text: different texts share none.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, t in zip(b["k"], b["t"], strict=True):
                scope = hashlib.md5(f"{k}\0{t}".encode()).hexdigest() + "-"
                try:
                    rows += [(k, None, *x) for x in parse_turtle(prefixes + t, scope)]
                except TurtleError as e:
                    rows.append((k, str(e), None, None, None, None, None))
            yield pd.DataFrame(rows, columns=["k", "error", "s", "p", "o", "o_kind", "o_datatype"])

    out = texts.select(F.col(key).cast("string").alias("k"), F.col(column).alias("t")).where("t is not null").mapInPandas(run, f"k string, error string, {COLUMNS}")
    return out.withColumnRenamed("k", key)


# --- evaluation ---------------------------------------------------------------------------------------------------------------


def declared(triples: DataFrame) -> DataFrame:
    """``iri, kind``: the named classes and object, datatype, annotation and plain properties."""
    kinds = {OWL + "Class": "class", RDFS + "Class": "class", OWL + "ObjectProperty": "object", OWL + "DatatypeProperty": "datatype", OWL + "AnnotationProperty": "annotation", RDF + "Property": "plain"}
    m = F.create_map(*(F.lit(x) for kv in kinds.items() for x in kv))
    return triples.where((F.col("p") == TYPE) & ~F.col("s").startswith("_:")).select(F.col("s").alias("iri"), m[F.col("o")].alias("kind")).where("kind is not null").distinct()


def taxonomy(triples: DataFrame) -> DataFrame:
    """``child, parent`` of the named subClassOf triples."""
    return triples.where((F.col("p") == SUBCLASS) & (F.col("o_kind") == "iri") & ~F.col("s").startswith("_:")).select(F.col("s").alias("child"), F.col("o").alias("parent"))


def relations(triples: DataFrame) -> DataFrame:
    """The triples whose predicate isn't of the schema."""
    return triples.where(~F.col("p").isin(SCHEMA_PREDICATES))


def structure(triples: DataFrame) -> DataFrame:
    """``section, metric, value``: numbers of declarations, links, relations and repeated statements, in one pass over each part."""
    d = declared(triples).groupBy("kind").agg(F.count("*").alias("value")).select(F.lit("declared").alias("section"), F.col("kind").alias("metric"), "value")
    n = triples.agg(
        F.count("*").alias("statements"), (F.count("*") - F.count_distinct(F.struct("s", "p", "o", "o_kind", "o_datatype"))).alias("repeated"), F.count_if(F.col("p") == SUBCLASS).alias("links"),
        F.count_if(~F.col("p").isin(SCHEMA_PREDICATES)).alias("relations"), F.count_if(F.col("o_kind") == "literal").alias("literals"),
    )
    return d.unionByName(n.unpivot([], n.columns, "metric", "value").select(F.lit("statements").alias("section"), "metric", "value"))


def predicate_frequencies(triples: DataFrame, n: int = 10) -> DataFrame:
    return relations(triples).groupBy("p").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p").limit(n)


def schema_problems(triples: DataFrame) -> DataFrame:
    """``problem, iri``: classes that are properties, properties of both kinds, object properties with a literal range, datatype properties with another, undeclared predicates."""
    d = declared(triples)
    per = d.groupBy("iri").agg(F.collect_set("kind").alias("k"))
    has = lambda *ks: F.arrays_overlap("k", F.array(*(F.lit(k) for k in ks)))
    a = per.where(has("class") & has("object", "datatype", "annotation", "plain")).select(F.lit("class_and_property").alias("problem"), "iri")
    b = per.where(has("object") & has("datatype")).select(F.lit("object_and_datatype").alias("problem"), "iri")
    r = triples.where((F.col("p") == RANGE) & (F.col("o_kind") == "iri")).select(F.col("s").alias("iri"), F.col("o").startswith(XSD).alias("xsd")).join(per, "iri")
    c = r.where(has("object") & F.col("xsd")).select(F.lit("object_with_literal_range").alias("problem"), "iri")
    e = r.where(has("datatype") & ~F.col("xsd")).select(F.lit("datatype_with_other_range").alias("problem"), "iri")
    u = relations(triples).select(F.col("p").alias("iri")).distinct().join(d.where("kind in ('object', 'datatype', 'annotation')"), "iri", "left_anti").select(F.lit("undeclared").alias("problem"), "iri")
    return a.unionByName(b).unionByName(c).unionByName(e).unionByName(u).distinct()


def usage_problems(triples: DataFrame, closed: DataFrame) -> DataFrame:
    """``problem, s, p, o``: uses against domain or range, literals of object properties, resources of datatype properties. ``closed``: node, ancestor."""
    types = triples.where((F.col("p") == TYPE) & (F.col("o_kind") == "iri") & ~F.col("o").isin(DECLARATIONS)).select(F.col("s").alias("x"), F.col("o").alias("c"))
    types = types.unionByName(types.join(closed.select(F.col("node").alias("c"), "ancestor"), "c").select("x", F.col("ancestor").alias("c"))).groupBy("x").agg(F.collect_set("c").alias("types"))
    req = lambda pred, out: triples.where((F.col("p") == pred) & (F.col("o_kind") == "iri")).groupBy(F.col("s").alias("p")).agg(F.collect_set("o").alias(out))
    kinds = declared(triples).groupBy(F.col("iri").alias("p")).agg(F.collect_set("kind").alias("kinds"))
    t = relations(triples).join(req(DOMAIN, "dom"), "p", "left").join(req(RANGE, "ran"), "p", "left").join(kinds, "p", "left")
    t = t.join(types.select(F.col("x").alias("s"), F.col("types").alias("st")), "s", "left").join(types.select(F.col("x").alias("o"), F.col("types").alias("ot")), "o", "left")
    other = F.filter("ran", lambda r: ~r.startswith(XSD))
    is_ = lambda k: F.coalesce(F.array_contains("kinds", k), F.lit(False))
    lit = F.col("o_kind") == "literal"
    found = F.array_compact(F.array(
        F.when(F.size("dom") > 0, F.when(F.size("st") > 0, F.when(~F.arrays_overlap("st", "dom"), "domain"))), F.when(~lit & (F.size(other) > 0), F.when(F.size("ot") > 0, F.when(~F.arrays_overlap("ot", other), "range"))),
        F.when(lit & is_("object"), "literal_object"), F.when(~lit & is_("datatype"), "resource_value"),
    ))
    return t.select(F.explode(found).alias("problem"), "s", "p", "o").distinct()


def short_name(c: Column) -> Column:
    """The part of an IRI behind '#', the last '/' or ':'."""
    return F.regexp_extract(c, r"([^#/:]*)$", 1)


def display(c: Column, prefixes: dict[str, str]) -> Column:
    """An IRI with its prefix where one is known, else in brackets; blank nodes as they are."""
    out = F.when(c.startswith("_:"), c)
    for p, ns in sorted(prefixes.items(), key=lambda x: -len(x[1])):
        out = out.when(c.startswith(ns), F.concat(F.lit(f"{p}:"), F.substr(c, F.lit(len(ns) + 1))))
    return out.otherwise(F.concat(F.lit("<"), c, F.lit(">")))


def concepts(triples: DataFrame) -> DataFrame:
    """``term``: labels or short names of the named classes and of the ends of links, each once (case aside: the smallest spelling), sorted by the reader."""
    named = declared(triples).where("kind = 'class'").select("iri").unionByName(taxonomy(triples).select(F.explode(F.array("child", "parent")).alias("iri")))
    lab = triples.where((F.col("p") == LABEL) & (F.col("o_kind") == "literal")).groupBy(F.col("s").alias("iri")).agg(F.min("o").alias("label"))
    t = named.where(~F.col("iri").startswith(OWL)).distinct().join(lab, "iri", "left").select(F.coalesce("label", short_name(F.col("iri"))).alias("term")).where("term <> ''")
    return t.groupBy(F.lower("term").alias("k")).agg(F.min("term").alias("term")).select("term")


def sample(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows in an order given by the seed and the rows' content."""
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(c).cast("string") for c in sorted(df.columns))))
    return df.orderBy(key).limit(n)


def manual_precision(labels: DataFrame, column: str = "label") -> DataFrame:
    """One row: valid, invalid, ambiguous and other answers, precision over all three and without the ambiguous ones."""
    c = F.lower(F.trim(column))
    n = labels.agg(F.count_if(c == "valid").alias("valid"), F.count_if(c == "invalid").alias("invalid"), F.count_if(c == "ambiguous").alias("ambiguous"), F.count_if(F.coalesce(~c.isin("valid", "invalid", "ambiguous"), F.lit(True))).alias("other"))
    part = lambda d: F.when(d > 0, F.col("valid") / d).otherwise(0.0)
    return n.withColumn("precision", part(F.col("valid") + F.col("invalid") + F.col("ambiguous"))).withColumn("strict_precision", part(F.col("valid") + F.col("invalid")))


def quality_report(triples: DataFrame, closed: DataFrame) -> DataFrame:
    """``section, metric, value``: structure, schema problems and usage problems in one long table."""
    s = schema_problems(triples).groupBy("problem").agg(F.count("*").alias("value")).select(F.lit("schema").alias("section"), F.col("problem").alias("metric"), "value")
    u = usage_problems(triples, closed).groupBy("problem").agg(F.count("*").alias("value")).select(F.lit("usage").alias("section"), F.col("problem").alias("metric"), "value")
    return structure(triples).unionByName(s).unionByName(u)


def ranked_sample(df: DataFrame, n: int, by: str, seed: int = 42) -> DataFrame:
    """``n`` rows of each value of ``by``."""
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(c).cast("string") for c in sorted(df.columns))))
    return df.withColumn("_r", F.row_number().over(W.partitionBy(by).orderBy(key))).where(F.col("_r") <= n).drop("_r")


# --- evaluation exports ----------------------------------------------------------------------------------------------------------

BUILT_IN = (RDF, RDFS, OWL, XSD)


def _own(c: str) -> Column:
    """A named resource that is of none of the built-in vocabularies."""
    x = F.col(c)
    ok = ~x.startswith("_:")
    for ns in BUILT_IN:
        ok = ok & ~x.startswith(ns)
    return ok & (short_name(x) != "")


def taxonomy_rows(triples: DataFrame) -> DataFrame:
    """``child, parent``: short names of the named subClassOf statements outside the built-in vocabularies, each once (IRIs compared case aside)."""
    t = taxonomy(triples).where(_own("child") & _own("parent"))
    g = t.groupBy(F.lower("child").alias("c"), F.lower("parent").alias("p")).agg(F.min(F.struct("child", "parent")).alias("x"))
    return g.select(short_name(F.col("x.child")).alias("child"), short_name(F.col("x.parent")).alias("parent"))


def relation_rows(triples: DataFrame) -> DataFrame:
    """``subject, relation, object``: short names of the statements between resources that are neither types nor of the schema, each once (IRIs compared case aside)."""
    t = relations(triples).where((F.col("o_kind") == "iri") & _own("s") & _own("p") & _own("o"))
    g = t.groupBy(F.lower("s").alias("a"), F.lower("p").alias("b"), F.lower("o").alias("c")).agg(F.min(F.struct("s", "p", "o")).alias("x"))
    return g.select(short_name(F.col("x.s")).alias("subject"), short_name(F.col("x.p")).alias("relation"), short_name(F.col("x.o")).alias("object"))


def node_roles(triples: DataFrame) -> DataFrame:
    """``iri, class_like, property_like``: every named subject or link end, class-like if it is declared a class or is an end of a subClassOf link."""
    kinds = declared(triples).select("iri", (F.col("kind") == "class").alias("c"), (F.col("kind") != "class").alias("p"))
    ends = triples.where((F.col("p") == SUBCLASS) & (F.col("o_kind") == "iri")).select(F.explode(F.array("s", "o")).alias("iri"), F.lit(True).alias("c"), F.lit(False).alias("p"))
    subjects = triples.select(F.col("s").alias("iri"), F.lit(False).alias("c"), F.lit(False).alias("p")).distinct()
    every = kinds.unionByName(ends).unionByName(subjects).where(~F.col("iri").startswith("_:"))
    return every.groupBy("iri").agg(F.bool_or("c").alias("class_like"), F.bool_or("p").alias("property_like"))


def markdown(report: DataFrame, title: str = "Ontology quality") -> DataFrame:
    """``line_no, line``: a report (section, metric, value) as Markdown: a heading for the report and each section, a list item for each metric, both in order of their names."""
    items = report.select("section", F.lit(1).alias("k"), "metric", F.concat(F.lit("- "), "metric", F.lit(": **"), F.col("value").cast("string"), F.lit("**")).alias("line"))
    heads = report.select("section").distinct().select("section", F.lit(0).alias("k"), F.lit("").alias("metric"), F.concat(F.lit("## "), "section").alias("line"))
    top = report.sparkSession.createDataFrame([("", 0, "", f"# {title}")], "section string, k int, metric string, line string")
    every = top.unionByName(heads).unionByName(items)
    return every.select(F.row_number().over(W.orderBy("section", "k", "metric")).alias("line_no"), "line")
