"""Line-oriented RDF: reading .nt and .nq text into triples and rejects, and writing triples back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.vocab import RDF, XSD

_IRI = r"<([^<>\"{}|^`\\\x00-\x20]*)>"
_NODE = r"(?:" + _IRI + r"|(_:[A-Za-z0-9_][A-Za-z0-9_.\-]*))"
_LITERAL = r"\"((?:[^\"\\\n\r]|\\.)*)\"(?:\^\^<([^<>\s]*)>|@([A-Za-z]+(?:-[A-Za-z0-9]+)*))?"
LINE = r"^\s*" + _NODE + r"\s+" + _IRI + r"\s+(?:" + _NODE + "|" + _LITERAL + r")\s*(?:" + _IRI + r")?\s*\.\s*(?:#.*)?$"
#: The same, all in one: both forms of the subject, the predicate, both of the object, a literal's opening quote, datatype,
#: language, graph and, last since a text may hold anything, the literal.  Nothing before it can hold a line end.
_PARTED = LINE.replace(_LITERAL, _LITERAL.replace('\\"(', '(\\")(', 1)) + r"[\s\S]*"
_PARTS = "\n".join(f"${i}" for i in (1, 2, 3, 4, 5, 6, 8, 9, 10, 7))
ESCAPES = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'"}


def unescape(text: Column) -> Column:
    """Undo backslash escapes, whatever characters the text holds: doubled backslashes part it, and each part is decoded."""
    whole = F.array_join(F.transform(F.split(text, r"\\\\"), _unescape_part), "\\")
    return F.when(text.contains("\\"), whole).otherwise(text)


def _unescape_part(out: Column) -> Column:
    """A text without doubled backslashes; ``\\u`` forms are decoded one by one."""
    for letter, char in ESCAPES.items():
        out = F.replace(out, F.lit("\\" + letter), F.lit(char))
    pieces = F.split(out, r"\\(?=u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8})")
    code = lambda x, n: F.decode(F.unhex(F.lpad(F.substring(x, 2, n), 8, "0")), "UTF-32")
    decoded = F.transform(
        pieces, lambda x, i: F.when((i > 0) & x.rlike("^u[0-9A-Fa-f]{4}"), F.concat(code(x, 4), x.substr(F.lit(6), F.length(x)))).when((i > 0) & x.rlike("^U[0-9A-Fa-f]{8}"), F.concat(code(x, 8), x.substr(F.lit(10), F.length(x)))).otherwise(x)
    )
    return F.array_join(decoded, "")


def parse_lines(lines: DataFrame, graph: Column) -> tuple[DataFrame, DataFrame]:
    """Triples and rejects of a table with ``value`` (one line); blank lines and comments are neither."""
    rows = lines.where(~F.col("value").rlike(r"^\s*(#.*)?$"))
    # A line is matched once to be tested and once for all its parts, which are empty where they are not there.
    good = rows.where(F.col("value").rlike(LINE)).select(graph.alias("_graph"), F.split(F.regexp_replace("value", _PARTED, _PARTS), "\n", 10).alias("_parts"))
    s_iri, s_bnode, p, o_iri, o_bnode, quote, datatype, lang, own, text = (F.get("_parts", F.lit(i)) for i in range(10))
    literal = quote != ""
    triples = good.select(
        F.coalesce(F.nullif(own, F.lit("")), "_graph").alias("graph"),
        F.concat(s_iri, s_bnode).alias("s"),
        F.when(s_bnode != "", "bnode").otherwise("iri").alias("s_kind"),
        p.alias("p"),
        F.when(literal, unescape(text)).otherwise(F.concat(o_iri, o_bnode)).alias("o"),
        F.when(literal, "literal").when(o_bnode != "", "bnode").otherwise("iri").alias("o_kind"),
        F.when((datatype != "") & (datatype != XSD + "string"), datatype).alias("o_datatype"),
        F.nullif(lang, F.lit("")).alias("o_lang"),
    )
    return triples, rows.where(~F.col("value").rlike(LINE))


def read_ntriples(spark: SparkSession, path: str, graph: str) -> tuple[DataFrame, DataFrame]:
    return parse_lines(spark.read.text(path), F.lit(graph))


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for letter in ("n", "r", "t", '"'):
        out = F.replace(out, F.lit(ESCAPES[letter]), F.lit("\\" + letter))
    return out


def ntriples_lines(triples: DataFrame) -> DataFrame:
    """``line`` of every triple."""
    node = lambda value, kind: F.when(F.col(kind) == "bnode", F.col(value)).otherwise(F.concat(F.lit("<"), F.col(value), F.lit(">")))
    tag = F.when(F.col("o_lang").isNotNull(), F.concat(F.lit("@"), "o_lang")).when(F.col("o_datatype").isNotNull() & (F.col("o_datatype") != RDF + "langString"), F.concat(F.lit("^^<"), "o_datatype", F.lit(">"))).otherwise("")
    literal = F.concat(F.lit('"'), escape(F.col("o")), F.lit('"'), tag)
    value = F.when(F.col("o_kind") == "literal", literal).otherwise(node("o", "o_kind"))
    return triples.select("graph", F.concat_ws(" ", node("s", "s_kind"), F.concat(F.lit("<"), "p", F.lit(">")), value, F.lit(".")).alias("line"))


def write_ntriples(triples: DataFrame, path: str) -> None:
    ntriples_lines(triples).select("line").write.text(path)


#: File extensions and their RDF formats (fixed values).
FORMATS = {"ttl": "turtle", "turtle": "turtle", "rdf": "xml", "rdfs": "xml", "owl": "xml", "xml": "xml", "nt": "nt", "n3": "n3", "jsonld": "json-ld", "json": "json-ld", "trig": "trig", "nq": "nquads", "nquads": "nquads"}


def detect_format(path: Column, hint: Column | None = None) -> Column:
    """The format that a path's extension names; an explicit hint wins; unknown is null."""
    table = F.create_map(*[F.lit(x) for pair in FORMATS.items() for x in pair])
    found = table[F.lower(F.regexp_extract(F.regexp_extract(path, r"^([^?#]*)", 1), r"\.([A-Za-z0-9]+)$", 1))]
    return found if hint is None else F.coalesce(hint, found)
