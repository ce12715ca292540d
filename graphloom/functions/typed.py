"""RDF terms as one comparable value.

A term is a struct of kind (``iri``, ``bnode``, ``literal``), text, datatype and language, none of them null: a literal without
a datatype is a string, or a language string if it is tagged; tags compare without case; other kinds have neither.  Two terms are
the same exactly if their structs are equal, so an IRI never meets a literal of the same text, nor ``"1"^^xsd:integer`` the
string ``"1"``.  A null struct is an unbound variable.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.terms import default_datatype
from graphloom.functions.vocab import NUMERIC, RDF, XSD

TERM = "struct<kind:string,text:string,datatype:string,lang:string>"
LANG_STRING = RDF + "langString"
TEMPORAL = (XSD + "date", XSD + "dateTime")


@dataclass(frozen=True)
class Term:
    """A constant term; see ``iri``, ``bnode`` and ``literal``."""

    kind: str
    text: str
    datatype: str = ""
    lang: str = ""

    @property
    def column(self) -> Column:
        return F.struct(*[F.lit(getattr(self, f)).alias(f) for f in ("kind", "text", "datatype", "lang")])


def iri(text: str) -> Term:
    return Term("iri", text)


def bnode(text: str) -> Term:
    return Term("bnode", text)


def literal(text: str, datatype: str | None = None, lang: str | None = None) -> Term:
    return Term("literal", text, datatype or (LANG_STRING if lang else XSD + "string"), (lang or "").lower())


def iri_term(column: Column) -> Column:
    """An IRI column as a term."""
    none = F.lit("")
    return F.when(column.isNotNull(), F.struct(F.lit("iri").alias("kind"), column.alias("text"), none.alias("datatype"), none.alias("lang")))


def subject_term() -> Column:
    none = F.lit("")
    return F.struct(F.col("s_kind").alias("kind"), F.col("s").alias("text"), none.alias("datatype"), none.alias("lang"))


def object_term() -> Column:
    is_literal = F.col("o_kind") == "literal"
    datatype = F.when(is_literal, default_datatype(F.col("o_datatype"), F.col("o_lang"))).otherwise("")
    lang = F.when(is_literal, F.lower(F.coalesce("o_lang", F.lit("")))).otherwise("")
    return F.struct(F.col("o_kind").alias("kind"), F.col("o").alias("text"), datatype.alias("datatype"), lang.alias("lang"))


def is_term(frame: DataFrame, column: str) -> bool:
    return frame.schema[column].dataType.simpleString() == TERM


def order_keys(term: Column, *, descending: bool = False) -> list[Column]:
    """Sort keys of the order of terms: unbound, blank nodes, IRIs, then literals.

    Literals go numbers, booleans, dates and times, strings, tagged strings, others; numbers, booleans and times by value, the
    rest by text, tag and datatype.  A literal that cannot be read as its datatype is one of the others.  The last keys tell
    any two terms apart, so the order is total.
    """
    text, datatype = term["text"], term["datatype"]
    rank = F.when(term.isNull(), 0).when(term["kind"] == "bnode", 1).when(term["kind"] == "iri", 2).otherwise(3)
    number = F.when(datatype.isin(*NUMERIC), text.try_cast("double"))
    exact = F.when(datatype.isin(*NUMERIC), text.try_cast("decimal(38,10)"))
    truth = F.when(datatype == XSD + "boolean", text.try_cast("boolean"))
    day = F.regexp_replace(text, r"(Z|[-+]\d\d:\d\d)$", "")
    moment = F.when(datatype == XSD + "date", day.try_cast("date").try_cast("timestamp")).when(datatype == XSD + "dateTime", text.try_cast("timestamp"))
    group = F.when(number.isNotNull(), 0).when(truth.isNotNull(), 1).when(moment.isNotNull(), 2).when(datatype == XSD + "string", 3).when(datatype == LANG_STRING, 4).otherwise(5)
    keys = [rank, F.when(rank == 3, group), number, exact, truth, moment, text, term["lang"], datatype]
    return [k.desc_nulls_last() if descending else k.asc_nulls_first() for k in keys]
