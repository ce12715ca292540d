"""Column functions on RDF terms, and per-entity labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.vocab import KINDS, LABELS, RDF, TYPE_KINDS, XSD


def local_name(iri: Column) -> Column:
    """The part after the last ``#``, else ``/``, else ``:``; closing separators are cut off first."""
    trimmed = F.regexp_replace(iri, "[#/]+$", "")
    found = iri
    for sep in (":", "/", "#"):
        tail = F.substring_index(trimmed, sep, -1)
        found = F.when(iri.contains(sep) & (tail != ""), tail).otherwise(found)
    return found


def local_name_js(iri: Column) -> Column:
    """The run without ``#``, ``/`` and ``:`` at the end, else the whole."""
    tail = F.regexp_extract(iri, "[^#/:]+$", 0)
    return F.when(tail != "", tail).otherwise(iri)


def is_literal_type(iri: Column) -> Column:
    return iri.startswith(XSD) | (iri == RDF + "langString")


def default_datatype(datatype: Column, lang: Column) -> Column:
    return F.coalesce(datatype, F.when(lang.isNotNull(), RDF + "langString").otherwise(XSD + "string"))


def _choice(values: dict[str, str | int], of: Column) -> Column:
    """A lookup of a fixed table inside the row."""
    table = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return table[of]


def kind_of_type(iri: Column) -> Column:
    return _choice(TYPE_KINDS, iri)


def kind_rank(kind: Column) -> Column:
    return _choice({k: i for i, k in enumerate(KINDS)}, kind)


def kind_named(rank: Column) -> Column:
    return F.coalesce(F.get(F.array(*map(F.lit, KINDS)), rank), F.lit("other"))


def best_kind(kind: Column) -> Column:
    """Aggregate: the most specific kind of a group."""
    return kind_named(F.min(kind_rank(kind)))


def pick_label(triples: DataFrame) -> DataFrame:
    """graph, s, label: the first label predicate with a literal decides; there English or untagged goes first.

    Ties go to the smallest text.  Subjects without a literal label have no row: see ``label_or_name``.
    """
    rank = _choice({p: i for i, p in enumerate(LABELS)}, F.col("p"))
    foreign = F.col("o_lang").isNotNull() & (F.col("o_lang") != "en")
    rows = triples.where(F.col("p").isin(*LABELS) & (F.col("o_kind") == "literal"))
    return rows.groupBy("graph", "s").agg(F.min(F.struct(rank.alias("r"), foreign.alias("f"), "o")).alias("best")).select("graph", "s", F.col("best.o").alias("label"))


def label_or_name(frame: DataFrame, labels: DataFrame, iri: str, name: str = "label") -> DataFrame:
    """``frame`` with the label of its ``iri`` column, else the local name."""
    found = labels.select("graph", F.col("s").alias(iri), F.col("label").alias("_label"))
    return frame.join(found, ["graph", iri], "left").withColumn(name, F.coalesce("_label", local_name(F.col(iri)))).drop("_label")


def first_literal(triples: DataFrame, predicates: Sequence[str]) -> DataFrame:
    """graph, s, text: English or untagged in any predicate goes before foreign, then predicate order, then text."""
    rank = _choice({p: i for i, p in enumerate(predicates)}, F.col("p"))
    foreign = F.col("o_lang").isNotNull() & (F.col("o_lang") != "en")
    rows = triples.where(F.col("p").isin(*predicates) & (F.col("o_kind") == "literal"))
    return rows.groupBy("graph", "s").agg(F.min(F.struct(foreign.alias("f"), rank.alias("r"), "o")).alias("best")).select("graph", "s", F.col("best.o").alias("text"))


def prefixed(frame: DataFrame, prefixes: DataFrame, iri: str, name: str = "prefixed") -> DataFrame:
    """``frame`` with ``prefix:local``; the empty prefix gives the bare local name, no prefix the whole IRI."""
    split = F.regexp_extract(F.col(iri), r"^(.*[#/])([^#/]*)$", 1)
    known = prefixes.groupBy("graph", F.col("namespace").alias("_ns")).agg(F.min("prefix").alias("_prefix"))
    local = F.expr(f"substr({iri}, length(_ns) + 1)")
    short = F.when(F.col("_prefix").isNull() | (local == ""), F.col(iri)).when(F.col("_prefix") == "", local).otherwise(F.concat_ws(":", "_prefix", local))
    return frame.withColumn("_ns", split).join(known, ["graph", "_ns"], "left").withColumn(name, short).drop("_ns", "_prefix")


def shorten(frame: DataFrame, prefixes: DataFrame, iri: str, name: str = "short") -> DataFrame:
    """Like ``prefixed`` by the longest namespace that starts the IRI, if the rest is a plain name; else ``<iri>``.

    An IRI is cut to each length that a namespace of its graph has, and met by equality.
    """
    known = prefixes.select("graph", "namespace", "prefix").distinct()
    lengths = known.groupBy("graph").agg(F.collect_set(F.length("namespace")).alias("_lengths"))  # at most the longest namespace
    iris = frame.select("graph", F.col(iri).alias("_iri")).distinct().join(lengths, "graph")
    heads = iris.select("graph", "_iri", F.explode(F.filter("_lengths", lambda n: n <= F.length("_iri"))).alias("_n")).withColumn("namespace", F.col("_iri").substr(F.lit(1), F.col("_n")))
    matches = heads.join(known, ["graph", "namespace"])
    best = matches.groupBy("graph", F.col("_iri").alias(iri)).agg(F.max_by(F.struct("prefix", F.expr("substr(_iri, _n + 1)").alias("rest")), F.struct("_n", "prefix")).alias("m"))
    plain = F.col("m.rest").rlike("^[A-Za-z_][A-Za-z0-9_-]*$")
    short = F.when(plain, F.concat("m.prefix", F.lit(":"), "m.rest")).otherwise(F.concat(F.lit("<"), F.col(iri), F.lit(">")))
    return frame.join(best, ["graph", iri], "left").withColumn(name, short).drop("m")


def edge_key(kind: Column, label: Column, source: Column, target: Column) -> Column:
    return F.concat_ws("|", kind, label, source, target)


def anchor(iri: Column) -> Column:
    """``term-`` slug of the local name ``-`` first eight hex digits of the IRI's SHA-1."""
    slug = F.regexp_replace(F.regexp_replace(local_name(iri), "[^A-Za-z0-9_-]", "-"), "^-+|-+$", "")
    return F.concat(F.lit("term-"), F.when(slug == "", "term").otherwise(slug), F.lit("-"), F.substring(F.sha1(iri), 1, 8))


def slug_filename(name: Column) -> Column:
    """A safe file stem: a known RDF extension goes, runs of other characters become one dash."""
    stem = F.trim(F.regexp_replace(name, r"(?i)\.(ttl|turtle|rdf|rdfs|owl|xml|nt|n3|jsonld|json|trig|nq|nquads)$", ""))
    safe = F.regexp_replace(F.regexp_replace(stem, r"[^A-Za-z0-9._-]+", "-"), r"^[-. ]+|[-. ]+$", "")
    return F.when(safe == "", "ontology").otherwise(safe)


def neutralize_formula(text: Column) -> Column:
    """A leading apostrophe before what a spreadsheet would compute."""
    return F.when(text.rlike("^[=+\\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)


def csv_quote(text: Column) -> Column:
    safe = neutralize_formula(text)
    return F.when(safe.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(safe)


def url_normalize(url: Column) -> Column:
    """The raw-content address of a code host's file page; other addresses stay."""
    return F.regexp_replace(url, r"^https?://github\.com/([^/]+)/([^/]+)/(?:blob|raw)/(.+)$", "https://raw.githubusercontent.com/$1/$2/$3")


def url_host(url: Column) -> Column:
    """The host of an http(s) address, lower-cased; else null."""
    host = F.lower(F.regexp_extract(url, r"(?i)^https?://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", host)


#: Hosts of the public code host (fixed values).
PUBLIC_CODE_HOSTS = ("github.com", "www.github.com", "raw.githubusercontent.com", "gist.github.com", "gist.githubusercontent.com", "objects.githubusercontent.com", "media.githubusercontent.com", "codeload.github.com")


def self_hosted_code(host: Column) -> Column:
    """A host named after the code host that is none of its public ones."""
    public = host.isin(*PUBLIC_CODE_HOSTS) | host.endswith(".github.io") | host.endswith(".githubusercontent.com")
    return F.coalesce(host.contains("github") & ~public, F.lit(False))
