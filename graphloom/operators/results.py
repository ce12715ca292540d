"""Result tables: term structs, row caps, sorting, paging, and CSV and JSON text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.terms import csv_quote, label_or_name, prefixed
from graphloom.plans.tables import written


def row_cap(frame: DataFrame, cap: int = 1_000) -> tuple[DataFrame, bool]:
    """At most ``cap`` rows and whether more exist; one row beyond the cap is looked for, no more."""
    truncated = frame.limit(cap + 1).count() > cap
    return frame.limit(cap), truncated


def enrich(frame: DataFrame, labels: DataFrame, prefixes: DataFrame, columns: list[str]) -> DataFrame:
    """Each IRI column as a struct of type, value, label and prefixed form; null stays null."""
    out = frame
    for c in columns:
        out = prefixed(label_or_name(out, labels, c, f"_l_{c}"), prefixes, c, f"_p_{c}")
    structs = [F.when(F.col(c).isNotNull(), F.struct(F.lit("uri").alias("type"), F.col(c).alias("value"), F.col(f"_l_{c}").alias("label"), F.col(f"_p_{c}").alias("prefixed"))).alias(c) for c in columns]
    return out.select(*[x for x in frame.columns if x not in columns], *structs)


def term_struct(kind: Column, value: Column, lang: Column, datatype: Column, label: Column | None = None, short: Column | None = None) -> Column:
    """A term as type, value, lang, datatype, label and prefixed form; only an IRI has the last two."""
    name = F.when(kind == "iri", "uri").when(kind == "bnode", "bnode").otherwise("literal")
    only_iri = lambda c: F.when(kind == "iri", F.lit(None).cast("string") if c is None else c)
    return F.struct(name.alias("type"), value.alias("value"), lang.alias("lang"), datatype.alias("datatype"), only_iri(label).alias("label"), only_iri(short).alias("prefixed"))


def sort_keys(term: Column, label: Column) -> list[Column]:
    """Numbers by value before text by lower case; unbound is the empty text."""
    number = term["value"].try_cast("double")
    text = F.when(term["type"] == "uri", F.lower(F.coalesce(label, term["value"]))).otherwise(F.lower(F.coalesce(term["value"], F.lit(""))))
    is_number = (term["type"] == "literal") & number.isNotNull()
    return [F.when(is_number, number).asc_nulls_last(), text.asc()]


def with_places(frame: DataFrame, *order: Column | str) -> DataFrame:
    """``frame`` with ``place`` (from 1) in the order of the whole table.

    Rows are dealt by ranges of the order and numbered inside each; the ranges' row counts, one small row each, give the
    numbers that come before.  Equal rows share a range.
    """
    ranged = written(frame.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = dict(ranged.groupBy("_part").count().collect())
    before, total = [], 0
    for part in range(max(sizes, default=-1) + 1):
        before.append(total)
        total += sizes.get(part, 0)
    earlier = F.get(F.array(*[F.lit(n).cast("long") for n in before]), F.col("_part")) if before else F.lit(0)
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.withColumn("place", (earlier + inside).cast("long")).drop("_part")


def places_within(frame: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """``frame`` with ``place`` (from 1) in the order of each group (``keys``, not null), however large a group is.

    Rows are dealt by ranges of keys and order and numbered inside each.  A group that goes on in a later range starts there
    with the rows it had before; such entries are fewer than the ranges.
    """
    ranged = written(frame.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("_part", *keys).agg(F.count(F.lit(1)).alias("_n"))
    earlier = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    before = counts.withColumn("_before", earlier).where("_before is not null").drop("_n")
    inside = F.row_number().over(Window.partitionBy("_part", *keys).orderBy(*order))
    out = ranged.withColumn("_inside", inside).join(F.broadcast(before), ["_part", *keys], "left")  # fewer rows than partitions
    return out.select(*frame.columns, (F.col("_inside") + F.coalesce("_before", F.lit(0))).cast("long").alias("place"))


def page(frame: DataFrame, order: list, number: int, size: int = 15) -> DataFrame:
    """One page after sorting; a page past the end is the last one."""
    pages = max(1, -(-frame.count() // size))
    at = min(max(number, 0), pages - 1)
    return frame.orderBy(*order).offset(at * size).limit(size)


def csv_field(term: Column) -> Column:
    """An IRI in full, a blank node with ``_:``, a literal's text, nothing for unbound; quoted as CSV wants."""
    raw = F.when(term.isNull(), "").when(term["type"] == "bnode", F.concat(F.lit("_:"), term["value"])).otherwise(term["value"])
    return csv_quote(F.coalesce(raw, F.lit("")))


def csv_lines(frame: DataFrame, columns: list[str]) -> DataFrame:
    """One ``line`` per row, fields in order."""
    return frame.select(*[c for c in frame.columns if c not in columns], F.concat_ws(",", *[csv_field(F.col(c)) for c in columns]).alias("line"))


def csv_header(columns: list[str]) -> str:
    quoted = [f'"{c}"' if any(x in c for x in '",\r\n') else c for c in columns]
    return ",".join(quoted)


def export_csv(frame: DataFrame, columns: list[str], path: str) -> None:
    """Part files of lines ended by CRLF; the header is a file of its own (``header``), written once per job."""
    frame = csv_lines(frame, columns).select("line")
    frame.write.option("lineSep", "\r\n").text(f"{path}/rows")
    frame.sparkSession.createDataFrame([(csv_header(columns),)], "line string").coalesce(1).write.option("lineSep", "\r\n").text(f"{path}/header")


def json_lines(frame: DataFrame, columns: list[str]) -> DataFrame:
    """One result binding per row; unbound variables are left out, so are null language and datatype."""

    def entry(c: str) -> Column:
        t = F.col(c)
        literal = t["type"] == "literal"
        datatype = F.when(literal & t["lang"].isNull(), t["datatype"])
        return F.when(t.isNotNull(), F.struct(t["type"].alias("type"), t["value"].alias("value"), F.when(literal, t["lang"]).alias("xml:lang"), datatype.alias("datatype"))).alias(c)

    return frame.select(*[c for c in frame.columns if c not in columns], F.to_json(F.struct(*map(entry, columns))).alias("line"))


def export_json(frame: DataFrame, columns: list[str], path: str) -> None:
    json_lines(frame, columns).select("line").write.text(path)


def preview_rows(frame: DataFrame, triples: int, rows: int = 5, most: int = 50_000) -> DataFrame:
    """A small preview, only where the graph has at most ``most`` triples."""
    return frame.limit(rows if triples <= most else 0)
