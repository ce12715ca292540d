"""Graph patterns as DataFrame joins.

``QueryState`` is a tree of typed steps joined by links; ``run_pattern`` composes the joins.  ``Frame`` offers the algebra of
solution tables: a table whose columns are variables, null meaning unbound.  Values are terms with their kind, so an IRI
never joins a literal of the same text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.typed import TERM, Term, iri, iri_term, is_term, object_term, order_keys, subject_term
from graphloom.functions.vocab import NUMERIC, TYPE, XSD
from graphloom.operators.closure import path_closure, path_zero_or_one


@dataclass(frozen=True)
class Filter:
    op: str
    value: str


@dataclass(frozen=True)
class Prop:
    predicate: str
    label: str
    datatype: str | None = None
    optional: bool = True
    filter: Filter | None = None


@dataclass(frozen=True)
class Link:
    anchor: int
    predicates: tuple[tuple[str, bool], ...]  # (predicate, inverse)
    modifier: str = ""  # "", "?", "*", "+"
    optional: bool = False


@dataclass(frozen=True)
class Step:
    cls: str | None
    label: str
    props: tuple[Prop, ...] = ()
    link: Link | None = None
    pin: tuple[str, ...] = ()


@dataclass(frozen=True)
class QueryState:
    steps: tuple[Step, ...]
    limit: int | None = 100  # None: all rows, in no order
    paths_mode: bool = False
    distinct: bool = False
    aggregate: str = "none"


COMPARE = {"=": "__eq__", "!=": "__ne__", ">": "__gt__", ">=": "__ge__", "<": "__lt__", "<=": "__le__"}


def number(text: str) -> Decimal | float | None:
    """What a form field's text means as a number: decimal, exponent, hexadecimal, octal, binary or infinite; else None."""
    text = text.strip()
    if re.fullmatch(r"[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?", text):
        return Decimal(text)
    if re.fullmatch(r"0(x[0-9a-f]+|o[0-7]+|b[01]+)", text, re.IGNORECASE):
        return Decimal(int(text, 0))
    return float(text) if re.fullmatch(r"[-+]?Infinity", text) else None


def filter_condition(f: Filter, datatype: str | None, value: Column, lang: Column) -> Column:
    """Keeps a row whose value passes; a value that cannot be read as the type never does.

    A number compares exactly, as decimals of ten places, where it fits them, else as a double.
    """
    if f.op == "contains":
        return F.lower(value).contains(f.value.lower())
    if f.op == "startsWith":
        return F.lower(value).startswith(f.value.lower())
    if f.op == "lang":
        return F.coalesce(lang, F.lit("")) == f.value
    compare = lambda a, b: F.coalesce(getattr(a, COMPARE[f.op])(b), F.lit(False))
    wanted = number(f.value) if datatype in NUMERIC else None
    if wanted is not None:
        exact = isinstance(wanted, Decimal) and abs(wanted) < 10**28 and wanted == round(wanted, 10)
        return compare(value.try_cast("decimal(38,10)"), F.lit(str(wanted)).cast("decimal(38,10)")) if exact else compare(value.try_cast("double"), F.lit(float(wanted)))
    if datatype == XSD + "boolean":
        return compare(value.try_cast("boolean"), F.lit(f.value.strip().lower() == "true"))
    if datatype == XSD + "date":
        return compare(F.regexp_replace(value, r"(Z|[-+]\d\d:\d\d)$", "").try_cast("date"), F.lit(f.value).try_cast("date"))
    if datatype == XSD + "dateTime":
        return compare(value.try_cast("timestamp"), F.lit(f.value).try_cast("timestamp"))
    return compare(value, F.lit(f.value))


def var_names(labels: list[str]) -> list[str]:
    """Distinct column names: the label as a word, numbered where it repeats."""
    out: list[str] = []
    for label in labels:
        words = re.findall(r"[A-Za-z0-9]+", label)
        base = (words[0].lower() + "".join(w.capitalize() for w in words[1:])) if words else "x"
        base = f"v{base}" if base[0].isdigit() else base
        name, n = base, 2
        while name in out:
            name, n = f"{base}{n}", n + 1
        out.append(name)
    return out


def step_type(triples: DataFrame, cls: str, name: str = "s") -> DataFrame:
    """Asserted instances of a class, as terms."""
    return triples.where((F.col("p") == TYPE) & (F.col("o") == cls) & (F.col("o_kind") == "iri")).select("graph", subject_term().alias(name)).distinct()


def hop_pairs(triples: DataFrame, predicates: tuple[tuple[str, bool], ...]) -> DataFrame:
    """graph, a, b (terms) of one hop; alternatives are a bag, ``inverse`` swaps the ends."""
    parts = []
    for predicate, inverse in predicates:
        ends = ("b", "a") if inverse else ("a", "b")
        parts.append(triples.where(F.col("p") == predicate).select("graph", subject_term().alias(ends[0]), object_term().alias(ends[1])).select("graph", "a", "b"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def link_pairs(triples: DataFrame, link: Link, anchors: DataFrame) -> DataFrame:
    """graph, a, b of a link with its modifier; repeated paths start only from ``anchors`` (graph, start)."""
    pairs = hop_pairs(triples, link.predicates)
    if link.modifier in ("+", "*"):
        return path_closure(pairs, anchors, reflexive=link.modifier == "*").select("graph", F.col("start").alias("a"), F.col("node").alias("b"))
    if link.modifier == "?":
        return path_zero_or_one(pairs, anchors).select("graph", F.col("start").alias("a"), F.col("node").alias("b"))
    return pairs


def _with_props(triples: DataFrame, frame: DataFrame, step: Step, name: str, columns: list[str]) -> DataFrame:
    for prop, column in zip(step.props, columns, strict=True):
        active = prop.filter if prop.filter and prop.filter.value.strip() else None  # a blank filter is none
        rows = triples.where(F.col("p") == prop.predicate)
        if active:
            rows = rows.where(filter_condition(active, prop.datatype, F.col("o"), F.col("o_lang")))
        rows = rows.select("graph", subject_term().alias(name), object_term().alias(column))
        frame = frame.join(rows, ["graph", name], "left" if prop.optional and not active else "inner")
    return frame


def run_pattern(triples: DataFrame, state: QueryState, *, terms: bool = False) -> DataFrame:
    """The solutions of a query: graph and one column per emitted step and property; or graph and counts.

    Values are joined, made distinct and counted as terms; the columns are their texts, or with ``terms`` the terms.
    A step whose anchor does not exist is ignored, with all that hangs on it.
    """
    steps = state.steps
    if not steps:
        raise ValueError("a query needs a step")
    alive = {0}
    for i, s in enumerate(steps[1:], 1):
        if s.link and s.link.anchor in alive and s.link.anchor < i:
            alive.add(i)
    order = sorted(alive)
    names = dict(zip(order, var_names([steps[i].label for i in order]), strict=True))
    labels = [(i, p) for i in order for p in range(len(steps[i].props))]
    taken = var_names([*(steps[i].label for i in order), *(f"{steps[i].label} {steps[i].props[p].label}" for i, p in labels)])
    prop_names = dict(zip(labels, taken[len(order) :], strict=True))
    children = {i: [j for j in order if steps[j].link and steps[j].link.anchor == i and j != 0] for i in order}

    def bare(i: int) -> bool:
        """A step that paths mode folds into its only continuation."""
        s = steps[i]
        only = children[i]
        return state.paths_mode and i != 0 and not s.props and not s.pin and len(only) == 1 and not s.link.optional and not steps[only[0]].link.optional

    emitted = [i for i in order if not bare(i)]

    def own(i: int, frame: DataFrame | None) -> DataFrame:
        """The step's own conditions: type, pin, properties."""
        s, name = steps[i], names[i]
        if s.cls and not bare(i):
            typed = step_type(triples, s.cls, name)
            frame = typed if frame is None else frame.join(typed, ["graph", name], "left_semi")
        elif frame is None:
            frame = triples.select("graph", subject_term().alias(name)).distinct()
        if s.pin:
            frame = frame.where((F.col(name)["kind"] == "iri") & F.col(name)["text"].isin(*s.pin))
        return _with_props(triples, frame, s, name, [prop_names[i, p] for p in range(len(s.props))])

    def grow(i: int, frame: DataFrame) -> DataFrame:
        """Join everything that hangs on step ``i``."""
        for j in children[i]:
            link = steps[j].link
            anchors = frame.select("graph", F.col(names[i]).alias("start")).distinct()
            pairs = link_pairs(triples, link, anchors).select("graph", F.col("a").alias(names[i]), F.col("b").alias(names[j]))
            branch = grow(j, own(j, pairs))
            frame = frame.join(branch, ["graph", names[i]], "left" if link.optional else "inner")
        return frame

    def first(out: DataFrame, *order: str | Column) -> DataFrame:
        out = out if state.limit is None else out.orderBy(*order).limit(state.limit)
        return out if terms else texts(out)

    frame = grow(0, own(0, None))
    shown = [names[i] for i in emitted]
    if state.aggregate == "count":
        last = names[emitted[-1]]
        if len(emitted) > 1:
            out = frame.where(F.col(last).isNotNull() | F.lit(True)).groupBy("graph", names[emitted[0]]).agg(F.countDistinct(last).alias("count"))
            return first(out, F.desc("count"), "graph", names[emitted[0]])
        return first(frame.groupBy("graph").agg(F.countDistinct(last).alias("count")), "graph")
    columns = [c for i in emitted for c in (names[i], *(prop_names[i, p] for p in range(len(steps[i].props))))]
    out = frame.select("graph", *columns)
    out = out.distinct() if state.distinct else out
    return first(out, "graph", *columns)  # any rows would do; ordered ones are the same each time


def texts(frame: DataFrame) -> DataFrame:
    """``frame`` with the texts of its terms."""
    return frame.select(*[F.col(c)["text"].alias(c) if is_term(frame, c) else F.col(c) for c in frame.columns])


#: Rows of the smaller side of a product.
MAX_PRODUCT = 10_000


@dataclass(frozen=True)
class Frame:
    """A solution table: ``data`` has the graph and one column per variable; ``nullable`` lists variables that may be unbound.

    Variables hold terms (see ``functions.typed``), so joins compare kind, text, datatype and language; ``text`` gives a
    variable's text for conditions.  ``bind`` may add plain values.  Patterns are matched inside one graph: every join also
    joins on the graph, and solutions keep theirs.
    """

    data: DataFrame
    nullable: frozenset[str] = field(default_factory=frozenset)

    @property
    def vars(self) -> list[str]:
        return [c for c in self.data.columns if c != "graph"]

    @staticmethod
    def text(name: str) -> Column:
        return F.col(name)["text"]

    def texts(self) -> DataFrame:
        """graph and the text of every variable."""
        return texts(self.data)

    def flat(self) -> DataFrame:
        """graph and for every variable its text, and its kind, datatype and language in columns named after it."""
        parts = []
        for v in self.vars:
            parts += [F.col(v)[f].alias(n) for f, n in (("text", v), ("kind", f"{v}_kind"), ("datatype", f"{v}_datatype"), ("lang", f"{v}_lang"))] if is_term(self.data, v) else [F.col(v)]
        return self.data.select("graph", *parts)

    @staticmethod
    def match(triples: DataFrame, s: str | Term, p: str | Term, o: str | Term) -> Frame:
        """A triple pattern; ``?x`` is a variable, other strings are IRIs, ``Term`` any constant; a repeated variable must be equal."""
        rows, chosen = triples, {}
        for column, part in (("s", s), ("p", p), ("o", o)):
            variable = isinstance(part, str) and part.startswith("?")
            term = part if isinstance(part, Term) else iri(part)
            if not variable and column == "p":
                rows = rows.where((F.col("p") == term.text) & F.lit(term.kind == "iri"))
            elif not variable and term.kind != "literal":
                rows = rows.where((F.col(column) == term.text) & (F.col(f"{column}_kind") == term.kind))
            elif not variable:
                rows = rows.where((object_term() == term.column) & (F.col("o") == term.text) if column == "o" else F.lit(False))
            elif part[1:] in chosen:
                rows = rows.where(_POSITIONS[column]() == chosen[part[1:]])
            else:
                chosen[part[1:]] = _POSITIONS[column]()
        if "graph" in chosen:
            raise ValueError("the variable ?graph is taken by the graph itself; see graph_")
        return Frame(rows.select("graph", *[c.alias(v) for v, c in chosen.items()]))

    def graph_(self, term: str) -> Frame:
        """Only solutions in the named graph, or with ``?g`` the graph's name as a variable."""
        if not term.startswith("?"):
            return Frame(self.data.where(F.col("graph") == term), self.nullable)
        name = iri_term(F.col("graph"))
        if term[1:] in self.vars:
            return Frame(self.data.where(F.col(term[1:]) == name), self.nullable - {term[1:]})
        return Frame(self.data.withColumn(term[1:], name), self.nullable)

    def _shared(self, other: Frame) -> list[str]:
        """The join columns: the graph and the common variables, none of which may be unbound."""
        shared = [v for v in self.vars if v in other.vars]
        unbound = set(shared) & (self.nullable | other.nullable)
        if unbound:
            raise ValueError(f"joining on variables that may be unbound: {sorted(unbound)}")
        return ["graph", *shared]

    def and_(self, other: Frame) -> Frame:
        """Solutions of both that agree.

        Without a common variable every solution of a graph meets every other of that graph; the smaller table, of at most
        ``MAX_PRODUCT`` rows, goes to the tasks of the larger one.  Raises if both have more.
        """
        keys, nullable = self._shared(other), self.nullable | other.nullable
        if len(keys) > 1:
            return Frame(self.data.join(other.data, keys), nullable)
        for small, large in ((other, self), (self, other)):
            if small.data.limit(MAX_PRODUCT + 1).count() <= MAX_PRODUCT:
                both = large.data.join(F.broadcast(small.data), "graph")  # size checked above
                return Frame(both.select("graph", *self.vars, *other.vars), nullable)
        raise ValueError(f"patterns without a common variable, both of over {MAX_PRODUCT} solutions, would multiply")

    def optional(self, other: Frame) -> Frame:
        """Solutions, with those of ``other`` that agree where there are any; there must be a common variable."""
        shared = self._shared(other)
        if len(shared) == 1:
            raise ValueError("an optional part without a common variable would multiply")
        return Frame(self.data.join(other.data, shared, "left"), self.nullable | other.nullable | (set(other.vars) - set(shared)))

    def union(self, other: Frame) -> Frame:
        missing = set(self.vars) ^ set(other.vars)
        return Frame(self.data.unionByName(other.data, allowMissingColumns=True), self.nullable | other.nullable | missing)

    def exists(self, other: Frame) -> Frame:
        """Solutions that agree with one of ``other``; without a common variable, those whose graph has any."""
        return Frame(self.data.join(other.data, self._shared(other), "left_semi"), self.nullable)

    def not_exists(self, other: Frame) -> Frame:
        return Frame(self.data.join(other.data, self._shared(other), "left_anti"), self.nullable)

    def minus(self, other: Frame) -> Frame:
        """Without solutions compatible with the other's; nothing shared removes nothing."""
        return self.not_exists(other) if set(self.vars) & set(other.vars) else self

    def filter_(self, condition: Column) -> Frame:
        return Frame(self.data.where(condition), self.nullable)

    def bind(self, name: str, value: Column) -> Frame:
        return Frame(self.data.withColumn(name, value), self.nullable | {name})

    def values(self, names: str | list[str], rows: list) -> Frame:
        """Joined with an inline table: a row a list of terms, None where it leaves the variable open; strings are IRIs.

        Rows that fix the same variables are one table and join on those the solutions have; variables that are new take
        the row's values, or stay unbound where it leaves them open.
        """
        names = [names] if isinstance(names, str) else list(names)
        rows = [(r,) if isinstance(r, str | Term) or r is None else tuple(r) for r in rows]
        if any(len(r) != len(names) for r in rows):
            raise ValueError(f"each row needs {len(names)} values")
        known, new = [n for n in names if n in self.vars], [n for n in names if n not in self.vars]
        unbound = set(known) & self.nullable
        if unbound:
            raise ValueError(f"joining on variables that may be unbound: {sorted(unbound)}")
        term = lambda x: None if x is None else tuple(vars(iri(x) if isinstance(x, str) else x).values())
        schema = ", ".join(f"`{n}` {TERM}" for n in names)
        out = None
        for fixed in sorted({tuple(x is not None for x in r) for r in rows}, reverse=True):
            same = [r for r in rows if tuple(x is not None for x in r) == fixed]
            table = self.data.sparkSession.createDataFrame([tuple(map(term, r)) for r in same], schema).select(*[n for n, f in zip(names, fixed, strict=True) if f or n in new])
            on = [n for n in known if n in table.columns]
            part = self.data.join(table, on) if on else self.data.withColumn("_row", F.explode(F.array(*[F.struct(*[_constant(x).alias(n) for n, x in zip(names, r, strict=True)]) for r in same]))).select(*self.data.columns, *[F.col("_row")[n].alias(n) for n in new])
            part = part.select(*self.data.columns, *new)
            out = part if out is None else out.unionByName(part)
        open_ = {n for i, n in enumerate(names) if n in new and any(r[i] is None for r in rows)}
        if out is None:
            out = self.data.where(F.lit(False)).select("*", *[F.lit(None).cast(TERM).alias(n) for n in new])
        return Frame(out, self.nullable | open_)

    def project(self, *names: str) -> Frame:
        return Frame(self.data.select("graph", *names), self.nullable & set(names))

    def distinct(self) -> Frame:
        return Frame(self.data.distinct(), self.nullable)

    def order_by(self, *keys: Column | str) -> Frame:
        """Sorted by variables in the order of terms (``-x``: falling), or by any columns."""
        order: list[Column] = []
        for key in keys:
            name = key.removeprefix("-") if isinstance(key, str) else None
            if name is None:
                order.append(key)
            elif is_term(self.data, name):
                order += order_keys(F.col(name), descending=key.startswith("-"))
            else:
                order.append(F.desc_nulls_last(name) if key.startswith("-") else F.asc_nulls_first(name))
        return Frame(self.data.orderBy(*order), self.nullable)

    def slice(self, limit: int, offset: int = 0) -> Frame:
        """Rows ``offset`` to ``offset + limit`` of the whole table, over all graphs; choose one by ``graph_`` first."""
        return Frame(self.data.offset(offset).limit(limit), self.nullable)

    def group(self, by: list[str], having: Column | None = None, **aggregates: Column) -> Frame:
        """Aggregates of each group of a graph."""
        out = self.data.groupBy("graph", *by).agg(*[c.alias(n) for n, c in aggregates.items()])
        return Frame(out if having is None else out.where(having), self.nullable & set(by))


_POSITIONS = {"s": subject_term, "p": lambda: iri_term(F.col("p")), "o": object_term}


def _constant(value: str | Term | None) -> Column:
    return F.lit(None).cast(TERM) if value is None else (iri(value) if isinstance(value, str) else value).column
