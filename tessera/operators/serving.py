"""Which source answers: names in statements, routing to catalogs, metric index, tiers of answers, policy.

Relations are found by Spark's own parser together with their place in the text, so names in literals, comments and
aliases are never touched, and a common table expression hides a table only where it is in scope.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import fuzzy
from tessera.operators import metrics
from tessera.operators.sqlgate import Rejected, _expressions, _kinds, _seq, parse

# --- names in statements ---------------------------------------------------


@dataclass(frozen=True)
class Named:
    """A table in a statement: its name's parts, and where they stand (start, end)."""

    parts: tuple[str, ...]
    start: int
    end: int


def relations(spark: SparkSession, sql: str) -> list[Named]:
    """Tables that a statement reads, in the order of the text; names of its common table expressions left out."""
    found: list[Named] = []

    def visit(node, own: frozenset[str]) -> None:
        kind = node.getClass().getSimpleName()
        if kind == "UnresolvedWith":
            for pair in _seq(node.cteRelations()):
                visit(pair._2(), own)
                own = own | {pair._1().lower()}
        elif kind == "UnresolvedRelation":
            parts = tuple(_seq(node.multipartIdentifier()))
            if len(parts) > 1 or parts[0].lower() not in own:
                o = node.origin()
                found.append(Named(parts, o.startIndex().get(), o.stopIndex().get() + 1))
        children = _seq(node.children())
        for child in children:
            visit(child, own)
        for e in (x for top in _seq(node.expressions()) for x in _expressions(top)):
            if "PlanExpression" in _kinds(e):
                visit(e.plan(), own)

    visit(parse(spark, sql), frozenset())
    return sorted(set(found), key=lambda r: r.start)


def catalogs(spark: SparkSession, sql: str) -> tuple[set[str], bool]:
    """Catalog prefixes (of names with three parts) in a statement, and whether it has any other table."""
    names = relations(spark, sql)
    return {r.parts[0].lower() for r in names if len(r.parts) > 2}, any(len(r.parts) < 3 for r in names)


def renamed(spark: SparkSession, sql: str, name: Callable[[tuple[str, ...]], str | None]) -> str:
    """The statement with each table's name replaced by what name(parts) gives; None leaves it."""
    out, at = "", 0
    for r in relations(spark, sql):
        new = name(r.parts)
        if new is not None:
            out, at = out + sql[at : r.start] + new, r.end
    return out + sql[at:]


def qualified(spark: SparkSession, sql: str, prefix: Iterable[str]) -> str:
    """Bare tables put into a catalog's database; names with a database or more stay."""
    path = ".".join(f"`{p}`" for p in prefix)
    return renamed(spark, sql, lambda parts: f"{path}.`{parts[0]}`" if len(parts) == 1 else None)


def unprefixed(name: str, prefixes: Iterable[str]) -> str:
    """The table behind a name that a federation has made: <SOURCE>_<SCHEMA>_<TABLE> as table, small; else the name."""
    for p in sorted(prefixes, key=len, reverse=True):
        if name.lower().startswith(p.lower() + "_") and len(name) > len(p) + 1:
            return name[len(p) + 1 :].lower()
    return name


# --- sources ---------------------------------------------------------------


class Federation:
    """Sources by name, each with its tables; a statement over one or several of them runs in one plan.

    Every table is a temporary view named <source>__<table>, and names are replaced before the statement runs: source.
    table and catalog.source.table, a bare name where only one source has it, and <SOURCE>_<SCHEMA>_<table>.
    """

    def __init__(self, spark: SparkSession, sources: dict[str, dict[str, DataFrame]], schema: str = "public"):
        self.spark, self.schema = spark, schema
        self.sources = {s.lower(): {t.lower(): df for t, df in tables.items()} for s, tables in sources.items()}
        for s, tables in self.sources.items():
            for t, df in tables.items():
                df.createOrReplaceTempView(f"{s}__{t}")

    def owner(self, parts: tuple[str, ...]) -> tuple[str, str] | None:
        """(source, table) of a name; None if no source, or more than one, has it."""
        low = [p.lower() for p in parts]
        if len(low) > 1:
            return (low[-2], low[-1]) if low[-1] in self.sources.get(low[-2], {}) else None
        found = [(s, low[0]) for s, tables in self.sources.items() if low[0] in tables]
        found += [(s, t) for s, tables in self.sources.items() if (t := unprefixed(low[0], [f"{s}_{self.schema}"])) != low[0] and t in tables]
        return found[0] if len(found) == 1 else None

    def used(self, sql: str) -> set[str]:
        """Sources that a statement reads: one can be asked directly, several make a federated plan."""
        return {self._known(r.parts)[0] for r in relations(self.spark, sql)}

    def _known(self, parts: tuple[str, ...]) -> tuple[str, str]:
        owner = self.owner(parts)
        if owner is None:
            raise Rejected(f"{'.'.join(parts)} is in no source, or in several")
        return owner

    def sql(self, statement: str, max_rows: int | None = None) -> DataFrame:
        text = renamed(self.spark, statement, lambda parts: "`{}__{}`".format(*self._known(parts)))
        rows = self.spark.sql(text)
        return rows if max_rows is None else rows.limit(max_rows)


def decoded(rows: DataFrame, cells: str, columns: list[tuple[str, str]]) -> DataFrame:
    """Cells (an array of struct(is_null, text, whole, real, truth), one filled each) as typed columns."""
    value = lambda c: F.coalesce(c["text"], c["whole"].cast("string"), c["real"].cast("string"), c["truth"].cast("string"))
    picked = [(F.get(F.col(cells), F.lit(i)), name, kind) for i, (name, kind) in enumerate(columns)]
    return rows.select(*[F.when(~F.coalesce(c["is_null"], F.lit(False)), value(c)).try_cast(kind).alias(name) for c, name, kind in picked])


def routed(tables: DataFrame, mapping: DataFrame) -> DataFrame:
    """tables(table_name) with the source that mapping(table_name, source) names, ignoring case and any prefix; '' if none."""
    bare = lambda c: F.lower(F.element_at(F.split(c, r"\."), -1))
    m = mapping.groupBy(bare("table_name").alias("_t")).agg(F.max("source").alias("source"))
    return tables.withColumn("_t", bare("table_name")).join(m, "_t", "left").select(*tables.columns, F.coalesce("source", F.lit("")).alias("source"))


def class_sources(mapping: DataFrame, order: str) -> DataFrame:
    """(class, source): the last source that isn't empty, in order; a class with none is still mapped, to ''."""
    filled = F.when(F.coalesce("source", F.lit("")) != "", F.struct(F.col(order).alias("o"), F.col("source").alias("source")))
    return mapping.groupBy("class").agg(F.max(filled).alias("m")).select("class", F.coalesce("m.source", F.lit("")).alias("source"))


# What a function or type is called elsewhere.
SPELLINGS = {
    "spark": {"strpos": "instr", "now": "current_timestamp", "text": "string", "varchar": "string", "bytea": "binary", "timestamptz": "timestamp"},
    "trino": {"instr": "strpos", "string": "varchar", "text": "varchar", "bytea": "varbinary", "timestamptz": "timestamp with time zone"},
    "postgresql": {"instr": "strpos", "string": "text", "binary": "bytea"},
    "sqlserver": {"length": "len", "now": "getdate", "string": "nvarchar(max)", "text": "nvarchar(max)", "substr": "substring"},
}
_PIECE = re.compile(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`|--[^\n]*|/\*.*?\*/|[A-Za-z_]\w*|\s+|.", re.S)


def transpiled(sql: str, to: str) -> str:
    """The statement in another engine's spelling: functions before (, types behind :: and AS; quotes; unknown engines leave it.

    `x::type` becomes a CAST where the engine has no such form.
    """
    table = SPELLINGS.get(to.lower())
    if table is None:
        return sql
    pieces = _PIECE.findall(sql)
    out: list[str] = []
    for i, piece in enumerate(pieces):
        after = next((p for p in pieces[i + 1 :] if not p.isspace()), "")
        before = next((p for p in reversed(out) if not p.isspace()), "")
        if piece.lower() in table and (after == "(" or before.lower() == "as" or before == ":"):
            piece = table[piece.lower()]
        elif piece.startswith('"') and to.lower() == "spark":
            piece = "`" + piece[1:-1].replace('""', '"') + "`"
        out.append(piece)
    text = "".join(out)
    return text if to.lower() in ("postgresql", "spark") else re.sub(r"([\w.]+|\([^()]*\))::(\w+(?: with time zone)?(?:\([^)]*\))?)", r"CAST(\1 AS \2)", text)


def literals(sql: str) -> list[str]:
    return [p[1:-1].replace("''", "'") for p in _PIECE.findall(sql) if p.startswith("'")]


def literal_from(sql: str, question: str) -> bool:
    """Whether any text literal of the statement stands in the question, ignoring case."""
    low = question.lower()
    return any(x.strip() and x.strip().lower() in low for x in literals(sql))


# --- metrics ---------------------------------------------------------------


class MetricIndex:
    """Metrics by name, synonym and namespace, looked up in questions: exactly first, nearly where nothing is exact.

    metrics(metric, namespace, sql, synonyms array). The labels are written out once; rebuilt when asked to.
    """

    def __init__(self, load: Callable[[], DataFrame], least: float = 0.88):
        self.load, self.least = load, least
        self.rebuild()

    def rebuild(self) -> None:
        m = self.load()
        name = m.select("metric", "namespace", F.col("metric").alias("label"), F.lit(True).alias("is_name"))
        other = m.select("metric", "namespace", F.explode("synonyms").alias("label"), F.lit(False).alias("is_name"))
        self.labels, self.metrics = name.unionByName(other).filter("label <> ''"), m

    def visible(self, namespace: str) -> DataFrame:
        low = F.lower("namespace")
        return self.labels if namespace == "" else self.labels.filter((low == namespace.lower()) | (low == ""))

    def match(self, questions: DataFrame, namespace: str = "") -> DataFrame:
        """(qid, metric, how, score): exact hits score 1 (a name) or 0.95 (a synonym); the best near one else."""
        exact = metrics.match_metrics(questions, self.labels, namespace)
        exact = exact.select("qid", "metric", F.lit("exact").alias("how"), F.when(F.col("by_name") == 1, 1.0).otherwise(0.95).alias("score"))
        rest = questions.join(exact.select("qid").distinct(), "qid", "left_anti")
        labels = self.visible(namespace).select("metric", F.translate(F.lower("label"), "_", " ").alias("label"))
        near = fuzzy.fuzzy_matches(rest, labels, self.least)
        best = near.groupBy("qid").agg(F.max(F.struct("score", F.col("metric"))).alias("b")).select("qid", "b.metric", F.lit("fuzzy").alias("how"), "b.score")
        return exact.unionByName(best)


# --- tiers -----------------------------------------------------------------


@dataclass(frozen=True)
class Gating:
    """Which tiers may answer, by the kinds of sources there are."""

    metric: bool = True
    structured: bool = True
    knowledge: bool = True

    @staticmethod
    def of(kinds: Iterable[str] | None) -> Gating:
        """Without databases no metric and no structured answer, without documents no knowledge; unknown kinds gate nothing."""
        if kinds is None:
            return Gating()
        low = {k.lower() for k in kinds}
        data, text = low & {"database", "jdbc", "catalog", "structured"}, low & {"document", "documents", "unstructured"}
        if not data and not text:
            return Gating()
        return Gating(bool(data), bool(data), bool(text))


@dataclass
class Outcome:
    tier: str | None
    answer: object
    trace: list[dict] = field(default_factory=list)


def resolve(question: str, tiers: list[tuple[str, Callable[[str], object | None]]], gating: Gating | None = None, pinned: str | None = None) -> Outcome:
    """Asks the tiers in order (metric, structured, knowledge) until one answers; what fails or is gated is traced and passed over."""
    trace = []
    for name, ask in tiers:
        if pinned is not None and name != pinned:
            continue
        if gating is not None and not getattr(gating, name, True):
            trace.append({"tier": name, "status": "skipped"})
            continue
        try:
            answer = ask(question)
        except Exception as e:  # noqa: BLE001  the next tier may still answer
            trace.append({"tier": name, "status": "failed", "reason": type(e).__name__})
            continue
        trace.append({"tier": name, "status": "miss" if answer is None else "answered"})
        if answer is not None:
            return Outcome(name, answer, trace)
    return Outcome(None, None, trace)


# --- policy ----------------------------------------------------------------


@dataclass(frozen=True)
class Grant:
    role: str
    action: str
    namespace: str  # * is any
    effect: str = "permit"


class Policy:
    """Decides an action on a namespace by the caller's roles: a forbid beats any permit, and nothing said is no."""

    def __init__(self, grants: Iterable[Grant]):
        self.grants = tuple(grants)

    def allows(self, roles: Iterable[str], action: str, namespace: str) -> bool:
        own = {r.lower() for r in roles}
        said = [g.effect for g in self.grants if g.role.lower() in own and g.action in (action, "*") and g.namespace.lower() in (namespace.lower(), "*")]
        return "permit" in said and "forbid" not in said

    def check(self, roles: Iterable[str], action: str, namespace: str) -> None:
        try:
            ok = self.allows(roles, action, namespace)
        except Exception as e:
            raise Rejected("the policy can't be evaluated") from e
        if not ok:
            raise Rejected(f"{action} on {namespace} is not permitted")
