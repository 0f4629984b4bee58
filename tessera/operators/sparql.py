"""A SPARQL subset over mapped tables, compiled to DataFrames.

Supported: SELECT [DISTINCT] with variables, aggregates (COUNT, SUM, AVG, MIN, MAX, GROUP_CONCAT, DISTINCT inside)
and expressions AS names; ASK; basic graph patterns with `a`; FILTER; OPTIONAL; UNION; VALUES; BIND; GROUP BY;
HAVING; ORDER BY; LIMIT; OFFSET. Patterns on one subject read one table once; an object property is an equality
join on the referenced table's key. Everything is a logical plan: Catalyst prunes, pushes down and orders joins.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources import tables

_TOKEN = re.compile(r"""\s+|(?P<str>"(?:[^"\\]|\\.)*")|(?P<var>\?\w+)|(?P<num>\d+(?:\.\d+)?)|(?P<name>[A-Za-z_][\w]*(?::[\w]+)?|:[\w]+)|(?P<op>\^\^|&&|\|\||<=|>=|!=|[{}().;,*/+\-=<>!])""")


class Unsupported(ValueError):
    """The query is outside the subset or names what the mapping lacks."""


@dataclass(frozen=True)
class ClassMap:
    """A table as a class: its key columns, its properties by name, its references (property -> class)."""

    table: str
    key: tuple[str, ...]
    properties: dict[str, str]
    references: dict[str, tuple[str, str]] = field(default_factory=dict)


def mapping() -> dict[str, ClassMap]:
    """The sample schema's classes: a property is the column's name without its prefix."""
    columns = {
        "region": ("r_name",),
        "nation": ("n_name",),
        "customer": ("c_name", "c_acctbal", "c_mktsegment"),
        "supplier": ("s_name", "s_acctbal"),
        "part": ("p_name", "p_brand", "p_type", "p_size", "p_retailprice"),
        "orders": ("o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"),
        "lineitem": ("l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"),
    }
    out = {}
    for table, names in columns.items():
        refs = {rt: (c, rt.capitalize()) for t, c, rt, _ in tables.FOREIGN_KEYS if t == table}
        out[table.capitalize()] = ClassMap(table, tables.PRIMARY_KEYS[table], {n.split("_", 1)[1]: n for n in names}, refs)
    return out


class Parser:
    def __init__(self, text: str):
        text = re.sub(r"(?im)^\s*PREFIX\s+\w*:\s*<[^>]*>", "", text)
        self.tokens, at = [], 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise Unsupported(f"can't read {text[at : at + 20]!r}")
            if m.lastgroup:
                self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.i = 0

    def peek(self, *words: str) -> bool:
        return self.i < len(self.tokens) and self.tokens[self.i][0] != "str" and self.tokens[self.i][1].upper() in words

    def take(self, *words: str) -> bool:
        if self.peek(*words):
            self.i += 1
            return True
        return False

    def need(self, word: str) -> None:
        if not self.take(word):
            raise Unsupported(f"{word} expected at {self.tokens[self.i : self.i + 3]}")

    def next(self) -> tuple[str, str]:
        if self.i >= len(self.tokens):
            raise Unsupported("the query ends too early")
        self.i += 1
        return self.tokens[self.i - 1]

    def query(self) -> dict:
        q = {"ask": False, "distinct": False, "select": [], "group": [], "having": None, "order": [], "limit": None, "offset": 0}
        if self.take("ASK"):
            q["ask"] = True
        else:
            self.need("SELECT")
            q["distinct"] = self.take("DISTINCT", "REDUCED")
            if self.take("*"):
                q["select"] = None
            else:
                while not self.peek("WHERE", "{"):
                    if self.take("("):
                        e = self.expression()
                        self.need("AS")
                        q["select"].append((self.next()[1][1:], e))
                        self.need(")")
                    else:
                        v = self.next()[1][1:]
                        q["select"].append((v, ("var", v)))
        self.take("WHERE")
        q["where"] = self.group()
        while self.i < len(self.tokens):
            if self.take("GROUP"):
                self.need("BY")
                while self.i < len(self.tokens) and self.tokens[self.i][0] == "var":
                    q["group"].append(self.next()[1][1:])
            elif self.take("HAVING"):
                q["having"] = self.expression()
            elif self.take("ORDER"):
                self.need("BY")
                while self.i < len(self.tokens) and not self.peek("LIMIT", "OFFSET"):
                    down = self.take("DESC")
                    down = down or (self.take("ASC") and False)
                    q["order"].append((self.expression(), down))
            elif self.take("LIMIT"):
                q["limit"] = int(self.next()[1])
            elif self.take("OFFSET"):
                q["offset"] = int(self.next()[1])
            else:
                raise Unsupported(f"unexpected {self.next()[1]}")
        return q

    def group(self) -> list:
        self.need("{")
        out: list = []
        while not self.take("}"):
            if self.peek("{"):
                parts = [self.group()]
                while self.take("UNION"):
                    parts.append(self.group())
                out.append(("union", parts))
            elif self.take("OPTIONAL"):
                out.append(("optional", self.group()))
            elif self.take("FILTER"):
                out.append(("filter", self.expression()))
            elif self.take("BIND"):
                self.need("(")
                e = self.expression()
                self.need("AS")
                out.append(("bind", self.next()[1][1:], e))
                self.need(")")
            elif self.take("VALUES"):
                v = self.next()[1][1:]
                self.need("{")
                values = []
                while not self.take("}"):
                    values.append(self.literal())
                out.append(("values", v, values))
            else:
                subject = self.next()[1]
                while True:
                    predicate = self.next()[1]
                    kind, value = self.tokens[self.i]
                    obj = ("var", self.next()[1][1:]) if kind == "var" else ("name", self.next()[1]) if kind == "name" else ("lit", self.literal())
                    out.append(("triple", subject[1:], predicate, obj))
                    if not self.take(";"):
                        break
                    if self.peek(".", "}"):
                        break
            self.take(".")
        return out

    def literal(self):
        kind, value = self.next()
        if kind == "str":
            if self.take("^^"):
                self.next()
            return value[1:-1].replace('\\"', '"').replace("\\\\", "\\")
        if kind == "num":
            return float(value) if "." in value else int(value)
        raise Unsupported(f"a literal is expected, not {value}")

    _LEVELS = (("||",), ("&&",), ("=", "!=", "<", ">", "<=", ">="), ("+", "-"), ("*", "/"))

    def expression(self, level: int = 0):
        if level == len(self._LEVELS):
            return self.unary()
        left = self.expression(level + 1)
        while self.peek(*self._LEVELS[level]):
            op = self.next()[1]
            left = ("op", op, left, self.expression(level + 1))
        return left

    def unary(self):
        if self.take("!"):
            return ("not", self.unary())
        if self.take("-"):
            return ("op", "-", ("lit", 0), self.unary())
        if self.take("("):
            e = self.expression()
            self.need(")")
            return e
        kind, value = self.tokens[self.i] if self.i < len(self.tokens) else ("", "")
        if kind == "var":
            self.i += 1
            return ("var", value[1:])
        if kind in ("str", "num"):
            return ("lit", self.literal())
        name = self.next()[1]
        self.need("(")
        distinct = self.take("DISTINCT")
        args, separator = [], ","
        if not self.take(")"):
            if self.take("*"):
                args.append(("lit", 1))
            else:
                args.append(self.expression())
            while self.take(",", ";"):
                if self.take("SEPARATOR"):
                    self.need("=")
                    separator = self.literal()
                else:
                    args.append(self.expression())
            self.need(")")
        return ("call", name.upper(), args, distinct, separator)


AGGREGATES = {"COUNT", "SUM", "AVG", "MIN", "MAX", "GROUP_CONCAT", "SAMPLE"}


class Compiler:
    def __init__(self, spark: SparkSession, sf_dir: str, classes: dict[str, ClassMap] | None = None):
        self.spark, self.sf_dir, self.classes = spark, sf_dir, classes or mapping()

    def run(self, text: str) -> DataFrame:
        """The answers, one column a variable; an ASK has one row with the column `answer`."""
        q = Parser(text).query()
        df = self._group(q["where"])
        if q["ask"]:
            return df.limit(1).agg((F.count("*") > 0).alias("answer"))
        chosen = q["select"] if q["select"] is not None else [(c, ("var", c)) for c in df.columns if not c.startswith("_")]
        if q["group"] or any(self._aggregate(e) for _, e in chosen):
            keys = [self._visible(df, v) for v in q["group"]]
            aggs = [(n, e) for n, e in chosen if self._aggregate(e)]
            for n, e in chosen:
                if not self._aggregate(e) and not (e[0] == "var" and e[1] in q["group"]):
                    raise Unsupported(f"?{n} is neither grouped nor aggregated")
            having = [("_having", q["having"])] if q["having"] is not None else []
            out = df.groupBy(*[k.alias(v) for k, v in zip(keys, q["group"], strict=True)]).agg(*[self._expr(df, e).alias(n) for n, e in aggs + having])
            if having:
                out = out.filter("_having")
            df = out
        else:
            for n, e in chosen:
                if e == ("var", n):
                    self._visible(df, n)
            df = df.select("*", *[self._expr(df, e).alias(n) for n, e in chosen if e != ("var", n)])
        if q["distinct"]:  # DISTINCT holds for the projected rows
            df = df.select(*[n for n, _ in chosen]).distinct()
        if q["order"]:
            df = df.orderBy(*[F.desc(c) if d else c for c, d in ((self._expr(df, e), d) for e, d in q["order"])])
        if q["offset"]:
            df = df.offset(q["offset"])
        if q["limit"] is not None:
            df = df.limit(q["limit"])
        return df.select(*[n for n, _ in chosen])

    def _group(self, parts: list) -> DataFrame:
        triples = [p[1:] for p in parts if p[0] == "triple"]
        df = self._patterns(triples) if triples else None
        for p in parts:
            if p[0] == "union":
                u = None
                for g in p[1]:
                    d = self._group(g)
                    u = d if u is None else u.unionByName(d, allowMissingColumns=True)
                df = u if df is None else self._join(df, u, "inner")
            elif p[0] == "values":
                v = F.broadcast(self.spark.createDataFrame([(x,) for x in p[2]], [p[1]]))
                df = v if df is None else self._join(df, v, "inner")
            elif p[0] == "optional":
                df = self._join(df, self._group(p[1]), "left")
            elif p[0] == "bind":
                df = df.withColumn(p[1], self._expr(df, p[2]))
        if df is None:
            raise Unsupported("an empty pattern")
        for p in parts:
            if p[0] == "filter":
                df = df.filter(self._expr(df, p[1]))
        return df

    @staticmethod
    def _join(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
        shared = [c for c in a.columns if c in b.columns]
        if not shared:
            raise Unsupported("patterns without a shared variable")
        return a.join(b, shared, how)

    def _patterns(self, triples: list) -> DataFrame:
        """Each subject is one scan of its table; object properties join subjects."""
        kind, by = {}, {}
        for s, p, o in triples:
            by.setdefault(s, []).append((p, o))
            if p in ("a", "rdf:type"):
                kind[s] = o[1].split(":")[-1]
        names = lambda p: p.split(":")[-1]
        changed = True
        while changed:  # a subject's class may follow from a reference to it or from its properties
            changed = False
            for s, ps in by.items():
                if s in kind:
                    for p, o in ps:
                        ref = self.classes[self._known(kind[s])].references.get(names(p))
                        if ref and o[0] == "var" and o[1] not in kind and o[1] in by:
                            kind[o[1]] = ref[1]
                            changed = True
                else:
                    wanted = {names(p) for p, _ in ps}
                    fit = [c for c, m in self.classes.items() if wanted <= {*m.properties, *m.references}]
                    if len(fit) == 1:
                        kind[s] = fit[0]
                        changed = True
        out = None
        for s, ps in by.items():
            if s not in kind:
                raise Unsupported(f"the class of ?{s} is not known")
            m = self.classes[self._known(kind[s])]
            df = tables.read(self.spark, self.sf_dir, m.table)
            columns = [(F.struct(*m.key) if len(m.key) > 1 else F.col(m.key[0])).alias(s)]
            where = F.lit(True)
            for p, o in ps:
                if p in ("a", "rdf:type"):
                    continue
                if names(p) in m.references:
                    c = F.col(m.references[names(p)][0])
                elif names(p) in m.properties:
                    c = F.col(m.properties[names(p)])
                else:
                    raise Unsupported(f"{p} is no property of {kind[s]}")
                where = where & c.isNotNull()
                if o[0] == "var":
                    columns.append(c.alias(o[1]))
                else:
                    where = where & (c == F.lit(o[1]))
            df = df.filter(where).select(*columns)
            out = df if out is None else (out, df)
            if isinstance(out, tuple):
                out = self._join(out[0], out[1], "inner")
        return out

    def _known(self, name: str) -> str:
        if name not in self.classes:
            raise Unsupported(f"class {name} is not mapped")
        return name

    @staticmethod
    def _visible(df: DataFrame, v: str) -> Column:
        if v not in df.columns:
            raise Unsupported(f"?{v} is not bound")
        return F.col(v)

    def _aggregate(self, e) -> bool:
        if e[0] == "call":
            return e[1] in AGGREGATES or any(map(self._aggregate, e[2]))
        return any(self._aggregate(x) for x in e[1:] if isinstance(x, tuple))

    def _expr(self, df: DataFrame, e) -> Column:
        if e[0] == "var":
            return self._visible(df, e[1])
        if e[0] == "lit":
            return F.lit(e[1])
        if e[0] == "not":
            return ~self._expr(df, e[1])
        if e[0] == "op":
            a, b = self._expr(df, e[2]), self._expr(df, e[3])
            return {"||": lambda: a | b, "&&": lambda: a & b, "=": lambda: a == b, "!=": lambda: a != b, "<": lambda: a < b, ">": lambda: a > b, "<=": lambda: a <= b, ">=": lambda: a >= b, "+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))}[e[1]]()
        _, name, raw, distinct, separator = e
        if name == "BOUND":
            return self._visible(df, raw[0][1]).isNotNull()
        args = [self._expr(df, a) for a in raw]
        if name == "COUNT":
            return F.count_distinct(args[0]) if distinct else F.count(args[0])
        if name == "GROUP_CONCAT":
            c = args[0].cast("string")
            return F.array_join(F.array_sort(F.collect_set(c) if distinct else F.collect_list(c)), separator)
        simple = {"SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max, "SAMPLE": F.min, "LCASE": F.lower, "UCASE": F.upper, "STRLEN": F.length, "ABS": F.abs, "YEAR": F.year, "MONTH": F.month, "DAY": F.day}
        if name in simple:
            return simple[name](args[0])
        if name == "STR":
            return args[0].cast("string")
        if name == "CONTAINS":
            return args[0].cast("string").contains(args[1])
        if name == "STRSTARTS":
            return args[0].cast("string").startswith(args[1])
        if name == "STRENDS":
            return args[0].cast("string").endswith(args[1])
        if name == "IF":
            return F.when(args[0], args[1]).otherwise(args[2])
        if name == "COALESCE":
            return F.coalesce(*args)
        if name == "REPLACE":
            return F.regexp_replace(args[0], args[1], args[2])
        if name == "SUBSTR":
            return F.substring(args[0], args[1], args[2] if len(args) > 2 else F.length(args[0]))
        if name == "CONCAT":
            return F.concat(*[a.cast("string") for a in args])
        if name == "REGEX":
            return F.rlike(args[0], args[1])
        if name in ("XSD:DECIMAL", "XSD:DOUBLE"):
            return args[0].cast("decimal(38,10)" if name == "XSD:DECIMAL" else "double")
        if name == "XSD:INTEGER":
            return args[0].cast("long")
        raise Unsupported(f"function {name}")
