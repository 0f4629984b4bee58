"""Column functions on names, labels and types: normal forms, cases, local names, literal and column types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# SQL type names and their XSD names.
XSD = {
    "INT": "integer", "BIGINT": "long", "SMALLINT": "short", "TINYINT": "byte", "FLOAT": "float", "DOUBLE": "double", "DECIMAL": "decimal", "NUMERIC": "decimal", "VARCHAR": "string", "TEXT": "string",
    "CHAR": "string", "STRING": "string", "BOOLEAN": "boolean", "DATE": "date", "TIMESTAMP": "dateTime", "DATETIME": "dateTime", "TIME": "time", "BINARY": "hexBinary", "BLOB": "hexBinary", "UUID": "string",
}
# What Spark calls some of them.
SPARK_XSD = {"TIMESTAMP_NTZ": "dateTime", "INTEGER": "integer", "LONG": "long", "SHORT": "short", "BYTE": "byte", "REAL": "float", "BOOL": "boolean"}
# Families of column types.
FAMILIES = {
    "int": ("int", "integer", "bigint", "smallint", "tinyint", "serial", "bigserial"),
    "float": ("float", "double", "double precision", "real"),
    "decimal": ("decimal", "numeric", "money"),
    "string": ("varchar", "character varying", "char", "character", "text", "string", "uuid"),
    "bool": ("boolean", "bool"),
    "date": ("date",),
    "timestamp": ("timestamp", "timestamp without time zone", "timestamp with time zone", "datetime"),
    "time": ("time", "time without time zone"),
}
# What Spark calls some of them.
SPARK_FAMILIES = {"timestamp_ntz": "timestamp", "timestamp_ltz": "timestamp"}
# Words that make a text column a number by its name.
NUMERIC_WORDS = (
    "amount", "total", "sum", "count", "price", "cost", "revenue", "profit", "salary", "income", "balance", "budget", "spent", "remaining", "quantity", "rate", "ratio", "percentage", "pct", "score", "rating",
    "weight", "height", "width", "length", "size", "age", "duration", "distance", "consumption", "lat", "lng", "longitude", "latitude", "altitude", "elevation",
)
# The names of XSD's built-in types, and what is called otherwise elsewhere.
XSD_NAMES = (
    "string", "boolean", "decimal", "float", "double", "duration", "dateTime", "time", "date", "gYearMonth", "gYear", "gMonthDay", "gDay", "gMonth", "hexBinary", "base64Binary", "anyURI", "QName", "NOTATION",
    "normalizedString", "token", "language", "Name", "NCName", "NMTOKEN", "NMTOKENS", "ENTITY", "ENTITIES", "ID", "IDREF", "IDREFS",
    "integer", "nonNegativeInteger", "nonPositiveInteger", "positiveInteger", "negativeInteger", "long", "int", "short", "byte", "unsignedLong", "unsignedInt", "unsignedShort", "unsignedByte",
    "dateTimeStamp", "dayTimeDuration", "yearMonthDuration",
)
XSD_ALIASES = {
    "datetime": "dateTime", "timestamp": "dateTime", "timestamptz": "dateTime", "timestamp_with_timezone": "dateTime", "varchar": "string", "char": "string", "text": "string", "nvarchar": "string", "clob": "string",
    "bool": "boolean", "number": "decimal", "numeric": "decimal", "bigint": "long", "smallint": "short", "tinyint": "byte", "real": "double", "uuid": "string", "blob": "hexBinary", "binary": "hexBinary",
}
#: The texts that a type allows; of whole numbers also the range.
_LEXICAL = {
    "boolean": "^(true|false|0|1)$", "decimal": r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)$", "integer": "^[+-]?[0-9]+$", "double": r"^([+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?|[+-]?INF|NaN)$",
    "dateTime": r"^-?[0-9]{4,}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])T([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](\.[0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})?$", "hexBinary": "^([0-9a-fA-F]{2})*$",
}
_RANGES = {"long": 63, "int": 31, "short": 15, "byte": 7}


def _lookup(key: Column, table: dict[str, str], default: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key), default)


def normal_predicate(c: Column) -> Column:
    """Lower case, spaces as _, nothing but [a-z0-9_], runs of _ as one, none at the ends."""
    c = F.regexp_replace(F.lower(F.trim(c)), r"\s+", "_")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[^a-z0-9_]", ""), "_+", "_"), "^_|_$", "")


def normal_edge(c: Column) -> Column:
    return F.translate(F.lower(c), " -", "__")


def camel_spaced(c: Column) -> Column:
    """A space before each capital after a small letter, and before the last capital of a run that a word follows."""
    return F.regexp_replace(F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z])([A-Z][a-z])", "$1 $2")


def _words(c: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(c, r"[^a-zA-Z0-9\s_-]", ""), r"[\s_-]+"), lambda w: w != "")


def _capital(w: Column) -> Column:
    return F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w))))


def pascal_case(c: Column) -> Column:
    name = F.array_join(F.transform(_words(c), _capital), "")
    return F.when(name == "", F.lit("Entity")).otherwise(name)


def camel_case(c: Column) -> Column:
    p = pascal_case(c)
    return F.concat(F.lower(F.substring(p, 1, 1)), F.substring(p, F.lit(2), F.length(p)))


def local_name(iri: Column) -> Column:
    """What follows the last # or /."""
    return F.regexp_extract(iri, r"([^#/]*)$", 1)


def iri_segment(c: Column) -> Column:
    """ASCII names as an IRI segment: white space as -, others percent-encoded, hyphens collapsed and trimmed."""
    encoded = F.replace(F.url_encode(F.regexp_replace(F.trim(c), r"\s+", "-")), F.lit("*"), F.lit("%2A"))
    return F.regexp_replace(F.regexp_replace(encoded, "-+", "-"), "^-|-$", "")


def literal_type(c: Column) -> Column:
    """XSD type that a text looks like, tried in the order boolean, integer, decimal, dateTime, date, string."""
    t = F.trim(c)
    return (
        F.when(F.lower(t).isin("true", "false"), "boolean")
        .when(t.rlike(r"^[+-]?[0-9]+$"), "integer")
        .when(t.rlike(r"^[+-]?[0-9]*\.[0-9]+$"), "decimal")
        .when(t.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}(:[0-9]{2})?"), "dateTime")
        .when(t.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), "date")
        .otherwise("string")
    )


def xsd_type(sql_type: Column) -> Column:
    """XSD name of a SQL type, its length left out; string if it isn't known."""
    return _lookup(F.upper(F.trim(F.split_part(sql_type, F.lit("("), F.lit(1)))), XSD | SPARK_XSD, F.lit("string"))


def xsd_type_named(sql_type: Column, name: Column) -> Column:
    """As xsd_type, but a text column whose name says a number is decimal: the word, or the word behind or before a _."""
    words = "|".join(NUMERIC_WORDS)
    numeric = F.lower(F.trim(name)).rlike(f"^(({words})|.*_({words})|({words})_.*)$")
    kind = xsd_type(sql_type)
    return F.when((kind == "string") & numeric, "decimal").otherwise(kind)


def type_family(sql_type: Column) -> Column:
    """Family of a type's spellings; a type of no family is its own, none at all is `unknown`."""
    table = {name: family for family, names in FAMILIES.items() for name in names} | SPARK_FAMILIES
    base = F.lower(F.trim(F.split_part(F.coalesce(sql_type, F.lit("")), F.lit("("), F.lit(1))))
    return F.when(base == "", "unknown").otherwise(_lookup(base, table, base))


def canonical_xsd(token: Column, text: Column) -> Column:
    """The token's usual name (another case, or an alias) if the text is valid for it; else the token as it is."""
    usual = {n.lower(): n for n in XSD_NAMES}
    name = F.when(token.isin(*XSD_NAMES), token).otherwise(_lookup(F.lower(token), XSD_ALIASES | usual, F.lit(None).cast("string")))
    valid = F.lit(True)
    for kind, pattern in _LEXICAL.items():
        valid = F.when(name == kind, text.rlike(pattern)).otherwise(valid)
    for kind, bits in _RANGES.items():
        whole = F.try_to_number(text, F.lit("S9999999999999999999")).cast("decimal(20,0)")
        valid = F.when(name == kind, F.coalesce(text.rlike(_LEXICAL["integer"]) & whole.between(-(2**bits), 2**bits - 1), F.lit(False))).otherwise(valid)
    return F.when(name.isNotNull() & valid, name).otherwise(token)


def query_terms(text: Column, stop_words, most: int) -> Column:
    """Up to `most` lower-case terms of more than two letters that are no stop words; duplicates are kept."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9][a-z0-9-]*)"), F.lit(1))
    return F.slice(F.filter(tokens, lambda t: (F.length(t) > 2) & ~t.isin(*stop_words)), 1, most)


def datamarked(c: Column, marker: str = "^") -> Column:
    return F.regexp_replace(c, r"\s+", marker)


def score_tier(score: Column, reranked: Column, threshold: float = 0.8) -> Column:
    """Grounding tier of a score; null is novel."""
    by_rank = F.when(score >= 0.85, "exact").when(score >= 0.65, "high_confidence").when(score >= 0.4, "ambiguous").otherwise("novel")
    by_cosine = F.when(score >= 0.95, "exact").when(score >= threshold, "high_confidence").when(score >= 0.5, "ambiguous").otherwise("novel")
    return F.when(score.isNull(), "novel").when(reranked, by_rank).otherwise(by_cosine)


def score_band(score: Column) -> Column:
    return F.when(score >= 0.95, "exact").when(score >= 0.8, "close_match").otherwise("novel")


def fused_score(lexical: Column, structural: Column, weight: float) -> Column:
    """A missing structural score counts as zero, not as absent."""
    return (1 - weight) * lexical + weight * F.coalesce(structural, F.lit(0.0))


def iri_key(c: Column) -> Column:
    """What an IRI segment is looked up by: the segment, ignoring case."""
    return F.lower(iri_segment(c))


def _rebuilt(kind: T.DataType, c: Column, leaf) -> Column:
    """A value with leaf(kind, column) in the place of each of its scalars."""
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[_rebuilt(f.dataType, c[f.name], leaf).alias(f.name) for f in kind.fields]))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _rebuilt(kind.elementType, x, leaf))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda _, v: _rebuilt(kind.valueType, v, leaf))
    return leaf(kind, c)


def json_safe(kind: T.DataType, c: Column) -> Column:
    """A value as JSON text; decimals, dates and timestamps in it are texts, so nothing is rounded."""
    return F.to_json(_rebuilt(kind, c, lambda k, x: x.cast("string") if isinstance(k, T.DecimalType | T.DateType | T.TimestampType | T.TimestampNTZType) else x))


def without_floats(df: DataFrame, decimal: str) -> DataFrame:
    """df with every float and double, nested ones too, as a decimal."""
    leaf = lambda k, x: x.cast(decimal) if isinstance(k, T.FloatType | T.DoubleType) else x
    return df.select(*[_rebuilt(f.dataType, F.col(f.name), leaf).alias(f.name) for f in df.schema.fields])
