"""Metric definitions as text: reading and writing YAML (or JSON, which is YAML), DDL of catalog tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

# SQL types as an embedded database names them; times keep their kind.
EMBEDDED = {"int": "INTEGER", "bigint": "INTEGER", "smallint": "INTEGER", "tinyint": "INTEGER", "double": "DOUBLE", "float": "DOUBLE", "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP", "string": "VARCHAR"}
SCHEMA = "name string, dataset string, description string, dialects array<struct<dialect:string,expression:string>>, synonyms array<string>"


def _load(text: str):
    try:
        import yaml
    except ImportError:  # without PyYAML only the JSON part of YAML is read
        return json.loads(text)
    return yaml.safe_load(text)


def parse_metrics(text: str) -> tuple[list[dict], list[str]]:
    """(metrics, errors with their paths) of a document with the keys `datasets` and `metrics`."""
    try:
        document = _load(text) or {}
    except Exception as e:  # noqa: BLE001  a broken file is an error of the file
        return [], [f"$: {e}"]
    out, errors = [], []
    if not isinstance(document, dict):
        return [], ["$: a mapping is expected"]
    datasets = {d.get("name") for d in document.get("datasets") or [] if isinstance(d, dict)}
    for i, m in enumerate(document.get("metrics") or []):
        at = f"$.metrics[{i}]"
        if not isinstance(m, dict) or not m.get("name"):
            errors.append(f"{at}.name: missing")
            continue
        expression = m.get("expression")
        dialects = expression if isinstance(expression, list) else [{"dialect": "ANSI", "expression": expression}] if expression else []
        if not dialects:
            errors.append(f"{at}.expression: missing")
            continue
        if datasets and m.get("dataset") and m["dataset"] not in datasets:
            errors.append(f"{at}.dataset: {m['dataset']} is not declared")
        out.append({"name": m["name"], "dataset": m.get("dataset"), "description": m.get("description"), "dialects": [{"dialect": str(d.get("dialect", "ANSI")).upper(), "expression": d.get("expression", "")} for d in dialects], "synonyms": list(m.get("synonyms") or [])})
    return out, errors


def metrics_frame(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame(parse_metrics(text)[0], SCHEMA)


def dump_metrics(metrics: list[dict]) -> str:
    """The document that parse_metrics reads back."""
    body = {"metrics": [{**{k: m[k] for k in ("name", "dataset", "description", "synonyms") if m.get(k)}, "expression": m["dialects"]} for m in metrics]}
    try:
        import yaml
    except ImportError:
        return json.dumps(body, indent=2)
    return yaml.safe_dump(body, sort_keys=False)


def ddl(columns: DataFrame) -> DataFrame:
    """(table_name, ddl) of discovered columns, in their order."""
    from pyspark.sql import functions as F

    kind = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in EMBEDDED.items() for x in kv]), F.col("data_type")), F.when(F.col("data_type").startswith("decimal"), F.upper("data_type")).otherwise("VARCHAR"))
    line = F.concat(F.lit('"'), F.col("column_name"), F.lit('" '), kind)
    rows = columns.groupBy("table_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", line.alias("line")))), lambda x: x["line"]), ", ").alias("body"))
    return rows.select("table_name", F.concat(F.lit('CREATE TABLE "'), "table_name", F.lit('" ('), "body", F.lit(")")).alias("ddl"))
