"""Payload schemas: registry lookups, validation of payloads, compatibility of versions."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timelog.functions import binary

MODES = ("NONE", "BACKWARD", "FORWARD", "FULL")


def latest(schemas: DataFrame) -> DataFrame:
    """The newest version of each topic; with the column descriptor (binary), if the table has it."""
    extra = [c for c in ("descriptor",) if c in schemas.columns]
    return schemas.groupBy("topic").agg(F.max_by(F.struct("version", "type", "definition", *extra), "version").alias("x")).select("topic", "x.*")


def version(schemas: DataFrame, topic: str, number: int) -> DataFrame:
    return schemas.where((F.col("topic") == topic) & (F.col("version") == number))


def listing(schemas: DataFrame) -> DataFrame:
    return schemas.groupBy("topic").agg(F.count("*").alias("versions"), F.max("version").alias("newest")).orderBy("topic")


_CHECKS = {
    "object": lambda v: isinstance(v, dict),
    "array": lambda v: isinstance(v, list),
    "string": lambda v: isinstance(v, str),
    "boolean": lambda v: isinstance(v, bool),
    "null": lambda v: v is None,
    "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool),
    "integer": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool) and float(v).is_integer(),
}


def json_fits(schema: dict | None, value, strict: bool = False) -> bool:
    """Types, properties and items, at any depth; `required` only if strict. An unknown type fits nothing."""
    if not isinstance(schema, dict):
        return True
    kind = schema.get("type")
    if isinstance(kind, str) and kind and not _CHECKS.get(kind, lambda v: False)(value):
        return False
    if kind == "object":
        if strict and any(name not in value for name in schema.get("required") or []):
            return False
        props = schema.get("properties")
        return not isinstance(props, dict) or all(json_fits(s, value[n], strict) for n, s in props.items() if n in value)
    if kind == "array" and isinstance(schema.get("items"), dict):
        return all(json_fits(schema["items"], v, strict) for v in value)
    return True


def payload_fits(definition: str | None, payload: bytes | None, strict: bool = False) -> bool:
    """Anything fits where there is no schema."""
    if definition is None:
        return True
    try:
        return json_fits(json.loads(definition), json.loads(payload or b""), strict)
    except ValueError:
        return False


def validated(rows: DataFrame, schemas: DataFrame, strict: bool = False) -> DataFrame:
    """Adds schema_ok by the latest schema of each topic: JSON, Avro, or protobuf (definition: the message's name; descriptor: its file).

    Only the payload and its schema go through Python, in Arrow batches; a topic
    without a schema takes anything.
    """
    newest = latest(schemas)
    descriptor = F.col("descriptor") if "descriptor" in newest.columns else F.lit(None).cast("binary")
    joined = rows.join(newest.select("topic", F.col("type").alias("__type"), F.col("definition").alias("__definition"), descriptor.alias("__descriptor")), "topic", "left")

    @F.pandas_udf("boolean")
    def fits(kind: pd.Series, definition: pd.Series, descriptor: pd.Series, payload: pd.Series) -> pd.Series:
        return pd.Series([_fits(k, d, f, bytes(p) if p is not None else b"", strict) for k, d, f, p in zip(kind, definition, descriptor, payload)])

    ok = F.when(F.col("__type").isNull(), True).otherwise(fits("__type", "__definition", "__descriptor", "payload"))
    return joined.withColumn("schema_ok", ok).drop("__type", "__definition", "__descriptor")


def _fits(kind: str | None, definition: str | None, descriptor: bytes | None, payload: bytes, strict: bool) -> bool:
    if kind == "json":
        return payload_fits(definition, payload, strict)
    if kind == "avro":
        return binary.avro_fits(definition or "null", payload)
    return kind == "protobuf" and binary.protobuf_fits(definition or "", payload, descriptor)


def _avro_fields(definition: str) -> dict[str, bool]:
    """Names of a record's fields, and whether they have a default."""
    record = json.loads(definition)
    return {f["name"]: "default" in f for f in record.get("fields", [])} if isinstance(record, dict) else {}


def _json_problems(old: dict, new: dict, mode: str) -> Iterator[str]:
    if old.get("type") and new.get("type") and old["type"] != new["type"]:
        yield f"type changed from {old['type']} to {new['type']}"
        return
    before, after = set(old.get("required") or []), set(new.get("required") or [])
    olds, news = old.get("properties") or {}, new.get("properties") or {}
    if mode == "BACKWARD":
        yield from (f"{n} is no longer required" for n in sorted(before - after))
        yield from (f"new field {n} is required" for n in sorted(set(news) - set(olds)) if n in after)
    if mode == "FORWARD":
        yield from (f"{n} is newly required" for n in sorted(after - before))
    for name in sorted(set(olds) & set(news)):
        yield from (f"{name}: {x}" for x in _json_problems(olds[name], news[name], mode))


def problems(old_type: str, old: str, new_type: str, new: str, mode: str = "BACKWARD") -> list[str]:
    """Why a new version may not follow an old one. Protobuf definitions are JSON lists of {name, tag, type, required}."""
    if old_type != new_type:
        return [f"schema type changed from {old_type} to {new_type}"]
    if mode == "NONE":
        return []
    if mode == "FULL":
        return problems(old_type, old, new_type, new, "BACKWARD") + problems(old_type, old, new_type, new, "FORWARD")
    if old_type == "avro":
        a, b = _avro_fields(old), _avro_fields(new)
        gone, side = (a, b) if mode == "BACKWARD" else (b, a)
        return [f"field {n} has no default" for n in sorted(gone) if n not in side and not gone[n]]
    if old_type == "json":
        return list(_json_problems(json.loads(old), json.loads(new), mode))
    if old_type == "protobuf" and old and new:
        a, b = ({f["tag"]: f for f in json.loads(d)} for d in (old, new))
        out = [f"tag {t} changed type" for t in sorted(set(a) & set(b)) if a[t]["type"] != b[t]["type"]]
        missing, present = (a, b) if mode == "BACKWARD" else (b, a)
        return out + [f"required tag {t} is on one side only" for t in sorted(set(missing) - set(present)) if missing[t].get("required")]
    return []


def incompatible_versions(schemas: DataFrame, mode: str = "BACKWARD") -> DataFrame:
    """Versions that may not follow the one before: topic, version, problem."""
    from pyspark.sql import Window

    w = Window.partitionBy("topic").orderBy("version")
    pairs = schemas.select("topic", "version", "type", "definition", F.lag("type").over(w).alias("old_type"), F.lag("definition").over(w).alias("old")).where("old_type is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(r["topic"], r["version"], p) for r in batch.to_pylist() for p in problems(r["old_type"], r["old"], r["type"], r["definition"], mode)]
            cols = list(zip(*out)) if out else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string())], ["topic", "version", "problem"])

    return pairs.mapInArrow(run, "topic string, version int, problem string")
