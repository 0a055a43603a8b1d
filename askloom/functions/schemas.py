"""Parameter schemas compiled to expressions over variant values.

A schema is a dictionary as tools declare it: ``type``, ``properties``, ``required``,
``enum``, ``items``, ``additionalProperties``, nested at will. It becomes one expression, so the check
runs inside the scan stage and no function sees a row.
"""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, functions as F

UNREADABLE = "arguments are not a JSON object"
# Names of JSON types by the first word of a variant's type.
_KINDS = {
    "OBJECT": "object", "ARRAY": "array", "STRING": "string", "BOOLEAN": "boolean", "VOID": "null",
    "BIGINT": "number", "DECIMAL": "number", "DOUBLE": "number", "FLOAT": "number",
}


def json_kind(value: Column) -> Column:
    """The JSON type of a variant: "object", "array", "string", "number", "boolean", "null"."""
    first = F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)
    kind = F.lit(None).cast("string")
    for name, known in _KINDS.items():
        kind = F.when(first == name, known).otherwise(kind)
    return kind


def _member(name: str) -> str:
    return "$[" + json.dumps(name, ensure_ascii=False) + "]"


def _first(reasons: list[Column]) -> Column:
    return F.coalesce(*reasons) if reasons else F.lit(None).cast("string")


def _path(at: str, name: str) -> str:
    return f"{at}.{name}" if at else name


def violation(value: Column, schema: Mapping, at: str = "") -> Column:
    """What is wrong with a variant, by the first rule of ``schema`` it breaks, or NULL.

    The order is: type, enumeration, missing members by name as listed, members by name,
    members not declared, elements.
    """
    kind, label = json_kind(value), at or "arguments"
    rules: list[Column] = []
    wanted = schema.get("type")
    wanted = [wanted] if isinstance(wanted, str) else wanted
    if wanted:
        fits = [_is_kind(value, kind, w) for w in wanted]
        right = fits[0]
        for more in fits[1:]:
            right = right | more
        told = F.concat(F.lit(f"{label}: "), kind, F.lit(f" instead of {' or '.join(wanted)}"))
        rules.append(F.when(~right, told))
    if "enum" in schema:
        allowed = [json.dumps(v, ensure_ascii=False, separators=(",", ":")) for v in schema["enum"]]
        rules.append(F.when(~F.to_json(value).isin(allowed), F.lit(f"{label}: not one of {', '.join(allowed)}")))
    is_object = kind == "object"
    for name in schema.get("required", ()):
        missing = F.try_variant_get(value, _member(name), "variant").isNull()
        rules.append(F.when(is_object & missing, F.lit(f"missing argument: {_path(at, name)}")))
    properties = schema.get("properties", {})
    for name, own in properties.items():
        member = F.try_variant_get(value, _member(name), "variant")
        rules.append(F.when(is_object & member.isNotNull(), violation(member, own, _path(at, name))))
    if schema.get("additionalProperties", True) is False:
        extra = F.array_sort(F.array_except(F.json_object_keys(F.to_json(value)), F.array(*map(F.lit, properties)).cast("array<string>")))
        rules.append(F.when(is_object & (F.size(extra) > 0), F.concat(F.lit("unknown argument: "), F.lit(f"{at}." if at else ""), extra[0])))
    if "items" in schema:
        elements = F.try_variant_get(value, "$", "array<variant>")
        wrong = F.filter(F.transform(elements, lambda v: violation(v, schema["items"], f"{label}[]")), lambda r: r.isNotNull())
        rules.append(F.when(kind == "array", F.get(wrong, F.lit(0))))
    return _first(rules)


def _is_kind(value: Column, kind: Column, wanted: str) -> Column:
    if wanted == "integer":
        number = F.try_variant_get(value, "$", "double")
        return (kind == "number") & F.coalesce(number == F.floor(number), F.lit(False))
    return kind == wanted


def call_violation(args: Column, schema: Mapping) -> Column:
    """``violation`` of arguments given as JSON text, which must be an object.

    Text that is no JSON, repeats a key or goes on after its value is unreadable. The
    parser accepts text after a value, so the text is parsed inside an array and inside an
    object: only what ends both ways right ends with its value.
    """
    listed = F.try_parse_json(F.concat(F.lit("["), args, F.lit("]")))
    held = F.try_parse_json(F.concat(F.lit('{"v":'), args, F.lit("}")))
    value = F.try_variant_get(listed, "$[0]", "variant")
    alone = F.size(F.try_variant_get(listed, "$", "array<variant>")) == 1
    readable = F.coalesce(alone & held.isNotNull() & (json_kind(value) == "object"), F.lit(False))
    return F.when(~readable, UNREADABLE).otherwise(violation(value, dict(schema, type="object")))
