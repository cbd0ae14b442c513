"""Type tests and exact text renderings of JSON values held as VARIANT.

Each function takes and returns a SQL expression, so that a long expression is
built as one text instead of one driver call per node.
"""

from __future__ import annotations


def field(value: str, name: str) -> str:
    return f"try_variant_get({value}, '$.{name}', 'variant')"


def kind(value: str) -> str:
    """STRING, BIGINT, DECIMAL(p,s), DOUBLE, BOOLEAN, VOID (JSON null), OBJECT<..>,
    ARRAY<..>; SQL NULL for a missing key."""
    return f"schema_of_variant({value})"


def as_string(value: str) -> str:
    return f"try_variant_get({value}, '$', 'string')"


def members(value: str) -> str:
    return f"try_variant_get({value}, '$', 'map<string,variant>')"


def plain_double(value: str) -> str:
    """A JSON double without exponent or trailing zeros; NULL when it is not finite.

    340 decimals reach the smallest double; the formatter pads its shortest
    digits with zeros, which are cut off again.
    """
    number = f"try_variant_get({value}, '$', 'double')"
    return (
        f"CASE WHEN abs({number}) < double('Infinity') "
        f"THEN regexp_replace(format_string('%.340f', {number} + 0.0D), r'[.]?0+$', '') END"
    )


def scalar_text(value: str) -> str:
    """Text of a value as an attribute filter compares it; JSON null is NULL."""
    return f"""CASE {kind(value)}
        WHEN 'STRING' THEN {as_string(value)}
        WHEN 'DOUBLE' THEN {plain_double(value)}
        WHEN 'VOID' THEN NULL
        ELSE to_json({value}) END"""


def scalar_json(value: str) -> str:
    """JSON fragment of a string, number or boolean with numbers written plainly."""
    return f"""CASE WHEN {kind(value)} = 'DOUBLE' THEN coalesce({plain_double(value)}, 'null')
        ELSE to_json({value}) END"""


def json_string(text: str) -> str:
    """Quoted and escaped JSON string: a one-element JSON array without its brackets."""
    wrapped = f"to_json(array({text}))"
    return f"substr({wrapped}, 2, length({wrapped}) - 2)"


def flat_object_json(value: str, shape: str) -> str:
    """Canonical JSON of a flat object; only exponent-form numbers need rebuilding."""
    pair = f"concat({json_string('m.key')}, ':', {scalar_json('m.value')})"
    return f"""CASE WHEN contains({shape}, 'DOUBLE')
        THEN concat('{{', array_join(transform(map_entries({members(value)}), m -> {pair}), ','), '}}')
        ELSE to_json({value}) END"""


def flat_object_text(value: str, shape: str) -> str:
    """MAP of attribute name to text. The plain cast is exact except for fractions
    and exponent forms, which it may write in scientific notation."""
    return f"""CASE WHEN {shape} RLIKE 'DOUBLE|DECIMAL'
        THEN transform_values({members(value)}, (k, v) -> {scalar_text('v')})
        ELSE try_variant_get({value}, '$', 'map<string,string>') END"""


def interpolated(value: str) -> str:
    """Any JSON value as it reads inside a message: missing keys are 'undefined',
    objects '[object Object]', arrays their comma-joined items."""
    shape = kind(value)
    item = f"""CASE
        WHEN {kind('v')} = 'VOID' THEN ''
        WHEN {kind('v')} LIKE 'OBJECT%' THEN '[object Object]'
        WHEN {kind('v')} LIKE 'ARRAY%' THEN regexp_replace(to_json(v), r'[\\[\\]"]', '')
        ELSE {scalar_text('v')} END"""
    items = f"try_variant_get({value}, '$', 'array<variant>')"
    return f"""CASE
        WHEN {shape} IS NULL THEN 'undefined'
        WHEN {shape} = 'VOID' THEN 'null'
        WHEN {shape} LIKE 'OBJECT%' THEN '[object Object]'
        WHEN {shape} LIKE 'ARRAY%' THEN array_join(transform({items}, v -> {item}), ',')
        ELSE {scalar_text(value)} END"""
