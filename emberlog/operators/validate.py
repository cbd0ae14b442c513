"""Request bodies to validated entries and per-request responses.

Every step is an expression on the request's own row, so parsing and validation
need no shuffle; only the per-request summary groups, after a map-side combine
that leaves one row per request.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.functions import variants as V
from emberlog.functions.timestamps import instant_sql
from emberlog.schema import FUTURE_TOLERANCE, LEVELS, MAX_SERVICE_LENGTH

REQUEST_COLUMNS = ("request_id", "received_at", "request_number")

BODY_ERROR = """CASE
    WHEN NOT coalesce(try_variant_get(doc, '$[1]', 'bigint') = xxhash64(body), false)
        THEN 'Request body is not valid JSON'
    WHEN entries IS NULL THEN 'Request body must be an object with a "logs" array'
    WHEN size(entries) = 0 THEN 'Logs array cannot be empty' END"""


# The type text of a whole object rules most out cheaply; a nested type or null may be present.
_NESTED = "coalesce({0} LIKE 'OBJECT%' AND substr({0}, 8) RLIKE ': (OBJECT<|ARRAY<|VOID)', false)"


def explode_requests(requests: DataFrame) -> DataFrame:
    """One row per entry of `{"logs": [...]}`, with its 0-based position.

    A body that holds no entries keeps a single row carrying `error`. `entry` is
    the typed value and `attr_shape` the type of its attributes; `raw` is the same
    entry as text, whose key order the typed value does not keep. Only the name of a
    bad attribute asks for that order, so bodies without one are not parsed again.
    `request_number` tells requests apart that share an id.
    """
    # The JSON parser stops after the first value. Parsing the body as the first
    # item of an array that ends in the body's own hash makes trailing text show.
    sealed = "concat('[', body, ',', xxhash64(body), ']')"
    parsed = (
        requests.withColumn("request_number", F.monotonically_increasing_id())
        .selectExpr("*", f"try_parse_json({sealed}) AS doc")
        .selectExpr("*", "try_variant_get(doc, '$[0].logs', 'array<variant>') AS entries")
        .selectExpr("*", f"transform(entries, e -> {V.kind(V.field('e', 'attributes'))}) AS shapes")
    )
    paired = parsed.selectExpr(
        *REQUEST_COLUMNS,
        f"{BODY_ERROR} AS error",
        f"""CASE WHEN exists(shapes, s -> {_NESTED.format('s')})
            THEN coalesce(from_json(body, 'logs ARRAY<STRING>').logs, array()) ELSE array() END AS raw""",
        "entries AS entry",
        "shapes AS attr_shape",
    ).selectExpr(*REQUEST_COLUMNS, "error", "CASE WHEN error IS NULL THEN arrays_zip(entry, raw, attr_shape) END AS pairs")
    return paired.selectExpr(
        *REQUEST_COLUMNS, "error", "posexplode_outer(pairs) AS (index, pair)"
    ).selectExpr(*REQUEST_COLUMNS, "error", "index", "pair.entry", "pair.raw", "pair.attr_shape")


def _first_bad_attribute() -> str:
    """Name of the first attribute with a nested or null value, in property order:
    integer-like keys ascending, then the order written."""
    bad = f"""map_keys(map_filter({V.members('v_attributes')},
        (k, v) -> {V.kind('v')} RLIKE '^(OBJECT|ARRAY|VOID)'))"""
    written = "array_distinct(json_object_keys(from_json(raw, 'attributes STRING').attributes))"
    named = f"array_intersect({written}, {bad})"
    numbered = f"""filter({named},
        k -> k RLIKE '^(0|[1-9][0-9]{{0,9}})$' AND try_cast(k AS BIGINT) < 4294967295)"""
    lowest = f"array_min(transform({numbered}, k -> try_cast(k AS BIGINT)))"
    return f"coalesce(string({lowest}), get({named}, 0), get({bad}, 0))"


def _reason() -> str:
    """The first failing rule, NULL for an accepted entry. Its texts are fixed values. The last two rules reject
    what the fixed column widths cannot hold, so such a row never fails its
    neighbours."""
    levels = ", ".join(f"'{level}'" for level in LEVELS)
    tolerance = f"INTERVAL {int(FUTURE_TOLERANCE.total_seconds())} SECONDS"
    return f"""CASE
    WHEN error IS NOT NULL THEN NULL
    WHEN v_timestamp IS NULL AND NOT coalesce({V.kind('entry')} RLIKE '^(OBJECT|ARRAY)', false)
        THEN 'Entry must be an object'
    WHEN coalesce(timestamp, '') = '' THEN 'Missing or invalid timestamp'
    WHEN ts IS NULL THEN 'Timestamp must be a valid ISO 8601 string'
    WHEN date_trunc('millisecond', ts) > date_trunc('millisecond', received_at) + {tolerance}
        THEN 'Timestamp cannot be more than 5 minutes in the future'
    WHEN NOT coalesce(level IN ({levels}), false)
        THEN concat("Invalid level: '", {V.interpolated('v_level')}, "'")
    WHEN coalesce(service, '') = '' THEN 'Service must be a non-empty string'
    WHEN coalesce(message, '') = '' THEN 'Message must be a non-empty string'
    WHEN attr_shape <> 'VOID' AND NOT has_attributes THEN 'Attributes must be a flat object'
    WHEN bad_attribute IS NOT NULL
        THEN concat("Attribute '", bad_attribute, "' has invalid type 'object'")
    WHEN length(service) > {MAX_SERVICE_LENGTH} THEN 'Service exceeds {MAX_SERVICE_LENGTH} characters'
    WHEN contains(service, char(0)) OR contains(message, char(0))
        OR (contains(attributes, r'\\u0000') AND attributes RLIKE r'(?<!\\\\)(\\\\\\\\)*\\\\u0000')
        THEN 'Text contains a null character' END"""


def validate_entries(entries: DataFrame) -> DataFrame:
    """Typed columns plus `reason`; the typed columns are filled for accepted entries."""
    texts = ("timestamp", "level", "service", "message")
    kept = (*REQUEST_COLUMNS, "error", "index")
    fields = entries.selectExpr(
        "*", *[f"{V.field('entry', name)} AS v_{name}" for name in (*texts, "attributes")]
    )
    typed = fields.selectExpr(
        *kept, "entry", "raw", "v_timestamp", "v_level", "v_attributes", "attr_shape",
        *[f"CASE WHEN {V.kind(f'v_{n}')} = 'STRING' THEN {V.as_string(f'v_{n}')} END AS {n}" for n in texts],
    )
    # The exact look at each value runs only where a nested type or null may be present.
    checked = typed.selectExpr(
        "*",
        f"{instant_sql('timestamp')} AS ts",
        "coalesce(attr_shape LIKE 'OBJECT%', false) AS has_attributes",
        f"CASE WHEN {_NESTED.format('attr_shape')} THEN {_first_bad_attribute()} END AS bad_attribute",
        f"""CASE WHEN attr_shape LIKE 'OBJECT%'
            THEN {V.flat_object_json('v_attributes', 'attr_shape')} ELSE '{{}}' END AS attributes""",
    )
    judged = checked.selectExpr("*", f"{_reason()} AS reason").selectExpr(
        "*", "error IS NULL AND reason IS NULL AS accepted"
    )
    return judged.selectExpr(
        *kept,
        "reason",
        "CASE WHEN accepted THEN ts END AS timestamp",
        *[f"CASE WHEN accepted THEN {n} END AS {n}" for n in ("level", "service", "message", "attributes")],
        f"""CASE WHEN accepted AND has_attributes THEN {V.flat_object_text('v_attributes', 'attr_shape')}
            WHEN accepted THEN cast(map() AS MAP<STRING, STRING>) END AS attr_text""",
    )


def validate_requests(requests: DataFrame) -> DataFrame:
    """(request_id, body, received_at) rows to one validated row per entry."""
    return validate_entries(explode_requests(requests))


def summarise_requests(entries: DataFrame, *kept: str) -> DataFrame:
    """One response row per request: accepted count, rejections by index, status, and those of
    REQUEST_COLUMNS that are named.

    The collected list is bounded by one request body, which already is one cell.
    """
    rejection = "CASE WHEN reason IS NOT NULL THEN struct(int(index) AS index, reason AS reason) END"
    return (
        entries.groupBy(*REQUEST_COLUMNS)
        .agg(
            F.max("error").alias("error"),
            F.expr("int(count_if(error IS NULL AND reason IS NULL))").alias("accepted"),
            F.expr(f"array_sort(collect_list({rejection}))").alias("rejected"),
        )
        .selectExpr(
            "request_id",
            "received_at",
            "CASE WHEN error IS NOT NULL OR accepted = 0 THEN 400 ELSE 200 END AS status",
            "accepted",
            "rejected",
            "error",
            *kept,
        )
    )
