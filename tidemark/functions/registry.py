"""Scalar and aggregate functions that Spark has under another name, or not at all.

Names with a counterpart of the same meaning are renamed in the text. The rest
are SQL functions: Spark puts their bodies in place of the calls, so they are
planned like any other expression and no Python runs.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Name in the text -> Spark's name.
RENAMED = {
    "array_concat": "concat", "array_cat": "concat", "array_has": "array_contains",
    "array_has_any": "arrays_overlap", "array_length": "size", "cardinality": "size",
    "array_to_string": "array_join", "array_reverse": "reverse",
    "make_array": "array", "make_list": "array", "generate_series": "sequence", "array_intersection": "array_intersect",
    "strpos": "instr", "starts_with": "startswith", "ends_with": "endswith",
    "substr_index": "substring_index", "btrim": "trim", "character_length": "char_length",
    "stddev_population": "stddev_pop", "var": "var_samp", "var_population": "var_pop", "var_sample": "var_samp",
    "approx_distinct": "approx_count_distinct", "approx_percentile_cont": "percentile_approx", "string_agg": "listagg",
    "arrow_typeof": "typeof", "today": "current_date",
    "to_timestamp_seconds": "timestamp_seconds", "to_timestamp_millis": "timestamp_millis", "to_timestamp_micros": "timestamp_micros",
    "unnest": "explode", "make_map": "map", "row": "struct", "ifnull": "coalesce",
    "random": "rand", "trunc": "trunc_to", "encode": "encode_text", "decode": "decode_text", "digest": "digest_of",
    "datepart": "date_part", "datetrunc": "date_trunc",
}

#: name(parameters) RETURNS type: body
DEFINED = [
    ("gcd", "a BIGINT, b BIGINT", "BIGINT", "aggregate(sequence(1, 93), struct(abs(a) AS x, abs(b) AS y), (s, i) -> struct(IF(s.y = 0, s.x, s.y) AS x, IF(s.y = 0, 0L, s.x % s.y) AS y), s -> s.x)"),
    ("lcm", "a BIGINT, b BIGINT", "BIGINT", "IF(a = 0 OR b = 0, 0L, abs(a div aggregate(sequence(1, 93), struct(abs(a) AS x, abs(b) AS y), (s, i) -> struct(IF(s.y = 0, s.x, s.y) AS x, IF(s.y = 0, 0L, s.x % s.y) AS y), s -> s.x) * b))"),
    ("iszero", "x DOUBLE", "BOOLEAN", "x = 0"),
    ("trunc_to", "x DOUBLE, n INT DEFAULT 0", "DOUBLE", "IF(x < 0, ceil(x * power(10, n)), floor(x * power(10, n))) / power(10, n)"),
    ("encode_text", "x STRING, how STRING", "STRING", "CASE lower(how) WHEN 'hex' THEN lower(hex(x)) WHEN 'base64' THEN replace(base64(CAST(x AS BINARY)), '=', '') END"),
    ("decode_text", "x STRING, how STRING", "BINARY", "CASE lower(how) WHEN 'hex' THEN unhex(x) WHEN 'base64' THEN unbase64(concat(x, repeat('=', (4 - length(x) % 4) % 4))) END"),
    ("digest_of", "x STRING, how STRING", "STRING", "CASE lower(how) WHEN 'md5' THEN md5(x) WHEN 'sha224' THEN sha2(x, 224) WHEN 'sha256' THEN sha2(x, 256) WHEN 'sha384' THEN sha2(x, 384) WHEN 'sha512' THEN sha2(x, 512) END"),
    ("sha224", "x STRING", "STRING", "sha2(x, 224)"),
    ("sha256", "x STRING", "STRING", "sha2(x, 256)"),
    ("sha384", "x STRING", "STRING", "sha2(x, 384)"),
    ("sha512", "x STRING", "STRING", "sha2(x, 512)"),
    ("to_hex", "x BIGINT", "STRING", "lower(hex(x))"),
]

#: Microseconds of a day-time interval.
_STRIDE = "(CAST(extract(SECOND FROM stride) * 1000000 AS BIGINT) + (CAST(extract(MINUTE FROM stride) AS BIGINT) * 60 + CAST(extract(HOUR FROM stride) AS BIGINT) * 3600 + CAST(extract(DAY FROM stride) AS BIGINT) * 86400) * 1000000)"
_MICROS = "unix_micros(CAST({} AS TIMESTAMP))"
DEFINED.append(
    (
        "date_bin",
        "stride INTERVAL DAY TO SECOND, t TIMESTAMP_NTZ, origin TIMESTAMP_NTZ",
        "TIMESTAMP_NTZ",
        f"CAST(timestamp_micros({_MICROS.format('origin')} + CAST(floor(({_MICROS.format('t')} - {_MICROS.format('origin')}) / {_STRIDE}) AS BIGINT) * {_STRIDE}) AS TIMESTAMP_NTZ)",
    )
)


def register(spark: SparkSession) -> None:
    for name, params, returns, body in DEFINED:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {returns} RETURN {body}")
