"""The library's own functions under names, for queries in SQL text.

`register(spark)` makes them temporary functions of the session. Each body is a SQL expression that Spark inlines, so they are
optimised and compiled with the query around them, and no Python runs.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

_MIDDLE = "(element_at(sorted, greatest(CAST(floor((size(sorted) + 1) / 2) AS INT), 1)) + element_at(sorted, greatest(CAST(floor(size(sorted) / 2) AS INT) + 1, 1))) / 2.0D"

#: Name and arguments, result, body. Arrays have no nulls.
FUNCTIONS = {
    "padded(vals ARRAY<BIGINT>, n INT)": ("ARRAY<BIGINT>", "concat(vals, array_repeat(CAST(0 AS BIGINT), greatest(n - size(vals), 0)))"),
    "middle_of(sorted ARRAY<DOUBLE>)": ("DOUBLE", f"CASE WHEN size(sorted) > 0 THEN {_MIDDLE} END"),
    "array_median(vals ARRAY<DOUBLE>)": ("DOUBLE", "middle_of(sort_array(vals))"),
    "distances(vals ARRAY<DOUBLE>, m DOUBLE)": ("ARRAY<DOUBLE>", "transform(vals, x -> abs(x - m))"),
    "array_mad(vals ARRAY<DOUBLE>)": ("DOUBLE", "array_median(distances(vals, array_median(vals)))"),
    "padded_median(vals ARRAY<BIGINT>, n INT)": ("DOUBLE", "array_median(CAST(padded(vals, n) AS ARRAY<DOUBLE>))"),
    "padded_mad(vals ARRAY<BIGINT>, n INT)": ("DOUBLE", "array_mad(CAST(padded(vals, n) AS ARRAY<DOUBLE>))"),
    "bit_of(key BIGINT, bits INT)": ("BIGINT", "shiftleft(CAST(1 AS BIGINT), CAST(pmod(key, bits) AS INT))"),
    "linear_count(bitmap BIGINT, bits INT)": ("DOUBLE", "CASE WHEN bit_count(bitmap) >= bits THEN CAST(bits AS DOUBLE) ELSE -bits * ln(1 - bit_count(bitmap) / bits) END"),
    "hash_bucket(key STRING, buckets INT)": ("BIGINT", "CAST(conv(substring(md5(key), 1, 8), 16, 10) AS BIGINT) % buckets"),
    "decoded(raw STRING)": ("STRING", "try_url_decode(regexp_replace(replace(raw, '+', '%2B'), '%(?![0-9A-Fa-f]{2})', '%25'))"),
    "lossy(raw STRING, text STRING)": ("BOOLEAN", "contains(text, '�') AND NOT contains(upper(raw), '%EF%BF%BD') AND NOT contains(raw, '�')"),
    "normal_title(raw STRING)": ("STRING", "replace(CASE WHEN contains(raw, '%') AND decoded(raw) IS NOT NULL AND NOT lossy(raw, decoded(raw)) THEN decoded(raw) ELSE raw END, ' ', '_')"),
}


def register(spark: SparkSession) -> None:
    for head, (result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {result} RETURN {body}")
