"""SQL names for the short row functions.

``register(spark)`` makes them temporary functions of the session; they are
inlined by the optimizer, so a query using them stays on the JVM side.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

_FUNCTIONS = {
    "gt_norm(gt STRING)": (
        "STRING",
        "CASE WHEN gt = '.' THEN './.' WHEN try_cast(split_part(translate(gt, '|', '/'), '/', 1) AS INT) > "
        "try_cast(split_part(translate(gt, '|', '/'), '/', 2) AS INT) THEN concat(try_cast(split_part(translate(gt, '|', '/'), '/', 2) AS INT), '/', "
        "try_cast(split_part(translate(gt, '|', '/'), '/', 1) AS INT)) ELSE translate(gt, '|', '/') END",
    ),
    "gt_class4(gt STRING)": (
        "STRING",
        "CASE WHEN gt IS NULL OR gt IN ('./.', '.', '.|.') THEN 'MISS' WHEN split_part(gt, '/', 1) <> split_part(gt, '/', 2) THEN 'HET' "
        "WHEN split_part(gt, '/', 1) = '0' THEN 'REF' ELSE 'ALT' END",
    ),
    "site_id(chrom STRING, pos BIGINT)": ("STRING", "concat(chrom, '_', pos)"),
    "is_ems(ref STRING, alt STRING)": ("BOOLEAN", "concat(ref, alt) IN ('GA', 'CT')"),
    "pic(p DOUBLE)": ("DOUBLE", "1 - (p * p + (1 - p) * (1 - p)) - 2 * (p * p) * ((1 - p) * (1 - p))"),
    "fold_maf(f DOUBLE)": ("DOUBLE", "CASE WHEN f <= 0.5 THEN f ELSE 1 - f END"),
    "gt_from_af(af DOUBLE)": ("STRING", "CASE WHEN af < 0.25 THEN '0/0' WHEN af < 0.75 THEN '0/1' ELSE '1/1' END"),
    "real_match_length(len INT, mismatch INT, gap INT, probe INT)": (
        "INT", "CASE WHEN len > probe THEN probe - mismatch + gap ELSE len - mismatch - gap END",
    ),
}


def register(spark: SparkSession) -> None:
    for head, (kind, body) in _FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
