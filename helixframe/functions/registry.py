"""The library's functions by name, for users of SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Name, parameters, result and body of each function; bodies are SQL, so they are compiled into the plans that call them.
FUNCTIONS = {
    "revcomp": ("s STRING", "STRING", "CASE WHEN upper(s) RLIKE '^[ACGTN]*$' THEN translate(reverse(upper(s)), 'ACGTN', 'TGCAN') END"),
    "canonical_kmer": ("s STRING", "STRING", "least(s, translate(reverse(s), 'ACGT', 'TGCA'))"),
    "kmer_pack": ("s STRING", "BIGINT", "cast(conv(translate(upper(s), 'ACGT', '0123'), 4, 10) AS BIGINT)"),
    "kmer_unpack": ("x BIGINT, k INT", "STRING", "translate(lpad(conv(cast(x AS STRING), 10, 4), k, '0'), '0123', 'ACGT')"),
    "kmer_distance": ("x BIGINT, y BIGINT", "INT", "bit_count(((x ^ y) | shiftright(x ^ y, 1)) & 6148914691236517205)"),
    "gc_fraction": ("s STRING", "DOUBLE", "try_divide(length(regexp_replace(upper(s), '[^GC]', '')), length(s))"),
    "chrom_rank": ("c STRING", "INT", "CASE regexp_extract(c, '^(?:chr)?([1-9]|1[0-9]|2[0-2]|X|Y)$', 1) WHEN 'X' THEN 23 WHEN 'Y' THEN 24 WHEN '' THEN NULL ELSE try_cast(regexp_replace(c, '^chr', '') AS INT) END"),
    "phred": ("p DOUBLE", "DOUBLE", "-10 * log10(p)"),
    "flag_set": ("flags INT, bit INT", "BOOLEAN", "(flags & bit) = bit"),
    "info_value": ("info STRING, name STRING", "STRING", "filter(transform(split(info, ';'), p -> struct(substring_index(p, '=', 1) AS k, substr(p, instr(p, '=') + 1) AS v)), p -> p.k = name)[0].v"),
}


def register(spark: SparkSession, prefix: str = "hx_") -> list[str]:
    """Define all of FUNCTIONS in the session, each name behind ``prefix``; gives the names."""
    for name, (takes, gives, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({takes}) RETURNS {gives} RETURN {body}")
    return [prefix + name for name in FUNCTIONS]
