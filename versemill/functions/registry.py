"""The scalar functions for SQL users, as SQL functions without Python per row."""

from __future__ import annotations

from pyspark.sql import SparkSession

from versemill.functions import kana as K

_IN_ROWS = f"length(c) > 0 AND instr('{K.ROW_CHARS}', c) > 0"

SQL_FUNCTIONS = {
    "vm_split_moras(s STRING) RETURNS ARRAY<STRING>": (
        f"regexp_extract_all(s, '(?s).[{K.SMALL_KANA}{K.LONG_MARK}]*', 0)"
    ),
    "vm_split_fine_moras(s STRING) RETURNS ARRAY<STRING>": (
        f"regexp_extract_all(s, '(?s).[{K.SMALL_KANA}]*', 0)"
    ),
    "vm_vowel_of_char(c STRING) RETURNS STRING": (
        f"CASE WHEN {_IN_ROWS} THEN translate(c, '{K.ROW_CHARS}', '{K.ROW_VOWELS}') END"
    ),
    "vm_vowel_of(s STRING) RETURNS STRING": (
        f"vm_vowel_of_char(right(trim(TRAILING '{K.LONG_MARK}' FROM s), 1))"
    ),
    "vm_to_katakana(s STRING) RETURNS STRING": f"translate(s, '{K.HIRAGANA}', '{K.KATAKANA}')",
    "vm_to_hiragana(s STRING) RETURNS STRING": f"translate(s, '{K.KATAKANA}', '{K.HIRAGANA}')",
    "vm_strip_silent(s STRING) RETURNS STRING": f"translate(s, '{K.SILENT_SYMBOLS}', '')",
    "vm_is_missing(s STRING) RETURNS BOOLEAN": (
        "s IS NULL OR lower(trim(s)) IN ('', 'na', 'n/a', 'nan', 'none', 'null')"
    ),
    "vm_url_key(s STRING) RETURNS STRING": "left(sha1(s), 16)",
    "vm_safe_name(s STRING) RETURNS STRING": (
        r"""left(regexp_replace(regexp_replace(s, r'[\\/:*?"<>|\s]+', '_'), '^_+|_+$', ''), 40)"""
    ),
}


def register(spark: SparkSession) -> None:
    """Create the functions as temporary functions of the session."""
    for head, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
