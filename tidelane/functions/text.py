"""Scalar functions on names, dates and words, as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def natural_key(name: Column) -> Column:
    """O-SRC-03: an array to order by: digits as numbers, before letters; letters without case."""
    parts = F.regexp_extract_all(name, F.lit(r"(\d+|\D+)"), 1)
    return F.transform(parts, lambda p: F.struct(F.when(p.rlike(r"^\d+$"), 0).otherwise(1).alias("kind"), F.coalesce(F.expr("1").cast("long") * p.try_cast("long"), F.lit(0).cast("long")).alias("number"), F.when(p.rlike(r"^\d+$"), "").otherwise(F.lower(p)).alias("word")))


def folder_time(name: Column) -> Column:
    """O-SRC-02: the timestamp in YYMMDD_HHMMSS or YYYY-MM-DD_HH-MM-SS, else null."""
    long = F.regexp_extract(name, r"(\d{4}-\d{2}-\d{2}_\d{2}-\d{2}-\d{2})", 1)
    short = F.regexp_extract(name, r"(?<!\d)(\d{6}_\d{6})(?!\d)", 1)
    return F.coalesce(F.try_to_timestamp(F.nullif(long, F.lit("")), F.lit("yyyy-MM-dd_HH-mm-ss")), F.try_to_timestamp(F.nullif(short, F.lit("")), F.lit("yyMMdd_HHmmss")))


def safe_name(name: Column) -> Column:
    """Runs of other characters than letters, digits, '.', '_' and '-' as one '_', none at the ends."""
    return F.regexp_replace(F.regexp_replace(name, r"[^A-Za-z0-9._-]+", "_"), r"^_+|_+$", "")


def field_name(name: Column) -> Column:
    """A name of letters, digits and '_' that begins with a letter, at most 63 long."""
    clean = F.regexp_replace(name, r"[^A-Za-z0-9_]", "_")
    return F.substring(F.when(clean.rlike(r"^[A-Za-z]"), clean).otherwise(F.concat(F.lit("x"), clean)), 1, 63)


def day_prefix(name: Column) -> Column:
    """Letters, 'day' and number in front of a session's name, else ''."""
    return F.regexp_extract(F.lower(name), r"^([a-z]*day\d+)", 1)


def to_bool(value: Column) -> Column:
    """true/yes/on/1 and false/no/off/0 in any case; others null."""
    v = F.lower(F.trim(value.cast("string")))
    return F.when(v.isin("true", "yes", "on", "1", "y", "t"), True).when(v.isin("false", "no", "off", "0", "n", "f"), False)


def to_number(value: Column) -> Column:
    """A number, or null where the text isn't one."""
    return F.trim(value.cast("string")).try_cast("double")


def has_bit(word: Column, bit: int) -> Column:
    return F.getbit(word.cast("long"), F.lit(bit)) == 1


def point_column(name: Column) -> Column:
    """O-SUP-17: struct(point, part) of a column named point_x, point_y or point_likelihood; null for others."""
    return F.when(name.rlike(r"^.+_(x|y|likelihood)$"), F.struct(F.regexp_extract(name, r"^(.+)_(x|y|likelihood)$", 1).alias("point"), F.regexp_extract(name, r"^(.+)_(x|y|likelihood)$", 2).alias("part")))
