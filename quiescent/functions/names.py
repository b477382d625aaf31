"""Names of recordings and what is read from them, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A recording's name: hospital, number, record, segment, date and time, the last two joined by _ or T.
NAME = r"^([A-Za-z]+)_(\d+)_(\d+)_(\d+)_(\d{8})[_T](\d{6})"


def two_tokens(name: Column) -> Column:
    """The first two parts of a name."""
    return F.substring_index(name, "_", 2)


def patient_id(name: Column) -> Column:
    """The first two parts, three where the name starts with CA_BIDMC or CA_MGH."""
    long = name.startswith("CA_BIDMC") | name.startswith("CA_MGH")
    return F.when(long, F.substring_index(name, "_", 3)).otherwise(F.substring_index(name, "_", 2))


def parse_name(name: Column) -> Column:
    """Struct of hospital, number, record, segment, date and time; null where the name has another form."""
    part = lambda i: F.regexp_extract(name, NAME, i)
    out = F.struct(part(1).alias("hospital"), part(2).cast("int").alias("number"), part(3).cast("int").alias("record"), part(4).cast("int").alias("segment"), part(5).alias("date"), part(6).alias("time"))
    return F.when(name.rlike(NAME), out)


def name_timestamp(name: Column) -> Column:
    """Start time in a name, without a zone."""
    found = F.regexp_replace(F.regexp_extract(name, r"(\d{8}[_T]\d{6})", 1), "T", "_")
    return F.when(found != "", F.to_timestamp_ntz(found, F.lit("yyyyMMdd_HHmmss")))


def end_time(start: Column, n_samples: Column, srate: float) -> Column:
    """The start moved on by a recording's length."""
    return start + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (n_samples / srate).cast("decimal(18,6)"))


def hospital(pid: Column) -> Column:
    return F.regexp_extract(pid, r"^([A-Za-z_]+?)_?\d", 1)


def number(pid: Column) -> Column:
    return F.regexp_extract(pid, r"(\d+)$", 1).cast("int")


def pname_to_sid(pname: Column) -> Column:
    """``mgh_12`` to ``mgh12``-like ids without the mark."""
    return F.concat(hospital(pname), number(pname).cast("string"))


def drop_first_mark(name: Column) -> Column:
    """Without the first underscore."""
    return F.regexp_replace(name, r"^([^_]*)_", "$1")


def episode_bounds(name: Column) -> Column:
    """``start_end`` to a struct of both."""
    p = F.split(name, "_")
    return F.struct(F.element_at(p, 1).cast("long").alias("start"), F.element_at(p, 2).cast("long").alias("end"))


def burst_key(key: Column) -> Column:
    """``<recording>_<start>_<end>_<ordinal>`` to its four parts."""
    rx = r"^(.*)_(\d+)_(\d+)_(\d+)$"
    return F.struct(F.regexp_extract(key, rx, 1).alias("rec_id"), F.regexp_extract(key, rx, 2).cast("long").alias("start"), F.regexp_extract(key, rx, 3).cast("long").alias("end"), F.regexp_extract(key, rx, 4).cast("int").alias("ord"))


def make_burst_key(rec: Column, start: Column, end: Column, ordinal: Column) -> Column:
    return F.concat_ws("_", rec, start.cast("string"), end.cast("string"), ordinal.cast("string"))


def region_name(roi: Column) -> Column:
    """A column-safe region name."""
    return F.translate(roi, "- ", "__")


def good_outcome(cpc: Column) -> Column:
    """True for 1 and 2, false for 3 to 5, null for others."""
    return F.when(cpc.isin(1, 2), F.lit(True)).when(cpc.isin(3, 4, 5), F.lit(False))


def decibel(x: Column) -> Column:
    return 10 * F.log10(F.when(x > 0, x))


def seconds_to_samples(s: Column, srate: float) -> Column:
    return F.round(s * srate).cast("long")


def samples_to_seconds(n: Column, srate: float) -> Column:
    return n / srate


def samples_to_hours(n: Column, srate: float) -> Column:
    return n / srate / 3600


def natural_key(name: Column) -> Column:
    """Sort key by a name's text, then its last number."""
    return F.struct(F.regexp_replace(name, r"\d+(?=\D*$)", "").alias("text"), F.regexp_extract(name, r"(\d+)\D*$", 1).cast("long").alias("n"))
