"""Readers and writers of the tables around recordings, all with explicit schemas."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S

# ---------------------------------------------------------------- reading


def file_name(df: DataFrame, out: str = "file") -> DataFrame:
    """Adds the name of the file that a row came from."""
    return df.withColumn(out, F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``(path, length, modified)`` of the files below a folder."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return d.select("path", "length", F.col("modificationTime").alias("modified"))


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, sep: str = ",", header: bool = True, pattern: str | None = None) -> DataFrame:
    r = spark.read.schema(schema).option("header", header).option("sep", sep).option("nullValue", "NaN")
    return (r.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern) if pattern else r).csv(path)


def read_burst_ranges(spark: SparkSession, path: str, srate: float, offset: float = 0.0) -> DataFrame:
    """Burst CSV parts as ``(file, start_idx, end_idx, t_start, t_end)`` with times in seconds."""
    d = read_csv(spark, path, "burst_start_index bigint, burst_end_index bigint", pattern="*.csv")
    d = file_name(d)
    return d.select("file", F.col("burst_start_index").alias("start_idx"), F.col("burst_end_index").alias("end_idx"), (F.col("burst_start_index") / srate + offset).alias("t_start"), (F.col("burst_end_index") / srate + offset).alias("t_end"))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """``global_zs``/``bsr`` tables; the order of a file's lines is its index."""
    return read_csv(spark, path, "global_zs int, bsr double, i bigint", sep="\t")


#: An episode file: bounds to a list of one-element lists of bursts.
EPISODES = "map<string,array<array<struct<burst_start_index:bigint,burst_data:string>>>>"


def parse_episodes(df: DataFrame, text: str = "value", keep: Sequence[str] = (), indices_only: bool = False) -> DataFrame:
    """Episode JSON to ``(keep, episode_start, episode_end, burst_ord, burst_start_index, burst_data)``.

    A burst of one sample is a bare number. With ``indices_only`` its data are not parsed.
    """
    e = df.select(*keep, F.explode(F.from_json(text, EPISODES)).alias("k", "b"))
    e = e.select(*keep, "k", F.posexplode(F.transform("b", lambda x: x[0])).alias("burst_ord", "u"))
    bound = F.split("k", "_")
    cols = [F.element_at(bound, 1).cast("long").alias("episode_start"), F.element_at(bound, 2).cast("long").alias("episode_end"), (F.col("burst_ord") + 1).alias("burst_ord"), F.col("u.burst_start_index").alias("burst_start_index")]
    if not indices_only:
        raw = F.trim("u.burst_data")
        data = F.from_json(F.when(raw.startswith("["), raw).otherwise(F.concat(F.lit("["), raw, F.lit("]"))), "array<double>")
        cols.append(data.alias("burst_data"))
    return e.select(*keep, *cols)


def read_similarity(spark: SparkSession, path: str, sim_fn: str, min_length: int | None = None) -> DataFrame:
    """One measure's pairs; only its folder is read. ``min_length`` filters episodes by their span."""
    d = spark.read.parquet(path).where(F.col("sim_fn") == sim_fn)
    return d.where(F.col("episode_end") - F.col("episode_start") >= min_length) if min_length is not None else d


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``x1 x2 ... - label`` to ``(vec, label)``."""
    d = spark.read.text(path).where(F.trim("value") != "")
    p = F.split(F.col("value"), r"\s+-\s+")
    return d.select(F.transform(F.split(F.trim(p[0]), r"\s+"), lambda x: x.cast("double")).alias("vec"), F.trim(p[1]).cast("double").cast("int").alias("label"))


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """Lines that are not blank."""
    return spark.read.text(path).select(F.trim("value").alias("name")).where("name <> ''")


def read_timeline(spark: SparkSession, path: str) -> DataFrame:
    d = read_csv(spark, path, S.MERGE_INFO)
    return d.withColumn("ts", F.to_timestamp_ntz(F.col("timestamp"), F.lit("yyyyMMdd_HHmmss")))


def read_outcomes(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, S.OUTCOMES)


def read_offsets(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, S.ROSC)


#: Columns of electrode files by format; a label first or last.
LOCATIONS = {
    "sph": "idx int, sph_theta double, sph_phi double, label string",
    "loc": "idx int, theta double, radius double, label string",
    "xyz": "idx int, x double, y double, z double, label string",
    "sfp": "label string, x double, y double, z double",
}


def read_locations(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Electrode positions in one of the text formats, separated by blanks of any number."""
    names = T.StructType.fromDDL(LOCATIONS[kind])
    p = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    d = spark.read.text(path).where(F.trim("value") != "")
    return d.select(*[F.element_at(p, i + 1).cast(f.dataType).alias(f.name) for i, f in enumerate(names.fields)])


def read_matrix(spark: SparkSession, path: str, rows: int, dtype: str = "<f4", chunk: int = 65536) -> DataFrame:
    """Raw numbers, column by column, to ``(path, row, col, v)``."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, raw in zip(b["path"].to_pylist(), b["content"].to_pylist(), strict=True):
                v = np.frombuffer(raw, dtype, len(raw) // np.dtype(dtype).itemsize)
                for s in range(0, len(v), chunk):
                    k = np.arange(s, min(s + chunk, len(v)))
                    yield pa.RecordBatch.from_arrays([pa.array([p] * len(k)), pa.array((k % rows + 1).astype(np.int32)), pa.array(k // rows + 1), pa.array(v[k].astype(float))], ["path", "row", "col", "v"])

    return files.mapInArrow(run, "path string, row int, col long, v double")


def import_events(spark: SparkSession, path: str, columns: str, srate: float, unit: str = "s", sep: str = "\t", skip: int = 0) -> DataFrame:
    """An event list whose ``latency`` is in seconds, milliseconds or samples, to samples from 1."""
    d = read_csv(spark, path, columns, sep=sep, header=skip > 0)
    scale = {"s": srate, "ms": srate / 1000, "samples": 1.0}[unit]
    return d.withColumn("latency", F.col("latency") * scale + (1.0 if unit != "samples" else 0.0))


def json_value(c: Column) -> Column:
    """A JSON scalar that may spell NaN and infinities as strings."""
    t = F.trim(c, F.lit('"'))
    return F.when(t == "_NaN_", F.lit(float("nan"))).when(t.isin("_Inf_", "+_Inf_"), F.lit(float("inf"))).when(t == "-_Inf_", F.lit(float("-inf"))).otherwise(t.try_cast("double"))


def spell_value(c: Column) -> Column:
    """The other way: a number as JSON text."""
    return F.when(F.isnan(c), F.lit('"_NaN_"')).when(c == float("inf"), F.lit('"_Inf_"')).when(c == float("-inf"), F.lit('"-_Inf_"')).otherwise(c.cast("string"))


# ---------------------------------------------------------------- writing


def write_table(df: DataFrame, path: str, formats: dict[str, str] | None = None, sep: str = "\t", header: bool = True, mode: str = "errorifexists") -> None:
    """Delimited text; ``formats`` gives columns a printf format."""
    out = df.select(*[F.format_string(formats[c], F.col(c)).alias(c) if formats and c in formats else F.col(c) for c in df.columns])
    out.write.mode(mode).option("sep", sep).option("header", header).option("nullValue", "NaN").csv(path)


def write_lines(df: DataFrame, fmt: str, columns: Sequence[str], path: str, mode: str = "errorifexists") -> None:
    df.select(F.format_string(fmt, *[F.col(c) for c in columns]).alias("value")).write.mode(mode).text(path)


def episodes_json(bursts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(keys, value)``: each recording's episodes with their bursts' data as one JSON text."""
    one = F.array(F.struct(F.col("burst_start_index"), F.col("burst_data")))
    e = bursts.groupBy(*keys, "episode_start", "episode_end").agg(F.array_sort(F.collect_list(F.struct("burst_start_index", one.alias("b")))).alias("l"))
    e = e.select(*keys, F.concat_ws("_", "episode_start", "episode_end").alias("k"), F.transform("l", lambda x: x["b"]).alias("v"))
    return e.groupBy(*keys).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v"))))).alias("value"))


def burst_data(ranges: DataFrame, samples: DataFrame, keys: Sequence[str], bucket: int = 4096) -> DataFrame:
    """Each burst range with its samples in order."""
    from ..operators.ranges import points_in_ranges

    j = points_in_ranges(samples.select(*keys, "i", "v"), ranges, list(keys), bucket=bucket)
    group = [c for c in ranges.columns if c not in keys]
    return j.groupBy(*keys, *group).agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("s")).select(*keys, *group, F.col("start_idx").alias("burst_start_index"), F.col("s.v").alias("burst_data"))


def write_detection(labels: DataFrame, bursts: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Labels with ratios, and bursts, by recording."""
    labels.write.mode(mode).partitionBy("rec_id").parquet(f"{path}/labels")
    bursts.write.mode(mode).partitionBy("rec_id").parquet(f"{path}/bursts")


def write_similarity(pairs: DataFrame, path: str, mode: str = "append") -> None:
    """Pairs by measure; ``_SUCCESS`` marks what is whole."""
    pairs.write.mode(mode).partitionBy("sim_fn").parquet(path)


def write_burst_csv(bursts: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Burst indices by recording and episode part, each part its own episode's."""
    d = bursts.select("rec_id", F.col("episode_id").alias("part"), F.col("start_idx").alias("burst_start_index"), F.col("end_idx").alias("burst_end_index"))
    d.write.mode(mode).partitionBy("rec_id", "part").option("header", True).csv(path)


def write_regions(wide: DataFrame, path: str, mode: str = "append") -> None:
    wide.write.mode(mode).option("header", True).csv(path)


def write_locations(channels: DataFrame, path: str, kind: str, mode: str = "errorifexists") -> None:
    names = T.StructType.fromDDL(LOCATIONS[kind]).names
    write_table(channels.select(*names), path, header=False, mode=mode)


def is_done(spark: SparkSession, path: str) -> bool:
    """Whether a job has finished writing to a path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p))


def cached(spark: SparkSession, path: str, make: object, valid: Column | None = None) -> DataFrame:
    """The table at ``path`` if it is whole and has only valid rows, else made anew and written there."""
    if is_done(spark, path):
        d = spark.read.parquet(path)
        if not d.isEmpty() and (valid is None or d.where(~valid).isEmpty()):
            return d
    make().write.mode("overwrite").parquet(path)  # type: ignore[operator]
    return spark.read.parquet(path)


def timing_log(rows: DataFrame, path: str) -> None:
    """Medians of times and largest numbers of comparisons by node, appended."""
    g = rows.groupBy("node").agg(F.median("seconds").alias("median_seconds"), F.max("comparisons").alias("max_comparisons"), F.count("*").alias("n"))
    g.write.mode("append").option("header", True).csv(path)
