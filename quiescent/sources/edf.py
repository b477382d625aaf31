"""EDF recordings as a Spark source and sink.

The reader is a Python data source: files are planned into ranges of data records,
whose byte offsets follow from the header, so that one long recording is read by
many tasks. Signals can be chosen; others are skipped inside each record. Paths are
read through Hadoop's file systems by ``binaryFile`` where ``open`` cannot reach them
(:func:`read_edf_binary`).
"""

from __future__ import annotations

import glob
import os
import re
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Widths of the header's fields, the file's and each signal's.
FILE_FIELDS = (("version", 8), ("patient_id", 80), ("record_id", 80), ("start_date", 8), ("start_time", 8), ("header_bytes", 8), ("reserved", 44), ("n_records", 8), ("record_seconds", 8), ("n_signals", 4))
SIGNAL_FIELDS = (("label", 16), ("transducer", 80), ("units", 8), ("phys_min", 8), ("phys_max", 8), ("dig_min", 8), ("dig_max", 8), ("prefilter", 80), ("samples", 8), ("reserved", 32))

SCHEMA = "rec_id string, channel string, signal int, srate double, i bigint, v double"
RECORDS_PER_TASK = 600
#: Bytes of samples that a task gathers from stretches of short files, and rows of its batches.
TASK_BYTES = 256 << 10
ROWS = 1 << 16


@dataclass
class Header:
    """The parsed header; ``signals`` has a dict for each signal."""

    fields: dict[str, str]
    signals: list[dict[str, str]]

    @property
    def header_bytes(self) -> int:
        return int(self.fields["header_bytes"])

    @property
    def samples(self) -> np.ndarray:
        return np.array([int(s["samples"]) for s in self.signals])

    @property
    def record_seconds(self) -> float:
        return float(self.fields["record_seconds"])

    @property
    def sample_bytes(self) -> int:
        """2, and 3 in the 24-bit variant, whose version field is a byte 255 and a name."""
        return 3 if self.fields["version"].startswith("\xff") else 2

    @property
    def record_bytes(self) -> int:
        return self.sample_bytes * int(self.samples.sum())

    def records_in(self, size: int) -> int:
        """Whole records by the file's size; the header's count may be -1 or wrong."""
        return max(0, (size - self.header_bytes) // max(1, self.record_bytes))

    def start(self) -> datetime | None:
        try:
            return datetime.strptime(self.fields["start_date"] + " " + self.fields["start_time"], "%d.%m.%y %H.%M.%S")
        except ValueError:
            return None


def parse_header(raw: bytes) -> Header:
    at, fields = 0, {}
    for name, width in FILE_FIELDS:
        fields[name] = raw[at : at + width].decode("latin-1").strip()
        at += width
    n = int(fields["n_signals"])
    signals: list[dict[str, str]] = [{} for _ in range(n)]
    for name, width in SIGNAL_FIELDS:
        for s in signals:
            s[name] = raw[at : at + width].decode("latin-1").strip()
            at += width
    return Header(fields, signals)


def decode(raw: bytes, h: Header, first: int, wanted: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(signal, indices from 1, physical values) of whole records from the ``first`` on."""
    width = int(h.samples.sum())
    n = len(raw) // h.record_bytes * width
    if h.sample_bytes == 2:
        data = np.frombuffer(raw, "<i2", n).reshape(-1, width)
    else:  # the upper byte carries the sign
        b = np.frombuffer(raw, np.uint8, 3 * n).reshape(-1, 3).astype(np.int32)
        data = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) ^ 0x800000) - 0x800000
        data = data.reshape(-1, width)
    edge = np.concatenate([[0], np.cumsum(h.samples)])
    for k in wanted:
        s = h.signals[k]
        lo, hi, dlo, dhi = (float(s[x]) for x in ("phys_min", "phys_max", "dig_min", "dig_max"))
        scale = (hi - lo) / (dhi - dlo)
        v = data[:, edge[k] : edge[k + 1]].reshape(-1) * scale + (hi - scale * dhi)
        yield k, first * h.samples[k] + 1 + np.arange(len(v)), v


def _batch(rec: str, h: Header, raw: bytes, first: int, wanted: list[int]) -> Iterator[pa.RecordBatch]:
    kind = pa.schema([("rec_id", pa.string()), ("channel", pa.string()), ("signal", pa.int32()), ("srate", pa.float64()), ("i", pa.int64()), ("v", pa.float64())])
    for k, i, v in decode(raw, h, first, wanted):
        n = len(v)
        rate = float(h.samples[k]) / h.record_seconds
        cols = [pa.repeat(rec, n), pa.repeat(h.signals[k]["label"], n), pa.array(np.full(n, k, np.int32)), pa.array(np.full(n, rate)), pa.array(i.astype(np.int64)), pa.array(v)]
        yield pa.RecordBatch.from_arrays(cols, schema=kind)


def _wanted(h: Header, signals: str | None) -> list[int]:
    if not signals:
        return list(range(len(h.signals)))
    bare = lambda s: re.sub(r"\W", "", s).lower()
    names = {bare(s) for s in signals.split(",")}
    return [i for i, s in enumerate(h.signals) if bare(s["label"]) in names or str(i) in names]


def rec_name(path: str) -> str:
    return os.path.splitext(os.path.basename(path))[0]


@dataclass
class _Part(InputPartition):
    """Stretches ``(path, first record, records)`` that one task reads."""

    stretches: list[tuple[str, int, int]]


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Small batches put together."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= ROWS:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


class EdfReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.signals = options.get("signals")
        self.per_task = int(options.get("recordspertask", RECORDS_PER_TASK))
        self.trust = options.get("records", "size") == "header"

    def partitions(self) -> list[InputPartition]:
        path = self.path.removeprefix("file://").removeprefix("file:")
        files = sorted(glob.glob(os.path.join(path, "**", "*.[eb]df"), recursive=True)) if os.path.isdir(path) else sorted(glob.glob(path))
        out: list[_Part] = []
        held = 0
        for f in files:
            with open(f, "rb") as s:
                h = parse_header(_head(s))
            n = h.records_in(os.path.getsize(f))
            if self.trust and int(h.fields["n_records"]) >= 0:
                n = min(n, int(h.fields["n_records"]))
            for k in range(0, n, self.per_task):
                # many short files are one task
                if not out or held >= TASK_BYTES:
                    out.append(_Part([]))
                    held = 0
                count = min(self.per_task, n - k)
                out[-1].stretches.append((f, k, count))
                held += count * h.record_bytes
        return out  # type: ignore[return-value]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        def batches() -> Iterator[pa.RecordBatch]:
            for path, first, count in partition.stretches:
                with open(path, "rb") as s:
                    h = parse_header(_head(s))
                    s.seek(h.header_bytes + first * h.record_bytes)
                    raw = s.read(count * h.record_bytes)
                yield from _batch(rec_name(path), h, raw, first, _wanted(h, self.signals))

        yield from _joined(batches())


def _head(s: object) -> bytes:
    first = s.read(256)  # type: ignore[attr-defined]
    return first + s.read(int(first[184:192]) - 256)  # type: ignore[attr-defined]


class EdfSource(DataSource):
    """``spark.read.format("edf").option("signals", "Fp1,F3").load(path)``.

    Options: ``signals`` (labels, of which only word characters count, or numbers), ``recordsPerTask`` (of one file, at most; short
    stretches are read by one task together), and ``records`` = ``header`` to believe the header's count of records. Writing takes rows of
    :data:`RANGES` and the options ``srate`` and ``limit``; see :func:`save_edf`.
    """

    @classmethod
    def name(cls) -> str:
        return "edf"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> EdfReader:
        return EdfReader(dict(self.options))

    def writer(self, schema: object, overwrite: bool) -> EdfWriter:
        return EdfWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(EdfSource)


def read_edf_binary(spark: SparkSession, path: str, signals: str | None = None) -> DataFrame:
    """The same rows through ``binaryFile``, a file a task: for stores that only Spark reaches."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[eb]df").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path_, raw in zip(b["path"].to_pylist(), b["content"].to_pylist(), strict=True):
                h = parse_header(raw)
                yield from _batch(rec_name(path_), h, raw[h.header_bytes :], 0, _wanted(h, signals))

    return files.mapInArrow(run, SCHEMA)


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """``(rec_id, start, n_records, record_seconds, signals)`` of each file; only headers are parsed."""
    schema = "rec_id string, patient_id string, start timestamp_ntz, n_records bigint, record_seconds double, signals array<struct<label:string,units:string,phys_min:double,phys_max:double,dig_min:double,dig_max:double,samples:int>>"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[eb]df").load(path)
    names = files.select("path", "length", F.substring("content", 1, 256 * 513).alias("head"))

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for b in batches:
            rows = []
            for p, size, raw in zip(b["path"], b["length"], b["head"], strict=True):
                h = parse_header(bytes(raw))
                sig = [{"label": s["label"], "units": s["units"], **{k: float(s[k]) for k in ("phys_min", "phys_max", "dig_min", "dig_max")}, "samples": int(s["samples"])} for s in h.signals]
                rows.append((rec_name(p), h.fields["patient_id"], h.start(), h.records_in(size), h.record_seconds, sig))
            yield pd.DataFrame(rows, columns=["rec_id", "patient_id", "start", "n_records", "record_seconds", "signals"])

    # Spark plans a task for a few dozen short files
    return names.coalesce(int(spark.conf.get("spark.sql.shuffle.partitions"))).mapInPandas(run, schema)


def encode_header(n_records: int, srate: int, labels: list[str], patient: str = "X", record: str = "X", start: datetime | None = None, limit: float = 100.0) -> bytes:
    """The header of a file of 1-second records of 12 bits between ``-limit`` and ``limit``."""
    start = start or datetime(2000, 1, 1)
    cell = lambda x, w: str(x).encode("latin-1", "replace")[:w].ljust(w)
    values = {"version": "0", "patient_id": patient, "record_id": record, "start_date": start.strftime("%d.%m.%y"), "start_time": start.strftime("%H.%M.%S"), "header_bytes": 256 * (1 + len(labels)), "reserved": "", "n_records": n_records, "record_seconds": 1, "n_signals": len(labels)}
    head = b"".join(cell(values[k], w) for k, w in FILE_FIELDS)
    per = {"transducer": "", "units": "uV", "phys_min": f"{-limit:g}", "phys_max": f"{limit:g}", "dig_min": -2048, "dig_max": 2047, "prefilter": "", "samples": srate, "reserved": ""}
    for k, w in SIGNAL_FIELDS:
        head += b"".join(cell(labels[i] if k == "label" else per[k], w) for i in range(len(labels)))
    return head


def encode_records(data: np.ndarray, srate: int, limit: float = 100.0) -> bytes:
    """Records of ``(channel, time)`` data: clipped at ``limit``, the last one filled with zeros."""
    n = -(-data.shape[1] // srate) if data.shape[1] else 0
    full = np.zeros((len(data), n * srate))
    full[:, : data.shape[1]] = np.clip(data, -limit, limit)
    dig = np.clip(np.round((full + limit) / (2 * limit) * 4095 - 2048), -2048, 2047).astype("<i2")
    return dig.reshape(len(data), n, srate).transpose(1, 0, 2).tobytes()


def encode(data: np.ndarray, srate: int, labels: list[str], patient: str = "X", record: str = "X", start: datetime | None = None, limit: float = 100.0) -> bytes:
    """An EDF file of ``(channel, time)`` data in 1-second records: clipped at ``limit``, 12 bits, the last record filled with zeros."""
    n = -(-data.shape[1] // srate) if data.shape[1] else 0
    return encode_header(n, srate, labels, patient, record, start, limit) + encode_records(data, srate, limit)


#: Columns the sink takes: a stretch of records of a recording, and what the recording's header needs.
RANGES = "rec_id string, first bigint, count bigint, body binary, n_records bigint, labels array<string>, patient string, start timestamp_ntz"


@dataclass
class _Written(WriterCommitMessage):
    """Records by recording that a task has written."""

    counts: dict[str, int]
    wanted: dict[str, int]


class EdfWriter(DataSourceArrowWriter):
    """Writes stretches of records to their places in files that nobody sees before the commit.

    A recording's header says where each record belongs, so tasks write into one file
    side by side, and one that runs again writes the same bytes to the same places.
    The commit counts the records of each recording, then renames the files; where a task
    fails for good, or records are missing, they are deleted and earlier files stay.
    """

    def __init__(self, options: dict[str, str]) -> None:
        self.folder = options["path"].removeprefix("file://").removeprefix("file:")
        self.srate, self.limit = int(options["srate"]), float(options.get("limit", 100.0))
        self.hidden = os.path.join(self.folder, f".edf-{uuid.uuid4().hex}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        counts: dict[str, int] = {}
        wanted: dict[str, int] = {}
        os.makedirs(self.hidden, exist_ok=True)
        for b in iterator:
            for r in b.to_pylist():
                head = encode_header(r["n_records"], self.srate, r["labels"], r["patient"] or "X", r["rec_id"], r["start"], self.limit)
                size = 2 * self.srate * len(r["labels"])
                if len(r["body"]) != size * r["count"]:
                    raise ValueError(f"{r['rec_id']}: {len(r['body'])} bytes for {r['count']} records")
                fd = os.open(os.path.join(self.hidden, f"{r['rec_id']}.edf"), os.O_RDWR | os.O_CREAT, 0o644)
                try:
                    os.pwrite(fd, head, 0)
                    os.pwrite(fd, r["body"], len(head) + size * r["first"])
                finally:
                    os.close(fd)
                counts[r["rec_id"]] = counts.get(r["rec_id"], 0) + r["count"]
                wanted[r["rec_id"]] = r["n_records"]
        return _Written(counts, wanted)

    def commit(self, messages: list[_Written | None]) -> None:
        counts: dict[str, int] = {}
        wanted: dict[str, int] = {}
        for m in messages:
            for rec, n in (m.counts if m else {}).items():
                counts[rec] = counts.get(rec, 0) + n
                wanted[rec] = m.wanted[rec]
        short = sorted(r for r in counts if counts[r] != wanted[r])
        if short:
            self.abort(messages)
            raise ValueError(f"records are missing or double: {short[:5]}")
        for rec in counts:
            os.replace(os.path.join(self.hidden, f"{rec}.edf"), os.path.join(self.folder, f"{rec}.edf"))
        shutil.rmtree(self.hidden, ignore_errors=True)

    def abort(self, messages: list[_Written | None]) -> None:
        shutil.rmtree(self.hidden, ignore_errors=True)


def record_ranges(samples: DataFrame, srate: int, about: DataFrame | None = None, limit: float = 100.0, per_task: int = RECORDS_PER_TASK) -> DataFrame:
    """``samples(rec_id, channel, i, v)`` to rows of :data:`RANGES`, a row for each ``per_task`` records of a recording.

    ``i`` counts from 1. Samples that are not there, and those of channels that stop
    early, are 0. ``about(rec_id, patient, start)`` goes to the headers. No task has more
    of a recording than such a stretch. Rows with a null in one of the first three are left out.
    """
    s = samples.where("rec_id is not null and channel is not null and i >= 1").select(F.col("rec_id").cast("string").alias("rec_id"), "channel", F.col("i").cast("long").alias("i"), F.col("v").cast("double").alias("v"))
    rec = s.groupBy("rec_id").agg(F.ceil(F.max("i") / srate).cast("long").alias("n_records"), F.array_sort(F.collect_set("channel")).alias("labels"))
    if about is not None:
        rec = rec.join(about.select(F.col("rec_id").cast("string").alias("rec_id"), "patient", F.col("start").cast("timestamp_ntz").alias("start")), "rec_id", "left")
    else:
        rec = rec.withColumns({"patient": F.lit(None).cast("string"), "start": F.lit(None).cast("timestamp_ntz")})
    size = per_task * srate
    # every stretch, those without samples too
    grid = rec.withColumn("c_", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_records") - 1) / per_task))))
    own = s.withColumn("c_", F.floor((F.col("i") - 1) / size)).groupBy("rec_id", "c_", "channel").agg(F.collect_list(F.struct("i", "v")).alias("s"))
    own = own.groupBy("rec_id", "c_").agg(F.collect_list(F.struct("channel", "s")).alias("channels"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                n = min(per_task, r["n_records"] - r["c_"] * per_task)
                data = np.zeros((len(r["labels"]), n * srate))
                for c in r["channels"] or []:
                    at = np.array([x["i"] for x in c["s"]]) - 1 - r["c_"] * size
                    data[r["labels"].index(c["channel"]), at] = [0.0 if x["v"] is None else x["v"] for x in c["s"]]
                rows.append({"rec_id": r["rec_id"], "first": r["c_"] * per_task, "count": n, "body": encode_records(np.nan_to_num(data), srate, limit), **{k: r[k] for k in ("n_records", "labels", "patient", "start")}})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    kinds = pa.schema([("rec_id", pa.string()), ("first", pa.int64()), ("count", pa.int64()), ("body", pa.binary()), ("n_records", pa.int64()), ("labels", pa.list_(pa.string())), ("patient", pa.string()), ("start", pa.timestamp("us"))])
    # tasks by number: stretches are small and costly
    tasks = int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return grid.join(own, ["rec_id", "c_"], "left").repartition(tasks, "rec_id", "c_").mapInArrow(run, RANGES)


def save_edf(samples: DataFrame, folder: str, srate: int, about: DataFrame | None = None, limit: float = 100.0, per_task: int = RECORDS_PER_TASK) -> None:
    """A file for each recording below ``folder``, which all executors must reach; each is written by as many tasks as it has stretches."""
    register(samples.sparkSession)
    os.makedirs(folder.removeprefix("file://").removeprefix("file:"), exist_ok=True)
    rows = record_ranges(samples, srate, about, limit, per_task)
    rows.write.format("edf").option("srate", srate).option("limit", limit).mode("append").save(folder)


def write_edf(samples: DataFrame, folder: str, srate: int, limit: float = 100.0, existing: DataFrame | None = None) -> DataFrame:
    """One file for each recording of ``samples(rec_id, channel, i, v)``; returns ``(rec_id, path, bytes, status)``.

    Recordings in ``existing(rec_id)`` are left alone; one that fails has its error
    as status. ``folder`` must be one that every executor reaches.
    """
    todo = samples.join(existing.select("rec_id").distinct(), "rec_id", "left_anti") if existing is not None else samples

    def run(pdf: object) -> object:
        import pandas as pd

        rec = pdf["rec_id"].iloc[0]  # type: ignore[index]
        path = os.path.join(folder, f"{rec}.edf")
        try:
            m = pdf.pivot_table(index="channel", columns="i", values="v").fillna(0.0)  # type: ignore[attr-defined]
            raw = encode(m.to_numpy(float), srate, [str(c) for c in m.index], limit=limit)
            os.makedirs(folder, exist_ok=True)
            tmp = f"{path}.{os.getpid()}.part"
            with open(tmp, "wb") as s:
                s.write(raw)
            os.replace(tmp, path)  # a task that runs again leaves one whole file
            return pd.DataFrame([(rec, path, len(raw), "ok")], columns=["rec_id", "path", "bytes", "status"])
        except (OSError, ValueError) as e:
            return pd.DataFrame([(rec, path, 0, str(e)[:200])], columns=["rec_id", "path", "bytes", "status"])

    return todo.groupBy("rec_id").applyInPandas(run, "rec_id string, path string, bytes bigint, status string")
