"""Binary JSON (UBJSON draft 12): values to bytes and back, and files to JSON text.

A value is a one-letter type and its bytes, big-endian. Containers may state their
length after ``#`` and, before that, one type for all members after ``$``.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Number types and their layouts.
NUMBERS = {"i": ">b", "U": ">B", "I": ">h", "l": ">i", "L": ">q", "d": ">f", "D": ">d"}


def encode(x: object) -> bytes:
    """Smallest integer type that holds a number, doubles for fractions, typed arrays for lists of numbers."""
    if x is None:
        return b"Z"
    if isinstance(x, bool):
        return b"T" if x else b"F"
    if isinstance(x, int):
        kind = _int_type(x)
        return b"H" + _text(str(x)) if kind is None else kind.encode() + struct.pack(NUMBERS[kind], x)
    if isinstance(x, float):
        return b"D" + struct.pack(">d", x)
    if isinstance(x, str):
        return b"S" + _text(x)
    if isinstance(x, dict):
        return b"{" + b"".join(_text(str(k)) + encode(v) for k, v in x.items()) + b"}"
    items = list(x)  # type: ignore[call-overload]
    if len(items) > 3 and all(type(v) is float for v in items):
        return b"[$D#" + encode(len(items)) + struct.pack(f">{len(items)}d", *items)
    return b"[" + b"".join(map(encode, items)) + b"]"


def _int_type(n: int) -> str | None:
    for kind, lo, hi in (("i", -(2**7), 2**7), ("U", 0, 2**8), ("I", -(2**15), 2**15), ("l", -(2**31), 2**31), ("L", -(2**63), 2**63)):
        if lo <= n < hi:
            return kind
    return None


def _text(s: str) -> bytes:
    b = s.encode("utf-8")
    return encode(len(b)) + b


class _Reader:
    def __init__(self, raw: bytes) -> None:
        self.raw, self.at = raw, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.raw):
            raise ValueError("the value ends early")
        self.at += n
        return self.raw[self.at - n : self.at]

    def kind(self) -> str:
        k = chr(self.take(1)[0])
        return self.kind() if k == "N" else k  # a no-op fills space

    def text(self) -> str:
        return self.take(int(self.value(self.kind()))).decode("utf-8")  # type: ignore[call-overload]

    def value(self, k: str) -> object:
        if k in NUMBERS:
            f = NUMBERS[k]
            return struct.unpack(f, self.take(struct.calcsize(f)))[0]
        if k in "ZTF":
            return {"Z": None, "T": True, "F": False}[k]
        if k == "S":
            return self.text()
        if k == "C":
            return chr(self.take(1)[0])
        if k == "H":
            t = self.text()
            return int(t) if t.lstrip("+-").isdigit() else float(t)
        if k in "[{":
            return self.container(k)
        raise ValueError(f"no type {k!r}")

    def container(self, k: str) -> object:
        typed = count = None
        if self.raw[self.at : self.at + 1] == b"$":
            self.take(1)
            typed = chr(self.take(1)[0])
        if self.raw[self.at : self.at + 1] == b"#":
            self.take(1)
            count = int(self.value(self.kind()))  # type: ignore[call-overload]
        elif typed:
            raise ValueError("a typed container states its length")
        out: list = []
        end = "]" if k == "[" else "}"
        while count is None or len(out) < count:
            if count is None:
                while self.raw[self.at : self.at + 1] == b"N":
                    self.take(1)
                if self.raw[self.at : self.at + 1] == end.encode():
                    self.take(1)
                    break
            name = self.text() if k == "{" else None
            v = self.value(typed or self.kind())
            out.append((name, v) if k == "{" else v)
        return dict(out) if k == "{" else out


def decode(raw: bytes) -> object:
    r = _Reader(raw)
    return r.value(r.kind())


def read_ubjson(spark: SparkSession, path: str, pattern: str = "*.ubj*") -> DataFrame:
    """``(path, value)``: each file's value as JSON text; null where it cannot be read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for raw in b["content"].to_pylist():
                try:
                    out.append(json.dumps(decode(raw)))
                except (ValueError, UnicodeDecodeError):
                    out.append(None)
            yield pa.RecordBatch.from_arrays([b["path"], pa.array(out, pa.string())], ["path", "value"])

    return files.mapInArrow(run, "path string, value string")


def encode_column(df: DataFrame, column: str, out: str = "ubjson") -> DataFrame:
    """JSON text to bytes."""

    @F.pandas_udf("binary")
    def enc(s):  # noqa: ANN001, ANN202
        return s.map(lambda t: None if t is None else encode(json.loads(t)))

    return df.withColumn(out, enc(F.col(column)))
