"""Character sets of recognisers: text files, one entry a line, or metadata inside a model file.

``ModelMetadata`` is a data source over model files of any size: it walks the fields of the message with a buffer of BUFFER bytes
and steps over tensors without reading them. ``spark.dataSource.register(ModelMetadata)``, then
``spark.read.format("model_metadata").load("/models/a.onnx,/models/b.onnx")``: path, key, value, error. A file that is cut off or
damaged is a row with an error, beside what was read before it.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

BUFFER = 1 << 20
KEYS = ("character", "dictionary", "charset")


def entries(lines: list[str]) -> list[str]:
    """Class 0 is the blank, then every line, then the space."""
    return ["", *lines, " "]


def load(path: str) -> list[str]:
    with open(path, encoding="utf-8") as f:
        return entries([x.rstrip("\r\n") for x in f])


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """class, entry of a dictionary file, from any store that Spark reads: class 0 is the blank, then every line, then the space."""
    lines = F.split(F.regexp_replace("value", r"\r?\n$", ""), r"\r?\n")
    read = spark.read.format("binaryFile").load(path).select(F.decode("content", "UTF-8").alias("value"))
    read = read.agg(F.coalesce(F.first("value"), F.lit("")).alias("value"))  # one row even of an empty file
    text = read.select(F.concat(F.array(F.lit("")), F.when(F.col("value") != "", lines).otherwise(F.array().cast("array<string>")), F.array(F.lit(" "))).alias("entries"))
    return text.select(F.posexplode("entries").alias("class", "entry")).select(F.col("class").cast("long").alias("class"), "entry")


def varint(data: bytes, at: int) -> tuple[int, int]:
    """Value and the place behind it; ValueError where it is cut off or over 64 bits."""
    value = shift = 0
    while True:
        if at >= len(data):
            raise ValueError("cut off")
        if shift >= 63 and data[at] > 1:
            raise ValueError("overflow")
        value |= (data[at] & 127) << shift
        at += 1
        if not data[at - 1] & 128:
            return value, at
        shift += 7


def fields(data: bytes) -> Iterator[tuple[int, int, int | bytes]]:
    """Number, wire type and value of every field of a protobuf message."""
    at = 0
    while at < len(data):
        tag, at = varint(data, at)
        number, wire = tag >> 3, tag & 7
        if wire == 0:
            value, at = varint(data, at)
        elif wire in (1, 5):
            size = 8 if wire == 1 else 4
            value, at = data[at : at + size], at + size
        elif wire == 2:
            size, at = varint(data, at)
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"wire type {wire}")
        if at > len(data):
            raise ValueError("cut off")
        yield number, wire, value


def metadata(model: bytes) -> dict[str, str]:
    """Keys and values that an ONNX model carries (field 14: entries of key 1 and value 2)."""
    out = {}
    for number, wire, value in fields(model):
        if number == 14 and wire == 2:
            pair = {n: v.decode() for n, w, v in fields(value) if w == 2}
            out[pair.get(1, "")] = pair.get(2, "")
    return out


class Scanner:
    """The fields of a message in a file that can seek, read through a buffer of fixed size; what is not wanted is stepped over."""

    def __init__(self, file, size: int, buffer: int = BUFFER):
        self.file, self.size, self.most, self.at, self.held, self.begin = file, size, buffer, 0, b"", 0
        self.most_held = 0

    def _byte(self) -> int:
        if not self.begin <= self.at < self.begin + len(self.held):
            if self.at >= self.size:
                raise ValueError("cut off")
            self.file.seek(self.at)
            self.begin, self.held = self.at, self.file.read(min(self.most, self.size - self.at))
            self.most_held = max(self.most_held, len(self.held))
        self.at += 1
        return self.held[self.at - 1 - self.begin]

    def varint(self) -> int:
        value = shift = 0
        while True:
            b = self._byte()
            if shift >= 63 and b > 1:
                raise ValueError("overflow")
            value |= (b & 127) << shift
            shift += 7
            if not b & 128:
                return value

    def bytes(self, n: int) -> bytes:
        """``n`` bytes, which must fit the buffer."""
        if self.at + n > self.size:
            raise ValueError("cut off")
        if n > self.most:
            raise ValueError(f"an entry of {n} bytes")
        if not (self.begin <= self.at and self.at + n <= self.begin + len(self.held)):
            self.file.seek(self.at)
            self.begin, self.held = self.at, self.file.read(n)
        got = self.held[self.at - self.begin : self.at - self.begin + n]
        self.at += n
        return got

    def pairs(self) -> Iterator[tuple[str, str]]:
        """Keys and values of the metadata (field 14) of a model."""
        while self.at < self.size:
            tag = self.varint()
            wire = tag & 7
            if wire == 0:
                self.varint()
                continue
            if wire not in (1, 2, 5):
                raise ValueError(f"wire type {wire}")
            n = self.varint() if wire == 2 else 8 if wire == 1 else 4
            if wire == 2 and tag >> 3 == 14:
                pair = {k: v.decode() for k, w, v in fields(self.bytes(n)) if w == 2}
                yield pair.get(1, ""), pair.get(2, "")
            elif self.at + n > self.size:
                raise ValueError("cut off")
            else:
                self.at += n


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str], buffer: int):
        self.paths, self.buffer = paths, buffer

    def partitions(self):
        return [InputPartition(p) for p in self.paths]

    def read(self, partition):
        from pyarrow import fs

        path = partition.value
        try:
            store, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(path))
            with store.open_input_file(name) as f:
                for key, value in Scanner(f, f.size(), self.buffer).pairs():
                    yield path, key, value, None
        except (ValueError, OSError) as e:
            yield path, None, None, str(e)


class ModelMetadata(DataSource):
    """Data source of the metadata of model files: one row an entry, one task a file. ``path``: files, comma-joined."""

    @classmethod
    def name(cls):
        return "model_metadata"

    def schema(self):
        return "path string, key string, value string, error string"

    def reader(self, schema):
        paths = [p for p in self.options.get("path", "").split(",") if p]
        return _Reader(paths, int(self.options.get("buffer", BUFFER)))


def ensure(path: str, model: str) -> list[str]:
    """The character set in ``path``; where that is missing, it is written there from the model's metadata."""
    if not os.path.isfile(path):
        with open(model, "rb") as f:
            got = dict(Scanner(f, os.path.getsize(model)).pairs())
        text = next((got[k] for k in KEYS if got.get(k)), None)
        if text is None:
            raise ValueError(f"{model} holds no character set")
        with open(path, "w", encoding="utf-8") as f:
            f.write(text.rstrip("\n") + "\n")
    return load(path)
