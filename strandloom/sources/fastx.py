"""FASTA and FASTQ files, plain or gzipped, as a Spark data source for batch and streaming reads."""

from __future__ import annotations

import gzip
import io
import os
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Suffixes of record files.
SUFFIXES = (".fa", ".fasta", ".fq", ".fastq", ".fa.gz", ".fasta.gz", ".fq.gz", ".fastq.gz")
SCHEMA = "file string, ord bigint, read_id string, comment string, seq string, qual string, is_fastq boolean"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


def clean_path(path: str) -> str:
    path = path.strip().lstrip("﻿").strip("\"'")
    return os.path.expanduser(path)


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path within it: local paths, and any address that Arrow knows (hdfs, s3, gs)."""
    path = clean_path(path)
    if "://" in path and not path.startswith("file://"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), os.path.abspath(path.removeprefix("file://").removeprefix("file:"))


def record_files(path: str, suffixes: tuple[str, ...] = SUFFIXES) -> list[str]:
    """The file, or the record files of a folder (not of its folders) in order."""
    at, inner = file_system(path)
    head = path[: path.index("://") + 3] if "://" in path and not path.startswith("file://") else ""
    info = at.get_file_info(inner)
    if info.type == fs.FileType.Directory:
        names = sorted(f.path for f in at.get_file_info(fs.FileSelector(inner)) if f.type == fs.FileType.File and f.path.lower().endswith(suffixes))
        return [head + n for n in names]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    return [head + inner]


def open_text(path: str) -> io.TextIOBase:
    at, inner = file_system(path)
    with at.open_input_stream(inner, compression=None) as f:
        zipped = f.read(2) == b"\x1f\x8b"
    raw = at.open_input_stream(inner, compression=None)
    return io.TextIOWrapper(gzip.GzipFile(fileobj=raw) if zipped else io.BufferedReader(_Raw(raw), 1 << 20), encoding="latin-1", newline="\n")


class _Raw(io.RawIOBase):
    """An Arrow stream as a raw Python one."""

    def __init__(self, stream):
        self.stream = stream

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        data = self.stream.read(len(buffer))
        buffer[: len(data)] = data
        return len(data)


def parse_records(lines: Iterator[str]) -> Iterator[tuple[str, str, str, str]]:
    """(name, comment, sequence, quality) of records with one or several lines each; quality is empty for FASTA.

    Empty sequences are skipped. A quality that ends early or has another length ends the input there, as a torn file
    would.
    """
    line = next(lines, None)
    while line is not None:
        line = line.rstrip("\r\n")
        if line[:1] not in (">", "@"):
            line = next(lines, None)
            continue
        name, _, comment = line[1:].replace("\t", " ", 1).partition(" ") if "\t" not in line else _cut(line[1:])
        parts: list[str] = []
        line = next(lines, None)
        while line is not None and line[:1] not in (">", "@", "+"):
            parts.append(line.strip())
            line = next(lines, None)
        seq, qual = "".join(parts), ""
        if line is not None and line[:1] == "+":
            got, size = [], 0
            while size < len(seq):
                line = next(lines, None)
                if line is None:
                    return
                got.append(line.rstrip("\r\n"))
                size += len(got[-1])
            if size != len(seq):
                return
            qual = "".join(got)
            line = next(lines, None)
        if seq:
            yield name, comment, seq, qual


def _cut(head: str) -> tuple[str, str, str]:
    at = min((i for i in (head.find(" "), head.find("\t")) if i >= 0), default=len(head))
    return head[:at], head[at : at + 1], head[at + 1 :]


def _rows(path: str, columns: list[str], limit: int | None) -> Iterator[tuple]:
    with open_text(path) as f:
        for i, (name, comment, seq, qual) in enumerate(parse_records(iter(f))):
            if limit is not None and i >= limit:
                return
            whole = {"file": path, "ord": i, "read_id": name, "comment": comment, "seq": seq, "qual": qual or None, "is_fastq": bool(qual)}
            yield tuple(whole[c] for c in columns)


class _Reader(DataSourceReader):
    def __init__(self, options: dict, columns: list[str]):
        self.path, self.columns = options["path"], columns
        self.limit = int(options["max_reads"]) if "max_reads" in options else None
        self.suffixes = tuple(options["suffixes"].split(",")) if "suffixes" in options else SUFFIXES

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(f) for f in record_files(self.path, self.suffixes)] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value:
            yield from _rows(partition.value, self.columns, self.limit)


class _StreamReader(DataSourceStreamReader):
    """New files of a folder, by name, one task each; the offset is the last name there is."""

    def __init__(self, options: dict, columns: list[str]):
        self.path, self.columns = options["path"], columns

    def initialOffset(self) -> dict:
        return {"last": ""}

    def latestOffset(self) -> dict:
        files = record_files(self.path)
        return {"last": os.path.basename(files[-1]) if files else ""}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [InputPartition(f) for f in record_files(self.path) if start["last"] < os.path.basename(f) <= end["last"]]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from _rows(partition.value, self.columns, None)

    def commit(self, end: dict) -> None:
        pass


class FastxDataSource(DataSource):
    """Options: path, columns (comma-separated, to read only those), suffixes, max_reads (per file; read_fastx
    makes it one of all files)."""

    @classmethod
    def name(cls) -> str:
        return "fastx"

    def schema(self) -> str:
        kinds = dict(c.split() for c in SCHEMA.split(", "))
        return ", ".join(f"{c} {kinds[c]}" for c in self._columns())

    def _columns(self) -> list[str]:
        asked = [c.strip() for c in self.options.get("columns", "").split(",") if c.strip()]
        return asked or COLUMNS

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options), self._columns())

    def streamReader(self, schema) -> _StreamReader:
        return _StreamReader(dict(self.options), self._columns())


def read_fastx(spark: SparkSession, path: str, columns: str | None = None, max_reads: int | None = None, spread: bool = True, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """Records of a file or folder; with ``max_reads`` the first so many of all files, in their order.

    A file is one task, so rows are spread over the cores right after it.
    """
    spark.dataSource.register(FastxDataSource)

    def load(names: str | None) -> DataFrame:
        reader = spark.read.format("fastx").option("path", path).option("suffixes", ",".join(suffixes))
        reader = reader.option("columns", names) if names else reader
        return (reader.option("max_reads", max_reads) if max_reads is not None else reader).load()

    df = load(columns)
    if max_reads is not None:
        asked = df.columns
        counts = {r["file"]: r["n"] for r in load("file").groupBy("file").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per file
        left, quota = max_reads, []
        for f in sorted(counts):
            quota.append((f, min(left, counts[f])))
            left -= quota[-1][1]
        own = F.broadcast(spark.createDataFrame(quota, "file string, quota bigint"))
        df = load(",".join(dict.fromkeys([*asked, "file", "ord"]))).join(own, "file").where("ord < quota").select(*asked)
    return df.repartition(spark.sparkContext.defaultParallelism) if spread else df


def stream_fastx(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(FastxDataSource)
    return spark.readStream.format("fastx").option("path", path).load()


def read_manifest(spark: SparkSession, manifest: str) -> DataFrame:
    """Records of all inputs of a batch list (input,prefix without a header), with the prefix as a column."""
    out = None
    with open(clean_path(manifest), encoding="utf-8-sig") as f:
        for line in f:
            source, _, prefix = line.strip().partition(",")
            if source:
                df = read_fastx(spark, source, spread=False).withColumn("output_prefix", F.lit(prefix.strip()))
                out = df if out is None else out.unionByName(df)
    if out is None:
        raise ValueError("the batch list is empty")
    return out
