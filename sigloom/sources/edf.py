"""EDF and EDF+ files: a Python data source with a row per signal and range of records.

``spark.read.format("edf")`` takes options ``path``, ``channels`` (labels, comma-joined:
the others are never read), ``records`` (data records per row, default 600), and ``table``:
"signals" (default) or "annotations".  Paths are read through the Hadoop file system by
``read_edf``, which parses ``binaryFile`` rows, or, by the data source, from a folder that
all executors see.
"""

from __future__ import annotations

import datetime as dt
import glob
import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ANNOTATIONS = "EDF Annotations"
SIGNALS_SCHEMA = "file string, signal string, unit string, rate double, start_time timestamp, first_record bigint, first_sample bigint, samples array<double>"
ANNOTATIONS_SCHEMA = "file string, seq int, onset_s double, duration_s double, text string"
#: Bytes of each header field, and of each field of a signal.
HEADER_FIELDS = (("version", 8), ("patient", 80), ("recording", 80), ("date", 8), ("time", 8), ("size", 8), ("reserved", 44), ("records", 8), ("seconds", 8), ("signals", 4))
SIGNAL_FIELDS = (("label", 16), ("transducer", 80), ("unit", 8), ("physical_min", 8), ("physical_max", 8), ("digital_min", 8), ("digital_max", 8), ("filter", 80), ("samples", 8), ("reserved", 32))


class EdfError(ValueError):
    """A file that is not what its header says."""


@dataclass(frozen=True)
class Channel:
    label: str
    unit: str
    scale: float
    offset: float
    samples: int  # per data record
    at: int  # place of its samples in a record

    def physical(self, digital: np.ndarray) -> np.ndarray:
        return digital * self.scale + self.offset


@dataclass(frozen=True)
class Header:
    start: dt.datetime | None
    size: int
    records: int
    seconds: float
    channels: tuple[Channel, ...]

    @property
    def record_samples(self) -> int:
        return sum(c.samples for c in self.channels)


def _fields(raw: bytes, layout, times: int = 1) -> dict[str, list[str]]:
    out, at = {}, 0
    for name, width in layout:
        out[name] = [raw[at + i * width : at + (i + 1) * width].decode("ascii", "replace").strip() for i in range(times)]
        at += width * times
    return out


def start_time(date: str, time: str) -> dt.datetime | None:
    """dd.mm.yy and hh.mm.ss; years from 85 on are of the twentieth century.  None if it is no date."""
    try:
        day, month, year = (int(x) for x in date.split("."))
        hour, minute, second = (int(x) for x in time.split("."))
        return dt.datetime(year + (1900 if year >= 85 else 2000), month, day, hour, minute, second, tzinfo=dt.UTC)
    except ValueError:
        return None


def parse_header(raw: bytes, file_size: int) -> Header:
    """The header; the number of records follows from the file's size, and a file that lacks declared ones is refused."""
    if len(raw) < 256:
        raise EdfError("shorter than a header")
    h = {k: v[0] for k, v in _fields(raw[:256], HEADER_FIELDS).items()}
    try:
        n, size, seconds, declared = int(h["signals"]), int(h["size"]), float(h["seconds"]), int(h["records"])
        s = _fields(raw[256:], SIGNAL_FIELDS, n)
        channels, at = [], 0
        for i in range(n):
            lo, hi, dlo, dhi = (float(s[k][i]) for k in ("physical_min", "physical_max", "digital_min", "digital_max"))
            scale = (hi - lo) / (dhi - dlo) if dhi != dlo else 1.0
            count = int(s["samples"][i])
            channels.append(Channel(s["label"][i], s["unit"][i], scale, lo - dlo * scale, count, at))
            at += count
    except ValueError as e:
        raise EdfError(f"unreadable header: {e}") from e
    held = (file_size - size) // (2 * at) if at else 0
    if declared > held:
        raise EdfError(f"truncated: {declared} records declared, {held} held")
    return Header(start_time(h["date"], h["time"]), size, held if declared < 0 else declared, seconds, tuple(channels))


def records_matrix(raw: bytes, header: Header) -> np.ndarray:
    return np.frombuffer(raw, "<i2", len(raw) // 2).reshape(-1, header.record_samples)


def tals(data: bytes) -> Iterator[tuple[float, float, str]]:
    """(onset, duration, text) of time-stamped annotation lists; those without text only keep time."""
    for block in data.split(b"\x00"):
        head, *texts = block.split(b"\x14")
        onset, _, duration = head.partition(b"\x15")
        try:
            at = float(onset)
        except ValueError:
            continue
        try:
            length = float(duration) if duration else 0.0
        except ValueError:
            length = 0.0
        for text in texts:
            if text:
                yield at, length, text.decode("utf-8", "replace")


def signal_rows(file: str, raw: bytes, header: Header, first: int, channels: set[str] | None) -> Iterator[tuple]:
    """A row per wanted channel of consecutive records."""
    matrix = records_matrix(raw, header)
    for c in header.channels:
        if c.label != ANNOTATIONS and (channels is None or c.label in channels):
            x = c.physical(matrix[:, c.at : c.at + c.samples].reshape(-1).astype(float))
            yield (file, c.label, c.unit, c.samples / header.seconds, header.start, first, first * c.samples, x.tolist())


def annotation_rows(file: str, raw: bytes, header: Header) -> Iterator[tuple]:
    seq, matrix = 0, records_matrix(raw, header)
    for c in header.channels:
        if c.label == ANNOTATIONS:
            for onset, length, text in tals(matrix[:, c.at : c.at + c.samples].tobytes()):
                yield file, seq, onset, length, text
                seq += 1


class EdfSource(DataSource):
    """Registered as "edf"; a partition is a range of records of one file."""

    @classmethod
    def name(cls) -> str:
        return "edf"

    def schema(self) -> str:
        return ANNOTATIONS_SCHEMA if self.options.get("table") == "annotations" else SIGNALS_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return EdfReader(dict(self.options))


@dataclass
class _Range(InputPartition):
    path: str
    first: int
    end: int


class EdfReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options
        path = options["path"]
        self.files = sorted(glob.glob(f"{path}/**/*.edf", recursive=True)) if os.path.isdir(path) else sorted(glob.glob(path))
        wanted = options.get("channels")
        self.channels = {x.strip() for x in wanted.split(",")} if wanted else None

    @staticmethod
    def header(path: str) -> Header:
        with open(path, "rb") as f:
            raw = f.read(256)
            size = int(raw[184:192] or 0)
            return parse_header(raw + f.read(size - 256), os.path.getsize(path))

    def partitions(self) -> list[_Range]:
        if not self.files:
            raise FileNotFoundError(self.options["path"])
        if self.options.get("table") == "annotations":
            return [_Range(p, 0, -1) for p in self.files]
        step = int(self.options.get("records", 600))
        return [_Range(p, i, min(i + step, n)) for p in self.files for n in [self.header(p).records] for i in range(0, n, step)]

    def read(self, part: _Range) -> Iterator[tuple]:
        header = self.header(part.path)
        width = 2 * header.record_samples
        end = header.records if part.end < 0 else part.end
        with open(part.path, "rb") as f:
            f.seek(header.size + part.first * width)
            raw = f.read((end - part.first) * width)
        name = os.path.basename(part.path)
        if self.options.get("table") == "annotations":
            yield from annotation_rows(name, raw, header)
        else:
            yield from signal_rows(name, raw, header, part.first, self.channels)


def read_edf(spark: SparkSession, path: str, table: str = "signals", channels: list[str] | None = None) -> DataFrame:
    """Whole files through Spark's own readers, so any store that Spark reads will do.

    Files that cannot be parsed give one row with ``error`` and nothing else.
    """
    schema = ANNOTATIONS_SCHEMA if table == "annotations" else SIGNALS_SCHEMA
    wanted = set(channels) if channels else None
    arrow = pa.schema([("file", pa.string()), ("seq", pa.int32()), ("onset_s", pa.float64()), ("duration_s", pa.float64()), ("text", pa.string())]) if table == "annotations" else pa.schema([("file", pa.string()), ("signal", pa.string()), ("unit", pa.string()), ("rate", pa.float64()), ("start_time", pa.timestamp("us", tz="UTC")), ("first_record", pa.int64()), ("first_sample", pa.int64()), ("samples", pa.list_(pa.float64()))])
    arrow = arrow.append(pa.field("error", pa.string()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, raw in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                file, data = name.rsplit("/", 1)[-1], raw.as_py()
                try:
                    header = parse_header(data[: 256 * (1 + int(data[252:256] or 0))], len(data))
                    body = data[header.size : header.size + 2 * header.record_samples * header.records]
                    found = list(annotation_rows(file, body, header)) if table == "annotations" else list(signal_rows(file, body, header, 0, wanted))
                    found = [(*x, None) for x in found]
                except (EdfError, ValueError) as e:
                    found = [(file, *[None] * (len(arrow) - 2), str(e))]
                yield pa.record_batch([pa.array([x[k] for x in found], f.type) for k, f in enumerate(arrow)], schema=arrow)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.edf").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(run, schema + ", error string")


def write_edf(path: str, channels: list[tuple[str, str, int, np.ndarray]], seconds: float, annotations: list[tuple[float, float, str]] = (), start: str = "01.01.17", time: str = "00.00.00", span: tuple[float, float] = (-100.0, 100.0), declared: int | None = None) -> None:
    """A small EDF+ file: (label, unit, samples per record, samples) per channel; annotations as one channel."""
    records = max([len(x) // n for _, _, n, x in channels], default=1)
    note = b"".join(f"+{a:g}\x15{d:g}\x14{t}\x14\x00".encode() for a, d, t in annotations)
    width = -(-max(len(note), 2) // (2 * records)) if annotations else 0
    rows = [(label, unit, n) for label, unit, n, _ in channels] + ([(ANNOTATIONS, "", width)] if annotations else [])
    columns = {
        "label": [r[0] for r in rows],
        "transducer": [""] * len(rows),
        "unit": [r[1] for r in rows],
        "physical_min": [f"{span[0]:g}"] * len(rows),
        "physical_max": [f"{span[1]:g}"] * len(rows),
        "digital_min": ["-2048"] * len(rows),
        "digital_max": ["2047"] * len(rows),
        "filter": [""] * len(rows),
        "samples": [str(r[2]) for r in rows],
        "reserved": [""] * len(rows),
    }
    head = {"version": "0", "patient": "X", "recording": "X", "date": start, "time": time, "size": str(256 * (1 + len(rows))), "reserved": "EDF+C", "records": str(records if declared is None else declared), "seconds": f"{seconds:g}", "signals": str(len(rows))}
    scale = (span[1] - span[0]) / 4095
    note = note.ljust(2 * records * width, b"\x00")
    with open(path, "wb") as f:
        f.write(b"".join(head[k].ljust(w).encode() for k, w in HEADER_FIELDS))
        f.write(b"".join(v.ljust(w).encode() for k, w in SIGNAL_FIELDS for v in columns[k]))
        for i in range(records):
            for _, _, n, x in channels:
                f.write(np.clip(np.round((np.asarray(x[i * n : (i + 1) * n]) - span[0]) / scale) - 2048, -2048, 2047).astype("<i2").tobytes())
            f.write(note[2 * i * width : 2 * (i + 1) * width])


def file_digest(spark: SparkSession, path: str) -> DataFrame:
    """file, length and SHA-256 of whole files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "length", F.sha2("content", 256).alias("digest"))


def sample_digest(samples: np.ndarray) -> str:
    return hashlib.sha256(np.ascontiguousarray(samples).tobytes()).hexdigest()
