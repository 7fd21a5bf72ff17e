"""The wearable archive: a zip with one pickle per subject, read member by member.

``spark.read.format("wearable_zip")`` gives signals (one row per subject, signal axis and
chunk) or, with option ``table`` = "labels", runs of the label track.  A partition is one
subject and device, so a filter on subjects (option ``subjects``) opens only their members.
Pickles load through a list of allowed names; anything else is refused.
"""

from __future__ import annotations

import io
import pickle
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .. import schemas

SIGNALS_SCHEMA = "subject_id string, device string, signal string, rate double, chunk int, first_sample bigint, samples array<double>"
LABELS_SCHEMA = "subject_id string, code int, label string, begin_s double, end_s double"
#: What a pickle of arrays may name, under both spellings of numpy's core.
ALLOWED = {(f"numpy.{core}.{m}", n) for core in ("core", "_core") for m, n in (("multiarray", "_reconstruct"), ("multiarray", "scalar"), ("numeric", "_frombuffer"))}
ALLOWED |= {("numpy", "ndarray"), ("numpy", "dtype"), ("_codecs", "encode"), ("builtins", "bytearray")}


class ArrayUnpickler(pickle.Unpickler):
    def find_class(self, module: str, name: str):
        if (module, name) not in ALLOWED:
            raise pickle.UnpicklingError(f"{module}.{name} is not allowed")
        return super().find_class(module, name)


def load_arrays(data: bytes | io.BufferedIOBase):
    return ArrayUnpickler(io.BytesIO(data) if isinstance(data, bytes) else data, encoding="latin1").load()


def subjects_of(names: list[str]) -> dict[str, str]:
    """Subject and member, in the order of the subjects' numbers."""
    found = {m[1]: n for n in names if (m := re.fullmatch(r"(?:.*/)?(\w+)/\1\.pkl", n))}
    return dict(sorted(found.items(), key=lambda x: (re.sub(r"\d+$", "", x[0]), int(re.search(r"(\d*)$", x[0])[1] or 0))))


def label_runs(codes: np.ndarray, rate: float = schemas.LABEL_RATE) -> Iterator[tuple[int, str | None, float, float]]:
    """(code, label, begin, end) of the runs of equal codes; codes without a label have none."""
    codes = np.asarray(codes).ravel()
    edge = np.flatnonzero(np.diff(codes)) + 1
    for i, j in zip(np.append(0, edge), np.append(edge, len(codes)), strict=True):
        if j > i:
            yield int(codes[i]), schemas.LABELS.get(int(codes[i])), i / rate, j / rate


class WearableSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wearable_zip"

    def schema(self) -> str:
        return LABELS_SCHEMA if self.options.get("table") == "labels" else SIGNALS_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WearableReader(dict(self.options))


@dataclass
class _Member(InputPartition):
    subject: str
    member: str
    device: str


class WearableReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.table = options["path"], options.get("table", "signals")
        self.devices = [d.strip() for d in options.get("devices", "wrist,chest").split(",")]
        self.subjects = {s.strip() for s in options["subjects"].split(",")} if options.get("subjects") else None
        self.chunk_seconds = float(options.get("chunk_seconds", 600))

    def partitions(self) -> list[_Member]:
        with zipfile.ZipFile(self.path) as z:
            found = subjects_of(z.namelist())
        chosen = {s: m for s, m in found.items() if self.subjects is None or s in self.subjects}
        return [_Member(s, m, d) for s, m in chosen.items() for d in (self.devices if self.table == "signals" else [""])]

    def read(self, part: _Member) -> Iterator[tuple]:
        with zipfile.ZipFile(self.path) as z, z.open(part.member) as f:
            data = load_arrays(f.read())
        if self.table == "labels":
            yield from ((part.subject, *run) for run in label_runs(data["label"]))
            return
        for signal, x in data["signal"].get(part.device, {}).items():
            rate = schemas.rate_of(signal, part.device)
            x = np.asarray(x, float).reshape(len(x), -1)
            step = int(self.chunk_seconds * rate)
            for name, column in zip(schemas.channels_of(signal) if x.shape[1] == 3 else [signal], x.T, strict=True):
                for k, i in enumerate(range(0, len(column), step)):
                    yield part.subject, part.device, name, rate, k, i, column[i : i + step].tolist()
