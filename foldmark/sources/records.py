"""A data source of interleaved 16-bit records: header texts beside binary files, read in byte ranges by many tasks.

    spark.dataSource.register(Int16Records)
    spark.read.format("int16_records").option("channel", "ppg").load("folder")

gives (record, channel, start, samples): samples of one channel of a record from place `start` on, (x - baseline) / gain, at most `samples` a row. A
file is split where its size asks for it, so a record of any size is read without being in one row or one task. Without the option `channel` all
channels are given; with it only its samples are unpacked.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_LINE = re.compile(r"(?P<file>\S+)\s+16\S*\s+(?P<gain>[0-9.eE+-]+)(?:\((?P<baseline>-?\d+)\))?(?:/(?P<units>\S+))?.*?(?P<name>\S+)\s*\Z")
_SCHEMA = "record string, channel string, start long, samples array<double>"
#: Bytes of a file that one task reads, and samples of a row.
SPLIT_BYTES, ROW_SAMPLES = 64 << 20, 8192


def header(text: str) -> list[dict]:
    """The channels of a header text, in their order in the binary file; raises where a line is none of 16-bit samples."""
    lines = [x for x in text.replace("\r", "").split("\n") if x.strip() and not x.startswith("#")]
    channels = []
    for line in lines[1 : 1 + int(lines[0].split()[1])] if lines else ():
        m = _LINE.match(line)
        if not m or not float(m["gain"]):
            raise ValueError(f"not a channel of 16-bit samples: {line!r}")
        channels.append({"file": m["file"], "gain": float(m["gain"]), "baseline": float(m["baseline"] or 0), "name": m["name"]})
    return channels


class _Range(InputPartition):
    def __init__(self, header_path: str, data_path: str, begin: int, end: int):
        self.header_path, self.data_path, self.begin, self.end = header_path, data_path, begin, end


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.channel = options["path"], options.get("channel")
        self.split, self.row = int(options.get("splitBytes", SPLIT_BYTES)), int(options.get("samples", ROW_SAMPLES))

    def partitions(self):
        """Byte ranges of the binary files that have a header of the same name; only the folder is listed."""
        files, root = fs.FileSystem.from_uri(self.folder) if "://" in self.folder else (fs.LocalFileSystem(), self.folder)
        found = {x.path: x for x in files.get_file_info(fs.FileSelector(root, recursive=True)) if x.is_file}
        ranges = []
        for path, info in sorted(found.items()):
            head = path.rsplit(".", 1)[0] + ".hea"
            if path.endswith(".dat") and head in found:
                ranges += [_Range(head, path, at, min(at + self.split, info.size)) for at in range(0, max(1, info.size), self.split)]
        return ranges

    def read(self, partition: _Range):
        files = fs.FileSystem.from_uri(self.folder)[0] if "://" in self.folder else fs.LocalFileSystem()
        with files.open_input_stream(partition.header_path) as stream:
            channels = header(stream.read().decode())
        width, record = 2 * len(channels), partition.data_path.rsplit("/", 1)[-1].removesuffix(".dat")
        first, last = -(-partition.begin // width), -(-partition.end // width)  # frames that begin in the range
        with files.open_input_file(partition.data_path) as data:
            if data.size() % width:
                raise ValueError(f"{record}: {data.size()} bytes don't divide among {len(channels)} channels")
            for at in range(first, last, self.row):
                n = min(self.row, last - at)
                frames = np.frombuffer(data.read_at(n * width, at * width), "<i2").reshape(-1, len(channels))
                rows = [(c["name"], (frames[:, k].astype(float) - c["baseline"]) / c["gain"]) for k, c in enumerate(channels) if self.channel in (None, c["name"])]
                columns = [pa.array([record] * len(rows)), pa.array([x for x, _ in rows], pa.string()), pa.array([at] * len(rows), pa.int64()), pa.array([x for _, x in rows], pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, ["record", "channel", "start", "samples"])


class Int16Records(DataSource):
    @classmethod
    def name(cls) -> str:
        return "int16_records"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)
