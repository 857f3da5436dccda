"""WAV files as rows of frames, read by byte ranges.

A Spark data source with its own partitions: a long recording is read by many
tasks, each of which seeks to its range, and short ones are read together.  No
task holds more of a file than one block.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from ..operators.audio import WavError, mono, scaled, walk_header
from ..session import ship_package
from .committed import fs_and_path

#: Tasks that small ranges are dealt to at most (more of them if a task would
#: then read more than the bytes beside it): a task costs more than a small file.
TASKS, TASK_BYTES = 256, 64 << 20

SCHEMA = "file_id string, block long, start long, total long, sample_rate int, n_channels int, samples array<float>, error string"


@dataclass
class Ranges(InputPartition):
    """(file id, first byte, byte after the last) of each range of one task."""

    files: list = field(default_factory=list)


class FramesReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.folder = options["path"].rstrip("/")
        self.ext = options.get("ext", ".wav")
        self.block_frames = int(options.get("block_frames", 1 << 16))
        self.split_bytes = int(options.get("split_bytes", 64 << 20))
        if self.block_frames < 1 or self.split_bytes < 1:
            raise ValueError("block_frames and split_bytes must be positive")
        self.ids: set | None = None

    def pushFilters(self, filters) -> Iterator:
        """Conditions on ``file_id`` choose the files: then no folder is listed."""
        for f in filters:
            wanted = None
            if isinstance(f, EqualTo) and f.attribute == ("file_id",):
                wanted = {f.value}
            elif isinstance(f, In) and f.attribute == ("file_id",):
                wanted = set(f.value)
            if wanted is None:
                yield f
            else:
                self.ids = wanted if self.ids is None else self.ids & wanted

    def _files(self) -> list[tuple[str, int]]:
        """(id, bytes) of the files, in the order of their ids."""
        from pyarrow import fs as pafs

        fs, root = fs_and_path(self.folder)
        if fs.get_file_info(root).type != pafs.FileType.Directory:
            raise FileNotFoundError(f"no audio folder {self.folder}")
        if self.ids is None:
            found = fs.get_file_info(pafs.FileSelector(root, recursive=True))
        else:
            from .audio import exist

            names = [f"{root}/{i}{self.ext}" for i in self.ids if i]
            there = [n for n, ok in zip(names, exist(fs, names)) if ok]
            found = fs.get_file_info(there) if there else []
        out = []
        for info in found:
            inside = info.path[len(root):].lstrip("/")
            if info.type == pafs.FileType.File and inside.endswith(self.ext) and not inside.startswith("_staging-"):
                out.append((inside[:len(inside) - len(self.ext)], info.size))
        return sorted(out)

    def partitions(self) -> list[Ranges]:
        """Ranges of ``split_bytes`` at most, as many to a task as fit into
        ``split_bytes`` or, where that makes too many tasks, a share of all."""
        files = self._files()
        share = -(-sum(max(total, 1) for _, total in files) // TASKS)
        most = max(self.split_bytes, min(share, TASK_BYTES))
        out, size = [Ranges()], 0
        for name, total in files:
            at = 0
            while at < max(total, 1):
                end = min(at + self.split_bytes, max(total, 1))
                if size and size + end - at > most:
                    out.append(Ranges())
                    size = 0
                out[-1].files.append((name, at, end))
                size += end - at
                at = end
        return out

    def read(self, partition: Ranges) -> Iterator[tuple]:
        for name, begin, end in partition.files:
            fs, rel = fs_and_path(f"{self.folder}/{name}{self.ext}")
            try:
                with fs.open_input_file(rel) as f:
                    h = walk_header(lambda at, n: f.read_at(n, at), f.size())  # noqa: B023
                    yield from self._blocks(name, f, h, begin, end)
            except (WavError, struct.error, OSError) as e:
                if begin == 0:  # a bad file is one row, however many ranges it has
                    yield (name, None, None, None, None, None, None, str(e))

    def _blocks(self, name: str, f, h: dict, begin: int, end: int) -> Iterator[tuple]:
        """The blocks whose first byte lies in the range."""
        frames, step = h["n_frames"], self.block_frames * h["block_align"]
        if not frames and begin == 0:
            yield (name, 0, 0, 0, h["sample_rate"], h["channels"], [], None)
        block = max(0, -(-(begin - h["data_offset"]) // step))
        while block * self.block_frames < frames and h["data_offset"] + block * step < end:
            start = block * self.block_frames
            size = min(self.block_frames, frames - start)
            raw = f.read_at(size * h["block_align"], h["data_offset"] + block * step)
            yield (name, block, start, frames, h["sample_rate"], h["channels"], mono(scaled(raw, h)).tolist(), None)
            block += 1


class WavFrames(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wav_frames"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FramesReader:
        return FramesReader(dict(self.options))


def read_audio_frames(spark: SparkSession, audio_dir: str, ext: str = ".wav", block_frames: int = 1 << 16, split_bytes: int = 64 << 20) -> DataFrame:
    """``file_id, block, start, total, sample_rate, n_channels, samples, error``:
    every file below ``audio_dir`` in blocks of ``block_frames`` frames, mixed
    to one channel; a range is ``split_bytes`` bytes, a task reads one or, of
    more than some hundred ranges, several.  A file without
    frames has one empty block; one that is no WAV file has one row with an
    ``error``.  Conditions on ``file_id`` are pushed into the source."""
    ship_package(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WavFrames)
    options = {"ext": ext, "block_frames": str(block_frames), "split_bytes": str(split_bytes)}
    return spark.read.format("wav_frames").options(**options).load(audio_dir)
