"""Audio files on a (shared) file system."""

from __future__ import annotations

from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package
from .committed import CommittedFiles, fs_and_path


def list_audio(spark: SparkSession, audio_dir: str, ext: str = ".wav", recursive: bool = True) -> DataFrame:
    """``path, length, modificationTime`` of the audio files under a folder.

    The listing is held by the driver and skips names that begin with ``_``
    or ``.``; to test which of many ids have a file use
    :func:`with_existence`.

    Only listing columns are selected, so the ``binaryFile`` source never
    reads file content here."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*" + ext)
        .option("recursiveFileLookup", str(recursive).lower())
        .load(audio_dir)
        .select("path", "length", "modificationTime")
    )


def read_audio(spark: SparkSession, audio_dir: str, ext: str = ".wav", recursive: bool = True) -> DataFrame:
    """``path, length, content`` of every audio file (whole files)."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*" + ext)
        .option("recursiveFileLookup", str(recursive).lower())
        .load(audio_dir)
        .select("path", "length", "content")
    )


def with_existence(df: DataFrame, audio_dir: str, ext: str = ".wav", id_col: str = "file_id") -> DataFrame:
    """``df`` with ``has_audio``: whether the file ``audio_dir/(id + ext)`` exists.

    The ids drive the check, inside the tasks, a batch of paths at a time; no
    folder is listed and no listing reaches the driver.  As with path joins,
    an id with slashes addresses a subfolder and an absolute id replaces the
    folder.  ``audio_dir`` may be relative (to the driver's folder), end in a
    slash or be a URI of a file system that pyarrow knows; a missing folder
    raises.  Null ids have no audio, nor have ids that no file can have
    (longer than a file name, with U+0000)."""
    import os
    import posixpath

    from pyarrow import fs as pafs

    ship_package(df.sparkSession)
    if "://" not in audio_dir and not audio_dir.startswith("file:"):
        audio_dir = os.path.abspath(audio_dir)
    fs, root = fs_and_path(audio_dir)
    if fs.get_file_info(root).type != pafs.FileType.Directory:
        raise FileNotFoundError(f"no audio folder {audio_dir}")
    # the key travels beside the other columns in one struct
    packed = df.select(F.struct(*df.columns).alias("row"), F.col(id_col).cast("string").alias("id"))
    row = packed.schema["row"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        fs, root = fs_and_path(audio_dir)
        for b in batches:
            ids = b["id"].to_pylist()
            paths = [posixpath.normpath(posixpath.join(root, i + ext)) for i in ids if i is not None]
            found = iter(exist(fs, paths))
            yield pa.RecordBatch.from_arrays(
                [b["row"], pa.array([False if i is None else next(found) for i in ids], pa.bool_())], names=["row", "has_audio"])

    out = packed.mapInArrow(run, f"row {row}, has_audio boolean")
    return out.select("row.*", "has_audio")


def exist(fs, paths: list[str]) -> list[bool]:
    """Whether each path exists, asked at once; path by path if one of them
    is no possible name."""
    from pyarrow import fs as pafs

    try:
        return [info.type != pafs.FileType.NotFound for info in (fs.get_file_info(paths) if paths else [])]
    except (OSError, ValueError):  # pyarrow's ArrowInvalid is a ValueError
        if len(paths) == 1:
            if "\0" in paths[0] or max(len(part.encode()) for part in paths[0].split("/")) > 255:
                return [False]
            raise
        half = len(paths) // 2
        return exist(fs, paths[:half]) + exist(fs, paths[half:])


def read_headers(df: DataFrame, path_col: str = "path") -> DataFrame:
    """``df`` with the header fields and ``error`` of each listed WAV file.
    Chunks are walked by seeking, a few bytes each: audio never leaves
    storage, and chunks of any size may stand before the audio."""
    from ..operators.audio import HEADER_FIELDS, header_row, header_type

    ship_package(df.sparkSession)
    packed = df.select(F.struct(*df.columns).alias("row"), F.col(path_col).alias("path"))
    row = packed.schema["row"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = []
            for path in b["path"].to_pylist():
                try:
                    fs, rel = fs_and_path(path)
                    with fs.open_input_file(rel) as f:
                        rows.append(header_row(lambda at, n: f.read_at(n, at), f.size()))
                except (OSError, TypeError, AttributeError) as e:
                    rows.append(dict.fromkeys(HEADER_FIELDS) | {"error": str(e)})
            yield pa.RecordBatch.from_arrays([b["row"], pa.array(rows, header_type())], names=["row", "header"])

    schema = ", ".join(f"{k}: {t}" for k, t in HEADER_FIELDS.items()).replace(": ", ":")
    return packed.mapInArrow(run, f"row {row}, header struct<{schema}>").select("row.*", "header.*")


def read_contents(df: DataFrame, path_col: str = "path", max_bytes: int | None = None) -> DataFrame:
    """Add ``content`` by reading each listed file inside the tasks.

    Use after the listing has been joined/filtered, so only the files that
    are needed are read (a join cannot prune a ``binaryFile`` scan).  With
    ``max_bytes`` only the first bytes of each file are read; header checks
    use :func:`read_headers` instead."""
    ship_package(df.sparkSession)
    cols = df.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for p in pdf[path_col]:
                fs, rel = fs_and_path(p)
                with fs.open_input_stream(rel) as f:
                    out.append(f.read() if max_bytes is None else f.read(max_bytes))
            yield pdf.assign(content=out)

    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + ", content binary"
    return df.mapInPandas(run, schema).select(*cols, "content")


def write_wav_files(df: DataFrame, out_dir: str, id_col: str, content_col: str = "content") -> DataFrame:
    """Write every row's bytes to ``<out_dir>/<id>.wav``; returns ``id, path``
    of the written rows.

    The files appear when all tasks are done
    (:mod:`vocaframe.sources.committed`): a failed job leaves none, and a
    reader never meets half a file.  A null id or content, or an id that
    leads out of the folder, fails the job."""
    spark = df.sparkSession
    ship_package(spark)
    spark.dataSource.register(CommittedFiles)
    base = out_dir.rstrip("/")
    named = df.select(F.col(id_col).cast("string").alias("id"), F.col(content_col).alias("content"))
    named.select(F.concat("id", F.lit(".wav")).alias("name"), "content").write.format("committed_files").mode("append").save(base)
    return named.select("id", F.concat(F.lit(base + "/"), "id", F.lit(".wav")).alias("path"))
