"""Files that appear whole or not at all: a sink with staged names and a commit.

Tasks write under a staging folder beside the target, each attempt in a folder
of its own.  When all tasks are done the driver moves the files of the
attempts that counted to their names and removes the staging folder; when the
job fails it removes the staging folder alone.  A lost or repeated task leaves
nothing behind, and a reader never sees half a file.
"""

from __future__ import annotations

import os
import posixpath
import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

#: Renames that run at the same time.
MOVERS = 32

#: How often the staging folder is tried to be removed.
TRIES = 20


def fs_and_path(path: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs as pafs

    if path.startswith("file:"):
        path = path[len("file:"):]
        while path.startswith("//"):
            path = path[1:]
        return pafs.LocalFileSystem(), path
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def inner_name(name: str) -> str:
    """``name`` as a path below a folder; one that leads out of it, is empty
    or holds U+0000 is an error."""
    rel = posixpath.normpath(name)
    if not name or "\0" in name or rel.startswith(("/", "../")) or rel in (".", ".."):
        raise ValueError(f"no file name inside the folder: {name!r}")
    return rel


class Staging:
    """Staged files of one job; made on the driver, used by its tasks.

    The driver alone makes the staging folder: a task that goes on after the
    driver removed it finds no place to write to."""

    def __init__(self, folder: str) -> None:
        self.folder = folder.rstrip("/")
        self.root = f"{self.folder}/_staging-{os.urandom(8).hex()}"
        fs, root = fs_and_path(self.root)
        fs.create_dir(root, recursive=True)

    def attempt(self) -> str:
        """A folder for the running task's attempt."""
        from pyspark import TaskContext

        context = TaskContext.get()
        task = f"{context.partitionId()}-{context.taskAttemptId()}" if context else "0"
        return f"{self.root}/{task}-{os.urandom(4).hex()}"

    def put(self, attempt: str, name: str, content: bytes, made: set | None = None) -> None:
        """Write one staged file; a name that comes twice keeps the last content."""
        fs, path = fs_and_path(f"{attempt}/{inner_name(name)}")
        parent = posixpath.dirname(path)
        made = set() if made is None else made
        if parent not in made:
            _, at = fs_and_path(self.root)
            for part in posixpath.relpath(parent, at).split("/"):
                at = f"{at}/{part}"
                if at not in made:
                    fs.create_dir(at, recursive=False)
                    made.add(at)
        with fs.open_output_stream(path) as f:
            f.write(content)

    def commit(self, attempts: list[str]) -> int:
        """Move the attempts' files to their names; the number of files."""
        from pyarrow import fs as pafs

        fs, target = fs_and_path(self.folder)
        fs.create_dir(target, recursive=True)
        moved = 0
        with ThreadPoolExecutor(MOVERS) as pool:
            for attempt in attempts:
                _, base = fs_and_path(attempt)
                found = fs.get_file_info(pafs.FileSelector(base, allow_not_found=True, recursive=True))
                names = [posixpath.relpath(x.path, base) for x in found if x.type == pafs.FileType.File]
                for parent in sorted({posixpath.dirname(n) for n in names} - {""}):
                    fs.create_dir(f"{target}/{parent}", recursive=True)
                moved += len(list(pool.map(lambda n: fs.move(f"{base}/{n}", f"{target}/{n}"), names)))  # noqa: B023
        self.abort()
        return moved

    def abort(self) -> None:
        """Remove what is staged; tried again while a task still writes."""
        from pyarrow import fs as pafs

        fs, root = fs_and_path(self.root)
        for left in reversed(range(TRIES)):
            try:
                if fs.get_file_info(root).type != pafs.FileType.NotFound:
                    fs.delete_dir(root)
                return
            except OSError:
                if not left:
                    raise
                time.sleep(0.1)


@dataclass
class Written(WriterCommitMessage):
    """An attempt's folder; names stay in storage, so that a message is small
    however many files a task has."""

    attempt: str


class FilesWriter(DataSourceArrowWriter):
    def __init__(self, folder: str) -> None:
        self.staging = Staging(folder)

    def write(self, iterator) -> Written:
        attempt, made = self.staging.attempt(), set()
        for batch in iterator:
            for name, content in zip(batch["name"].to_pylist(), batch["content"]):
                if name is None or not content.is_valid:
                    raise ValueError("a file needs a name and content")
                self.staging.put(attempt, name, content.as_buffer(), made)
        return Written(attempt)

    def commit(self, messages) -> None:
        self.staging.commit([m.attempt for m in messages if m])

    def abort(self, messages) -> None:
        self.staging.abort()


class CommittedFiles(DataSource):
    """``df.write.format("committed_files").mode("append").save(folder)``:
    rows of ``name string, content binary`` as files below ``folder``.
    A file of the same name is replaced; other files of the folder stay."""

    @classmethod
    def name(cls) -> str:
        return "committed_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> FilesWriter:
        if overwrite:
            raise ValueError("files are added to a folder: use mode('append')")
        return FilesWriter(self.options["path"])
