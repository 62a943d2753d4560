"""Folders of part files that become visible by commits: what the package's own data sources share.

Tasks write part files into a folder of their job. The job's commit is one small file that lists the
parts it made, so readers see all of a job or nothing; parts of failed or repeated task attempts are
in no list. Appending jobs do not meet: every commit is a file of its own, and readers put the lists
of all commits since the last overwriting one behind one another.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSourceArrowWriter, WriterCommitMessage

DATA, COMMITS = "data", "commits"
#: bytes a reading task is given, about
TASK_BYTES = 128 << 20


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """File system and folder of a path or URI that driver and executors both reach."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def read_bytes(files: fs.FileSystem, path: str) -> bytes:
    with files.open_input_file(path) as f:
        return f.read()


def write_bytes(files: fs.FileSystem, path: str, data: bytes) -> None:
    with files.open_output_stream(path) as f:
        f.write(data)


@dataclass
class Part:
    """A part file: its path below the root, rows, bytes, and whatever its source says about its content."""

    path: str
    rows: int
    size: int
    about: dict


@dataclass
class Parts(WriterCommitMessage):
    """What a task reports: the part files it finished."""

    parts: list[Part]


def commits(files: fs.FileSystem, root: str) -> list[str]:
    """Commit files in order of their numbers; half-written ones carry another ending."""
    found = files.get_file_info(fs.FileSelector(f"{root}/{COMMITS}", allow_not_found=True))
    return sorted(f.path for f in found if f.type == fs.FileType.File and f.path.endswith(".json"))


def listed(files: fs.FileSystem, root: str) -> list[Part]:
    """Parts a reader sees."""
    seen: list[Part] = []
    for path in commits(files, root):
        entry = json.loads(read_bytes(files, path))
        if entry["overwrite"]:
            seen = []
        seen += [Part(**p) for p in entry["parts"]]
    return seen


class CommittedWriter(DataSourceArrowWriter):
    """Writes part files below `root`; a subclass turns record batches into finished parts."""

    def __init__(self, root: str, overwrite: bool):
        self.root, self.overwrite = root.rstrip("/"), overwrite
        self.job = uuid.uuid4().hex

    def finished(self, files: fs.FileSystem, folder: str, batches) -> list[Part]:
        """Write the task's rows into files of new names below `folder` and describe them."""
        raise NotImplementedError

    def order(self, parts: list[Part]) -> list[Part]:
        """Order of the job's parts in its list."""
        return sorted(parts, key=lambda p: p.path)

    def write(self, iterator) -> Parts:
        files, root = filesystem(self.root)
        folder = f"{root}/{DATA}/{self.job}"
        files.create_dir(folder, recursive=True)
        parts = self.finished(files, folder, iterator)
        for part in parts:
            part.path = part.path.removeprefix(f"{root}/")
        return Parts(parts)

    def commit(self, messages) -> None:
        files, root = filesystem(self.root)
        files.create_dir(f"{root}/{COMMITS}", recursive=True)
        last = commits(files, root)
        number = int(last[-1].rsplit("/", 1)[1].split("-")[0]) + 1 if last else 0
        parts = self.order([p for m in messages if m is not None for p in m.parts])
        path = f"{root}/{COMMITS}/{number:012d}-{self.job}"
        entry = {"overwrite": self.overwrite, "parts": [asdict(p) for p in parts]}
        write_bytes(files, f"{path}.tmp", json.dumps(entry).encode())
        files.move(f"{path}.tmp", f"{path}.json")  # the moment the job becomes visible

    def abort(self, messages) -> None:
        files, root = filesystem(self.root)
        folder = f"{root}/{DATA}/{self.job}"
        if files.get_file_info(folder).type == fs.FileType.Directory:
            files.delete_dir(folder)


def vacuum(path: str) -> int:
    """Delete the folders of jobs that no reader sees (crashed, aborted or overwritten ones); how many there were.

    Not to be called while a job is writing or a reader still uses an overwritten state.
    """
    files, root = filesystem(path.rstrip("/"))
    seen = {p.path.split("/")[1] for p in listed(files, root)}
    found = files.get_file_info(fs.FileSelector(f"{root}/{DATA}", allow_not_found=True))
    gone = [f.path for f in found if f.type == fs.FileType.Directory and f.path.rsplit("/", 1)[1] not in seen]
    for folder in gone:
        files.delete_dir(folder)
    return len(gone)


def bundles(sizes: list[int]) -> list[tuple[int, int]]:
    """Neighbouring places put together until they hold TASK_BYTES: (first, end) of every task."""
    out, first, held = [], 0, 0
    for i, size in enumerate(sizes):
        if i > first and held + size > TASK_BYTES:
            out.append((first, i))
            first, held = i, 0
        held += size
    return [*out, (first, len(sizes))] if sizes else []


def enable_pushdown(spark: SparkSession) -> None:
    """Filters reach Python data sources only with this setting on."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
