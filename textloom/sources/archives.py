"""Uploads to files: single files, folders, and zip, tar and gzip archives.

Every upload is one row of Spark's binary files; archives are unpacked in Arrow batches, one archive at a time, so an archive has to
fit in a task's memory, but not several of them.
"""

from __future__ import annotations

import gzip
import io
import posixpath
import re
import tarfile
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators.skeleton import SKELETON

MODES = ("archive", "many", "folder", "skeleton")
FILES = "upload string, submission string, dirs array<string>, filename string, extension string, content string, size long, line_count int, nonempty_line_count int, sha512 string, problem string"


def split_name(path: str) -> tuple[str, str]:
    """Base name and extension; a name that only begins with a dot has no extension."""
    name = posixpath.basename(path)
    base, dot, extension = name.rpartition(".")
    return (base, extension) if dot and base else (name, "")


def count_lines(text: str) -> tuple[int, int]:
    """Lines as a line reader gives them, and those that aren't ''."""
    lines = re.split(r"\r\n|\n|\r", text)
    if lines[-1] == "":
        lines.pop()
    return len(lines), sum(x != "" for x in lines)


def entries(name: str, data: bytes) -> Iterator[tuple[str, bytes]]:
    """(path, bytes) of the files in an upload; one that isn't an archive is its own only file. Directories and links are skipped, and
    what tries to leave the archive is kept under its own name."""
    lower = name.lower()
    if lower.endswith(".zip"):
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for info in z.infolist():
                if not info.is_dir():
                    yield _inner(info.filename), z.read(info)
    elif lower.endswith((".tar", ".tgz", ".tar.gz")):
        with tarfile.open(fileobj=io.BytesIO(data), mode="r:*") as t:
            for member in t:
                if member.isfile():
                    yield _inner(member.name), t.extractfile(member).read()
    elif lower.endswith(".gz"):
        yield from entries(name[:-3], gzip.decompress(data))
    else:
        yield posixpath.basename(name), data


def _inner(path: str) -> str:
    return "/".join(p for p in path.replace("\\", "/").split("/") if p not in ("", ".", ".."))


def is_archive(name: str) -> bool:
    return name.lower().endswith((".zip", ".tar", ".tgz", ".gz"))


def place(upload: str, path: str, mode: str, archive: bool) -> tuple[str, list[str]] | None:
    """Submission and directories of a file of an upload; None for one that the mode leaves out.

    archive: an archive, or a file, is a submission. many: the first directory is the submission, and files outside of any are left
    out. folder: likewise, but such files are a submission each. skeleton: all is given code.
    """
    dirs = path.split("/")[:-1]
    if mode == "skeleton":
        return SKELETON, dirs
    if mode == "many":
        return (dirs[0], dirs[1:]) if dirs else None
    if mode == "folder":
        return (dirs[0], dirs[1:]) if dirs else (split_name(path)[0], [])
    return (re.sub(r"\.(zip|tar|tgz|tar\.gz|gz)$", "", posixpath.basename(upload), flags=re.I) if archive else split_name(upload)[0]), dirs


def strip_common(paths: list[str]) -> list[str]:
    """Paths without the first directory, where all share it and none lies directly in it alone."""
    tops = {p.split("/")[0] for p in paths}
    return [p.split("/", 1)[1] for p in paths] if len(tops) == 1 and all("/" in p for p in paths) else paths


def unpack(binaries: DataFrame, mode: str = "archive", root: str | None = None) -> DataFrame:
    """One row for each file of uploads (path, content), as FILES says.

    With ``root`` the place of an upload below it gives its directories. Bytes that aren't UTF-8 are replaced. An upload that can't be
    read has one row with its problem and no content; one without files has none.
    """
    if mode not in MODES:
        raise ValueError(f"mode has to be one of {MODES}")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        kinds = [("upload", pa.string()), ("submission", pa.string()), ("dirs", pa.list_(pa.string())), ("filename", pa.string()), ("extension", pa.string()), ("content", pa.string()), ("size", pa.int64()), ("line_count", pa.int32()), ("nonempty_line_count", pa.int32()), ("sha512", pa.string()), ("problem", pa.string())]
        for b in batches:
            rows: list[tuple] = []
            for upload, data in zip(b.column(0).to_pylist(), b.column(1)):
                name = posixpath.basename(upload)
                archive = is_archive(name)
                try:
                    found = list(entries(name, data.as_py()))
                    if root is not None and not archive:
                        found = [(_inner(upload.split(root.rstrip("/"), 1)[-1]), x) for _, x in found]
                    if mode == "folder" and archive and len(found) > 1:
                        paths = strip_common([p for p, _ in found])
                        # a folder packed as a whole: its own directories are the submissions
                        found = [(p, x) for p, (_, x) in zip(paths, found)] if any("/" in p for p in paths) else found
                except Exception as e:
                    rows.append((upload, None, None, name, None, None, len(data.as_py()), None, None, None, f"{type(e).__name__}: {e}"[:300]))
                    continue
                for path, x in found:
                    where = place(upload, path, mode, archive)
                    if where is None:
                        continue
                    base, extension = split_name(path)
                    text = x.decode("utf-8", "replace")
                    rows.append((upload, where[0], where[1], base, extension, text, len(x), *count_lines(text), hashlib.sha512(x).hexdigest(), None))
            cols = list(zip(*rows)) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, (_, t) in zip(cols, kinds)], names=[n for n, _ in kinds])

    return binaries.select("path", "content").mapInArrow(read, FILES)


def read_uploads(spark: SparkSession, path: str, mode: str = "archive") -> DataFrame:
    """Files of all uploads below a path."""
    binaries = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return unpack(binaries, mode, root=path if mode in ("many", "folder", "skeleton") else None)
