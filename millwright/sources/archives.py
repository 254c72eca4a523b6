"""Archives opened by a table function, a line of a member at a time: `FROM bundles, LATERAL archive_lines(content)`."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from typing import IO

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.functions import udtf

from .files import MEMBERS

#: Lines longer than this are cut into several, so that a member without line ends never stands in memory as a whole.
MOST_LINE = 1 << 20

#: Bytes of members that are read at once, and bytes from which on they are compressed.
SMALL, WORTH = 1 << 16, 1 << 10


@udtf(returnType="member string, line_no bigint, line string")
class ArchiveLines:
    """Members in their order, and their lines, numbered from 1. Members are decompressed as they are read. What isn't an archive, or breaks
    off, gives a row without a line there; null and empty content give none."""

    def eval(self, content: bytes) -> Iterator[tuple]:
        if not content:
            return
        name = None
        try:
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                for info in z.infolist():
                    if info.is_dir():
                        continue
                    name, number = info.filename, 0
                    with _opened(z, info) as lines:
                        while line := lines.readline(MOST_LINE):
                            number += 1
                            yield name, number, line.rstrip(b"\r\n").decode("utf-8", "replace")
        except (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, RuntimeError):
            yield name, None, None


def _opened(z: zipfile.ZipFile, info: zipfile.ZipInfo) -> IO[bytes]:
    """A member to read lines of: a small whole one at once, which is faster; another, or one that breaks off, as it is decompressed."""
    if info.file_size <= SMALL:
        try:
            return io.BytesIO(z.read(info))
        except (zipfile.BadZipFile, zlib.error, EOFError):
            pass  # its first lines may be whole
    return z.open(info)


def pack_members(members: Iterable[tuple[str, str]]) -> bytes:
    """An archive of (name, text) members, of which only those are compressed that are long enough to gain by it."""
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        for name, text in members:
            content = text.encode()
            z.writestr(zipfile.ZipInfo(name), content, zipfile.ZIP_DEFLATED if len(content) > WORTH else zipfile.ZIP_STORED)
    return raw.getvalue()


def archive_lines(archives: DataFrame, content: str = "content") -> DataFrame:
    """All other columns of `archives` with member, line_no, line and kind (of the member, by its name; `broken` where it can't be read)."""
    spark = archives.sparkSession
    spark.udtf.register("archive_lines", ArchiveLines)
    rest = [F.col(f"`{c}`") for c in archives.columns if c != content]
    rows = spark.sql(f"SELECT a.*, m.* FROM {{archives}} a, LATERAL archive_lines(a.`{content}`) m", archives=archives)
    base = F.lower(F.element_at(F.split("member", "/"), -1))
    kind = F.when(F.col("line_no").isNull(), "broken")
    for name, end, begin in MEMBERS:
        kind = kind.when(base.endswith(end) if end else base.startswith(begin), name)
    return rows.select(*rest, "member", "line_no", "line", kind.otherwise("other").alias("kind"))


def read_archive_lines(spark: SparkSession, path: str, pattern: str = "*.zip") -> DataFrame:
    """path, member, line_no, line, kind of the archives in a folder."""
    return archive_lines(spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content"))
