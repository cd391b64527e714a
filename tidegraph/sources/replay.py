"""Replay of stored files in the order of their numbers.

Spark's file source takes files in the order of their modification times. Here a
stream's offsets are the numbers that files are named after: its rows name the next
files, and every micro-batch reads those, as splittable text, where it wants them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FORMAT = "numbered_files"
NUMBERED = "number long, path string"


def register(spark: SparkSession) -> None:
    """Make the source known to a session.

    Options: ``path``; ``first``, the number to begin with (0); ``filesPerBatch`` (1);
    ``dispose``, ``delete`` or ``archive`` (into ``archiveDir``) for files whose
    micro-batch has been committed, kept otherwise. Files are named ``7`` or
    ``7.txt``; a number that is missing is waited for, as its file may still come.
    The folder is one that ``pyarrow.fs`` opens (local, HDFS, S3 or GCS).
    """
    from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

    # Defined here, so that they are sent to Spark's processes as they are and need
    # no package there.
    class Reader(SimpleDataSourceStreamReader):
        def __init__(self, options):
            self.folder = options["path"]
            self.first = int(options.get("first", 0))
            self.most = int(options.get("filesPerBatch", 1))
            self.dispose = options.get("dispose", "keep")
            self.archive = options.get("archiveDir")
            if self.dispose not in ("keep", "delete", "archive"):
                raise ValueError(f"unknown way to dispose of files: {self.dispose!r}")

        def _files(self):
            """Number -> name of the files that are there, and the file system."""
            import re

            from pyarrow import fs

            uri = self.folder
            if uri.startswith("file:/") and not uri.startswith("file://"):
                uri = "file://" + uri.removeprefix("file:")
            system, root = fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")
            found = {}
            for info in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
                named = re.fullmatch(r"(\d+)(?:\.[A-Za-z]+)?", info.base_name)
                if named and info.type == fs.FileType.File:
                    number = int(named[1])
                    if number in found:
                        raise ValueError(f"two files of number {number} in {self.folder}")
                    found[number] = info.base_name
            return found, system, root

        def _rows(self, numbers, files):
            return iter([(n, f"{self.folder.rstrip('/')}/{files[n]}") for n in numbers])

        def initialOffset(self):
            return {"next": self.first}

        def read(self, start):
            files, end = self._files()[0], start["next"]
            while end in files and end - start["next"] < self.most:
                end += 1
            return self._rows(range(start["next"], end), files), {"next": end}

        def readBetweenOffsets(self, start, end):
            return self._rows(range(start["next"], end["next"]), self._files()[0])

        def commit(self, end):
            if self.dispose == "keep":
                return
            files, system, root = self._files()
            for number, name in files.items():
                if number < end["next"]:
                    if self.dispose == "delete":
                        system.delete_file(f"{root}/{name}")
                    else:
                        system.create_dir(self.archive, recursive=True)
                        system.move(f"{root}/{name}", f"{self.archive}/{name}")

    class NumberedFiles(DataSource):
        @classmethod
        def name(cls):
            return FORMAT

        def schema(self):
            return NUMBERED

        def simpleStreamReader(self, schema):
            return Reader(self.options)

    spark.dataSource.register(NumberedFiles)


def numbered_files(spark: SparkSession, path: str, **options) -> DataFrame:
    """``number, path`` of the files of a folder as a stream, by number."""
    register(spark)
    reader = spark.readStream.format(FORMAT).option("path", path)
    for name, value in options.items():
        reader = reader.option(name, str(value))
    return reader.load()
