"""File operations on whatever store Spark can reach."""

from __future__ import annotations

import gzip
import io
from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass
class FileResult:
    name: str
    size: int
    status: str


class FileOperation:
    def __init__(self, session: SparkSession):
        self.session = session

    def _fs(self, location: str):
        jvm = self.session.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(location)
        return path.getFileSystem(self.session.sparkContext._jsc.hadoopConfiguration()), path

    def put(self, local_file_name: str, location: str, auto_compress: bool = True, overwrite: bool = False) -> list[FileResult]:
        """Copy local files (a glob) to a folder, gzipped unless told otherwise."""
        import glob
        import os

        out = []
        for name in sorted(glob.glob(local_file_name.removeprefix("file://"))):
            with open(name, "rb") as f:
                data = f.read()
            target = os.path.basename(name)
            if auto_compress and not target.endswith(".gz"):
                data, target = gzip.compress(data), target + ".gz"
            status = self.put_stream(io.BytesIO(data), f"{location.rstrip('/')}/{target}", auto_compress=False, overwrite=overwrite).status
            out.append(FileResult(target, len(data), status))
        return out

    def put_stream(self, stream: io.IOBase, location: str, auto_compress: bool = True, overwrite: bool = False) -> FileResult:
        data = stream.read()
        if auto_compress and not location.endswith(".gz"):
            data, location = gzip.compress(data), location + ".gz"
        fs, path = self._fs(location)
        if fs.exists(path) and not overwrite:
            return FileResult(location, len(data), "SKIPPED")
        out = fs.create(path, True)
        try:
            for at in range(0, len(data), 1 << 20):
                out.write(bytearray(data[at : at + (1 << 20)]))
        finally:
            out.close()
        return FileResult(location, len(data), "UPLOADED")

    def get(self, location: str, target_directory: str, pattern: str = "*") -> list[FileResult]:
        import os

        os.makedirs(target_directory, exist_ok=True)
        out = []
        for row in self.list(location):
            name = row.name.rsplit("/", 1)[-1]
            with open(os.path.join(target_directory, name), "wb") as f:
                f.write(self.get_stream(row.name).read())
            out.append(FileResult(name, row.size, "DOWNLOADED"))
        return out

    def get_stream(self, location: str, decompress: bool = False) -> io.BytesIO:
        row = self.session.read.format("binaryFile").load(location).select("content").head()
        data = bytes(row.content)
        return io.BytesIO(gzip.decompress(data) if decompress else data)

    def list(self, location: str, pattern: str | None = None) -> list[FileResult]:
        import re

        fs, path = self._fs(location)
        rows = [FileResult(s.getPath().toString(), s.getLen(), "LISTED") for s in fs.listStatus(path) if s.isFile()]
        return [r for r in rows if pattern is None or re.search(pattern, r.name)]

    def copy_files(self, source: str, target: str, pattern: str | None = None) -> list[str]:
        out = []
        for row in self.list(source, pattern):
            name = row.name.rsplit("/", 1)[-1]
            self.put_stream(self.get_stream(row.name), f"{target.rstrip('/')}/{name}", auto_compress=False, overwrite=True)
            out.append(name)
        return out

    def remove(self, location: str, pattern: str | None = None) -> list[str]:
        fs, path = self._fs(location)
        names = [r.name for r in self.list(location, pattern)]
        for n in names:
            fs.delete(self._fs(n)[1], False)
        return names
