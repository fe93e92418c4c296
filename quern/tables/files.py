"""Small files and listings on whatever file system Spark reads, through Hadoop's client."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    """File operations by Hadoop path; creation of a file can be exclusive, which commits rely on."""

    def __init__(self, spark: SparkSession) -> None:
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        place = self._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self._conf), place

    def qualified(self, path: str) -> str:
        fs, place = self._at(path)
        return place.makeQualified(fs.getUri(), fs.getWorkingDirectory()).toString()

    def exists(self, path: str) -> bool:
        fs, place = self._at(path)
        return fs.exists(place)

    def read(self, path: str) -> str:
        fs, place = self._at(path)
        stream = fs.open(place)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, path: str, text: str) -> bool:
        """Write a new file as a whole; False if something is there already."""
        fs, place = self._at(path)
        draft = self._jvm.org.apache.hadoop.fs.Path(f"{path}.{self._jvm.java.util.UUID.randomUUID()}.draft")
        stream = fs.create(draft, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        try:
            if fs.getScheme() == "file":  # rename there would replace; a hard link doesn't
                files, paths = self._jvm.java.nio.file.Files, self._jvm.java.nio.file.Paths
                files.createLink(paths.get(place.toUri()), paths.get(draft.toUri()))
                return True
            return not fs.exists(place) and fs.rename(draft, place)
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                return False
            raise
        finally:
            fs.delete(draft, False)

    def names(self, path: str) -> list[str]:
        """Names in a folder; none if it isn't there."""
        fs, place = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(place)) if fs.exists(place) else []

    def walk(self, path: str) -> list[tuple[str, int, int]]:
        """(path, bytes, modification time in ms) of all files below a folder."""
        fs, place = self._at(path)
        out = []
        if fs.exists(place):
            found = fs.listFiles(place, True)
            while found.hasNext():
                s = found.next()
                out.append((s.getPath().toString(), s.getLen(), s.getModificationTime()))
        return sorted(out)

    def make(self, path: str) -> None:
        fs, place = self._at(path)
        fs.mkdirs(place)

    def rename(self, old: str, new: str) -> bool:
        fs, place = self._at(old)
        return fs.rename(place, self._at(new)[1])

    def delete(self, path: str) -> None:
        fs, place = self._at(path)
        fs.delete(place, True)

    def footer(self, path: str) -> tuple[int, dict[str, dict]]:
        """Rows of a Parquet file, and by top-level column: nulls, lower and upper (text; absent if unknown)."""
        _, place = self._at(path)
        source = self._jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(place, self._conf)
        reader = self._jvm.org.apache.parquet.hadoop.ParquetFileReader.open(source)
        try:
            rows, columns = 0, {}
            for block in reader.getFooter().getBlocks():
                rows += block.getRowCount()
                for chunk in block.getColumns():
                    parts = chunk.getPath().toArray()
                    if len(parts) > 1:
                        continue
                    got, own = chunk.getStatistics(), columns.setdefault(parts[0], {"nulls": 0, "bounds": []})
                    if got is None or not got.isNumNullsSet():
                        own["nulls"] = None
                    elif own["nulls"] is not None:
                        own["nulls"] += got.getNumNulls()
                    if got is not None and got.hasNonNullValue():
                        own["bounds"].append((_plain(got.genericGetMin()), _plain(got.genericGetMax())))
                    elif got is None or own["nulls"] is None or got.getNumNulls() < chunk.getValueCount():
                        own["bounds"].append((None, None))
            for own in columns.values():
                bounds = own.pop("bounds")
                if bounds and all(a is not None and b is not None and type(a) is type(bounds[0][0]) for a, b in bounds):
                    own |= {"lower": min(a for a, _ in bounds), "upper": max(b for _, b in bounds)}
            return rows, columns
        finally:
            reader.close()


def _plain(x):
    """A statistic as a JSON value; None if it has no faithful one (binary, or possibly cut)."""
    if isinstance(x, bool | int):
        return x
    if isinstance(x, float):
        return x if x == x else None
    if hasattr(x, "toStringUsingUTF8"):
        text = x.toStringUsingUTF8()
        return text if len(text) <= 64 and "�" not in text else None
    return None
