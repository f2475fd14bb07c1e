"""Small driver-side files through Hadoop's file systems, so that any store Spark can write to works."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession):
        self.jvm = spark._jvm
        self.conf = spark._jsc.hadoopConfiguration()
        self.gateway = spark.sparkContext._gateway

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def system(self, name: str):
        return self.path(name).getFileSystem(self.conf)

    def exists(self, name: str) -> bool:
        return self.system(name).exists(self.path(name))

    def written(self, name: str) -> int | None:
        """When a file was written (milliseconds), or None if it is not there."""
        try:
            return self.system(name).getFileStatus(self.path(name)).getModificationTime()
        except Exception as e:
            if "FileNotFound" in str(e):
                return None
            raise

    def names(self, folder: str) -> list[str]:
        """Names in a folder, sorted; none if it does not exist."""
        if not self.exists(folder):
            return []
        return sorted(s.getPath().getName() for s in self.system(folder).listStatus(self.path(folder)))

    def read(self, name: str) -> str:
        stream = self.system(name).open(self.path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Publish a new file whole; False if the name is taken. The text goes to a temporary file that is renamed
        without overwriting, which is atomic where the file system's rename is."""
        import uuid

        folder, _, last = name.rpartition("/")
        part = f"{folder}/.{last}.{uuid.uuid4().hex}"
        stream = self.system(part).create(self.path(part), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        fs = self.jvm.org.apache.hadoop.fs
        kept = self.gateway.new_array(getattr(fs, "Options$Rename"), 1)
        kept[0] = getattr(fs, "Options$Rename").NONE
        try:
            fs.FileContext.getFileContext(self.system(name).getUri(), self.conf).rename(self.path(part), self.path(name), kept)
        except Exception:
            self.delete(part)
            if self.exists(name):
                return False
            raise
        return True

    def delete(self, name: str) -> bool:
        return self.system(name).delete(self.path(name), True)

    def files_below(self, name: str) -> list[tuple[str, int]]:
        """(path, bytes) of all files under a folder."""
        if not self.exists(name):
            return []
        found, it = [], self.system(name).listFiles(self.path(name), True)
        while it.hasNext():
            s = it.next()
            found.append((s.getPath().toString(), s.getLen()))
        return found
