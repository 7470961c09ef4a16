"""Tables of immutable parts under numbered manifests: whole versions for readers, each batch once for writers.

A writer first writes a part's folder, then names it in a new manifest, whose file appears whole or not at all. A reader takes the
newest manifest and reads the parts it names, so it sees one version, also while another is written. A manifest keeps the number of
the last batch of every source: a batch that is run again after a crash is recognised and adds nothing; a part without a manifest
is never read. All files lie in one folder that the cluster shares.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class Parts:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(conf)
        self._files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.path).toUri(), conf)
        self._text = jvm.org.apache.commons.io.IOUtils

    def _numbers(self) -> list[int]:
        at = self._path(f"{self.path}/manifests")
        names = [f.getPath().getName() for f in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def manifest(self, number: int | None = None) -> dict:
        """The newest manifest, or the one of that number; number 0, without parts, before the first."""
        if number is None:
            number = max(self._numbers(), default=0)
        if not number:
            return {"number": 0, "parts": {}, "applied": {}}
        stream = self._fs.open(self._path(f"{self.path}/manifests/{number}.json"))
        try:
            return json.loads(self._text.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, manifest: dict) -> None:
        """Give the manifest its name; fails if another writer has taken the number."""
        draft = self._path(f"{self.path}/drafts/{uuid.uuid4().hex}")
        stream = self._fs.create(draft, False)
        try:
            stream.write(json.dumps(manifest).encode())
        finally:
            stream.close()
        self._fs.mkdirs(self._path(f"{self.path}/manifests"))
        rename = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        plain = self.spark._sc._gateway.new_array(rename, 0)  # without OVERWRITE an existing name is an error
        self._files.rename(draft, self._path(f"{self.path}/manifests/{manifest['number']}.json"), plain)

    def write(self, df: DataFrame) -> str:
        """A part that no manifest names yet."""
        folder = f"{self.path}/parts/{uuid.uuid4().hex}"
        df.write.parquet(folder)
        return folder

    def applied(self, source: str, batch: int) -> bool:
        return batch <= self.manifest()["applied"].get(source, -1)

    def commit(self, add: dict[str, list[str]], source: str | None = None, batch: int = 0, replace: bool = False) -> int:
        """A new version with these parts beside (or instead of) those of the tables they belong to; its number."""
        now = self.manifest()
        parts = dict(now["parts"])
        for table, folders in add.items():
            parts[table] = folders if replace else parts.get(table, []) + folders
        applied = now["applied"] | ({source: batch} if source is not None else {})
        self._publish({"number": now["number"] + 1, "parts": parts, "applied": applied})
        return now["number"] + 1

    def insert(self, df: DataFrame, source: str, batch: int, table: str = "rows") -> bool:
        """Add a batch's rows once; False if the batch was applied before."""
        if self.applied(source, batch):
            return False
        self.commit({table: [self.write(df)]}, source, batch)
        return True

    def read(self, schema: str, table: str = "rows", number: int | None = None) -> DataFrame:
        """The rows of one version; parts written later are not seen, however late the rows are fetched."""
        parts = self.manifest(number)["parts"].get(table, [])
        return self.spark.read.schema(schema).parquet(*parts) if parts else self.spark.createDataFrame([], schema)

    def vacuum(self, keep: int = 2) -> int:
        """Delete parts that none of the last `keep` versions names, and older manifests; how many parts went.

        Only for a writer: a part that is being written is in no manifest yet.
        """
        numbers = self._numbers()
        named = {f for n in numbers[-keep:] for folders in self.manifest(n)["parts"].values() for f in folders}
        at = self._path(f"{self.path}/parts")
        found = [f.getPath() for f in self._fs.listStatus(at)] if self._fs.exists(at) else []
        gone = [p for p in found if p.getName() not in {f.rsplit("/", 1)[1] for f in named}]
        for n in numbers[:-keep]:
            self._fs.delete(self._path(f"{self.path}/manifests/{n}.json"), False)
        for p in gone:
            self._fs.delete(p, True)
        return len(gone)
