"""Written results that readers see as a whole or not at all."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.plans.commits import CommitLog, Folder

_RANGE = "range"


def write_parts(parts: DataFrame, path: str) -> None:
    """Write (range, ..., text) as text files that give the whole text in the order of their names.

    Each range must come from one task, in order. Spark writes a folder per range next to ``path``; the files then get the range's number as
    their name, and the folder takes the place of an earlier one. Only names are handled here, one per range.
    """
    spark = parts.sparkSession
    above, _, name = path.rstrip("/").rpartition("/")
    folder = Folder(spark, above or ".")
    writing = f"_{name}-{uuid.uuid4().hex}"
    text = [c for c in parts.columns if c not in (_RANGE, "rank")]
    # The rows are sorted by range already, which is all that the writer asks for.
    parts.select(_RANGE, *text).write.partitionBy(_RANGE).text(f"{folder.root}/{writing}")
    written = Folder(spark, f"{folder.root}/{writing}")
    for inner in written.names():
        if inner.startswith(f"{_RANGE}="):
            number = int(inner.partition("=")[2])
            files = [f for f in Folder(spark, f"{written.root}/{inner}").names() if f.startswith("part-")]
            if len(files) != 1:
                raise RuntimeError(f"range {number} was written by {len(files)} tasks")
            folder.move(f"{written.root}/{inner}/{files[0]}", f"{written.root}/part-{number:05d}.txt")
            written.delete(inner)
    folder.delete(name)
    folder.move(f"{written.root}", f"{folder.root}/{name}")


class DocumentSink:
    """Documents by name, published batch by batch.

    A batch's files are written where no reader looks. One exclusive rename of a log entry publishes the batch, and
    a reader takes, for each name, the document of the latest batch that has it. A write that is killed leaves the documents as they were;
    one that is killed right after publishing is finished by the next reader or writer.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark = spark
        self.path = path.rstrip("/")
        self._log = CommitLog(spark, f"{self.path}/_commits")

    def last(self) -> int:
        """The last published batch."""
        for number in self._log.refresh():
            self._log.folder.move(f"{self.path}/{self._log.entry(number)['folder']}", f"{self.path}/batch={number}")
        return self._log.last()

    def write(self, documents: DataFrame) -> int:
        """Publish (name, html); returns the number of the batch."""
        folder = f"_new-{uuid.uuid4().hex}"
        documents.select("name", "html").write.partitionBy("name").text(f"{self.path}/{folder}")
        while (number := self._log.publish(folder, 0, self.last(), folder=folder)) is None:
            pass
        self.last()
        self._log.folder.move(f"{self.path}/{folder}", f"{self.path}/batch={number}")
        return number

    def read(self) -> DataFrame:
        """(name, html): the latest document of each name, as it was written and with a line end."""
        if not self.last():
            return self.spark.createDataFrame([], "name string, html string")
        rows = self.spark.read.text(self.path, wholetext=True).select("name", "batch", F.col("value").alias("html"))
        latest = rows.groupBy("name").agg(F.max("batch").alias("batch"))
        return rows.join(latest, ["name", "batch"]).select("name", "html")
