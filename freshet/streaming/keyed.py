"""Tables that streams keep up to date: one row per key, in whole versions.

A micro-batch is folded to one row per key and written as a run of its own. Runs
are merged while what came after a run holds half as many rows as it or more, so
each run outweighs twice all later ones: a table holds at most half as many rows
again as it has keys, in a logarithmic number of runs, and a row is rewritten a
logarithmic number of times however many batches there are.

An index file names the runs of a version. It is renamed into place when all of
them are complete, so readers find whole versions only, and a batch that is run
again after its version exists changes nothing. Runs that none of the newest
versions names are removed, those of broken-off attempts among them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, types as T
from pyspark.sql.streaming import StreamingQuery

from ..session import file_system, read_text, remove

Fold = Callable[[DataFrame], DataFrame]

#: Where Spark notes the id of a streaming query, which its checkpoint holds (fixed).
QUERY_ID = "sql.streaming.queryId"

#: Versions whose runs stay for readers that have begun on them.
KEPT_VERSIONS = 3


@dataclass(frozen=True)
class KeyedTable:
    """A table under ``path``, written by one stream.

    ``fold`` brings rows of equal keys down to one, and must give the same whether rows
    are folded at once or in parts first. Rows for which ``live`` is not true only cancel
    earlier ones: readers do not see them, and a merge with the oldest run drops them.
    ``owner`` names the writer, whose batch numbers must never start anew.
    """

    spark: SparkSession
    path: str
    fold: Fold
    live: Column | None = None
    owner: str = ""

    def versions(self) -> list[int]:
        """Numbers of the batches whose versions can be read, ascending."""
        system, folder = file_system(self.spark, f"{self.path}/index")
        if not system.exists(folder):
            return []
        names = [status.getPath().getName() for status in system.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def read(self, among: DataFrame | None = None, keys: Sequence[str] = ()) -> DataFrame:
        """The newest version; with ``among``, only its rows for the ``keys`` that table holds."""
        numbers = self.versions()
        if not numbers:
            raise LookupError(f"nothing has been kept under {self.path} yet")
        index = self._index(numbers[-1])
        runs = [self._run(index, name) for name, _ in index["runs"]]
        if among is not None:
            runs = [run.join(among, list(keys), "left_semi") for run in runs]
        whole = self.fold(reduce(DataFrame.unionByName, runs)) if len(runs) > 1 else runs[0]
        return whole if self.live is None else whole.where(self.live)

    def keep(self, number: int, updates: DataFrame) -> bool:
        """Fold a batch in as a new version; False if that batch has been kept before."""
        numbers = self.versions()
        index = self._index(numbers[-1]) if numbers else {"runs": [], "owner": self.owner}
        if index["owner"] != self.owner:
            raise ValueError(f"{self.path} is kept by {index['owner']!r}, whose batches are numbered otherwise")
        if numbers and number <= numbers[-1]:
            return False
        folded = self.fold(updates)
        index["schema"] = folded.schema.json()
        runs = [*index["runs"], self._write(index, number, folded)]
        outweighed = [i for i in range(len(runs) - 1) if 2 * sum(rows for _, rows in runs[i + 1:]) >= runs[i][1]]
        if outweighed:
            begin = outweighed[0]
            merged = self.fold(reduce(DataFrame.unionByName, [self._run(index, name) for name, _ in runs[begin:]]))
            if begin == 0 and self.live is not None:
                merged = merged.where(self.live)
            runs[begin:] = [self._write(index, number, merged)]
        self._commit(number, index | {"runs": runs})
        self._sweep()
        return True

    def _run(self, index: dict, name: str) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(index["schema"]))
        return self.spark.read.schema(schema).parquet(f"{self.path}/runs/{name}")

    def _write(self, index: dict, number: int, rows: DataFrame) -> tuple[str, int]:
        name = f"{number:012d}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/runs/{name}")
        return name, self._run(index, name).count()  # from the files' footers

    def _index(self, number: int) -> dict:
        return json.loads(read_text(self.spark, f"{self.path}/index/{number:012d}.json"))

    def _commit(self, number: int, index: dict) -> None:
        system, place = file_system(self.spark, f"{self.path}/index/{number:012d}.json")
        _, draft = file_system(self.spark, f"{self.path}/index/_{uuid.uuid4().hex}")
        stream = system.create(draft, True)
        stream.write(json.dumps(index).encode())
        stream.close()
        if not system.rename(draft, place):
            raise OSError(f"version {number} of {self.path} could not be put in place")

    def _sweep(self) -> None:
        numbers = self.versions()
        named = {name for n in numbers[-KEPT_VERSIONS:] for name, _ in self._index(n)["runs"]}
        system, folder = file_system(self.spark, f"{self.path}/runs")
        for number in numbers[:-KEPT_VERSIONS]:
            remove(self.spark, f"{self.path}/index/{number:012d}.json")
        for status in system.listStatus(folder):
            name = status.getPath().getName()
            if name not in named:
                remove(self.spark, f"{self.path}/runs/{name}")


def keep_folded(
    stream: DataFrame, path: str, fold: Fold, checkpoint: str, **trigger
) -> StreamingQuery:
    """Keep the fold of a stream as a keyed table; without a trigger, of what is there now.

    The table is all the state there is: a row counts however late it comes. It belongs to
    the checkpoint it was begun with; a stream that starts anew needs a table of its own.
    """
    def keep(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        query = spark.sparkContext.getLocalProperty(QUERY_ID)
        KeyedTable(spark, path, fold, owner=query).keep(number, batch)

    return (
        stream.writeStream.outputMode("append").foreachBatch(keep)
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    )
