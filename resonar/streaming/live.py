"""Search over records that keep arriving: each micro-batch is indexed, scored, and merged with the best so far."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import SearchConfig
from ..functions.languages import BACKENDS, Backend
from ..operators.index import build_index
from ..operators.rank import RESULT, sort_columns
from ..operators.search import matches


class LiveSearch:
    """Keeps an index table that grows, and the best rows for one query.

    The best k of a union are among the best k of its parts, so a batch costs its own rows and k more. A new query
    searches the whole index table once. Results carry the query, its case policy and the batch, so that answers to an
    older query are never taken for the present one's. `case` (ignore, respect or smart) is decided anew for each query;
    without it the config's own setting holds.
    """

    def __init__(self, path: str, query: str, *, config: SearchConfig = SearchConfig(), backend: Backend = BACKENDS["plain"], language: str | None = None, case: str | None = None):
        if language == "auto":
            raise ValueError("a stream has no sample to detect a language from; name one")
        if config.limit is None:
            raise ValueError("the best rows are held by the driver; give a limit, or search() the index() table for all")
        self.path, self.config, self.backend, self.case = path.rstrip("/"), config, backend, case
        self.batch_id, self.best = -1, None
        self.set_query(query)

    def set_query(self, query: str, case_sensitive: bool | None = None) -> None:
        from dataclasses import replace

        self.query = query
        if self.case is not None:
            self.config = self.config.with_case(query, self.case)
        if case_sensitive is not None:
            self.config = replace(self.config, case_sensitive=case_sensitive)
        self.best = None  # the next batch, or results(), searches the whole index

    def _top(self, index: DataFrame) -> DataFrame:
        found = matches(index, self.query, config=self.config, backend=self.backend)
        order = [F.col("id")] if self.config.no_sort else [F.desc("score"), *sort_columns(self.query, self.config.tiebreaks)]
        out = found.orderBy(*order)
        return out if self.config.limit is None else out.limit(self.config.limit)

    def _rows(self, index: DataFrame) -> list:
        return self._top(index).collect()  # at most `limit` rows

    def add(self, batch: DataFrame, batch_id: int) -> None:
        """One micro-batch of id and search_text. A batch that comes again replaces itself."""
        spark = batch.sparkSession
        target = f"{self.path}/index/batch={batch_id}"
        build_index(batch, backend=self.backend, config=self.config).write.mode("overwrite").parquet(target)
        self.batch_id = max(self.batch_id, batch_id)
        new = spark.read.parquet(target)
        if self.best is None:
            self.best = self._rows(self.index(spark))
            return
        kept = spark.createDataFrame(self.best, self._top(new).schema).select(*new.columns)
        # of a row that comes again the newer holds
        self.best = self._rows(new.unionByName(kept.join(new.select("id"), "id", "left_anti")))

    def index(self, spark) -> DataFrame:
        return spark.read.parquet(f"{self.path}/index").drop("batch")

    def compact(self, spark, to: str, files: int = 1) -> None:
        """Copies the index, which has a folder for each batch, to another place in few files, for searches that follow."""
        self.index(spark).repartition(files).write.parquet(f"{to.rstrip('/')}/index/batch={self.batch_id}")
        self.path = to.rstrip("/")

    def results(self, spark) -> DataFrame:
        """The present best rows, tagged with what they answer."""
        if self.best is None:
            self.best = self._rows(self.index(spark))
        empty = self._top(self.index(spark)).schema
        rows = spark.createDataFrame(self.best, empty).select(*RESULT)
        return rows.select("*", F.lit(self.query).alias("query"), F.lit(self.config.case_sensitive).alias("case_sensitive"), F.lit(self.batch_id).alias("batch_id"))

    def start(self, stream: DataFrame, checkpoint: str, *, once: bool = True):
        """Runs over a stream with id and search_text; `once` stops when all that is there has been read."""
        if not stream.isStreaming:
            raise ValueError("start() takes a stream; search() takes a table")
        writer = stream.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer).start()
