"""Live search with its state in Spark's state store: what arrived, what is asked, and the best rows of each question.

Rows and questions are two streams that become one, dealt out to buckets. A bucket's state holds its rows, the questions
that are live and each one's best rows. New rows are scored against all live questions at once; a new question, or one
whose text or case policy has changed, is searched over all rows of the bucket. A stream that stops goes on from its
checkpoint, and its answers are those of one search over all rows.
"""

from __future__ import annotations

import json
import threading
from collections import deque
from collections.abc import Iterator
from types import SimpleNamespace

import pandas as pd
import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

from ..config import SearchConfig
from ..functions.languages import BACKENDS, Backend
from ..operators.index import build_index
from ..operators.rank import RESULT
from ..operators.search_table import Compiled, _meet, _ready, order_of

#: Buckets that rows are dealt to; each new question is searched in all of them side by side. Fixed for a checkpoint.
BUCKETS = 32
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_IN = "bucket int, id long, display string, norm string, case_fold_only boolean, hay string, keys string, query_id string, query string, seq long"
_OUT = "bucket int, query_id string, query string, case_sensitive boolean, tie string, seq long, state string, id long, display string, norm string, score long, key_kind string, key_index int"
_KEYS = pa.list_(pa.struct([("text", pa.string()), ("kind", pa.string()), ("weight", pa.int32()), ("hay", pa.string())]))
_ITEM = pa.schema([("id", pa.int64()), ("display", pa.string()), ("norm", pa.string()), ("case_fold_only", pa.bool_()), ("hay", pa.string()), ("keys", _KEYS)])
_FOUND = ("id", "display", "norm", "score", "key_kind", "key_index")


def _packed(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(data).read_next_batch()


class LiveProcessor(StatefulProcessor):
    """State of a bucket. items: one compressed Arrow batch for each micro-batch that brought rows, so that a new question
    reads few large values. asked: the live questions. best: each one's best rows, as JSON."""

    def __init__(self, config: SearchConfig, backend: Backend, case: str | None, keep_ms: int | None):
        self.config, self.backend, self.case, self.keep_ms = config, backend, case, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.items = handle.getListState("items", "batch binary")
        self.asked = handle.getMapState("asked", "query_id string", "query string, cased boolean, seq long, until long")
        self.best = handle.getMapState("best", "query_id string", "rows string")

    def close(self) -> None:
        pass

    def _cased(self, query: str) -> bool:
        return self.config.case_sensitive if self.case is None else self.config.with_case(query, self.case).case_sensitive

    def _search(self, batch: pa.RecordBatch, queries: list[str]) -> dict[str, list[tuple]]:
        """Found rows by query. One text may be asked under many ids."""
        out: dict[str, list[tuple]] = {q: [] for q in queries}
        compiled = SimpleNamespace(value=Compiled(sorted(out), self.config, self.backend, self.case))
        for found in _meet(compiled)(iter([batch])):
            for r in found.to_pylist():
                out[r["query"]].append(tuple(r[c] for c in _FOUND))
        return out

    def _cut(self, query: str, rows: list[tuple]) -> list[tuple]:
        """All that may be among the best: rows are cut by score alone, as tiebreaks are Spark's."""
        most = self.config.limit
        by = (lambda r: r[0]) if self.config.no_sort else (lambda r: -r[3])
        rows = sorted(rows, key=lambda r: (by(r), r[0]))
        return rows if len(rows) <= most else [r for r in rows if by(r) <= by(rows[most - 1])] if most else []

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        given = pd.concat(list(rows), ignore_index=True)
        now = timerValues.getCurrentProcessingTimeInMs() if self.keep_ms else 0
        fresh = self._ask(given[given["query_id"].notna()], now)
        items = given[given["query_id"].isna()].drop_duplicates("id", keep="last")
        live = {k[0]: v for k, v in self.asked.iterator()}
        changed: dict[str, list[tuple]] = {}
        if len(items):
            batch = self._batch(items)
            before = {q: self._rows(q) for q in live if q not in fresh}
            arrived = set(items["id"].tolist())
            # a best row that comes again may no longer match, and what it kept out is not at hand: search anew
            fresh |= {q for q, held in before.items() if any(r[0] in arrived for r in held)}
            again = [q for q in before if q not in fresh]
            found = self._search(batch, [live[q][0] for q in again]) if again else {}
            for q in again:
                if new := found[live[q][0]]:
                    changed[q] = self._cut(live[q][0], before[q] + new)
            self.items.appendValue((_packed(batch),))
        if fresh:
            changed |= self._anew({q: live[q][0] for q in fresh if q in live})
        out = []
        for q, held in changed.items():
            self.best.updateValue((q,), (json.dumps(held),))
            out += self._said(key[0], q, live[q], held)
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _OUT.split(", ")])

    def _ask(self, asks: pd.DataFrame, now: int) -> set[str]:
        """Takes in questions, the last of each id; those whose identity is new are returned."""
        fresh = set()
        for ask in asks.sort_values("seq").drop_duplicates("query_id", keep="last").itertuples():
            held = self.asked.getValue((ask.query_id,)) if self.asked.containsKey((ask.query_id,)) else None
            if held is not None and held[2] > ask.seq:
                continue
            cased = self._cased(ask.query)
            if held is None or (held[0], held[1]) != (ask.query, cased):
                fresh.add(ask.query_id)
            until = now + (self.keep_ms or 0)
            seq = int(ask.seq) if ask.query_id in fresh else held[2]
            self.asked.updateValue((ask.query_id,), (ask.query, cased, seq, until))
            if self.keep_ms:
                self.handle.registerTimer(until)
        return fresh

    def _rows(self, query_id: str) -> list[tuple]:
        return [tuple(r) for r in json.loads(self.best.getValue((query_id,))[0])] if self.best.containsKey((query_id,)) else []

    def _anew(self, asked: dict[str, str]) -> dict[str, list[tuple]]:
        """Best rows of questions over all rows of the bucket; of a row that came again the newest holds."""
        found: dict[str, list[tuple]] = {q: [] for q in asked}
        seen: set[int] = set()
        for (data,) in reversed(list(self.items.get())):
            batch = _unpacked(bytes(data))
            ids = batch.column(0).to_pylist()
            batch = batch.filter(pa.array([k not in seen for k in ids]))
            seen.update(ids)
            got = self._search(batch, list(asked.values()))
            for q, text in asked.items():
                found[q] = self._cut(text, found[q] + got[text])
        return found

    def _batch(self, items: pd.DataFrame) -> pa.RecordBatch:
        keys = [None if k is None else json.loads(k) for k in items["keys"]]
        plain = [pa.array(items[c].tolist(), _ITEM.field(c).type, from_pandas=True) for c in ("id", "display", "norm", "case_fold_only", "hay")]
        return pa.RecordBatch.from_arrays([*plain, pa.array(keys, _KEYS)], schema=_ITEM)

    def _said(self, bucket: int, query_id: str, asked: tuple, held: list[tuple]) -> list[tuple]:
        from ..operators.rank import tiebreak_query

        head = (bucket, query_id, asked[0], asked[1], tiebreak_query(asked[0]), asked[2])
        return [(*head, "found", *r) for r in held] or [(*head, "none", *[None] * 6)]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Questions that have not been asked again in time go, and say so."""
        now, out = expiredTimerInfo.getExpiryTimeInMs(), []
        for (q,), asked in list(self.asked.iterator()):
            if asked[3] <= now:
                self.asked.removeKey((q,))
                self.best.removeKey((q,))
                out.append((key[0], q, asked[0], asked[1], "", asked[2], "closed", *[None] * 6))
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _OUT.split(", ")])


class StatefulSearch:
    """Live answers to many questions over rows that keep arriving, kept under a shared folder.

    start() takes a stream of id and search_text, and a stream of query_id, query and seq: of two questions of one id that
    with the greater seq holds, and answers to the older one are stale. `case` is decided for each text. With `keep`
    seconds, a question that is not asked again in that time closes. A row whose id comes again replaces the older one.
    Rows with a null id or text, and questions with a null id or text, are passed over; a null seq counts as 0.
    """

    def __init__(self, path: str, *, config: SearchConfig = SearchConfig(), backend: Backend = BACKENDS["plain"], case: str | None = None, keep: float | None = None, buckets: int = BUCKETS):
        if config.limit is None:
            raise ValueError("a state of best rows has a limit; search the rows as a table for all")
        self.path, self.config, self.backend, self.case, self.buckets = path.rstrip("/"), config, backend, case, buckets
        self.keep_ms = None if keep is None else int(1000 * keep)

    def answers(self, items: DataFrame, asks: DataFrame) -> DataFrame:
        """The stream of changed answers: the rows of a bucket that may be among a question's best."""
        ready = _ready(build_index(items, backend=self.backend, config=self.config), self.config, self.backend).where("id IS NOT NULL")
        rows = ready.select(F.pmod(F.xxhash64("id"), F.lit(self.buckets)).cast("int").alias("bucket"), "id", "display", "norm", "case_fold_only", "hay", F.to_json("keys").alias("keys"))
        to_all = F.explode(F.sequence(F.lit(0), F.lit(self.buckets - 1))).alias("bucket")
        asked = asks.where("query_id IS NOT NULL AND query IS NOT NULL").select(to_all, F.col("query_id").cast("string").alias("query_id"), "query", F.coalesce(F.col("seq").cast("long"), F.lit(0)).alias("seq"))
        both = rows.unionByName(asked, allowMissingColumns=True).select(*[c.split()[0] for c in _IN.split(", ")])
        processor = LiveProcessor(self.config, self.backend, self.case, self.keep_ms)
        return both.groupBy("bucket").transformWithStateInPandas(processor, _OUT, "Update", "ProcessingTime" if self.keep_ms else "None")

    def _write(self, batch: DataFrame, batch_id: int) -> None:
        """A batch that comes again replaces itself."""
        batch.write.mode("overwrite").parquet(f"{self.path}/answers/batch={batch_id}")

    def start(self, items: DataFrame, asks: DataFrame, *, once: bool = True, name: str | None = None):
        """Runs from the checkpoint under the folder on; `once` stops when all that is there has been read.

        A stream with `keep` waits for time to pass, and so never comes to such an end.
        """
        if once and self.keep_ms:
            raise ValueError("questions close in time: give once=False, and stop the stream")
        spark = items.sparkSession
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
        writer = self.answers(items, asks).writeStream.foreachBatch(self._write).outputMode("update").option("checkpointLocation", f"{self.path}/checkpoint")
        writer = writer.queryName(name) if name else writer
        return (writer.trigger(availableNow=True) if once else writer).start()

    def results(self, spark: SparkSession) -> DataFrame:
        """query_id, query, case_sensitive, seq, rank and the columns of search: the live questions' present answers."""
        said = spark.read.schema(f"{_OUT}, batch long").option("basePath", f"{self.path}/answers").parquet(f"{self.path}/answers/batch=*")
        newest = said.groupBy("query_id").agg(F.max("seq").alias("seq"))
        last = said.groupBy("query_id", "seq", "bucket").agg(F.max("batch").alias("batch"))
        held = said.join(newest, ["query_id", "seq"]).join(last, ["query_id", "seq", "bucket", "batch"]).where("state = 'found'")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order_of(self.config, F.col("tie"))))
        return held.withColumn("rank", rank).where(F.col("rank") <= self.config.limit).select("query_id", "query", "case_sensitive", "seq", "rank", *RESULT)


class ControlRows(StreamingQueryListener):
    """A stream's progress, end and failure as rows: kind (started, progress, finished or error), name, batch_id, n_rows, message.

    The last `most` rows are kept by the driver.
    """

    def __init__(self, most: int = 10_000):
        self.rows: deque[tuple] = deque(maxlen=most)
        self.names: dict[str, str | None] = {}
        self.lock = threading.Lock()

    def _say(self, kind: str, run: object, batch_id: int | None = None, n_rows: int | None = None, message: str | None = None) -> None:
        with self.lock:
            self.rows.append((kind, self.names.get(str(run)), str(run), batch_id, n_rows, message))

    def onQueryStarted(self, event) -> None:
        self.names[str(event.runId)] = event.name
        self._say("started", event.runId)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self._say("progress", p.runId, p.batchId, p.numInputRows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._say("error" if event.exception else "finished", event.runId, message=event.exception)

    def table(self, spark: SparkSession) -> DataFrame:
        with self.lock:
            return spark.createDataFrame(list(self.rows), "kind string, name string, run string, batch_id long, n_rows long, message string")
