"""Live answers that survive a stop, a failure, changed questions and rows that come again."""

import os
import time

import pytest

from pyspark.sql import functions as F
from resonar.config import SearchConfig
from resonar.operators.index import build_index
from resonar.operators.search_table import search_table
from resonar.streaming.stateful import ControlRows, StatefulSearch

ITEM, ASK = "id long, search_text string", "query_id string, query string, seq long"


def _put(spark, rows, schema, folder, n):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{n}")


def _streams(spark, root):
    read = lambda schema, name: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/{name}/*")
    return read(ITEM, "items"), read(ASK, "asks")


def _answers(live, spark):
    return sorted((r.query_id, r["query"], r["rank"], r.id, r.display, r.score) for r in live.results(spark).collect())


def _one_search(spark, items, asked, config, case=None):
    index = build_index(spark.createDataFrame(items, ITEM))
    got = search_table(index, spark.createDataFrame([(k, q) for k, q in asked.items()], "query_id string, query string"), config=config, case=case)
    return sorted((r.query_id, asked[r.query_id], r["rank"], r.id, r.display, r.score) for r in got.collect())


@pytest.fixture
def texts():
    return [(k, f"{w}/{v}_{k % 17}.rs") for k, (w, v) in enumerate((w, v) for w in ("src", "Docs", "test", "bench") for v in ("read", "Reader", "main", "red", "r d", "lib"))]


def test_a_failed_stream_goes_on_where_it_stopped(spark, tmp_path, texts):
    config = SearchConfig(limit=4, tiebreaks=("begin", "length", "index"))
    live = StatefulSearch(f"{tmp_path}/live", config=config, case="smart", buckets=3)
    for n in range(4):
        _put(spark, texts[n::4], ITEM, f"{tmp_path}/items", n)
    _put(spark, [("a", "rd", 1), ("b", "^src 'read", 1), ("c", "Read", 1), ("d", "zzz", 1), (None, "x", 1), ("n", None, 1)], ASK, f"{tmp_path}/asks", 0)
    said = ControlRows()
    spark.streams.addListener(said)
    try:
        write, live._write = live._write, None

        def failing(batch, batch_id):
            if batch_id == 2:
                raise RuntimeError("lost in the middle")
            write(batch, batch_id)

        live._write = failing
        with pytest.raises(Exception, match="lost in the middle"):
            live.start(*_streams(spark, tmp_path), name="broken").awaitTermination()
        assert 0 < len(_answers(live, spark))
        live._write = write
        live.start(*_streams(spark, tmp_path), name="whole").awaitTermination()
        deadline = time.time() + 30
        while time.time() < deadline and not any(r[0] == "finished" for r in said.rows):
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(said)
    asked = {"a": "rd", "b": "^src 'read", "c": "Read", "d": "zzz"}
    assert _answers(live, spark) == _one_search(spark, texts, asked, config, "smart")
    kinds = [(r.kind, r.name) for r in said.table(spark).collect()]
    assert ("error", "broken") in kinds and kinds[-1] == ("finished", "whole") and ("progress", "whole") in kinds
    assert said.table(spark).where("kind = 'error'").first().message.count("lost in the middle")


def test_changed_questions_and_rows_that_come_again(spark, tmp_path, texts):
    config = SearchConfig(limit=3)
    live = StatefulSearch(f"{tmp_path}/live", config=config, buckets=2)
    _put(spark, texts, ITEM, f"{tmp_path}/items", 0)
    _put(spark, [("a", "rd", 1), ("b", "main", 1)], ASK, f"{tmp_path}/asks", 0)
    live.start(*_streams(spark, tmp_path)).awaitTermination()
    asked = {"a": "rd", "b": "main"}
    assert _answers(live, spark) == _one_search(spark, texts, asked, config)
    # another text for one id, an older one for the other, and a best row that no longer matches
    best = live.results(spark).where("query_id = 'b' AND rank = 1").first().id
    _put(spark, [("a", "lib", 3), ("a", "test", 2), ("b", "zz", 0)], ASK, f"{tmp_path}/asks", 1)
    _put(spark, [(best, "gone"), (999, "main"), (None, "main"), (1000, None)], ITEM, f"{tmp_path}/items", 1)
    live.start(*_streams(spark, tmp_path)).awaitTermination()
    now = [(k, t) for k, t in texts if k != best] + [(best, "gone"), (999, "main")]
    assert _answers(live, spark) == _one_search(spark, now, {"a": "lib", "b": "main"}, config)
    assert {(r.query_id, r.seq) for r in live.results(spark).collect()} == {("a", 3), ("b", 1)}


def test_questions_close_in_time(spark, tmp_path, texts):
    live = StatefulSearch(f"{tmp_path}/live", keep=3, buckets=2)
    _put(spark, texts, ITEM, f"{tmp_path}/items", 0)
    _put(spark, [("a", "rd", 1)], ASK, f"{tmp_path}/asks", 0)
    with pytest.raises(ValueError):
        live.start(*_streams(spark, tmp_path))
    running = live.start(*_streams(spark, tmp_path), once=False)
    said = f"{tmp_path}/live/answers"
    try:
        closed, deadline = 0, time.time() + 60
        while closed < 2 and time.time() < deadline:
            time.sleep(1)
            if os.path.isdir(said) and any(os.path.exists(f"{said}/{x}/_SUCCESS") for x in os.listdir(said)):
                done = [f"{said}/{x}" for x in os.listdir(said) if os.path.exists(f"{said}/{x}/_SUCCESS")]
                closed = spark.read.parquet(*done).where("state = 'closed'").select(F.countDistinct("bucket")).first()[0]
    finally:
        running.stop()
    assert closed == 2 and _answers(live, spark) == []


def test_a_state_wants_a_limit(tmp_path):
    with pytest.raises(ValueError):
        StatefulSearch(str(tmp_path), config=SearchConfig(limit=None))
