import random

import pytest
from pyspark.sql import functions as F

from resonar.config import SearchConfig
from resonar.functions.languages import BACKENDS, backend_for
from resonar.operators import fields
from resonar.functions import width
from resonar.operators.explain import explain, explain_text, highlight, highlight_places, match_positions
from resonar.operators.index import all_keys, apply_aliases, build_index, newest_first, with_ids
from resonar.operators.outcome import filter_outcome
from resonar.operators.search import search, search_many
from resonar.sources import text as source
from resonar.sources.walker import WalkerSource, parse_options, walk
from resonar.streaming.live import LiveSearch


def found(spark, query, texts, config=SearchConfig(), backend=BACKENDS["plain"]):
    items = spark.createDataFrame(list(enumerate(texts)), "id long, search_text string")
    return [(r.display, r.score) for r in search(build_index(items, backend=backend, config=config), query, config=config, backend=backend).collect()]


def test_golden_orders(spark):
    mixed = ["readme.md", "README.md", "ReadMe.md", "readme_old.md"]
    assert found(spark, "readme", mixed) == [("readme.md", 13934), ("readme_old.md", 13934), ("ReadMe.md", 13929), ("README.md", 13859)]
    assert [d for d, _ in found(spark, "hs", ["HTTPServer.rs", "HttpServer.rs", "httpserver.rs", "http_server.rs"])] == ["http_server.rs", "httpserver.rs", "HttpServer.rs", "HTTPServer.rs"]
    assert found(spark, "'readme", ["README.md"]) == [("README.md", 9991)]


def test_sounds(spark):
    assert found(spark, "bjdx", ["北京地铁", "北京大学"], backend=BACKENDS["zh"])[0][0] == "北京大学"
    assert found(spark, "tokyodai", ["東京電機大学", "東北大学", "東京大学"], SearchConfig(limit=1), backend_for("ja", readings=True))[0][0] == "東京大学"


def test_order_does_not_depend_on_input_order(spark):
    rng = random.Random(1)
    texts = [f"{a}{b}abc{b}" for a in "xyz/" for b in "-_."]
    whole = sorted(found(spark, "abc", texts, SearchConfig(limit=None, tiebreaks=("length",))), key=lambda x: (-x[1], len(x[0])))
    mixed = rng.sample(texts, len(texts))
    assert sorted(found(spark, "abc", mixed, SearchConfig(limit=None))) == sorted(whole)


def test_explain(spark):
    items = spark.createDataFrame([(0, "北京大学.txt"), (1, "notes.txt")], "id long, search_text string")
    own = build_index(items, backend=BACKENDS["zh"])
    row = explain(search(own, "bjdx", backend=BACKENDS["zh"]), own, "bjdx", backend=BACKENDS["zh"]).collect()[0].asDict()
    assert (row["key_kind"], row["source_start"], row["source_end"]) == ("PinyinInitials", 0, 4)
    assert "PinyinInitials" in explain_text(row)
    assert match_positions("abc", "xabc") == [1, 2, 3] and match_positions("ac", "a_b_c") == [0, 4] and match_positions("z", "a") is None


def test_fields(spark):
    df = spark.createDataFrame([(7, "foo,bar,baz")], "id long, line string")
    out = lambda spec, d=",", text=F.col("line"): df.select(fields.render(spec, text, F.col("id"), fields.Delimiter(d)).alias("x")).first()[0]
    assert [out(s) for s in ("2,-1", "2..", "..-2", "0", "9", "3..2", "{n}:{3}:{1}")] == ["bar,baz", "bar,baz", "foo,bar", "", "", "", "7:baz:foo"]
    assert out("2", None, F.lit("  a  b ")) == "b"
    with pytest.raises(ValueError):
        out("{1")


def test_records(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"one\r\n\nb\xff\nlast\rx\n")
    rows = source.read_records(spark, str(tmp_path / "a.txt")).collect()
    assert [bytes(r.raw) for r in rows] == [b"one", b"", b"b\xff", b"last\rx"] and rows[2].display == "b�"
    (tmp_path / "b.txt").write_bytes(b"one\0\0two\0")
    assert [r.display for r in source.read_records(spark, str(tmp_path / "b.txt"), nul=True).collect()] == ["one", "two"]
    records = source.records_of(spark, b"h\na\nb\nc\n")
    body, header = fields.slice_records(records, header=1, tail=2, tac=True)
    assert [(r.id, r.display) for r in body.orderBy("id").collect()] == [(0, "c"), (1, "b")] and [r.display for r in header.collect()] == ["h"]
    items = fields.prepare_items(body.withColumnRenamed("pos", "_p").select("id", "raw", "display"))
    assert source.ordered_bytes(fields.accept(items).orderBy("id")) == b"c\nb\n"
    assert source.choose_source(path="x") == "file" and source.choose_source(stdin=b"") == "stdin" and source.choose_source() == "walker"
    assert [r.display for r in source.command_records(spark, "printf 'a\\nb'").collect()] == ["a", "b"]
    with pytest.raises(RuntimeError):
        source.command_records(spark, "exit 3")


def test_aliases_and_history(spark):
    items = spark.createDataFrame([(0, "x"), (1, "x")], "id long, search_text string").select("id", F.col("search_text").alias("original"), F.col("search_text").alias("display"), "search_text")
    aliases = spark.createDataFrame([("nick", "x")], "query string, display string")
    first = apply_aliases(build_index(items), items, aliases).orderBy("id").select(F.size("keys")).collect()
    every = apply_aliases(build_index(items), items, aliases, first_only=False).select(F.size("keys")).collect()
    assert [r[0] for r in first] == [1, 0] and [r[0] for r in every] == [1, 1]
    lines = spark.createDataFrame([("a", 0), ("b", 1), ("a", 2)], "line string, pos long")
    assert [r.line for r in newest_first(lines).collect()] == ["a", "b"]
    assert [r.id for r in with_ids(spark.createDataFrame([("a",), ("b",)], "t string")).collect()] == [0, 1]
    assert build_index(items).select(F.size(all_keys())).first()[0] == 2


def test_walker(spark, tmp_path):
    for path in ("a/x.txt", "a/skip.log", ".git/config", ".hidden/h", "b/y.txt"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text("")
    (tmp_path / ".gitignore").write_text("*.log\n!keep.log\nb/\n")
    got = {p.removeprefix(f"{tmp_path}/") for p in walk(str(tmp_path))}
    assert got == {"a/x.txt", ".gitignore", ".hidden/h"}
    assert "a" in {p.removeprefix(f"{tmp_path}/") for p in walk(str(tmp_path), parse_options("dir"))}
    spark.dataSource.register(WalkerSource)
    assert spark.read.format("walker").option("roots", str(tmp_path)).load().count() == 3
    with pytest.raises(ValueError):
        parse_options("nonsense")


def test_live_search_equals_one_search(spark, tmp_path):
    texts = [(k, f"part {k} red") for k in range(40)]
    items = spark.createDataFrame(texts, "id long, search_text string")
    live = LiveSearch(str(tmp_path), "prd")
    for k in range(3):
        live.add(items.where(F.col("id") % 3 == k), k)
    want = [tuple(r) for r in search(build_index(items), "prd").collect()]
    assert [tuple(r)[:5] for r in live.results(spark).collect()] == want
    live.set_query("p3")
    assert [tuple(r)[:5] for r in live.results(spark).collect()] == [tuple(r) for r in search(build_index(items), "p3").collect()]
    with pytest.raises(ValueError):
        live.start(items, str(tmp_path / "c"))


def test_live_search_needs_a_limit(tmp_path):
    with pytest.raises(ValueError):
        LiveSearch(str(tmp_path), "prd", config=SearchConfig(limit=None))


def test_stream_of_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(2):
        (tmp_path / "in" / f"{k}.txt").write_text(f"red {k}\nblue {k}\n")
    stream = source.read_record_stream(spark, str(tmp_path / "in")).select(F.xxhash64("display").alias("id"), F.col("display").alias("search_text"))
    live = LiveSearch(str(tmp_path / "live"), "red")
    live.start(stream, str(tmp_path / "check")).awaitTermination()
    assert {r.display for r in live.results(spark).collect()} == {"red 0", "red 1"}
    with pytest.raises(ValueError):
        fields.slice_records(stream, tail=1)


def test_many_queries_in_one_scan(spark):
    items = spark.createDataFrame(list(enumerate(["red bolt", "blue gear", "red gear", "ring"])), "id long, search_text string")
    own = build_index(items)
    queries = {"a": "rd", "b": "gear", "c": "'red !bolt", "d": "zz"}
    got = search_many(own, queries, config=SearchConfig(limit=2)).collect()
    for name, query in queries.items():
        want = [(r.id, r.score) for r in search(own, query, config=SearchConfig(limit=2)).collect()]
        assert [(r.id, r.score) for r in sorted((x for x in got if x.query_id == name), key=lambda x: x["rank"])] == want


def test_highlight_and_outcome(spark):
    items = spark.createDataFrame([(0, "北京大学.txt"), (1, "notes.txt")], "id long, search_text string")
    own = build_index(items, backend=BACKENDS["zh"])
    found_rows = search(own, "bj", backend=BACKENDS["zh"])
    assert highlight(found_rows, own, "bj", backend=BACKENDS["zh"]).first().places == [0, 1]
    assert highlight_places("カメラ x", "kamera x", "RomajiReading", None, [("kam", "Original")]) == [0, 1, 2]
    rows = items.select("id", F.col("search_text").cast("binary").alias("raw"), F.col("search_text").alias("original"))
    done = filter_outcome(found_rows, rows, "bj", print_query=True)
    assert (done.output.decode(), done.code) == ("bj\n北京大学.txt\n", 0)
    assert filter_outcome(found_rows.limit(0), rows, "bj").code == 1


def test_width(spark):
    assert [width.width(t) for t in ("abc", "東京", "e\u0301", "")] == [3, 4, 1, 0]
    assert width.shorten("東京駅前", 5) == "東京…" and width.shorten("ab", 5) == "ab"
    df = spark.createDataFrame([("ab",), ("東京",)], "t string")
    assert [r[0] for r in df.select(width.width_col(F.col("t"))).collect()] == [2, 4]
