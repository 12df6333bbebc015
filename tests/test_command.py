"""A stream over a command: whole records, no loss and no repeats over a restart, failures as errors."""

import os
import time

import pytest

from resonar.sources.command import Spool, _Reader, command_stream


def _rows(spark, folder):
    return sorted(r.display for r in spark.read.schema("raw binary, display string, pos long").parquet(folder).collect()) if os.path.isdir(folder) else []


def _until(done, seconds=60):
    deadline = time.time() + seconds
    while not done() and time.time() < deadline:
        time.sleep(0.3)
    assert done()


def test_a_stream_goes_on_after_a_stop(spark, tmp_path):
    out, said = f"{tmp_path}/out", f"{tmp_path}/ran"
    go = f"{tmp_path}/go"
    command = f"echo x >> {said}; for i in 1 2 3 4 5; do echo line$i; done; while [ ! -e {go} ]; do sleep 0.2; done; for i in 6 7 8 9; do echo line$i; done; printf last"

    def start():
        stream = command_stream(spark, command, f"{tmp_path}/spool", part_bytes=10)
        return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/checkpoint").start()

    first = start()
    _until(lambda: len(_rows(spark, out)) >= 5)
    first.stop()
    before = len(_rows(spark, out))
    with open(go, "w"):
        pass
    second = start()
    want = [*sorted(f"line{k}" for k in range(1, 10))]
    try:
        _until(lambda: len(_rows(spark, out)) >= 10)
    finally:
        second.stop()
    assert _rows(spark, out) == sorted([*want, "last"]) and before == 5
    with open(said) as f:
        assert f.read() == "x\n"


def test_a_failing_command_is_an_error_after_its_output(spark, tmp_path):
    stream = command_stream(spark, "echo a; echo b; exit 3", f"{tmp_path}/spool")
    query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/checkpoint").start()
    with pytest.raises(Exception, match="ended with 3"):
        query.awaitTermination(60)
    assert _rows(spark, f"{tmp_path}/out") == ["a", "b"]


def _read_all(reader):
    out, at = [], reader.initialOffset()
    while True:
        end = reader.latestOffset()
        if end == at:
            return out
        out += [r for p in reader.partitions(at, end) for r in reader.read(p)]
        reader.commit(end)
        at = end


@pytest.mark.parametrize(("nul", "printed", "want"), [(False, r"a\nb\r\n\nlong record\n\nend", [b"a", b"b", b"", b"long record", b"", b"end"]), (True, r"a\0\0b\nc\0d", [b"a", b"b\nc", b"d"]), (False, "", [])])
def test_records_in_small_batches(tmp_path, nul, printed, want):
    for size in (1, 3, 1000):
        folder = f"{tmp_path}/{size}"
        reader = _Reader({"command": f"printf '{printed}'", "spool": folder, "nul": str(nul), "batchbytes": str(size), "partbytes": str(size)})
        _until(lambda folder=folder: os.path.exists(f"{folder}/code"))
        got = _read_all(reader)
        assert [r[0] for r in got] == want and len({r[2] for r in got}) == len(want)
        assert Spool(folder, "", nul).committed() == Spool(folder, "", nul).size()
        again = _Reader({"command": "exit 1", "spool": folder, "nul": str(nul)})
        assert again.latestOffset() == {"at": Spool(folder, "", nul).size()}
