"""A stream over what a running command prints.

The command writes into a spool in a shared folder and outlives the stream that started it, so that a stream which is
stopped, or whose driver is lost, goes on from its checkpoint: offsets are places in the spool after whole records, what was
not committed is read again from there, and the command is not started twice.
"""

from __future__ import annotations

import json
import os
import subprocess
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes of one micro-batch and of one partition at most, but for longer records.
BATCH, PART = 64 << 20, 8 << 20
_STEP = 1 << 20


@dataclass
class _Range(InputPartition):
    path: str
    start: int
    stop: int
    nul: bool


class Spool:
    """A command's output so far, its end, and how far it has been taken."""

    def __init__(self, folder: str, command: str, nul: bool):
        self.folder, self.command, self.nul = folder.removeprefix("file://"), command, nul
        self.output = os.path.join(self.folder, "output")
        self.end = b"\0" if nul else b"\n"

    def _at(self, name: str) -> str:
        return os.path.join(self.folder, name)

    def start(self) -> None:
        """Starts the command unless that has been done before. Its exit code is written when it ends."""
        os.makedirs(self.folder, exist_ok=True)
        try:
            mark = os.open(self._at("started"), os.O_CREAT | os.O_EXCL | os.O_WRONLY)
        except FileExistsError:
            return
        shell = os.environ.get("SHELL", "sh")
        wrapped = f'"$0" -c "$1" >> "$2"; code=$?; echo $code > "$3.part" && mv "$3.part" "$3"'
        with open(os.devnull) as nothing:
            own = subprocess.Popen(["sh", "-c", wrapped, shell, self.command, self.output, self._at("code")], stdin=nothing, start_new_session=True)
        with os.fdopen(mark, "w") as f:
            f.write(str(own.pid))

    def code(self) -> int | None:
        """The exit code; None while the command runs. A command that is gone without one is an error."""
        for last in (False, True):
            if os.path.exists(self._at("code")):
                with open(self._at("code")) as f:
                    return int(f.read())
            if last:
                break
            with open(self._at("started")) as f:
                pid = f.read().strip()
            try:
                if not pid:
                    return None
                os.kill(int(pid), 0)
                return None
            except ProcessLookupError:
                continue
            except PermissionError:
                return None
        raise RuntimeError(f"{self.command!r} is gone and has left no exit code")

    def committed(self) -> int:
        try:
            with open(self._at("committed")) as f:
                return json.load(f)
        except FileNotFoundError:
            return 0

    def commit(self, at: int) -> None:
        with open(self._at("committed.part"), "w") as f:
            json.dump(at, f)
        os.replace(self._at("committed.part"), self._at("committed"))

    def size(self) -> int:
        return os.path.getsize(self.output) if os.path.exists(self.output) else 0

    def last_end(self, low: int, high: int) -> int:
        """The place after the last whole record in a range; low where there is none."""
        if high <= low:
            return low
        with open(self.output, "rb") as f:
            at = high
            while at > low:
                begin = max(low, at - _STEP)
                f.seek(begin)
                k = f.read(at - begin).rfind(self.end)
                if k >= 0:
                    return begin + k + 1
                at = begin
        return low

    def next_end(self, low: int, high: int) -> int:
        """The place after the first whole record from low on; high where there is none."""
        with open(self.output, "rb") as f:
            f.seek(low)
            at = low
            while at < high:
                data = f.read(min(_STEP, high - at))
                k = data.find(self.end)
                if k >= 0:
                    return at + k + 1
                at += len(data)
        return high


class _Reader(DataSourceStreamReader):
    def __init__(self, options):
        if "command" not in options or "spool" not in options:
            raise ValueError("a command stream wants the options command and spool")
        self.spool = Spool(options["spool"].rstrip("/"), options["command"], options.get("nul", "false").lower() == "true")
        self.batch, self.part = int(options.get("batchbytes", BATCH)), int(options.get("partbytes", PART))
        self.spool.start()
        self.now = self.spool.committed()

    def initialOffset(self) -> dict:
        return {"at": 0}

    def latestOffset(self) -> dict:
        code = self.spool.code()  # before the size: what was printed before the end counts
        size = self.spool.size()
        high = min(size, self.now + self.batch)
        at = self.spool.last_end(self.now, high)
        if at == self.now and high > self.now:  # a record longer than a batch, or the last one without an end
            at = self.spool.next_end(self.now, size)
            if code is None and at == size and self.spool.last_end(self.now, size) != size:
                at = self.now
        elif high == size and code is not None:
            at = size
        if code and at == self.now:
            raise RuntimeError(f"{self.spool.command!r} ended with {code}")
        self.now = at
        return {"at": at}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out, at = [], start["at"]
        while at < end["at"]:
            stop = min(end["at"], at + self.part)
            if stop < end["at"]:
                stop = self.spool.last_end(at, stop) if self.spool.last_end(at, stop) > at else self.spool.next_end(at, end["at"])
            out.append(_Range(self.spool.output, at, stop, self.spool.nul))
            at = stop
        self.now = max(self.now, end["at"])
        return out

    def read(self, partition: _Range):
        with open(partition.path, "rb") as f:
            f.seek(partition.start)
            at = partition.start
            data = f.read(partition.stop - partition.start)
        end = b"\0" if partition.nul else b"\n"
        for record in data.removesuffix(end).split(end) if data else ():
            size = len(record) + 1
            if partition.nul and not record:
                at += size
                continue
            raw = record if partition.nul or not record.endswith(b"\r") else record[:-1]
            yield raw, raw.decode("utf-8", "replace"), at
            at += size

    def commit(self, end: dict) -> None:
        self.spool.commit(end["at"])


class CommandSource(DataSource):
    """spark.readStream.format("command").option("command", "tail -f log").option("spool", "/shared/folder").load()"""

    @classmethod
    def name(cls):
        return "command"

    def schema(self):
        return "raw binary, display string, pos long"

    def streamReader(self, schema):
        return _Reader(self.options)


def command_stream(spark: SparkSession, command: str, spool: str, *, nul: bool = False, batch_bytes: int = BATCH, part_bytes: int = PART) -> DataFrame:
    """raw, display and place in the output of each record that a shell command prints, as it prints them.

    spool is a folder that driver and executors share, one for each run of a command. Records end as those of read_records
    do; a last one without an end counts once the command has ended. A command that fails ends the stream with an error
    after its output has been read.
    """
    spark.dataSource.register(CommandSource)
    reader = spark.readStream.format("command").option("command", command).option("spool", spool).option("nul", str(nul).lower())
    return reader.option("batchbytes", batch_bytes).option("partbytes", part_bytes).load()
