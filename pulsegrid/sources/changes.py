"""A replayable feed of change events as a streaming source: `spark.readStream.format("changes")`.

A feed is a folder of JSON-lines segments, named `<number of the first event>-<its second>.jsonl`, as a relay of a change
stream keeps them. An offset is the number of the next event, so a query that was stopped goes on at the event after its
last one. A query without a checkpoint begins at the `position` option, or else replays the last `replay_minutes` before
the newest event, or the whole feed with `replay_minutes` "all". Segments of a feed grow with it, so that it has no more than SEGMENTS of
them, and a replay no more batches, however many events there are.

Options: path (a URI that pyarrow can open), position, replay_minutes (60), batch_events (events of a batch, rounded up to
segments). A segment is read in parts of PART events, each a partition; events are parsed on the executors. An availableNow trigger asks a Python source
for its latest offset once, so it reads one batch: leave batch_events out there.

Defined results: lines that are no JSON objects are skipped, but keep their number; unknown fields are ignored, missing
ones null. A feed may grow while it is read; a segment may not.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "position long, event_id long, wiki string, namespace int, type string, bot boolean, title string, user string, comment string, tags array<string>, timestamp long, dt string"


#: Segments of a feed about, events of one at least, and events of a partition at most.
SEGMENTS, LEAST, PART = 256, 2000, 20_000


def segment_name(first: int, second: int) -> str:
    return f"{first:015d}-{second:012d}.jsonl"


def write_segments(events: DataFrame, path: str, order: list[str], seconds: str, size: int | None = None) -> None:
    """Write events as a feed, numbered by their order; seconds is the column with an event's second. Numbers are counts of the
    ranges before and places within the own range. size is the events of a segment; unset, it follows from all events."""
    ranged = events.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    ranged = ranged.persist()
    counts = dict(ranged.groupBy(F.shiftright("_at", 33)).count().collect())  # a row a range
    before, total = {}, 0
    for part in sorted(counts):
        before[part] = total
        total += counts[part]
    size = size or max(LEAST, -(-total // SEGMENTS))
    first = F.element_at(F.create_map(*[F.lit(x) for pair in before.items() for x in pair]), F.shiftright("_at", 33)) if before else F.lit(0)
    numbered = ranged.withColumn("position", first + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at")
    columns = [c for c in numbered.columns if c != "position"]
    lines = numbered.select("position", F.col(seconds).alias("_second"), F.to_json(F.struct(*columns)).alias("line"), F.floor(F.col("position") / size).alias("segment"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, top = fs.FileSystem.from_uri(path)
        files.create_dir(top)
        out, own, n = None, None, 0
        for b in batches:
            for position, second, line, segment in zip(*[c.to_pylist() for c in b.columns]):
                if segment != own:
                    if out:
                        out.close()
                    own, n = segment, n + 1
                    out = files.open_output_stream(f"{top}/{segment_name(position, second)}", buffer_size=1 << 20)
                out.write(f"{line}\n".encode())
        if out:
            out.close()
        yield pa.RecordBatch.from_pydict({"segments": pa.array([n], pa.int64())})

    lines.repartition("segment").sortWithinPartitions("segment", "position").mapInArrow(write, "segments long").agg(F.sum("segments")).collect()
    ranged.unpersist()


class Segment(InputPartition):
    def __init__(self, name: str, low: int, high: int):
        self.name, self.low, self.high = name, low, high


class ChangeReader(DataSourceStreamReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.schema, self.path = schema, options["path"]
        self.size = int(options.get("batch_events", 1 << 62))
        self.start, self.replay = options.get("position"), options.get("replay_minutes", "60")
        self.last: int | None = None

    def segments(self) -> list[tuple[int, int, str]]:
        """(first event, its second, name) of every segment, in order."""
        files, top = fs.FileSystem.from_uri(self.path)
        names = sorted(i.base_name for i in files.get_file_info(fs.FileSelector(top, allow_not_found=True)) if i.base_name.endswith(".jsonl"))
        return [(int(n.split("-")[0]), int(n.split("-")[1][:-6]), n) for n in names]

    def lines(self, name: str) -> list[bytes]:
        files, top = fs.FileSystem.from_uri(self.path)
        with files.open_input_stream(f"{top}/{name}") as f:
            return f.read().splitlines()

    def end(self, found: list[tuple[int, int, str]]) -> int:
        return found[-1][0] + len(self.lines(found[-1][2])) if found else 0

    def initialOffset(self) -> dict:
        found = self.segments()
        if self.start is not None:
            return {"position": int(self.start)}
        if self.replay == "all" or not found:
            return {"position": found[0][0] if found else 0}
        newest = max(second_of(x) or 0 for x in self.lines(found[-1][2])) if found else 0
        since = newest - 60 * int(self.replay)
        earlier = [s for s in found if s[1] < since]
        if not earlier:
            return {"position": found[0][0]}
        # the segment that the moment falls in, from its first event at or after it
        first, _, name = earlier[-1]
        for k, line in enumerate(self.lines(name)):
            if (second_of(line) or 0) >= since:
                return {"position": first + k}
        return {"position": next((s[0] for s in found if s[0] > first), self.end(found))}

    def latestOffset(self) -> dict:
        found = self.segments()
        if self.last is None:
            return {"position": self.end(found)} if self.size >= 1 << 62 else self._after(found, self.initialOffset()["position"])
        return self._after(found, self.last)

    def _after(self, found: list, position: int) -> dict:
        """The end of the segment that makes the batch large enough, or of the feed."""
        ends = [s[0] for s in found[1:]] + [self.end(found)]
        reached = next((e for e in ends if e >= position + self.size), ends[-1] if ends else 0)
        return {"position": max(position, reached)}

    def partitions(self, start: dict, end: dict) -> list[Segment]:
        found, low, high = self.segments(), start["position"], end["position"]
        self.last = high
        bounds = [s[0] for s in found[1:]] + [1 << 62]
        whole = [(name, max(low, first), min(high, bound)) for (first, _, name), bound in zip(found, bounds) if first < high and bound > low]
        return [Segment(name, k, min(k + PART, end)) for name, begin, end in whole for k in range(begin, end, PART)]

    def read(self, partition: Segment) -> Iterator[tuple]:
        first = int(partition.name.split("-")[0])
        for k, line in enumerate(self.lines(partition.name), first):
            if partition.low <= k < partition.high and (event := parsed(line)) is not None:
                yield tuple(k if f.name == "position" else fitting(event.get(f.name), f.dataType) for f in self.schema)

    def commit(self, end: dict) -> None:
        self.last = end["position"]


def parsed(line: bytes) -> dict | None:
    try:
        event = json.loads(line)
    except ValueError:
        return None
    return event if isinstance(event, dict) else None


def second_of(line: bytes) -> int | None:
    event = parsed(line)
    return event.get("timestamp") if event and isinstance(event.get("timestamp"), int) else None


def fitting(value, kind: T.DataType):
    """The value if it has the column's type, else null."""
    fits = {T.LongType: int, T.IntegerType: int, T.StringType: str, T.BooleanType: bool, T.ArrayType: list}[type(kind)]
    return value if isinstance(value, fits) and not (fits is int and isinstance(value, bool)) else None


class ChangeSource(DataSource):
    """Registered with `spark.dataSource.register(ChangeSource)`."""

    @classmethod
    def name(cls) -> str:
        return "changes"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: T.StructType) -> ChangeReader:
        return ChangeReader(schema, dict(self.options))
