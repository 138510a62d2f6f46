"""Logs of lines that grow: a Python data source whose position in the stream is a byte offset for each file.

``spark.readStream.format("tail").load(folder)`` gives every complete line once, with the offset at which it begins. A last line without its end is held back
until the end comes. A file that is shorter than what has been read of it was rewritten, and is read from its start again (``reset``). Large ranges are cut into
parts that tasks read on their own; a part gives the lines that begin in it, so none is read twice. Files are reached through the path's own file system.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "path string, offset long, reset boolean, line string"
#: Bytes that a task reads, and bytes that are read at a time.
PART_BYTES, BLOCK_BYTES = 64 << 20, 1 << 20


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _files(path: str, ending: str) -> list[tuple[str, int]]:
    """Path and size of the files of a folder and below it (or of the one file), hidden ones aside."""
    system, inner = _open(path)
    info = system.get_file_info(inner)
    if info.type == pafs.FileType.File:
        return [(inner, info.size)]
    if info.type == pafs.FileType.NotFound:
        return []
    found = system.get_file_info(pafs.FileSelector(inner, recursive=True))
    return sorted((x.path, x.size) for x in found if x.type == pafs.FileType.File and x.path.endswith(ending) and not x.base_name.startswith(("_", ".")))


def complete(system: pafs.FileSystem, path: str, size: int, block: int = BLOCK_BYTES) -> int:
    """The byte after the last end of line within the first ``size`` bytes; looks from the end, block by block."""
    with system.open_input_file(path) as f:
        end = size
        while end > 0:
            start = max(0, end - block)
            at = f.read_at(end - start, start).rfind(b"\n")
            if at >= 0:
                return start + at + 1
            end = start
    return 0


class Part(InputPartition):
    """Lines of ``path`` that begin in ``[start, stop)``, none beyond ``end``; ``aligned``: a line begins at ``start``."""

    def __init__(self, path: str, start: int, stop: int, end: int, aligned: bool, reset: bool):
        self.path, self.start, self.stop, self.end, self.aligned, self.reset = path, start, stop, end, aligned, reset


def parts_between(start: dict, end: dict, part_bytes: int) -> list[Part]:
    out = []
    for path, upto in sorted(end.items()):
        since = start.get(path, 0)
        reset = upto < since
        since = 0 if reset else since
        for at in range(since, upto, part_bytes):
            out.append(Part(path, at, min(upto, at + part_bytes), upto, at == since, reset))
    return out


def lines_of(system: pafs.FileSystem, part: Part, block: int = BLOCK_BYTES) -> Iterator[tuple[int, bytes]]:
    """Offset and bytes of the part's lines; no more than a block and a line are held."""
    with system.open_input_file(part.path) as f:
        # the byte before an unaligned part says whether a line begins with it
        at = read = part.start if part.aligned else part.start - 1
        skip, rest = not part.aligned, b""
        while at < part.stop:
            cut = rest.find(b"\n")
            while cut < 0 and read < part.end:
                more = f.read_at(min(block, part.end - read), read)
                if not more:  # the file was cut short meanwhile
                    return
                read += len(more)
                cut = more.find(b"\n")
                cut = cut + len(rest) if cut >= 0 else -1
                rest += more
            if cut < 0:
                return
            line, rest = rest[:cut], rest[cut + 1 :]
            if skip:
                skip = False
            elif line:
                yield at, line
            at += cut + 1


class _Reader:
    def __init__(self, options: dict):
        self.path = options["path"]
        self.ending = options.get("ending", "")
        self.part_bytes = int(options.get("partBytes", PART_BYTES))

    def state(self) -> dict:
        system, _ = _open(self.path)
        return {path: complete(system, path, size) for path, size in _files(self.path, self.ending)}

    def read(self, part: Part | None) -> Iterator[tuple]:
        if part is None:  # nothing to read
            return
        system, _ = _open(self.path)
        for at, line in lines_of(system, part):
            yield part.path, at, part.reset, line.decode("utf-8", "replace")


class _Batch(_Reader, DataSourceReader):
    def partitions(self) -> list[Part]:
        return parts_between({}, self.state(), self.part_bytes)


class _Stream(_Reader, DataSourceStreamReader):
    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        return self.state()

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return parts_between(start, end, self.part_bytes)


class Tail(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _Stream(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Tail)


def lines(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """All complete lines of the files at ``path``: ``path, offset, reset, line``."""
    register(spark)
    return spark.read.format("tail").options(**options).load(path)


def line_stream(spark: SparkSession, path: str, **options: str) -> DataFrame:
    register(spark)
    return spark.readStream.format("tail").options(**options).load(path)


# Where a line's time is told, in order.
TIMES = ["timestamp", "createdAt", "time", "created_at"]


def _time(line: Column, key: str) -> Column:
    """A number is seconds, or milliseconds from 1e11 on; a string is a date."""
    raw = F.get_json_object(line, f"$.{key}")
    number = F.try_to_number(F.when(raw.rlike(r"^-?[0-9]{1,18}$"), raw), F.lit("S999999999999999999")).cast("long")
    by_number = F.timestamp_millis(F.when(F.abs(number) < 100_000_000_000, number * 1000).otherwise(number))
    return F.when(raw.rlike(r"^-?[0-9]{1,18}$"), by_number).otherwise(F.try_to_timestamp(raw))


def transcript_events(rows: DataFrame) -> DataFrame:
    """Lines (``path, offset, reset, line``) as events: ``type, role, ts, source_event, seq, data``.

    A line that is no JSON is an event of its own (``custom``), one that is no object is the value of one. Identifier and sequence are the offset, so
    a line that is read again after a restart is told by them. ``ts`` is null where the line tells none.
    """
    value = F.try_parse_json("line")
    kind = F.schema_of_variant(value)
    is_object = kind.startswith("OBJECT")
    at = lambda key: F.when(F.try_variant_get(value, f"$.{key}", "string").isNotNull() & F.schema_of_variant(F.try_variant_get(value, f"$.{key}", "variant")).startswith("STRING"), F.try_variant_get(value, f"$.{key}", "string"))
    role, told = F.coalesce(at("role"), F.lit("")), F.lower(F.coalesce(at("type"), F.lit("")))
    calls = kind.rlike(r"(?:^OBJECT<|, )(?:toolCall|tool_call): ")
    of_object = (
        F.when((role == "user") | told.contains("user"), "user_prompt").when((role == "assistant") | told.contains("assistant") | told.contains("model"), "assistant_message")
        .when(told.contains("tool") | calls, "tool_call").when(told.contains("error"), "error").otherwise("message")
    )
    text = F.to_json(F.struct(F.lit("raw-line").alias("format"), F.col("line").alias("content")))
    return rows.select(
        "path", F.when(value.isNull(), F.lit("custom")).when(is_object, of_object).otherwise("message").alias("type"), F.when(is_object, at("role")).alias("role"), F.when(is_object, F.coalesce(*[_time(F.col("line"), k) for k in TIMES])).alias("ts"),
        F.concat(F.lit("transcript:"), F.col("offset")).alias("source_event"), F.col("offset").alias("seq"), "reset", F.when(value.isNull(), text).when(is_object, F.col("line")).otherwise(F.concat(F.lit('{"value":'), F.col("line"), F.lit("}"))).alias("data"),
    )
