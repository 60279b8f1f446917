"""Sources: JSON-lines pairs, split files, prepared tables, text lines, media files."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.joins import broadcast_if_small
from ..session import cut_lineage

PAIR_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("source_text", T.StringType()),
    T.StructField("target_text", T.StringType()),
    T.StructField("lang", T.StringType()),
])

_FORMATS = {"json": "json", "jsonl": "json", "csv": "csv", "parquet": "parquet", "txt": "text"}


def read_pairs(spark: SparkSession, paths_glob: str, schema: T.StructType = PAIR_SCHEMA) -> DataFrame:
    """Many JSON-lines files matched by a glob as one table, explicit schema (no inference pass)."""
    return spark.read.schema(schema).json(paths_glob)


def read_splits(spark: SparkSession, paths: Mapping[str, str], schema: T.StructType = PAIR_SCHEMA,
                split_col: str = "split", multi_line: bool = False) -> DataFrame:
    """One file (or folder) per split, format from the extension, as one table with a split column.

    ``multi_line`` allows line ends inside quoted CSV values; such files are still split among tasks (``read_records``).
    """
    out = None
    for split, path in paths.items():
        ext = os.path.basename(path.rstrip("/")).rsplit(".", 1)[-1].lower()
        fmt = _FORMATS.get(ext)
        if fmt is None:
            raise ValueError(f"cannot tell the format of {path} (split {split!r}) from its extension {ext!r}")
        reader = spark.read.schema(schema)
        if fmt == "csv" and multi_line:
            row = F.from_csv("record", schema.simpleString()[7:-1].replace(":", " "), {"escape": '"', "multiLine": "true"})
            df = read_records(spark, path).select(row.alias("_row")).select("_row.*")
        else:
            df = (reader.option("header", "true").option("escape", '"') if fmt == "csv" else reader).format(fmt).load(path)
        df = df.withColumn(split_col, F.lit(split))
        out = df if out is None else out.unionByName(df)
    if out is None:
        raise ValueError("no split given")
    return out


#: What a file split that starts within a value takes when it is sent to the tasks, and the most of all of them.
SPLIT_BYTES, MAX_SPLITS_BYTES = 1024, 64 * 1024 * 1024
#: Complete values of a line that starts a value, and the rest of a quoted value up to the next one. Possessive, so in linear time.
_VALUES = re.compile(r'(?:(?:"(?:[^"]|"")*+"[^,]*+|[^",][^,]*+|)(?:,|$))*+')
_REST = re.compile(r'(?:[^"]|"")*+"[^,]*+(?:,|$)')


def _ends_quoted(line: str, quoted: bool) -> bool:
    """Whether a line end after ``line`` falls in a quoted value, if the line starts in one (``quoted``) or at a value."""
    at = 0
    if quoted:
        rest = _REST.match(line)
        if rest is None:
            return True
        at = rest.end()
    return _VALUES.match(line, at).end() < len(line)


def read_records(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """(path, block, at, record): the records of CSV files whose quoted values may hold line ends, cut by many tasks.

    A line maps the state before it (at a value, in a quoted value) to the state after it. Each file split sums its lines
    up to such a map; a window over the splits (one row each) gives the state that each starts in; then every
    split cuts its own lines. Only a record that goes over the end of a split is put together from its parts, keyed by the
    split (``block``) and place (``at``) it starts at. Blank records are left out, and with ``header`` each file's first record.
    """
    raw = (spark.read.option("recursiveFileLookup", "true").option("lineSep", "\n").text(path)
                .select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block")))
    lines = raw.select("path", "block", F.regexp_replace("value", "\r$", "").alias("value"))

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends: dict[tuple, tuple[bool, bool]] = {}  # one entry per split of this task
        for batch in batches:
            for p, b, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x, y = ends.get((p, b), (False, True))
                if '"' in line:
                    x, y = _ends_quoted(line, x), _ends_quoted(line, y)
                ends[p, b] = x, y
        keys = list(ends)
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in keys], pa.string()), pa.array([b for _, b in keys], pa.int64()),
                                          pa.array([ends[k][0] for k in keys], pa.bool_()), pa.array([ends[k][1] for k in keys], pa.bool_())],
                                         names=["path", "block", "x", "y"])

    # A map is constant (x = y), or keeps the state, or turns it (x): the last constant, turned as often as there are turns after it.
    splits = lines.mapInArrow(maps, "path string, block long, x boolean, y boolean")
    turns = F.when(F.col("x") & ~F.col("y"), 1).otherwise(0)
    upto = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    splits = splits.withColumn("turns", F.sum(turns).over(upto))
    fixed = F.last(F.when(F.col("x") == F.col("y"), F.struct("x", "turns")), ignorenulls=True).over(upto)
    after = splits.withColumn("fixed", fixed).withColumn("after", F.pmod(F.coalesce(F.col("fixed.x").cast("int"), F.lit(0)) + F.col("turns")
                                                                         - F.coalesce("fixed.turns", F.lit(0)), F.lit(2)) == 1)
    order = Window.partitionBy("path").orderBy("block")
    starts = after.select(F.col("path").alias("_p"), F.col("block").alias("_b"), F.coalesce(F.lag("after").over(order), F.lit(False)).alias("quoted"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here: dict[tuple, list] = {}  # per split of this task: state, number of records begun, lines of the open one
        kind = pa.schema([("path", pa.string()), ("block", pa.int64()), ("at", pa.int64()), ("record", pa.string()), ("open", pa.bool_())])
        for batch in batches:
            out = []
            for p, b, line, quoted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                state = here.setdefault((p, b), [quoted, 0 if quoted else 1, []])
                state[2].append(line)
                state[0] = _ends_quoted(line, state[0]) if '"' in line else state[0]
                if not state[0]:
                    out.append((p, b, state[1], "\n".join(state[2]), False))
                    state[1:] = state[1] + 1, []
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 5, kind.types, strict=True)], schema=kind)
        last = [(p, b, at, "\n".join(held), True) for (p, b), (_, at, held) in here.items() if held]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*last, strict=True) if last else [[]] * 5, kind.types, strict=True)], schema=kind)

    # Few splits start within a value: sent to the tasks, they leave the lines in their order. More are joined, and the order made again.
    inside, n = broadcast_if_small(cut_lineage(starts.filter("quoted"), "quoted-splits"), row_bytes=SPLIT_BYTES, max_bytes=MAX_SPLITS_BYTES)
    states = (lines.withColumn("no", F.monotonically_increasing_id())
                   .join(inside, (F.col("path") == F.col("_p")) & (F.col("block") == F.col("_b")), "left"))
    if n * SPLIT_BYTES > MAX_SPLITS_BYTES:
        states = states.repartition("path", "block").sortWithinPartitions("path", "block", "no")
    states = states.select("path", "block", "value", F.coalesce("quoted", F.lit(False)).alias("quoted"))
    parts = states.mapInArrow(cut, "path string, block long, at long, record string, open boolean")
    # Place 0 of a split continues what an earlier split left open; at most two parts a split take part in this.
    loose = parts.filter((F.col("at") == 0) | F.col("open"))
    owner = F.last(F.when(F.col("at") > 0, F.struct("block", "at")), ignorenulls=True).over(Window.partitionBy("path").orderBy("block", "at"))
    joined = (loose.withColumn("of", owner).groupBy("path", "of").agg(F.sort_array(F.collect_list(F.struct("block", "at", "record"))).alias("ps"))
              .select("path", F.col("of.block").alias("block"), F.col("of.at").alias("at"), F.array_join(F.transform("ps", lambda e: e["record"]), "\n").alias("record")))
    records = parts.filter((F.col("at") > 0) & ~F.col("open")).drop("open").unionByName(joined).filter(F.trim("record") != "")
    if not header:
        return records
    first = records.groupBy("path").agg(F.min(F.struct("block", "at")).alias("_first")).withColumnRenamed("path", "_p")
    same = (F.col("path") == F.col("_p")) & (F.col("block") == F.col("_first.block")) & (F.col("at") == F.col("_first.at"))
    return records.join(first, same, "left_anti")


def read_prepared(spark: SparkSession, path: str) -> DataFrame:
    """S3: an already prepared columnar dataset."""
    return spark.read.parquet(path)


def read_table(spark: SparkSession, name: str) -> DataFrame:
    """A named table or view of the catalog (no download step)."""
    return spark.table(name)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, line) for text files; every line is kept, numbered from 1.

    Files are split among tasks as usual. Each split numbers its own lines, which are stored, so that all that follows
    meets the same splits; the lines of the splits before it are added (one row per split). A final newline ends the last
    line and starts no new one.
    """
    raw = (spark.read.option("recursiveFileLookup", "true").option("lineSep", "\n").text(path)
                .select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block")))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, int] = {}  # one entry per split of this task
        for batch in batches:
            keys = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
            at = []
            for k in keys:
                seen[k] = seen.get(k, 0) + 1
                at.append(seen[k])
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(at, pa.int64()), batch.column(0)],
                                             names=["path", "block", "at", "line"])

    lines = cut_lineage(raw.mapInArrow(number, "path string, block long, at long, line string"), "numbered-lines")
    w = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = (lines.groupBy("path", "block").agg(F.count(F.lit(1)).alias("n"))
                   .select(F.col("path").alias("_p"), F.col("block").alias("_b"), F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before")))
    before, _ = broadcast_if_small(before)
    return (lines.join(before, (F.col("path") == F.col("_p")) & (F.col("block") == F.col("_b")))
                 .select("path", (F.col("before") + F.col("at")).alias("line_no"), "line"))


def line_at(lines: DataFrame, i: int) -> DataFrame:
    """Line ``i`` (1-based) of every file."""
    return lines.filter(F.col("line_no") == i)


def read_merges(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """A published merges file (plain or gzip) as (rank, left, right).

    The first line is a header; each further line holds two symbols apart by a space, and its order is
    the rank. ``most`` lines are read at most: published files hold more merges than their vocabulary uses (the one that
    goes with the published start and end ids 48 894). A merges file is one model parameter of bounded size, so it is read as one text.
    """
    text = spark.read.text(path, wholetext=True).select(F.split(F.regexp_replace("value", r"\n$", ""), "\n").alias("lines"))
    lines = text.select(F.posexplode(F.slice("lines", 2, 2_147_483_647 if most is None else most)).alias("rank", "line"))
    sides = F.split("line", " ")
    return lines.where(F.size(sides) == 2).select(F.col("rank").cast("long").alias("rank"), sides[0].alias("left"), sides[1].alias("right"))


def read_media(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Files as (path, length, content) bytes; decoding is left to the caller."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select("path", "length", "content")


# Leading bytes (hexadecimal) of image formats; a dot stands for any digit.
IMAGE_MAGIC = {
    "png": "89504E470D0A1A0A",
    "jpeg": "FFD8FF",
    "gif": "474946383",
    "bmp": "424D",
    "webp": "52494646........57454250",
    "tiff_le": "49492A00",
    "tiff_be": "4D4D002A",
    "ico": "00000100",
    "jpeg2000": "0000000C6A502020",
    "avif": "........6674797061766966",
    "pnm": "503[1-6](09|0A|0D|20)",
}


def image_header_ok(content_col: str = "content", formats: Sequence[str] | None = None) -> Column:
    """P6 probe: the bytes start like an image of one of ``formats`` (default: all in ``IMAGE_MAGIC``)."""
    magic = "|".join(IMAGE_MAGIC[f] for f in (formats or IMAGE_MAGIC))
    return F.hex(F.substring(F.col(content_col), 1, 12)).rlike(f"^(?:{magic})")


def drop_unreadable(df: DataFrame, content_col: str = "content", formats: Sequence[str] | None = None) -> DataFrame:
    """Keep rows whose payload opens (header probe), native filter before any decode."""
    return df.filter(image_header_ok(content_col, formats))


def drop_unparsable_json(df: DataFrame, col: str) -> DataFrame:
    """P6 for JSON payloads: keep rows that parse."""
    return df.filter(F.try_parse_json(F.col(col)).isNotNull())


def verify_checksums(files: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """sha256 of the content equals the digest in the second-to-last path part."""
    digest = F.element_at(F.split(F.col(path_col), "/"), -2)
    return files.withColumn("checksum_ok", F.sha2(F.col(content_col), 256) == F.lower(digest))
