"""Reading of raw logs, label files and predictions; writing of tables.

Line numbers follow (file, block, place in block). Lines are capped at CAP characters.
Missing paths raise the reader's error, but for the label file: without it (or with path None)
there are no labels, and every group counts as normal. JSON lines that are no record of the asked
kind are rejects: with file, line number and reason in a table of their own, or an error.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CAP = 4096
BLOCK_ID = r"blk_-?\d+"
INSTANCE_ID = r"\[instance:\s*([^\]]+)\]"
PREDICTION = "group_id string, y_true int, y_pred int, p_anomaly double"
REQUEST = "request_id string, id string, lines array<string>"
#: Bytes of a file that its digest holds at once; files that one digest task gets, more only beyond DIGEST_TASKS tasks.
DIGEST_CHUNK, DIGEST_TASKS = 4 << 20, 10_000


def read_lines(spark: SparkSession, path: str, system: str) -> DataFrame:
    """(system, path, line_no, value): raw lines with a stable number in each file set."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    counts = raw.groupBy("path", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    # One row a block: the running sum over blocks is small.
    before = F.sum("n").over(Window.orderBy("path", "block").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("path", "block", F.coalesce(before, F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("path", "block").orderBy("at")) - 1
    joined = raw.withColumn("place", place).join(starts, ["path", "block"])
    return joined.select(F.lit(system).alias("system"), "path", (F.col("start") + F.col("place")).alias("line_no"), "value")


def prefix_label(value: Column) -> tuple[Column, Column]:
    """(label, text) of a line that starts with its label: `-` is normal, anything else anomalous."""
    line = F.regexp_replace(value, r"[\r\n]+\z", "")
    first = F.substring_index(line, " ", 1)
    rest = F.when(F.instr(line, " ") > 0, F.regexp_extract(line, r"(?s)\A[^ ]* (.*)\z", 1)).otherwise(F.lit(""))
    return F.when(first == "-", 0).otherwise(1), F.substring(F.when(rest == "", line).otherwise(rest), 1, CAP)


def parse_prefixed(lines: DataFrame, value: str = "value") -> DataFrame:
    """lines with label and text; empty lines go."""
    label, text = prefix_label(F.col(value))
    return lines.where(F.regexp_replace(value, r"[\r\n]+\z", "") != "").withColumns({"label": label, "text": text})


def session_key(value: Column, kind: str) -> Column:
    """Block or instance id in the capped raw line; empty if there is none."""
    line = F.substring(value, 1, CAP)
    return F.regexp_extract(line, BLOCK_ID, 0) if kind == "block" else F.trim(F.regexp_extract(line, INSTANCE_ID, 1))


def parse_sessions(lines: DataFrame, kind: str, value: str = "value") -> DataFrame:
    """lines with group_id and text; lines without an id go."""
    return lines.withColumns({"group_id": session_key(F.col(value), kind), "text": F.substring(value, 1, CAP)}).where("group_id <> ''")


def read_labels(spark: SparkSession, path: str | None, trim: bool = False) -> DataFrame:
    """(group_id, label) from a two-column CSV; a header may stand first in a file, the last of equal ids, by file and place, counts."""
    none = spark.createDataFrame([], "group_id string, label int")
    if path is None:
        return none
    try:
        raw = spark.read.schema("id string, mark string").csv(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return none
    at = F.monotonically_increasing_id().alias("at")
    rows = raw.select("id", "mark", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), at)
    named = F.col("mark").isNotNull() & F.lower("id").isin("blockid", "instanceid")
    # A header is the first row of its file's first block; the few rows that look like one are met with it.
    heads = rows.where(F.col("block") == 0).groupBy("file").agg(F.min("at").alias("at")).join(rows.where(named).select("file", "at"), ["file", "at"], "left_semi")
    rows = rows.join(heads.select("at"), "at", "left_anti").where(F.col("mark").isNotNull())
    key = F.trim("id") if trim else F.col("id")
    return rows.groupBy(key.alias("group_id")).agg(F.max_by(F.when(F.lower(F.trim("mark")) == "anomaly", 1).otherwise(0), F.struct("file", "block", "at")).alias("label"))


def read_records(spark: SparkSession, path: str, schema: str, required: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """JSON lines as (records, rejects): every line that is not blank is in one of them.

    records: the schema's columns and the folder's partition columns. rejects: (path, line_no, reason,
    value); the line number counts from 0 in its file. Reasons: `not a record`, or `no <field>`.
    """
    raw = spark.read.text(path)
    parts = [c for c in raw.columns if c != "value"]
    lines = raw.select(*parts, "value", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    got = F.from_json("value", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    rows = lines.where(F.trim("value") != "").withColumn("_r", got)
    reason = F.when(F.col("_r").isNull() | F.col("_r._corrupt").isNotNull(), "not a record")
    for name in required:
        reason = reason.when(F.col("_r")[name].isNull(), f"no {name}")
    rows = rows.withColumn("reason", reason)
    names = [c.name for c in spark.createDataFrame([], schema).schema]
    records = rows.where("reason is null").select(*[F.col("_r")[n].alias(n) for n in names], *parts)
    # Numbers are consecutive inside a block, so only rejects are met with the blocks' first numbers.
    blocks = lines.groupBy("_path", "_block").agg(F.count("*").alias("n"), F.min("_at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("_path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = blocks.select("_path", "_block", (before - F.col("first")).alias("start"))
    rejects = rows.where("reason is not null").join(starts, ["_path", "_block"])
    return records, rejects.select(F.col("_path").alias("path"), (F.col("start") + F.col("_at")).alias("line_no"), "reason", "value")


def accepted(found: tuple[DataFrame, DataFrame], strict: bool, rejects: str | None) -> DataFrame:
    """The records; rejects are written to a path if one is given, else with strict the first ones are an error."""
    records, bad = found
    if rejects:
        bad.write.json(rejects)
    elif strict and (some := bad.limit(3).collect()):
        raise ValueError("; ".join(f"{r.path} line {r.line_no}: {r.reason}" for r in some))
    return records


def read_predictions(spark: SparkSession, path: str, strict: bool = True, rejects: str | None = None) -> DataFrame:
    """(group_id, y_true, y_pred, p_anomaly); a line without one of the last three is a reject."""
    return accepted(read_records(spark, path, PREDICTION, ("y_true", "y_pred", "p_anomaly")), strict, rejects)


def read_requests(spark: SparkSession, path: str, strict: bool = True, rejects: str | None = None) -> DataFrame:
    """(request_id, id, lines); a line that is no such record is a reject. Rules for its values are validate()'s."""
    return accepted(read_records(spark, path, REQUEST, ()), strict, rejects)


def write_predictions(predictions: DataFrame, path: str, mode: str = "error") -> None:
    predictions.select("fold", "group_id", "y_true", "y_pred", "p_anomaly").write.mode(mode).partitionBy("fold").json(path)


def write_csv(table: DataFrame, path: str, decimals: int = 6) -> None:
    """CSV with header; doubles with fixed decimals, nulls empty."""
    cols = [F.format_string(f"%.{decimals}f", F.col(n)).alias(n) if t == "double" else F.col(n) for n, t in table.dtypes]
    cols = [F.when(F.col(n).isNotNull(), c).alias(n) for (n, _), c in zip(table.dtypes, cols, strict=True)]
    table.select(*cols).write.option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def write_report(table: DataFrame, path: str) -> None:
    table.write.json(path)


def sha256_of(path: str) -> tuple[str, int]:
    """(hex SHA-256, bytes) of a file of any store that pyarrow opens; a chunk is held at a time. Names are as Spark lists them."""
    from pyarrow import fs as pafs

    local = re.fullmatch("(?:file:)?/+(.*)", path, re.DOTALL)
    store, name = (pafs.LocalFileSystem(), f"/{local[1]}") if local else pafs.FileSystem.from_uri(path)
    digest, size = hashlib.sha256(), 0
    with store.open_input_file(name) as source:
        while chunk := source.read(DIGEST_CHUNK):
            digest.update(chunk)
            size += len(chunk)
    return digest.hexdigest(), size


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column("path").to_pylist():
            digest, size = sha256_of(path)
            yield pa.RecordBatch.from_pydict({"path": [path], "sha256": [digest], "bytes": [size]})


def digests(files: DataFrame) -> DataFrame:
    """(path, sha256, bytes) of files (path), each streamed by one task, whatever its size.

    A path that Spark alone resolves (viewfs) is read by Spark from files_in()'s content, 2 GB of a file at most.
    """
    rows = files.select("path")
    if "content" in files.columns and rows.where(F.col("path").startswith("viewfs:")).limit(1).count():
        return files.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))
    return rows.repartition(max(1, min(DIGEST_TASKS, rows.count()))).mapInArrow(_digests, "path string, sha256 string, bytes long")


def files_in(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, modificationTime, length, content) of the files under a folder, not read unless content is asked for."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)


def table_digests(files: DataFrame, root: str) -> DataFrame:
    """(name, sha256) of each file or folder right under root that files (path) stand in.

    A file has its own digest; a folder that of its lines `<path in the folder> <digest>` in order of path.
    """
    spark = files.sparkSession
    top = spark._jvm.org.apache.hadoop.fs.Path(root)
    above = len(top.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(top).toString()) + 2
    below = F.split(F.col("path").substr(F.lit(above), F.length("path")), "/", 2)
    parts = digests(files).select(below[0].alias("name"), F.get(below, 1).alias("part"), "sha256")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("part", "sha256"))), lambda x: F.concat_ws(" ", x["part"], x["sha256"]))  # a line a file
    return parts.groupBy("name").agg(F.when(F.max("part").isNull(), F.max("sha256")).otherwise(F.sha2(F.array_join(lines, "\n"), 256)).alias("sha256"))


def verify_checksums(files: DataFrame, expected: DataFrame, root: str | None = None) -> DataFrame:
    """(name, sha256, status): ok, new, mismatch or missing; files: (path), expected: (name, sha256). With root a name is one right under it, a file or a folder of files."""
    have = table_digests(files, root) if root else digests(files).select(F.element_at(F.split("path", "/"), -1).alias("name"), "sha256")
    both = have.withColumnRenamed("sha256", "have").join(expected.select("name", F.col("sha256").alias("want")), "name", "full")
    status = F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "new").when(F.col("have") == F.col("want"), "ok").otherwise("mismatch")
    return both.select("name", F.coalesce("have", "want").alias("sha256"), status.alias("status"))


def read_published(path: str) -> list[dict]:
    """Records of a YAML file of published results: a list, or one under `baselines`."""
    import yaml

    with open(path, encoding="utf-8") as source:
        held = yaml.safe_load(source) or []
    return held.get("baselines") or [] if isinstance(held, dict) else held


def published_table(spark: SparkSession, records: list[dict]) -> DataFrame:
    """(method, year, fold, f1, macro_f1) from records of published results; what is missing or no number is null."""
    number = lambda x: float(x) if isinstance(x, int | float) and not isinstance(x, bool) else None
    rows = [(r["method"], r.get("year"), fold, number((v or {}).get("f1")), number(r.get("macro_f1"))) for r in records for fold, v in (r.get("per_fold") or {None: None}).items()]
    return spark.createDataFrame(rows, "method string, year int, fold string, f1 double, macro_f1 double")
