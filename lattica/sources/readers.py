"""Readers of the source formats, each with a declared schema; what can't be read is set aside, not fatal."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructType

#: Kinds of quarterly adverse-event files by their names.
REPORT_KINDS = ("DEMO", "DRUG", "REAC", "OUTC", "RPSR", "THER", "INDI")


def delimited_reports(spark: SparkSession, path: str, kind: str, schema: str) -> DataFrame:
    """Rows of '$'-delimited files of a kind, with the file that each came from; broken rows go to _corrupt_record."""
    if kind not in REPORT_KINDS:
        raise ValueError(f"unknown kind {kind}")
    rows = spark.read.option("sep", "$").option("header", True).option("mode", "PERMISSIVE").option("pathGlobFilter", f"*{kind}*").option("recursiveFileLookup", True).schema(f"{schema}, _corrupt_record string").csv(path)
    return rows.withColumn("file", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1))


STUDY = """protocolSection STRUCT<identificationModule: STRUCT<nctId: STRING, briefTitle: STRING>, statusModule: STRUCT<overallStatus: STRING, startDateStruct: STRUCT<date: STRING>>,
    designModule: STRUCT<phases: ARRAY<STRING>, studyType: STRING, enrollmentInfo: STRUCT<count: INT>>, conditionsModule: STRUCT<conditions: ARRAY<STRING>>,
    armsInterventionsModule: STRUCT<interventions: ARRAY<STRUCT<type: STRING, name: STRING>>>, contactsLocationsModule: STRUCT<locations: ARRAY<STRUCT<facility: STRING, city: STRING, country: STRING>>>,
    sponsorCollaboratorsModule: STRUCT<leadSponsor: STRUCT<name: STRING>>, adverseEventsModule: STRUCT<seriousEvents: ARRAY<STRUCT<term: STRING, organSystem: STRING>>>>"""


def studies(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """Trial records (one JSON object or a list of them a file) as flat rows; since: only those that start from a day on."""
    p = F.col("protocolSection")
    rows = spark.read.option("multiLine", True).schema(STUDY).json(path).filter(p["identificationModule"]["nctId"].isNotNull())
    out = rows.select(
        p["identificationModule"]["nctId"].alias("trial_id"),
        p["identificationModule"]["briefTitle"].alias("title"),
        p["statusModule"]["overallStatus"].alias("status"),
        F.try_to_date(p["statusModule"]["startDateStruct"]["date"], "yyyy-MM-dd").alias("start_date"),
        F.get(p["designModule"]["phases"], 0).alias("phase"),
        p["designModule"]["enrollmentInfo"]["count"].alias("enrollment"),
        p["conditionsModule"]["conditions"].alias("conditions"),
        p["armsInterventionsModule"]["interventions"].alias("interventions"),
        p["contactsLocationsModule"]["locations"].alias("locations"),
        p["sponsorCollaboratorsModule"]["leadSponsor"]["name"].alias("sponsor"),
        p["adverseEventsModule"]["seriousEvents"].alias("serious_events"),
    )
    return out if since is None else out.filter(F.col("start_date") >= F.lit(since).cast("date"))


DRUG = """`drugbank-id` ARRAY<STRUCT<_VALUE: STRING, _primary: BOOLEAN>>, name STRING, groups STRUCT<group: ARRAY<STRING>>, indication STRING,
    targets STRUCT<target: ARRAY<STRUCT<id: STRING, name: STRING, actions: STRUCT<action: ARRAY<STRING>>>>>, `drug-interactions` STRUCT<`drug-interaction`: ARRAY<STRUCT<`drugbank-id`: STRING, name: STRING, description: STRING>>>"""


def drugs(spark: SparkSession, path: str, include: tuple[str, ...] = ("approved", "experimental"), exclude: tuple[str, ...] = ("withdrawn", "illicit")) -> DataFrame:
    """Drug elements of a large XML file, read in splits, of the groups wanted."""
    rows = spark.read.format("xml").option("rowTag", "drug").schema(DRUG).load(path)
    ids = F.col("`drugbank-id`")
    primary = F.coalesce(F.get(F.filter(ids, lambda x: x["_primary"]), 0)["_VALUE"], F.get(ids, 0)["_VALUE"])
    groups = F.coalesce(F.col("groups.group"), F.array().cast("array<string>"))
    wanted = F.arrays_overlap(groups, F.array(*map(F.lit, include))) & ~F.arrays_overlap(groups, F.array(*map(F.lit, exclude)))
    return rows.filter(primary.isNotNull()).filter(wanted).select(primary.alias("id"), "name", groups.alias("groups"), "indication", F.col("targets.target").alias("targets"), F.col("`drug-interactions`.`drug-interaction`").alias("interactions"))


@F.pandas_udf(StringType())
def _decoded(content: pd.Series) -> pd.Series:
    """UTF-8 if valid, else GBK with what isn't valid replaced; Spark's own decode() has no GBK."""

    def one(x: bytes) -> str:
        try:
            return x.decode("utf-8")
        except UnicodeDecodeError:
            return x.decode("gbk", "replace")

    return content.map(one)


def text_documents(spark: SparkSession, path: str, glob: str = "*.txt", most_bytes: int = 50 << 20, most_chars: int = 50_000) -> DataFrame:
    """Text files as documents: digest, title (first line), content cut to a length; UTF-8 or, if not valid, GBK."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path).filter(F.col("length") <= most_bytes)
    content = _decoded("content")
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.trim(F.get(F.split(content, "\n"), 0)).alias("title"), F.left(content, F.lit(most_chars)).alias("text"))


def json_records(spark: SparkSession, path: str, record: str) -> DataFrame:
    """Records of files that hold a list, {"data": [...]}, {"results": [...]} or one object. record: a DDL struct body."""
    files = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    trimmed = F.trim("value")
    many = f"array<struct<{record}>>"
    as_list = F.when(trimmed.startswith("["), F.from_json("value", many))
    inner = F.from_json("value", f"struct<data: {many}, results: {many}>")
    one = F.array(F.from_json("value", f"struct<{record}>"))
    return files.select(F.explode(F.coalesce(as_list, inner["data"], inner["results"], one)).alias("r")).select("r.*")


def sections(spark: SparkSession, path: str) -> DataFrame:
    """Flat files of labelled sections (a label in the first 12 columns, going on in lines that begin with blanks): entry, section, lines."""
    text = spark.read.text(path, wholetext=True)
    entries = text.select(F.posexplode(F.split("value", "(?m)^///\\s*$")).alias("place", "entry")).filter(F.trim("entry") != "")
    entry = F.regexp_extract("entry", r"(?m)^ENTRY\s+(\S+)", 1)
    parts = F.split("entry", r"(?m)\n(?=\S)")
    rows = entries.select(entry.alias("entry"), F.explode(parts).alias("part")).filter(F.trim("part") != "")
    lines = F.transform(F.split("part", "\n"), lambda x: F.trim(F.substring(x, 13, 10_000)))
    return rows.select("entry", F.substring("part", 1, 12).alias("head"), lines.alias("lines")).select("entry", F.regexp_extract("head", r"^(\S+)", 1).alias("section"), F.filter("lines", lambda x: x != "").alias("lines"))


class _Range(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class _SqliteReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.path, self.table, self.parts = schema, options["path"], options["table"], int(options.get("parts", "8"))

    def partitions(self) -> list[InputPartition]:
        with sqlite3.connect(self.path) as c:
            low, high = c.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
        if low is None:
            return [_Range(0, -1)]
        step = max(1, -(-(high - low + 1) // self.parts))
        return [_Range(a, min(high, a + step - 1)) for a in range(low, high + 1, step)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        names = ", ".join(f'"{f.name}"' for f in self.schema)
        with sqlite3.connect(self.path) as c:
            yield from c.execute(f'SELECT {names} FROM "{self.table}" WHERE rowid BETWEEN ? AND ?', (partition.low, partition.high))


class SqliteSource(DataSource):
    """spark.read.format("sqlite") with options path (on a file system that all executors mount), table and parts."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _SqliteReader(schema, self.options)


def sqlite_table(spark: SparkSession, path: str, table: str, schema: str, parts: int = 8) -> DataFrame:
    """A table of an SQLite file in ranges of row ids, one a partition."""
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite").schema(schema).option("path", path).option("table", table).option("parts", str(parts)).load()
