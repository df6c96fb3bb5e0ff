"""Harvested XML records, resumable rebuilds, and the files that evaluation reads and writes."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholarlake.operators.ranges import running_before

RECORD = "struct<header:struct<identifier:string,datestamp:string>,metadata:struct<title:string,abstract:string,categories:string,created:string,updated:string>>"
#: One page of an OAI-PMH answer, element by element.
PAGE = f"error struct<_code:string,_VALUE:string>, ListRecords struct<record:array<{RECORD}>,resumptionToken:string>"


def parsed_pages(pages: DataFrame, xml: str = "xml") -> DataFrame:
    """Pages with their records, resumption token and error code; prefixes are dropped before parsing."""
    bare = F.regexp_replace(xml, r"(</?)[A-Za-z0-9]+:", "$1")
    doc = F.from_xml(bare, PAGE)
    return pages.withColumn("_p", doc).select(
        *pages.columns,
        F.col("_p.ListRecords.record").alias("records"),
        F.nullif(F.trim("_p.ListRecords.resumptionToken"), F.lit("")).alias("token"),
        F.col("_p.error._code").alias("error_code"),
    )


def records(pages: DataFrame) -> DataFrame:
    """(identifier, datestamp, title, abstract, categories, created, updated) of parsed pages, white space normal."""
    clean = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    r = pages.select(F.explode("records").alias("r"))
    return r.select(normal_id(F.col("r.header.identifier")).alias("identifier"), F.col("r.header.datestamp").alias("datestamp"), clean(F.col("r.metadata.title")).alias("title"), clean(F.col("r.metadata.abstract")).alias("abstract"), F.filter(F.split("r.metadata.categories", r"[\s,]+"), lambda c: c != "").alias("categories"), "r.metadata.created", "r.metadata.updated")


def normal_id(raw: Column) -> Column:
    """An identifier without scheme, prefix and version."""
    return F.regexp_replace(F.regexp_replace(F.trim(raw), r"^(oai:[^:]+:|https?://[^/]+/(abs|pdf)/)", ""), r"v\d+$", "")


def compaction_plan(files: DataFrame, most_rows: int) -> DataFrame:
    """(collection, file, grp): small files put together, in order, up to a number of rows each group.

    A running sum per collection decides: a group is what falls into the same multiple of `most_rows`.
    """
    before = running_before(files, ["collection"], [F.col("file")], F.col("n"), "_before")
    return before.select("collection", "file", F.floor(F.col("_before") / most_rows).cast("long").alias("grp"))


def write_records(rows: DataFrame, path: str, day: str) -> None:
    """Appends records as JSON lines, in a folder for each day."""
    rows.write.mode("append").partitionBy(day).json(path)


def golden_cases(rows: DataFrame, key: str = "case_id") -> DataFrame:
    """Cases as they are; an error if an id occurs twice."""
    twice = rows.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").limit(5).collect()
    if twice:
        raise ValueError(f"repeated cases: {[r[key] for r in twice]}")
    return rows


#: The layout of published builds; readers refuse any other.
LAYOUT = 1


def publish(df: DataFrame, root: str, name: str, version: int, checks: Iterable[tuple[str, Column]] = ()) -> DataFrame:
    """Writes a build beside the ones before it, checks it, and only then points readers to it.

    The pointer is the manifest: the version, the layout, and how many rows the build has.
    """
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{root}/{name}/v={version}")
    back = spark.read.parquet(f"{root}/{name}/v={version}")
    for what, test in checks:
        if back.filter(~test).limit(1).count():
            raise ValueError(f"{name} v{version} fails {what}")
    pointer = spark.createDataFrame([(name, version, True, LAYOUT, back.count())], "name string, version long, active boolean, layout long, rows long")
    pointer.coalesce(1).write.mode("overwrite").parquet(f"{root}/{name}-active")
    return back


def active(spark, root: str, name: str) -> DataFrame:
    """The build that readers are pointed to; an error if its layout is another one or rows are missing."""
    found = spark.read.parquet(f"{root}/{name}-active").filter("active").first()
    if found["layout"] != LAYOUT:
        raise ValueError(f"{name} has layout {found['layout']}, not {LAYOUT}")
    build = spark.read.parquet(f"{root}/{name}/v={found['version']}")
    if build.count() != found["rows"]:
        raise ValueError(f"{name} v{found['version']} does not have {found['rows']} rows")
    return build


def read_records(spark, path: str, schema: str) -> DataFrame:
    """Records that `write_records` wrote, of all days."""
    return spark.read.schema(schema).json(path)


def retired(spark, root: str, name: str) -> list[int]:
    """The versions of builds that readers are not pointed to."""
    now = spark.read.parquet(f"{root}/{name}-active").filter("active").first()["version"]
    return sorted(r["v"] for r in spark.read.parquet(f"{root}/{name}").select("v").distinct().collect() if r["v"] != now)
