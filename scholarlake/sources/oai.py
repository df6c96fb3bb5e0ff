"""Harvesting a repository page by page, as a stream whose offsets are resumption tokens.

Each page names the token of the next one. The stream's reader follows the tokens, so a micro-batch is the pages from one
token to another, and the checkpoint of the stream is where the harvest stands: stopped anywhere, it goes on at the first
page that is not written yet. The pages themselves are fetched and parsed by the tasks.
"""

from __future__ import annotations

import re
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from html import unescape

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from scholarlake.sources.harvest import normal_id, parsed_pages

_TOKEN = re.compile(r"<(?:\w+:)?resumptionToken\b[^>]*>([^<]*)<")
_ERROR = re.compile(r"<(?:\w+:)?error\b[^>]*\bcode=[\"']([^\"']+)[\"']")
#: The error that says that there is nothing to harvest: a normal end.
NOTHING = "noRecordsMatch"


def address(options: dict, token: str) -> str:
    """Where a page is: a request by verb to a server; in a folder (file://), a file named by its token, the first by its dates."""
    base = options["endpoint"].rstrip("/")
    if base.startswith("file:"):
        named = urllib.parse.quote(token or f"{options.get('from', '')}_{options.get('until', '')}", safe="")
        return f"{base}/{urllib.parse.quote(named)}.xml"
    asked = {"verb": "ListRecords"}
    if token:  # dates must not go along with a token
        asked["resumptionToken"] = token
    else:
        asked |= {"metadataPrefix": options.get("prefix", "oai_dc")} | {k: options[k] for k in ("from", "until") if options.get(k)}
    return f"{base}?{urllib.parse.urlencode(asked)}"


def fetched(options: dict, token: str) -> str:
    with urllib.request.urlopen(address(options, token), timeout=float(options.get("timeout", 60))) as answer:
        return answer.read().decode("utf-8")


def follows(xml: str) -> tuple[str, str]:
    """(token of the next page, error code) that a page names, each maybe empty."""
    error, token = _ERROR.search(xml), _TOKEN.search(xml)
    return unescape(token[1]).strip() if token and not error else "", error[1] if error else ""


class Page(InputPartition):
    def __init__(self, number: int, token: str):
        self.number, self.token = number, token


class PageReader(DataSourceStreamReader):
    """Offsets are {page, token, done}: how many pages lie before, the token of the next one, and why there is none ('' if there is)."""

    def __init__(self, options: dict):
        self.options, self.most = options, int(options.get("pagesPerBatch", 1))
        self.at: dict | None = None
        self.tokens: dict[int, str] = {}

    def initialOffset(self) -> dict:
        return {"page": 0, "token": "", "done": ""}

    def _next(self, at: dict) -> dict:
        token, error = follows(fetched(self.options, at["token"]))
        return {"page": at["page"] + 1, "token": token, "done": error or ("" if token else "end")}

    def latestOffset(self) -> dict:
        at = self.at or self.initialOffset()
        for _ in range(self.most):
            if at["done"]:
                break
            self.tokens[at["page"]] = at["token"]
            at = self._next(at)
        self.at = at
        return at

    def partitions(self, start: dict, end: dict) -> Sequence[Page]:
        # after a restart the pages of an unfinished batch are found by following the tokens again
        at, out = start, []
        while at["page"] < end["page"]:
            out.append(Page(at["page"], at["token"]))
            number = at["page"] + 1
            at = {"page": number, "token": self.tokens[number], "done": ""} if number in self.tokens else end if number == end["page"] else self._next(at)
        self.at = self.at or end
        return out

    def read(self, partition: Page) -> Iterator[tuple]:
        yield partition.number, partition.token, fetched(self.options, partition.token)

    def commit(self, end: dict) -> None:
        self.at = self.at or end
        self.tokens = {k: v for k, v in self.tokens.items() if k >= end["page"]}


class Repository(DataSource):
    """spark.readStream.format("repository") with options endpoint, from, until, prefix, pagesPerBatch: (page, token, xml)."""

    @classmethod
    def name(cls) -> str:
        return "repository"

    def schema(self) -> str:
        return "page long, asked string, xml string"

    def streamReader(self, schema: object) -> PageReader:
        return PageReader(dict(self.options))


@dataclass
class Counters:
    """What a run has seen; `error` is the code of the page that ended it, if it was one."""

    pages: int = 0
    seen: int = 0
    no_metadata: int = 0
    no_id: int = 0
    no_categories: int = 0
    filtered: int = 0
    matched: int = 0
    written: int = 0
    would_write: int = 0
    error: str = ""
    batches: list[int] = field(default_factory=list)


def judged(pages: DataFrame, categories: Sequence[str]) -> DataFrame:
    """(page, error_code, outcome, identifier, datestamp, title, abstract, categories): a row per record, and one without outcome for a page without records.

    The outcome is the first of no_metadata, no_id, no_categories, filtered (none of the wanted categories; without any
    wanted all match) that holds, else matched.
    """
    clean = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    r = parsed_pages(pages).select("page", "error_code", F.explode_outer("records").alias("r"))
    named = F.filter(F.split(F.coalesce("r.metadata.categories", F.lit("")), r"[\s,]+"), lambda c: c != "")
    r = r.select("page", "error_code", F.col("r").isNotNull().alias("is"), F.col("r.metadata").isNotNull().alias("has"), normal_id(F.col("r.header.identifier")).alias("identifier"), F.col("r.header.datestamp").alias("datestamp"), clean(F.col("r.metadata.title")).alias("title"), clean(F.col("r.metadata.abstract")).alias("abstract"), named.alias("categories"))
    wanted = F.arrays_overlap("categories", F.array(*map(F.lit, categories))) if categories else F.lit(True)
    outcome = F.when(~F.col("has"), "no_metadata").when(F.coalesce("identifier", F.lit("")) == "", "no_id").when(F.size("categories") == 0, "no_categories").when(~wanted, "filtered").otherwise("matched")
    return r.select("page", "error_code", F.when(F.col("is"), outcome).alias("outcome"), "identifier", "datestamp", "title", "abstract", "categories")


def harvest(spark: SparkSession, out: str, checkpoint: str, categories: Sequence[str] = (), dry_run: bool = False, count_only: bool = False, after_batch: Callable[[int], None] | None = None, **options: str) -> Counters:
    """Follows a repository to its end, or to a page of error, and writes the matching records to `out`, a folder for each batch.

    Run again with the same checkpoint it goes on where it stopped; a batch that was written but not yet noted is written
    over, so no record is lost or doubled. `dry_run` counts what would be written, `count_only` what matches: both write
    nothing. Counters are of this run, observed as the records pass.
    """
    spark.dataSource.register(Repository)
    found = Counters()

    def put(batch: DataFrame, number: int) -> None:
        # a batch is of few pages; they are fetched once for counts and rows
        rows = judged(batch, categories)
        told = Observation(f"harvest-{number}")
        kinds = ("no_metadata", "no_id", "no_categories", "filtered", "matched")
        rows = rows.observe(told, F.count("outcome").alias("seen"), F.max("error_code").alias("error"), F.max("page").alias("last"), F.min("page").alias("first"), *[F.count(F.when(F.col("outcome") == k, 1)).alias(k) for k in kinds])
        kept = rows.filter("outcome = 'matched'").drop("error_code", "outcome")
        if dry_run or count_only:
            kept.write.format("noop").mode("overwrite").save()
        else:
            kept.write.mode("overwrite").parquet(f"{out}/batch={number}")
        seen = told.get
        for k in ("seen", *kinds):
            setattr(found, k, getattr(found, k) + seen[k])
        failed = seen["error"] is not None
        found.pages += 0 if seen["first"] is None else seen["last"] - seen["first"] + 1 - failed
        found.written += 0 if dry_run or count_only else seen["matched"]
        found.would_write += seen["matched"] if dry_run else 0
        found.error = seen["error"] if failed and seen["error"] != NOTHING else found.error
        found.batches.append(number)
        if after_batch:
            after_batch(number)

    stream = spark.readStream.format("repository").options(**options).load()
    query = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return found
