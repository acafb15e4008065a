"""Surveys, codebooks and instances in files."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger(__name__)

VARIABLE = "struct<question:string,description:string,notes:string,values:string>"
INSTANCE = """example_id string, base_id string, survey string, id string, country string, questions array<struct<question:string,answer:string>>,
target_question string, target_code string, target_section string, answer string, answer_raw string, options array<string>, profile_type string"""


#: Encodings that are tried in order. Spark reads these and UTF-16 and 32; the last one reads any bytes.
ENCODINGS = ("UTF-8", "ISO-8859-1")
#: The character that stands for bytes an encoding doesn't have.
UNREADABLE = "\ufffd"


def read_survey_csv(spark: SparkSession, paths: str | list[str], encoding: str = "UTF-8", multi_line: bool = False) -> DataFrame:
    """All columns as strings, as answers are codes. ``multi_line`` (line breaks inside quotes) makes files unsplittable."""
    return spark.read.csv(paths, header=True, inferSchema=False, encoding=encoding, multiLine=multi_line, escape='"')


def fitting_encoding(spark: SparkSession, path: str, encodings: tuple[str, ...] = ENCODINGS) -> str:
    """The first encoding that reads every line of the files without an unreadable character, else the last. A distributed scan for each try."""
    for e in encodings[:-1]:
        lines = spark.read.csv(path, sep="\x01", quote="", encoding=e, header=False)
        if lines.where(F.col("_c0").contains(UNREADABLE)).isEmpty():
            return e
    return encodings[-1]


def _read_paths(spark: SparkSession, paths: list[str], read: Callable[[str], DataFrame]) -> DataFrame:
    found = None
    for p in paths:
        rows = read(p).select("*", F.col("_metadata.file_name").alias("_source_file"))
        found = rows if found is None else found.unionByName(rows, allowMissingColumns=True)
    return found


def readable(spark: SparkSession, paths: list[str], read: Callable[[str], DataFrame]) -> tuple[list[str], dict[str, str]]:
    """Of the paths those that can be read to their end, and the others with the reason. A file that breaks half-way counts as unreadable, as part of it would be no survey.

    All are read by one distributed job; only where that fails halves are tried, so a broken one among n costs some log n jobs.
    """
    try:
        _read_paths(spark, paths, read).write.format("noop").mode("overwrite").save()
        return list(paths), {}
    except Exception as e:  # whatever a format's reader raises, while it plans or runs
        if len(paths) == 1:
            return [], {paths[0]: next((x for x in str(e).splitlines() if x.strip()), type(e).__name__)}
    good, lost = [], {}
    for part in (paths[: len(paths) // 2], paths[len(paths) // 2 :]):
        own, bad = readable(spark, part, read)
        good, lost = good + own, lost | bad
    return good, lost


def read_survey_files(
    spark: SparkSession, paths: list[str], encoding: str | None = "UTF-8", skip_errors: bool = True, format: str = "csv", ledger: dict[str, str] | None = None,
) -> DataFrame:
    """The union of files (csv, or any other ``format`` of Spark's) whose columns may differ, with ``_source_file``. Without an ``encoding`` each file gets the first that fits.

    With ``skip_errors`` a path that can't be read, be it absent, malformed or broken half-way (a truncated gzip, a damaged Parquet page), is left out with a warning, and named
    in ``ledger`` with the reason; for that, all files are read once beforehand. No path, or none that can be read, is an error.
    """

    def read(p: str) -> DataFrame:
        return read_survey_csv(spark, p, encoding or fitting_encoding(spark, p)) if format == "csv" else spark.read.format(format).load(p)

    good, lost = readable(spark, paths, read) if skip_errors and paths else (paths, {})
    for p, reason in lost.items():
        log.warning("survey file %s is left out: %s", p, reason)
    if ledger is not None:
        ledger.update(lost)
    if not good:
        raise ValueError("no survey files")
    return _read_paths(spark, good, read)


def load_codebook(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(variables, values) of JSON files {section: {code: {question, description, values}}}, in the files' order.

    A ``values`` that is no object gives no labels; sections and variables that are none are passed over (``codebook.file_structure`` names them).
    Files are codebooks, so one is read by one task.
    """
    opened = lambda c: F.map_entries(F.from_json(c, "map<string,string>"))
    text = spark.read.text(path, wholetext=True)
    sections = text.select(F.posexplode(opened(F.col("value"))).alias("section_pos", "s"))
    rows = sections.select("section_pos", F.col("s.key").alias("section"), F.posexplode(opened(F.col("s.value"))).alias("var_pos", "e"))
    rows = rows.where(opened(F.col("e.value")).isNotNull()).withColumn("v", F.from_json("e.value", VARIABLE))
    variables = rows.select(
        "section", "section_pos", F.col("e.key").alias("code"), "var_pos", "v.question", "v.description", "v.notes",
        F.from_json("v.values", "map<string,string>").alias("labels"),
    )
    values = variables.select("code", F.posexplode(F.map_entries("labels")).alias("label_pos", "e")).select("code", F.col("e.key").alias("raw"), F.col("e.value").alias("label"), "label_pos")
    return variables.withColumn("has_values", F.coalesce(F.size("labels") > 0, F.lit(False))).withColumn("sampleable", F.col("section") != "EXCLUDED").drop("labels"), values


def write_jsonl(rows: DataFrame, path: str, by_survey: bool = False) -> None:
    """One JSON object a line, nulls kept; a folder of part files, with ``by_survey`` one below it for each survey."""
    out = rows.write.option("ignoreNullFields", "false")
    (out.partitionBy("survey") if by_survey else out).json(path)


def read_instances(spark: SparkSession, path: str) -> DataFrame:
    """Instances as written; blank lines are skipped."""
    return spark.read.schema(INSTANCE).json(path)


def write_json_array(rows: DataFrame, path: str) -> None:
    """A small export as one file with one JSON array, a row a line. One task writes it; for datasets use ``write_jsonl``."""
    columns = [F.col(f"`{c}`") for c in rows.columns]
    lines = rows.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("value"))
    one = lines.coalesce(1).withColumn("k", F.monotonically_increasing_id())
    first = one.select("k", F.concat(F.when(F.col("k") == 0, "[").otherwise(","), "value").alias("value"))
    last = rows.sparkSession.range(1).select(F.lit(2**62).alias("k"), F.lit("]").alias("value"))
    head = rows.limit(1).groupBy().count().where("count = 0").select(F.lit(-1).cast("long").alias("k"), F.lit("[").alias("value"))
    head.unionByName(first).unionByName(last).coalesce(1).sortWithinPartitions("k").select("value").write.text(path)


def codebook_from_html(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, code, question, raw, label, label_pos) of pages where an ``h3`` with an id opens a variable.

    The texts up to the next ``div`` of class data-table are the question: parts of one element joined by " - ", elements by line breaks.
    The table's rows with two or more cells are raw value and label; blank raw values go. A variable without labels has one row without them.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, *r) for k, text in zip(batch["key"], batch["html"], strict=True) for r in _variables(text or "")]
            yield pd.DataFrame(rows, columns=["key", "code", "question", "raw", "label", "label_pos"]).astype({"label_pos": "Int32"})

    out = pages.select(F.col(key).cast("string").alias("key"), F.col(html).alias("html"))
    return out.mapInPandas(run, "key string, code string, question string, raw string, label string, label_pos int")


class _Codebook(HTMLParser):
    """Collects variables as it goes; depth is counted from the element that follows a heading."""

    def __init__(self):
        super().__init__()
        self.found: list[dict] = []
        self.depth, self.table, self.cell, self.heading = 0, 0, None, False

    def handle_starttag(self, tag, attrs):
        own = dict(attrs)
        if tag == "h3":
            self.heading = True
            if own.get("id"):
                self.found.append({"code": own["id"], "parts": [], "open": True, "rows": []})
                self.depth = 0
        elif self.found and self.found[-1]["open"]:
            if tag == "div" and "data-table" in (own.get("class") or "").split():
                self.found[-1]["open"], self.table = False, 1
            elif tag not in ("br", "hr", "img", "input", "meta", "link"):
                if self.depth == 0:
                    self.found[-1]["parts"].append([])
                self.depth += 1
        elif self.table:
            self.table += tag == "div"
            if tag == "tr":
                self.found[-1]["rows"].append([])
            elif tag == "td" and self.found[-1]["rows"]:
                self.cell = []
                self.found[-1]["rows"][-1].append(self.cell)

    def handle_endtag(self, tag):
        if tag == "h3":
            self.heading = False
        elif self.found and self.found[-1]["open"]:
            if self.depth:
                self.depth -= 1
            else:
                self.found[-1]["open"] = False  # the end of what holds the heading
        elif self.table:
            self.table -= tag == "div"
            if tag == "td":
                self.cell = None

    def handle_data(self, data):
        text = data.strip()
        if not text or self.heading or not self.found:
            return
        if self.cell is not None:
            self.cell.append(text)
        elif self.found[-1]["open"]:
            if self.depth == 0:
                self.found[-1]["parts"].append([text])
            else:
                self.found[-1]["parts"][-1].append(text)


def _variables(html: str) -> Iterator[tuple]:
    p = _Codebook()
    p.feed(html)
    p.close()
    for v in p.found:
        question = "\n".join(" - ".join(part) for part in v["parts"] if part)
        labels = {"".join(r[0]): " ".join(r[1]) for r in v["rows"] if len(r) >= 2 and "".join(r[0])}
        for k, (raw, label) in enumerate(labels.items()):
            yield v["code"], question, raw, label, k
        if not labels:
            yield v["code"], question, None, None, None
