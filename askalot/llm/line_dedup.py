"""Removal of boilerplate lines by the number of distinct sites that show them.

Each line is hashed; a HyperLogLog sketch of the sites is kept per line hash and
merged by Spark's partial aggregation, so a line that stands on every page of a
hot site costs one sketch per task, not one row per page. Only lines whose
estimate is near the threshold are counted exactly. Removal shuffles (document,
line numbers) pairs, not lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

#: A line is boilerplate if it stands on this many distinct sites.
MIN_SITES = 10
#: log2 of the sketch's buckets: a standard error of 1.6 %.
LG_K = 12


def _line_key(line: Column) -> list[Column]:
    """96 bits of hash for a line without outer spaces."""
    return [F.xxhash64(F.trim(line)).alias("__h"), F.hash(F.trim(line)).alias("__g")]


def _place(docs: DataFrame, doc_id: str, text: str) -> Column:
    """Orders rows by doc_id, those without one last; rows that repeat are equal."""
    return F.struct(docs[doc_id].isNull().alias("last"), docs[doc_id].alias("id"), F.xxhash64(docs[doc_id], docs[text]).alias("row"))


def boilerplate_lines(
    docs: DataFrame, text: str = "text", site: str = "source", min_sites: int = MIN_SITES, place: Column | None = None
) -> DataFrame:
    """Keys (``__h``, ``__g``) of the lines on at least ``min_sites`` distinct non-null sites.

    With ``place``, also ``__first``: the smallest value of it among the rows that show the line.
    """
    extra = [] if place is None else [place.alias("__place")]
    first = [] if place is None else [F.min("__place").alias("__first")]
    key = ["__h", "__g", *(["__first"] if extra else [])]
    placed = (
        docs.select(docs[site].alias("__site"), *extra, F.explode(F.split(docs[text], "\n")).alias("__line"))
        .where(F.trim("__line") != "")
        .select("__site", *(["__place"] if extra else []), *_line_key(F.col("__line")))
    )
    lines = placed.select("__site", "__h", "__g")
    # An estimate is off by less than a tenth plus two, six standard errors; beyond that it decides.
    low, high = min_sites * 0.9 - 2, min_sites * 1.1 + 2
    estimated = stored(
        placed.groupBy("__h", "__g")
        .agg(F.hll_sketch_agg("__site", F.lit(LG_K)).alias("__sketch"), *first)
        .select(*key, F.hll_sketch_estimate("__sketch").alias("__sites"))
        .where(F.col("__sites") >= low)
    )
    near = estimated.where(F.col("__sites") <= high).select(*key)
    exact = (
        lines.join(near, ["__h", "__g"])  # few keys of a table of known size: only their lines are dealt by site
        .distinct()
        .groupBy(*key)
        .agg(F.count("__site").alias("__sites"))
        .where(F.col("__sites") >= min_sites)
    )
    return estimated.where(F.col("__sites") > high).select(*key).unionByName(exact.select(*key))


def drop_boilerplate_lines(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", site: str = "source", min_sites: int = MIN_SITES, keep_first: bool = False
) -> DataFrame:
    """``docs`` with its boilerplate lines taken out of ``text``, plus ``n_lines`` and ``n_removed``.

    Lines end at \\n and compare without outer spaces; blank lines always stay. Every
    occurrence of a boilerplate line goes, on every site; with ``keep_first`` all but those in the
    row of the smallest doc_id that shows it (rows without an id come last), so that no line is
    lost altogether and of a document copied to many sites one copy stays whole. Null texts stay null and have no
    lines; null sites don't count as a site. Every row stays, repeated rows too, an emptied
    text as ''. Other columns pass through, whatever their names; columns named n_lines or n_removed are replaced.
    """
    # Names of its own for the columns given, so that none clashes with those made here.
    names = {f"c{i}": c for i, c in enumerate(docs.columns)}
    own = {c: k for k, c in names.items()}
    keep = [k for k, c in names.items() if c not in ("n_lines", "n_removed")]
    docs, doc_id, text, site = docs.toDF(*names), own[doc_id], own[text], own[site]
    rows = docs.select(*[docs[c] for c in keep], F.xxhash64(docs[doc_id], docs[text]).alias("__row"), docs[doc_id].alias("__id"))
    place = _place(docs, doc_id, text) if keep_first else None
    found = boilerplate_lines(docs, text, site, min_sites, place)
    drops = (
        docs.select(docs[doc_id].alias("__id"), F.xxhash64(docs[doc_id], docs[text]).alias("__row"), F.posexplode(F.split(docs[text], "\n")).alias("__pos", "__line"))
        .where(F.trim("__line") != "")
        .select("__id", "__row", "__pos", *_line_key(F.col("__line")))
        .join(found, ["__h", "__g"])
        .where(~(F.col("__first.row").eqNullSafe(F.col("__row")) & F.col("__first.id").eqNullSafe(F.col("__id"))) if keep_first else F.lit(True))
        .groupBy("__id", "__row")
        .agg(F.collect_set("__pos").alias("__drop"))
        .select(F.col("__id").alias("__id2"), F.col("__row").alias("__row2"), "__drop")
    )
    joined = rows.join(drops, F.col("__row").eqNullSafe(F.col("__row2")) & F.col("__id").eqNullSafe(F.col("__id2")), "left")
    lines = F.split(F.col(text), "\n")
    kept = F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__drop")), lambda i: F.get(lines, i)
    )
    return joined.select(
        *[(F.col(c) if c != text else F.when(F.col("__drop").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))).alias(names[c]) for c in keep],
        F.coalesce(F.size(F.filter(lines, lambda x: F.trim(x) != "")), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("__drop"), F.lit(0)).cast("long").alias("n_removed"),
    )


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that stand on at least ten sources: doc_id, n_lines, n_removed, text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return drop_boilerplate_lines(docs).select("doc_id", "n_lines", "n_removed", "text")


ORACLE = f"""
WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
                  generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
b AS (SELECT trim(line) AS line FROM l WHERE trim(line) <> '' GROUP BY 1 HAVING count(DISTINCT source) >= {MIN_SITES}),
m AS (SELECT l.doc_id, l.pos, l.line, (trim(l.line) <> '')::INT AS full_line, (b.line IS NOT NULL)::INT AS gone
      FROM l LEFT JOIN b ON b.line = trim(l.line))
SELECT d.doc_id, coalesce(x.n_lines, 0) AS n_lines, coalesce(x.n_removed, 0) AS n_removed,
       CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(x.text, '') END AS text
FROM documents d LEFT JOIN (
  SELECT doc_id, sum(full_line)::BIGINT AS n_lines, sum(gone)::BIGINT AS n_removed,
         string_agg(CASE WHEN gone = 0 THEN line END, chr(10) ORDER BY pos) AS text
  FROM m GROUP BY doc_id) x ON x.doc_id = d.doc_id
"""
