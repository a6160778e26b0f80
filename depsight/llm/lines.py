"""Line dedup by site-relative frequency.

For each host the pages that contain a line are counted, each page once however often it repeats the line, and divided by the host's
pages. A line in more than a given ratio of them is boilerplate there and is dropped from that host's pages. The rule is the ratio alone: hosts of
every size are judged by it, and a page of nothing but boilerplate loses it all. A line on one page only is no boilerplate, however few pages its host has.

Cases: a line is what stands between newlines, compared whole, so a very long text may be one line; a share of exactly the ratio stays (ties). Lines without
a word are neither counted nor dropped. Null hosts are one host; null texts stay null and count as pages; empty texts stay empty. Repeated rows are pages
of their own. An empty table gives an empty table. Extra columns, whatever their names, go with their rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depsight.llm.shared import fresh, table

#: A line on a larger share of a host's pages is boilerplate.
RATIO = 0.1


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def key_of(line: Column) -> Column:
    """16 bytes that stand for a line in shuffles."""
    return F.unhex(F.md5(line.cast("binary")))


def boilerplate(docs: DataFrame, text_col: str = "text", host_col: str = "source", ratio: float = RATIO) -> DataFrame:
    """host and the keys of its boilerplate lines.

    Counts are summed before the shuffle. A host has fewer such lines than its mean number of lines a page divided by the ratio, so the
    list of a host doesn't grow with its pages.
    """
    base = docs.select(docs[host_col].alias("host"), docs[text_col].alias("text"))
    pages = base.groupBy("host").agg(F.count("*").alias("pages"))
    # one row a page for its distinct lines
    once = base.select("host", F.explode(F.array_distinct(F.transform(F.filter(lines_of(F.col("text")), has_word), key_of))).alias("line"))
    counts = once.groupBy("host", "line").agg(F.count("*").alias("n")).where("n > 1")
    hosts = table(pages.withColumnRenamed("host", "page_host"), "hosts")
    often = counts.join(hosts, counts["host"].eqNullSafe(hosts["page_host"])).where(F.col("n") > F.col("pages") * F.lit(ratio))
    return table(often.groupBy("host").agg(F.collect_set("line").alias("boiler")), "boilerplate")


def dedup(docs: DataFrame, text_col: str = "text", host_col: str = "source", ratio: float = RATIO, n_lines: str | None = None, n_dropped: str | None = None) -> DataFrame:
    """docs with boilerplate lines taken out of the text; with n_lines and n_dropped also how many lines there were and how many went."""
    host, boiler, hits = (fresh(docs, c) for c in ("host", "boiler", "hits"))
    found = boilerplate(docs, text_col, host_col, ratio).select(F.col("host").alias(host), F.col("boiler").alias(boiler))
    text = docs[text_col]
    # a page's own boilerplate comes from a hashed intersection, so that no line is compared with the host's whole list
    own = F.array_intersect(F.transform(lines_of(text), key_of), F.col(boiler))
    joined = docs.join(found, docs[host_col].eqNullSafe(found[host]), "left").withColumn(hits, own)
    touched = F.coalesce(F.size(hits) > 0, F.lit(False))
    kept = F.filter(lines_of(text), lambda x: ~F.array_contains(hits, key_of(x)))
    new = F.when(touched, F.array_join(kept, "\n")).otherwise(text)
    columns = [new.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    total = F.when(text.isNull(), F.lit(0)).otherwise(F.size(lines_of(text)))
    columns += [total.cast("long").alias(n_lines)] if n_lines else []
    columns += [F.when(touched, total - F.size(kept)).otherwise(F.lit(0)).cast("long").alias(n_dropped)] if n_dropped else []
    return joined.select(*columns)


ORACLE = rf"""
WITH d AS (SELECT *, string_split(text, chr(10)) AS lines FROM documents),
p AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
u AS (SELECT source, unnest(list_distinct(lines)) AS line FROM d),
b AS (SELECT u.source, u.line, count(*) AS n FROM u WHERE regexp_matches(u.line, '[^\x20\x09-\x0D]') GROUP BY u.source, u.line),
o AS (SELECT b.source, list(b.line) AS boiler FROM b JOIN p ON b.source IS NOT DISTINCT FROM p.source WHERE b.n > 1 AND b.n > p.pages * {RATIO}::DOUBLE GROUP BY b.source),
k AS (SELECT d.*, list_filter(d.lines, lambda x: o.boiler IS NULL OR NOT list_contains(o.boiler, x)) AS kept FROM d LEFT JOIN o ON d.source IS NOT DISTINCT FROM o.source)
SELECT doc_id, CASE WHEN text IS NULL THEN text ELSE array_to_string(kept, chr(10)) END AS text, coalesce(len(lines), 0)::BIGINT AS n_lines,
    CASE WHEN text IS NULL THEN 0 ELSE len(lines) - len(kept) END::BIGINT AS n_dropped FROM k
"""
