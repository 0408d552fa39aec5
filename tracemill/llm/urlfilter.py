"""URL lists with dates: entries become validity intervals, and every capture meets the entries active when it was fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.llm._shared import parked

SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*://"


def host_of(url: Column) -> Column:
    """The host in lower case, without user and port; empty if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, SCHEME + r"(?:[^/?#@]*@)?([^/?#:@]*)", 1)), F.lit(""))


def segments_of(url: Column) -> Column:
    return F.filter(F.split(F.coalesce(F.regexp_extract(url, SCHEME + r"[^/?#]*([^?#]*)", 1), F.lit("")), "/"), lambda s: s != "")


def keys_of(url: Column, depth: int) -> Column:
    """All that a list entry may name: the host and its parent domains, and the host with its first 1 to ``depth`` segments."""
    labels, segments, host = F.split(host_of(url), r"\."), segments_of(url), host_of(url)
    n, d = F.size(labels), F.least(F.lit(depth), F.size(segments))
    domains = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n - i + 1), "."))
    none = F.array().cast("array<string>")
    paths = F.when(d > 0, F.transform(F.sequence(F.lit(1), F.greatest(d, F.lit(1))), lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(segments, F.lit(1), i), "/")))).otherwise(none)
    return F.when(host != "", F.concat(domains, paths)).otherwise(none)


def intervals(entries: DataFrame, pattern: str = "pattern", action: str = "action", listed: str = "listed_on") -> DataFrame:
    """(key, action, since, until): each entry from its date until the next of its pattern; the last has no end.

    Patterns are compared in lower case up to their first slash. Entries without pattern, date or action say nothing. Of
    several with one date the last by the action's name counts.
    """
    low = F.concat(F.lower(F.substring_index(pattern, "/", 1)), F.expr(f"substr(`{pattern}`, length(substring_index(`{pattern}`, '/', 1)) + 1)"))
    rows = entries.select(F.rtrim(low, F.lit("/")).alias("key"), F.col(action).alias("action"), F.col(listed).cast("date").alias("since")).filter("key <> '' AND action IS NOT NULL AND since IS NOT NULL")
    rows = rows.groupBy("key", "since").agg(F.max("action").alias("action"))
    return rows.withColumn("until", F.lead("since").over(Window.partitionBy("key").orderBy("since")))


#: Lists with up to so many keys are broadcast to drop all other keys of captures before anything is shuffled.
SMALL_LIST = 200_000


def evaluate(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", fetched_col: str = "fetched", pattern: str = "pattern", action: str = "action", listed: str = "listed_on") -> DataFrame:
    """One row per row of ``captures``: id, fetched, pattern, action and listed_on of the deciding entry, blocked.

    Of the entries active on the day of the fetch the one with the longest pattern decides; "block" blocks, "allow" doesn't, and
    any other action ends the pattern's entry before it. No active entry, no URL or no date: the entry's columns are null and
    blocked is false. Empty captures give an empty result, empty lists block nothing. Repeated rows stay; other columns are
    ignored.

    Of the keys of a capture (its host, parent domains and paths) only those on the list are joined, so a top-level domain that
    nobody listed is no key. The join is by key and month, intervals being spread over the months until the last fetch, so that
    it stays an equi-join whose skewed keys can be split.
    """
    spans = parked(intervals(entries, pattern, action, listed), "intervals")
    rows = captures.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), F.col(fetched_col).cast("date").alias("fetched"), F.col(url_col).cast("string").alias("url"))
    rows = parked(rows, "captures")  # so that a row keeps its number
    known = F.lit(rows.agg(F.max("fetched")).first()[0]).cast("date")
    size = spans.agg(F.max(F.size(F.split("key", "/")) - 1).alias("depth"), F.count_distinct("key").alias("keys")).first()
    months = F.sequence(F.trunc("since", "month"), F.greatest(F.trunc("since", "month"), F.trunc(F.least(F.coalesce("until", known), known), "month")), F.expr("interval 1 month"))
    listed_spans = spans.filter(F.col("action").isin("block", "allow") & (F.col("since") <= known)).withColumn("month", F.explode(months))
    names = spans.select("key").distinct()
    asked = rows.filter(F.col("fetched").isNotNull()).select("rid", "fetched", F.trunc("fetched", "month").alias("month"), F.explode(keys_of(F.col("url"), size.depth or 0)).alias("key"))
    asked = asked.join(F.broadcast(names) if size["keys"] <= SMALL_LIST else names, "key", "left_semi")
    met = asked.join(listed_spans, ["key", "month"]).filter((F.col("fetched") >= F.col("since")) & F.coalesce(F.col("fetched") < F.col("until"), F.lit(True)))
    entry = F.struct(F.length("key").alias("size"), F.col("key").alias("pattern"), "action", F.col("since").alias("listed_on"))
    best = met.groupBy("rid").agg(F.max(entry).alias("e"))
    found = rows.select("rid", "id", "fetched").join(best, "rid", "left")
    return found.select(F.col("id").alias(id_col), "fetched", "e.pattern", "e.action", "e.listed_on", F.coalesce(F.col("e.action") == "block", F.lit(False)).alias("blocked"))


def dated_pages(pages: DataFrame) -> DataFrame:
    """Pages with a day of fetching, which the table lacks: one of the 730 days from 2023-01-01, by the page's id."""
    return pages.select("page_id", "url", F.date_add(F.lit("2023-01-01").cast("date"), F.pmod(F.col("page_id") * 7919, F.lit(730)).cast("int")).alias("fetched"))


def dated_list(pages: DataFrame) -> DataFrame:
    """A dated list, which the tables lack, made of the pages themselves by hashes: a fifth of the hosts are blocked from some day
    until another, a ninth of the first sections of hosts are blocked on some day and allowed from another."""
    h = lambda a, n: F.pmod(F.conv(F.substring(F.md5("pattern"), a, 6), 16, 10).cast("int"), F.lit(n))
    start, host, part = F.lit("2023-01-01").cast("date"), host_of(F.col("url")), segments_of(F.col("url"))
    hosts = pages.select(host.alias("pattern")).filter("pattern <> ''").distinct().filter(h(1, 5) == 0).withColumn("then", F.lit("remove"))
    parts = pages.filter((host != "") & (F.size(part) > 0)).select(F.concat(host, F.lit("/"), part[0]).alias("pattern")).distinct().filter(h(1, 9) == 0).withColumn("then", F.lit("allow"))
    spans = hosts.unionByName(parts).select("pattern", "then", h(7, 500).alias("a"), (h(13, 200) + 1).alias("n"))
    two = F.array(F.struct(F.lit("block").alias("action"), F.col("a").alias("day")), F.struct(F.col("then").alias("action"), (F.col("a") + F.col("n")).alias("day")))
    return spans.select("pattern", F.explode(two).alias("e")).select("pattern", "e.action", F.date_add(start, F.col("e.day")).alias("listed_on"))


_HASH = "('0x' || substr(md5(pattern), {}, 6))::INTEGER % {}"
ORACLE = f"""
    WITH p AS (SELECT page_id, url, DATE '2023-01-01' + ((page_id * 7919) % 730)::INTEGER AS fetched,
                 lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)', 1)) host,
                 list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda s: s <> '') seg FROM pages),
    h AS (SELECT DISTINCT host AS pattern, 5 AS m, 'remove' AS then_ FROM p WHERE host <> '' UNION ALL SELECT DISTINCT host || '/' || seg[1], 9, 'allow' FROM p WHERE host <> '' AND len(seg) > 0),
    x AS (SELECT pattern, then_, {_HASH.format(7, 500)} AS a, {_HASH.format(13, 200)} + 1 AS n FROM h WHERE {_HASH.format(1, 'm')} = 0),
    l AS (SELECT pattern, 'block' AS action, DATE '2023-01-01' + a AS listed_on FROM x UNION ALL SELECT pattern, then_, DATE '2023-01-01' + (a + n) FROM x),
    one AS (SELECT pattern, listed_on, max(action) AS action FROM l GROUP BY pattern, listed_on),
    i AS (SELECT *, lead(listed_on) OVER (PARTITION BY pattern ORDER BY listed_on) AS until FROM one),
    k AS (SELECT page_id, fetched, unnest(list_concat(list_transform(range(1, len(string_split(host, '.')) + 1), lambda j: array_to_string(string_split(host, '.')[j:], '.')),
                 list_transform(range(1, len(seg) + 1), lambda j: host || '/' || array_to_string(seg[:j], '/')))) AS key FROM p),
    m AS (SELECT k.page_id, max({{'size': length(pattern), 'pattern': pattern, 'action': action, 'listed_on': listed_on}}) e FROM k JOIN i ON key = pattern AND action IN ('block', 'allow')
          AND fetched >= listed_on AND (until IS NULL OR fetched < until) GROUP BY k.page_id)
    SELECT p.page_id, p.fetched, e.pattern AS pattern, e.action AS action, e.listed_on AS listed_on, coalesce(e.action = 'block', false) AS blocked FROM p LEFT JOIN m USING (page_id)
"""
