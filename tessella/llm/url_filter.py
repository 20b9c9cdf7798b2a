"""URL filters as a temporal list join, in DataFrame functions only.

A block list is a table of dated entries: a pattern (a domain, or a host with leading path segments) is added or
removed. Entries become validity intervals, at most one at any time for a pattern. Every capture asks, for each
domain suffix and path prefix of its URL, which interval holds at its fetch time: an equi-join on the pattern with a
range on time, so one key of a capture meets one interval at most. Captures of one host may be a third of all rows, so
both sides are salted; Spark broadcasts the intervals where their measured size is below its threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.common import stored, table

SALTS = 16


def host_of(url: Column) -> Column:
    """The host in lower case, without user, port and scheme; empty if there is none."""
    authority = F.regexp_extract(_stem(url), "^[^/]*", 0)
    return F.lower(F.regexp_replace(F.regexp_replace(authority, "^.*@", ""), ":[0-9]*$", ""))


def _stem(url: Column) -> Column:
    """What lies between the scheme and the query or fragment."""
    return F.regexp_extract(F.regexp_replace(url, "^[A-Za-z][A-Za-z0-9+.-]*://", ""), "^[^?#]*", 0)


def segments_of(url: Column) -> Column:
    """The path's segments; empty ones don't count."""
    return F.filter(F.split(F.regexp_replace(_stem(url), "^[^/]*", ""), "/"), lambda s: s != "")


def keys_of(url: Column, labels: int, depth: int) -> Column:
    """The domain suffixes of at most `labels` labels, and the host with 1 to `depth` path segments: no longer pattern is listed."""
    host, parts = F.split(host_of(url), "\\."), segments_of(url)
    fit = F.least(F.size(host), F.lit(labels))
    suffixes = F.transform(F.sequence(F.lit(1), fit), lambda n: F.array_join(F.slice(host, F.size(host) - n + 1, n), "."))
    deep = F.least(F.size(parts), F.lit(depth))
    prefixes = F.when(deep > 0, F.transform(F.sequence(F.lit(1), deep), lambda n: F.concat(host_of(url), F.lit("/"), F.array_join(F.slice(parts, 1, n), "/")))).otherwise(F.array().cast("array<string>"))
    return F.when(F.coalesce(host_of(url), F.lit("")) != "", F.array_distinct(F.concat(F.when(fit > 0, suffixes).otherwise(F.array().cast("array<string>")), prefixes))).otherwise(F.array().cast("array<string>"))


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, since, until): when each pattern is listed; until is null while it still is.

    entries (pattern, listed, action): action is add or remove. Of entries of one pattern and time, a removal
    counts. Entries with a null in any of these, or another action, are no entries. Patterns are lower-cased.
    """
    good = entries.select(F.lower("pattern").alias("pattern"), F.col("listed"), F.col("action")).where("pattern is not null and pattern <> '' and listed is not null and action in ('add', 'remove')")
    state = good.groupBy("pattern", "listed").agg(F.min(F.col("action") == "add").alias("active"))
    by_time = Window.partitionBy("pattern").orderBy("listed")
    changes = state.withColumn("before", F.lag("active", 1, False).over(by_time)).where("active <> before")
    return changes.withColumn("until", F.lead("listed").over(by_time)).where("active").select("pattern", F.col("listed").alias("since"), "until")


def evaluate(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """page_id, url, fetched, n_entries (patterns active at that time), first_entry, blocked: one row for each distinct capture.

    captures (page_id, url, fetched). A null or malformed URL has no host and meets no entry, nor does a null time.
    Without entries nothing is blocked. Repeated captures are one. Other columns are not read.
    """
    valid = intervals(entries)
    # Two numbers about the list bound the keys of a capture, however long its URL.
    shape = valid.agg(F.max(F.size(F.split(F.regexp_extract("pattern", "^[^/]*", 0), "\\."))), F.max(F.size(F.split("pattern", "/")) - 1)).first()
    seen = captures.select("page_id", "url", "fetched").distinct()
    asked = captures.select("page_id", "url", "fetched", F.explode(keys_of(F.col("url"), shape[0] or 0, shape[1] or 0)).alias("pattern"))
    asked = asked.withColumn("salt", F.pmod(F.xxhash64("page_id", "url", "fetched"), F.lit(SALTS)).cast("int"))
    spread = valid.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    active = (asked["fetched"] >= spread["since"]) & (spread["until"].isNull() | (asked["fetched"] < spread["until"]))
    met = asked.join(spread, (asked["pattern"] == spread["pattern"]) & (asked["salt"] == spread["salt"]) & active).select("page_id", "url", "fetched", asked["pattern"].alias("pattern"))
    every = seen.withColumn("pattern", F.lit(None).cast("string")).unionByName(met.distinct())
    found = every.groupBy("page_id", "url", "fetched").agg(F.count("pattern").alias("n_entries"), F.min("pattern").alias("first_entry"))
    return found.withColumn("blocked", F.col("n_entries") > 0)


def dated_list(pages: DataFrame) -> DataFrame:
    """The list of the query: entries about a third of the hosts, a fifth of their /en paths, and two parent domains, dated by
    a digest of the host, so that SQL can form the same list."""
    hosts = pages.select(host_of(F.col("url")).alias("host")).where("host <> ''").distinct().withColumn("v", F.conv(F.substring(F.md5("host"), 1, 4), 16, 10).cast("int"))
    hosts = stored(hosts, "url-hosts", "snappy")  # read by each kind of entry
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n)
    entry = lambda pattern, listed, action: F.struct(pattern.alias("pattern"), listed.alias("listed"), F.lit(action).alias("action"))
    host, v = F.col("host"), F.col("v")
    own = [
        hosts.where("v % 3 = 0").select(entry(host, day(v % 300), "add").alias("e")), hosts.where("v % 3 = 0").select(entry(host, day(v % 300 + 40 + v % 50), "remove").alias("e")),
        hosts.where("v % 12 = 0").select(entry(host, day(v % 300 + 150), "add").alias("e")), hosts.where("v % 5 = 0").select(entry(F.concat(host, F.lit("/en")), day(v % 200), "add").alias("e")),
    ]
    fixed = pages.sparkSession.sql(
        "SELECT struct(pattern, listed, action) AS e FROM VALUES ('example.org', DATE'2024-03-01', 'add'), ('example.org', DATE'2024-04-01', 'remove'), ('example.net/de', DATE'2024-01-05', 'add'), "
        "('example.net', DATE'2024-09-01', 'add') AS t(pattern, listed, action)"
    )
    out = fixed
    for part in own:
        out = out.unionByName(part)
    return out.select("e.*")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 366).cast("int")))
    return evaluate(captures, dated_list(pages)).select("page_id", "url", F.date_format("fetched", "yyyy-MM-dd").alias("fetched"), "n_entries", "first_entry", "blocked")


OP3_SQL = r"""
WITH stems AS (
  SELECT DISTINCT page_id, url, DATE '2024-01-01' + CAST(page_id % 366 AS INTEGER) AS fetched,
         regexp_extract(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '^[^?#]*', 0) AS stem
  FROM pages
), captures AS (
  SELECT *, lower(regexp_replace(regexp_replace(regexp_extract(stem, '^[^/]*', 0), '^.*@', ''), ':[0-9]*$', '')) AS host,
         list_filter(string_split(regexp_replace(stem, '^[^/]*', ''), '/'), lambda s: s <> '') AS parts
  FROM stems
), hosts AS (
  SELECT host, CAST('0x' || substr(md5(host), 1, 4) AS INTEGER) AS v FROM (SELECT DISTINCT host FROM captures WHERE host <> '')
), entries AS (
  SELECT host AS pattern, DATE '2024-01-01' + v % 300 AS listed, 'add' AS action FROM hosts WHERE v % 3 = 0
  UNION ALL SELECT host, DATE '2024-01-01' + (v % 300 + 40 + v % 50), 'remove' FROM hosts WHERE v % 3 = 0
  UNION ALL SELECT host, DATE '2024-01-01' + (v % 300 + 150), 'add' FROM hosts WHERE v % 12 = 0
  UNION ALL SELECT host || '/en', DATE '2024-01-01' + v % 200, 'add' FROM hosts WHERE v % 5 = 0
  UNION ALL SELECT * FROM (VALUES ('example.org', DATE '2024-03-01', 'add'), ('example.org', DATE '2024-04-01', 'remove'),
                                  ('example.net/de', DATE '2024-01-05', 'add'), ('example.net', DATE '2024-09-01', 'add'))
), keys AS (
  SELECT page_id, url, fetched,
         unnest(list_distinct(list_concat(
           list_transform(range(1, len(string_split(host, '.')) + 1), lambda n: array_to_string(string_split(host, '.')[-n:], '.')),
           list_transform(range(1, len(parts) + 1), lambda n: host || '/' || array_to_string(parts[1:n], '/'))))) AS pattern
  FROM captures WHERE host <> ''
), last_day AS (
  SELECT k.page_id, k.url, k.fetched, k.pattern, max(e.listed) AS listed
  FROM keys k JOIN entries e ON e.pattern = k.pattern AND e.listed <= k.fetched GROUP BY ALL
), active AS (
  SELECT l.page_id, l.url, l.fetched, l.pattern FROM last_day l
  JOIN entries e ON e.pattern = l.pattern AND e.listed = l.listed GROUP BY ALL HAVING bool_and(e.action = 'add')
)
SELECT c.page_id, c.url, strftime(c.fetched, '%Y-%m-%d') AS fetched, count(a.pattern) AS n_entries, min(a.pattern) AS first_entry, count(a.pattern) > 0 AS blocked
FROM captures c LEFT JOIN active a ON c.page_id = a.page_id AND c.url = a.url AND c.fetched = a.fetched
GROUP BY c.page_id, c.url, c.fetched
"""
