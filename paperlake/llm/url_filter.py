"""URL filters by a temporal list join, in DataFrame expressions throughout.

A list is a history of dated entries: on a day a rule (a domain with its subdomains, or a
URL prefix) is put on a list or taken off it. Entries become validity intervals
[valid_from, valid_to); every capture is then held against the entries that were active
when it was fetched. Each capture names the rules that could match it (all suffixes of its
host, all path prefixes), so the as-of join is an equality on the rule plus two bounds on
time. Rules are salted: a host with a third of all captures is dealt over ``SALTS`` tasks,
and the intervals of a rule are repeated once for each salt.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, joined_by_hot_key

SALTS = 16


def intervals(entries: DataFrame) -> DataFrame:
    """entries(list, rule, action add|remove, at) to intervals(list, rule, valid_from, valid_to).

    Events of a rule take effect in order of time, removals after additions at the same
    instant; repeated additions and removals change nothing. An addition that is never
    taken back stays valid (valid_to null). Rows with a null rule, action or time are void.
    """
    known = entries.where("rule IS NOT NULL AND at IS NOT NULL AND action IN ('add', 'remove')").select(
        F.coalesce(F.col("list"), F.lit("")).alias("list"), F.lower("rule").alias("rule"), F.col("action") == "add", "at"
    ).toDF("list", "rule", "on", "at")
    #: At one instant the last word is the removal, if there is one.
    states = known.groupBy("list", "rule", "at").agg(F.min("on").alias("on"))
    order = Window.partitionBy("list", "rule").orderBy("at")
    changes = states.withColumn("was", F.coalesce(F.lag("on").over(order), F.lit(False))).where("on <> was")
    spans = changes.withColumn("valid_to", F.lead("at").over(order))
    return spans.where("on").select("list", "rule", F.col("at").alias("valid_from"), "valid_to")


def host_and_path(url: str = "url"):
    """Host (lower case, no user, port or closing dot) and path (no query or fragment) of a URL."""
    rest = F.regexp_replace(F.trim(F.col(url)), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    authority = F.regexp_extract(rest, "^([^/?#]*)", 1)
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(authority, "^.*@", ""), ":[0-9]*$", ""), "\\.$", "")
    path = F.regexp_extract(rest, "^[^/?#]*(/[^?#]*)", 1)
    return F.lower(host), path


def rule_sizes(rules: DataFrame) -> tuple[list[int], list[int]]:
    """The numbers of labels that listed domains have, and the numbers of path parts that listed prefixes have.

    Short lists of distinct small numbers, whatever the length of the list of rules.
    """
    slashes = F.length("rule") - F.length(F.replace("rule", F.lit("/"), F.lit("")))
    rows = rules.select(slashes.alias("parts"), F.when(slashes == 0, F.size(F.split("rule", "\\."))).alias("labels")).distinct().collect()
    return sorted({r.labels for r in rows if r.labels}), sorted({r.parts for r in rows if r.parts})


def candidate_rules(sizes: tuple[list[int], list[int]], host: str = "host", path: str = "path"):
    """Every rule of these sizes that may match: host suffixes (``a.b.c``, ``b.c``, ``c``) and prefixes ``host/p/q``.

    Only sizes that the list has are written out, so the work is linear in the length of a URL.
    """
    labels, parts = F.split(host, "\\."), F.filter(F.split(path, "/"), lambda x: x != "")
    fit = lambda numbers, of: F.filter(F.array(*map(F.lit, numbers)).cast("array<int>"), lambda n: n <= F.size(of))
    suffixes = F.transform(fit(sizes[0], labels), lambda n: F.array_join(F.slice(labels, F.size(labels) - n + 1, n), "."))
    prefix = lambda n: F.lower(F.concat(F.col(host), F.lit("/"), F.array_join(F.slice(parts, F.lit(1), n), "/")))
    return F.array_distinct(F.concat(suffixes, F.transform(fit(sizes[1], parts), prefix)))


def filter_captures(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """One row per capture(page_id, url, fetched_at): page_id, host, fetched_at, n_active, blocked, first_rule, since.

    n_active counts the entries (list and rule) that match and were active; first_rule is the
    smallest of them and since its start. A null or empty URL has no host and is never
    blocked; neither is a capture without a time. Repeated rows are judged once each. A page with
    very many captures of one time is joined by a broadcast, so it is no task of its own.
    """
    host, path = host_and_path()
    base = captures.select("page_id", host.alias("host"), path.alias("path"), "fetched_at")
    base = base.withColumn("host", F.when(F.col("host") != "", F.col("host")))
    #: Equal captures of a host, path and time have equal verdicts: they are judged once, and counted.
    key = ["host", "path", "fetched_at"]
    judgeable = F.col("host").isNotNull() & F.col("fetched_at").isNotNull()
    distinct = checkpointed(base.where(judgeable).groupBy(*key).agg(F.count("*").alias("captures")))
    valid = checkpointed(intervals(entries))
    asked = distinct.select(*key).withColumn("rule", F.explode(candidate_rules(rule_sizes(valid)))).withColumn(
        "salt", F.pmod(F.xxhash64("path", "fetched_at"), F.lit(SALTS))
    )
    spans = valid.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    active = (F.col("valid_from") <= F.col("fetched_at")) & (F.col("valid_to").isNull() | (F.col("fetched_at") < F.col("valid_to")))
    hits = asked.join(spans, ["rule", "salt"]).where(active)
    first = F.min(F.struct("rule", "valid_from"))
    found = hits.groupBy(*key).agg(F.count("*").alias("n_active"), first.alias("first"))
    verdicts = checkpointed(distinct.join(found, key, "left"))
    judged = joined_by_hot_key(base.where(judgeable), verdicts, key, "captures")
    return judged.unionByName(base.where(~judgeable), allowMissingColumns=True).select(
        "page_id", "host", "fetched_at", F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"), F.col("n_active").isNotNull().alias("blocked"),
        F.col("first.rule").alias("first_rule"), F.col("first.valid_from").alias("since"),
    )


def stand_in_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages with a fetch day that their number decides (the table has none)."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select(
        "page_id",
        "url",
        F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("page_id", F.lit(360)).cast("int")).alias("fetched_at"),
    )


def stand_in_entries(captures: DataFrame) -> DataFrame:
    """A dated list over all hosts of the captures: on, off and on again by the host's checksum.

    Domains (the host without its first label, where it has four or more) are listed where
    the checksum mod 3 is 0; hosts with their first path part where it is 1.
    """
    host, path = host_and_path()
    hosts = captures.select(host.alias("host"), F.regexp_extract(path, "^/([^/]+)", 1).alias("part")).where("host <> ''").distinct()
    c = F.conv(F.substring(F.md5(F.col("host").cast("binary")), 1, 6), 16, 10).cast("long")
    labels = F.split("host", "\\.")
    domain = F.when(F.size(labels) >= 4, F.array_join(F.slice(labels, F.lit(2), F.size(labels)), ".")).otherwise(F.col("host"))
    rules = hosts.where(c % 3 <= 1).select(
        c.alias("c"), F.when(c % 3 == 0, domain).otherwise(F.concat("host", F.lit("/"), "part")).alias("rule")
    ).distinct()
    day = lambda x: F.date_add(F.lit("2024-01-01").cast("date"), x.cast("int"))
    start = F.col("c") % 200
    event = lambda action, at: F.struct(F.lit(action).alias("action"), day(at).alias("at"))
    events = F.array(event("add", start), event("remove", start + 40), event("add", start + 90))
    return rules.withColumn("e", F.explode(events)).select(F.lit("stand-in").alias("list"), "rule", "e.action", "e.at")


ORACLE = r"""
WITH rest AS (
  SELECT page_id, DATE '2024-01-01' + CAST(page_id % 360 AS INTEGER) AS fetched_at,
         regexp_replace(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest FROM pages),
parts AS (
  SELECT page_id, fetched_at,
         lower(regexp_replace(regexp_replace(regexp_replace(regexp_extract(rest, '^([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', ''), '\.$', '')) AS host,
         regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) AS path FROM rest),
hosts AS (
  SELECT DISTINCT host, regexp_extract(path, '^/([^/]+)', 1) AS part,
         CAST('0x' || substr(md5(host), 1, 6) AS BIGINT) AS c FROM parts WHERE host <> ''),
rules AS (
  SELECT DISTINCT c, lower(CASE WHEN c % 3 = 1 THEN host || '/' || part
         WHEN len(string_split(host, '.')) >= 4 THEN array_to_string(string_split(host, '.')[2:], '.') ELSE host END) AS rule
  FROM hosts WHERE c % 3 <= 1),
events AS (
  SELECT rule, is_on, DATE '2024-01-01' + CAST(c % 200 + later AS INTEGER) AS day
  FROM rules CROSS JOIN (VALUES (true, 0), (false, 40), (true, 90)) AS v(is_on, later)),
states AS (SELECT rule, day, bool_and(is_on) AS is_on FROM events GROUP BY rule, day),
changes AS (
  SELECT * FROM (SELECT *, coalesce(lag(is_on) OVER (PARTITION BY rule ORDER BY day), false) AS was FROM states) WHERE is_on <> was),
spans AS (
  SELECT * FROM (SELECT rule, is_on, day AS valid_from, lead(day) OVER (PARTITION BY rule ORDER BY day) AS valid_to FROM changes) WHERE is_on),
asked AS (
  SELECT page_id, fetched_at, unnest(list_distinct(list_concat(
    list_transform(range(1, len(string_split(host, '.')) + 1), lambda i: array_to_string(string_split(host, '.')[i:], '.')),
    list_transform(range(1, len(list_filter(string_split(path, '/'), lambda x: x <> '')) + 1),
      lambda i: lower(host || '/' || array_to_string(list_filter(string_split(path, '/'), lambda x: x <> '')[1:i], '/')))))) AS rule
  FROM parts WHERE host <> ''),
hits AS (
  SELECT page_id, count(*) AS n, min(struct_pack(rule := a.rule, since := valid_from)) AS first
  FROM asked a JOIN spans s ON a.rule = s.rule AND valid_from <= fetched_at AND (valid_to IS NULL OR fetched_at < valid_to)
  GROUP BY page_id)
SELECT page_id, CASE WHEN host <> '' THEN host END AS host, fetched_at, coalesce(n, 0) AS n_active, n IS NOT NULL AS blocked,
       first.rule AS first_rule, first.since AS since
FROM parts LEFT JOIN hits USING (page_id)
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = stand_in_captures(spark, sf_dir)
    return filter_captures(captures, stand_in_entries(captures))


QUERIES = {"op5_url_filters": query}
ORACLE_SQL = {"op5_url_filters": ORACLE}
