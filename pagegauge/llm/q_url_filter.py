"""Query of the URL filters, with its SQL twin.

The tables have neither fetch times nor lists, so both are derived from ``pages``: a time from the
page's number, and entries from the hosts, domains and path prefixes that occur, dated and taken
back by a hash of the rule.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegauge.llm import url_filter
from pagegauge.llm.queries import query, table

SQL = r"""
WITH p AS (
  SELECT page_id, url, TIMESTAMP '2023-01-01 00:00:00' + to_seconds(page_id * 7919 % 730 * 86400 + page_id * 31 % 86400) AS seen,
         regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '#.*$', '') AS bare
  FROM pages
), u AS (
  SELECT page_id, url, seen, string_split(host, '.') AS labels, host, path,
         list_filter(string_split(regexp_replace(path, '[?].*$', ''), '/'), lambda x: x <> '') AS segments
  FROM (SELECT *, regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), '^.*@', ''), ':[0-9]*$', ''), '^www[.]', '') AS host,
               regexp_extract(bare, '^[^/?]*(.*)$', 1) AS path FROM p)
), asked AS (
  SELECT page_id, url, seen, 'host' AS kind, host AS rule FROM u
  UNION SELECT page_id, url, seen, 'url', host || path FROM u
  UNION SELECT page_id, url, seen, 'domain', array_to_string(list_slice(labels, i, len(labels)), '.')
        FROM (SELECT *, unnest(range(1, len(labels) + 1)) AS i FROM u)
  UNION SELECT page_id, url, seen, 'prefix', host || '/' || array_to_string(list_slice(segments, 1, i), '/')
        FROM (SELECT *, unnest(range(0, len(segments) + 1)) AS i FROM u)
), rules AS (
  SELECT DISTINCT kind, rule, CAST('0x' || substr(md5(kind || ' ' || rule), 1, 7) AS BIGINT) AS h FROM asked WHERE kind <> 'url'
), told AS (
  SELECT CASE WHEN h % 2 = 0 THEN 'spam' ELSE 'adult' END AS list, kind, rule, h, s.action, TIMESTAMP '2023-01-01 00:00:00' + to_days(CAST(h // 7 % 500 + s.days AS INTEGER)) AS seen
  FROM rules, (VALUES ('add', 0, 1), ('remove', 90, 2), ('add', 200, 4)) s(action, days, part)
  WHERE h % 5 = 0 AND (s.part = 1 OR h // 5 % s.part = 0)
), valid AS (
  SELECT * FROM (SELECT *, lead(seen) OVER (PARTITION BY list, kind, rule ORDER BY seen) AS until FROM told) WHERE action = 'add'
), met AS (
  SELECT asked.page_id, asked.url, asked.seen, count(*) AS n, string_agg(DISTINCT list, ',' ORDER BY list) AS names
  FROM asked JOIN valid v ON v.kind = asked.kind AND v.rule = asked.rule AND v.seen <= asked.seen AND (v.until IS NULL OR asked.seen < v.until)
  GROUP BY ALL
)
SELECT p.page_id, p.url, CAST(epoch(p.seen) AS BIGINT) AS fetched_s, coalesce(met.n, 0) AS n_active, coalesce(names, '') AS lists, met.n IS NOT NULL AS blocked
FROM p LEFT JOIN met ON met.page_id = p.page_id AND met.url = p.url
"""


def captures_of(pages: DataFrame) -> DataFrame:
    seconds = "page_id * 7919 % 730 * 86400 + page_id * 31 % 86400"
    return pages.select("page_id", "url", F.expr(f"timestamp_seconds(1672531200 + {seconds})").alias("fetched_at"))


def entries_of(captures: DataFrame) -> DataFrame:
    rules = url_filter.rules_of(captures).filter("kind <> 'url'").select("kind", "rule").distinct()
    rules = rules.withColumn("h", F.expr("CAST(conv(substr(md5(concat(kind, ' ', rule)), 1, 7), 16, 10) AS BIGINT)")).filter("h % 5 = 0")
    told = rules.select(
        "*", F.inline(F.expr("array(named_struct('action', 'add', 'days', 0, 'part', 1), named_struct('action', 'remove', 'days', 90, 'part', 2), named_struct('action', 'add', 'days', 200, 'part', 4))"))
    ).filter("part = 1 OR h div 5 % part = 0")
    return told.select(
        F.expr("IF(h % 2 = 0, 'spam', 'adult')").alias("list"),
        "kind",
        "rule",
        "action",
        F.expr("timestamp_seconds(1672531200 + 86400 * (h div 7 % 500 + days))").alias("at"),
    )


@query("op8_url_filters", SQL)
def filters(spark: SparkSession, folder: str) -> DataFrame:
    """Every capture against the list entries that were active when it was fetched."""
    captures = captures_of(table(spark, folder, "pages"))
    found = url_filter.active_entries(captures, entries_of(captures))
    return found.select(
        "page_id",
        "url",
        F.expr("unix_timestamp(fetched_at)").alias("fetched_s"),
        "n_active",
        F.array_join("lists", ",").alias("lists"),
        "blocked",
    )
