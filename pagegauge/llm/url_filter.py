"""URL filters as they stood when a page was fetched.

Lists change: an entry is added on one day and taken off on another. Dated entries become validity
intervals per list and rule, and every capture is joined as of its fetch time to the rules it falls
under: its host, the domains above it, its path prefixes and its whole address. The join is by rule
and month, intervals being laid out over the months they touch, so a host with a third of all
captures is dealt over its months, and Spark may split what is still large.

Entry kinds: ``host`` (that host only), ``domain`` (the domain and everything below it), ``prefix``
(host and leading path segments) and ``url`` (host, path and query). Scheme, user, port, fragment,
``www.`` and the case of the host do not matter.

Defined cases: a removal at the very instant of an addition wins; entries or captures with a null
rule or time match nothing, such captures are returned as not blocked; an entry without a list or of
another kind or action is an error in the list and matches nothing; repeated entries count once;
repeated captures are returned as often as they come; empty tables give no rows, or no matches.
Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("host", "domain", "prefix", "url")


def split_url(url: str) -> str:
    """SQL text: struct of host and path (with query, without fragment) of the column ``url``."""
    bare = f"regexp_replace(regexp_replace({url}, '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '#.*$', '')"
    host = f"regexp_replace(regexp_replace(lower(regexp_extract({bare}, '^([^/?]*)', 1)), '^.*@', ''), '(:[0-9]*)?$|^www[.]', '')"
    return f"named_struct('host', rtrim('.', {host}), 'path', regexp_extract({bare}, '^[^/?]*(.*)$', 1))"


def intervals(entries: DataFrame) -> DataFrame:
    """Validity intervals [valid_from, valid_to) of dated entries (list, kind, rule, action, at)."""
    told = entries.select("list", "kind", "rule", "action", "at").dropna()
    told = told.filter(F.col("kind").isin(*KINDS) & F.col("action").isin("add", "remove"))
    # "remove" sorts after "add".
    told = told.groupBy("list", "kind", "rule", "at").agg(F.max("action").alias("action"))
    after = F.lead("at").over(Window.partitionBy("list", "kind", "rule").orderBy("at"))
    return (
        told.withColumn("valid_to", after)
        .filter(F.col("action") == "add")
        .select("list", "kind", "rule", F.col("at").alias("valid_from"), "valid_to")
    )


def rules_of(captures: DataFrame) -> DataFrame:
    """Every rule a capture may fall under (kind, rule), beside its columns."""
    parts = captures.withColumn("u", F.expr(split_url("url")))
    parts = parts.withColumn("labels", F.split("u.host", "[.]")).withColumn(
        "segments", F.filter(F.split(F.regexp_replace("u.path", "[?].*$", ""), "/"), lambda x: x != "")
    )
    rules = F.expr(
        "concat(array(struct('host' AS kind, u.host AS rule), struct('url' AS kind, concat(u.host, u.path) AS rule)),"
        " transform(sequence(1, size(labels)), i -> struct('domain' AS kind, array_join(slice(labels, i, size(labels)), '.') AS rule)),"
        " transform(sequence(0, size(segments)), i -> struct('prefix' AS kind, concat(u.host, '/', array_join(slice(segments, 1, i), '/')) AS rule)))"
    )
    return parts.select(*captures.columns, F.explode(F.array_distinct(rules)).alias("r")).select(*captures.columns, "r.kind", "r.rule")


def _month(at) -> F.Column:
    return F.year(at) * 12 + F.month(at)


def active_entries(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """One row per capture: its id, url and time, ``lists`` (sorted names of the lists with an entry
    that was active), ``n_active`` (active entries) and ``blocked``."""
    own = captures.select(captures[id_col].alias("id"), captures[url_col].alias("url"), captures[time_col].alias("at"))
    known = own.dropna(subset=["url", "at"]).distinct()
    span = known.agg(F.min("at").alias("a"), F.max("at").alias("b"), F.lit(1).alias("one"))
    valid = intervals(entries).withColumn("one", F.lit(1)).join(span, "one")
    valid = valid.filter((F.col("valid_from") <= F.col("b")) & (F.coalesce(F.col("valid_to"), F.col("b")) >= F.col("a")))
    months = F.sequence(_month(F.greatest("valid_from", "a")), _month(F.least(F.coalesce("valid_to", "b"), F.col("b"))))
    laid = valid.select("list", "kind", "rule", "valid_from", "valid_to", F.explode(months).alias("month"))
    asked = rules_of(known).withColumn("month", _month(F.col("at")))
    met = asked.join(laid, ["kind", "rule", "month"]).filter(
        (F.col("valid_from") <= F.col("at")) & (F.col("valid_to").isNull() | (F.col("at") < F.col("valid_to")))
    )
    found = met.groupBy("id", "url", "at").agg(F.array_sort(F.collect_set("list")).alias("lists"), F.count("*").alias("n_active"))
    found = found.select(F.col("id").alias("f_id"), F.col("url").alias("f_url"), F.col("at").alias("f_at"), "lists", "n_active")
    same = F.col("id").eqNullSafe(F.col("f_id")) & (F.col("url") == F.col("f_url")) & (F.col("at") == F.col("f_at"))
    return own.join(found, same, "left").select(
        F.col("id").alias(id_col),
        F.col("url").alias(url_col),
        F.col("at").alias(time_col),
        F.coalesce("lists", F.array().cast("array<string>")).alias("lists"),
        F.coalesce("n_active", F.lit(0)).alias("n_active"),
        (F.coalesce("n_active", F.lit(0)) > 0).alias("blocked"),
    )
