"""Run comparison and gate queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegauge.operators import gates as gt
from pagegauge.operators import timeline as tl
from pagegauge.operators.detection import rate
from pagegauge.operators.percentiles import Wanted, with_percentiles
from pagegauge.plans import bindings as b
from pagegauge.plans import captures as cp
from pagegauge.plans.detection import rounded, sql_pct
from pagegauge.plans.registry import Tables, query, view

METRICS = ["wrongRate", "missRate", "falsePositiveRate", "cornerErrorP50"]

view(
    "fx_runs",
    f"""
    SELECT run, family, variant, round(avg(CASE WHEN l_discount > 0.05 THEN 1.0 ELSE 0.0 END), 9) AS "wrongRate",
           round(avg(CASE WHEN l_tax > 0.06 THEN 1.0 ELSE 0.0 END), 9) AS "missRate",
           CASE WHEN NOT (run = 1 AND family = 'N') THEN round(avg(CASE WHEN l_quantity > 40 THEN 1.0 ELSE 0.0 END), 9) END
             AS "falsePositiveRate",
           round({sql_pct('l_extendedprice', 0.5)} / 1000000, 9) AS "cornerErrorP50"
    FROM (SELECT *, l_orderkey % 2 AS run, l_returnflag AS family,
            CASE WHEN l_orderkey % 2 = 1 AND l_returnflag = 'R' AND l_linestatus = 'F' THEN 'F2' ELSE l_linestatus END AS variant
          FROM lineitem)
    GROUP BY run, family, variant
    """,
)
view(
    "fx_long",
    " UNION ALL ".join(f"""SELECT run, family, variant, '{m}' AS metric, "{m}" AS v FROM fx_runs""" for m in METRICS),
)


def runs(t: Tables) -> DataFrame:
    # A variant that the second run has under another name: lost for the first, new for the second.
    renamed = F.expr("l_orderkey % 2 = 1 AND l_returnflag = 'R' AND l_linestatus = 'F'")
    rows = t.lineitem.select(
        (F.col("l_orderkey") % 2).alias("run"),
        F.col("l_returnflag").alias("family"),
        F.when(renamed, "F2").otherwise(F.col("l_linestatus")).alias("variant"),
        "l_discount",
        "l_tax",
        "l_quantity",
        "l_extendedprice",
    )
    by = ["run", "family", "variant"]
    n = F.count("*")
    table = rows.groupBy(*by).agg(
        rate(F.count_if(F.col("l_discount") > 0.05), n).alias("wrongRate"),
        rate(F.count_if(F.col("l_tax") > 0.06), n).alias("missRate"),
        rate(F.count_if(F.col("l_quantity") > 40), n).alias("falsePositiveRate"),
    )
    gone = (F.col("run") == 1) & (F.col("family") == "N")
    table = table.withColumn("falsePositiveRate", F.when(~gone, F.col("falsePositiveRate")))
    table = with_percentiles(
        table, rows, by, {"price": (F.col("l_extendedprice"), 50.0)}, [Wanted("price_p50", "price", 0.5)]
    )
    out = table.withColumn("cornerErrorP50", F.col("price_p50") / 1000000).drop("price_p50")
    return out.select(*by, *[F.round(F.col(m), 9).alias(m) for m in METRICS])


def run_metrics(t: Tables) -> tuple[DataFrame, DataFrame]:
    long = gt.long_metrics(runs(t), ["run", "family", "variant"], METRICS)
    return long.where("run = 0"), long.where("run = 1")


_TOLERANCES = "CASE metric WHEN 'cornerErrorP50' THEN CAST(0.002 AS DOUBLE) ELSE CAST(0.02 AS DOUBLE) END"
view(
    "fx_compared",
    f"""
    SELECT *, CASE WHEN before IS NULL AND now IS NULL THEN 'none' WHEN before IS NULL THEN 'new' WHEN now IS NULL THEN 'lost'
                   WHEN now - before > tolerance + 1e-12 THEN 'regressed' ELSE 'ok' END AS status
    FROM (SELECT family, variant, metric, p.v AS before, n.v AS now, n.v - p.v AS delta, {_TOLERANCES} AS tolerance
          FROM (SELECT * FROM fx_long WHERE run = 0) p
          FULL JOIN (SELECT * FROM fx_long WHERE run = 1) n USING (family, variant, metric))
    """,
)


@query(
    "baseline_full_compare",
    """
    SELECT family, variant, metric, round(before, 6) AS before, round(now, 6) AS now, round(delta, 6) AS delta, status
    FROM fx_compared
    """,
)
def baseline_full_compare(t: Tables) -> DataFrame:
    table = gt.compare_runs(*run_metrics(t), ["family", "variant"])
    return rounded(table.select("family", "variant", "metric", "before", "now", "delta", "status"))


@query(
    "regression_gate",
    """
    SELECT family, variant, metric, round(delta, 6) AS delta, tolerance, status FROM fx_compared
    WHERE status IN ('regressed', 'lost')
    """,
)
def regression_gate(t: Tables) -> DataFrame:
    table = gt.compare_runs(*run_metrics(t), ["family", "variant"])
    kept = table.where(F.col("status").isin("regressed", "lost"))
    return rounded(kept.select("family", "variant", "metric", "delta", "tolerance", "status"))


@query(
    "headline_table",
    """
    SELECT family, variant, round(max(now) FILTER (metric = 'wrongRate'), 6) AS "wrongRate",
           round(max(now) FILTER (metric = 'missRate'), 6) AS "missRate",
           round(max(now) FILTER (metric = 'falsePositiveRate'), 6) AS "falsePositiveRate",
           round(max(now) FILTER (metric = 'cornerErrorP50'), 6) AS "cornerErrorP50" FROM fx_compared
    GROUP BY family, variant
    """,
)
def headline_table(t: Tables) -> DataFrame:
    table = gt.compare_runs(*run_metrics(t), ["family", "variant"])
    return rounded(table.groupBy("family", "variant").pivot("metric", METRICS).agg(F.max("now")))


@query("missing_measurements", "SELECT family, variant, metric FROM fx_compared WHERE before IS NOT NULL AND now IS NULL")
def missing_measurements(t: Tables) -> DataFrame:
    previous, current = run_metrics(t)
    keys = ["family", "variant", "metric"]
    measured = previous.where("value IS NOT NULL").select(*keys)
    return measured.exceptAll(current.where("value IS NOT NULL").select(*keys))


_SUMMED = """
    SELECT CAST(w.n_wide AS DOUBLE) AS missing_data, CAST(u.n AS DOUBLE) AS unscored, u.session_id
    FROM (SELECT session_id, count(*) FILTER (k % 11 = 3) AS n FROM fx_log WHERE kind = 'capture' GROUP BY session_id) u
    JOIN (SELECT session_id, CASE WHEN w.to_t - w.from_t - obs > 0.2 * (w.to_t - w.from_t) THEN 1 ELSE 0 END AS n_wide
          FROM fx_windows w JOIN (SELECT session_id, sum(e2 - b) AS obs FROM fx_intervals GROUP BY session_id) i
          USING (session_id)) w USING (session_id)"""


@query(
    "absolute_gate",
    f"""
    SELECT session_id, metric, value, CAST(0 AS DOUBLE) AS lim,
           CASE WHEN value IS NULL THEN 'no value' ELSE 'over limit' END AS problem
    FROM (SELECT session_id, 'missingData' AS metric, missing_data AS value FROM ({_SUMMED}) UNION ALL
          SELECT session_id, 'unscoredCaptures', CASE WHEN session_id % 25 <> 4 THEN unscored END FROM ({_SUMMED}))
    WHERE value IS NULL OR value > 0
    """,
)
def absolute_gate(t: Tables) -> DataFrame:
    rows = b.samples(t)
    spans = b.windows(rows)
    seen = tl.observed(tl.intervals(rows, spans), spans, {})
    wide = F.col("unobserved_ms") > tl.MAX_UNOBSERVED_SHARE * (F.col("to_t") - F.col("from_t"))
    missing = seen.select("session_id", F.when(wide, 1.0).otherwise(0.0).alias("missingData"))
    unscored = b.log(t).where("kind = 'capture'").groupBy("session_id").agg(
        F.count_if(F.col("k") % 11 == 3).cast("double").alias("unscoredCaptures")
    )
    unscored = unscored.withColumn(
        "unscoredCaptures", F.when(F.col("session_id") % 25 != 4, F.col("unscoredCaptures"))
    )
    wide_table = missing.join(unscored, "session_id")
    long = gt.long_metrics(wide_table, ["session_id"], ["missingData", "unscoredCaptures"])
    return gt.absolute_violations("session", long, ["session_id"])


@query(
    "missing_data_audit",
    """
    SELECT session_id, 'window' AS what, CAST(NULL AS BIGINT) AS event_id,
           CAST(w.to_t - w.from_t - coalesce(obs, 0) AS BIGINT) AS unobserved_ms
    FROM fx_windows w LEFT JOIN (SELECT session_id, sum(e2 - b) AS obs FROM fx_intervals GROUP BY session_id) i
      USING (session_id)
    WHERE w.to_t - w.from_t - coalesce(obs, 0) > 0.2 * (w.to_t - w.from_t)
    UNION ALL SELECT session_id, 'capture image', event_id, NULL FROM fx_stitched WHERE open_t IS NOT NULL AND k % 11 = 3
    UNION ALL SELECT session_id, 'content truth', event_id, NULL FROM fx_stitched
      WHERE open_t IS NOT NULL AND k % 11 <> 3 AND k % 10 <> 7 AND k % 13 = 5
    """,
)
def missing_data_audit(t: Tables) -> DataFrame:
    rows = b.samples(t)
    spans = b.windows(rows)
    seen = tl.observed(tl.intervals(rows, spans), spans, {})
    wide = seen.where(F.col("unobserved_ms") > tl.MAX_UNOBSERVED_SHARE * (F.col("to_t") - F.col("from_t")))
    none = F.lit(None).cast("bigint")
    windows = wide.select("session_id", F.lit("window").alias("what"), none.alias("event_id"), "unobserved_ms")
    opened = cp.stitched(t).where("open_t IS NOT NULL")
    k = F.col("k")
    what = F.when(k % 11 == 3, "capture image").when((k % 10 != 7) & (k % 13 == 5), "content truth")
    captures = opened.select("session_id", what.alias("what"), "event_id", none.alias("unobserved_ms"))
    return windows.unionByName(captures.where("what IS NOT NULL"))


SESSIONS = ["dim-owner-case", "dim-owner-bare", "dim-sheet-over", "dim-text-page", "lit-desk"]
view(
    "fx_locks",
    f"""
    SELECT CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 4 END AS cpu, {b.sql_pick(SESSIONS, 'o_custkey % 5')} AS session,
           count(*) AS runs, round(avg(o_totalprice / 500000), 6) AS locked_share,
           {sql_pct('o_totalprice / 200', 0.5)} AS first_lock_p50
    FROM orders GROUP BY 1, 2
    """,
)


def locks(t: Tables) -> DataFrame:
    rows = t.orders.select(
        F.when(F.col("o_orderkey") % 2 == 0, 1).otherwise(4).alias("cpu"),
        b.pick(SESSIONS, (F.col("o_custkey") % 5).cast("int")).alias("session"),
        (F.col("o_totalprice") / 500000).alias("share"),
        (F.col("o_totalprice") / 200).alias("first"),
    )
    by = ["cpu", "session"]
    table = rows.groupBy(*by).agg(F.count("*").alias("runs"), F.round(F.avg("share"), 6).alias("locked_share"))
    return with_percentiles(table, rows, by, {"first": (F.col("first"), 1.0)}, [Wanted("first_lock_p50", "first", 0.5)])


_FLOORS = "CASE " + " ".join(
    f"WHEN cpu = {cpu} AND session = '{s}' THEN CAST({v} AS DOUBLE)" for (cpu, s), v in gt.PAPER_LOCK_FLOORS.items()
) + " END"


@query(
    "paper_lock_gate",
    f"""
    SELECT cpu, session, runs, locked_share, floor, unnest(list_filter([CASE WHEN runs < 8 THEN 'too few runs' END,
             CASE WHEN runs >= 8 AND locked_share < floor THEN 'below floor' END,
             CASE WHEN runs >= 8 AND cpu = 1 AND NOT coalesce(first_lock_p50 <= 1500, false) THEN 'locked late' END],
             lambda v: v IS NOT NULL)) AS problem
    FROM (SELECT *, {_FLOORS} AS floor FROM fx_locks) WHERE floor IS NOT NULL
    """,
)
def paper_lock_gate(t: Tables) -> DataFrame:
    return gt.paper_lock_violations(locks(t))


@query(
    "paper_lock_target",
    "SELECT cpu, session, locked_share, locked_share >= 0.8 AS met FROM fx_locks WHERE session LIKE 'dim%'",
)
def paper_lock_target(t: Tables) -> DataFrame:
    met = F.col("locked_share") >= gt.PAPER_LOCK_TARGET
    return locks(t).where("session LIKE 'dim%'").select("cpu", "session", "locked_share", met.alias("met"))


view(
    "fx_scope",
    """
    SELECT l_orderkey % 2 AS run, CASE WHEN l_orderkey % 2 = 1 AND l_returnflag = 'A' THEN 'B' ELSE l_returnflag END AS family, l_linestatus AS variant FROM lineitem
    UNION ALL SELECT DISTINCT l_orderkey % 2, 'ALL', l_linestatus FROM lineitem
    """,
)


@query(
    "comparable_scope",
    """
    SELECT family, variant FROM ((SELECT DISTINCT family, variant FROM fx_scope WHERE run = 0) INTERSECT
      (SELECT DISTINCT family, variant FROM fx_scope WHERE run = 1))
    WHERE family <> 'ALL' OR (SELECT count(*) FROM (
      (SELECT DISTINCT family FROM fx_scope WHERE run = 0) EXCEPT (SELECT DISTINCT family FROM fx_scope WHERE run = 1))) = 0
    """,
)
def comparable_scope(t: Tables) -> DataFrame:
    renamed = F.when((F.col("l_orderkey") % 2 == 1) & (F.col("l_returnflag") == "A"), "B").otherwise(F.col("l_returnflag"))
    rows = t.lineitem.select(
        (F.col("l_orderkey") % 2).alias("run"), renamed.alias("family"), F.col("l_linestatus").alias("variant")
    )
    pooled = t.lineitem.select(
        (F.col("l_orderkey") % 2).alias("run"), F.lit("ALL").alias("family"), F.col("l_linestatus").alias("variant")
    )
    scope = rows.unionByName(pooled)
    keys = ["family", "variant"]
    return gt.shared_scope(scope.where("run = 0"), scope.where("run = 1"), keys, F.col("family") == "ALL")


@query(
    "comparable_config",
    """
    SELECT name, p.setting AS before, n.setting AS now FROM (
      SELECT c_mktsegment AS name, CAST(count(*) AS VARCHAR) AS setting FROM customer WHERE c_custkey % 2 = 0 GROUP BY 1) p
    FULL JOIN (SELECT c_mktsegment AS name, CAST(count(*) AS VARCHAR) AS setting FROM customer WHERE c_custkey % 2 = 1
               GROUP BY 1) n USING (name)
    WHERE name IN ('AUTOMOBILE', 'BUILDING', 'MACHINERY') AND p.setting IS DISTINCT FROM n.setting
    """,
)
def comparable_config(t: Tables) -> DataFrame:
    """Settings that must match for two runs to be compared, and do not."""

    def config(side: int) -> DataFrame:
        rows = t.customer.where(F.col("c_custkey") % 2 == side)
        return rows.groupBy(F.col("c_mktsegment").alias("name")).agg(F.count("*").cast("string").alias("setting"))

    return gt.config_problems(config(0), config(1), ["AUTOMOBILE", "BUILDING", "MACHINERY"])


@query(
    "run_identity",
    """
    SELECT family, variant, sha256('{"family":"' || family || '","variant":"' || variant || '","n":' || n || '}') AS run_hash
    FROM (SELECT l_returnflag AS family, l_linestatus AS variant, count(*) AS n FROM lineitem GROUP BY 1, 2)
    """,
)
def run_identity(t: Tables) -> DataFrame:
    config = t.lineitem.groupBy(F.col("l_returnflag").alias("family"), F.col("l_linestatus").alias("variant")).agg(
        F.count("*").alias("n")
    )
    return config.select("family", "variant", gt.identity("family", "variant", "n").alias("run_hash"))


@query(
    "incremental_skip",
    "SELECT doc_id, md5(text) AS content_hash FROM documents WHERE doc_id % 3 = 0 OR doc_id % 5 = 0",
)
def incremental_skip(t: Tables) -> DataFrame:
    """Documents to recompute: absent from the manifest, or there under another content hash."""
    items = t.documents.select("doc_id", F.md5("text").alias("content_hash"))
    stale = F.when(F.col("doc_id") % 5 == 0, F.md5(F.concat("text", F.lit("x")))).otherwise(F.md5("text"))
    manifest = t.documents.where("doc_id % 3 <> 0").select("doc_id", stale.alias("content_hash"))
    return gt.still_to_do(items, manifest, ["doc_id", "content_hash"])
