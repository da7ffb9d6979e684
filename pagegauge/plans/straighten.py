"""Straighten queries, over order lines read as page records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegauge.operators import straighten as st
from pagegauge.plans.bindings import pick, sql_pick
from pagegauge.plans.detection import rounded, sql_rate
from pagegauge.plans.registry import Tables, query, view

FAMILIES = ["tilt", "curl", "rotation"]
CURLS = ["none", "s-bend", "none", "roll", "unknown"]
CODES = ["E1", "E2", "E3"]
REASONS = ["curl-absent", "low-text", "no-gain", "edge-lost", "flat"]
BUCKETS = ["nothing", "declined", "better-flat", "transient", "page", "unverified"]

view(
    "fx_straighten",
    f"""
    SELECT *, accepted OR deskewed AS acted,
           CASE WHEN accepted OR deskewed THEN final_tilt ELSE flat_tilt END AS page_tilt,
           CASE WHEN accepted OR deskewed THEN final_bow ELSE flat_bow END AS page_bow,
           curl NOT IN ('none', 'unknown') AS bent,
           abs(truth_tilt) >= 0.5 OR curl NOT IN ('none', 'unknown') AS should_act,
           NOT (abs(truth_tilt) >= 0.5 OR curl <> 'none') AS flat_and_straight
    FROM (
      SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id,
        {sql_pick(FAMILIES, 'l_partkey % 3')} AS family,
        CASE WHEN l_suppkey % 2 = 0 THEN 'correct' ELSE 'loose' END AS quad_mode,
        {sql_pick(CURLS, 'l_partkey % 5')} AS curl, (l_quantity - 25) / 5.0 AS truth_tilt,
        (l_quantity - 25) / 5.0 AS flat_tilt,
        CASE WHEN l_linenumber <> 4 OR l_tax <> 0.03 THEN (l_quantity - 25) / 5.0 * (l_discount * 10 - 0.4) END AS final_tilt,
        l_returnflag = 'A' AS accepted, l_returnflag = 'R' OR l_linenumber = 2 AS deskewed,
        CASE WHEN l_linenumber <> 7 THEN l_tax / 10 END AS flat_bow,
        CASE WHEN l_linenumber <> 7 THEN l_tax / 10 * (0.3 + l_discount * 10) END AS final_bow,
        l_discount / 2 AS flat_dark, l_discount / 2 + CASE WHEN l_suppkey % 5 = 0 THEN 0.05 ELSE 0 END AS final_dark,
        l_linenumber <> 6 AS clip_known, l_partkey % 13 = 0 AS clipped, l_partkey % 7 = 0 AS shrunk,
        CASE WHEN l_linenumber <> 5 THEN l_discount / 20 END AS painted_frac, l_suppkey % 17 = 0 AS seam,
        1000 AS flat_w, 1400 AS flat_h, 1000 AS final_w, 1400 + CASE WHEN l_suppkey % 10 = 3 THEN 30 ELSE 0 END AS final_h,
        {sql_pick(CODES, 'l_suppkey % 3')} AS code,
        CASE WHEN l_partkey % 97 = 0 THEN 'timeout' ELSE {sql_pick(REASONS, 'l_partkey % 5')} END AS reason,
        {sql_pick(BUCKETS, 'l_suppkey % 6')} AS bucket, l_linenumber % 2 = 0 AS planned, l_linenumber % 3 = 0 AS failed,
        l_partkey % 2 = 0 AS level_evidence, l_suppkey % 4 <> 0 AS level_flat,
        (l_quantity - 25) / 5.0 + l_tax * 5 AS deskew_deg, l_quantity * 100 AS gate_ms,
        3000 + l_extendedprice / 20 AS deskew_ms, l_quantity * 100 + 3000 + l_extendedprice / 20 AS stage_ms,
        l_partkey % 101 = 0 AS error
      FROM lineitem)
    """,
)

_MEASURED = "flat_tilt IS NOT NULL AND final_tilt IS NOT NULL"
_BOW = "flat_bow IS NOT NULL AND final_bow IS NOT NULL"
view(
    "fx_verdicts",
    f"""
    SELECT *, CASE WHEN NOT acted THEN CASE WHEN should_act THEN 'noop' ELSE 'left-alone' END
                   WHEN harm THEN 'harm' WHEN unverified THEN 'unverified' WHEN NOT should_act THEN 'acted-ok'
                   WHEN tilt_ok AND curl_ok THEN 'complete' ELSE 'partial' END AS cls
    FROM (SELECT *, harms <> '' AS harm, acted AND harms = '' AND gaps <> '' AS unverified FROM (
      SELECT *, CASE WHEN acted THEN concat_ws(', ',
          CASE WHEN {_MEASURED} AND abs(final_tilt) > abs(flat_tilt) + CAST(0.3 AS DOUBLE) THEN 'tilt' END,
          CASE WHEN accepted AND {_BOW} AND final_bow > flat_bow + greatest(CAST(0.0015 AS DOUBLE), CAST(0.25 AS DOUBLE)
            * flat_bow) THEN 'bow' END,
          CASE WHEN clip_known AND clipped THEN 'clipped' END,
          CASE WHEN wedge AND (abs(truth_tilt) < 0.5 OR (clip_known AND shrunk)) THEN 'background framed in' END,
          CASE WHEN abs((final_w / final_h) / (flat_w / flat_h) - 1) > 0.01 THEN 'stretched' END) ELSE '' END AS harms,
        CASE WHEN acted THEN concat_ws(', ', CASE WHEN NOT ({_MEASURED}) THEN 'tilt unmeasured' END,
          CASE WHEN (accepted OR bent) AND NOT ({_BOW}) THEN 'bow unmeasured' END,
          CASE WHEN NOT clip_known THEN 'clipping unmeasured' END) ELSE '' END AS gaps,
        abs(truth_tilt) < 0.5 OR coalesce(abs(page_tilt) <= CAST(0.35 AS DOUBLE), false) AS tilt_ok,
        NOT bent OR coalesce(page_bow <= CAST(0.6 AS DOUBLE) * flat_bow, false) AS curl_ok,
        abs(page_tilt) AS residual_tilt, page_bow AS residual_bow,
        coalesce(painted_frac > CAST(0.002 AS DOUBLE), false) AS painted, acted AND painted_frac IS NULL AS paint_unmeasured
      FROM (SELECT *, acted AND final_dark > flat_dark + CAST(0.03 AS DOUBLE) AS wedge FROM fx_straighten WHERE NOT error)))
    """,
)


def records(t: Tables) -> DataFrame:
    c = F.col
    line, part, supp = c("l_linenumber"), c("l_partkey"), c("l_suppkey")
    tilt = (c("l_quantity") - 25) / 5.0
    curl = pick(CURLS, (part % 5).cast("int"))
    bent = ~curl.isin("none", "unknown")
    return t.lineitem.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"),
        pick(FAMILIES, (part % 3).cast("int")).alias("family"),
        F.when(supp % 2 == 0, "correct").otherwise("loose").alias("quad_mode"),
        curl.alias("curl"),
        tilt.alias("truth_tilt"),
        tilt.alias("flat_tilt"),
        F.when((line != 4) | (c("l_tax") != 0.03), tilt * (c("l_discount") * 10 - 0.4)).alias("final_tilt"),
        (c("l_returnflag") == "A").alias("accepted"),
        ((c("l_returnflag") == "R") | (line == 2)).alias("deskewed"),
        F.when(line != 7, c("l_tax") / 10).alias("flat_bow"),
        F.when(line != 7, c("l_tax") / 10 * (0.3 + c("l_discount") * 10)).alias("final_bow"),
        (c("l_discount") / 2).alias("flat_dark"),
        (c("l_discount") / 2 + F.when(supp % 5 == 0, 0.05).otherwise(0.0)).alias("final_dark"),
        (line != 6).alias("clip_known"),
        (part % 13 == 0).alias("clipped"),
        (part % 7 == 0).alias("shrunk"),
        F.when(line != 5, c("l_discount") / 20).alias("painted_frac"),
        (supp % 17 == 0).alias("seam"),
        F.lit(1000).alias("flat_w"),
        F.lit(1400).alias("flat_h"),
        F.lit(1000).alias("final_w"),
        (F.lit(1400) + F.when(supp % 10 == 3, 30).otherwise(0)).alias("final_h"),
        pick(CODES, (supp % 3).cast("int")).alias("code"),
        F.when(part % 97 == 0, "timeout").otherwise(pick(REASONS, (part % 5).cast("int"))).alias("reason"),
        pick(BUCKETS, (supp % 6).cast("int")).alias("bucket"),
        (line % 2 == 0).alias("planned"),
        (line % 3 == 0).alias("failed"),
        (part % 2 == 0).alias("level_evidence"),
        (supp % 4 != 0).alias("level_flat"),
        (tilt + c("l_tax") * 5).alias("deskew_deg"),
        (c("l_quantity") * 100).alias("gate_ms"),
        (3000 + c("l_extendedprice") / 20).alias("deskew_ms"),
        (c("l_quantity") * 100 + 3000 + c("l_extendedprice") / 20).alias("stage_ms"),
        (part % 101 == 0).alias("error"),
        ((F.abs(tilt) >= 0.5) | bent).alias("should_act"),
        (~((F.abs(tilt) >= 0.5) | (curl != "none"))).alias("flat_and_straight"),
    )


@query(
    "straighten_verdict",
    """
    SELECT id, cls, acted, harms AS harm_why, CASE WHEN unverified THEN gaps ELSE '' END AS unverified_why, tilt_ok,
           curl_ok, round(residual_tilt, 6) AS residual_tilt, round(residual_bow, 6) AS residual_bow, wedge AS dark_wedge
    FROM fx_verdicts
    """,
)
def straighten_verdict(t: Tables) -> DataFrame:
    c = F.col
    return rounded(
        st.verdicts(records(t)).select(
            "id",
            "cls",
            "acted",
            F.concat_ws(", ", "harm_why").alias("harm_why"),
            F.when(c("unverified"), F.concat_ws(", ", "gap_why")).otherwise("").alias("unverified_why"),
            "tilt_ok",
            "curl_ok",
            "residual_tilt",
            "residual_bow",
            "dark_wedge",
        )
    )


_TILT_ONLY = "should_act AND abs(truth_tilt) >= 0.5 AND NOT bent"
_CURLED = "should_act AND bent"


def _n(condition: str) -> str:
    return f"count(*) FILTER ({condition})"


def _q(v: str, p: float, where: str) -> str:
    return f"round(quantile_cont({v}, {p}) FILTER ({where}), 6)"


@query(
    "straighten_summary",
    f"""
    SELECT s.grp, s.ok_n + coalesce(x.errors, 0) AS scenes, coalesce(x.errors, 0) AS errors, s.* EXCLUDE (grp, ok_n) FROM (
      SELECT grp, count(*) AS ok_n, {_n('should_act')} AS should_act_n, {_n('acted')} AS acted_n,
        {_n('accepted')} AS accepted_n, {_n('deskewed')} AS deskewed_n, {_n("should_act AND cls = 'noop'")} AS noop,
        {_n("should_act AND cls = 'partial'")} AS partial, {_n("should_act AND cls = 'complete'")} AS complete,
        {_n("should_act AND cls = 'harm'")} AS harm_n, {_n("should_act AND cls = 'unverified'")} AS unverified_n,
        {_n('harm')} AS harm_count, {_n('NOT should_act AND harm')} AS flat_harms, {_n('NOT should_act')} AS nothing_to_do,
        {_n('NOT should_act AND acted')} AS nothing_to_do_acted, {_n('unverified')} AS unverified_count,
        {_n('flat_and_straight')} AS flat_and_straight_n, {_n('flat_and_straight AND NOT harm')} AS true_noop,
        {_n(_TILT_ONLY)} AS tilt_cases, {_n(_TILT_ONLY + " AND cls = 'complete'")} AS tilt_complete,
        {_n(_CURLED)} AS curl_cases, {_n(_CURLED + " AND cls = 'complete'")} AS curl_complete,
        {_n('should_act AND residual_tilt IS NULL')} AS resid_tilt_unmeasured, {_n('wedge')} AS dark_wedges,
        {_n('painted')} AS painted_pages, {_n('seam')} AS seam_count, {_n('paint_unmeasured')} AS paint_unmeasured_n,
        {_n("reason = 'timeout'")} AS timeouts, {_n('gate_ms + deskew_ms > 12000')} AS over_budget,
        {sql_rate(_n("should_act AND cls = 'noop'"), _n('should_act'))} AS noop_rate,
        {sql_rate(_n("should_act AND cls = 'partial'"), _n('should_act'))} AS partial_rate,
        {sql_rate(_n("should_act AND cls = 'complete'"), _n('should_act'))} AS complete_rate,
        {sql_rate(_n("should_act AND cls = 'harm'"), _n('should_act'))} AS harm_rate,
        {sql_rate(_n("should_act AND cls = 'unverified'"), _n('should_act'))} AS unverified_rate,
        {sql_rate(_n("should_act AND cls <> 'complete'"), _n('should_act'))} AS unfixed_rate,
        {sql_rate(_n('flat_and_straight AND NOT harm'), _n('flat_and_straight'))} AS true_noop_rate,
        {sql_rate(_n(_TILT_ONLY + " AND cls = 'complete'"), _n(_TILT_ONLY))} AS tilt_complete_rate,
        {sql_rate(_n(_CURLED + " AND cls = 'complete'"), _n(_CURLED))} AS curl_complete_rate,
        {sql_rate(_n(_CURLED + " AND cls <> 'complete'"), _n(_CURLED))} AS curl_unfixed_rate,
        {_q('residual_tilt', 0.5, 'should_act')} AS resid_tilt_p50, {_q('residual_tilt', 0.9, 'should_act')} AS resid_tilt_p90,
        {_q('residual_tilt', 0.5, _TILT_ONLY)} AS tilt_only_resid_p50,
        {_q('residual_tilt', 0.9, _TILT_ONLY)} AS tilt_only_resid_p90,
        {_q('residual_bow', 0.5, _CURLED)} AS curl_resid_bow_p50, {_q('stage_ms', 0.5, 'true')} AS stage_ms_p50,
        {_q('stage_ms', 0.9, 'true')} AS stage_ms_p90, {_q('deskew_ms', 0.5, 'deskewed')} AS deskew_ms_p50,
        {_q('deskew_ms', 0.9, 'deskewed')} AS deskew_ms_p90
      FROM (SELECT *, 'ALL' AS grp FROM fx_verdicts UNION ALL SELECT *, family AS grp FROM fx_verdicts UNION ALL
            SELECT *, 'tilt/correct' AS grp FROM fx_verdicts WHERE family = 'tilt' AND quad_mode = 'correct') GROUP BY grp) s
    LEFT JOIN (
      SELECT grp, count(*) AS errors FROM (
        SELECT 'ALL' AS grp FROM fx_straighten WHERE error UNION ALL SELECT family FROM fx_straighten WHERE error
        UNION ALL SELECT 'tilt/correct' FROM fx_straighten WHERE error AND family = 'tilt' AND quad_mode = 'correct')
      GROUP BY grp) x ON x.grp = s.grp
    """,
)
def straighten_summary(t: Tables) -> DataFrame:
    rows = records(t)
    return rounded(st.summarize(st.verdicts(rows), rows.where("error")))


@query(
    "per_tilt_table",
    f"""
    SELECT abs(truth_tilt) AS tilt, count(*) AS n, {_n('deskewed')} AS deskewed, {_n('accepted')} AS accepted,
           {_n("cls = 'complete'")} AS complete, {_n('harm')} AS harm, {_n('unverified')} AS unverified,
           {_n("cls IN ('noop', 'left-alone')")} AS noop, {_n('NOT deskewed')} AS abstained,
           {_q('residual_tilt', 0.5, 'true')} AS resid_p50, {_q('residual_tilt', 0.9, 'true')} AS resid_p90,
           {_q('abs(deskew_deg - truth_tilt)', 0.9, 'true')} AS est_err_p90
    FROM fx_verdicts WHERE family = 'tilt' GROUP BY abs(truth_tilt)
    """,
)
def per_tilt_table(t: Tables) -> DataFrame:
    return rounded(st.per_tilt(st.verdicts(records(t))))


@query(
    "per_tilt_abstentions",
    f"""
    SELECT abs(truth_tilt) AS tilt, reason, count(*) AS n FROM fx_verdicts WHERE family = 'tilt' AND NOT deskewed
    GROUP BY abs(truth_tilt), reason
    """,
)
def per_tilt_abstentions(t: Tables) -> DataFrame:
    rows = st.verdicts(records(t)).where("family = 'tilt' AND NOT deskewed")
    return rows.groupBy(F.abs("truth_tilt").alias("tilt"), "reason").agg(F.count("*").alias("n"))


@query(
    "outcome_histogram",
    f"""
    SELECT CASE WHEN accepted THEN 'accepted' ELSE code || ' ' || reason END AS key, count(*) AS n,
           {_n('should_act')} AS should_act, {_n('NOT should_act')} AS nothing_to_do FROM fx_verdicts GROUP BY 1
    ORDER BY n DESC, key
    """,
)
def outcome_histogram(t: Tables) -> DataFrame:
    rows = st.verdicts(records(t)).groupBy(st.outcome_key().alias("key"))
    counted = rows.agg(
        F.count("*").alias("n"),
        F.count_if("should_act").alias("should_act"),
        F.count_if(~F.col("should_act")).alias("nothing_to_do"),
    )
    return counted.orderBy(F.desc("n"), "key")


_LEVEL = "(NOT level_evidence AND level_flat)"
_FINALS = "('nothing', 'declined', 'unverified', 'page')"
_CARD = f"""CASE WHEN accepted AND planned THEN 'both' WHEN accepted THEN CASE WHEN {_LEVEL} THEN 'none' ELSE 'curl' END
      WHEN deskewed AND reason = 'curl-absent' THEN 'tilt'
      WHEN deskewed THEN CASE WHEN bucket IN {_FINALS} OR bucket = 'better-flat' THEN 'tilt-only' ELSE 'tilt-retry' END
      WHEN failed THEN 'transient' WHEN bucket IN {_FINALS} AND {_LEVEL} THEN 'nothing'
      WHEN bucket = 'better-flat' THEN 'declined' ELSE bucket END"""


@query("straighten_card", f"SELECT id, {_CARD} AS card FROM fx_straighten WHERE NOT error")
def straighten_card(t: Tables) -> DataFrame:
    return records(t).where("NOT error").select("id", st.card().alias("card"))


@query(
    "card_histogram",
    f"""
    SELECT {_CARD} AS key, count(*) AS n, {_n('NOT should_act')} AS nothing_to_do,
           {_n("should_act AND cls = 'complete'")} AS complete, {_n("should_act AND cls = 'partial'")} AS partial,
           {_n("should_act AND cls = 'noop'")} AS noop, {_n("should_act AND cls = 'harm'")} AS harm,
           {_n("should_act AND cls = 'unverified'")} AS unverified FROM fx_verdicts GROUP BY 1
    """,
)
def card_histogram(t: Tables) -> DataFrame:
    judged = st.verdicts(records(t))
    need = F.col("should_act")
    return judged.groupBy(st.card().alias("key")).agg(
        F.count("*").alias("n"),
        F.count_if(~need).alias("nothing_to_do"),
        *[
            F.count_if(need & (F.col("cls") == k)).alias(k)
            for k in ("complete", "partial", "noop", "harm", "unverified")
        ],
    )


# ── two runs of the same scenes ─────────────────────────────────────────────

CLASSES = ["complete", "partial", "noop", "harm", "unverified", "left-alone", "acted-ok"]
view(
    "fx_scenes",
    f"""
    SELECT CASE WHEN o_orderkey % 22 = 1 THEN -1 - o_orderkey // 2 ELSE o_orderkey // 2 END AS id, o_orderkey % 2 AS run, {sql_pick(CLASSES, 'CAST(floor(o_totalprice) AS INTEGER) % 7')} AS cls,
           CAST(floor(o_totalprice) AS INTEGER) % 7 NOT IN (2, 5) AS acted, o_custkey % 19 = 0 AS seam
    FROM orders
    """,
)


def scenes(t: Tables, run: int) -> DataFrame:
    slot = F.floor("o_totalprice").cast("int") % 7
    rows = t.orders.where(F.col("o_orderkey") % 2 == run)
    return rows.select(
        # Some scenes go by another name in the newer run.
        F.expr("IF(o_orderkey % 22 = 1, -1 - o_orderkey div 2, o_orderkey div 2)").alias("id"),
        pick(CLASSES, slot).alias("cls"),
        (~slot.isin(2, 5)).alias("acted"),
        (F.col("o_custkey") % 19 == 0).alias("seam"),
    )


view(
    "fx_changes",
    """
    SELECT p.id, p.cls AS before, n.cls AS now, unnest(list_filter([CASE WHEN n.id IS NULL THEN 'missing' END,
      CASE WHEN p.cls = 'complete' AND n.cls <> 'complete' THEN 'lost fix' END,
      CASE WHEN n.cls = 'harm' AND p.cls <> 'harm' THEN 'new harm' END], lambda v: v IS NOT NULL)) AS change
    FROM (SELECT * FROM fx_scenes WHERE run = 0) p LEFT JOIN (SELECT * FROM fx_scenes WHERE run = 1) n ON n.id = p.id
    """,
)


@query("scene_regressions", "SELECT id, before, now, change FROM fx_changes")
def scene_regressions(t: Tables) -> DataFrame:
    return st.scene_regressions(scenes(t, 0), scenes(t, 1))


@query(
    "scene_gate",
    """
    SELECT CASE change WHEN 'missing' THEN 'scene ' || id || ': measured before, missing now'
             WHEN 'lost fix' THEN 'scene ' || id || ': lost fix (complete to ' || now || ')'
             ELSE 'scene ' || id || ': new harm (' || before || ' to harm)' END AS line FROM fx_changes
    """,
)
def scene_gate(t: Tables) -> DataFrame:
    rows = st.scene_regressions(scenes(t, 0), scenes(t, 1))
    change = F.col("change")
    name = F.concat(F.lit("scene "), F.col("id").cast("string"))
    line = (
        F.when(change == "missing", F.concat(name, F.lit(": measured before, missing now")))
        .when(change == "lost fix", F.concat(name, F.lit(": lost fix (complete to "), F.col("now"), F.lit(")")))
        .otherwise(F.concat(name, F.lit(": new harm ("), F.col("before"), F.lit(" to harm)")))
    )
    return rows.select(line.alias("line"))


@query(
    "flagged_scenes",
    """
    SELECT * FROM (
      SELECT n.id, concat_ws(', ', CASE WHEN n.cls = 'harm' THEN 'harm' END,
               CASE WHEN n.cls = 'unverified' THEN 'unverified' END, CASE WHEN n.seam THEN 'seam' END,
               CASE WHEN n.acted AND NOT p.acted THEN 'new act' END,
               CASE WHEN p.cls = 'complete' AND n.cls <> 'complete' THEN 'lost fix' END) AS reasons
      FROM (SELECT * FROM fx_scenes WHERE run = 1) n LEFT JOIN (SELECT * FROM fx_scenes WHERE run = 0) p ON n.id = p.id)
    WHERE reasons <> ''
    """,
)
def flagged_scenes(t: Tables) -> DataFrame:
    now = scenes(t, 1).withColumn("harm", F.col("cls") == "harm").withColumn("unverified", F.col("cls") == "unverified")
    return st.flagged(now, scenes(t, 0))
