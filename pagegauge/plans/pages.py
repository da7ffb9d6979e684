"""Source, label, page and document queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegauge.functions import geometry as g
from pagegauge.operators import folds
from pagegauge.operators import pages as pg
from pagegauge.operators.detection import rate, score_detections
from pagegauge.operators.percentiles import Wanted, with_percentiles
from pagegauge.plans import bindings as b
from pagegauge.plans.detection import rounded, sql_pct, sql_rate
from pagegauge.plans.registry import Tables, query, view
from pagegauge.sources import readers
from pagegauge.streaming import machines as m

e = b.e

# ── readers ──────────────────────────────────────────────────────────────────


@query(
    "read_probe_events",
    "SELECT event_type AS type, count(*) AS n, round(avg(value), 6) AS mean_ms FROM events GROUP BY event_type",
)
def read_probe_events(t: Tables) -> DataFrame:
    """The event log through its typed schema, by kind."""
    record = F.struct(
        F.col("event_type").alias("type"), F.col("user_id").alias("session_id"), "event_id", F.col("value").alias("passMs")
    )
    parsed = readers.parse_probe_events(t.events.select(F.to_json(record).alias("line")), "line")
    return rounded(parsed.groupBy("type").agg(F.count("*").alias("n"), F.avg("passMs").alias("mean_ms")))


@query(
    "read_diagnostics",
    "SELECT event_id AS seq, event_type AS type, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events WHERE event_id % 10 <> 3",
)
def read_diagnostics(t: Tables) -> DataFrame:
    """Envelopes of the known version, a late field read from the payload."""
    version = F.when(F.col("event_id") % 10 != 3, readers.DIAGNOSTICS_VERSION).otherwise(2)
    envelope = F.struct(version.alias("v"), F.col("event_id").alias("seq"), F.col("event_type").alias("type"), "props")
    parsed = t.events.select(F.from_json(F.to_json(envelope), "v int, seq bigint, type string, props string").alias("d"))
    known = parsed.select("d.*").where(F.col("v") == readers.DIAGNOSTICS_VERSION)
    late = F.variant_get(F.parse_json("props"), "$.k", "int")
    return known.select("seq", "type", late.alias("k"))


FLOW = ["step", "capture", "retake", "reorder", "dewarp", "quality", "error", "cancel", "boot"]
view(
    "fx_flow",
    f"""
    SELECT event_id, {b.sql_pick(FLOW, 'k % 9')} AS name, ['capture', 'corners', 'review', 'build', 'lobby'][k % 5 + 1] AS step,
      ['camera', 'file', 'scanner'][k % 3 + 1] AS source, CASE WHEN k % 13 <> 0 THEN k::DOUBLE END AS page,
      ['applied', 'fallback', 'declined', 'lost'][k % 4 + 1] AS outcome, ['sharp', 'blurred', 'soft'][k % 3 + 1] AS verdict,
      ['camera_denied', 'asset_load', 'odd'][k % 3 + 1] AS code, CASE WHEN k % 7 <> 0 THEN k % 2 = 0 END AS recoverable,
      ['user', 'error', 'system'][k % 3 + 1] AS reason FROM fx_samples
    """,
)


def flow(t: Tables) -> DataFrame:
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    rows = t.events.withColumn("k", k)
    k = F.col("k")
    return rows.select(
        "event_id",
        b.pick(FLOW, k % 9).alias("name"),
        b.pick(["capture", "corners", "review", "build", "lobby"], k % 5).alias("step"),
        b.pick(["camera", "file", "scanner"], k % 3).alias("source"),
        F.when(k % 13 != 0, k.cast("double")).alias("page"),
        F.when(k % 13 != 0, k.cast("double")).alias("from"),
        F.lit(1.0).alias("to"),
        b.pick(["applied", "fallback", "declined", "lost"], k % 4).alias("outcome"),
        b.pick(["sharp", "blurred", "soft"], k % 3).alias("verdict"),
        F.lit(None).cast("double").alias("rung"),
        F.lit(None).cast("double").alias("bytes"),
        k.cast("double").alias("pages"),
        F.lit(None).cast("double").alias("ms"),
        b.pick(["camera_denied", "asset_load", "odd"], k % 3).alias("code"),
        F.when(k % 7 != 0, k % 2 == 0).alias("recoverable"),
        b.pick(["user", "error", "system"], k % 3).alias("reason"),
    )


@query(
    "flow_allowlist",
    """
    SELECT event_id, name, CASE WHEN name = 'step' THEN step END AS step, CASE WHEN name = 'capture' THEN source END AS source,
      CASE WHEN name IN ('capture', 'retake', 'dewarp', 'quality') THEN page END AS page, CASE WHEN name = 'error' THEN code END AS code
    FROM fx_flow WHERE CASE name WHEN 'step' THEN step <> 'lobby' WHEN 'capture' THEN page IS NOT NULL AND source <> 'scanner'
      WHEN 'retake' THEN page IS NOT NULL WHEN 'reorder' THEN page IS NOT NULL WHEN 'dewarp' THEN page IS NOT NULL AND outcome <> 'lost'
      WHEN 'quality' THEN page IS NOT NULL AND verdict <> 'soft' WHEN 'error' THEN code <> 'odd' AND recoverable IS NOT NULL
      WHEN 'cancel' THEN reason <> 'system' ELSE false END
    """,
)
def flow_allowlist(t: Tables) -> DataFrame:
    return readers.flow_allowed(flow(t)).select("event_id", "name", "step", "source", "page", "code")


@query("read_flow_events", "SELECT name, count(*) AS n, count(page) AS with_page FROM fx_flow GROUP BY name")
def read_flow_events(t: Tables) -> DataFrame:
    from pagegauge import schemas

    parsed = flow(t).select(F.from_json(F.to_json(F.struct("*")), schemas.FLOW_EVENT).alias("f")).select("f.*")
    return parsed.groupBy("name").agg(F.count("*").alias("n"), F.count("page").alias("with_page"))


@query(
    "clean_payload",
    """
    SELECT doc_id, CASE WHEN doc_id % 9 <> 0 THEN floor(n_chars / 7.0 * 1000 + 0.5) / 1000 END AS number, substr(text, 1, 96) AS short, text, length(text) > 96 AS truncated FROM documents
    """,
)
def clean_payload(t: Tables) -> DataFrame:
    number = F.when(F.col("doc_id") % 9 == 0, F.lit(float("nan"))).otherwise(F.col("n_chars") / 7.0)
    return t.documents.select(
        "doc_id", readers.clean_number(number).alias("number"), *readers.clean_text(F.col("text"))
    )


@query(
    "read_result_rows",
    "SELECT variant, count(*) AS rows, count(*) FILTER (accepted) AS accepted FROM fx_det WHERE scene_id % 8 <> 0 GROUP BY variant",
)
def read_result_rows(t: Tables) -> DataFrame:
    rows = b.detections(t).withColumn("schema", F.when(F.col("scene_id") % 8 == 0, 1).otherwise(readers.RESULTS_SCHEMA))
    return readers.comparable_rows(rows).groupBy("variant").agg(
        F.count("*").alias("rows"), F.count_if("accepted").alias("accepted")
    )


@query(
    "discover_media",
    """
    SELECT kind, count(*) AS n FROM (SELECT CASE WHEN doc_id % 11 = 0 THEN 'skipped: screen recording' WHEN doc_id % 4 = 0 THEN 'still'
      WHEN doc_id % 4 = 1 THEN 'clip' ELSE 'skipped: not media' END AS kind FROM documents) GROUP BY kind
    """,
)
def discover_media(t: Tables) -> DataFrame:
    doc = F.col("doc_id")
    name = F.when(doc % 11 == 0, "Screen Recording ").otherwise("IMG_")
    ext = b.pick(["JPG", "mp4", "txt", "mov"], (doc % 4).cast("int"))
    path = F.concat(F.lit("set/"), name, doc.cast("string"), F.lit("."), ext)
    return t.documents.select(readers.media_kind(path).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@query(
    "read_page_records",
    "SELECT o_orderstatus AS status, count(*) AS pages, round(sum(o_totalprice), 2) AS bytes FROM orders GROUP BY o_orderstatus",
)
def read_page_records(t: Tables) -> DataFrame:
    pages = t.orders.select(F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("size"))
    return pages.groupBy("status").agg(F.count("*").alias("pages"), F.round(F.sum("size"), 2).alias("bytes"))


@query(
    "sparse_frame_sample",
    "SELECT 'clip-' || user_id || '@' || CAST(floor(event_id * 1000 / 15.0 + 0.5) AS BIGINT) || 'ms' AS frame_id FROM events WHERE event_id % 8 = 0",
)
def sparse_frame_sample(t: Tables) -> DataFrame:
    clip = F.concat(F.lit("clip-"), F.col("user_id").cast("string"))
    return readers.sparse_frames(t.events.withColumn("clip", clip), "clip", "event_id").select("frame_id")


@query(
    "write_report_tables",
    "SELECT variant, family, count(*) AS scenes FROM fx_det GROUP BY variant, family",
)
def write_report_tables(t: Tables) -> DataFrame:
    """The table a run's report is written from (the writer itself is ``sources.sinks.write_report``)."""
    return b.detections(t).groupBy("variant", "family").agg(F.count("*").alias("scenes"))


@query(
    "union_events",
    "SELECT session_id, kind, count(*) AS n FROM (SELECT session_id, kind FROM fx_log UNION ALL SELECT session_id, 'overlay' FROM fx_samples WHERE shown) GROUP BY session_id, kind",
)
def union_events(t: Tables) -> DataFrame:
    overlay = b.samples(t).where("shown").select("session_id", "event_id", "err", F.lit("overlay").alias("kind"))
    both = b.log(t).unionByName(overlay, allowMissingColumns=True)
    return both.groupBy("session_id", "kind").agg(F.count("*").alias("n"))


# ── labels ───────────────────────────────────────────────────────────────────


def label_documents(t: Tables) -> DataFrame:
    item = F.struct(
        (F.col("quality") == 0).alias("noDocument"),
        F.array(*[F.col("toxic") == 1, *[F.lit(False)] * 3]).alias("uncertain"),
        F.lit("2024-01-01").alias("t"),
    )
    document = F.struct(
        F.when(F.col("doc_id") % 20 == 0, 2).otherwise(1).alias("version"),
        F.create_map(F.col("doc_id").cast("string"), item).alias("items"),
    )
    return t.labels.select(F.to_json(document).alias("document"))


@query(
    "read_labels",
    "SELECT CAST(doc_id AS VARCHAR) AS image_id, quality = 0 AS no_document, toxic = 1 AS first_uncertain FROM labels WHERE doc_id % 20 <> 0",
)
def read_labels(t: Tables) -> DataFrame:
    items = readers.parse_labels(label_documents(t), "document")
    return items.select(
        "image_id", F.col("noDocument").alias("no_document"), F.get("uncertain", F.lit(0)).alias("first_uncertain")
    )


@query(
    "label_counts",
    "SELECT count(*) AS total, count(*) FILTER (quality = 0) AS no_document, count(*) FILTER (quality <> 0 AND toxic = 1) AS with_uncertain FROM labels WHERE doc_id % 20 <> 0",
)
def label_counts(t: Tables) -> DataFrame:
    items = readers.parse_labels(label_documents(t), "document")
    uncertain = ~F.col("noDocument") & F.exists("uncertain", lambda u: u)
    return items.agg(
        F.count("*").alias("total"),
        F.count_if("noDocument").alias("no_document"),
        F.count_if(uncertain).alias("with_uncertain"),
    )


@query(
    "validate_labels_rows",
    """
    SELECT scene_id, CASE WHEN scene_id % 6 = 0 THEN NULL WHEN scene_id % 7 = 0 THEN 'corners must be four pairs'
      WHEN list_max(list_transform(e[1:8], lambda v: abs(v * 5 + 0.5 - 0.5))) > 1.0 THEN 'corners must be normalized'
      WHEN scene_id % 5 = 0 THEN 'uncertain must be four booleans' END AS problem FROM fx_vectors
    """,
)
def validate_labels_rows(t: Tables) -> DataFrame:
    scene = F.col("scene_id")
    corners = F.array(*[F.array(e(2 * i + 1) * 5 + 0.5, e(2 * i + 2) * 5 + 0.5) for i in range(4)])
    corners = F.when(scene % 7 == 0, F.slice(corners, 1, 3)).otherwise(corners)
    uncertain = F.when(scene % 5 == 0, F.array(F.lit(True))).otherwise(F.array(*[F.lit(False)] * 4))
    return b.vectors(t).select(scene, readers.label_problem(corners, uncertain, scene % 6 == 0).alias("problem"))


@query(
    "label_join",
    """
    SELECT s.scene_id, s.variant, l.doc_id IS NOT NULL AS labelled, l.quality = 0 AS negative,
      CASE WHEN l.doc_id IS NULL THEN NULL WHEN l.quality = 0 THEN CASE WHEN s.detected THEN 'false positive' ELSE 'nothing' END
           WHEN NOT s.detected THEN 'miss' WHEN s.degenerate OR s.iou < 0.9 OR s.order_wrong OR coalesce(
             list_max(list_filter(s.errs, lambda v, i: s.seen[i] AND NOT (i = 1 AND l.toxic = 1))) > 0.03, false) THEN 'wrong' ELSE 'good' END AS verdict
    FROM (SELECT * FROM fx_score WHERE has_truth) s LEFT JOIN labels l ON l.doc_id = s.scene_id
    """,
)
def label_join(t: Tables) -> DataFrame:
    """Detections against hand labels; corners the labeller was not sure of do not judge."""
    scored = score_detections(b.detections(t)).where("has_truth")
    labels = t.labels.select(F.col("doc_id").alias("scene_id"), F.lit(True).alias("labelled"), "quality", "toxic")
    rows = scored.join(labels, "scene_id", "left")
    certain = F.array(
        *[
            F.get("corners_in_frame", F.lit(i)) & ((F.col("toxic") != 1) if i == 0 else F.lit(True))
            for i in range(4)
        ]
    )
    far = F.coalesce(g.masked_max(F.col("corner_errors"), certain) > g.WRONG_CROP_MAX_CORNER_ERROR, F.lit(False))
    wrong = F.col("degenerate") | (F.col("iou") < g.WRONG_CROP_MIN_IOU) | F.col("order_wrong") | far
    verdict = (
        F.when(F.col("labelled").isNull(), None)
        .when(F.col("quality") == 0, F.when(F.col("detected"), "false positive").otherwise("nothing"))
        .when(~F.col("detected"), "miss")
        .when(wrong, "wrong")
        .otherwise("good")
    )
    return rows.select(
        "scene_id",
        "variant",
        F.coalesce("labelled", F.lit(False)).alias("labelled"),
        (F.col("quality") == 0).alias("negative"),
        verdict.alias("verdict"),
    )


@query(
    "labelled_subset",
    "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)",
)
def labelled_subset(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "lang").join(t.labels.where("quality = 1"), "doc_id", "left_semi")


@query(
    "label_upsert",
    """
    SELECT doc_id, CASE WHEN i.doc_id IS NULL OR c.t > i.t THEN c.quality ELSE i.quality END AS quality,
      CASE WHEN i.doc_id IS NULL OR c.t > i.t THEN c.t ELSE i.t END AS t, coalesce(c.t > i.t AND (c.quality <> i.quality OR c.t <> i.t), false) AS kept_newer
    FROM (SELECT doc_id, quality, doc_id % 4 AS t FROM labels WHERE doc_id % 3 <> 0) c
    FULL JOIN (SELECT doc_id, 1 - quality AS quality, doc_id % 5 AS t FROM labels WHERE doc_id % 3 <> 1) i USING (doc_id)
    """,
)
def label_upsert(t: Tables) -> DataFrame:
    doc = F.col("doc_id")
    current = t.labels.where(doc % 3 != 0).select("doc_id", "quality", (doc % 4).alias("t"))
    incoming = t.labels.where(doc % 3 != 1).select("doc_id", (1 - F.col("quality")).alias("quality"), (doc % 5).alias("t"))
    return pg.upsert_labels(current, incoming, "doc_id")


# ── pages ────────────────────────────────────────────────────────────────────

ACTIONS = ["add", "add", "add", "rotate", "move", "retake", "remove", "add"]


_FIND = "len(list_filter(f.pages, lambda p: p.id = r.page)) > 0"
_NEXT = f"""CASE r.action
      WHEN 'add' THEN CASE WHEN {_FIND} THEN f.pages ELSE list_append(f.pages, struct_pack(id := r.page, rev := 1::BIGINT, rot := 0::BIGINT)) END
      WHEN 'remove' THEN list_filter(f.pages, lambda p: p.id <> r.page)
      WHEN 'move' THEN list_concat(list_filter(f.pages, lambda p: p.id = r.page), list_filter(f.pages, lambda p: p.id <> r.page))
      WHEN 'rotate' THEN list_transform(f.pages, lambda p: CASE WHEN p.id = r.page THEN struct_pack(id := p.id, rev := p.rev + 1, rot := (p.rot + 90) % 360) ELSE p END)
      ELSE list_transform(f.pages, lambda p: CASE WHEN p.id = r.page THEN struct_pack(id := p.id, rev := p.rev + 1, rot := 0::BIGINT) ELSE p END) END"""


@query(
    "page_state_fold",
    f"""
    WITH RECURSIVE acts AS MATERIALIZED (
      SELECT conv_id, turn, action, CASE WHEN action = 'add' THEN turn ELSE conv_id % 3 END AS page, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS nth
      FROM (SELECT *, {b.sql_pick(ACTIONS, 'turn % 8')} AS action FROM conversations)),
    f AS (
      SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS nth, CAST(NULL AS BIGINT) AS turn, CAST([] AS STRUCT(id BIGINT, rev BIGINT, rot BIGINT)[]) AS pages FROM acts
      UNION ALL SELECT r.conv_id, r.nth, r.turn, {_NEXT} FROM f JOIN acts r ON r.conv_id = f.conv_id AND r.nth = f.nth + 1)
    SELECT conv_id, turn, CAST(len(pages) AS INTEGER) AS page_count, array_to_string(list_transform(pages, lambda p: p.id || ':' || p.rev || ':' || p.rot), '|') AS pages FROM f WHERE nth > 0
    """,
)
def page_state_fold(t: Tables) -> DataFrame:
    """Pages of each document after every event, in order, with revision and rotation."""
    turn = F.col("turn")
    action = b.pick(ACTIONS, (turn % 8).cast("int"))
    page = F.when(action == "add", turn).otherwise(F.col("conv_id") % 3)
    rows = t.conversations.select(
        "conv_id", "turn", action.alias("action"), page.cast("bigint").alias("page_id"), F.lit(0).alias("to_index")
    )
    return folds.fold(rows, ["conv_id"], ["turn"], m.PAGE_FOLD, 4096).select("conv_id", "turn", "page_count", "pages")


@query(
    "pending_removal",
    """
    SELECT conv_id, turn AS event_id, turn * 2000 AS t, CASE WHEN next_turn IS NOT NULL AND next_turn * 2000 < turn * 2000 + 5000 THEN
        CASE WHEN next_role = 'undo' THEN NULL ELSE next_turn * 2000 END ELSE turn * 2000 + 5000 END AS committed_t
    FROM (SELECT *, lead(turn) OVER w AS next_turn, lead(CASE WHEN role = 'assistant' THEN 'remove' ELSE 'undo' END) OVER w AS next_role
          FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'assistant'
    """,
)
def pending_removal(t: Tables) -> DataFrame:
    action = F.when(F.col("role") == "assistant", "remove").otherwise("undo")
    events = t.conversations.select(
        "conv_id", F.col("turn").alias("event_id"), (F.col("turn") * 2000).alias("t"), action.alias("action")
    )
    return pg.commit_removals(events, ["conv_id"], 3_600_000)


@query(
    "size_ladder_first_fit",
    """
    SELECT o_orderkey, coalesce(min(rung) FILTER (bytes <= 100000), 7) AS rung, min(rung) FILTER (bytes <= 100000) IS NOT NULL AS fits,
      CASE WHEN min(rung) FILTER (bytes <= 100000) IS NULL THEN CASE WHEN any_value(n) <= 1 THEN 1 ELSE CAST(least(greatest(1,
        ceil((arg_max(bytes, rung) - 100000) / (arg_max(bytes, rung) / any_value(n)))), any_value(n) - 1) AS BIGINT) END END AS remove_pages
    FROM (SELECT o_orderkey, rung, o_totalprice * (1 - CAST(0.1 AS DOUBLE) * rung) AS bytes, 1 + o_custkey % 9 AS n FROM orders, range(0, 8) r(rung))
    GROUP BY o_orderkey
    """,
)
def size_ladder_first_fit(t: Tables) -> DataFrame:
    rungs = F.array(*[F.lit(i) for i in range(8)])
    rows = t.orders.select(
        "o_orderkey", F.explode(rungs).alias("rung"), "o_totalprice", (1 + F.col("o_custkey") % 9).alias("page_count")
    )
    measured = rows.withColumn("bytes", F.col("o_totalprice") * (1 - F.lit(0.1) * F.col("rung")))
    fit = pg.first_fit(measured, ["o_orderkey"], 100000.0)
    return fit.withColumn("rung", F.col("rung").cast("bigint"))


@query(
    "document_bytes",
    "SELECT o_custkey, CAST(floor(coalesce(sum(CAST(floor(o_totalprice) AS BIGINT)) FILTER (o_orderstatus = 'F'), 0) * CAST(1.02 AS DOUBLE) + 0.5) AS BIGINT) AS pdf_bytes FROM orders GROUP BY o_custkey",
)
def document_bytes(t: Tables) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "ready").otherwise("processing")
    return pg.document_bytes(t.orders, ["o_custkey"], status, F.floor("o_totalprice"))


@query(
    "page_limit",
    "SELECT o_custkey, o_orderkey, place, place > 20 AS over_limit FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place FROM orders)",
)
def page_limit(t: Tables) -> DataFrame:
    return pg.numbered_pages(t.orders.select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey", 1_000_000)


@query(
    "latest_by_key",
    "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events) WHERE place = 1",
)
def latest_by_key(t: Tables) -> DataFrame:
    return pg.latest(t.events, ["user_id"], ["ts", "event_id"], ["event_id", "event_type"])


@query(
    "quality_event_rollup",
    f"""
    SELECT l_orderkey, count(*) AS pages, count(*) FILTER (l_quantity > 40) AS resampled, max(l_linenumber) AS worst_rung,
      CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS embedded FROM lineitem GROUP BY l_orderkey
    """,
)
def quality_event_rollup(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_orderkey").agg(
        F.count("*").alias("pages"),
        F.count_if(F.col("l_quantity") > 40).alias("resampled"),
        F.max("l_linenumber").alias("worst_rung"),
        F.sum(F.col("l_quantity").cast("bigint")).alias("embedded"),
    )


@query(
    "confirm_outcomes",
    f"""
    SELECT l_returnflag AS trigger, count(*) AS confirms, {sql_rate("count(*) FILTER (o = 'accepted')", 'count(*)')} AS accepted_rate,
      {sql_rate("count(*) FILTER (o = 'adjusted')", 'count(*)')} AS adjusted_rate, {sql_rate("count(*) FILTER (o = 'retake')", 'count(*)')} AS retake_rate,
      {sql_rate("count(*) FILTER (o = 'whole')", 'count(*)')} AS whole_rate, round(max(l_discount), 6) AS max_move,
      round({sql_pct('l_quantity', 0.5)}, 6) AS dwell_p50, round({sql_pct('l_quantity', 0.95)}, 6) AS dwell_p95
    FROM (SELECT *, ['accepted', 'adjusted', 'retake', 'whole', 'accepted'][l_linenumber % 5 + 1] AS o FROM lineitem) GROUP BY l_returnflag
    """,
)
def confirm_outcomes(t: Tables) -> DataFrame:
    outcome = b.pick(["accepted", "adjusted", "retake", "whole", "accepted"], F.col("l_linenumber") % 5)
    rows = t.lineitem.select(F.col("l_returnflag").alias("trigger"), outcome.alias("o"), "l_discount", "l_quantity")
    n = F.count("*")
    table = rows.groupBy("trigger").agg(
        n.alias("confirms"),
        *[rate(F.count_if(F.col("o") == k), n).alias(f"{k}_rate") for k in ("accepted", "adjusted", "retake", "whole")],
        F.max("l_discount").alias("max_move"),
    )
    wanted = [Wanted("dwell_p50", "dwell", 0.5), Wanted("dwell_p95", "dwell", 0.95)]
    return rounded(with_percentiles(table, rows, ["trigger"], {"dwell": (F.col("l_quantity"), 1.0)}, wanted))


@query(
    "funnel",
    """
    SELECT count(*) AS sessions, count(*) FILTER (s1) AS capture, count(*) FILTER (s2) AS corners, count(*) FILTER (s3) AS review,
      round(count(*) FILTER (s1) / count(*), 6) AS capture_rate, round(count(*) FILTER (s2) / count(*), 6) AS corners_rate, round(count(*) FILTER (s3) / count(*), 6) AS review_rate
    FROM (SELECT session_id, bool_or(kind = 'capture') AS s1,
        bool_or(kind = 'confirm-open' AND EXISTS (SELECT 1 FROM fx_log c WHERE c.session_id = e.session_id AND c.kind = 'capture' AND c.t <= e.t)) AS s2,
        bool_or(kind = 'confirm-done' AND EXISTS (SELECT 1 FROM fx_log o JOIN fx_log c ON c.session_id = o.session_id AND c.kind = 'capture' AND c.t <= o.t
                                                  WHERE o.session_id = e.session_id AND o.kind = 'confirm-open' AND o.t <= e.t)) AS s3
      FROM fx_log e GROUP BY session_id)
    """,
)
def funnel(t: Tables) -> DataFrame:
    kind = F.col("kind")
    steps = {"capture": kind == "capture", "corners": kind == "confirm-open", "review": kind == "confirm-done"}
    return rounded(pg.funnel(b.log(t), "session_id", "t", steps, b.SLICE_MS))


@query("cancel_reasons", "SELECT reason, count(*) AS n FROM fx_flow WHERE name = 'cancel' AND reason <> 'system' GROUP BY reason")
def cancel_reasons(t: Tables) -> DataFrame:
    return readers.flow_allowed(flow(t)).where("name = 'cancel'").groupBy("reason").agg(F.count("*").alias("n"))


@query(
    "refine_outcome_rates",
    f"""
    SELECT variant, count(*) AS asked, {sql_rate('count(*) FILTER (refine_ran)', 'count(*)')} AS measured_rate,
      {sql_rate('count(*) FILTER (refine_ran AND refine_changed)', 'count(*) FILTER (refine_ran)')} AS changed_rate,
      round(avg(refine_ms) FILTER (refine_ran), 6) AS mean_ms FROM fx_det GROUP BY variant
    """,
)
def refine_outcome_rates(t: Tables) -> DataFrame:
    ran = F.col("refine_ran")
    return rounded(
        b.detections(t).groupBy("variant").agg(
            F.count("*").alias("asked"),
            rate(F.count_if(ran), F.count("*")).alias("measured_rate"),
            rate(F.count_if(ran & F.col("refine_changed")), F.count_if(ran)).alias("changed_rate"),
            F.avg(F.when(ran, F.col("refine_ms"))).alias("mean_ms"),
        )
    )


@query(
    "engine_event_histogram",
    "SELECT l_linestatus AS event, ['E1', 'E2', 'E3'][l_suppkey % 3 + 1] AS reason, count(*) AS n FROM lineitem GROUP BY 1, 2",
)
def engine_event_histogram(t: Tables) -> DataFrame:
    reason = b.pick(["E1", "E2", "E3"], (F.col("l_suppkey") % 3).cast("int"))
    return t.lineitem.groupBy(F.col("l_linestatus").alias("event"), reason.alias("reason")).agg(F.count("*").alias("n"))


@query(
    "distinct_counts",
    """
    SELECT session_id, count(*) AS pages_fired, CAST(sum(n - 1) AS BIGINT) AS repeat_fires FROM (
      SELECT session_id, k % 4 AS page, count(*) AS n FROM fx_log WHERE kind = 'capture' GROUP BY 1, 2) GROUP BY session_id
    """,
)
def distinct_counts(t: Tables) -> DataFrame:
    """Pages fired on, and shutter calls past the first on each; counted per page first, so nothing gathers."""
    per_page = b.log(t).where("kind = 'capture'").groupBy("session_id", (F.col("k") % 4).alias("page")).agg(F.count("*").alias("n"))
    return per_page.groupBy("session_id").agg(F.count("*").alias("pages_fired"), F.sum(F.col("n") - 1).alias("repeat_fires"))


@query(
    "dedupe_identity",
    """
    WITH q AS (SELECT session_id, event_id, t, k % 8 AS place, 0.1 + (k % 8) / 1e2 + value / 1e8 AS x, 0.1 + value / 2e8 AS y FROM fx_samples)
    SELECT session_id, count(*) AS readings, count(*) FILTER (fresh) AS answers FROM (
      SELECT session_id, NOT EXISTS (SELECT 1 FROM q b WHERE b.session_id = a.session_id AND b.place = a.place
          AND (b.t < a.t OR (b.t = a.t AND b.event_id < a.event_id)) AND abs(b.x - a.x) < 1e-6 AND abs(b.y - a.y) < 1e-6) AS fresh FROM q a)
    GROUP BY session_id
    """,
)
def dedupe_identity(t: Tables) -> DataFrame:
    """Readings of a page that rests in one of eight places, and the answers among them that are new: a
    reading whose corners all lie within a millionth of an earlier one's is the same answer."""
    place, value = (F.col("k") % 8) / F.lit(1e2), F.col("value")
    quad = g.polygon((0.1 + place + value / 1e8, F.lit(0.1)), (F.lit(0.9), 0.1 + value / 2e8), (F.lit(0.9), F.lit(0.9)), (F.lit(0.1), F.lit(0.9)))
    rows = b.clocked(t).select("session_id", "event_id", "t", quad.alias("quad"))
    new = pg.first_answers(rows, ["session_id"], ["t", "event_id"]).groupBy("session_id").agg(F.count("*").alias("answers"))
    return rows.groupBy("session_id").agg(F.count("*").alias("readings")).join(new, "session_id")


@query(
    "fire_set_union",
    """
    SELECT session_id, count(*) AS fires, count(*) FILTER (k % 7 = 0) AS in_tremor, count(*) FILTER (k % 11 = 0) AS in_no_fire,
      count(*) FILTER (value > 100) AS moving, count(*) FILTER (k % 7 = 0 OR k % 11 = 0 OR value > 100) AS unsafe
    FROM fx_log WHERE kind = 'capture' GROUP BY session_id
    """,
)
def fire_set_union(t: Tables) -> DataFrame:
    tremor, no_fire, moving = F.col("k") % 7 == 0, F.col("k") % 11 == 0, F.col("value") > 100
    return b.log(t).where("kind = 'capture'").groupBy("session_id").agg(
        F.count("*").alias("fires"),
        F.count_if(tremor).alias("in_tremor"),
        F.count_if(no_fire).alias("in_no_fire"),
        F.count_if(moving).alias("moving"),
        F.count_if(tremor | no_fire | moving).alias("unsafe"),
    )
