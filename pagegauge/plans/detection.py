"""Detection scoring and geometry queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegauge.functions import geometry as g
from pagegauge.operators import detection as d
from pagegauge.plans import bindings as b
from pagegauge.plans.registry import Tables, query, view


def r6(column):
    return F.round(column, 6)


# ── SQL building blocks of the twins ─────────────────────────────────────────


def sql_area(p: str) -> str:
    return (
        f"(CASE WHEN len({p}) >= 3 THEN list_sum(list_transform(range(1, len({p}) + 1), lambda i: "
        f"{p}[i].x * {p}[i % len({p}) + 1].y - {p}[i % len({p}) + 1].x * {p}[i].y)) / 2 ELSE 0 END)"
    )


def _sql_cut(p: str, a: str, b_: str) -> str:
    def side(q):
        return f"(({b_}.x - {a}.x) * ({q}.y - {a}.y) - ({b_}.y - {a}.y) * ({q}.x - {a}.x))"

    prev = f"{p}[CASE WHEN i = 1 THEN len({p}) ELSE i - 1 END]"
    cur = f"{p}[i]"
    den = f"(({cur}.x - {prev}.x) * ({b_}.y - {a}.y) - ({cur}.y - {prev}.y) * ({b_}.x - {a}.x))"
    along = f"((({a}.x - {prev}.x) * ({b_}.y - {a}.y) - ({a}.y - {prev}.y) * ({b_}.x - {a}.x)) / {den})"
    meet = (
        f"(CASE WHEN {den} = 0 THEN {cur} ELSE struct_pack(x := {prev}.x + {along} * ({cur}.x - {prev}.x), "
        f"y := {prev}.y + {along} * ({cur}.y - {prev}.y)) END)"
    )
    return (
        f"flatten(list_transform(range(1, len({p}) + 1), lambda i: CASE WHEN {side(cur)} >= 0 THEN "
        f"CASE WHEN {side(prev)} >= 0 THEN [{cur}] ELSE [{meet}, {cur}] END "
        f"WHEN {side(prev)} >= 0 THEN [{meet}] ELSE [] END))"
    )


def sql_clip(source: str, subject: str, clip: str, out: str, edges: int) -> str:
    """``source`` with a column ``out``: ``subject`` cut to the convex ``clip`` of at most ``edges`` sides."""
    inner = (
        f"SELECT *, CASE WHEN {sql_area(clip)} > 0 THEN {clip} ELSE list_reverse({clip}) END AS zc, "
        f"{subject} AS z0 FROM {source}"
    )
    for i in range(1, edges + 1):
        a, b_ = f"zc[{i}]", f"zc[{i} % len(zc) + 1]"
        inner = (
            f"SELECT *, CASE WHEN len(zc) >= {i} AND len(z{i - 1}) > 0 THEN {_sql_cut(f'z{i - 1}', a, b_)} "
            f"ELSE z{i - 1} END AS z{i} FROM ({inner})"
        )
    drop = ", ".join(f"z{i}" for i in range(edges))
    return f"SELECT * EXCLUDE (zc, {drop}) RENAME (z{edges} AS {out}) FROM ({inner})"


def sql_pairing(det: str, truth: str) -> str:
    """Way (0–7) of the cheapest pairing of corners, the lowest on ties."""
    costs = []
    for way in range(8):
        terms = []
        for i in range(4):
            j = g.paired_index(way, i) + 1
            dx, dy = f"({det}[{j}].x - {truth}[{i + 1}].x)", f"({det}[{j}].y - {truth}[{i + 1}].y)"
            terms.append(f"{dx} * {dx} + {dy} * {dy}")
        costs.append("(" + " + ".join(f"({t})" for t in terms) + ")")
    return f"(list_position([{', '.join(costs)}], list_min([{', '.join(costs)}])) - 1)"


def sql_paired(det: str, way: str) -> str:
    table = [[g.paired_index(w, i) + 1 for i in range(4)] for w in range(8)]
    return f"list_transform({table}[{way} + 1], lambda j: {det}[j])"


def sql_degenerate(q: str) -> str:
    def turn(a, b_, c):
        return f"sign(({b_}.x - {a}.x) * ({c}.y - {a}.y) - ({b_}.y - {a}.y) * ({c}.x - {a}.x))"

    def cross(i):
        p = [f"{q}[{(i + k) % 4 + 1}]" for k in range(4)]
        return (
            f"({turn(p[0], p[1], p[2])} * {turn(p[0], p[1], p[3])} < 0 AND "
            f"{turn(p[2], p[3], p[0])} * {turn(p[2], p[3], p[1])} < 0)"
        )

    return f"(abs({sql_area(q)}) <= 1e-9 OR {cross(0)} OR {cross(1)})"


def sql_distances(a: str, b_: str, scale: str) -> str:
    return (
        f"list_transform(range(1, 5), lambda i: sqrt(({a}[i].x - {b_}[i].x) * ({a}[i].x - {b_}[i].x) + "
        f"({a}[i].y - {b_}[i].y) * ({a}[i].y - {b_}[i].y)) / {scale})"
    )


def sql_scale(q: str, w: str = "w", h: str = "h") -> str:
    return f"list_transform({q}, lambda p: struct_pack(x := p.x * {w}, y := p.y * {h}))"


SQL_FRAME = (
    "[struct_pack(x := CAST(0 AS DOUBLE), y := CAST(0 AS DOUBLE)), struct_pack(x := w, y := CAST(0 AS DOUBLE)), "
    "struct_pack(x := w, y := h), struct_pack(x := CAST(0 AS DOUBLE), y := h)]"
)
SQL_DIAGONAL = "sqrt(w * w + h * h)"


def sql_in_frame(q: str) -> str:
    return f"list_transform({q}, lambda p: p.x >= -1e-6 AND p.y >= -1e-6 AND p.x <= 1 + 1e-6 AND p.y <= 1 + 1e-6)"


def sql_image_order(q: str) -> str:
    c = f"(CASE WHEN {sql_area(q)} >= 0 THEN {q} ELSE list_reverse({q}) END)"
    sums = f"list_transform({c}, lambda p: p.x + p.y)"
    first = f"list_position({sums}, list_min({sums}))"
    return f"list_transform(range(0, 4), lambda i: {c}[({first} - 1 + i) % 4 + 1])"


view(
    "fx_paired",
    f"""
    SELECT *, {sql_pairing('d', 'q')} AS way, {sql_pairing('d', 'io')} AS ord FROM (
      SELECT *, {sql_image_order('q')} AS io FROM (
        SELECT *, {sql_scale('det')} AS d, {sql_scale('truth')} AS q, {SQL_FRAME} AS box FROM fx_det
        WHERE det IS NOT NULL AND truth IS NOT NULL))
    """,
)
view("fx_clip_truth", sql_clip("fx_paired", "q", "box", "qi", 4))
view("fx_clip_det", sql_clip(f"(SELECT *, {sql_degenerate('d')} AS degenerate FROM fx_clip_truth)", "d", "box", "di", 4))
view("fx_clip_both", sql_clip("fx_clip_det", "di", "qi", "shared", 8))
view(
    "fx_judged",
    f"""
    SELECT scene_id, variant, degenerate, way, ord, errs, seen,
           CASE WHEN ta + da - ov > 0 THEN ov / (ta + da - ov) ELSE 0 END AS iou,
           list_max(list_filter(errs, lambda v, i: seen[i])) AS max_error,
           list_max(errs) AS max_error_all, list_avg(list_filter(errs, lambda v, i: seen[i])) AS mean_error,
           CASE WHEN ta > 0 THEN (ta - ov) / ta ELSE 1 END AS clipped_fraction,
           CASE WHEN ta > 0 THEN greatest(0, da - ov) / ta ELSE 0 END AS loose_fraction
    FROM (SELECT *, abs({sql_area('qi')}) AS ta, CASE WHEN degenerate THEN 0 ELSE abs({sql_area('di')}) END AS da,
                 CASE WHEN degenerate THEN 0 ELSE abs({sql_area('shared')}) END AS ov,
                 {sql_distances(sql_paired('d', 'way'), 'q', SQL_DIAGONAL)} AS errs, {sql_in_frame('truth')} AS seen
          FROM fx_clip_both)
    """,
)
view(
    "fx_score",
    """
    SELECT a.*, s.degenerate, s.errs, s.seen, s.iou, s.max_error, s.max_error_all, s.mean_error, s.clipped_fraction,
           s.loose_fraction, s.ord >= 4 AS mirrored, s.ord <> 0 AS order_wrong, s.clipped_fraction > 0.01 AS clipped,
           s.loose_fraction > 0.03 AS loose,
           CASE WHEN s.iou IS NOT NULL THEN s.degenerate OR s.iou < 0.9 OR coalesce(s.max_error > 0.03, false)
                OR s.ord <> 0 END AS wrong,
           a.truth IS NOT NULL AS has_truth, a.det IS NOT NULL AS detected
    FROM fx_det a LEFT JOIN fx_judged s USING (scene_id, variant)
    """,
)


def scored(t: Tables) -> DataFrame:
    return d.score_detections(b.detections(t))


@query(
    "score_detection",
    """
    SELECT scene_id, variant, has_truth, detected, degenerate, round(iou, 6) AS iou, round(max_error, 6) AS max_error,
           round(max_error_all, 6) AS max_error_all, round(mean_error, 6) AS mean_error,
           round(clipped_fraction, 6) AS clipped_fraction, round(loose_fraction, 6) AS loose_fraction, clipped, loose,
           mirrored, order_wrong, wrong, NOT has_truth AND detected AS false_positive,
           has_truth AND NOT detected AS miss FROM fx_score
    """,
)
def score_detection(t: Tables) -> DataFrame:
    return scored(t).select(
        "scene_id",
        "variant",
        "has_truth",
        "detected",
        "degenerate",
        *[
            r6(F.col(c)).alias(c)
            for c in ("iou", "max_error", "max_error_all", "mean_error", "clipped_fraction", "loose_fraction")
        ],
        "clipped",
        "loose",
        "mirrored",
        "order_wrong",
        "wrong",
        "false_positive",
        "miss",
    )


def sql_pct(v: str, p: float, where: str = "true") -> str:
    """Nearest-rank percentile of an aggregate group."""
    kept = f"{v} IS NOT NULL AND ({where})"
    return (
        f"(list_sort(list({v}) FILTER ({kept})))"
        f"[CAST(greatest(1, ceil(CAST({p} AS DOUBLE) * count(*) FILTER ({kept}))) AS BIGINT)]"
    )


def sql_rate(part: str, whole: str) -> str:
    return f"round(CASE WHEN {whole} > 0 THEN ({part}) / CAST({whole} AS DOUBLE) END, 6)"


def rounded(df: DataFrame) -> DataFrame:
    """Doubles at six places, as the twins give them."""
    return df.select(*[r6(F.col(n)).alias(n) if kind == "double" else F.col(n) for n, kind in df.dtypes])


# ── content ──────────────────────────────────────────────────────────────────

view(
    "fx_boxes_cut",
    sql_clip(
        f"(SELECT d.scene_id, d.variant, c.box, c.kind, d.d, d.box AS frame_box, {sql_scale('c.polygon')} AS bp "
        "FROM fx_paired d JOIN fx_content c USING (scene_id) WHERE c.kind IN ('text', 'identifier', 'mark'))",
        "bp",
        "frame_box",
        "bi",
        4,
    ),
)


def _sql_tri(i: int, j: int, k: int) -> str:
    return f"[d[{i}], d[{j}], d[{k}]]"


def _sql_convex(q: str) -> str:
    def cross(i):
        a, b_, c = (f"{q}[{(i + k) % 4 + 1}]" for k in range(3))
        v = f"(({b_}.x - {a}.x) * ({c}.y - {b_}.y) - ({b_}.y - {a}.y) * ({c}.x - {b_}.x))"
        return f"(CASE WHEN abs({v}) < 1e-12 THEN 0 ELSE sign({v}) END)"

    signs = ", ".join(cross(i) for i in range(4))
    return f"NOT (least({signs}) < 0 AND greatest({signs}) > 0)"


def _sql_side(i: int, j: int, k: int) -> str:
    a, b_, c = f"d[{i}]", f"d[{j}]", f"d[{k}]"
    return f"sign(({b_}.x - {a}.x) * ({c}.y - {a}.y) - ({b_}.y - {a}.y) * ({c}.x - {a}.x))"


view(
    "fx_box_pieces",
    f"""
    SELECT *, {_sql_convex('d')} AS whole,
           CASE WHEN {_sql_convex('d')} THEN d WHEN {_sql_side(1, 2, 3)} = {_sql_side(1, 3, 4)}
                THEN {_sql_tri(1, 2, 3)} ELSE {_sql_tri(2, 3, 4)} END AS piece_a,
           CASE WHEN {_sql_side(1, 2, 3)} = {_sql_side(1, 3, 4)}
                THEN {_sql_tri(1, 3, 4)} ELSE {_sql_tri(2, 4, 1)} END AS piece_b
    FROM fx_boxes_cut
    """,
)
view("fx_box_a", sql_clip("fx_box_pieces", "bi", "piece_a", "kept_a", 4))
view("fx_box_b", sql_clip("fx_box_a", "bi", "piece_b", "kept_b", 3))
view(
    "fx_lost",
    f"""
    SELECT scene_id, variant, box, kind, greatest(0, least(1, (ba - ka - kb) / ba)) AS lost FROM (
      SELECT *, abs({sql_area('bi')}) AS ba, abs({sql_area('kept_a')}) AS ka,
             CASE WHEN whole THEN 0 ELSE abs({sql_area('kept_b')}) END AS kb FROM fx_box_b)
    WHERE ba > 0
    """,
)
view(
    "fx_full",
    """
    SELECT *, CASE WHEN content_clipped IS NOT NULL THEN clipped AND NOT content_clipped END AS margin_clipped,
           CASE WHEN wrong OR coalesce(content_clipped, false) THEN true
                WHEN content_clipped IS NOT NULL THEN false END AS severe
    FROM (
      SELECT s.*, CASE WHEN judged_here THEN coalesce(c.cut, false) END AS content_clipped,
             CASE WHEN judged_here THEN coalesce(c.idcut, false) END AS identifier_clipped,
             CASE WHEN judged_here THEN coalesce(c.n, 0) END AS boxes_judged,
             CASE WHEN judged_here THEN coalesce(c.ncut, 0) END AS boxes_clipped,
             CASE WHEN judged_here THEN c.max_lost END AS max_lost
      FROM (SELECT *, scene_id % 7 <> 0 AND wrong IS NOT NULL AND NOT degenerate AS judged_here FROM fx_score) s
      LEFT JOIN (SELECT scene_id, variant, bool_or(lost > 0.01) AS cut,
                        bool_or(lost > 0.01 AND kind = 'identifier') AS idcut, count(*) AS n,
                        count(*) FILTER (lost > 0.01) AS ncut, max(lost) AS max_lost
                 FROM fx_lost GROUP BY scene_id, variant) c USING (scene_id, variant))
    """,
)


def losses(t: Tables) -> DataFrame:
    answers = b.detections(t).where(F.col("truth").isNotNull()).select("scene_id", "variant", "det", "w", "h")
    return d.content_loss(answers, b.content(t), ["scene_id"])


def full(t: Tables) -> DataFrame:
    by = ["scene_id", "variant"]
    return d.with_content(scored(t), losses(t), b.content(t), by, ["scene_id"])


@query(
    "content_box_join",
    """
    SELECT scene_id, variant, kind, count(*) AS boxes, count(*) FILTER (lost > 0.01) AS clipped,
           round(max(lost), 6) AS max_lost FROM fx_lost GROUP BY scene_id, variant, kind
    """,
)
def content_box_join(t: Tables) -> DataFrame:
    table = losses(t).groupBy("scene_id", "variant", "kind").agg(
        F.count("*").alias("boxes"),
        F.count_if(F.col("lost") > g.CONTENT_CLIP_MIN_FRACTION).alias("clipped"),
        F.max("lost").alias("max_lost"),
    )
    return rounded(table)


@query(
    "content_verdict",
    """
    SELECT scene_id, variant, content_clipped, identifier_clipped, margin_clipped, severe,
           CAST(boxes_judged AS BIGINT) AS boxes_judged, CAST(boxes_clipped AS BIGINT) AS boxes_clipped,
           round(max_lost, 6) AS max_lost FROM fx_full
    """,
)
def content_verdict(t: Tables) -> DataFrame:
    return rounded(
        full(t).select(
            "scene_id",
            "variant",
            "content_clipped",
            "identifier_clipped",
            "margin_clipped",
            "severe",
            "boxes_judged",
            "boxes_clipped",
            "max_lost",
        )
    )


def _sql_summary(source: str, keys: str) -> str:
    acc = "has_truth AND detected"
    n_acc, n_pos = f"count(*) FILTER ({acc})", "count(*) FILTER (has_truth)"
    n_neg = "count(*) FILTER (NOT has_truth)"
    n_wrong = "count(*) FILTER (wrong)"
    n_judged = "count(*) FILTER (content_clipped IS NOT NULL)"
    return f"""
    SELECT {keys}, count(*) AS scenes, {n_pos} AS positives, {n_neg} AS negatives,
      {sql_rate('count(*) FILTER (ok)', 'count(*)')} AS answered_rate, {sql_rate(n_acc, n_pos)} AS accepted_rate,
      {n_acc} - {n_wrong} AS good, {n_wrong} AS wrong, {n_pos} - {n_acc} AS miss,
      {sql_rate(f'{n_acc} - {n_wrong}', n_pos)} AS good_rate, {sql_rate(n_wrong, n_pos)} AS wrong_rate,
      {sql_rate(f'{n_pos} - {n_acc}', n_pos)} AS miss_rate,
      {sql_rate('count(*) FILTER (clipped)', n_acc)} AS clipped_rate,
      {sql_rate('count(*) FILTER (loose)', n_acc)} AS loose_rate, count(*) FILTER (order_wrong) AS order_wrong,
      {n_judged} AS content_judged,
      count(*) FILTER ({acc} AND NOT degenerate AND content_clipped IS NULL) AS content_unknown,
      count(*) FILTER (content_clipped) AS content_clipped,
      {sql_rate('count(*) FILTER (content_clipped)', n_judged)} AS content_clipped_rate,
      {sql_rate('count(*) FILTER (identifier_clipped)', n_judged)} AS identifier_clipped_rate,
      {sql_rate('count(*) FILTER (margin_clipped)', n_judged)} AS margin_clipped_rate,
      count(*) FILTER (severe) AS severe,
      CASE WHEN count(*) FILTER ({acc} AND severe IS NULL) = 0 THEN {sql_rate('count(*) FILTER (severe)', n_pos)} END
        AS severe_rate,
      round(avg(mean_error), 6) AS mean_corner_error,
      count(*) FILTER (NOT has_truth AND detected) AS false_positives,
      {sql_rate('count(*) FILTER (NOT has_truth AND detected)', n_neg)} AS false_positive_rate,
      count(*) FILTER (accepted AND source = 'ml') AS from_ml,
      count(*) FILTER (accepted AND source = 'classical') AS from_classical,
      count(*) FILTER (refine_ran) AS refine_runs, count(*) FILTER (refine_ran AND refine_changed) AS refine_changed,
      round({sql_pct('iou', 0.5)}, 6) AS iou_p50, round({sql_pct('max_error', 0.5)}, 6) AS corner_error_p50,
      round({sql_pct('max_error', 0.95)}, 6) AS corner_error_p95, round({sql_pct('ms', 0.5)}, 6) AS ms_p50,
      round({sql_pct('ms', 0.95)}, 6) AS ms_p95, round({sql_pct('refine_ms', 0.5, 'refine_ran')}, 6) AS refine_ms_p50,
      round({sql_pct('refine_ms', 0.95, 'refine_ran')}, 6) AS refine_ms_p95
    FROM {source} GROUP BY {keys}"""


GROUPED = (
    "(SELECT *, unnest(['ALL', family, family || '/' || setting]) AS grp FROM fx_full)"
)


@query("detection_summary", _sql_summary("fx_full", "family, variant"))
def detection_summary(t: Tables) -> DataFrame:
    table = d.summarize_detections(full(t), F.array("family"))
    return rounded(table.withColumnRenamed("grp", "family"))


@query("detection_rollup", _sql_summary(GROUPED, "grp, variant"))
def detection_rollup(t: Tables) -> DataFrame:
    return rounded(d.summarize_detections(full(t), d.group_names()))


@query(
    "refine_summary",
    f"""
    SELECT variant, count(*) AS refine_runs, count(*) FILTER (refine_changed) AS refine_changed,
           round({sql_pct('refine_ms', 0.5)}, 6) AS ms_p50, round({sql_pct('refine_ms', 0.95)}, 6) AS ms_p95,
           CAST(sum(len(list_filter(sides, lambda s: s > 0.1))) AS BIGINT) AS sides_wide,
           CAST(sum(len(list_filter(sides, lambda s: s <= 0.1 AND s > -0.1))) AS BIGINT) AS sides_local,
           CAST(sum(len(list_filter(sides, lambda s: s <= -0.1))) AS BIGINT) AS sides_kept,
           count(*) FILTER (len(list_filter(seen, lambda s: NOT s)) > 0) AS off_image
    FROM (SELECT *, e[37:40] AS sides, {sql_in_frame('quad')} AS seen FROM fx_det) WHERE refine_ran GROUP BY variant
    """,
)
def refine_summary(t: Tables) -> DataFrame:
    ran = b.detections(t).where("refine_ran")
    sides = F.slice("e", 37, 4)

    def counted(test):
        return F.sum(F.size(F.filter(sides, test))).cast("bigint")

    table = ran.groupBy("variant").agg(
        F.count("*").alias("refine_runs"),
        F.count_if("refine_changed").alias("refine_changed"),
        counted(lambda s: s > 0.1).alias("sides_wide"),
        counted(lambda s: (s <= 0.1) & (s > -0.1)).alias("sides_local"),
        counted(lambda s: s <= -0.1).alias("sides_kept"),
        F.count_if(g.off_image(F.col("quad"))).alias("off_image"),
    )
    return rounded(
        d.with_percentiles(
            table,
            ran,
            ["variant"],
            {"ms": (F.col("refine_ms"), 0.1)},
            [d.Wanted("ms_p50", "ms", 0.5), d.Wanted("ms_p95", "ms", 0.95)],
        )
    )


@query(
    "gtfree_summary",
    f"""
    SELECT variant, count(*) AS images, {sql_rate('count(*) FILTER (ok)', 'count(*)')} AS answered_rate,
           {sql_rate('count(*) FILTER (accepted)', 'count(*)')} AS detection_rate,
           {sql_rate('count(*) FILTER (NOT accepted)', 'count(*)')} AS undetected_rate,
           round({sql_pct('coverage', 0.5)}, 6) AS coverage_p50, round({sql_pct('ms', 0.5)}, 6) AS ms_p50,
           round({sql_pct('ms', 0.95)}, 6) AS ms_p95
    FROM (SELECT *, CASE WHEN accepted THEN abs({sql_area('quad')}) END AS coverage FROM fx_det) GROUP BY variant
    """,
)
def gtfree_summary(t: Tables) -> DataFrame:
    rows = b.detections(t).withColumn("coverage", F.when(F.col("accepted"), g.quad_area(F.col("quad"))))
    n = F.count("*")
    table = rows.groupBy("variant").agg(
        n.alias("images"),
        d.rate(F.count_if("ok"), n).alias("answered_rate"),
        d.rate(F.count_if("accepted"), n).alias("detection_rate"),
        d.rate(n - F.count_if("accepted"), n).alias("undetected_rate"),
    )
    return rounded(
        d.with_percentiles(
            table,
            rows,
            ["variant"],
            {"coverage": (F.col("coverage"), 1e-3), "ms": (F.col("ms"), 0.5)},
            [
                d.Wanted("coverage_p50", "coverage", 0.5),
                d.Wanted("ms_p50", "ms", 0.5),
                d.Wanted("ms_p95", "ms", 0.95),
            ],
        )
    )


view(
    "fx_moves",
    f"""
    SELECT scene_id, w, h, list_max({sql_distances(sql_scale('a'), sql_scale('q'), SQL_DIAGONAL)}) AS move, refine_ms,
           len(list_filter({sql_in_frame('q')}, lambda s: NOT s)) > 0 AS off
    FROM (SELECT r.scene_id, r.w, r.h, r.quad AS q, p.quad AS a, r.refine_ms FROM fx_det r
          JOIN fx_det p ON p.scene_id = r.scene_id AND p.variant = 'production'
          WHERE r.variant = 'refined' AND r.refine_ran)
    """,
)


def moves(t: Tables) -> DataFrame:
    rows = b.detections(t)
    before = rows.where("variant = 'production'").select("scene_id", F.col("quad").alias("before"))
    after = rows.where("variant = 'refined' AND refine_ran").select("scene_id", "w", "h", "quad", "refine_ms")
    w, h = F.col("w"), F.col("h")
    pairs = after.join(before, "scene_id")
    move = F.array_max(g.distances(g.scaled(F.col("quad"), w, h), g.scaled(F.col("before"), w, h), g.diagonal(w, h)))
    return pairs.withColumn("move", move)


@query(
    "refine_move_summary",
    f"""
    SELECT 'refined' AS variant, count(*) AS refined, count(*) FILTER (move > 1e-4) AS moved,
           round({sql_pct('move', 0.5)}, 6) AS move_p50, round({sql_pct('move', 0.95)}, 6) AS move_p95,
           round(max(move), 6) AS move_max, count(*) FILTER (move > 0.03) AS flagged,
           count(*) FILTER (off) AS off_image, round({sql_pct('refine_ms', 0.5)}, 6) AS refine_ms_p50,
           round({sql_pct('refine_ms', 0.95)}, 6) AS refine_ms_p95 FROM fx_moves
    """,
)
def refine_move_summary(t: Tables) -> DataFrame:
    ran = moves(t).withColumn("variant", F.lit("refined"))
    table = ran.groupBy("variant").agg(
        F.count("*").alias("refined"),
        F.count_if(F.col("move") > 1e-4).alias("moved"),
        F.max("move").alias("move_max"),
        F.count_if(F.col("move") > 0.03).alias("flagged"),
        F.count_if(g.off_image(F.col("quad"))).alias("off_image"),
    )
    return rounded(
        d.with_percentiles(
            table,
            ran,
            ["variant"],
            {"move": (F.col("move"), 1e-4), "ms": (F.col("refine_ms"), 0.1)},
            [
                d.Wanted("move_p50", "move", 0.5),
                d.Wanted("move_p95", "move", 0.95),
                d.Wanted("refine_ms_p50", "ms", 0.5),
                d.Wanted("refine_ms_p95", "ms", 0.95),
            ],
        )
    )


@query("refine_flagged", "SELECT scene_id, round(move, 6) AS move FROM fx_moves WHERE move > 0.03")
def refine_flagged(t: Tables) -> DataFrame:
    """The images whose refinement moved a corner far enough to audit."""
    return rounded(moves(t).where(F.col("move") > 0.03).select("scene_id", "move"))


@query(
    "variant_flips",
    """
    SELECT b.scene_id, CASE WHEN b.good THEN 'good to wrong' ELSE 'wrong to good' END AS flip
    FROM (SELECT scene_id, has_truth AND detected AND NOT coalesce(wrong, false) AS good FROM fx_score
          WHERE variant = 'production' AND has_truth) b
    JOIN (SELECT scene_id, has_truth AND detected AND NOT coalesce(wrong, false) AS good FROM fx_score
          WHERE variant = 'refined') o USING (scene_id) WHERE b.good <> o.good
    """,
)
def variant_flips(t: Tables) -> DataFrame:
    return d.variant_flips(scored(t), "production", "refined")


view(
    "fx_pair_distance",
    f"""
    SELECT *, list_max({sql_distances(sql_paired('pa', 'way'), 'pb', SQL_DIAGONAL)}) AS dist FROM (
      SELECT *, {sql_pairing('pa', 'pb')} AS way FROM (
        SELECT a.scene_id, a.w, a.h, a.det AS da, b.det AS db, {sql_scale('a.det', 'a.w', 'a.h')} AS pa,
               {sql_scale('b.det', 'b.w', 'b.h')} AS pb
        FROM (SELECT * FROM fx_det WHERE variant = 'production') a
        FULL JOIN (SELECT * FROM fx_det WHERE variant = 'refined') b USING (scene_id)))
    """,
)


@query(
    "detector_disagreement",
    f"""
    SELECT 'production/refined' AS pair, count(*) AS images, count(dist) AS comparable,
           count(*) FILTER (dist > 0.05) AS disagree, {sql_rate('count(*) FILTER (dist > 0.05)', 'count(dist)')} AS rate,
           count(*) FILTER (da IS NOT NULL AND db IS NULL) AS only_a,
           count(*) FILTER (db IS NOT NULL AND da IS NULL) AS only_b,
           round({sql_pct('dist', 0.5)}, 6) AS distance_p50, round({sql_pct('dist', 0.95)}, 6) AS distance_p95
    FROM fx_pair_distance
    """,
)
def detector_disagreement(t: Tables) -> DataFrame:
    rows = b.detections(t)
    a = rows.where("variant = 'production'").select("scene_id", "w", "h", F.col("det").alias("a"))
    o = rows.where("variant = 'refined'").select("scene_id", F.col("det").alias("b"))
    pairs = a.join(o, "scene_id", "full").withColumn("pair", F.lit("production/refined"))
    pairs = d.with_quad_distance(pairs, "dist", "a", "b", F.col("w"), F.col("h"))
    apart = F.count_if(F.col("dist") > 0.05)
    table = pairs.groupBy("pair").agg(
        F.count("*").alias("images"),
        F.count("dist").alias("comparable"),
        apart.alias("disagree"),
        d.rate(apart, F.count("dist")).alias("rate"),
        F.count_if(F.col("a").isNotNull() & F.col("b").isNull()).alias("only_a"),
        F.count_if(F.col("b").isNotNull() & F.col("a").isNull()).alias("only_b"),
    )
    return rounded(
        d.with_percentiles(
            table,
            pairs,
            ["pair"],
            {"dist": (F.col("dist"), 1e-4)},
            [d.Wanted("distance_p50", "dist", 0.5), d.Wanted("distance_p95", "dist", 0.95)],
        )
    )


@query(
    "pivot_by_image",
    f"""
    SELECT scene_id, bool_or(accepted) FILTER (variant = 'production') AS production_accepted,
           bool_or(accepted) FILTER (variant = 'refined') AS refined_accepted,
           round(max(cov) FILTER (variant = 'production'), 6) AS production_coverage,
           round(max(cov) FILTER (variant = 'refined'), 6) AS refined_coverage,
           coalesce(max(cov) FILTER (variant = 'production' AND accepted)
             > max(cov) FILTER (variant = 'refined' AND accepted), false) AS production_wider
    FROM (SELECT *, abs({sql_area('quad')}) AS cov FROM fx_det) GROUP BY scene_id
    """,
)
def pivot_by_image(t: Tables) -> DataFrame:
    rows = b.detections(t).withColumn("coverage", g.quad_area(F.col("quad")))
    wide = (
        rows.groupBy("scene_id")
        .pivot("variant", ["production", "refined"])
        .agg(
            F.bool_or("accepted").alias("accepted"),
            F.max("coverage").alias("coverage"),
            F.max(F.when(F.col("accepted"), F.col("coverage"))).alias("taken"),
        )
    )
    wider = F.coalesce(F.col("production_taken") > F.col("refined_taken"), F.lit(False))
    return rounded(wide.withColumn("production_wider", wider).drop("production_taken", "refined_taken"))


@query(
    "worst_wrong_crops",
    """
    SELECT family, scene_id, variant, round(iou, 6) AS iou, place FROM (
      SELECT *, row_number() OVER (PARTITION BY family ORDER BY round(iou, 9), scene_id, variant) AS place
      FROM fx_score WHERE wrong)
    WHERE place <= 8
    """,
)
def worst_wrong_crops(t: Tables) -> DataFrame:
    wrong = scored(t).where("wrong")
    worst = d.worst_rows(wrong, ["family"], [F.round("iou", 9), F.col("scene_id"), F.col("variant")], 8)
    return rounded(worst.select("family", "scene_id", "variant", "iou", F.col("place").cast("bigint").alias("place")))


@query(
    "worst_content_clipped",
    """
    SELECT scene_id, variant, round(max_lost, 6) AS max_lost FROM fx_full WHERE content_clipped
    ORDER BY round(max_lost, 9) DESC, scene_id, variant LIMIT 8
    """,
)
def worst_content_clipped(t: Tables) -> DataFrame:
    cut = full(t).where("content_clipped").orderBy(F.round("max_lost", 9).desc(), "scene_id", "variant").limit(8)
    return rounded(cut.select("scene_id", "variant", "max_lost"))


@query(
    "evidence_family_table",
    """
    SELECT family, count(*) FILTER (has_truth AND NOT wrong) AS pages,
           count(*) FILTER (has_truth AND NOT wrong AND paper) AS pages_as_paper,
           count(*) FILTER (NOT has_truth) AS pageless, count(*) FILTER (NOT has_truth AND paper) AS pageless_passed
    FROM (SELECT *, e[59] > -0.08 AS paper FROM fx_score WHERE variant = 'production' AND accepted) GROUP BY family
    """,
)
def evidence_family_table(t: Tables) -> DataFrame:
    rows = scored(t).where("variant = 'production' AND accepted").withColumn("paper", b.e(59) > -0.08)
    page = F.col("has_truth") & ~F.coalesce(F.col("wrong"), F.lit(False))
    return rows.groupBy("family").agg(
        F.count_if(page).alias("pages"),
        F.count_if(page & F.col("paper")).alias("pages_as_paper"),
        F.count_if(~F.col("has_truth")).alias("pageless"),
        F.count_if(~F.col("has_truth") & F.col("paper")).alias("pageless_passed"),
    )
