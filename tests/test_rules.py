"""Hand-worked cases of the rules that are easy to get wrong."""

from pyspark.sql import functions as F

from pagegauge.functions import geometry as g
from pagegauge.operators import text as tx
from pagegauge.operators import timeline as tl
from pagegauge.operators.detection import score_detections
from pagegauge.sources import readers, sinks
from pagegauge.streaming import machines as m

QUAD = "array<struct<x:double,y:double>>"
PAGE = [(0.1, 0.1), (0.9, 0.1), (0.9, 0.9), (0.1, 0.9)]


def scored(spark, rows):
    df = spark.createDataFrame(rows, f"id string, det {QUAD}, truth {QUAD}, w double, h double")
    return {r["id"]: r for r in score_detections(df).collect()}


def test_detection_verdicts(spark):
    bow_tie = [PAGE[0], PAGE[2], PAGE[1], PAGE[3]]
    mirrored = [PAGE[0], PAGE[3], PAGE[2], PAGE[1]]
    turned = PAGE[1:] + PAGE[:1]
    off = [(-0.2, 0.1), (0.9, 0.1), (0.9, 0.9), (-0.2, 0.9)]
    rows = [
        ("exact", PAGE, PAGE),
        ("bow", bow_tie, PAGE),
        ("mirrored", mirrored, PAGE),
        ("turned", turned, PAGE),
        ("miss", None, PAGE),
        ("nothing", None, None),
        ("false", PAGE, None),
        ("cut", [(0.0, 0.1), (0.9, 0.1), (0.9, 0.9), (0.0, 0.9)], off),
    ]
    got = scored(spark, [(n, d, t, 720.0, 1280.0) for n, d, t in rows])
    assert (got["exact"]["iou"], got["exact"]["wrong"]) == (1.0, False)
    assert got["bow"]["degenerate"] and got["bow"]["wrong"] and got["bow"]["iou"] == 0
    assert got["mirrored"]["mirrored"] and got["mirrored"]["wrong"] and got["mirrored"]["max_error"] == 0
    assert got["turned"]["order_wrong"] and not got["turned"]["mirrored"]
    assert got["miss"]["miss"] and got["miss"]["wrong"] is None
    assert not got["nothing"]["false_positive"] and got["false"]["false_positive"]
    # Corners the frame cannot show are reported and not judged.
    assert got["cut"]["max_error_all"] > 0.09 and got["cut"]["max_error"] == 0 and not got["cut"]["wrong"]


def test_a_concave_crop_keeps_only_what_is_inside(spark):
    arrow = [(0.0, 0.0), (10.0, 0.0), (4.0, 4.0), (0.0, 10.0)]
    square = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]
    df = spark.createDataFrame([(arrow, square)], f"a {QUAD}, s {QUAD}")
    row = df.select(g.area_inside(F.col("s"), F.col("a")).alias("v"), g.convex(F.col("a")).alias("c")).first()
    assert abs(row["v"] - 40.0) < 1e-9 and not row["c"]


def samples(spark, times, shown=None):
    rows = [(1, i, t, True if shown is None else shown[i], 0.0, True, True, True) for i, t in enumerate(times)]
    return spark.createDataFrame(
        rows, "session_id long, event_id long, t long, shown boolean, err double, frame_known boolean, has_page boolean, judged boolean"
    )


def window(spark, start, stop):
    return spark.createDataFrame([(1, start, stop)], "session_id long, from_t long, to_t long")


def test_a_gap_of_251_ms_ends_a_hold_and_250_does_not(spark):
    assert tl.time_to_lock(samples(spark, [0, 250, 300]), window(spark, 0, 300)).first()["time_to_lock_ms"] == 0
    assert tl.time_to_lock(samples(spark, [0, 251, 300]), window(spark, 0, 300)).first()["time_to_lock_ms"] is None


def test_unobserved_time_is_not_shown_time(spark):
    row = tl.false_lock_exposure(samples(spark, [0, 1000]), window(spark, 0, 1100)).first()
    assert (row["observed_ms"], row["unobserved_ms"], row["share"]) == (350, 750, 1.0)


def test_pii_allowances(spark):
    lines = [
        (1, "write to ana@mail.org.br or b@example.com"),
        (2, "cpf 123.456.789-09 and 000.000.000-00"),
        (3, "cpf 123.456.789-09\nphone (11) 91234-5678 text-scan: allow-line"),
        (4, "ana@mail.org\ntext-scan: allow-file"),
        (5, "id 11912345678"),
    ]
    got = tx.pii_hits(spark.createDataFrame(lines, "k int, body string"), "k", "body").collect()
    assert sorted((r["k"], r["line_no"], r["pattern"]) for r in got) == [(1, 1, "e-mail"), (3, 1, "CPF")]


def test_automatic_capture_fires_once_per_page():
    state, fired = m.AUTO_CAPTURE.start(), []
    sheet = [0.1, 0.1, 0.9, 0.1, 0.9, 0.9, 0.1, 0.9]
    for t in range(0, 4000, 50):
        moved = [v + (0.3 if t >= 2500 else 0.0) for v in sheet]
        _, fire = m.AUTO_CAPTURE.step(state, (t, 0, -2000, t, None, False, True, 1.5, *moved))
        if fire:
            fired.append(t)
    # Half a second of countdown; then nothing until the page jumps, which starts another.
    assert fired == [500, 3000]


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.json").write_text('{"type":"detect","t":5,"ok":true,"odd":1}\n{"type":"hint","t":7,"key":"glare"}\n')
    events = readers.read_probe_events(spark, str(tmp_path / "log"))
    assert [(r["type"], r["t"]) for r in events.orderBy("t").collect()] == [("detect", 5.0), ("hint", 7.0)]
    out = str(tmp_path / "report")
    table = spark.createDataFrame([("F1", 3)], "family string, n int")
    sinks.write_report(table, out, "detector", "r1")
    sinks.write_report(table, out, "detector", "r2")
    sinks.write_report(table.withColumn("n", F.lit(4)), out, "detector", "r2")
    got = {r["run_id"]: r["n"] for r in sinks.read_report(spark, out, "detector").collect()}
    assert got == {"r1": 3, "r2": 4}


def test_one_hit_refuses_and_a_clean_corpus_has_a_verdict(spark):
    hits = spark.createDataFrame([(1, "CPF"), (1, "CPF"), (2, "CPF"), (2, "e-mail")], "doc_id long, pattern string")
    got = {r["pattern"]: (r["hits"], r["documents"], r["refused"]) for r in tx.pii_verdict(hits, "doc_id").collect()}
    assert got == {"CPF": (3, 2, True), "e-mail": (1, 1, True), None: (4, 2, True)}
    assert [tuple(r) for r in tx.pii_verdict(hits.limit(0), "doc_id").collect()] == [(None, 0, 0, False)]
