"""Coordinate maps of 3 x 3 nodes, worked by hand."""

from pagegauge.operators import maps as mp

SCHEMA = (
    "name string, gw int, gh int, gx array<double>, gy array<double>,"
    " crop struct<left:double,top:double,width:double,height:double>,"
    " quad array<struct<x:double,y:double>>, w double, h double, mean_move string"
)
FLAT = [-1.0, 0.0, 1.0]


def grid(left=500.0, top=500.0, change=None):
    """A flat map over 100 x 100 pixels whose page is the crop; ``change`` sets nodes by number."""
    gx, gy = [x for _ in FLAT for x in FLAT], [y for y in FLAT for _ in FLAT]
    for i, (x, y) in (change or {}).items():
        gx[i], gy[i] = x, y
    quad = [(left, top), (left + 100, top), (left + 100, top + 100), (left, top + 100)]
    return [3, 3, gx, gy, (left, top, 101.0, 101.0), quad, 2000.0, 2000.0, "clash"]


def judged(spark, cases):
    rows = [(name, *row) for name, row in cases]
    return {r["name"]: r for r in mp.map_guard(spark.createDataFrame(rows, SCHEMA), ["name"]).collect()}


def moved(by):
    return {i: (x + by, y + by) for i, (x, y) in enumerate((x, y) for y in FLAT for x in FLAT)}


def shrunk(share):
    return {i: (x * share, y * share) for i, (x, y) in enumerate((x, y) for y in FLAT for x in FLAT)}


def test_bounds_of_a_map(spark):
    short = grid()
    short[2] = short[2][:8]
    no_quad = grid()
    no_quad[5] = None
    got = judged(
        spark,
        [
            ("flat", grid()),
            ("folded", grid(change={4: (1.5, 0.0)})),
            ("hourglass", grid(change={1: (0.0, -0.6)})),
            ("small", grid(change=shrunk(0.4))),
            ("away", grid(change=moved(1.2))),
            ("over the edge", grid(left=0.0, change=moved(-0.1))),
            ("corner", grid(change={0: (-0.75, -0.75)})),
            ("missing", grid(change={4: (None, 0.0)})),
            ("endless", grid(change={4: (float("inf"), 0.0)})),
            ("short", short),
            ("no page", no_quad),
        ],
    )
    flat = got["flat"]
    assert flat["failure"] is None and flat["most_move"] == 0 and flat["edge_off"] == 0
    assert abs(flat["least_jacobian"] - 1) < 1e-12 and abs(flat["most_stretch"] - 1) < 1e-12
    # The middle node beyond the right border: its right-hand cells turn over.
    assert got["folded"]["failure"] == "jacobian" and got["folded"]["least_jacobian"] < 0
    # Corners stay, one edge's middle is 20 of 141 pixels inside.
    assert got["hourglass"]["failure"] == "boundary" and got["hourglass"]["corner_off"] == 0
    assert abs(got["hourglass"]["edge_off"] - 20 / 20000**0.5) < 1e-9
    assert got["small"]["failure"] == "scale" and abs(got["small"]["least_stretch"] - 0.4) < 1e-9
    assert got["away"]["failure"] == "displacement" and abs(got["away"]["mean_move"] - 0.6) < 1e-9
    assert got["over the edge"]["failure"] == "out-of-bounds"
    # 12.5 pixels both ways at one corner: 0.125 of the diagonal.
    assert got["corner"]["failure"] == "boundary" and abs(got["corner"]["corner_off"] - 0.125) < 1e-9
    for name in ("missing", "endless", "short", "no page"):
        assert got[name]["failure"] == "nonfinite" and got[name]["least_jacobian"] is None


def test_thin_and_repeated_and_no_maps(spark):
    column = [1, 3, [0.0] * 3, FLAT, *grid()[4:]]
    df = spark.createDataFrame([("thin", *column), ("twice", *grid()), ("twice", *grid())], SCHEMA)
    rows = mp.map_guard(df, ["name"]).collect()
    assert sorted(r["name"] for r in rows) == ["thin", "twice", "twice"]
    # A grid of one column has no width, hence no area.
    assert [r["failure"] for r in rows if r["name"] == "thin"] == ["jacobian"]
    assert mp.map_guard(df.where("false"), ["name"]).count() == 0
