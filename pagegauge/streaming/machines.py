"""Per-session state machines, one step per row.

A machine keeps a small JSON-able state and turns one row into new state and output values.
The batch fold and the streaming query drive the same step, so they cannot disagree.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

State = list[Any]


@dataclass(frozen=True)
class Machine:
    inputs: tuple[str, ...]
    outputs: str
    start: Callable[[], State]
    step: Callable[[State, tuple], tuple]


# ── sampling and de-duplication ──────────────────────────────────────────────

# Sampler and debounce times (ms).
SAMPLE_MIN_GAP = 450
SAMPLE_WINDOW = 1000
CANCEL_DEBOUNCE = 400


def _sample(state: State, row: tuple) -> tuple:
    (t,) = row
    last, before = state
    due = (last is None or t - last >= SAMPLE_MIN_GAP) and (before is None or t - before >= SAMPLE_WINDOW)
    if due:
        state[:] = [t, last]
    return (due,)


RATE_LIMIT = Machine(("t",), "due boolean", lambda: [None, None], _sample)


def _cancel(state: State, row: tuple) -> tuple:
    t, kind = row
    finished, last = state
    if finished or kind == "other":
        return (False,)
    if kind in ("error", "complete"):
        state[:] = [True, None]
        return (True,)
    if last is not None and t - last < CANCEL_DEBOUNCE:
        return (False,)
    state[1] = t
    return (True,)


CANCEL_GATE = Machine(("t", "action"), "passed boolean", lambda: [False, None], _cancel)


# ── smoothing ────────────────────────────────────────────────────────────────

# Smoothing of the drawn quad.
MIN_CUTOFF, BETA, DERIVATIVE_CUTOFF = 1.0, 64.0, 5.0


def _share(cutoff: float, dt: float) -> float:
    return 1 / (1 + (1 / (2 * math.pi * cutoff)) / dt)


def _smooth(state: State, row: tuple) -> tuple:
    t, aspect, *channels = row
    if state[1] is not None and abs(aspect - state[1]) > 1e-6:
        state[:] = [None, None, None, None]
    values = [v * aspect if i % 2 else v for i, v in enumerate(channels)]
    at, _, smoothed, slopes = state
    if smoothed is None:
        state[:] = [t, aspect, values, [0.0] * len(values)]
    elif t > at:
        dt = (t - at) / 1000
        share = _share(DERIVATIVE_CUTOFF, dt)
        for i, v in enumerate(values):
            raw = (v - smoothed[i]) / dt
            slopes[i] += share * (raw - slopes[i])
            smoothed[i] += _share(MIN_CUTOFF + BETA * abs(slopes[i]), dt) * (v - smoothed[i])
        state[0] = t
    return tuple(v / aspect if i % 2 else v for i, v in enumerate(state[2]))


ONE_EURO = Machine(
    ("t", "aspect", "x0", "y0", "x1", "y1", "x2", "y2", "x3", "y3"),
    ", ".join(f"s{a}{i} double" for i in range(4) for a in "xy"),
    lambda: [None, None, None, None],
    _smooth,
)

# Pass cost and the interval it asks for.
COST_SHARE, LONG_TASK_MS, DUTY, INTERVAL_LOW, INTERVAL_HIGH = 0.3, 50.0, 0.35, 120.0, 400.0


def _cost(state: State, row: tuple) -> tuple:
    cost, lane = row
    if lane != state[1]:
        state[:] = [None, lane]
    if cost is not None and math.isfinite(cost) and cost >= 0:
        charged = cost * 2 if lane == "main" and cost >= LONG_TASK_MS else cost
        state[0] = charged if state[0] is None else state[0] * (1 - COST_SHARE) + charged * COST_SHARE
    if state[0] is None:
        return (None, INTERVAL_LOW)
    return (state[0], min(INTERVAL_HIGH, max(INTERVAL_LOW, state[0] / DUTY)))


CADENCE = Machine(("pass_ms", "lane"), "cost_ms double, interval_ms double", lambda: [None, None], _cost)


# ── which of two sources is believed ────────────────────────────────────────

# Confidence under which an answer is weak, and how long ML keeps its say.
WEAK_CONFIDENCE, ML_AUTHORITY_MS = 0.5, 1500


def _arbitrate(state: State, row: tuple) -> tuple:
    t, source, confidence, captured_at = row

    def weak(c: Any) -> bool:
        return c is None or c < WEAK_CONFIDENCE

    if state[0] is None:
        accept = True
    elif source == state[0]:
        accept = captured_at > state[2]
    elif source == "ml":
        accept = weak(state[1]) or captured_at > state[2]
    else:
        fresh = t - state[2] < ML_AUTHORITY_MS
        accept = captured_at > state[2] and not (weak(confidence) and fresh)
    if accept:
        state[:] = [source, confidence, captured_at]
    return (accept, state[0])


ARBITRATE = Machine(
    ("t", "source", "confidence", "captured_at"),
    "accepted boolean, tracked string",
    lambda: [None, None, None],
    _arbitrate,
)


# ── cues ─────────────────────────────────────────────────────────────────────

# Hint and cue times (ms).
HINT_APPEAR, HINT_MIN_SHOW, HINT_MIN_GAP = 300, 1000, 1500
FRAMING_HINTS = ("move-closer", "move-back", "move-phone")
READY_AFTER, READY_EXIT = 100, 300
TICK_REARM, LOST_REARM = 2000, 1000


def _held_for(run: list, value: Any, t: Any) -> Any:
    """How long a wish has been the same; ``run`` is the wish and since when."""
    if run[1] is None or run[0] != value:
        run[:] = [value, t]
    return t - run[1]


def _debounce(state: State, row: tuple) -> tuple:
    """A wish becomes the hint when it lasts, the hint before it was seen and the last change is past.

    A framing hint that nobody wishes for any more goes at once.
    """
    t, wanted = row
    run, shown, shown_at, changed_at = state
    lasts = _held_for(run, wanted, t) >= HINT_APPEAR
    outlived = shown in FRAMING_HINTS and wanted is None
    seen = shown is None or t - shown_at >= HINT_MIN_SHOW
    rested = changed_at is None or t - changed_at >= HINT_MIN_GAP
    if wanted != shown and (outlived or (lasts and seen and rested)):
        state[1:] = [wanted, t, t]
    return (state[1],)


HINT_DEBOUNCE = Machine(("t", "wanted"), "shown_hint string", lambda: [[None, None], None, None, None], _debounce)


def _latch(state: State, row: tuple) -> tuple:
    """The first direction shows at once, another one when it lasts and the shown one was seen; none clears."""
    t, direction = row
    run, shown, shown_at = state
    lasts = _held_for(run, direction, t) >= HINT_APPEAR
    if direction is None:
        state[1:] = [None, None]
    elif shown is None or (direction != shown and lasts and t - shown_at >= HINT_MIN_SHOW):
        state[1:] = [direction, t]
    return (state[1],)


DIRECTION_LATCH = Machine(("t", "direction"), "shown_direction string", lambda: [[None, None], None, None], _latch)

#: Phase and signal to the next phase, taken once the phase has lasted so long; other signals leave it.
READY_PHASES = {
    "off": {"strict": ("arming", 0)},
    "arming": {"strict": ("on", READY_AFTER), "keep": ("off", 0), "lost": ("off", 0)},
    "on": {"keep": ("leaving", 0), "lost": ("off", 0)},
    "leaving": {"strict": ("on", 0), "keep": ("off", READY_EXIT), "lost": ("off", 0)},
}


def _ready(state: State, row: tuple) -> tuple:
    t, strict, keep = row
    phase, since = state
    signal = "strict" if strict else "keep" if keep else "lost"
    following, after = READY_PHASES[phase].get(signal, (phase, math.inf))
    if following != phase and t - (t if since is None else since) >= after:
        state[:] = [following, None if following == "off" else t]
    return (state[0] in ("on", "leaving"),)


READY_CUE = Machine(("t", "strict", "keep"), "cue boolean", lambda: ["off", None], _ready)


def _tick(state: State, row: tuple) -> tuple:
    t, ready, found = row
    armed, off_since, lost_since = state
    if ready:
        state[:] = [False, None, None]
        return (armed,)
    off_since = t if off_since is None else off_since
    lost_since = None if found else (t if lost_since is None else lost_since)
    rearm = t - off_since >= TICK_REARM or (lost_since is not None and t - lost_since >= LOST_REARM)
    state[:] = [armed or rearm, off_since, lost_since]
    return (False,)


ONCE_PER_EPISODE = Machine(("t", "ready", "found"), "tick boolean", lambda: [True, None, None], _tick)


# ── automatic capture ────────────────────────────────────────────────────────

# Automatic capture times (ms) and the move that means another page.
FIRE_MS, FIRE_FAST_MS, MIN_DWELL_MS, CONFIRM_AFTER_MS = 500, 300, 1200, 150
FRAME_AGE_MS, QUIET_MS, REARM_JUMP, REARM_GONE_MS = 250, 150, 0.08, 1000


def _far(a: list, b: list, aspect: float) -> float:
    diagonal = math.sqrt(1 + aspect * aspect)
    return max(math.sqrt((a[i] - b[i]) ** 2 + ((a[i + 1] - b[i + 1]) * aspect) ** 2) for i in (0, 2, 4, 6)) / diagonal


def _rearmed(watch: list, t: Any, page: list | None, aspect: float) -> list:
    """After a fire the trigger waits for another page: one far from the fired quad, or the fired one gone.

    Phases: ``armed`` since when, ``fired`` (its page not met since), ``seen``, ``gone`` since when.
    """
    phase, quad, since = watch
    if phase == "armed":
        return watch
    if page is not None:
        return ["armed", None, t] if _far(page, quad, aspect) > REARM_JUMP else ["seen", quad, None]
    if phase == "seen":
        return ["gone", quad, t]
    return ["armed", None, t] if phase == "gone" and t - since >= REARM_GONE_MS else watch


def _pace(pace: list, begin: Any, agree: Any) -> list:
    """A countdown turns fast when both sources agree, and slow for good when they then do not."""
    mode = pace[1] if pace[0] == begin else "open"
    if agree:
        mode = "fast" if mode == "open" else mode
    elif mode == "fast":
        mode = "slow"
    return [begin, mode]


def _auto(state: State, row: tuple) -> tuple:
    """Counts down while a page is ready; fires when the time is up and the picture is confirmed quiet."""
    t, ready_since, locked_since, confirmed_at, motion_at, agree, steady, aspect, *corners = row
    page = None if corners[0] is None else corners
    watch, (begun, mode), quiet_from = state
    state[0] = watch = _rearmed(watch, t, page, aspect)
    if watch[0] != "armed" or ready_since is None or page is None:
        state[1:] = [[begun, "slow" if mode == "slow" else "open"], None]
        return (None, False)
    begin = ready_since if watch[2] is None else max(ready_since, watch[2])
    state[1] = _pace([begun, mode], begin, agree)
    if locked_since is None:
        state[2] = None
        return (0.0, False)
    length = FIRE_FAST_MS if state[1][1] == "fast" else FIRE_MS
    dwelt = locked_since + MIN_DWELL_MS
    end = max(begin + length, dwelt)
    earliest = max(begin + min(CONFIRM_AFTER_MS, length), dwelt)
    # Confirmations count that are late enough and younger than the last motion.
    counts = [at is not None and at >= earliest and (motion_at is None or at > motion_at) for at in (quiet_from, confirmed_at)]
    quiet_from = quiet_from if counts[0] else confirmed_at if counts[1] else None
    progress = min(1.0, (t - begin) / (end - begin))
    quiet = quiet_from is not None and t - quiet_from >= QUIET_MS
    if progress >= 1 and steady and quiet and counts[1] and t - confirmed_at <= FRAME_AGE_MS:
        state[:] = [["fired", page, None], state[1], None]
        return (1.0, True)
    state[2] = quiet_from
    return (progress, False)


AUTO_CAPTURE = Machine(
    (
        "t",
        "ready_since",
        "locked_since",
        "confirmed_at",
        "motion_at",
        "agree",
        "steady",
        "aspect",
        *[f"{a}{i}" for i in range(4) for a in "xy"],
    ),
    "countdown double, fire boolean",
    lambda: [["armed", None, None], [None, "open"], None],
    _auto,
)


# ── queues, matching, pages ──────────────────────────────────────────────────


def _conflate(state: State, row: tuple) -> tuple:
    """One pending live job, newer ones replacing it; captures wait in order and go first."""
    item, action, priority = row
    live, captures = state
    if action == "push":
        if priority == "capture":
            captures.append(item)
            return (None, None)
        state[0] = item
        return (live, None)
    if captures:
        return (None, captures.pop(0))
    state[0] = None
    return (None, live)


CONFLATE = Machine(
    ("event_id", "action", "priority"), "displaced bigint, taken bigint", lambda: [None, []], _conflate
)

# How far a fire's own probe may lie from its tap (ms).
PROBE_BEFORE, PROBE_AFTER = 250, 50


def _match(state: State, row: tuple) -> tuple:
    """Each fire takes the nearest probe not taken yet; a fire is decided once its last probe can be in."""
    at, is_fire, item = row
    probes = state[0]
    if not is_fire:
        # No later fire reaches further back than this.
        probes[:] = [p for p in probes if p[0] >= at - PROBE_AFTER - PROBE_BEFORE]
        probes.append([at, item])
        return (None,)
    tap = at - PROBE_AFTER
    probes[:] = [p for p in probes if p[0] >= tap - PROBE_BEFORE]
    best = None
    for p in probes:
        if best is None or abs(tap - p[0]) < abs(tap - best[0]):
            best = p
    if best is None:
        return (None,)
    probes.remove(best)
    return (best[1],)


NEAREST_UNIQUE = Machine(("due", "is_fire", "event_id"), "probe_id bigint", lambda: [[]], _match)

def _pages(state: State, row: tuple) -> tuple:
    """Pages of a document in order, each ``[id, revision, rotation]``, however many."""
    action, page, to = row
    pages = state[0]
    at = next((i for i, p in enumerate(pages) if p[0] == page), None)
    if action == "add":
        if at is None:
            pages.append([page, 1, 0])
    elif at is not None:
        if action == "remove":
            pages.pop(at)
        elif action == "move":
            pages.insert(max(0, min(to, len(pages) - 1)), pages.pop(at))
        elif action == "rotate":
            pages[at][1] += 1
            pages[at][2] = (pages[at][2] + 90) % 360
        elif action == "retake":
            pages[at][1] += 1
            pages[at][2] = 0
    return (len(pages), "|".join(f"{p[0]}:{p[1]}:{p[2]}" for p in pages))


PAGE_FOLD = Machine(("action", "page_id", "to_index"), "page_count int, pages string", lambda: [[]], _pages)
