"""Plain-numpy control charts, used by ``spikes`` inside Arrow workers.

Everything here works on one source's readings, sorted by time, as Python
lists; no Spark object is touched, so the functions are tested on their own.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from math import inf, log

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view


@dataclass(frozen=True)
class Limits:
    """How one field is judged.

    low, high: readings outside are physically impossible.
    floor: least noise assumed of any source, in the field's unit; keeps a
        source that never moves from having a zero scale.
    resting: values at which a healthy source may stand still for ever.
    jumps: a source of this field may be one whose level always jumps; such a
        source has no course, and only the limits and freezes are judged.
    limit, relock: in place of those of ChartParams.
    """

    low: float
    high: float
    floor: float
    resting: tuple[float, ...] = ()
    jumps: bool = False
    limit: float | None = None
    relock: int | None = None


@dataclass(frozen=True)
class ChartParams:
    """lam, slope_lam, scale_lam: weights of the newest reading in mean, trend and scale.
    clip: residuals enter the updates at no more than so many scales.
    limit: a reading further than so many scales from both charts is a spike.
    relock: after so many suspects in a row that agree with each other the
        course has moved, and the chart starts again there.
    least_run: shortest run of equal readings that can count as frozen.
    gap_factor: a step of more than so many usual steps is a silence; the trend
        isn't carried through it and the source may have moved meanwhile.
    """

    lam: float = 0.5
    slope_lam: float = 0.3
    scale_lam: float = 0.05
    clip: float = 5.0
    limit: float = 10.0
    relock: int = 7
    least_run: int = 10
    gap_factor: float = 4.0


def course(t: list, v: list, noise: float, speed: float, usual: float, p: ChartParams, counted: bool = False) -> list:
    """Distance of each reading from a robust exponentially weighted course, in scales.

    The course runs in the order of the lists. The first reading, and those
    from which the course starts again, have distance inf: this direction
    can't judge them. counted: t is a running number, so that a hole in it is
    a silence of unknown length, after which the course starts again.
    """
    out = [inf] * len(v)
    if not v:
        return out
    lam, slope_lam, scale_lam, clip, limit, relock = p.lam, p.slope_lam, p.scale_lam, p.clip, p.limit, p.relock
    horizon = (1.5 if counted else p.gap_factor) * usual
    level, slope, scale, at = v[0], _trend(t[:6], v[:6]), noise, t[0]
    suspects: list[int] = []
    for i in range(1, len(v)):
        x = v[i]
        dt = abs(t[i] - at)
        at = t[i]
        # Through a silence the trend says nothing, and the source may have moved anywhere within its speed.
        if dt <= horizon:
            level += slope * dt
            unit = scale
        elif counted:
            level, suspects = x, []
            continue
        else:
            slope *= 0.5
            unit = scale + 0.5 * speed * dt
        r = x - level
        size = abs(r)
        out[i] = z = size / unit
        if z > limit:
            # Suspected: mean, trend and scale stay as they are, until enough suspects agree on another course.
            if suspects and abs(x - v[suspects[-1]]) > limit * (noise + speed * dt):
                suspects = []
            suspects.append(i)
            if len(suspects) >= relock:
                level, slope = x, _trend([t[k] for k in suspects], [v[k] for k in suspects])
                for k in suspects:  # they are a course of their own, not a few strays
                    out[k] = inf
                scale, suspects = max(scale, noise), []
            continue
        suspects = []
        most = clip * unit
        if size > most:
            r, size = (most if r > 0 else -most), most
        # After a silence the reading says nearly all about where the source is now.
        level += (1 - (1 - lam) * scale / unit) * r
        if 0 < dt <= horizon:
            slope += slope_lam * lam * r / dt
            scale += scale_lam * (1.25 * size - scale)
            if scale < noise:
                scale = noise
    return out


def _trend(t: list, v: list) -> float:
    """Median step per time of a few readings."""
    s = sorted((v[i + 1] - v[i]) / abs(t[i + 1] - t[i]) for i in range(len(v) - 1) if t[i + 1] != t[i])
    return s[len(s) // 2] if s else 0.0


#: Quantiles of a source's readings are told to one part in so many of an octave, so that they can be counted piece by piece.
BINS = 128
#: The bin of values that are 0.
ZERO = -1_000_000


def bin_of(x: np.ndarray) -> np.ndarray:
    out = np.full(len(x), ZERO, np.int64)
    there = x > 0
    out[there] = np.floor(np.log2(x[there]) * BINS).astype(np.int64)
    return out


def middle(k: int | None) -> float:
    return 0.0 if k is None or k == ZERO else 2.0 ** ((k + 0.5) / BINS)


def at_share(bins: np.ndarray, share: float) -> int | None:
    """The bin in which the value at a share of all values lies."""
    if not len(bins):
        return None
    kinds, counts = np.unique(bins, return_counts=True)
    return int(kinds[np.searchsorted(np.cumsum(counts), int(share * (len(bins) - 1)), side="right")])


#: Which shares of a source's steps, speeds and bends are its usual ones.
SHARES = {"step": 0.5, "speed": 0.9, "bend": 0.75}


def step_bins(t: np.ndarray, core: np.ndarray) -> np.ndarray:
    """Steps in time that end at a core reading."""
    dt = np.diff(t)
    return bin_of(dt[core[1:] & (dt > 0)])


def usual_step(k: int | None) -> float:
    return 1.0 if k is None else 2.0 ** ((k + 1) / BINS)


def move_bins(t: np.ndarray, v: np.ndarray, core: np.ndarray, usual: float) -> tuple[np.ndarray, np.ndarray]:
    """Speeds of the steps, and bends of two steps, that end at a core reading and aren't silences."""
    step = np.diff(t)
    near = (step > 0) & (step <= 3 * usual)
    own = near & core[1:]
    both = near[1:] & near[:-1] & core[2:]
    bend = np.abs(v[1:-1] - (v[:-2] + v[2:]) / 2)
    return bin_of(np.abs(np.diff(v))[own] / step[own]), bin_of(bend[both])


def jump_count(v: np.ndarray, core: np.ndarray, step: float) -> int:
    """How often the level moves by more than step, counted at core readings; the level is the median of five, which a spike of two doesn't move."""
    if len(v) < 10:
        return 0
    level = np.median(sliding_window_view(v, 5), axis=1)
    moved = np.abs(level[5:] - level[:-5]) > step
    return int(np.count_nonzero(moved & ~np.concatenate([[False], moved[:-1]]) & core[: len(moved)]))


def run_lengths(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal neighbours."""
    if not len(v):
        return np.zeros(0, int), np.zeros(0, int)
    start = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
    return start, np.diff(np.append(start, len(v)))


def repeat_counts(v: np.ndarray, core: np.ndarray, least_run: int) -> tuple[int, int]:
    """Repeats and readings of the short runs that start at a core reading; a freeze doesn't excuse itself."""
    start, length = run_lengths(v)
    works = (length < least_run) & core[start]
    return int((length[works] - 1).sum()), int(length[works].sum())


@dataclass(frozen=True)
class Motion:
    """What is usual for one field of one source, from counts over all its sound readings.

    They are sums, so that a source that is read in pieces has the very same
    usual motion as one that is read whole.
    """

    usual: float
    counted: bool
    noise: float
    speed: float
    jumps: bool
    longest: float


def motion(n: int, odd: int, step: int | None, speed: int | None, bend: int | None, moves: int, repeats: int, total: int, lim: Limits, p: ChartParams) -> Motion:
    """From the number of readings, that of times that aren't whole, the usual bins, and the counts of jumps and repeats.

    A level that moves at least three times, and once in sixty readings,
    always jumps. With repeats at rate q the longest run among n readings is
    near log(n) / -log(q); a frozen run has to exceed that clearly.
    """
    usual = usual_step(step)
    noise = max(lim.floor, middle(bend)) if n >= 4 else lim.floor
    fast = max(middle(speed) if n >= 4 else 0.0, lim.floor / max(usual, 1e-9))
    q = (repeats + 0.5) / (total + 2)
    longest = log(max(total, 2)) / -log(min(max(q, 0.02), 0.95))
    always = lim.jumps and n >= 15 and moves >= 3 and moves * 60 >= n
    return Motion(usual, odd == 0 and step == 0, noise, fast, always, max(p.least_run, 1.3 * longest + 2))


def least_jump(bend: int | None, n: int, lim: Limits, p: ChartParams) -> float:
    """The step from which on a move of the level is a jump."""
    return (lim.limit or p.limit) * (max(lim.floor, middle(bend)) if n >= 4 else lim.floor)


def whole_motion(t: np.ndarray, v: np.ndarray, lim: Limits, p: ChartParams) -> Motion:
    """The usual motion of a source all of whose sound readings are here."""
    core = np.ones(len(v), bool)
    step = at_share(step_bins(t, core), SHARES["step"])
    speed, bend = (at_share(b, SHARES[k]) for b, k in zip(move_bins(t, v, core, usual_step(step)), ("speed", "bend")))
    moves = jump_count(v, core, least_jump(bend, len(v), lim, p)) if lim.jumps else 0
    return motion(len(v), int(np.count_nonzero(t != np.floor(t))), step, speed, bend, moves, *repeat_counts(v, core, p.least_run), lim, p)


def spikes(t: np.ndarray, v: np.ndarray, lim: Limits, p: ChartParams, usual: Motion | None = None) -> np.ndarray:
    """Marks readings that leave the course both as seen from before and as seen from after.

    A shift of level leaves only the course from before, and the first
    reading after a silence only that from before as well; neither is marked.
    """
    m = usual or whole_motion(t, v, lim, p)
    if len(v) < 3 or m.jumps:
        return np.zeros(len(v), bool)
    p = replace(p, limit=lim.limit or p.limit, relock=lim.relock or p.relock)
    tl, vl = t.tolist(), v.tolist()
    ahead = course(tl, vl, m.noise, m.speed, m.usual, p, m.counted)
    back = course(tl[::-1], vl[::-1], m.noise, m.speed, m.usual, p, m.counted)[::-1]
    z = np.minimum(ahead, back)
    return np.isfinite(z) & (z > p.limit)


def frozen(v: np.ndarray, lim: Limits, p: ChartParams, usual: Motion | None = None) -> np.ndarray:
    """Marks the repeats of runs far longer than the source's own rate of repeats explains."""
    out = np.zeros(len(v), bool)
    start, length = run_lengths(v)
    long = length >= p.least_run
    if lim.resting:
        long &= ~np.isin(v[start], lim.resting)
    if not long.any():
        return out
    m = usual or whole_motion(np.arange(len(v), dtype=float), v, lim, p)
    for s, n in zip(start[long], length[long]):
        if n >= m.longest:
            out[s + 1 : s + n] = True
    return out


def judge(t: np.ndarray, v: np.ndarray, lim: Limits, p: ChartParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """impossible, spike, frozen for one field of one source, sorted by time; nulls (NaN) are never marked."""
    impossible = np.zeros(len(v), bool)
    spike, still = impossible.copy(), impossible.copy()
    there = ~np.isnan(v)
    with np.errstate(invalid="ignore"):
        impossible[there] = ~((v[there] >= lim.low) & (v[there] <= lim.high))
    sound = np.flatnonzero(there & ~impossible)
    if len(sound):
        m = whole_motion(t[sound], v[sound], lim, p)
        still[sound] = frozen(v[sound], lim, p, m)
        spike[sound] = spikes(t[sound], v[sound], lim, p, m)
    return impossible, spike, still
