"""The hottest pixel of a decaying heat map, frame by frame, without computing the whole map.

The map is divided into cells, these into blocks of pixels. A batch of frames passes through three stages:

* Cells. Of each are kept a bound on its hottest pixel (by the greatest value that each stamp has in the cell) and
  one from below on its first pixel. The map has a pixel as hot as the highest of the latter, so only cells whose bound reaches
  it can hold the answer; of those that only equal it, none behind that pixel in row order.
* Blocks of the cells that can hold the answer in some frame of the batch, in the same way.
* Pixels of the blocks that can.

Blocks and pixels are brought up to date when they are needed, from when they were last computed or cold, with the stamps since
then: these are kept (as windows, 72 bytes each) back to the oldest such state. Their values are arrays whose last axis are the
cells or blocks, from left to right: a stamp reaches a slice of it, and numpy's innermost loops are long.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np

CELL, BLOCK = 16, 4  #: pixels on a side
FRAMES_AT_ONCE, BOXES_AT_ONCE, STAMPS_AT_ONCE, BLOCKS_AT_ONCE = 256, 512, 32, 1024
RECENT = 1  #: batches


class Stamps(NamedTuple):
    """The windows of a block's boxes within the map, ends exclusive, in order of frames."""

    frame: np.ndarray
    left: np.ndarray
    top: np.ndarray
    right: np.ndarray
    bottom: np.ndarray
    cx: np.ndarray
    cy: np.ndarray
    pad: np.ndarray
    reach: np.ndarray

    def where(self, keep: np.ndarray) -> Stamps:
        return Stamps(*(c[keep] for c in self))


def stamps(frame: np.ndarray, boxes: np.ndarray, width: int, height: int, influence: float) -> Stamps:
    x1, y1, x2, y2 = boxes.T
    side, cx, cy = np.maximum(x2 - x1, y2 - y1), (x1 + x2) / 2, (y1 + y2) / 2
    pad = side * (influence**0.5 - 1) / 2
    reach = side / 2 + pad
    ends = [np.maximum(cx - reach, 0), np.maximum(cy - reach, 0), np.minimum(cx + reach, width), np.minimum(cy + reach, height)]
    all_ = Stamps(frame, *(np.clip(e, -1, max(width, height) + 1).astype(np.int64) for e in ends), cx, cy, pad, reach)
    return all_.where((pad > 0) & (all_.right > all_.left) & (all_.bottom > all_.top))


def _within(at: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    return (at >= first[:, None]) & (at < end[:, None])


def _bell(s: Stamps, x: np.ndarray, y: np.ndarray, rate: int) -> tuple[np.ndarray, np.ndarray]:
    """A Gaussian of ``rate`` around the center: one factor along each axis, for every stamp and coordinate."""
    spread = (2 * (s.pad / 3.5) ** 2)[:, None]

    def along(at: np.ndarray, center: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        v = at - center[:, None]
        v *= v
        v /= -spread
        np.exp(v, out=v)
        v *= _within(at, first, end)
        return v

    across = along(x, s.cx, s.left, s.right)
    across *= rate
    return across, along(y, s.cy, s.top, s.bottom)


def _bell_heat(across: np.ndarray, down: np.ndarray, rate: int) -> np.ndarray:
    return (down * across).astype(np.int32)


def _disc(s: Stamps, x: np.ndarray, y: np.ndarray, rate: int) -> tuple[np.ndarray, np.ndarray]:
    """``rate`` within a circle around the middle of the window: what the squared distance along each axis leaves of the
    squared radius, less than nothing outside of the window."""
    nothing = -(1 << 40)
    far = lambda at, first, end: (at - first[:, None] - (end - first)[:, None] // 2) ** 2
    across = np.where(_within(x, s.left, s.right), -far(x, s.left, s.right), nothing)
    down = np.where(_within(y, s.top, s.bottom), (s.reach.astype(np.int64) ** 2)[:, None] - far(y, s.top, s.bottom), nothing)
    return across, down


def _disc_heat(across: np.ndarray, down: np.ndarray, rate: int) -> np.ndarray:
    return (across + down >= 0) * np.int32(rate)


def _disc_middle(s: Stamps) -> tuple[np.ndarray, np.ndarray]:
    return s.left + (s.right - s.left) // 2, s.top + (s.bottom - s.top) // 2


#: By name: the values along the axes, the heat of a pixel from both (it never falls as either value rises), and the middle,
#: away from which both values fall within the window.
STAMPS = {"bell": (_bell, _bell_heat, lambda s: (s.cx, s.cy)), "disc": (_disc, _disc_heat, _disc_middle)}
SLACK = 1 + 1e-12  #: more than the errors of exp, which may rise by them where its argument falls


def extremes(s: Stamps, x: np.ndarray, y: np.ndarray, size: int, rate: int, stamp: str) -> list[np.ndarray]:
    """A bound on the values along each axis of the ``size`` coordinates from each of ``x`` and ``y`` on, and the value of the
    first of them: arrays of (stamp, bound or first, coordinate)."""
    axes, _, middle = STAMPS[stamp]

    def nearest(at: np.ndarray, mid: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        low, high = np.maximum(at, first[:, None]), np.minimum(at + size, end[:, None]) - 1
        return np.where(low <= high, np.minimum(np.maximum(np.rint(mid).astype(np.int64)[:, None], low), high), -1)

    mx, my = middle(s)
    most = axes(s, nearest(x, mx, s.left, s.right), nearest(y, my, s.top, s.bottom), rate)
    return [np.stack([m * SLACK if m.dtype == float else m, f], axis=1) for m, f in zip(most, axes(s, x, y, rate))]


def decay(levels: int, rate: int, attack: int) -> np.ndarray:
    """What is left of each value a frame later."""
    value = np.arange(levels)
    return np.clip(value - value**attack / (levels - 1) ** attack * rate, 0, levels - 1).astype(np.int64)


def hottest(width: int, height: int, influence: float, levels: int, rate: int, attack: int, stamp: str) -> Callable[[], Callable]:
    """A step for ``tracking.fold``: rows of (frame, x, y, value)."""
    axes, heat_of, _ = STAMPS[stamp]
    own = decay(levels, rate, attack)
    # of 1, 2, 4, ... frames; bounds from above are values + levels, those from below values + 2 * levels, and their decay
    # never falls as the value rises (that of values may, by one near the top)
    powers = [np.concatenate([own, levels + np.maximum.accumulate(own), 2 * levels + np.minimum.accumulate(own[::-1])[::-1]]).astype(np.int32)]
    while not np.array_equal(twice := powers[-1][powers[-1]], powers[-1]):
        powers.append(twice)
    bottom, top = (np.array(v, np.int32)[:, None, None] for v in ([levels, 2 * levels], [2 * levels - 1, 3 * levels - 1]))  # of both bounds
    rows, cols = -(-height // CELL), -(-width // CELL)
    parts = CELL // BLOCK
    cell_x, cell_y = np.arange(cols) * CELL, np.arange(rows) * CELL

    def faded(v: np.ndarray, frames: int) -> np.ndarray:
        if frames >> len(powers):
            return powers[-1].take(v, mode="clip")
        for k, power in enumerate(powers):
            if frames >> k & 1:
                v = power.take(v, mode="clip")
        return v

    def slices(s: Stamps) -> Iterator[Stamps]:
        for begin in range(0, len(s.frame), STAMPS_AT_ONCE):
            yield s.where(slice(begin, begin + STAMPS_AT_ONCE))

    def in_cells(s: Stamps) -> tuple[list[int], ...]:
        """Left, top, right, bottom of each window in cells."""
        return tuple(e.tolist() for e in (s.left // CELL, s.top // CELL, -(-s.right // CELL), -(-s.bottom // CELL)))

    def on_map(s: Stamps) -> Iterator[tuple]:
        """(frame, window in cells, heat at most and in the first pixel of each) of each stamp."""
        for part in slices(s):
            across, down = extremes(part, cell_x, cell_y, CELL, rate, stamp)
            for i, (frame, l, t, r, b) in enumerate(zip(part.frame.tolist(), *in_cells(part))):
                yield frame, (l, t, r, b), heat_of(across[i, :, None, l:r], down[i, :, t:b, None], rate)

    def corner(units: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """x and y of the first pixel of cells or blocks."""
        cell, at = (units, 0) if size == CELL else np.divmod(units, parts * parts)
        return cell % cols * CELL + at % parts * BLOCK, cell // cols * CELL + at // parts * BLOCK

    def from_left(units: np.ndarray, size: int) -> np.ndarray:
        return units[np.argsort(corner(units, size)[0], kind="stable")]

    def on_units(s: Stamps, units: np.ndarray, size: int) -> Iterator[tuple]:
        """(frame, slice of ``units``, heat) of each stamp that touches one of them: of a cell's blocks the bounds, of a block
        the pixels. ``units`` are in order from the left."""
        x, y = corner(units, size)
        begin, end = np.searchsorted(x, s.left - size, side="right"), np.searchsorted(x, s.right)
        touched = (begin < end) & (s.top < y.max() + size) & (s.bottom > y.min())
        s, spans = s.where(touched), [np.s_[a:b] for a, b in zip(begin[touched].tolist(), end[touched].tolist())]
        if not spans:
            return
        (xs, of_x), (ys, of_y) = (np.unique(k, return_inverse=True) for k in (x, y))
        inner = np.arange(0, size, BLOCK if size == CELL else 1)[:, None]
        xs, ys = ((inner + k).ravel() for k in (xs, ys))
        for n, part in enumerate(slices(s)):
            across, down = extremes(part, xs, ys, BLOCK, rate, stamp) if size == CELL else axes(part, xs, ys, rate)
            across, down = (a.reshape(*a.shape[:-1], len(inner), -1) for a in (across, down))
            for i, frame in enumerate(part.frame.tolist()):
                some = spans[n * STAMPS_AT_ONCE + i]
                yield frame, some, heat_of(across[i].take(of_x[some], axis=-1, mode="clip")[..., None, :, :], down[i].take(of_y[some], axis=-1, mode="clip")[..., None, :], rate)

    def step():
        bounds = np.zeros((2, rows, cols), np.int32) + bottom  # of each cell: on its hottest pixel, and on its first from below
        upper = bounds[0].reshape(-1)
        fine = {CELL: np.zeros((rows * cols, 2, parts, parts), np.int32) + bottom, BLOCK: np.zeros((rows * cols * parts * parts, BLOCK, BLOCK), np.uint16)}
        since = {size: np.zeros(len(f), np.int64) for size, f in fine.items()}  # how many batches are in them
        ends = {CELL: top[..., None], BLOCK: levels - 1}
        computed = np.zeros(rows * cols, bool)  # since they were cold
        past: list[tuple[int, Stamps]] = []  # frames and stamps of the batches from ``oldest`` on
        waiting: list[tuple] = []
        oldest, held, point = 0, 0, (width // 2, height // 2)

        def cells_of(frames: int, s: Stamps) -> np.ndarray:
            """Cells that can hold the hottest pixel in some frame of the batch; ``bounds`` go on."""
            wanted, warm = np.zeros((rows, cols), bool), bounds[0] > levels
            for l, t, r, b in zip(*in_cells(s)):
                warm[t:b, l:r] = True
            (ys, xs), coming = (np.flatnonzero(warm.any(axis=k)) for k in (1, 0)), on_map(s)
            if not len(ys):
                return ys
            x0, y0, x1, y1 = xs[0], ys[0], xs[-1] + 1, ys[-1] + 1
            part, own = bounds[:, y0:y1, x0:x1], wanted[y0:y1, x0:x1]
            found, stamp = np.zeros(own.size, bool), next(coming, None)
            for frame in range(frames):
                part = powers[0].take(part, mode="clip")
                while stamp and stamp[0] == frame:
                    l, t, r, b = stamp[1]
                    window = part[:, t - y0 : b - y0, l - x0 : r - x0]
                    np.minimum(window + stamp[2], top, out=window)
                    stamp = next(coming, None)
                high, low = part.reshape(2, -1)
                at = int(low.argmax())
                least = low[at] - levels
                found |= high > least
                if least > levels:
                    found[: at + 1] |= high[: at + 1] == least
            bounds[:, y0:y1, x0:x1], own[:] = part, found.reshape(own.shape)
            return from_left(np.flatnonzero(wanted), CELL)

        def replayed(v: np.ndarray, start: np.ndarray, units: np.ndarray, size: int, most: np.ndarray | int) -> np.ndarray:
            """Values of ``units`` before batch ``start``, moved to the beginning of this one."""
            for batch in range(int(start.min()), oldest + len(past)):
                frames, s = past[batch - oldest]
                which = np.flatnonzero(start <= batch)
                now, done = v[..., which], 0
                for frame, some, heat in on_units(s, units[which], size):
                    if frame >= done:
                        now, done = faded(np.minimum(now, most), frame + 1 - done), frame + 1
                    now[..., some] += heat
                v[..., which] = faded(np.minimum(now, most), frames - done)
            return v

        def caught_up(units: np.ndarray, size: int) -> np.ndarray:
            """Cells' or blocks' values at the beginning of the batch. What was last computed long ago begins RECENT batches
            ago from all cold and all hot: these bound a cell's blocks as they are, and where both end alike they are a pixel's
            value whatever it was before. Blocks of which a pixel stays open begin where they were."""
            v, start = np.ascontiguousarray(np.moveaxis(fine[size][units], 0, -1), np.int32), since[size][units]
            recent = oldest + len(past) - RECENT
            late = np.flatnonzero(start < recent)
            if len(late) and size == CELL:
                v[..., late], start[late] = np.stack([top[0], bottom[1]])[..., None], recent
            elif len(late):
                both = np.zeros((2, BLOCK, BLOCK, len(late)), np.int32) + np.stack([top[0], bottom[1]])[..., None]
                both = replayed(both, np.full(len(late), recent), units[late], size, ends[CELL]) - bottom[..., None]
                same = (both[0] == both[1]).all(axis=(0, 1))
                v[..., late[same]], start[late[same]] = both[0][..., same], oldest + len(past)
            return replayed(v, start, units, size, ends[size])

        def moved(frames: int, s: Stamps, units: np.ndarray, size: int) -> Iterator[np.ndarray]:
            """The values after each frame of the batch; they go on."""
            v = caught_up(units, size)
            coming = on_units(s, units, size)
            stamp = next(coming, None)
            for frame in range(frames):
                v = powers[0].take(v, mode="clip")
                if stamp and stamp[0] == frame:
                    while stamp and stamp[0] == frame:
                        v[..., stamp[1]] += stamp[2]
                        stamp = next(coming, None)
                    np.minimum(v, ends[size], out=v)
                yield v
            fine[size][units], since[size][units] = np.moveaxis(v, -1, 0), oldest + len(past) + 1

        def blocks_of(frames: int, s: Stamps, cells: np.ndarray) -> np.ndarray:
            """Blocks of ``cells`` that can hold the hottest pixel in some frame of the batch."""
            blocks = cells * parts * parts + np.arange(parts * parts)[:, None]
            x, y = corner(blocks, BLOCK)
            place, wanted = y * (cols * CELL) + x, np.zeros(blocks.shape, bool)
            for v in moved(frames, s, cells, CELL):
                bound, first = v.reshape(2, *blocks.shape)
                least = first.max()
                wanted |= bound > least - levels
                if least > 2 * levels:
                    wanted |= (bound == least - levels) & (place <= place[first == least].min())
            return from_left(blocks[wanted], BLOCK)

        def searched(frames: int, s: Stamps, blocks: np.ndarray) -> tuple[list[int], list[int]]:
            """Value and place of the hottest pixel of ``blocks`` in each frame of the batch."""
            value, place = [0] * frames, [0] * frames
            inner = np.arange(BLOCK)
            for begin in range(0, len(blocks), BLOCKS_AT_ONCE):
                some = blocks[begin : begin + BLOCKS_AT_ONCE]
                x, y = corner(some, BLOCK)
                at = (y + inner[:, None, None]) * (cols * CELL) + x + inner[:, None]
                for frame, v in enumerate(moved(frames, s, some, BLOCK)):
                    most = int(v.max())
                    if most >= value[frame]:
                        first = int(at[v == most].min())
                        value[frame], place[frame] = most, min(first, place[frame]) if most == value[frame] else first
            return value, place

        def batch() -> list[tuple]:
            nonlocal oldest, point, held
            frames, held = len(waiting), 0
            s = stamps(np.repeat(np.arange(frames), [len(b) for _, b in waiting]), np.concatenate([b for _, b in waiting]), width, height, influence)
            cells = cells_of(frames, s)
            blocks = blocks_of(frames, s, cells) if len(cells) else cells
            out = []
            for (frame, _), value, place in zip(waiting, *searched(frames, s, blocks)):
                if value:
                    y, x = divmod(place, cols * CELL)
                    point = (x, y)
                out.append((frame, *point, value))
            waiting.clear()
            cell, at = np.divmod(blocks, parts * parts)
            fine[CELL][cell, 0, at // parts, at % parts] = fine[BLOCK][blocks].max(axis=(1, 2)) + levels
            computed[cells] = True
            upper[cells] = fine[CELL][cells, 0].max(axis=(1, 2))
            past.append((frames, s))
            cool()
            return out

        def cool() -> None:
            """Cells without heat are up to date; batches that are in all cells and blocks are forgotten."""
            nonlocal oldest
            now = oldest + len(past)
            cold = np.flatnonzero(upper == levels)
            stale = cold[computed[cold]]
            fine[CELL][stale] = bottom
            fine[BLOCK].reshape(rows * cols, parts * parts, BLOCK, BLOCK)[stale] = 0
            computed[stale] = False
            since[CELL][cold] = now
            since[BLOCK].reshape(rows * cols, parts * parts)[cold] = now
            forget = min(int(k.min()) for k in since.values()) - oldest
            del past[:forget]
            oldest += forget

        def advance(frame, boxes):
            nonlocal held
            if frame is not None:
                waiting.append((frame, boxes))
                held += len(boxes)
            return batch() if waiting and (frame is None or len(waiting) >= FRAMES_AT_ONCE or held >= BOXES_AT_ONCE) else []

        return advance

    return step
