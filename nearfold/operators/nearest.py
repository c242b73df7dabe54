"""The k nearest rows of one matrix to each row of another, exactly, on arrays.

Rows are put into boxes of neighbours.  A box of queries meets the boxes of the other side from the nearest on, and ends when
the next one is farther than all its queries' k-th neighbours.  Within two boxes a product in single precision, of which
the largest error is known, leaves out what can't be among the nearest; what it leaves is measured as the expressions do.
"""

from __future__ import annotations

import numpy as np

from nearfold.operators.kmeans import CELLS, distances

#: Rows of a box, of the side that is searched and of the queries.
BOX, GROUP = 1024, 256
#: Values beyond these would leave the range of doubles when they are squared.
HUGE, TINY = 1e150, 1e-150
#: Twice the rounding of single precision, for each term of a sum.
ROUNDING = 1.2e-7


def boxes(x: np.ndarray, size: int) -> list[np.ndarray]:
    """Numbers of the rows in groups of at most ``size`` that lie together: halves along the side of the largest variance."""
    done, rest = [], [np.arange(len(x))] if len(x) else []
    while rest:
        rows = rest.pop()
        if len(rows) <= size:
            done.append(rows)
            continue
        part, half = x[rows], len(rows) // 2
        order = np.argpartition(part[:, part.var(axis=0).argmax()], half)
        rest += [rows[order[:half]], rows[order[half:]]]
    return done


def k_nearest(q: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of v, squared distance) of the k nearest rows of ``v``, all if there are fewer; ties to the lower row.

    What isn't a number is farther than anything.
    """
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    if not len(q) or not len(v):
        return none
    good_q, good_v = ((np.abs(x) < HUGE).all(axis=1) for x in (q, v))
    if good_v.sum() < k:
        good_q[:] = False
    found = []
    for rows, search, places in ((np.flatnonzero(good_q), _by_boxes, np.flatnonzero(good_v)), (np.flatnonzero(~good_q), _plainly, np.arange(len(v)))):
        if len(rows):
            a, b, d = search(q[rows], v if len(places) == len(v) else v[places], k)
            found.append((rows[a], places[b], d))
    return tuple(np.concatenate(x) for x in zip(*found))


def _plainly(q: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    found, step = [], max(1, CELLS // len(v))
    for at in range(0, len(q), step):
        with np.errstate(all="ignore"):
            d = distances(q[at : at + step, None, :], v[None, :, :])
        near = np.argsort(d, axis=1, kind="stable")[:, :k]
        a = np.repeat(np.arange(len(d)), near.shape[1])
        found.append((at + a, near.reshape(-1), d[a, near.reshape(-1)]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _by_boxes(q: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    held = boxes(v, BOX)
    starts = np.concatenate([[0], np.cumsum([len(b) for b in held])])
    order = np.concatenate(held)
    v = v[order]
    # Moved and scaled (by a power of two) to within -1 .. 1, where single precision says most.
    middle = (v.min(axis=0) + v.max(axis=0)) / 2
    widest = max(np.abs(v - middle).max(), np.abs(q - middle).max())
    scale = 2.0 ** -np.ceil(np.log2(widest)) if widest > TINY else 1.0
    w = (v - middle) * scale
    norm = (w * w).sum(axis=1)
    w = np.concatenate([-2 * w, norm[:, None]], axis=1).astype(np.float32)
    low, high, reach = np.minimum.reduceat(v, starts[:-1]), np.maximum.reduceat(v, starts[:-1]), np.sqrt(np.maximum.reduceat(norm, starts[:-1]))
    slack = ROUNDING * (q.shape[1] + 8)
    found = []
    for rows in boxes(q, GROUP):
        a = q[rows]
        x = (a - middle) * scale
        own = (x * x).sum(axis=1)
        length = np.sqrt(own)
        x = np.concatenate([x, np.ones((len(x), 1))], axis=1).astype(np.float32)
        d, at, worst = np.full((len(a), k), np.inf), np.full((len(a), k), len(v)), np.full(len(a), np.inf)
        bound = _apart(low, high, a.min(axis=0), a.max(axis=0))
        for box in np.argsort(bound, kind="stable").tolist():
            if bound[box] > worst.max():
                break
            near = np.flatnonzero(_apart(low[box], high[box], a, a) <= worst)
            if not len(near):
                continue
            part = slice(starts[box], starts[box + 1])
            p = x[near] @ w[part].T
            error = slack * (length[near] + reach[box]) ** 2
            limit = worst[near] * scale * scale - own[near] + error
            fresh = np.flatnonzero(np.isinf(worst[near]))
            if len(fresh) and p.shape[1] > k:
                limit[fresh] = np.partition(p[fresh], k - 1, axis=1)[:, k - 1] + 2 * error[fresh]
            r, c = np.divmod(np.flatnonzero(p <= np.nextafter(limit.astype(np.float32), np.float32(np.inf))[:, None]), p.shape[1])
            r, c = near[r], c + starts[box]
            far, place = distances(a[r], v[c]), order[c]
            keep = (far < worst[r]) | (far == worst[r]) & (place < at[r, k - 1])
            if not keep.any():
                continue
            r, far, place = r[keep], far[keep], place[keep]
            own_rows = np.unique(r)
            r, far, place = np.concatenate([r, np.repeat(own_rows, k)]), np.concatenate([far, d[own_rows].reshape(-1)]), np.concatenate([place, at[own_rows].reshape(-1)])
            sort = np.lexsort((place, far, r))
            first = sort[np.arange(len(r)) - np.searchsorted(r[sort], r[sort]) < k]
            d[own_rows], at[own_rows] = far[first].reshape(-1, k), place[first].reshape(-1, k)
            worst[own_rows] = d[own_rows, k - 1]
        r, c = np.nonzero(at < len(v))
        found.append((rows[r], at[r, c], d[r, c]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _apart(low: np.ndarray, high: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """No more than the squared distance of anything within one box and within the other, whatever is lost to rounding."""
    gap = np.maximum(np.maximum(low - most, least - high), 0)
    return (gap * gap).sum(axis=-1) * (1 - 1e-9)
