"""Copies of byte runs in bounded memory."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes of short runs that are moved at once: index arrays take 24 bytes for each.
STEP = 1 << 18
#: Bytes from which a run is copied by itself.
LONG = 512
#: Bytes of values or messages that are encoded or decoded at once.
PIECE = 2 << 20


def copy_runs(source: np.ndarray, starts: np.ndarray | None, out: np.ndarray, places: np.ndarray | None, sizes: np.ndarray) -> None:
    """``sizes`` bytes each from ``starts`` in ``source`` to ``places`` in ``out``; None: they lie behind one another."""
    ends = np.cumsum(sizes)
    if sizes.size and int(sizes.max()) >= LONG:
        starts = ends - sizes if starts is None else starts
        places = ends - sizes if places is None else places
        big = sizes >= LONG
        for s, p, n in zip(starts[big].tolist(), places[big].tolist(), sizes[big].tolist(), strict=True):
            out[p : p + n] = source[s : s + n]
        starts, places, sizes = starts[~big], places[~big], sizes[~big]
        ends = np.cumsum(sizes)
    i = base = 0
    while i < sizes.size:
        j = max(int(np.searchsorted(ends, base + STEP, side="right")), i + 1)
        stop, some = int(ends[j - 1]), sizes[i:j]
        begin, turn = ends[i:j] - some - base, np.arange(stop - base)
        where = slice(base, stop) if places is None else np.repeat(places[i:j] - begin, some) + turn
        out[where] = source[base:stop] if starts is None else source[np.repeat(starts[i:j] - begin, some) + turn]
        i, base = j, stop


def pieces(arr: pa.Array) -> list[pa.Array]:
    """Slices of some ``PIECE`` bytes, of one row at least."""
    step = max(1, len(arr) * PIECE // max(arr.nbytes, 1))
    return [arr] if step >= len(arr) else [arr.slice(i, step) for i in range(0, len(arr), step)]
