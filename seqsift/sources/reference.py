"""One track's files, opened where a task runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Vectors that are read at a time.
ROWS = 10_000


def _open(path: str):
    from pyarrow import fs

    store, where = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    return store.open_input_stream(where)


def _matrix(path: str) -> Iterator[np.ndarray]:
    """Rows of a features file, a part at a time."""
    with _open(path) as f:
        dim = int(np.frombuffer(f.read(4), np.uint32)[0])
        while raw := f.read(8 * dim * ROWS):
            yield np.frombuffer(raw, np.float64).reshape(-1, dim)


def load(features: str, power: str | None, times: str | None) -> Iterator[tuple[np.ndarray, ...]]:
    """A track's vectors, powers and times in parts. Powers and intervals must be as many as vectors."""
    loud = np.concatenate([np.zeros(0), *(x[:, 0] for x in _matrix(power))]) if power else None
    bounds = None
    if times:
        with _open(times) as f:
            bounds = np.array(f.read().split(), np.float64)
    at = 0
    for part in _matrix(features):
        n, none = len(part), np.full(len(part), np.nan)
        if (loud is not None and at + n > len(loud)) or (bounds is not None and at + n + 1 > len(bounds)):
            raise ValueError(f"a power or times file has fewer values than {features} has vectors")
        yield part, none if loud is None else loud[at : at + n], none if bounds is None else bounds[at : at + n], none if bounds is None else bounds[at + 1 : at + n + 1]
        at += n


def load_all(tracks: list[dict], has_power: bool, has_times: bool) -> Iterator[pa.RecordBatch]:
    """The rows of many tracks (track_id, key, features, power, times), about ROWS at a time."""
    held: list[tuple] = []

    def rows() -> pa.RecordBatch:
        sizes = [len(x[3]) for x in held]
        track, at, key = np.repeat([x[0] for x in held], sizes), np.concatenate([np.arange(x[2], x[2] + len(x[3])) for x in held]), pa.array([x[1] for x in held], pa.string()).take(pa.array(np.repeat(np.arange(len(held)), sizes)))
        dims = np.repeat([x[3].shape[1] for x in held], sizes)
        vec = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(dims)], pa.int32()), pa.array(np.concatenate([x[3].ravel() for x in held])))
        # What a collection has no files of is null; values that aren't numbers stay as they are.
        rest = [pa.array(np.concatenate([x[i] for x in held])) if there else pa.nulls(len(at), pa.float64()) for i, there in ((4, has_power), (5, has_times), (6, has_times))]
        return pa.RecordBatch.from_arrays([pa.array(track, pa.int32()), key, pa.array(at, pa.int32()), vec, *rest], names=["track_id", "key", "pos", "vec", "power", "t_start", "t_end"])

    n = 0
    for r in tracks:
        at = 0
        for part in load(r["features"], r["power"] if has_power else None, r["times"] if has_times else None):
            held.append((r["track_id"], r["key"], at, *part))
            at, n = at + len(part[0]), n + len(part[0])
            if n >= ROWS:
                yield rows()
                held, n = [], 0
    if held:
        yield rows()
