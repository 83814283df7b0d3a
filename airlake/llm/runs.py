"""Words of many texts at once, in numpy: shared by the operators on words."""

from __future__ import annotations

BREAK = b"\xff"  # in no UTF-8 text


def split_runs(data: bytes):
    """(code, piece, vocabulary) of the runs of ``data`` without blanks and
    ``BREAK``: per run an index into the vocabulary of distinct runs and the
    number of breaks before it."""
    import numpy as np
    import pyarrow as pa

    raw = np.frombuffer(data, np.uint8)
    ends = raw == BREAK[0]
    inside = ~(ends | (raw == 32))
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    starts = np.flatnonzero(first)
    offsets = np.zeros(len(starts) + 1, np.int32)
    if len(starts):
        before = np.cumsum(inside.view(np.int8), dtype=np.int32)
        offsets[:-1] = before[starts] - 1
        offsets[-1] = before[-1]
    runs = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw[inside])])
    runs = runs.dictionary_encode()
    piece = np.cumsum(ends.view(np.int8), dtype=np.int32)[starts]
    return runs.indices.to_numpy(zero_copy_only=False).astype(np.int64), piece, runs.dictionary
