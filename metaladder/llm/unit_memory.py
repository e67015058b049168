"""Ids of repeated text units, kept in flat arrays by a worker process."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct units remembered at most, and bytes of them; the memory is emptied beyond that.
REMEMBERED, REMEMBERED_BYTES = 1_000_000, 64 << 20


class UnitMemory:
    """Base of encoders that cut texts into independent units and encode each distinct one once."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.known = pa.array([], pa.string())
        self.pool = np.zeros(0, np.uint32)
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode_units(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, size of each unit's run) of units not seen before."""
        raise NotImplementedError

    def remember(self, units: pa.Array, ids: np.ndarray, size: np.ndarray) -> None:
        self.known = pa.concat_arrays([self.known, units])
        self.start = np.concatenate([self.start, len(self.pool) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.pool = np.concatenate([self.pool, ids.astype(np.uint32)])

    def codes(self, units: pa.Array) -> np.ndarray:
        """Places of the units in the memory; unknown ones are encoded first."""
        if len(self.known) > REMEMBERED or self.known.nbytes > REMEMBERED_BYTES:
            self.clear()
        found = pc.index_in(units, value_set=self.known)
        place = found.to_numpy(zero_copy_only=False)
        if found.null_count:
            unknown = found.is_null().to_numpy(zero_copy_only=False)
            fresh, known = units.filter(pa.array(unknown)), len(self.known)
            self.remember(fresh, *self.encode_units(fresh))
            place = np.where(unknown, 0, place).astype(np.int64)
            place[unknown] = known + np.arange(len(fresh))
        return place.astype(np.int64)
