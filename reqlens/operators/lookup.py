"""Looking up values inside Arrow batches: frequent keys are in every task, the
few others come with the row that needs them (``rare``, an array of structs)."""

from __future__ import annotations

from collections.abc import Iterator

#: bytes of words looked up at a time
PART_BYTES = 1 << 22


def parts(batch) -> Iterator:
    """Slices of a batch that hold about ``PART_BYTES`` of words."""
    rows = max(1, int(PART_BYTES * batch.num_rows / max(batch.column("words").nbytes, 1)))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def whole(column):
    """A column of a table as one array."""
    import pyarrow as pa

    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def missing(partner, row, wanted, known, name: str) -> Iterator:
    """Batches ``(partner, name)`` of the wanted keys that aren't known, once per partner."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    lost = np.flatnonzero(pc.index_in(wanted, value_set=known).is_null().to_numpy(zero_copy_only=False))
    found = pa.table({"partner": partner.take(pa.array(row[lost])), name: wanted.take(pa.array(lost))})
    yield from found.group_by(["partner", name]).aggregate([]).to_batches()


def places(row, wanted, known, rare, name: str) -> tuple:
    """Where each wanted key is among the known ones followed by those of ``rare``,
    flattened; and these."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    at = pc.fill_null(pc.index_in(wanted, value_set=known), -1).to_numpy().copy()
    lost = np.flatnonzero(at < 0)
    if not len(lost):
        return at, None
    own = rare.flatten()
    rows = np.repeat(np.arange(len(rare)), pc.fill_null(pc.list_value_length(rare), 0).to_numpy())

    def numbered(r, keys):
        return pc.binary_join_element_wise(pa.array(r).cast(pa.string()), keys, " ")
    at[lost] = len(known) + pc.index_in(numbered(row[lost], wanted.take(pa.array(lost))), value_set=numbered(rows, own.field(name))).to_numpy()
    return at, own
