"""Arrow batches inside Python tasks, a bounded number of text bytes at a time.

Spark hands a task batches of up to 10,000 rows and 64 MB, whatever their texts become in Python.
Here only one slice of one text column is ever Python objects; all other columns stay Arrow's.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes that are Python objects at once; a longer single text is one slice.
SLICE_BYTES = 2 << 20


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``most`` bytes of ``text``, or one row; empty batches are skipped."""
    for batch in batches:
        lo, held = 0, 0
        for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()):
            if held and held + n > most:
                yield batch.slice(lo, i - lo)
                lo, held = i, 0
            held += n
        if batch.num_rows:
            yield batch.slice(lo)
