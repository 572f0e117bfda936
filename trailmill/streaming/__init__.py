"""The record-at-a-time steps on a stream.

Conversion, null markers and the accept decision need no state, so the batch operators apply
to a streaming DataFrame as they are. Ids, site radii and the profile look at all records and
stay batch results; a radius table or lookup made by a batch run can be joined to the stream.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from trailmill.functions.casts import quoted
from trailmill.functions.times import TimeReader
from trailmill.operators.clean import accept_condition, clean
from trailmill.operators.schema import OutputColumn
from trailmill.options import PrepOptions


def accepted_stream(
    stream: DataFrame,
    columns: Sequence[OutputColumn],
    options: PrepOptions,
    times: TimeReader,
    start: int | None = None,
    end: int | None = None,
) -> DataFrame:
    """Accepted, typed records of a stream; the schema and time format come from a sample."""
    kept = [c for c in columns if c.role not in ("geometry", "encoded", "ids", "lookup")]
    accepted = stream.where(accept_condition(stream, options, times, start, end))
    return clean(accepted, kept, options, times).select(*[quoted(c.name) for c in kept])
