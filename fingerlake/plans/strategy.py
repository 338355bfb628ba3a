"""Which plan a similarity join takes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rows that a block has at least, if there are more than one, and at most; blocks of a side that keep a cluster busy.
LEAST, MOST, SPREAD = 1024, 32768, 8


def blocks(n: Column, block: int | None = None, spread: int = SPREAD) -> Column:
    """Into how many blocks ``n`` rows are hashed, 1 at least.

    Each row is sent once for each block of the other side, so blocks are few: as many as
    keep the cluster busy, and more only where they would have over ``MOST`` rows. With
    ``block`` they have about that many rows.
    """
    many = F.ceil(n / block) if block else F.greatest(F.ceil(n / MOST), F.least(F.ceil(n / LEAST), F.lit(spread)))
    return F.greatest(F.lit(1), many).cast("int")


def choose(metric: str, threshold: float, length: int, by: list[str] | None = None, exact: bool = True) -> str:
    """``grouped``, ``bands``, ``blocks`` or ``inverted_file``.

    A blocking key confines the work to its groups; few allowed bits make bands
    selective and stay exact; blocks compare all pairs; an inverted file is for
    callers that accept less than full recall.
    """
    if by:
        return "grouped"
    if metric == "hamming" and length // max(1, int(-(-threshold * length // 1))) >= 12:
        return "bands"
    return "blocks" if exact else "inverted_file"
