"""Best-fit packing of pieces into sequences of one capacity.

A bin's content depends on lengths alone, and there are at most ``capacity`` lengths. So the
pieces are counted by length, the plan is made for the counts (runs of equal bins instead
of single bins), and every piece looks up its place by its rank among the pieces of its length.
The plan's size does not depend on the number of pieces.

Pieces above a third of the capacity go first: at most two share a bin, matched greedily, the longest
with the longest that fits beside it. The smaller ones then fill, longest first, the
smallest gap that holds them.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarterline.llm.tokens import token_pieces
from quarterline.session import shuffle_partitions, stage

CAPACITY = 2048
#: plan rows up to which the plan is broadcast (48 bytes each); a longer one is joined by shuffle
BROADCAST_ROWS = 100_000

_PLAN = "length bigint, first bigint, past bigint, bin bigint, per_bin bigint, place bigint"


class _Gaps:
    """Runs of bins by the room left in each."""

    def __init__(self) -> None:
        self._sizes: list[int] = []
        self._runs: dict[int, list[tuple[int, int]]] = {}

    def add(self, gap: int, first: int, count: int) -> None:
        if gap and count:
            if gap not in self._runs:
                insort(self._sizes, gap)
                self._runs[gap] = []
            self._runs[gap].append((first, count))

    def take(self, least: int) -> tuple[int, int, int] | None:
        """(gap, first bin, bins) of a run with the smallest gap of at least ``least``."""
        at = bisect_left(self._sizes, least)
        if at == len(self._sizes):
            return None
        gap = self._sizes[at]
        first, count = self._runs[gap].pop()
        if not self._runs[gap]:
            del self._runs[gap], self._sizes[at]
        return gap, first, count


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first, past, bin, per_bin, place).

    The pieces of ``length`` with ranks from ``first`` up to ``past`` lie ``per_bin`` to a bin, from
    bin number ``bin`` on, and the first in each bin begins at ``place``.
    """
    rows: list[tuple[int, int, int, int, int, int]] = []
    left = dict(counts)
    ranks = dict.fromkeys(counts, 0)
    gaps = _Gaps()
    bins = 0

    def put(length: int, pieces: int, first_bin: int, per_bin: int, place: int) -> None:
        rows.append((length, ranks[length], ranks[length] + pieces, first_bin, per_bin, place))
        ranks[length] += pieces
        left[length] -= pieces

    large = sorted(length for length in counts if 3 * length > capacity)
    for length in reversed(large):
        while left[length]:
            room = capacity - length
            partner = next((
                other for other in reversed(large[: bisect_left(large, room + 1)])
                if left[other] >= (2 if other == length else 1)), None)
            if partner is None:
                opened = left[length]
                put(length, opened, bins, 1, 0)
                gaps.add(room, bins, opened)
            elif partner == length:
                opened = left[length] // 2
                put(length, 2 * opened, bins, 2, 0)
                gaps.add(room - length, bins, opened)
            else:
                opened = min(left[length], left[partner])
                put(length, opened, bins, 1, 0)
                put(partner, opened, bins, 1, length)
                gaps.add(room - partner, bins, opened)
            bins += opened
    for length in sorted((length for length in counts if 3 * length <= capacity), reverse=True):
        while left[length]:
            found = gaps.take(length)
            if found is None:
                opened = -(-left[length] // (capacity // length))
                found = (capacity, bins, opened)
                bins += opened
            gap, first, count = found
            each = gap // length
            full = min(count, left[length] // each)
            rest = min(left[length] - full * each, each) if full < count else 0
            put(length, full * each + rest, first, each, capacity - gap)
            gaps.add(gap - each * length, first, full)
            if rest:
                gaps.add(gap - rest * length, first + full, 1)
            used = full + bool(rest)
            gaps.add(gap, first + used, count - used)
    return rows


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (doc_id, piece, length from 1 to ``capacity``, ...) with sequence_id and offset.

    Every row gets a place: sequences are filled from offset 0 without gaps. Repeated rows get places
    of their own; which of two rows of one length lies where follows doc_id and piece. An empty
    table gives an empty one. ``pieces`` is read three times: pass a staged table.

    Ranks come from counts of (length, block) with blocks cut by a hash of the row, so a
    length that most pieces have is ranked by many tasks.
    """
    spark = pieces.sparkSession
    counts = {row["length"]: row["count"] for row in pieces.groupBy("length").count().collect()}
    rows = spark.createDataFrame(plan(counts, capacity), _PLAN)
    if len(counts) == 0:
        return pieces.withColumns({"sequence_id": F.lit(0).cast("bigint"), "offset": F.lit(0).cast("bigint")}).limit(0)
    blocks = 4 * shuffle_partitions(spark)
    placed = pieces.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(blocks)))
    held = placed.groupBy("length", "block").count()
    before = held.select(
        "length", "block",
        (F.sum("count").over(Window.partitionBy("length").orderBy("block")) - F.col("count")).alias("before"))
    within = Window.partitionBy("length", "block").orderBy("doc_id", "piece")
    ranked = (
        placed.withColumn("within", F.row_number().over(within) - 1)
        .join(before, ["length", "block"]).withColumn("rank", F.col("before") + F.col("within"))
    )
    if rows.count() <= BROADCAST_ROWS:
        rows = F.broadcast(rows)
    found = ranked.join(
        rows.withColumnRenamed("length", "of_length"),
        (F.col("length") == F.col("of_length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("past")))
    number = F.col("rank") - F.col("first")
    return found.select(
        *pieces.columns,
        (F.col("bin") + F.expr("(rank - first) div per_bin")).alias("sequence_id"),
        (F.col("place") + number % F.col("per_bin") * F.col("length")).alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Tokenise ``docs`` (doc_id, text), cut only what is longer than ``capacity``, and pack.

    One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and ``ids`` if
    asked for. A NULL or empty text is its end id alone. Other columns are ignored.
    """
    pieces = stage(token_pieces(docs, tokenizer, capacity, end_id, with_ids))
    return pack(pieces, capacity)
