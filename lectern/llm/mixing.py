"""Mixing sources to target weights by Pfair scheduling.

Every source is a task whose weight is its target share; its k-th block of
`block_rows` rows is released at slot floor((k-1)/w) and due by slot ceil(k/w).
Each slot goes to the released block with the earliest deadline (ties: the later
successor first, as PD2 has it, then the name), which keeps every source within
one block of its share at every slot while no source has run out.

Weights are kept as exact fractions and no schedule is repeated, so the bound
holds against the targets themselves, however long the mix and however many its
sources. A source that has run out takes no more slots; the others' blocks keep
to their windows. The driver works the slots out one block after another and
holds one entry for each source and one piece of the schedule; the pieces are
written to a shared folder and joined to the ranges of rows, not broadcast.
Rows get their number within the source from counts by hash range, summed up over
a thousand ranges at a time, so a source that holds a third of all rows is dealt
over as many tasks as its ranges.

Every row is kept: slots for which no block is released stay empty, and the
rest goes on in order; `mix_row` numbers the rows of a block without gaps. Defined results: a null source counts as the source "";
sources without a target weight share what `weights` leaves over in proportion
to their rows, or, where nothing (less than 1e-9) is left over, come after all
others in proportion to their rows; repeated rows are rows of their own; rows
with a null id go by a hash of all their columns; an empty table gives an empty
result; columns named like the new ones are replaced, others may have any name.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, named, spare

#: Hash ranges whose rows are summed up together.
RANGES = 1000
#: Blocks of the schedule that the driver holds at once.
PIECE = 100_000


def schedule(weights: dict[str, float], blocks: dict[str, int]) -> Iterator[tuple[str, int, int]]:
    """(source, block from 0, slot) of all blocks by slot: the earliest deadline among released blocks, by exact weights."""
    exact = {k: Fraction(v) for k, v in weights.items()}
    if not exact or min(exact.values()) <= 0:
        raise ValueError("weights must be positive")
    unit = math.lcm(*(x.denominator for x in exact.values()))
    part = {k: int(x * unit) for k, x in exact.items()}
    total = sum(part.values())

    def due(name: str, k: int) -> tuple[int, bool, int, str, int]:
        end = (k + 1) * total
        # the next block's window begins before this one's ends: it goes first among equals
        return -(-end // part[name]), end % part[name] == 0, -part[name], name, k

    ready = [due(name, 0) for name in sorted(part) if blocks[name]]
    heapq.heapify(ready)
    later: list[tuple[int, str, int]] = []
    slot = 0
    while ready or later:
        if not ready:
            slot = max(slot, later[0][0])
        while later and later[0][0] <= slot:
            _, name, k = heapq.heappop(later)
            heapq.heappush(ready, due(name, k))
        *_, name, k = heapq.heappop(ready)
        yield name, k, slot
        if k + 1 < blocks[name]:
            heapq.heappush(later, ((k + 1) * total // part[name], name, k + 1))
        slot += 1


def target_weights(counts: dict[str, int], weights: dict[str, float] | None) -> tuple[dict[str, float], dict[str, float]]:
    """Weights of the sources that are mixed, and of those that come after them: see the module."""
    held = {k: w for k, w in (weights or {}).items() if w > 0 and k in counts}
    rest = {k: n for k, n in counts.items() if k not in held}
    left = 1 - sum(map(Fraction, held.values()))
    if not held or left < Fraction(1, 10**9):
        return (held, rest) if held else (rest, {})
    total = sum(rest.values())
    return held | {k: left * n / total for k, n in rest.items()}, {}


def _slots(counts: dict[str, int], weights: dict[str, float] | None, alpha: float, block_rows: int) -> Iterator[tuple[str, int, int]]:
    blocks = {k: -(-n // block_rows) for k, n in counts.items()}
    first, after = target_weights(counts, weights) if weights else ({k: n**alpha for k, n in counts.items()}, {})
    begin = 0
    for shares in (first, after):
        last = begin - 1
        if shares:
            for name, k, slot in schedule(shares, blocks):
                last = begin + slot
                yield name, k, last
        begin = last + 1


def _written(spark, slots: Iterator[tuple[str, int, int]]) -> DataFrame:
    """The schedule as a table of the shared folder, written piece by piece."""
    scratch, out = Scratch(spark), None
    names = ["of", "k", "slot"]
    types = [pa.string(), pa.int64(), pa.int64()]
    while piece := list(islice(slots, PIECE)):
        columns = [pa.array(c, t) for c, t in zip(zip(*piece, strict=True), types, strict=True)]
        part = scratch.write(spark.createDataFrame(pa.table(columns, names)), "slots")
        out = part if out is None else out.unionAll(part)
    return out


def mix(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    source_col: str = "source",
    id_col: str = "doc_id",
    alpha: float = 0.5,
    block_rows: int = 8,
    range_rows: int = 500,
    seed: int = 1,
) -> DataFrame:
    """All rows with mix_block (the block's slot) and mix_row (the row's place within the block).

    Ordering by (mix_block, mix_row) gives the mix. Rows of a source are taken in
    the order of a seeded hash of their id. weights: target share by source, of 1
    in all, or scaled to it where they are more; without them a source's share goes with its rows to the power alpha.
    """
    spark = docs.sparkSession
    slots = 1 << 40
    new = ("mix_block", "mix_row")
    docs = docs.drop(*new)
    kept = named(docs)
    of, h, part, i, before, held, key, key_part = spare([*docs.columns, *new], "of", "h", "part", "i", "before", "held", "key", "key_part")
    rows = docs.withColumn(of, F.coalesce(F.col(source_col).cast("string"), F.lit("")))
    found = rows.groupBy(of).agg(F.count("*").alias("n"), F.count(id_col).alias("with_id")).collect()
    counts = {r[of]: r.n for r in found}
    if not counts:
        return docs.select(*kept, F.lit(None).cast("long").alias("mix_block"), F.lit(None).cast("int").alias("mix_row"))
    mixed = F.xxhash64(F.lit(seed), F.col(id_col))
    if any(r.n > r.with_id for r in found):  # else null ids would all meet in one range
        mixed = F.when(F.col(id_col).isNull(), F.xxhash64(F.lit(seed), *kept)).otherwise(mixed)
    taken = _written(spark, _slots(dict(sorted(counts.items())), weights, alpha, block_rows))
    ranges = max(1, -(-sum(counts.values()) // range_rows))
    rows = rows.withColumn(h, F.pmod(mixed, F.lit(slots))).withColumn(part, F.floor(F.col(h) / F.lit(-(-slots // ranges))).cast("int"))
    # running counts of the ranges: within a thousand of them, on top of those of the thousands before
    sizes = rows.groupBy(F.col(of).alias("of"), F.col(part).alias("part")).agg(F.count("*").alias("n")).withColumn("many", F.expr(f"part div {RANGES}"))
    running = lambda order, *by: Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.groupBy("of", "many").agg(F.sum("n").alias("n")).select("of", "many", F.coalesce(F.sum("n").over(running("many", "of")), F.lit(0)).alias("base"))
    inner = sizes.withColumn("inner", F.coalesce(F.sum("n").over(running("part", "of", "many")), F.lit(0))).join(base, ["of", "many"])
    inner = inner.select("of", "part", "n", (F.col("base") + F.col("inner")).alias("before"))
    # the slots of each range's blocks, in order: a range holds about range_rows / block_rows of them
    ks = inner.select("of", "part", "before", F.explode(F.sequence(F.expr(f"before div {block_rows}"), F.expr(f"(before + n - 1) div {block_rows}"))).alias("k"))
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("k", "slot"))), lambda x: x["slot"])
    places = ks.join(taken.hint("merge"), ["of", "k"]).groupBy("of", "part").agg(F.first("before").alias("before"), in_order.alias("held"))
    places = places.select(F.col("of").alias(key), F.col("part").alias(key_part), F.col("before").alias(before), F.col("held").alias(held))
    within = Window.partitionBy(of, part).orderBy(h, id_col)
    out = rows.withColumn(i, F.row_number().over(within) - 1).join(places.hint("merge"), (F.col(of) == F.col(key)) & (F.col(part) == F.col(key_part)))
    at = F.expr(f"`{held}`[cast((`{before}` + `{i}`) div {block_rows} - `{before}` div {block_rows} as int)]")
    return out.select(*kept, at.alias("mix_block"), F.expr(f"cast((`{before}` + `{i}`) % {block_rows} as int)").alias("mix_row"))
