"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard has ``NODES`` places on a ring of 63-bit numbers; they depend on the shard's number only. A key's place is its hash, its home the
shard of the first node clockwise. A shard has room for its share of all rows and no more: with ``slack`` 0 the whole part of rows / shards, and one
more for the shards with the most rows at home as far as the remainder goes, so that counts are at most one apart (law ``rows``); else
(1 + slack) times the mean. In each round every unplaced row asks the first shard clockwise that has room left; a shard takes its askers in the
order of their hashes as far as its room goes, and the others continue clockwise. Homes come first, so one more shard moves about its
own share and what overflows, not everything.

Nothing but counts reaches the driver: a round's histogram of (shard, ten bits of the order) with ten more bits for the cell that holds the last
place, until a cell has at most ``CELL`` rows, whose orders are looked at. What a round decides is a mask of open shards and one last
order a shard; any row's shard follows from its own hashes and these masks, so rows are never joined to their shards. A key with a third of all rows has one home
and fills shard after shard; its equal orders are told apart by the row's place in the stored table.

Slots number a shard's rows in that order: rows are sorted by (shard, order) over range partitions, in which no key is too large as the order has no
ties, and written; a row's place in its file plus the rows of earlier files is its slot.

Cases: a null key is a key; a null text has no bytes and the checksum of the empty text; repeated rows are rows of one key (which copy lies where is not said,
as nothing tells them apart); fewer rows than shards leave shards empty; an empty table gives no rows; extra columns pass through.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldloom.llm.common import bounded_batches, dropped, random_table, small, stored, tidy

SHARDS, NODES = 40, 1024
#: Bytes that a row has beside its text (fixed value).
OVERHEAD = 16
#: Bits of an order that one histogram tells apart; rows of a cell that are looked at one by one.
BITS, CELL = 10, 1000
#: An order is two numbers of ORDER bits: the key's and contents' hash, and the row's place.
ORDER = 60

#: One round: the shards that have room, and for each the last order that it takes (-1: none is refused).
Round = tuple[tuple[bool, ...], list[tuple[int, int] | None]]


class Ring:
    """The nodes of the shards that are open, in order."""

    def __init__(self, is_open: tuple[bool, ...], nodes: int = NODES) -> None:
        owners = np.repeat(np.arange(len(is_open)), nodes)
        places = (random_table(len(is_open) * nodes, 77) >> np.uint64(1)).astype(np.int64)
        kept = np.asarray(is_open)[owners]
        order = np.lexsort((owners[kept], places[kept]))
        self.places, self.owners = places[kept][order], owners[kept][order]

    def first(self, place: np.ndarray) -> np.ndarray:
        """The shard of the first node at or after each place, clockwise."""
        at = np.searchsorted(self.places, place)
        return self.owners[np.where(at == len(self.places), 0, at)]


@lru_cache(maxsize=SHARDS)
def ring(is_open: tuple[bool, ...], nodes: int) -> Ring:
    """A worker keeps the rings that it has made: there is one a round."""
    return Ring(is_open, nodes)


def asked(rounds: list[Round], nodes: int, place: np.ndarray, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shard asked last, was it in the last round, is it taken) of each row."""
    shard, late = np.full(len(place), -1), np.zeros(len(place), bool)
    waiting = np.arange(len(place))
    taken = np.zeros(len(place), bool)
    for number, (is_open, last) in enumerate(rounds):
        if not len(waiting):
            break
        found = ring(is_open, nodes).first(place[waiting])
        top = np.asarray([(1 << ORDER) if cut is None else cut[0] for cut in last], np.int64)[found]
        end = np.asarray([0 if cut is None else cut[1] for cut in last], np.int64)[found]
        shard[waiting] = found
        late[waiting] = number + 1 == len(rounds)
        fits = (high[waiting] < top) | ((high[waiting] == top) & (low[waiting] <= end))
        taken[waiting[fits]] = True
        waiting = waiting[~fits]
    return shard, late, taken


def _arrays(batch: pa.RecordBatch, names: tuple[str, ...]) -> list[np.ndarray]:
    return [batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False).astype(np.int64) for name in names]


def _bits(high: np.ndarray, low: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The digit at ``depth``, and what lies before it in either number."""
    steps = ORDER // BITS
    word, at = (high, depth) if depth < steps else (low, depth - steps)
    rest = ORDER - BITS * at
    before = word >> np.int64(rest)
    digit = (word >> np.int64(rest - BITS)) & np.int64((1 << BITS) - 1)
    return digit, (before if depth < steps else high), (np.zeros_like(before) if depth < steps else before)


class Rounds:
    """Finds the rounds of one stored table of (place, high, low) columns."""

    def __init__(self, columns: tuple[str, str, str], shards: int, nodes: int) -> None:
        self.columns, self.shards, self.nodes = columns, shards, nodes

    def histogram(self, rows: DataFrame, rounds: list[Round], depth: int, cells: dict[int, tuple[int, int]] | None) -> dict[int, dict[int, int]]:
        """shard -> digit -> rows that ask it in the last round, of the given cells only."""
        columns, nodes = self.columns, self.nodes

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, int] = {}
            for batch in batches:
                place, high, low = _arrays(batch, columns)
                shard, late, _ = asked(rounds, nodes, place, high, low)
                digit, a, b = _bits(high, low, depth)
                if cells is not None:
                    for s in np.unique(shard):
                        if s not in cells:
                            late &= shard != s
                        else:
                            late &= (shard != s) | ((a == cells[s][0]) & (b == cells[s][1]))
                for code, n in zip(*(x.tolist() for x in np.unique((shard << BITS | digit)[late], return_counts=True))):
                    total[code] = total.get(code, 0) + n
            if total:
                yield pa.RecordBatch.from_pydict({"code": pa.array(list(total), pa.int64()), "n": pa.array(list(total.values()), pa.int64())})

        found: dict[int, dict[int, int]] = {}
        # at most shards * 2 ** BITS rows, however many rows the table has
        for row in rows.select(*columns).mapInArrow(tidy(run), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect():
            found.setdefault(row.code >> BITS, {})[row.code & (1 << BITS) - 1] = row.n
        return found

    def orders(self, rows: DataFrame, rounds: list[Round], depth: int, cells: dict[int, tuple[int, int]]) -> dict[int, list[tuple[int, int]]]:
        """shard -> the orders of its cell, ascending; a cell has at most CELL rows."""
        columns, nodes = self.columns, self.nodes

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                place, high, low = _arrays(batch, columns)
                shard, late, _ = asked(rounds, nodes, place, high, low)
                _, a, b = _bits(high, low, depth)
                for s, cell in cells.items():
                    mine = np.flatnonzero(late & (shard == s) & (a == cell[0]) & (b == cell[1]))
                    if len(mine):
                        yield pa.RecordBatch.from_pydict({"shard": pa.repeat(int(s), len(mine)), "high": pa.array(high[mine]), "low": pa.array(low[mine])})

        found: dict[int, list[tuple[int, int]]] = {}
        for row in rows.select(*columns).mapInArrow(tidy(run), "shard long, high long, low long").collect():
            found.setdefault(row.shard, []).append((row.high, row.low))
        return {s: sorted(orders) for s, orders in found.items()}

    def cuts(self, rows: DataFrame, rounds: list[Round], counts: dict[int, dict[int, int]], room: list[int]) -> list[tuple[int, int] | None]:
        """The last order that each shard takes of those that ask it in the last round."""
        steps, depth = ORDER // BITS, 0
        cells: dict[int, tuple[int, int]] = {s: (0, 0) for s, digits in counts.items() if sum(digits.values()) > room[s]}
        wanted = {s: room[s] for s in cells}  # this many of the cell's rows are taken
        looked: dict[int, tuple[int, int]] = {}
        while cells:
            ready: dict[int, tuple[int, int]] = {}
            for s in list(cells):
                for digit in sorted(counts[s]):
                    if counts[s][digit] >= wanted[s]:
                        break
                    wanted[s] -= counts[s][digit]
                a, b = cells[s]
                cells[s] = (a << BITS | digit, b) if depth < steps else (a, b << BITS | digit)
                if counts[s][digit] <= CELL:
                    ready[s] = cells.pop(s)
            depth += 1
            if ready:
                for s, orders in self.orders(rows, rounds, depth, ready).items():
                    looked[s] = orders[wanted[s] - 1]
            if cells:
                counts = self.histogram(rows, rounds, depth, cells)
        return [looked.get(s) for s in range(self.shards)]

    def find(self, rows: DataFrame, slack: float) -> list[Round]:
        everything: list[tuple[int, int] | None] = [None] * self.shards
        rounds: list[Round] = [((True,) * self.shards, everything)]
        counts, room, stored_at = self.histogram(rows, rounds, 0, None), [], []
        home = [sum(counts.get(s, {}).values()) for s in range(self.shards)]
        whole, rest = divmod(sum(home), self.shards)
        if slack:
            room = [math.ceil((1 + slack) * sum(home) / self.shards)] * self.shards
        else:
            more = set(sorted(range(self.shards), key=lambda s: (-home[s], s))[:rest])
            room = [whole + (s in more) for s in range(self.shards)]
        while True:
            asking = [sum(counts.get(s, {}).values()) for s in range(self.shards)]
            rounds[-1] = (rounds[-1][0], self.cuts(rows, rounds, counts, room))
            room = [left - min(left, n) for left, n in zip(room, asking)]
            if rounds[-1][1] == everything:
                dropped(*stored_at)
                return rounds
            if not stored_at:  # most rows are at home now: the others are read from a table of their own
                rows = stored(self.waiting(rows, rounds), "overflow")
                stored_at.append(rows)
            # the cuts of a shard without room refuse all: it is not open any more
            rounds.append((tuple(left > 0 for left in room), everything))
            counts = self.histogram(rows, rounds, 0, None)

    def waiting(self, rows: DataFrame, rounds: list[Round]) -> DataFrame:
        columns, nodes = self.columns, self.nodes

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                taken = asked(rounds, nodes, *_arrays(batch, columns))[2]
                yield batch.filter(pa.array(~taken))

        return rows.select(*columns).mapInArrow(tidy(run), ", ".join(f"`{c}` long" for c in columns))


def order_of(*columns: Column) -> Column:
    """A hash of ORDER bits."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 64 - ORDER)


def shard_rows(rows: DataFrame, shards: int = SHARDS, key: str = "doc_id", content: tuple[str, ...] = (), slack: float = 0.0, nodes: int = NODES) -> DataFrame:
    """``rows`` with shard, slot and home_shard (the first shard clockwise, had it room).

    ``content`` names columns that tell the rows of one key apart. Columns of ``rows`` called like the new ones are an error.
    """
    spark = rows.sparkSession
    bounded_batches(spark)
    taken = {c.lower() for c in rows.columns}
    clash = taken & {"shard", "slot", "home_shard"}
    if clash:
        raise ValueError(f"columns {sorted(clash)} are there already")

    def free(name: str) -> str:
        while name in taken:
            name = f"ring_{name}"
        taken.add(name)
        return name

    place, high, low, first, before, file = (free(n) for n in ("place", "high", "low", "first_row", "rows_before", "file"))
    hashed = rows.withColumns({place: F.shiftrightunsigned(F.xxhash64(key), 1), high: order_of(F.col(key), *(F.col(c) for c in content), F.lit(1))})
    held = stored(hashed, "ring-rows")
    numbered = held.withColumn(low, order_of(F.col("_metadata.file_name"), F.col("_metadata.row_index")))
    rounds = Rounds((place, high, low), shards, nodes).find(numbered, slack)

    @F.pandas_udf("struct<shard:int,home_shard:int>")
    def seat(places, highs, lows):  # noqa: ANN001, ANN202
        import pandas as pd

        arrays = [c.to_numpy(np.int64) for c in (places, highs, lows)]
        return pd.DataFrame({"shard": asked(rounds, nodes, *arrays)[0].astype(np.int32), "home_shard": ring((True,) * shards, nodes).first(arrays[0]).astype(np.int32)})

    seat_col = free("seat")
    seated = numbered.withColumn(seat_col, seat(place, high, low)).select("*", f"{seat_col}.*").drop(seat_col, place)
    ordered = stored(seated.sort("shard", high, low), "ring-sorted")
    dropped(held)
    placed = ordered.withColumns({file: F.col("_metadata.file_path"), first: F.col("_metadata.row_index")})
    parts = placed.groupBy(file, "shard").agg(F.min(first).alias("start"), F.count("*").alias("n"), F.min(F.struct(high, low)).alias("least"))
    earlier = F.sum("n").over(Window.partitionBy("shard").orderBy("least")) - F.col("n")
    parts = small(stored(parts.select(file, "shard", (earlier - F.col("start")).alias(before)), "ring-parts"))
    slot = (F.col(first) + F.col(before)).alias("slot")
    return placed.join(parts, [file, "shard"]).select(*rows.columns, "shard", slot, "home_shard")


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards whose counts are at most one apart."""
    text = F.coalesce("text", F.lit(""))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = docs.select("doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return shard_rows(docs, SHARDS, content=("size", "text_crc32")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "home_shard"
    )
