"""Best-fit-decreasing packing of token pieces into fixed-length sequences.

Best-fit decreasing depends on the lengths alone, and lengths are integers up
to the capacity, so the plan is made from a histogram of at most ``capacity``
counts.  The driver runs best-fit over classes of equal pieces: a segment tree
over remaining capacities finds the tightest open capacity that takes a length
in O(log capacity), and a whole interval of bins is filled at once, exactly as
piece-by-piece best-fit would.  The plan has rows
(length, first rank, last rank, first bin, pieces a bin, offset), their number
bounded by the capacity and not by the corpus.  Each piece finds its row by its
rank among the pieces of its length: a rank inside a salt of (length, salt)
plus the counts of the salts before.  A length gets a salt for every ``RANKED``
pieces (or more where there are over RANKED * SALTS pieces), so no length, however
common, is ranked by one task, and the driver has capacity + SALTS counts at most.

Defined cases: null text counts as empty (one piece, the separator alone); ids
are cast to long, so one that isn't a number is an error (or null, without ANSI
mode); a null id hashes like any other value; repeated rows are packed each on
its own; a text may be of any length and its pieces are handed on a million ids
at a time; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import tokens
from .session import durable, map_arrow

CAPACITY = 2048
SEPARATOR = 0
RANKED = 10_000
SALTS = 100_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document; only the first may be shorter than the capacity."""
    head = total % capacity or min(capacity, total)
    return [(0, head)] + [(a, capacity) for a in range(head, total, capacity)]


def _piece_batches(batches: Iterator[pa.RecordBatch], capacity: int, json_path: str, ranks_path: str, with_ids: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[] for _ in range(5 + with_ids)]

        def flush(out=out):
            made = pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), *[pa.array(out[i], pa.int64()) for i in (2, 3, 4)]] + [pa.array(x, pa.binary()) for x in out[5:]],
                names=["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids,
            )
            for x in out:
                x.clear()
            return made

        size = 0
        for row in range(batch.num_rows):
            doc, text = batch.column(0)[row].as_py(), batch.column(1)[row].as_py()
            ids = np.append(tokens.encode(text or "", json_path, ranks_path), np.uint32(SEPARATOR)).astype("<u4")
            for k, (start, length) in enumerate(cut(len(ids), capacity)):
                part = ids[start : start + length].tobytes()
                values = (doc, k, start, length, zlib.crc32(part)) + ((part,) if with_ids else ())
                for column, value in zip(out, values, strict=True):
                    column.append(value)
                size += 5 + with_ids * length
            if size > 1_000_000:
                yield flush()
                size = 0
        yield flush()


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, json_path: str | None = None, ranks_path: str | None = None, with_ids: bool = False) -> DataFrame:
    """The pieces of all documents, with their ids (little-endian unsigned 32-bit) if asked for."""
    json_path, ranks_path = json_path or tokens.default_path("byte_bpe_50k.json"), ranks_path or tokens.default_path("byte_bpe_50k.tiktoken")
    return map_arrow(
        docs.select(F.col(id_col).cast("long"), F.col(text_col)),
        lambda it: _piece_batches(it, capacity, json_path, ranks_path, with_ids),
        PIECES + (", ids binary" if with_ids else ""),
    )


class CapacityTree:
    """Segment tree over remaining capacities: which of them have open bins."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.open = [0] * (2 * self.size)

    def set(self, at: int, value: int) -> None:
        at += self.size
        self.open[at] = value
        while at > 1:
            at >>= 1
            self.open[at] = self.open[2 * at] or self.open[2 * at + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest open capacity of at least ``least``."""
        at = least + self.size
        if self.open[at]:
            return least
        while at > 1:
            if not at & 1 and self.open[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.open[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return None


def best_fit_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Rows (length, first rank, end rank, first bin, pieces a bin, offset) and the number of bins."""
    tree, bins, plan = CapacityTree(capacity), 0, []
    stock: dict[int, list[tuple[int, int]]] = {}  # remaining capacity: intervals (first bin, number) of open bins

    def put(remaining: int, first: int, n: int) -> None:
        if remaining and n:
            insort(stock.setdefault(remaining, []), (first, n))
            tree.set(remaining, 1)

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            remaining = tree.tightest(length)
            if remaining is None:
                each = capacity // length
                first, n, remaining = bins, max(1, left // each), capacity
                bins += n
            else:
                each = remaining // length
                first, n = stock[remaining].pop()
                if n > max(1, left // each):
                    put(remaining, first + max(1, left // each), n - max(1, left // each))
                    n = max(1, left // each)
                if not stock[remaining]:
                    tree.set(remaining, 0)
            each = min(each, left)
            plan.append((length, rank, rank + n * each, first, each, capacity - remaining))
            put(remaining - each * length, first, n)
            rank, left = rank + n * each, left - n * each
    return plan, bins


def place(pieces_df: DataFrame, capacity: int = CAPACITY, ranked: int = RANKED) -> DataFrame:
    """The pieces with sequence_id and offset; at most about ``ranked`` pieces of a length are ranked together."""
    spark = pieces_df.sparkSession
    fixed = durable(pieces_df)
    lengths = [(x.length, x["count"]) for x in fixed.groupBy("length").count().collect()]  # at most capacity rows
    ranked = max(ranked, sum(n for _, n in lengths) // SALTS)
    salts = F.broadcast(spark.createDataFrame([(length, -(-n // ranked)) for length, n in lengths], "length long, _salts long"))
    salted = fixed.join(salts, "length").withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.col("_salts")).cast("int")).drop("_salts")
    counts = salted.groupBy("length", "_salt").count()
    counts = [(x.length, x._salt, x["count"]) for x in counts.collect()]  # at most capacity + SALTS rows
    histogram, before = {}, []
    for length, salt, n in sorted(counts):
        before.append((length, salt, histogram.get(length, 0)))
        histogram[length] = histogram.get(length, 0) + n
    plan, _ = best_fit_plan(histogram, capacity)
    plan_df = spark.createDataFrame(plan, "length long, _first long, _end long, _bin long, _each long, _offset long")
    before_df = spark.createDataFrame(before, "length long, _salt int, _before long")
    own = W.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("_own", F.row_number().over(own) - 1).join(F.broadcast(before_df), ["length", "_salt"])
    ranked = ranked.withColumn("_rank", F.col("_own") + F.col("_before"))
    hit = ranked.alias("p").join(F.broadcast(plan_df).alias("q"), (F.col("p.length") == F.col("q.length")) & (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_end")))
    step = F.col("_rank") - F.col("_first")
    return hit.select(
        *[F.col(f"p.{c}") for c in pieces_df.columns],
        (F.col("_bin") + F.expr("(_rank - _first) div _each")).alias("sequence_id"),
        (F.col("_offset") + (step % F.col("_each")) * F.col("p.length")).alias("offset"),
    )


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, **paths) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return place(pieces(docs, id_col, text_col, capacity, **paths), capacity)


def sequences(placed: DataFrame) -> DataFrame:
    """The packed token sequences: sequence_id, ids (little-endian unsigned 32-bit), from pieces made with_ids and placed.

    A sequence has at most ``capacity`` tokens, so no group is larger than that.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))
    return placed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id",
        F.aggregate("parts", F.expr("cast('' as binary)"), lambda a, x: F.concat(a, x["ids"])).alias("ids"),
        F.transform("parts", lambda x: F.struct(x["offset"].alias("offset"), x["doc_id"].alias("doc_id"), x["piece"].alias("piece"))).alias("parts"),
    )
