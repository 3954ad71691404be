"""Exact deduplication with a heavy-hitter split.

1. Each row's normalised text gets a SHA-256 digest in the JVM.
2. Misra-Gries summaries of the digests (one per partition, at most
   ``counters`` entries each) are merged; the ``counters`` largest are the
   candidates, whatever the size of the corpus.
3. Exact counts and smallest ids of the candidates (partial aggregation, so a
   task sends at most one row for each) verify them; this table of at most
   ``counters`` rows is broadcast, and rows with those digests are resolved
   map-side.
4. All other digests are shuffled; a hot digest is never among them.

Digests are stored once with their ids and all of this works on that table;
texts aren't shuffled.  ``drop_copies`` removes the copies of a winner map-side,
and the others by a broadcast of at most ``FEW`` of them or else a join.

Defined cases: null text counts as empty; null ids come after all others
(``keep_id`` is null only if every copy's id is); rows that repeat both id and
text are all marked like the first, and ``drop_copies`` leaves one of them;
an empty table gives an empty result; texts may be of any length.  Other columns
pass through untouched whatever their names, but ``mark_copies`` replaces one
that is named like a result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .session import SPACE, durable, map_arrow

COUNTERS = 1024
#: Rows (an id and a digest) that may be broadcast.
FEW = 500_000
RESULT = ("keep_id", "group_size", "kept", "text_sha256")


def digest(text: str | Column) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ").cast("binary"), 256)


def misra_gries(batches: Iterator[pa.RecordBatch], counters: int) -> Iterator[pa.RecordBatch]:
    """Counters of one partition: each is at most n / (counters + 1) below its true count."""
    keys, counts, schema = np.empty(0, object), np.empty(0, np.int64), pa.schema([("d", pa.string()), ("n", pa.int64())])
    for batch in batches:
        seen, n = np.unique(np.concatenate([keys, batch.column(0).to_numpy(zero_copy_only=False)]), return_inverse=True)
        total = np.bincount(n, weights=np.concatenate([counts, np.ones(batch.num_rows)]), minlength=len(seen)).astype(np.int64)
        if len(seen) > counters:
            total -= np.partition(total, len(total) - counters - 1)[len(total) - counters - 1]
        keys, counts = seen[total > 0], total[total > 0]
    yield pa.RecordBatch.from_arrays([pa.array(list(keys), pa.string()), pa.array(counts, pa.int64())], schema=schema)


def heavy_hitters(digests: DataFrame, id_col: str, counters: int = COUNTERS) -> DataFrame:
    """Exact (text_sha256, keep_id, group_size) of at most ``counters`` frequent digests."""
    summary = map_arrow(digests.select("text_sha256"), lambda it: misra_gries(it, counters), "d string, n long")
    found = summary.groupBy("d").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "d").limit(counters).select(F.col("d").alias("text_sha256"))
    return digests.join(F.broadcast(found), "text_sha256", "left_semi").groupBy("text_sha256").agg(F.min(id_col).alias("keep_id"), F.count(F.lit(1)).alias("group_size"))


def _winners(digests: DataFrame, counters: int) -> DataFrame:
    """The verified winners, for a broadcast: at most `counters` rows of three short columns, the one collect here."""
    schema = digests.select("text_sha256", F.col("id").alias("keep_id"), F.lit(0).cast("long").alias("group_size")).schema
    return F.broadcast(digests.sparkSession.createDataFrame(heavy_hitters(digests, "id", counters).collect(), schema))


def _digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return durable(docs.select(docs[id_col].alias("id"), digest(docs[text_col]).alias("text_sha256")))


def _split(rows: DataFrame, winners: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows (id, text_sha256, ...) of the winners' digests, and all others, with keep_id and group_size."""
    group = W.partitionBy("text_sha256")
    cold = rows.join(winners, "text_sha256", "left_anti").withColumns({"keep_id": F.min("id").over(group), "group_size": F.count(F.lit(1)).over(group)})
    return rows.join(winners, "text_sha256"), cold


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row per row of docs: id_col, keep_id, group_size, kept, text_sha256."""
    digests = _digests(docs, id_col, text_col)
    hot, cold = _split(digests, _winners(digests, counters))
    return hot.unionByName(cold).select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def mark_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """docs with keep_id, group_size, kept and text_sha256."""
    others = [c for c in docs.columns if c not in RESULT or c in (id_col, text_col)]
    rows = docs.select(docs[id_col].alias("id"), digest(docs[text_col]).alias("text_sha256"), F.struct(*[docs[c] for c in others]).alias("row"))
    hot, cold = _split(rows, _winners(_digests(docs, id_col, text_col), counters))
    return hot.unionByName(cold).select("row.*", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row of each group of equal texts, with the columns of docs."""
    digests = _digests(docs, id_col, text_col)
    winners = _winners(digests, counters)
    hot, cold = _split(digests, winners)
    is_kept = F.col("id").eqNullSafe(F.col("keep_id"))
    late = durable(cold.filter(~is_kept).select("id", "text_sha256").distinct())
    late = F.broadcast(late) if late.count() <= FEW else late
    again = durable(hot.unionByName(cold).filter(is_kept).groupBy("id", "text_sha256").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    rows = docs.select(docs[id_col].alias("id"), digest(docs[text_col]).alias("text_sha256"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    rows = rows.join(winners, "text_sha256", "left").filter(F.col("group_size").isNull() | is_kept).select("id", "text_sha256", "row")
    same = lambda x: (rows["text_sha256"] == x["text_sha256"]) & rows["id"].eqNullSafe(x["id"])
    rows = rows.join(late, same(late), "left_anti")
    if again.isEmpty():
        return rows.select("row.*")
    # rows that repeat both id and text: a task keeps one of them
    single, repeated = rows.join(again, same(again), "left_anti"), rows.join(again, same(again), "left_semi")
    return single.select("row.*").unionByName(repeated.groupBy("id", "text_sha256").agg(F.first("row").alias("row")).select("row.*"))
