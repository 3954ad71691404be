"""Language identification by Bayesian evidence fusion.

Four kinds of evidence are multiplied: the likelihood of the text (hashed byte
trigrams), the declared markup language, the address suffix and the host.
The text model is fitted on at most ``SAMPLE`` labelled rows, those with the
smallest hashed ids; its likelihood is tempered to ``EVIDENCE`` trigrams, as
neighbouring trigrams aren't independent.  Text posteriors of all rows are then
added up by host, by suffix and over everything (grouped aggregation), and
smoothed down the hierarchy: a suffix's prior leans on the global one with
weight ``LEAN``, a host's on its suffix's.  How far a declaration can be
trusted is learned in the same way, from how often it goes with each language.
Host priors are broadcast while they are at most ``FEW``; more are joined, with the
rows of a host dealt over ``SALTS`` tasks.

Defined cases: null and empty texts have no text evidence and follow their
declaration and host; null hosts, suffixes and declarations are values of
their own; without labelled rows the result is empty strings with probability
0; ties go to the language that comes first by name; repeated rows get equal
results, and texts may be of any length; an empty table gives an empty result.
Other columns are handed on whatever their names, but ``lang`` and
``probability`` are replaced by the results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashing import BLOCK, text_buffers
from .session import durable, map_arrow

SAMPLE = 10_000
BUCKETS = 1 << 16
EVIDENCE = 60
LEAN = 5.0
#: Rows of host priors that may be broadcast, and parts of a host's rows in a join of more.
FEW = 200_000
SALTS = 32
#: More languages than this are taken for a mistake in the labels.
MOST_LANGUAGES = 1000
_LOW = np.arange(256, dtype=np.uint32)
_LOW[65:91] += 32


@dataclass(frozen=True)
class TextModel:
    """languages, and log-probabilities of the trigram buckets by language."""

    languages: tuple[str, ...]
    table: np.ndarray


def _buckets(data: np.ndarray) -> np.ndarray:
    low = _LOW[data]
    return (low[:-2] * np.uint32(0x9E3779B1) + low[1:-1] * np.uint32(0x85EBCA6B) + low[2:] * np.uint32(0xC2B2AE35)) >> np.uint32(16)


def _blocks(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, buckets of a block of its text), whole texts."""
    data, offsets = text_buffers(column)
    for row in range(len(offsets) - 1):
        for a in range(offsets[row], max(offsets[row + 1] - 2, offsets[row]), BLOCK):
            yield row, _buckets(data[a : min(a + BLOCK + 2, offsets[row + 1])])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for row, buckets in _blocks(batch.column(1)):
            total.setdefault(langs[row], np.zeros(BUCKETS, np.int64))
            total[langs[row]] += np.bincount(buckets, minlength=BUCKETS)
    for lang, counts in total.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], names=["lang", "bucket", "n"])


def fit_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> TextModel:
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull())
    chosen = durable(known.select(id_col, lang_col).orderBy(F.xxhash64(id_col), id_col).limit(sample)).distinct()
    rows = known.join(F.broadcast(chosen), [id_col, lang_col], "left_semi").select(lang_col, text_col)
    if (n := chosen.select(lang_col).distinct().count()) > MOST_LANGUAGES:
        raise ValueError(f"{n} languages, {MOST_LANGUAGES} at most")
    sums = map_arrow(rows, _counted, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    # a row for each language: its buckets and their sums, at most BUCKETS of them
    counts = sums.groupBy("lang").agg(F.collect_list("bucket").alias("buckets"), F.collect_list("n").alias("ns")).orderBy("lang").collect()
    languages = tuple(x.lang for x in counts)
    table = np.full((BUCKETS, len(languages)), 0.5)
    for i, x in enumerate(counts):
        table[np.array(x.buckets), i] += np.array(x.ns)
    return TextModel(languages, np.log(table / table.sum(axis=0)) if languages else table)


def _scored(batches: Iterator[pa.RecordBatch], model: TextModel, names: list[str], at: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sums, n = np.zeros((batch.num_rows, len(model.languages))), np.zeros(batch.num_rows)
        for row, buckets in _blocks(batch.column(at)):
            sums[row] += model.table[buckets].sum(axis=0)
            n[row] += len(buckets)
        sums *= (np.minimum(n, EVIDENCE) / np.maximum(n, 1))[:, None]
        sums -= sums.max(axis=1, keepdims=True)
        keep = [i for i in range(len(names)) if i != at]
        flat = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(model.languages)), pa.array(sums.ravel()))
        yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in keep], flat], names=[*[names[i] for i in keep], "ll"])


def declared_language(html: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(html, r"(?i)<html[^>]*\blang\s*=\s*[\"']?([a-zA-Z]{2})", 1)), F.lit(""))


def host_of(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)), F.lit(""))


def suffix_of(host: Column) -> Column:
    return F.nullif(F.regexp_extract(host, r"\.([a-z]{2,})$", 1), F.lit(""))


def visible_text(html: Column) -> Column:
    return F.regexp_replace(html, r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->|<[^>]*>", " ")


def identify(rows: DataFrame, model: TextModel) -> DataFrame:
    """rows (any columns, and text, declared, suffix, host) without text, with lang and probability."""
    n = len(model.languages)
    others = [c for c in rows.columns if c not in ("text", "lang", "probability")]
    if not n:
        return rows.select(*[rows[c] for c in others], F.lit("").alias("lang"), F.lit(0.0).alias("probability"))
    key = lambda c: F.coalesce(rows[c].cast("string"), F.lit(""))
    packed = rows.select(F.struct(*[rows[c] for c in others]).alias("row"), key("host").alias("host"), key("suffix").alias("suffix"), key("declared").alias("declared"), rows["text"].alias("text"))
    names, at = packed.columns, packed.columns.index("text")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in packed.schema if f.name != "text")
    scored = durable(map_arrow(packed, lambda it: _scored(it, model, names, at), f"{kinds}, ll array<double>"))
    total = F.aggregate("ll", F.lit(0.0), lambda a, x: a + F.exp(x))
    soft = scored.select("host", "suffix", "declared", "ll", total.alias("total")).withColumns({f"p{i}": F.exp(F.get("ll", F.lit(i))) / F.col("total") for i in range(n)})
    sums = lambda *by: soft.groupBy(*by).agg(*[F.sum(f"p{i}").alias(f"p{i}") for i in range(n)])
    hosts, declared = durable(sums("suffix", "host")), sums("declared")
    everything = hosts.agg(*[F.sum(f"p{i}") for i in range(n)]).first()
    prior = [((everything[i] or 0.0) + 1.0) / (sum(x or 0.0 for x in everything) + n) for i in range(n)]
    all_of = lambda prefix: sum((F.col(f"{prefix}{i}") for i in range(n)), F.lit(0.0))
    suffixes = hosts.groupBy("suffix").agg(*[F.sum(f"p{i}").alias(f"q{i}") for i in range(n)])
    suffixes = suffixes.select("suffix", *[((F.col(f"q{i}") + LEAN * prior[i]) / (all_of("q") + LEAN)).alias(f"s{i}") for i in range(n)])
    hosts = hosts.join(suffixes, "suffix").select("suffix", "host", *[((F.col(f"p{i}") + LEAN * F.col(f"s{i}")) / (all_of("p") + LEAN)).alias(f"h{i}") for i in range(n)])
    # P(declaration | language), smoothed; a missing declaration says nothing
    mass = [(everything[i] or 0.0) + 1.0 for i in range(n)]
    trust = declared.select("declared", *[F.when(F.col("declared") == "", 1.0).otherwise((F.col(f"p{i}") + 0.01) / mass[i]).alias(f"d{i}") for i in range(n)])
    joined = _joined(_joined(scored, hosts, ["suffix", "host"]), trust, ["declared"])
    fused = joined.withColumn("log", F.array(*[F.get("ll", F.lit(i)) + F.log(f"h{i}") + F.log(f"d{i}") for i in range(n)]))
    fused = fused.withColumn("top", F.array_max("log"))
    best = F.array_position("log", F.col("top")).cast("int")
    share = 1.0 / F.aggregate("log", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    return fused.select("row.*", F.element_at(F.array(*[F.lit(x) for x in model.languages]), best).alias("lang"), share.alias("probability"))


def _joined(rows: DataFrame, priors: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the priors of their keys: broadcast, or joined with a key's rows dealt over SALTS tasks."""
    priors = durable(priors)
    if priors.count() <= FEW:
        return rows.join(F.broadcast(priors), keys)
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64("ll", "row"), F.lit(SALTS)).cast("int"))
    return dealt.join(priors.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [*keys, "salt"]).drop("salt")


def evidence_of(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """Rows of both tables with their evidence: source_table, doc_id, page_id, text, declared, suffix, host."""
    none = F.lit(None).cast("string")
    docs = documents.select(F.lit("documents").alias("source_table"), F.col("doc_id").cast("long"), F.lit(None).cast("long").alias("page_id"), "text", declared_language(F.col("text")).alias("declared"), none.alias("suffix"), F.col("source").alias("host"))
    host = host_of(F.col("url"))
    web = pages.select(F.lit("pages").alias("source_table"), F.lit(None).cast("long").alias("doc_id"), F.col("page_id").cast("long"), visible_text(F.col("html")).alias("text"), declared_language(F.col("html")).alias("declared"), suffix_of(host).alias("suffix"), host.alias("host"))
    return docs.unionByName(web)
