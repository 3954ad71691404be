"""Column functions shared by the operators; all are built-in expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-12


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pad_code(code: str | Column, width: int = 6) -> Column:
    """Trimmed, zero-filled on the left; longer codes stay as they are (lpad alone would cut them)."""
    text = F.trim(col(code).cast("string"))
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def normalize_code(code: str | Column, width: int = 6) -> Column:
    """Robust form: drop a trailing ".0", take the first run of ``width`` digits, else all digits zero-filled."""
    text = F.regexp_replace(F.trim(col(code).cast("string")), r"\.0$", "")
    run = F.regexp_extract(text, rf"(\d{{{width}}})", 1)
    return F.when(run != "", run).otherwise(pad_code(F.regexp_replace(text, r"\D", ""), width))


def canonical(a: str | Column, b: str | Column) -> tuple[Column, Column]:
    """The pair's two keys, smaller first; attributes are joined late, so they can't go astray."""
    return F.least(col(a), col(b)), F.greatest(col(a), col(b))


def strict_bool(c: str | Column) -> Column:
    """true/false/1/0 (and 1.0/0.0) in any case; anything else, null included, raises."""
    text = F.lower(F.trim(col(c).cast("string")))
    return F.when(text.isin("true", "1", "1.0"), True).when(text.isin("false", "0", "0.0"), False).otherwise(F.raise_error(F.concat(F.lit("not a boolean: "), F.coalesce(text, F.lit("null")))).cast("boolean"))


def to_number(c: str | Column) -> Column:
    """Bad text becomes null."""
    return col(c).try_cast("double")


def positive_only(c: str | Column) -> Column:
    return F.when(col(c) > 0, col(c))


def ratio(a: str | Column, b: str | Column) -> Column:
    """a / b, null on a zero or missing denominator."""
    return F.try_divide(col(a).cast("double"), F.nullif(col(b).cast("double"), F.lit(0.0)))


def isclose(a: str | Column, b: str | Column, atol: float = 1e-8, rtol: float = 1e-5) -> Column:
    return F.abs(col(a) - col(b)) <= atol + rtol * F.abs(col(b))


def variation(mean: str | Column, sd: str | Column) -> Column:
    """Coefficient of variation, null at a mean of (nearly) zero."""
    return F.when(F.abs(col(mean)) >= EPS, col(sd) / F.abs(col(mean)))


def median(c: str | Column) -> Column:
    return F.percentile(col(c), F.lit(0.5))


def safe_corr(a: str | Column, b: str | Column) -> Column:
    """Pearson of a group, null where either side doesn't vary (corr itself raises there)."""
    return F.when((F.stddev_pop(a) > EPS) & (F.stddev_pop(b) > EPS), F.covar_pop(a, b) / (F.stddev_pop(a) * F.stddev_pop(b)))


def row_mean(*cs: str) -> Column:
    return sum((F.col(c) for c in cs[1:]), F.col(cs[0])) / len(cs)


def row_sd(*cs: str) -> Column:
    """Population standard deviation across columns."""
    mean = row_mean(*cs)
    return F.sqrt(sum(((F.col(c) - mean) ** 2 for c in cs[1:]), (F.col(cs[0]) - mean) ** 2) / len(cs))


def count_true(*predicates: Column) -> Column:
    return sum((F.coalesce(p, F.lit(False)).cast("int") for p in predicates), F.lit(0))


def geomspace(low: float, high: float, n: int) -> list[float]:
    if n == 1:
        return [low]
    step = (math.log(high) - math.log(low)) / (n - 1)
    return [low, *[math.exp(math.log(low) + i * step) for i in range(1, n - 1)], high]


def resolve_column(df: DataFrame, candidates: Sequence[str], required: bool = True) -> str | None:
    """The first candidate that the frame has."""
    for c in candidates:
        if c in df.columns:
            return c
    if required:
        raise ValueError(f"none of {list(candidates)} among {df.columns}")
    return None
