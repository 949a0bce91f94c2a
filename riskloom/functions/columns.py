"""Row-level column builders (inventory B and H).

All return ``Column`` expressions made of built-in functions, so they compile
into whole-stage codegen and run unchanged on batch or streaming frames.
Semantics follow the pandas conventions the reference relies on: a
comparison with a missing value is false, so flags built here are 0 (never
NULL) when an input is NULL.
"""

from __future__ import annotations

from functools import reduce
from operator import add
from typing import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def flag(pred: Column) -> Column:
    """Boolean predicate to 0/1 integer; NULL predicate gives 0."""
    return F.when(pred, F.lit(1)).otherwise(F.lit(0))


def between_flag(c, lo, hi) -> Column:
    """1 when lo <= c <= hi, else 0."""
    return flag(col(c).between(lo, hi))


def present_flag(c) -> Column:
    """1 when not NULL."""
    return col(c).isNotNull().cast("int")


def row_sum(cols) -> Column:
    """Row-wise sum where NULL counts as 0 (B7); differs from ``a + b``."""
    return reduce(add, [F.coalesce(col(c), F.lit(0)) for c in cols])


def clip(c, lo=None, hi=None) -> Column:
    """Clip to bounds, NULL stays NULL."""
    x = col(c)
    y = x
    if lo is not None:
        y = F.greatest(y, F.lit(lo))
    if hi is not None:
        y = F.least(y, F.lit(hi))
    return F.when(x.isNotNull(), y)


def safe_div(a, b) -> Column:
    """Division that yields NULL on a zero divisor (ANSI mode raises)."""
    return F.try_divide(col(a), col(b))


def _map_literal(mapping: Mapping) -> Column:
    items = []
    for k, v in mapping.items():
        items += [F.lit(k), F.lit(v)]
    return F.create_map(*items)


def dict_map(c, mapping: Mapping, default=None) -> Column:
    """Look a value up in a literal mapping; unmapped gives ``default``.

    The mapping is a literal ``map`` value inside the projection: no join and
    no shuffle; it is bounded by the size of the code-level dictionary.
    """
    looked = _map_literal(mapping)[col(c)]
    return looked if default is None else F.coalesce(looked, F.lit(default))


def dict_replace(c, mapping: Mapping) -> Column:
    """Replace mapped values, keep the rest unchanged."""
    return F.coalesce(_map_literal(mapping)[col(c)], col(c))


def sentinel_null(c, sentinel=0) -> Column:
    """Sentinel value to NULL."""
    return F.when(col(c) != F.lit(sentinel), col(c))


def first_group(c, pattern: str, group: int = 1) -> Column:
    """First regex group, no match gives NULL (H1).

    Spark returns '' for no match; pandas returns NaN.
    """
    return F.nullif(F.regexp_extract(col(c), pattern, group), F.lit(""))


def first_token(c, delim: str = ",") -> Column:
    """Text before the first delimiter (H2)."""
    return F.split_part(col(c), F.lit(delim), F.lit(1))


def _ws_tokens(c) -> Column:
    # Python's str.split(): split on runs of whitespace, no empty tokens.
    return F.filter(F.split(col(c), r"[\s\x0B\x1C-\x1F\x85\p{Z}]+"), lambda w: w != "")


def last_token(c) -> Column:
    """Last whitespace-separated token (H3); NULL if there is none."""
    return F.try_element_at(_ws_tokens(c), F.lit(-1))


def to_number(c, default=0.0) -> Column:
    """Parse as double; unparsable or NULL gives ``default`` (H4)."""
    parsed = col(c).try_cast("double")
    return F.coalesce(parsed, F.lit(default)) if default is not None else parsed


def first_char(c, missing: str = "U") -> Column:
    """First character; NULL gives ``missing`` (H5)."""
    return F.coalesce(F.substring(col(c), 1, 1), F.lit(missing))


def token_count(c) -> Column:
    """Number of whitespace tokens; NULL gives 0 (H6)."""
    return F.coalesce(F.size(_ws_tokens(c)), F.lit(0))


def boxcox1p(c, lam: float = 0.15) -> Column:
    """Box-Cox of ``1 + x``: ((1+x)^lam - 1)/lam, lam = 0 gives log1p.

    Values below -1 have no real transform and give NULL.
    """
    x = col(c)
    if lam == 0:
        body = F.log1p(x)
    else:
        body = (F.pow(F.lit(1.0) + x, F.lit(float(lam))) - 1) / F.lit(float(lam))
    return F.when(x >= -1, body)


def composite_key(*cols, sep: str = "_") -> Column:
    """Concatenate values as text with a separator (H9)."""
    return F.concat_ws(sep, *[col(c).cast("string") for c in cols])
