"""Array functions: runs, common ends, containment, ordered matching (columns)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import IntegerType


def compress_runs(a: Column) -> Column:
    """Without empty strings, then without neighbours that repeat."""
    full = F.filter(a, lambda x: x.isNotNull() & (x != ""))
    return F.filter(full, lambda x, i: (i == 0) | (x != F.get(full, i - 1)))


def _leading(same: Column) -> Column:
    """How many leading values are true."""
    return F.aggregate(same, F.struct(F.lit(0).alias("n"), F.lit(True).alias("go")), lambda s, x: F.struct((s.n + F.when(s.go & x, 1).otherwise(0)).alias("n"), (s.go & x).alias("go")), lambda s: s.n)


def common_prefix(a: Column, b: Column) -> Column:
    return _leading(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y) & x.isNotNull()))


def common_suffix(a: Column, b: Column, prefix: Column) -> Column:
    """Length of the common end that a common beginning leaves room for."""
    n = common_prefix(F.reverse(a), F.reverse(b))
    return F.greatest(F.lit(0), F.least(n, F.least(F.size(a), F.size(b)) - prefix))


def contiguous_at(target: Column, query: Column) -> Column:
    """0-based start of the query in the target; -1 if it isn't there."""
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(target) - F.size(query) + 1, F.lit(1))), lambda i: F.slice(target, i, F.size(query)) == query)
    return F.when((F.size(query) == 0) | (F.size(query) > F.size(target)) | (F.size(starts) == 0), -1).otherwise(F.get(starts, F.lit(0)) - 1)


def ordered_matches(target: Column, query: Column) -> Column:
    """How many query words the target has in the query's order, from its first on."""
    return F.aggregate(target, F.lit(0), lambda n, t: n + F.when((n < F.size(query)) & (t == F.get(query, n)), 1).otherwise(0))


def contains_run(long: Column, short: Column, strict: bool = False) -> Column:
    ok = contiguous_at(long, short) >= 0
    return ok & (F.size(short) < F.size(long)) if strict else ok


def last(a: Column, n: int) -> Column:
    return F.slice(a, F.greatest(F.size(a) - n + 1, F.lit(1)), n)


def ordered_union(*arrays: Column) -> Column:
    """Distinct values in the order first seen; empties aside."""
    return F.array_distinct(F.filter(F.concat(*(F.coalesce(a, F.array().cast("array<string>")) for a in arrays)), lambda x: x.isNotNull() & (x != "")))


@pandas_udf(IntegerType())
def longest_common_run(a: pd.Series, b: pd.Series) -> pd.Series:
    """Length of the longest contiguous run that both arrays hold."""

    def one(x, y):
        best, before = 0, [0] * (len(y) + 1)
        for u in x:
            row = [0]
            for j, v in enumerate(y):
                row.append(before[j] + 1 if u == v else 0)
            best, before = max(best, max(row)), row
        return best

    return pd.Series([0 if x is None or y is None else one(list(x), list(y)) for x, y in zip(a, b)], dtype="int32")
