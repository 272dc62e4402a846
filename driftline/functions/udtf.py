"""Certificates for SQL callers as table functions, and encoders as column functions."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql.functions import pandas_udf, udtf


@udtf(returnType="m bigint, z bigint, bound double")
class Certify:
    """SELECT * FROM certify(d, exact, w, ids, k) over the arrays of one query's candidates."""

    def eval(self, d: list, exact: list, w: list, ids: list, k: int) -> Iterator[tuple[int, int, float]]:
        n = len(d)
        if n <= k:
            yield n, 0, 1.0
            return
        low = [x if e else 0.0 if math.isinf(r) else max(0.0, x - r) for x, e, r in zip(d, exact, w, strict=True)]
        high = [x if e else x + r for x, e, r in zip(d, exact, w, strict=True)]
        order = sorted(range(n), key=lambda i: (d[i], ids[i]))
        edge, kth = min(low[i] for i in order[k:]), sorted(high)[k - 1]
        m, z = sum(high[i] < edge for i in order[:k]), sum(low[i] <= kth for i in order[k:])
        yield m, z, max(0, m, k - z) / k


@udtf(returnType="item_id bigint, r int")
class Ambiguous:
    """SELECT * FROM ambiguous(d, exact, w, ids, k, most) over the arrays of one query's candidates."""

    def eval(self, d: list, exact: list, w: list, ids: list, k: int, most: int) -> Iterator[tuple[int, int]]:
        rows = sorted(zip(d, ids, exact, w, strict=True))
        span = lambda x, e, r: (x, x) if e else (0.0 if math.isinf(r) else max(0.0, x - r), x + r)
        open_rows = [(x, i, span(x, e, r)) for x, i, e, r in rows if not e]
        if len(rows) >= k:
            at, _, e, r = rows[k - 1]
            low, high = span(at, e, r)
            shared = [(round(min(b, high) - max(a, low), 9), round(abs(x - at), 9), i) for x, i, (a, b) in open_rows]
            open_rows = [(None, i, None) for o, _, i in sorted(shared, key=lambda s: (-s[0], s[1], s[2])) if o >= 0]
        for n, (_, i, _) in enumerate(open_rows[:most], 1):
            yield i, n


def encoder(encode: Callable[[list], list]) -> Callable[[Column], Column]:
    """A column function from a model's ``encode``, which takes a list of texts (or image paths) and gives a vector for
    each; it is called with whole batches. A translator of vectors is such a function of vectors."""

    @pandas_udf("array<double>")
    def run(batch: pd.Series) -> pd.Series:
        return pd.Series([[float(x) for x in v] for v in encode(batch.tolist())])

    return run


#: Encoders by name; applications add their own.
ENCODERS: dict[str, Callable[[list], list]] = {}


def load_encoder(name: str) -> Callable[[Column], Column]:
    if name not in ENCODERS:
        raise KeyError(f"no encoder {name}; known: {sorted(ENCODERS)}")
    return encoder(ENCODERS[name])


def register(spark: SparkSession) -> None:
    spark.udtf.register("certify", Certify)
    spark.udtf.register("ambiguous", Ambiguous)
