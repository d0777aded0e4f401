"""Folds over each key's rows in order, for what depends on its own growing result.

Rows are dealt by key and sorted, and a task streams through them: it holds one batch and the rows of one key, and calls the fold once for each key on plain tuples.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Fold = Callable[[list[tuple]], list[tuple]]


def fold_keys(df: DataFrame, columns: Sequence[str], order: Sequence[str], fold: Fold, schema: str, *, errors: bool = False) -> DataFrame:
    """For each ``key`` of ``df``, which must not be null, what ``fold`` makes of its rows' ``columns`` in ``order``: rows of key and ``schema``.

    DRV2: with ``errors`` there is a column ``error`` besides. A key whose fold raises gives one row with the exception's text there and nulls elsewhere, and the other keys go on.
    """
    kind = df.schema["key"].dataType.simpleString()
    names = ["key", *(part.split()[0] for part in schema.split(", "))]
    if errors:
        schema, blank = f"{schema}, error string", (None,) * (len(names) - 1)
        names, plain = [*names, "error"], fold

        def fold(rows: list[tuple]) -> list[tuple]:
            try:
                return [(*r, None) for r in plain(rows)]
            except Exception as e:
                return [(*blank, repr(e))]

    def folded(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        keys = pdf["key"].to_numpy()
        edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        rows = list(zip(*(pdf[c].tolist() for c in columns), strict=True))
        out = [(keys[a], *r) for a, b in zip(edges, edges[1:], strict=False) if b > a for r in fold(rows[a:b])]
        if out:
            yield pd.DataFrame(out, columns=names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            keys = pdf["key"].to_numpy()
            if not len(keys):
                continue
            other = np.flatnonzero(keys != keys[-1])
            cut = int(other[-1]) + 1 if len(other) else 0
            if held and (cut or held[0]["key"].iloc[0] != keys[0]):
                yield from folded(pd.concat([*held, pdf.iloc[:cut]]))
                held = []
            elif cut:
                yield from folded(pdf.iloc[:cut])
            held.append(pdf.iloc[cut:])
        if held:
            yield from folded(pd.concat(held))

    # A window deals and sorts rows by key only where they aren't already, which repartition would do once more.
    nth = F.row_number().over(Window.partitionBy("key").orderBy(*order))
    return df.select("key", *columns).withColumn("_nth", nth).mapInPandas(run, f"key {kind}, {schema}")
