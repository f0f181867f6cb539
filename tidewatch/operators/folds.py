"""Sequential operators as folds over keyed, ordered rows, with state of bounded size.

Rows are hashed by key and sorted inside each partition (both spill), and a task walks through them once, carrying one key's state from
batch to batch: no key's rows are ever held together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fold(df: DataFrame, key: list[str], order: list[str], make: Callable[[], Callable], columns: list[str], schema: str, flush: bool = False) -> DataFrame:
    """``make()`` gives a step for each key; ``step(*values)`` of ``columns`` gives a tuple for ``schema``'s columns after the key, or None.

    With ``flush``, ``step(None)`` is called after a key's last row. Rows whose key is null have one state too.
    """
    chosen = df.select(*key, *order, *[c for c in columns if c not in key + order])
    wanted = f"{', '.join(f'{c} {dict(chosen.dtypes)[c]}' for c in key)}, {schema}"
    names = [x.strip().split(" ")[0].strip("`") for x in _split(wanted)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, step = None, None
        for batch in batches:
            out = []
            for k, values in zip(batch[key].itertuples(index=False, name=None), batch[columns].itertuples(index=False, name=None)):
                if step is None or (k != now and not _same(k, now)):
                    if step is not None and flush and (row := step(None)) is not None:
                        out.append((*now, *row))
                    now, step = k, make()
                if (row := step(*values)) is not None:
                    out.append((*k, *row))
            yield pd.DataFrame(out, columns=names)
        if step is not None and flush and (row := step(None)) is not None:
            yield pd.DataFrame([(*now, *row)], columns=names)

    # A stated number of partitions isn't coalesced by size: a step costs far more time than its row has bytes. The keys' hash is dealt by,
    # not the keys, as rows that lie by key already may do so in a single partition.
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = chosen.repartition(n, F.xxhash64(*key)).sortWithinPartitions(*key, *order)
    return ordered.mapInPandas(run, wanted)


def _same(a: tuple, b: tuple) -> bool:
    """Equal keys, where null (NaN in a column of numbers) is equal to itself."""
    return all(x == y or (x != x and y != y) for x, y in zip(a, b))


def _split(schema: str) -> list[str]:
    """A DDL string at its outer commas."""
    out, depth, part = [], 0, ""
    for c in schema:
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append(part)
            part = ""
        else:
            part += c
    return [*out, part]
