"""Best N items of every group by a secondary sort.

Rows are sorted by (group, score descending, item) inside each partition and streamed as Arrow batches; a
group is never held in memory, only the at most N items already given out. The same kernel first runs on
the unshuffled input, so a shuffle moves at most N rows of a group per input partition, however hot it is.

Defined results: rows whose item is null or whose score is null or NaN do not count. An item counts once,
with its highest score. Equal scores are ordered by item ascending; -0.0 equals 0.0. A null group column is
a group value like any other. An empty table gives no rows. Columns not named are dropped, so extra columns
cannot clash.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _codes(column):
    return pc.dictionary_encode(column, null_encoding="encode").indices.to_numpy(zero_copy_only=False)


def _same(a: tuple, b: tuple) -> bool:
    return all(x == y or (x != x and y != y) for x, y in zip(a, b))


def _stream(groups: int, n: int, with_pos: bool):
    """Kernel over sorted batches: columns are the groups, then item, then score."""

    def run(batches):
        import numpy as np

        last: tuple | None = None
        given: list = []
        for batch in batches:
            size = batch.num_rows
            if size == 0:
                continue
            cut = np.zeros(size, dtype=bool)
            for c in range(groups):
                codes = _codes(batch.column(c))
                cut[1:] |= codes[1:] != codes[:-1]
            first = tuple(batch.column(c)[0].as_py() for c in range(groups))
            cut[0] = last is None or not _same(first, last)
            last = tuple(batch.column(c)[size - 1].as_py() for c in range(groups))
            items = batch.column(groups)
            codes = _codes(items).tolist()
            starts = np.flatnonzero(cut).tolist()
            take: list[int] = []
            pos: list[int] = []

            def scan(begin: int, end: int, seen: set, count: int) -> int:
                for i in range(begin, end):
                    if count >= n:
                        break
                    if codes[i] not in seen:
                        seen.add(codes[i])
                        count += 1
                        take.append(i)
                        pos.append(count)
                return count

            head = starts[0] if starts else size
            if head and len(given) < n:  # the group that began in an earlier batch
                dictionary = pc.dictionary_encode(items)
                where = {v: k for k, v in enumerate(dictionary.dictionary.to_pylist())} if given else {}
                seen = {where[v] for v in given if v in where}
                at = len(take)
                scan(0, head, seen, len(given))
                given += [items[i].as_py() for i in take[at:]]
            for k, begin in enumerate(starts):
                end = starts[k + 1] if k + 1 < len(starts) else size
                at = len(take)
                scan(begin, end, set(), 0)
                if end == size:
                    given = [items[i].as_py() for i in take[at:]]
            if take:
                out = pa.Table.from_batches([batch]).take(pa.array(take, pa.int64()))
                if with_pos:
                    out = out.append_column("pos", pa.array(pos, pa.int32()))
                yield from out.combine_chunks().to_batches()

    return run


def top_n_per_group(df: DataFrame, groups: list[str], item: str, score: str, n: int) -> DataFrame:
    """Columns ``groups``, ``item``, ``score`` and ``pos`` (1..n) of the best ``n`` items of each group."""
    if n < 0:
        raise ValueError("n must not be negative")
    rows = df.select(*groups, item, (F.col(score).cast("double") + F.lit(0.0)).alias(score)).where(
        F.col(item).isNotNull() & F.col(score).isNotNull() & ~F.isnan(score)
    )
    if n == 0:
        rows = rows.where(F.lit(False))
    order = [*(F.col(g) for g in groups), F.col(score).desc(), F.col(item)]
    local = rows.sortWithinPartitions(*order).mapInArrow(_stream(len(groups), n, False), rows.schema)
    schema = T.StructType([*rows.schema.fields, T.StructField("pos", T.IntegerType())])
    merged = local.repartition(*groups) if groups else local.coalesce(1)
    return merged.sortWithinPartitions(*order).mapInArrow(_stream(len(groups), n, True), schema)
