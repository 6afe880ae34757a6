"""Positional numbering inside a group without putting the group in one task.

``row_number().over(Window.partitionBy(batch).orderBy(...))`` sorts a whole
batch inside one task, which fails once one batch holds a large share of the
data. ``sequence_within`` gives the same dense 1..n numbering with bounded,
deterministic tasks:

1. every row gets a *chunk* key, a function of its order key that never
   decreases along the order (for a dense position p: (p - 1) div width);
2. ``row_number`` inside (group, chunk) -- a chunk holds at most ``width``
   positions, so the window's tasks are bounded however large the group is;
3. rows per (group, chunk), a table with about n / width rows per group;
   a running sum over the chunks of a group gives each chunk's offset;
4. the offsets are joined back: number = offset + local number. What has one
   row a group can come with them, so the rows are not exchanged for it again.

The join keeps all rows of its left side, so a plan that does not read the
number drops both (an offset's keys are unique) and exchanges nothing.

No partition ids, sampling or driver round-trips are involved, so a retried
task recomputes exactly the same numbers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Positions per chunk. A chunk is one window task's unit of work; 2^20 rows of a
# few columns sort comfortably in executor memory.
DEFAULT_CHUNK_ROWS = 1 << 20


def position_chunk(position: str | Column, width: int = DEFAULT_CHUNK_ROWS) -> Column:
    """Chunk key for a dense 1-based position column."""
    p = F.col(position) if isinstance(position, str) else position
    return F.floor((p - F.lit(1)) / F.lit(width)).cast("long")


def sequence_within(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence,
                    name: str, chunk_cols: Sequence[Column],
                    flag: Column | None = None, flag_name: str | None = None,
                    by_group: DataFrame | None = None) -> DataFrame:
    """Add ``name`` = dense 1-based position of each row inside its group.

    ``chunk_cols`` must be non-decreasing along ``order_cols`` within a group
    (the order is (chunk_cols, order_cols) lexicographically). Ties in
    ``order_cols`` are numbered arbitrarily but completely, like ``row_number``.
    With ``flag`` (a boolean column), ``flag_name`` is also added: the position
    among the flagged rows of the group (NULL on unflagged rows), in the same
    pass. The further columns of ``by_group`` are added as a left join on the
    group columns would (a missing group meets none).
    """
    # Plain, never-null key columns: the join of the offsets then reuses the
    # window's partitioning, so the rows are exchanged once.
    keyed, keys, n_group, own = df, [], 0, {}
    for i, c in enumerate([*map(F.col, group_cols), *chunk_cols]):
        field = df.select(c).schema[0]
        if i < len(group_cols) and not field.nullable:
            keys.append(group_cols[i])
        elif not field.nullable:
            keyed = keyed.withColumn(f"_seq_k{i}", c)
            keys.append(f"_seq_k{i}")
        else:
            keyed = keyed.withColumns({f"_seq_k{i}": F.coalesce(c, F.lit(0).cast(field.dataType)),
                                       f"_seq_z{i}": c.isNull()})
            # A missing value sorts before all others, as in the order itself.
            keys += [f"_seq_z{i}", f"_seq_k{i}"]
            if i < len(group_cols):  # exchanged as its key alone
                own[group_cols[i]] = F.when(~F.col(f"_seq_z{i}"), F.col(f"_seq_k{i}"))
        n_group = len(keys) if i < len(group_cols) else n_group
    if flag is not None:
        keyed = keyed.withColumn("_seq_f", F.when(flag, F.lit(1)).otherwise(F.lit(0)))
    local_w = Window.partitionBy(*keys).orderBy(*order_cols)
    local = keyed.withColumn("_seq_local", F.row_number().over(local_w))
    if flag is not None:
        running = local_w.rowsBetween(Window.unboundedPreceding, 0)
        local = local.withColumn("_seq_flocal", F.sum("_seq_f").over(running))

    # Rows per chunk: tasks count their own rows of the key columns first, so
    # only the (group, chunk) counts are exchanged.
    size_aggs = [F.count(F.lit(1)).alias("_seq_n")]
    if flag is not None:
        size_aggs.append(F.sum("_seq_f").alias("_seq_fn"))
    sizes = keyed.groupBy(*keys).agg(*size_aggs)
    before = (Window.partitionBy(*keys[:n_group]).orderBy(*(
        F.col(k).desc() if k.startswith("_seq_z") else F.col(k) for k in keys[n_group:]))
              .rowsBetween(Window.unboundedPreceding, -1))
    offset_cols = [F.coalesce(F.sum("_seq_n").over(before), F.lit(0)).alias("_seq_before")]
    if flag is not None:
        offset_cols.append(F.coalesce(F.sum("_seq_fn").over(before), F.lit(0)).alias("_seq_fbefore"))
    offsets = sizes.select(*keys, *offset_cols)
    more = []
    if by_group is not None:
        more = [c for c in by_group.columns if c not in group_cols]
        named = offsets.select("*", *(own.get(c, F.col(c)).alias(f"_seq_g{i}") for i, c in enumerate(group_cols)))
        by = by_group.select(*more, *(F.col(c).alias(f"_seq_b{i}") for i, c in enumerate(group_cols)))
        same = [F.col(f"_seq_g{i}") == F.col(f"_seq_b{i}") for i in range(len(group_cols))]
        offsets = named.join(by, same, "left").select(*offsets.columns, *more)
    out = local.join(offsets, keys, "left")
    out = out.withColumn(name, (F.col("_seq_before") + F.col("_seq_local")).cast("long"))
    if flag is not None:
        out = out.withColumn(flag_name, F.when(F.col("_seq_f") == 1, (
            F.col("_seq_fbefore") + F.col("_seq_flocal")).cast("long")))
    return out.select(*(own.get(c, F.col(c)).alias(c) for c in df.columns), name,
                      *([flag_name] if flag is not None else []), *more)


def rank_positions(df: DataFrame, group_cols: Sequence[str], position: str, name: str,
                   width: int = DEFAULT_CHUNK_ROWS, flag: Column | None = None,
                   flag_name: str | None = None, by_group: DataFrame | None = None) -> DataFrame:
    """Dense rank of a unique position column among the rows of ``df``.

    With ``position`` = the row's place in its export (dense 1..n over all rows
    of the batch), each chunk holds at most ``width`` rows of ``df``.
    """
    return sequence_within(df, group_cols, [position], name,
                           [position_chunk(position, width)], flag, flag_name, by_group)
