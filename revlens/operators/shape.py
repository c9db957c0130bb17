"""Joins, ranking, dedup and reshaping (§2.5, §2.8)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType


def _order(value: str, key: str | Sequence[str], ascending: bool = False) -> list[Column]:
    keys = [key] if isinstance(key, str) else list(key)
    v = F.col(value).asc() if ascending else F.col(value).desc()
    return [v] + [F.col(k).asc_nulls_last() for k in keys]


def top_k_sorted(df: DataFrame, value: str, key: str | Sequence[str], k: int, ascending: bool = False) -> DataFrame:
    """First ``k`` rows by ``value`` (desc by default) with the key as tie-break.

    Plans as TakeOrderedAndProject: each task keeps its own top ``k``, so only
    ``k × tasks`` rows meet in the final merge.
    """
    return df.orderBy(*_order(value, key, ascending)).limit(k)


def number_top(top: DataFrame, value: str, key: str | Sequence[str], rank_col: str = "rank",
               ascending: bool = False) -> DataFrame:
    """Rank 1..k of a top-k result, in the order of ``top_k_sorted``.

    ``top`` holds at most ``k`` rows, so they are gathered into one bounded
    array, sorted by (value, then key ascending, NULLs last) with an explicit
    comparator and numbered by ``posexplode``: no window without a partition.
    """
    keys = [key] if isinstance(key, str) else list(key)
    cols = top.columns

    def cmp(a, b):
        va, vb = a[value], b[value]
        null_side = -1 if ascending else 1  # NULL value: first when ascending, last when descending (as Spark)
        c = (F.when(va.isNull() & vb.isNotNull(), F.lit(null_side))
             .when(va.isNotNull() & vb.isNull(), F.lit(-null_side))
             .when(va < vb, F.lit(-1 if ascending else 1)).when(va > vb, F.lit(1 if ascending else -1)))
        for k in keys:
            ka, kb = a[k], b[k]
            c = (c.when(ka.isNull() & kb.isNotNull(), F.lit(1)).when(ka.isNotNull() & kb.isNull(), F.lit(-1))
                 .when(ka < kb, F.lit(-1)).when(ka > kb, F.lit(1)))
        return c.otherwise(F.lit(0))

    arr = F.array_sort(F.collect_list(F.struct(*[F.col(f"`{c}`") for c in cols])), cmp)
    return (top.agg(arr.alias("_a")).select(F.posexplode("_a").alias("_p", "_r"))
            .select(*[F.col("_r").getField(c).alias(c) for c in cols], (F.col("_p") + 1).alias(rank_col)))


def rank_rows(df: DataFrame, value: str, key: str | Sequence[str], k: int, rank_col: str = "rank") -> DataFrame:
    """Top ``k`` with a running rank 1..k, assigned on the ``k`` kept rows only."""
    return number_top(top_k_sorted(df, value, key, k), value, key, rank_col)


def sort_by_key(df: DataFrame, *keys: str) -> DataFrame:
    return df.orderBy(*[F.col(k).asc_nulls_last() for k in keys])


def reverse_order(df: DataFrame, *cols: str) -> DataFrame:
    """Ascending order of a ranked result, for display; name the key last, so ties have one order."""
    return df.orderBy(*[F.col(c).asc() for c in cols])


def number_shown(df: DataFrame, name: str = "position") -> DataFrame:
    """The rows of a small sorted result (a top list, a table of classes) with
    their places 1, 2, … as a column, so that the order survives a sink."""
    # the result is sorted, so ids rise along it; the array is put in their order, whatever order it was gathered in
    at = F.struct(F.monotonically_increasing_id().alias("at"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    rows = F.array_sort(F.collect_list("_r"), lambda a, b: F.signum(a["at"] - b["at"]).cast("int"))
    return (df.select(at.alias("_r")).agg(rows.alias("_rows")).select(F.posexplode("_rows").alias("_at", "_r"))
            .select("_r.row.*", (F.col("_at") + 1).cast("int").alias(name)))


def row_hash(df: DataFrame) -> Column:
    """A 64-bit hash of the whole row; maps, which have no hash, by their JSON."""
    return F.xxhash64(*[F.to_json(F.col(f"`{f.name}`")) if isinstance(f.dataType, MapType) else F.col(f"`{f.name}`")
                        for f in df.schema.fields])


def key_hashes(key: Column) -> tuple[Column, Column]:
    """(256-bit digest, 64-bit hash) of a key as text, the two that ``dedup_keep_first`` tells keys apart by."""
    text = key.cast("string")
    return F.unhex(F.sha2(F.coalesce(F.concat(F.lit("+"), text), F.lit("-")), 256)), F.xxhash64(text)


def dedup_keep_first(df: DataFrame, key: str, order: str, hashed: Sequence[str] = ()) -> DataFrame:
    """One row per ``key`` value: the one with the smallest ``order``.

    Any ids will do: of rows that share the smallest id the one with the
    smallest row hash stays, of equal rows one; a key none of whose rows has an
    id keeps the row with the smallest hash. NULL keys are one group.

    Grouped by a 256-bit digest of the key with the smallest id as a plain hash
    aggregate, so copies collapse map-side and a long text is neither sorted nor
    used as a shuffle key; the rows kept are then found by a semi join on the
    id, which keeps the rows where an earlier join on it put them. Rows without
    an id are one key per digest before they meet the others.

    ``hashed`` names columns that hold ``key_hashes`` of the key already: then the key itself is not read (the row
    hash is of the other columns), and crosses no exchange unless the result's reader wants it.
    """
    cols = df.columns
    digest, text_hash = (F.col(f"`{c}`") for c in hashed) if hashed else key_hashes(F.col(f"`{key}`"))
    x = df.withColumns({"_o": F.col(f"`{order}`"), "_k": text_hash, "_h": row_hash(df.drop(key) if hashed else df)})
    known = x.where("_o is not null")
    first = known.groupBy(digest.alias("_d")).agg(F.min("_o").alias("_first"), F.max("_k").alias("_first_k"))
    # the key's hash is compared beside the join, so that the id alone decides where rows go
    same = (F.col("_o") == F.col("_first")) & (F.col("_k").bitwiseXOR(F.col("_first_k")) == 0)
    kept = known.join(first.select("_first", "_first_k"), same, "left_semi")
    at = F.row_number().over(Window.partitionBy("_o", "_k").orderBy("_h"))
    kept = kept.withColumn("_n", at).where("_n = 1").select(*[f"`{c}`" for c in cols])
    if not df.schema[order].nullable:
        return kept
    unknown = x.where("_o is null")
    lone = (unknown.groupBy(digest.alias("_d")).agg(F.min("_h").alias("_first_h"), F.max("_k").alias("_first_k"))
            .join(first.select("_d"), "_d", "left_anti"))
    same = (F.col("_h") == F.col("_first_h")) & (F.col("_k") == F.col("_first_k"))
    at = F.row_number().over(Window.partitionBy("_h", "_k").orderBy(F.lit(1)))
    lone = (unknown.join(lone.select("_first_h", "_first_k"), same, "left_semi").withColumn("_n", at).where("_n = 1")
            .select(*[f"`{c}`" for c in cols]))
    return kept.unionByName(lone)


def distinct_options(df: DataFrame, col: str, all_value: str = "All", name: str = "option") -> DataFrame:
    """Sorted distinct non-NULL values with ``All`` first."""
    vals = df.select(F.col(col).cast("string").alias(name)).where(F.col(name).isNotNull()).distinct()
    first = df.sparkSession.range(1).select(F.lit(all_value).alias(name))
    return (vals.withColumn("_o", F.lit(1)).unionByName(first.withColumn("_o", F.lit(0)))
            .orderBy("_o", name).drop("_o"))


def union_rows(df: DataFrame, extra: DataFrame) -> DataFrame:
    return df.unionByName(extra)


def melt(df: DataFrame, value_cols: Sequence[str], id_cols: Sequence[str] = (), var_name: str = "variable",
         value_name: str = "value") -> DataFrame:
    return df.unpivot(list(id_cols), list(value_cols), var_name, value_name)


def expand_struct(df: DataFrame, struct_col: str) -> DataFrame:
    others = [c for c in df.columns if c != struct_col]
    return df.select(*others, f"{struct_col}.*")


def join_group_count(df: DataFrame, group: str, cols: Sequence[str], count_name: str = "count") -> DataFrame:
    """Per-group means (NaN is missing) aligned with per-group counts: one aggregate, no join."""
    return df.where(F.col(group).isNotNull()).groupBy(group).agg(
        *[F.avg(F.nanvl(F.col(c).cast("double"), F.lit(None))).alias(f"mean_{c}") for c in cols],
        F.count(F.lit(1)).alias(count_name))


def semi_join_top(df: DataFrame, col: str, k: int) -> DataFrame:
    """Rows whose ``col`` is among the ``k`` most frequent values (ties by value).

    The right side holds at most ``k`` rows, so broadcasting it is safe at any scale.
    """
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("_n"))
    top = top_k_sorted(counts, "_n", col, k).select(col)
    return df.join(F.broadcast(top), on=col, how="left_semi")


def semi_join_qualified(df: DataFrame, group: str | Sequence[str], n: int) -> DataFrame:
    """Rows of groups having at least ``n`` rows (HAVING + semi join).

    The qualified-group table has one row per group: it is measured and
    broadcast when small (``join_small``), so a hot group is never shuffled
    into one task.
    """
    keys = [group] if isinstance(group, str) else list(group)
    q = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= n).select(*keys)
    return join_small(df, q, on=keys, how="left_semi")


def left_join_domain(df: DataFrame, key: str, domain: Sequence, order_col: str = "position") -> DataFrame:
    """Reindex a keyed result onto a fixed ordered domain; absent keys give NULLs."""
    spark = df.sparkSession
    dom = spark.createDataFrame([(i, v) for i, v in enumerate(domain)], f"{order_col} int, {key} string")
    return dom.join(df, on=key, how="left").orderBy(order_col)


def join_scores(df: DataFrame, scores: DataFrame, key: str) -> DataFrame:
    """Attach score columns by key (left join: unscored rows keep NULL scores)."""
    return df.join(scores, on=key, how="left")


def _bytes_of(field) -> Column:
    """Bytes of one value as stored in a row: 8 for fixed widths, the measured length of anything else."""
    from pyspark.sql import types as T
    fixed = (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DateType,
             T.TimestampType, T.TimestampNTZType)
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, fixed):
        return F.lit(8)
    text = c if isinstance(field.dataType, (T.StringType, T.BinaryType)) else F.to_json(F.struct(c))
    return F.lit(8) + F.coalesce(F.octet_length(text), F.lit(0))


# Byte budget for broadcasting a measured per-key table.
BROADCAST_BUDGET_BYTES = 64 << 20


def join_small(big: DataFrame, small: DataFrame, on, how: str = "inner",
               budget_bytes: int = BROADCAST_BUDGET_BYTES) -> DataFrame:
    """Join a large frame with a per-key table that is usually small (one row
    per group, per label, per target).

    Joining on a low-cardinality key by shuffle would send each hot key's rows
    to one task, so the small side is materialised in the shared checkpoint
    folder and measured: it is broadcast only when the bytes of its rows (texts
    by their actual lengths) fit ``budget_bytes``; beyond that both sides shuffle on the key and AQE splits
    skewed partitions.
    """
    from ..session import checkpoint_root
    checkpoint_root(big.sparkSession)
    s = small.checkpoint()
    size = sum((_bytes_of(f) for f in s.schema.fields), F.lit(16))
    fits = (s.agg(F.sum(size.cast("long"))).first()[0] or 0) <= budget_bytes
    return big.join(F.broadcast(s) if fits else s, on=on, how=how)
