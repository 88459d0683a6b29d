"""Join helpers: dplyr key semantics and size-checked broadcasts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A side is broadcast only when it is measured to be below both bounds.
DEFAULT_BROADCAST_ROWS = 2_000_000
DEFAULT_BROADCAST_BYTES = 64 << 20


def _width(field: T.StructField) -> Column:
    """Bytes of a column's value: 8 for numbers and the like, the length of
    text and binary, and the length of the JSON text of nested values."""
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0))
    if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
        return F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0))
    return F.lit(8)


def is_small(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS,
             max_bytes: int = DEFAULT_BROADCAST_BYTES) -> bool:
    """Is ``df`` below both bounds?  Reads at most ``max_rows + 1`` rows."""
    width = F.lit(16)
    for f in df.schema.fields:
        width = width + _width(f)
    r = df.limit(max_rows + 1).agg(F.count(F.lit(1)).alias("n"), F.sum(width).alias("b")).first()
    return r["n"] <= max_rows and (r["b"] or 0) <= max_bytes


def broadcast_if_small(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS,
                       max_bytes: int = DEFAULT_BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint only behind a checked size; beyond the bounds the side
    is left to the shuffle join AQE chooses."""
    return F.broadcast(df) if is_small(df, max_rows, max_bytes) else df


def salted_join(big: DataFrame, other: DataFrame, on, how: str = "inner",
                salt_buckets: int = 32, hot_rows: int | None = 1_000_000,
                salt_from=None) -> DataFrame:
    """Equi-join that spreads hot keys of ``big`` over many tasks.

    A partial-aggregate pass counts ``big`` per key; keys with more than
    ``hot_rows`` rows are hot (at most rows / hot_rows of them, so the hot
    list is small and broadcast).  Rows of a hot key get one of
    ``ceil(count / hot_rows)`` salts from a hash of their own columns, so no
    task has much more than ``hot_rows`` of them, and the matching rows of
    ``other`` are replicated once per salt; every other key joins as usual
    (salt 0, no copies).  Rows of ``big`` with a NULL key match nothing: in a
    left join they go round the join and are added at the end.
    ``hot_rows=None`` gives every key ``salt_buckets`` salts.  ``how``:
    ``inner`` or ``left`` (``big`` preserved).
    """
    keys = [on] if isinstance(on, str) else list(on)
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    keyed, rest = big.where(whole), big.where(~whole)
    hashed = F.xxhash64(*(salt_from or big.columns))
    if hot_rows is None:
        b = keyed.withColumn("_salt", F.pmod(hashed, F.lit(salt_buckets)).cast("int"))
        o = other.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salt_buckets - 1))))
    else:
        hot = (keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
               .where(F.col("_n") > hot_rows)
               .select(*keys, F.ceil(F.col("_n") / hot_rows).cast("int").alias("_salts")))
        hot = F.broadcast(hot)
        salts = F.coalesce("_salts", F.lit(1))
        b = keyed.join(hot, keys, "left") \
            .withColumn("_salt", F.pmod(hashed, salts).cast("int")).drop("_salts")
        o = other.join(hot, keys, "left") \
            .withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    out = b.join(o, keys + ["_salt"], how).drop("_salt")
    return out.unionByName(rest, allowMissingColumns=True) if how == "left" else out


def broadcast_or_salted(big: DataFrame, other: DataFrame, on, how: str = "inner",
                        max_rows: int = DEFAULT_BROADCAST_ROWS, salt_buckets: int = 32,
                        hot_rows: int | None = 1_000_000) -> DataFrame:
    """Broadcast ``other`` when it is measured to be small; otherwise a
    shuffle join with hot keys salted (see ``salted_join``)."""
    if is_small(other, max_rows):
        return big.join(F.broadcast(other), on, how)
    return salted_join(big, other, on, how, salt_buckets, hot_rows)


def join_keys(left: DataFrame, right: DataFrame, keys, how: str = "inner",
              null_safe: bool = False) -> DataFrame:
    """Join on key pairs; ``keys`` is a list of names or ``(left, right)``
    pairs.  The right-hand key columns are dropped (dplyr ``by=``).
    ``null_safe`` makes NA match NA, as dplyr does.

    Right-hand keys are renamed before the join, so joining a table back
    onto its own lineage (an aggregate of itself, a checkpoint) is never
    ambiguous."""
    pairs = [(k, k) if isinstance(k, str) else tuple(k) for k in keys]
    tmp = {b: f"__r_{i}" for i, (_, b) in enumerate(pairs)}
    r = right.withColumnsRenamed(tmp)
    cond = [F.col(a).eqNullSafe(F.col(tmp[b])) if null_safe else F.col(a) == F.col(tmp[b])
            for a, b in pairs]
    out = left.join(r, cond, how)
    return out.drop(*tmp.values())


def natural_join(left: DataFrame, right: DataFrame, how: str = "left",
                 null_safe: bool = True) -> DataFrame:
    """Join on every shared column name (``left_join(x, y)`` with no ``by``)."""
    shared = [c for c in left.columns if c in set(right.columns)]
    if not shared:
        raise ValueError("natural join needs at least one shared column")
    return join_keys(left, right, shared, how, null_safe=null_safe)


def with_global(df: DataFrame, agg_col, name: str, materialize: bool = True) -> DataFrame:
    """Attach a whole-table aggregate (e.g. a mean line) to every row as a
    scalar subquery: one value, no cross join, no single-task window.  The
    input (read twice) is written once unless ``materialize=False``."""
    if materialize:
        from regioscope.session import cut_lineage
        df = cut_lineage(df)
    return df.withColumn(name, df.select(agg_col).scalar())


def union_all(frames: Sequence[DataFrame], fill_missing: bool = True) -> DataFrame:
    """Union by name; columns missing on one side become NULL."""
    frames = list(frames)
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=fill_missing)
    return out
