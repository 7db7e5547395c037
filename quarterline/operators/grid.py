"""Gap-free grids: every combination of a set of columns has a row."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarterline.session import shuffle_partitions, stage


def value_product(df: DataFrame, keys: Sequence[str], side: int = 16) -> DataFrame:
    """All combinations of the distinct values of ``keys``.

    Each further key joins on a ``side`` x ``side`` board of hash blocks: a value of
    either side goes to its row or column of the board, so that the product is spread
    over ``side`` squared groups whatever the number of values on one side.
    """

    def block(*columns: str) -> Column:
        return F.pmod(F.xxhash64(*columns), F.lit(side)).cast("int")

    every_block = F.explode(F.sequence(F.lit(0), F.lit(side - 1)))
    first, *others = keys
    product, held = df.select(first).distinct(), [first]
    for key in others:
        left = product.withColumn("_i", block(*held)).withColumn("_j", every_block)
        right = df.select(key).distinct().withColumn("_j", block(key)).withColumn("_i", every_block)
        product = left.join(right, ["_i", "_j"]).drop("_i", "_j")
        held.append(key)
    return product


def complete_grid(
    df: DataFrame, keys: Sequence[str], across: Sequence[str | Sequence[str]]
) -> DataFrame:
    """Add a row, NULL in the other columns, for every combination ``df`` lacks.

    ``keys``    columns with any number of values, for example the mechanism.
    ``across``  label columns with few values, for example category and period; an
                entry of several names is one nested dimension (period and its key).
                Their values travel as a constant list, not through a join; ``complete_wide`` takes many values.

    ``df`` holds at most one row per combination, as the result of an aggregation
    does; a duplicate raises. All rows of a key are placed together once, so the
    merge here and later windows that partition by the keys add no shuffle.
    """
    dims = [(d,) if isinstance(d, str) else tuple(d) for d in across]
    keys = list(keys)
    if not keys:
        keys, dims = list(dims[0]), dims[1:]
        grid = df.select(*keys).distinct()
    else:
        grid = value_product(df, keys)
    places = shuffle_partitions(df.sparkSession)
    grid = grid.repartition(places, *keys)
    for names in dims:
        values = df.agg(F.sort_array(F.collect_set(F.struct(*names))).alias("v")).scalar()
        grid = grid.withColumn("_d", F.explode(values)).select("*", "_d.*").drop("_d")

    cell = [*keys, *[name for names in dims for name in names]]
    others = [name for name in df.columns if name not in cell]
    marked = df.withColumn("_row", F.lit(1)).repartition(places, *keys)
    merged = (
        marked.unionByName(grid, allowMissingColumns=True)
        .groupBy(*cell)
        .agg(F.count("_row").alias("_rows"), *[F.max(name).alias(name) for name in others])
    )
    unique = F.assert_true(F.col("_rows") <= 1, F.lit("complete_grid: more than one row per cell"))
    return merged.filter(unique.isNull()).select(*df.columns)


#: values of a wide dimension that travel together
CHUNK = 256


def complete_wide(df: DataFrame, keys: Sequence[str], wide: str, fill: Mapping[str, object] | None = None) -> DataFrame:
    """``complete_grid`` for one dimension with any number of values, such as the mechanism.

    A row for every combination of ``keys`` that ``df`` has with every value of ``wide`` that it has; other columns are
    NULL in added rows, or as ``fill`` says. A second row for a combination raises. NULL is a value, in keys and in ``wide``.

    The values are dealt by hash into chunks of about ``CHUNK``, a row each; only their number reaches the driver. Rows of
    ``df`` are gathered by key and chunk, at most a chunk's worth in one row, and a key meets each
    chunk in a row that is shuffled before it unfolds: what is moved is ``df``, the values, and a row per key and chunk, never the grid.
    """
    others = [name for name in df.columns if name not in (*keys, wide)]
    kinds = {name: df.schema[name].dataType for name in others}
    values = stage(df.select(wide).distinct())
    count = max(1, -(-values.count() // CHUNK))

    def chunk(column: str) -> Column:
        return F.pmod(F.xxhash64(F.lit("chunk"), column), F.lit(count)).cast("int")

    places = [F.col(name).alias(f"_k{i}") for i, name in enumerate(keys)]
    names = [f"_k{i}" for i in range(len(keys))]
    given = df.groupBy(*places, chunk(wide).alias("_chunk")).agg(
        F.collect_list(F.struct(F.struct(F.col(wide).alias("v")).alias("key"), F.struct(*[
            F.lit(True).alias("_given"), *[F.col(name).alias(f"_o{i}") for i, name in enumerate(others)]]).alias("value"))).alias("_rows"))
    # one side has a row per chunk: dealing it out to several places keeps keys that meet it apart
    side = F.explode(F.sequence(F.lit(0), F.lit(_SIDE - 1)))
    chunks = values.groupBy(chunk(wide).alias("_chunk")).agg(
        F.collect_list(F.struct(F.col(wide).alias("v"))).alias("_values")).withColumn("_side", side)
    board = df.select(*places).distinct().withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))).withColumn(
        "_side", F.pmod(F.xxhash64(*names, F.lit("side")), F.lit(_SIDE)).cast("int"))
    met = board.join(chunks, ["_chunk", "_side"]).drop("_side")
    same = met["_chunk"] == given["_chunk"]
    for name in names:
        same = same & met[name].eqNullSafe(given[name])
    cells = met.join(given, same, "left").select(
        *[met[name] for name in names], F.explode("_values").alias("_v"), F.map_from_entries("_rows").alias("_found"))
    row = F.col("_found")[F.col("_v")]
    added = fill or {}

    def value(i: int, name: str) -> Column:
        missing = F.lit(added.get(name)).cast(kinds[name])
        return F.when(row["_given"], row[f"_o{i}"]).otherwise(missing)

    columns = {name: F.col(f"_k{i}") for i, name in enumerate(keys)} | {wide: F.col("_v.v")}
    columns |= {name: value(i, name) for i, name in enumerate(others)}
    return cells.select(*[columns[name].alias(name) for name in df.columns])


#: places that the chunks of a wide dimension are dealt out to
_SIDE = 16


def complete_series(
    df: DataFrame, keys: Sequence[str], order: str, labels: Sequence[str] = ()
) -> DataFrame:
    """Add a row, NULL in the other columns, for every value of ``order`` that a group lacks
    before its last one.

    Groups are the combinations of ``keys`` that ``df`` has; no product of them is made.
    The values of ``order`` in the table, with their ``labels`` columns, are few (periods) and
    travel as a constant list. ``df`` holds at most one row per group and value; a duplicate raises.
    """
    dimension = [order, *labels]
    values = df.agg(F.sort_array(F.collect_set(F.struct(*dimension))).alias("v")).scalar()
    last = df.groupBy(*keys).agg(F.max(order).alias("_last"))
    cells = last.select(*keys, "_last", F.explode(values).alias("_d")).filter(
        F.col(f"_d.{order}") <= F.col("_last")).select(*keys, "_d.*")
    cell = [*keys, *dimension]
    others = [name for name in df.columns if name not in cell]
    merged = (
        df.withColumn("_row", F.lit(1)).unionByName(cells, allowMissingColumns=True)
        .groupBy(*cell)
        .agg(F.count("_row").alias("_rows"), *[F.max(name).alias(name) for name in others])
    )
    unique = F.assert_true(F.col("_rows") <= 1, F.lit("complete_series: more than one row per cell"))
    return merged.filter(unique.isNull()).select(*df.columns)
