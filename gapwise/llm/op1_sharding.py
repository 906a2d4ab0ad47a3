"""Sharding by a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a table of prime size.  Shards take turns, each claiming its
first slot that is still free, until all are taken; so every shard has the same share of slots, give or take
one, and adding or removing a shard moves few others.  The table is broadcast, and a key is placed by one look-up.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Hexadecimal digits of an md5 that make a number; 15 of them fit a signed 64-bit integer.
DIGITS = 15


@dataclass(frozen=True)
class ShardParams:
    """shards: names, in turn order.  slots: a prime, about a hundred times the shards or more.  hot: share of all rows
    above which a key is divided.
    """

    shards: tuple[str, ...] = tuple(f"shard-{i:03d}" for i in range(32))
    slots: int = 4099
    hot: float = 1 / 128


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:DIGITS], 16)


def fill_table(params: ShardParams) -> list[int]:
    """For each slot the number of its shard.  Bounded by the table, which the caller chooses."""
    size, shards = params.slots, params.shards
    if not shards or len(set(shards)) < len(shards) or size < max(2, len(shards)):
        raise ValueError("shards must be distinct, and at least as many slots as shards")
    if any(size % d == 0 for d in range(2, int(size**0.5) + 1)):
        raise ValueError("the number of slots must be a prime: else some orders miss slots")
    first = [_number(f"offset:{s}") % size for s in shards]
    skip = [_number(f"skip:{s}") % (size - 1) + 1 for s in shards]
    table, turn = [-1] * size, 0
    following = list(first)
    for _ in range(size):
        slot = following[turn]
        while table[slot] >= 0:
            slot = (slot + skip[turn]) % size
        table[slot] = turn
        following[turn] = (slot + skip[turn]) % size
        turn = (turn + 1) % len(shards)
    return table


def number_of(keys: list[Column]) -> Column:
    """A key of one or more columns as a number: its md5.

    A missing part is not an empty one, and parts cannot run into each other.
    """
    parts = [
        F.when(c.isNull(), "-").otherwise(F.concat(F.length(c.cast("string")), F.lit(":"), c.cast("string")))
        for c in keys
    ]
    digits = F.substring(F.md5(F.concat(*parts).cast("binary")), 1, DIGITS)
    return F.conv(digits, 16, 10).cast("long")


def slot_of(keys: list[Column], slots: int) -> Column:
    """Slot of a key: its number modulo the slots."""
    return F.pmod(number_of(keys), F.lit(slots)).cast("int")


def slot_table(df: DataFrame, params: ShardParams) -> DataFrame:
    """``slot``, ``shard`` for a broadcast: as many short rows as slots, whatever the data."""
    table = fill_table(params)
    rows = [(slot, params.shards[shard]) for slot, shard in enumerate(table)]
    return df.sparkSession.createDataFrame(rows, "slot int, shard string")


def assign_shards(
    df: DataFrame,
    keys: list[str],
    params: ShardParams = ShardParams(),
    spread: list[str] | None = None,
    parts: int = 1,
    slot_column: str = "slot",
    shard_column: str = "shard",
) -> DataFrame:
    """``df`` with the slot and the shard of each row; every row is placed, null keys as a key of their own.

    Rows of equal keys share a shard.  For a key that may hold a large part of all rows, ``spread`` names columns
    that divide it into ``parts`` keys, which go to shards of their own.  Columns of the result's names are replaced.
    An empty table gives an empty result.
    """
    columns = [F.col(f"`{k}`") for k in keys]
    if spread and parts > 1:
        columns.append(slot_of([F.col(f"`{c}`") for c in spread], parts))
    named = slot_table(df, params).select(F.col("slot").alias("__slot"), F.col("shard").alias("__shard"))
    own = [F.col(f"`{c}`") for c in df.columns if c not in (slot_column, shard_column)]
    placed = df.withColumn("__slot", slot_of(columns, params.slots)).join(F.broadcast(named), "__slot")
    return placed.select(*own, F.col("__slot").alias(slot_column), F.col("__shard").alias(shard_column))


def hot_keys(df: DataFrame, keys: list[str], params: ShardParams = ShardParams()) -> DataFrame:
    """``keys`` and ``__parts`` of the keys with more than the share ``hot`` of all rows: fewer than 1 / hot rows.

    Parts are so many that each holds about that share.  Rows are counted per key before the shuffle.
    """
    names = [F.col(f"`{k}`") for k in keys]
    counts = df.select(*names).groupBy(*names).agg(F.count("*").alias("__rows"))
    most = df.agg(F.count("*") * params.hot).scalar()
    return counts.where(F.col("__rows") > most).select(*names, F.ceil(F.col("__rows") / most).alias("__parts"))


def place_evenly(
    df: DataFrame,
    keys: list[str],
    spread: list[str],
    params: ShardParams = ShardParams(),
    slot_column: str = "slot",
    shard_column: str = "shard",
) -> DataFrame:
    """Like :func:`assign_shards`, but hot keys are found, and only those are divided, by ``spread``.

    Rows of a hot key that are equal in ``spread`` stay together.
    """
    hot = hot_keys(df, keys, params)
    columns = [F.col(f"`{k}`") for k in keys]
    renamed = hot.select(*[F.col(f"`{k}`").alias(f"__hot_{i}") for i, k in enumerate(keys)], "__parts")
    same = reduce(and_, [c.eqNullSafe(F.col(f"__hot_{i}")) for i, c in enumerate(columns)])
    marked = df.join(F.broadcast(renamed), same, "left")
    part = F.pmod(number_of([F.col(f"`{c}`") for c in spread]), F.col("__parts"))
    slot = F.when(F.col("__parts").isNull(), slot_of(columns, params.slots)).otherwise(
        slot_of([*columns, part], params.slots)
    )
    named = slot_table(df, params).select(F.col("slot").alias("__slot"), F.col("shard").alias("__shard"))
    own = [F.col(f"`{c}`") for c in df.columns if c not in (slot_column, shard_column)]
    placed = marked.withColumn("__slot", slot).join(F.broadcast(named), "__slot")
    return placed.select(*own, F.col("__slot").alias(slot_column), F.col("__shard").alias(shard_column))


def shard_sizes(placed: DataFrame, shard_column: str = "shard") -> DataFrame:
    """Rows per shard."""
    return placed.groupBy(shard_column).agg(F.count("*").alias("rows"))


def write_shards(placed: DataFrame, path: str, shard_column: str = "shard", files: int = 8) -> None:
    """One folder per shard with up to ``files`` files each, so that a shard is not one task."""
    part = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in placed.columns if c != shard_column]), F.lit(files))
    placed.repartition(F.col(shard_column), part).write.partitionBy(shard_column).parquet(path)


def read_shards(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of all shards in ``path``, with ``schema``."""
    return spark.read.schema(schema).parquet(path).select(*[F.col(f"`{c}`") for c in schema.names])


def moved_slots(before: ShardParams, after: ShardParams) -> float:
    """Share of slots whose shard differs; both tables must have the same size."""
    old, new = fill_table(before), fill_table(after)
    if len(old) != len(new):
        raise ValueError("tables of different size")
    differ = sum(before.shards[a] != after.shards[b] for a, b in zip(old, new))
    return differ / len(old)


def oracle(params: ShardParams = ShardParams()) -> str:
    """Placement of ``documents`` by ``doc_id``, hot ones divided by text, for DuckDB; the table is filled by a recursion."""
    size, count = params.slots, len(params.shards)
    names = ", ".join(f"'{s}'" for s in params.shards)

    def number(text: str) -> str:
        return f"('0x' || substr(md5({text}), 1, {DIGITS}))::BIGINT"

    def key(text: str) -> str:
        return f"CASE WHEN {text} IS NULL THEN '-' ELSE length({text}) || ':' || {text} END"

    return f"""
WITH RECURSIVE names AS (SELECT [{names}] AS s),
orders AS (
  SELECT list_transform(s, lambda x: {number("'offset:' || x")} % {size}) AS off,
         list_transform(s, lambda x: {number("'skip:' || x")} % {size - 1} + 1) AS skip
  FROM names
),
fill(step, slot, taken) AS (
  SELECT 0, NULL::BIGINT, list_transform(range({size}), lambda x: false)
  UNION ALL
  SELECT step + 1, pick, list_transform(range({size}), lambda x: x = pick OR taken[x + 1])
  FROM (
    SELECT step, taken,
      list_filter(
        list_transform(range({size}), lambda j: (off[step % {count} + 1] + j * skip[step % {count} + 1]) % {size}),
        lambda p: NOT taken[p + 1])[1] AS pick
    FROM fill, orders WHERE step < {size}
  )
),
slots AS (SELECT slot, s[(step - 1) % {count} + 1] AS shard FROM fill, names WHERE step > 0),
hot AS (
  SELECT coalesce(doc_id::VARCHAR, '-') AS k, ceil(count(*) / (any_value(n) * {params.hot}))::BIGINT AS parts
  FROM documents, (SELECT count(*) AS n FROM documents) GROUP BY 1 HAVING count(*) > any_value(n) * {params.hot}
),
keyed AS (
  SELECT d.*, {key("d.doc_id::VARCHAR")} AS own, {number(key("d.text"))} % h.parts AS part
  FROM documents d LEFT JOIN hot h ON h.k = coalesce(d.doc_id::VARCHAR, '-')
),
placed AS (
  SELECT *, ({number("own || coalesce(length(part::VARCHAR) || ':' || part, '')")} % {size})::INTEGER AS slot FROM keyed
)
SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5, slot, shard FROM placed JOIN slots USING (slot)
"""
