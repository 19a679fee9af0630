"""The keys that a store holds, found without reading all of them.

Keys are dealt to buckets by their md5. A bucket has the keys themselves and a
Bloom filter: PROBES bits for each key in SLICES bitmaps of 32,768. A lookup
reads the filters of the buckets that its keys fall in, and opens the keys of
only those buckets where a filter admits one; for new keys that is almost none,
however many keys the store has. Both tables are partitioned by bucket, so the
buckets that a lookup leaves out are not listed either.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import ensure_checkpoint_dir

PROBES = 3
#: Bits of one bitmap aggregate.
BITMAP = 32768


@dataclass(frozen=True)
class KeyLayout:
    """How keys are dealt: a filter has ``slices`` bitmaps; about ten bits for each key of a bucket keep it selective."""

    buckets: int = 64
    slices: int = 4


def keys_of(rows: DataFrame) -> DataFrame:
    """Distinct keys of rows with link_key and content_key."""
    both = F.array(F.concat(F.lit("l:"), "link_key"), F.concat(F.lit("c:"), "content_key"))
    return rows.select(F.explode(both).alias("key")).where("key is not null").distinct()


def _part(key: str, at: int, digits: int) -> Column:
    return F.conv(F.substring(F.md5(F.col(key)), at, digits), 16, 10).cast("long")


def dealt(keys: DataFrame, layout: KeyLayout) -> DataFrame:
    """bucket, key and the positions of its bits."""
    bits = [_part("key", 5 + 8 * k, 8) % (layout.slices * BITMAP) for k in range(PROBES)]
    return keys.select((_part("key", 1, 4) % layout.buckets).cast("int").alias("bucket"), "key", F.array(*bits).alias("bits"))


def filters_of(placed: DataFrame) -> DataFrame:
    """bucket, slice, bitmap of keys with their positions."""
    bits = placed.select("bucket", F.explode("bits").alias("bit"))
    place = F.col("bit") % BITMAP
    return bits.groupBy("bucket", F.expr(f"cast(bit div {BITMAP} as int)").alias("slice")).agg(F.bitmap_construct_agg(place).alias("bitmap"))


def _is_set(bitmap: Column, place: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, (place % 8).cast("int")) == 1


@dataclass
class Lookup:
    """``known``: the asked keys that are stored; what it took to find them."""

    known: DataFrame
    buckets_asked: int
    buckets_opened: int
    files_opened: int


def look_up(asked: DataFrame, stored: DataFrame | None, filters: DataFrame | None, layout: KeyLayout) -> Lookup:
    """Which of ``asked`` (key) are in ``stored`` (bucket, key). The numbers of at most ``layout.buckets`` buckets come to the driver."""
    ensure_checkpoint_dir(asked.sparkSession)
    placed = dealt(asked.distinct(), layout).checkpoint()
    numbers = lambda df: sorted(r["bucket"] for r in df.select("bucket").distinct().collect())
    wanted = numbers(placed)
    if stored is None or filters is None or not wanted:
        return Lookup(placed.select("key").limit(0), len(wanted), 0, 0)
    # One row for each bucket asked, of ``layout.slices`` bitmaps of 4 KB, so it is small enough to broadcast.
    maps = filters.where(F.col("bucket").isin(wanted)).groupBy("bucket", "slice").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
    maps = maps.groupBy("bucket").agg(F.map_from_entries(F.collect_list(F.struct("slice", "bitmap"))).alias("maps"))
    on = F.forall("bits", lambda bit: F.coalesce(_is_set(F.try_element_at("maps", F.floor(bit / BITMAP).cast("int")), bit % BITMAP), F.lit(False)))
    admitted = placed.join(F.broadcast(maps), "bucket").where(on).select("bucket", "key").checkpoint()
    opened = numbers(admitted)
    if not opened:
        return Lookup(placed.select("key").limit(0), len(wanted), 0, 0)
    held = stored.where(F.col("bucket").isin(opened))
    files = held.select(F.input_file_name().alias("file")).distinct().count()
    return Lookup(admitted.join(held, ["bucket", "key"], "left_semi").select("key").distinct(), len(wanted), len(opened), files)


def split(known: DataFrame) -> DataFrame:
    """Keys as link_key and content_key, one of them null in each row."""
    of = lambda mark: F.when(F.startswith("key", F.lit(mark)), F.expr("substring(key, 3)"))
    return known.select(of("l:").alias("link_key"), of("c:").alias("content_key"))
