"""References to records that do not exist (problem 4).

Keys are dictionary-encoded as dense integers within key ranges of at most
about 2^15 keys, so that one range is one bitmap.  Per (key range, period) a
bitmap holds the keys referred to and one the parents that exist by then;
`reference AND-NOT parent` leaves the keys whose references may be orphans in
that period.  Surviving bits are decoded through the dictionary and only the
rows that refer to them are looked at again, with exact times.

The bitmaps are aggregates (`bitmap_construct_agg`), combined before the
shuffle, so a key that a third of all rows refer to is one bit from every task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkloom.common import Scratch, clean_path

#: Bits of one bitmap, as `bitmap_construct_agg` has them.
RANGE_BITS = 32_768
#: Keys of one range on average; the slack keeps hashed ranges within RANGE_BITS.
RANGE_FILL = 24_000


@dataclass(frozen=True)
class Reference:
    """Rows (ref_id, key, at) of one field that refers to the parents of `kind`."""

    ref_table: str
    ref_field: str
    kind: str
    rows: DataFrame


def pack(raw: bytes) -> bytes:
    """A bitmap as a sorted array of 16-bit positions or, if that is longer, as its bits; a leading byte tells which."""
    bits = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")
    places = np.flatnonzero(bits).astype("<u2")
    return b"a" + places.tobytes() if 2 * len(places) < len(raw) else b"b" + bytes(raw)


def unpack(packed: bytes) -> np.ndarray:
    """The RANGE_BITS bits of a packed bitmap, as bytes of 0 and 1."""
    if packed[:1] == b"b":
        bits = np.unpackbits(np.frombuffer(packed, np.uint8, offset=1), bitorder="little")
        return np.pad(bits, (0, RANGE_BITS - len(bits)))
    bits = np.zeros(RANGE_BITS, np.uint8)
    bits[np.frombuffer(packed, "<u2", offset=1)] = 1
    return bits


@F.pandas_udf(T.BinaryType())
def _pack(raw: pd.Series) -> pd.Series:
    return raw.map(pack)


@F.pandas_udf(T.ArrayType(T.BinaryType()))
def _running(bitmaps: pd.Series) -> pd.Series:
    """For packed bitmaps in the order of their periods: those of each period and all before it, packed."""
    out = []
    for several in bitmaps:
        bits, held = np.zeros(RANGE_BITS, np.uint8), []
        for bitmap in several:
            bits |= unpack(bitmap)
            held.append(pack(np.packbits(bits, bitorder="little").tobytes()))
        out.append(held)
    return pd.Series(out)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _and_not(references: pd.Series, parents: pd.Series) -> pd.Series:
    """Positions in a packed reference bitmap that the packed bitmap of the parents before its period has not."""
    out = []
    for r, p in zip(references, parents):
        bits = unpack(r)
        out.append(np.flatnonzero(bits if p is None else bits & ~unpack(p) & 1).astype(np.int32))
    return pd.Series(out)


def dictionary(keys: DataFrame) -> DataFrame:
    """kind, key, range, bit: each distinct key's dense integer within its hashed range.

    The number of ranges follows the number of keys; a range that hashing
    overfills goes on in a further range, so no key is lost.
    """
    from pyspark.sql import Window

    keys = keys.distinct()
    ranges = keys.groupBy("kind").agg(F.ceil(F.count("*") / RANGE_FILL).alias("ranges"))
    placed = keys.join(F.broadcast(ranges), "kind").withColumn("slot", F.pmod(F.xxhash64("kind", "key"), F.col("ranges")))
    number = F.row_number().over(Window.partitionBy("kind", "slot").orderBy("key")) - 1
    return placed.withColumn("n", number).select("kind", "key", F.concat_ws("/", "slot", F.floor(F.col("n") / RANGE_BITS)).alias("range"), (F.col("n") % RANGE_BITS).alias("bit"))


def orphans(references: list[Reference], parents: DataFrame) -> DataFrame:
    """ref_table, ref_field, ref_id, month of each reference that had no parent when it was made.

    `parents` has kind, key, since (its first arrival) and gone (true if it is
    deleted).  A reference is an orphan if its key has no parent row, or the
    parent is gone, or it arrived after the reference's `at`.  Null keys are no
    references.  A null `at` counts as before everything, so only a missing or
    gone parent makes it an orphan; a null `since` means that it never came.
    One row per ref_id and field, however often the referring row is repeated.

    A range's parents are or-ed along its periods once, so each reference bitmap
    meets one parent bitmap.  In the last join the suspects have one row a key
    and period, so adaptive execution may split the rows of a key that a third
    of them name.
    """
    spark = parents.sparkSession
    scratch = Scratch(spark, "orphans")
    rows = None
    for r in references:
        part = r.rows.where(F.col("key").isNotNull()).select(F.lit(r.ref_table).alias("ref_table"), F.lit(r.ref_field).alias("ref_field"), F.lit(r.kind).alias("kind"), F.col("key").cast("string"), "ref_id", "at", F.coalesce(F.date_format("at", "yyyy-MM"), F.lit("9999-99")).alias("month"))
        rows = part if rows is None else rows.unionByName(part)
    rows = scratch.cut(rows)
    held = scratch.cut(parents.where(F.col("key").isNotNull()).select("kind", F.col("key").cast("string"), "since", "gone").groupBy("kind", "key").agg(F.min("since").alias("since"), F.min("gone").alias("gone")))

    used = rows.groupBy("kind", "key", "month").agg(F.count("*").alias("refs"))
    used = scratch.cut(used)
    words = scratch.cut(dictionary(used.select("kind", "key")))  # keys nobody refers to need no code

    coded = used.join(words, ["kind", "key"])
    asked = coded.groupBy("kind", "range", "month").agg(_pack(F.bitmap_construct_agg("bit")).alias("asked"))
    live = held.where(~F.coalesce("gone", F.lit(False)) & F.col("since").isNotNull()).withColumn("month", F.date_format("since", "yyyy-MM"))
    there = live.join(words, ["kind", "key"]).groupBy("kind", "range", "month").agg(F.bitmap_construct_agg("bit").alias("bits"))
    there = there.select("kind", "range", "month", _pack("bits").alias("bits")).groupBy("kind", "range").agg(F.array_sort(F.collect_list(F.struct("month", "bits"))).alias("there"))
    there = there.select("kind", "range", F.col("there.month").alias("months"), _running(F.col("there.bits")).alias("running"))
    before = F.size(F.filter("months", lambda q: q < F.col("month")))  # the months come in order
    earlier = F.when(before > 0, F.get("running", before - 1))
    left = asked.join(there, ["kind", "range"], "left").select("kind", "range", "month", "asked", earlier.alias("earlier"))
    left = left.select("kind", "range", "month", F.explode(_and_not("asked", "earlier")).alias("bit"))
    suspects = left.join(words, ["kind", "range", "bit"]).select("kind", "key", "month").join(held, ["kind", "key"], "left")

    late = F.col("since").isNull() | F.coalesce("gone", F.lit(False)) | (F.col("since") > F.col("at"))
    hit = rows.join(suspects, ["kind", "key", "month"]).where(late)
    return hit.select("ref_table", "ref_field", "ref_id", "month").distinct()


def chunk_parents(chunks: DataFrame) -> DataFrame:
    """Chunks as parents: first arrival, and whether the row with the greatest updated_at (null lowest) is deleted."""
    state = F.max_by(F.coalesce("is_deleted", F.lit(False)), F.struct(F.coalesce("updated_at", F.lit("0001-01-01").cast("timestamp")), F.coalesce("is_deleted", F.lit(False))))
    return chunks.groupBy(F.col("id").cast("string").alias("key")).agg(F.min("created_at").alias("since"), state.alias("gone")).withColumn("kind", F.lit("chunk"))


def standard(chunks: DataFrame, files: DataFrame, entities: DataFrame, attributes: DataFrame, dependencies: DataFrame) -> DataFrame:
    """The orphans of the three references: attributes to chunks, dependencies to entities, chunks to files.

    -1 in chunk_id means no chunk.  Paths are compared cleaned; an empty path is
    no reference.
    """
    path = clean_path(F.col("file_path"))
    refs = [
        Reference("chunks", "file_path", "file", chunks.select(F.col("id").alias("ref_id"), F.when(path != "", path).alias("key"), F.col("created_at").alias("at"))),
        Reference("entity_attributes", "chunk_id", "chunk", attributes.where(F.col("chunk_id") != -1).select(F.col("id").alias("ref_id"), F.col("chunk_id").alias("key"), F.col("created_at").alias("at"))),
        Reference("entity_dependencies", "target_entity", "entity", dependencies.where(F.col("target_entity") != -1).select(F.col("id").alias("ref_id"), F.col("target_entity").alias("key"), F.col("created_at").alias("at"))),
    ]
    no = F.lit(False).alias("gone")
    parents = chunk_parents(chunks).select("kind", "key", "since", "gone")
    parents = parents.unionByName(entities.select(F.lit("entity").alias("kind"), F.col("id").cast("string").alias("key"), F.col("created_at").alias("since"), no))
    parents = parents.unionByName(files.select(F.lit("file").alias("kind"), clean_path(F.col("path")).alias("key"), F.col("indexed_at").alias("since"), no))
    return orphans(refs, parents)


def report(found: DataFrame) -> DataFrame:
    """Orphans per table, field and month."""
    return found.groupBy("ref_table", "ref_field", "month").agg(F.count("*").alias("orphans"))
