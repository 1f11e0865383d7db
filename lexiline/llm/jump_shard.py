"""Shards by jump consistent hashing: a key and the shard count decide, and no ring table is kept.

The published generator (key * 2862933555777941757 + 1, modulo 2**64) is computed in built-in expressions with
products of at most 48 bits, so that no step overflows a long. A key jumps from bucket to bucket until it would leave
the last one; appending a shard moves rows into the new shard only.

Cases: a null key counts as key -1; null texts count as empty; equal rows keep their multiplicity and get
consecutive slots; an empty table gives an empty layout; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MULTIPLIER = 2862933555777941757  # fixed value of the published function
LOW32 = (1 << 32) - 1
LOW16 = (1 << 16) - 1
HEAD = 48  # jumps that every row is given; the few rows that need more get the rest
BLOCKS = 1 << 10  # parts of a shard that are ordered on their own


def low32(c: Column) -> Column:
    return c.bitwiseAND(F.lit(LOW32))


def times(c: Column, factor: int) -> Column:
    """c * factor modulo 2**32, for c and factor below 2**32."""
    return low32(c * (factor & LOW16) + F.shiftleft((c * (factor >> 16)).bitwiseAND(F.lit(LOW16)), 16))


def advance(hi: Column, lo: Column) -> tuple[Column, Column]:
    """The generator's next state, as two halves of 32 bits."""
    c_hi, c_lo = MULTIPLIER >> 32, MULTIPLIER & LOW32
    low, mid = lo * (c_lo & LOW16) + 1, lo * (c_lo >> 16)
    low = low + F.shiftleft(mid.bitwiseAND(F.lit(LOW16)), 16)
    carry = F.shiftright(low, 32) + F.shiftright(mid, 16)
    return low32(carry + times(lo, c_hi) + times(hi, c_lo)), low32(low)


def jump(key: Column, shards: int) -> Column:
    """Bucket of a long key among `shards` (int, from 0)."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    key = F.coalesce(key.cast("long"), F.lit(-1).cast("long"))
    zero = F.lit(0).cast("long")
    start = F.struct(F.shiftrightunsigned(key, 32).alias("hi"), low32(key).alias("lo"), zero.alias("b"), zero.alias("j"))

    def step(s: Column, _: Column) -> Column:
        hi, lo = advance(s["hi"], s["lo"])
        # (key >> 33) + 1 uses the upper 31 bits, and the quotient may pass any shard count
        ahead = F.floor((s["j"] + 1).cast("double") * (float(1 << 31) / (F.shiftright(hi, 1) + 1).cast("double"))).cast("long")
        return F.when(s["j"] < shards, F.struct(hi.alias("hi"), lo.alias("lo"), s["j"].alias("b"), ahead.alias("j"))).otherwise(s)

    # The bucket grows with each jump, so `shards` jumps suffice; nearly all rows are done after a few.
    state = F.aggregate(F.sequence(F.lit(1), F.lit(min(shards, HEAD))), start, step)
    if shards > HEAD:
        state = F.when(state["j"] >= shards, state).otherwise(F.aggregate(F.sequence(F.lit(HEAD + 1), F.lit(shards)), state, step))
    return state["b"].cast("int")


def block_of(key: Column, crc: Column, blocks: int) -> Column:
    """Block of a row: the top of the generator's low half, started from the key and the text's checksum together."""
    mixed = F.coalesce(key, F.lit(-1).cast("long")).bitwiseXOR(crc)
    _, lo = advance(F.shiftrightunsigned(mixed, 32), low32(mixed))
    return F.floor(lo / ((1 << 32) // blocks)).cast("int")


def layout(docs: DataFrame, shards: int = 24, key: str = "doc_id", text: str = "text", blocks: int = BLOCKS) -> DataFrame:
    """One row per document: its shard, its gapless slot in the shard, and its shard if one more were appended.

    Equal rows are counted before the shuffle. Slots are running sums inside blocks of a shard, plus the total of the
    blocks before; no task sees a whole shard, and one row per block is carried over. The rows alone decide the slots,
    not the layout of the table or the settings of the session; `blocks` is a power of two.
    """
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = (
        docs.select(F.col(key).cast("long").alias("doc_id"), F.octet_length(body).cast("long").alias("bytes"), F.crc32(body).alias("text_crc32"))
        .groupBy("doc_id", "bytes", "text_crc32")
        .agg(F.count("*").alias("copies"))
        .withColumn("shard", jump(F.col("doc_id"), shards))
        .withColumn("block", block_of(F.col("doc_id"), F.col("text_crc32"), blocks))
    )
    totals = rows.groupBy("shard", "block").agg(F.sum("copies").alias("rows"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("shard", "block", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("shard", "block").orderBy("doc_id", "bytes", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("first", F.coalesce(F.sum("copies").over(inside), F.lit(0))).join(carried, ["shard", "block"])
    slots = F.explode(F.sequence(F.col("base") + F.col("first"), F.col("base") + F.col("first") + F.col("copies") - 1))
    return placed.select("*", slots.alias("slot")).select(
        "doc_id",
        (F.col("bytes") + 8).alias("size"),
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        "slot",
        jump(F.col("doc_id"), shards + 1).alias("grown_shard"),
    )
