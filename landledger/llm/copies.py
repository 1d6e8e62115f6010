"""Exact copies by two Bloom filters, in DataFrame operations only: rows that cannot have a copy never shuffle.

1. One pass over the texts writes each row's digest (SHA-256 of the text with white space made one space) and a row number.
   Columns to be carried are written beside them; only what a later step needs is read again.
2. A row's key is a word of the filter and `PROBES` bits in it, both hashed from the digest. Equal keys are counted where
   they lie, so a large group of copies sends one row from each task. Each word then takes its keys one after the other:
   a key that the first filter already holds, or that came more than once, goes into the second filter.
3. A row whose bits are not all set in the second filter has no copy and passes straight through. The others, real copies
   and some half per cent of false alarms, shuffle by digest: groups are counted with map-side sums and attached again,
   large ones by a broadcast of at most `HOT_GROUPS` groups.

The first filter grows with the rows (16 bits each) and lives as a distributed table, as the second does, which holds only
words with repeated keys. It is broadcast where it has at most `BROADCAST_WORDS` words; a larger one is met by a shuffled
join of digests, still without the texts.

Null texts count as empty, and empty texts are copies of each other. Of equal texts the row with the smallest key stays;
null keys come last, and rows that repeat the key count as copies of which the first written one stays. An empty table
gives an empty table. Other columns are ignored by mark() and kept by keep(), whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landledger.llm.shared import staged
from landledger.plans.skew import attach

BLANKS = r"[\x20\x09-\x0D]+"
BITS_A_ROW = 16
PROBES = 4
#: Of 16 bytes each, some 100 MB as a hash table of longs.
BROADCAST_WORDS = 2_000_000
#: Groups of copies that are broadcast hold more than rows / HOT_GROUPS rows each, and at least LEAST_HOT.
HOT_GROUPS, LEAST_HOT = 10_000, 500


def _digests(docs: DataFrame, text: str, key: str, carried: list[str]) -> DataFrame:
    normal = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), BLANKS, " ")
    rows = docs.select(
        F.struct(*[docs[c] for c in carried], F.lit(0).alias("_")).alias("doc"), docs[key].alias("key"),
        F.unhex(F.sha2(normal.cast("binary"), 256)).alias("digest"), F.monotonically_increasing_id().alias("row"),
    )
    return staged(rows, "copies")[0]


def _keys(rows: DataFrame, words: int) -> DataFrame:
    """Adds the filter's word and bits of each row."""
    mask = " | ".join(f"shiftleft(1L, cast(shiftrightunsigned(bits, {6 * k}) & 63 AS INT))" for k in range(PROBES))
    keyed = rows.withColumns({"word": F.pmod(F.xxhash64("digest"), F.lit(words)), "bits": F.xxhash64("digest", F.lit(1))})
    return keyed.withColumn("mask", F.expr(mask)).drop("bits")


def second_filter(rows: DataFrame, words: int) -> DataFrame:
    """Words of the filter of repeated keys: `word` and its bits, `again`."""
    counted = _keys(rows.select("digest"), words).groupBy("word", "mask").agg(F.count("*").alias("n"))
    # a word's distinct keys, four on average
    listed = counted.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("mask", "n"))).alias("keys"))
    none = F.lit(0).cast("long")

    def insert(held: Column, k: Column) -> Column:
        again = (k["n"] > 1) | (held["first"].bitwiseAND(k["mask"]) == k["mask"])
        return F.struct(
            held["first"].bitwiseOR(k["mask"]).alias("first"),
            F.when(again, held["second"].bitwiseOR(k["mask"])).otherwise(held["second"]).alias("second"),
        )

    filters = F.aggregate("keys", F.struct(none.alias("first"), none.alias("second")), insert)
    return listed.select("word", filters["second"].alias("again")).where(F.col("again") != 0)


def _resolved(docs: DataFrame, text: str, key: str, carried: list[str], broadcast_words: int) -> DataFrame:
    """Each row with its group's size and the row of it that stays, `keeper`."""
    rows = _digests(docs, text, key, carried)
    many = rows.count()
    words = 1 << max(0, many * BITS_A_ROW // 64).bit_length()
    repeated, _ = staged(second_filter(rows, words), "repeated")
    if repeated.count() <= broadcast_words:
        repeated = F.broadcast(repeated)
    suspected = F.coalesce(F.col("again").bitwiseAND(F.col("mask")) == F.col("mask"), F.lit(False))
    probed = _keys(rows, words).join(repeated, "word", "left").withColumn("suspected", suspected).drop("word", "mask", "again")
    suspects, clear = probed.where("suspected"), probed.where("NOT suspected")
    own = F.struct(F.col("key").isNull().alias("unnamed"), "key", "row")
    # groups with more than a ten-thousandth of all rows, so at most 10,000, are broadcast and their rows spread
    met = attach(suspects, ["digest"], {"group_size": F.count("*"), "keeper": F.min(own)}, ["row"], max(LEAST_HOT, many // HOT_GROUPS))
    return met.unionByName(clear.withColumns({"group_size": F.lit(1).cast("long"), "keeper": own}))


def mark(docs: DataFrame, text: str = "text", key: str = "doc_id", broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """Per row: the key, keep_id, group_size, kept and text_sha256 of the normalised text."""
    rows = _resolved(docs, text, key, [], broadcast_words)
    return rows.select(F.col("key").alias(key), F.col("keeper.key").alias("keep_id"), "group_size", F.expr("keeper.row = row").alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def keep(docs: DataFrame, text: str = "text", key: str = "doc_id", broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """The rows that stay, with the columns of docs."""
    rows = _resolved(docs, text, key, docs.columns, broadcast_words)
    return rows.where("keeper.row = row").select(*[F.col("doc")[c].alias(c) for c in docs.columns])
