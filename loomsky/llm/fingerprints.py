"""Document fingerprints by one-permutation MinHash, in DataFrame functions only.

Every distinct word shingle is hashed once. The hash's high bits name one of ``bins`` bins, and each bin keeps the
least hash that fell into it. A bin that got none takes the value of a filled one, picked by a hash of the two bins
alone: as uniform, and as independent from bin to bin, as the probing of optimal densification (Shrivastava, 2017),
which it finds in one step. Of each value the low-order ``bits`` are kept, and written as hex digits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BINS, BITS, SHINGLE = 128, 8, 5
#: neighbours: rows in a bucket, cells of the first cut of the id range, and buckets at most
BUCKET_ROWS, CELLS, MOST_BUCKETS = 256, 4096, 1 << 20


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` where ``value`` is computed once, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def shingle_hashes(text: Column, n: int = SHINGLE) -> Column:
    """Sorted distinct 64-bit hashes of the runs of ``n`` words (lower-cased, split at ASCII white space).

    With fewer words, the hash of the whole sequence; of a null, an empty text or white space alone, none.
    """
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[ \t-\r]+"), lambda w: w != "")
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    runs = let(
        hashed,
        lambda w: F.when(
            F.size(w) > 0,
            F.transform(
                F.sequence(F.lit(0), F.greatest(F.size(w) - n, F.lit(0))),
                lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(n)]),
            ),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    return F.sort_array(F.array_distinct(runs))


def fingerprint_bins(hashes: Column, bins: int = BINS, bits: int = BITS) -> Column:
    """``bins`` numbers of ``bits`` bits for sorted ``hashes`` (array<smallint>); of no hashes, an empty array."""
    high, mask = 64 - (bins - 1).bit_length(), (1 << bits) - 1

    def bin_of(h: Column) -> Column:
        return F.shiftrightunsigned(h, high)

    def packed(sorted_: Column) -> Column:
        least = F.filter(sorted_, lambda h, i: (i == 0) | (bin_of(h) != bin_of(F.get(sorted_, i - 1))))
        return F.transform(least, lambda h: F.shiftleft(bin_of(h), bits).bitwiseOR(h.bitwiseAND(F.lit(mask))))

    def filled(got: Column) -> Column:
        empty = F.array_except(F.sequence(F.lit(0).cast("bigint"), F.lit(bins - 1).cast("bigint")), F.transform(got, lambda c: F.shiftright(c, bits)))

        def lent(i: Column) -> Column:
            rank = F.array_min(F.transform(got, lambda c: F.xxhash64(i, F.shiftright(c, bits)).bitwiseAND(F.lit(~mask)).bitwiseOR(c.bitwiseAND(F.lit(mask)))))
            return F.shiftleft(i, bits).bitwiseOR(rank.bitwiseAND(F.lit(mask)))

        return F.sort_array(F.concat(got, F.transform(empty, lent)))

    full = let(let(hashes, packed), lambda got: F.when(F.size(got) > 0, filled(got)).otherwise(got))
    return F.transform(full, lambda c: c.bitwiseAND(F.lit(mask)).cast("smallint"))


def as_text(values: Column, bits: int = BITS) -> Column:
    """Fingerprint numbers as hex digits; of an empty fingerprint, an empty string."""
    return F.array_join(F.transform(values, lambda v: F.lpad(F.hex(v), bits // 4, "0")), "")


def likeness(a: Column, b: Column, bits: int = BITS) -> Column:
    """Estimated Jaccard similarity of two fingerprints: the share of equal numbers, less the 2 ** -bits that
    agree by chance. 1 for two empty ones, 0 for an empty and another one."""
    chance = 2.0**-bits
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda m: m))
    share = equal / F.greatest(F.size(a), F.lit(1))
    return (
        F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0)
        .when((F.size(a) == 0) | (F.size(b) == 0), 0.0)
        .otherwise(F.greatest((share - chance) / (1 - chance), F.lit(0.0)))
    )


def fingerprints(docs: DataFrame, text: str = "text", *, bins: int = BINS, bits: int = BITS, shingle_words: int = SHINGLE) -> DataFrame:
    """``docs`` with a column ``fingerprint_bins``; ``as_text`` writes it, ``likeness`` compares two."""
    if bins & (bins - 1) or bits % 4 or not 4 <= bits <= 12:
        raise ValueError("bins must be a power of two, bits 4, 8 or 12")
    return docs.withColumn("fingerprint_bins", fingerprint_bins(shingle_hashes(F.col(text), shingle_words), bins, bits))


def with_next(docs: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``docs`` with ``next_<c>`` for each of ``columns``: the value in the row that follows by ``key``, and in the last
    row that of the first. Rows with equal keys follow each other by ``columns``; rows without a key come first.

    No task sees more than a bucket of neighbours. The key range is cut into equal cells, each cell between its own
    least and greatest key into buckets of about ``BUCKET_ROWS`` rows, at most ``MOST_BUCKETS`` in all. The first row of
    a bucket is copied to the end of the bucket before.
    """
    at = F.coalesce(F.col(key).cast("double"), F.lit(float("-inf")))
    low, high, rows = docs.agg(F.min(F.col(key).cast("double")), F.max(F.col(key).cast("double")), F.count("*")).first()
    low, span = low or 0.0, max((high or 0.0) - (low or 0.0), 1.0)
    target = max(BUCKET_ROWS, -(-rows // (MOST_BUCKETS - CELLS)))
    cell = F.when(F.col(key).isNull(), F.lit(-1)).otherwise(F.floor((at - low) / span * (CELLS - 1)).cast("int"))
    keyed = docs.withColumn("_cell", cell)
    cells = keyed.groupBy("_cell").agg(
        F.min(at).alias("_lo"), (F.max(at) - F.min(at)).alias("_span"), F.ceil(F.count("*") / target).alias("_parts")
    )
    keyed = keyed.join(F.broadcast(cells), "_cell")  # CELLS + 1 rows at most
    part = F.when(F.col("_span") > 0, F.floor((at - F.col("_lo")) / F.col("_span") * F.col("_parts")).cast("long")).otherwise(F.lit(0))
    keyed = keyed.withColumn("_part", part).drop("_lo", "_span", "_parts")

    in_order = Window.orderBy("_cell", "_part")
    firsts = (
        keyed.groupBy("_cell", "_part").agg(F.min(key).alias("_first"))
        .withColumn("_prev", F.lag(F.struct("_cell", "_part")).over(in_order))
        .withColumn("_wraps", F.col("_prev").isNull())
        .withColumn("_last", F.max(F.struct("_cell", "_part")).over(Window.partitionBy(F.lit(0))))
        .select("_first", F.coalesce("_prev", "_last").alias("_to"), "_wraps")
    )
    copies = (
        keyed.join(F.broadcast(firsts), F.col(key).eqNullSafe(F.col("_first")))  # MOST_BUCKETS rows at most
        .withColumns({"_cell": F.col("_to._cell"), "_part": F.col("_to._part"), "_copy": F.col("_wraps").cast("int") + 1})
        .drop("_first", "_to", "_wraps")
    )
    both = keyed.withColumn("_copy", F.lit(0)).unionByName(copies)
    order = Window.partitionBy("_cell", "_part").orderBy("_copy", F.col(key).asc_nulls_first(), *columns)
    return (
        both.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns})
        .where("_copy = 0").drop("_cell", "_part", "_copy")
    )


def edited_fingerprints(docs: DataFrame, *, bins: int = BINS, bits: int = BITS, shingle_words: int = SHINGLE) -> DataFrame:
    """Fingerprints of each text, of its edited form (its last quarter replaced by as much of the start of the next
    document's text, by doc_id; the first follows the last) and how like they are.

    Null texts count as empty. Rows that share a doc_id follow each other by text; rows without one come first. One row
    for each row of ``docs``; a single document is its own next. Other columns are ignored.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    base = fingerprints(base, bins=bins, bits=bits, shingle_words=shingle_words)
    near = with_next(base, "doc_id", ["text", "fingerprint_bins"])
    n = F.char_length("text")
    cut = F.floor(n / 4).cast("int")
    near = near.withColumns({
        "n_chars": n.cast("long"),
        "edited": F.concat(F.expr("left(text, char_length(text) - cast(floor(char_length(text) / 4) as int))"), F.col("next_text").substr(F.lit(1), cut)),
    })
    near = near.select("doc_id", "n_chars", "edited", "fingerprint_bins", "next_fingerprint_bins")
    near = near.withColumn("edited_bins", fingerprint_bins(shingle_hashes(F.col("edited"), shingle_words), bins, bits))
    return near.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        *let_columns(F.col("fingerprint_bins"), F.col("edited_bins"), F.col("next_fingerprint_bins"), bits),
    )


def let_columns(own: Column, edited: Column, following: Column, bits: int) -> list[Column]:
    """What the result says of three fingerprints."""
    return [
        as_text(own, bits).alias("fingerprint"), as_text(edited, bits).alias("edited_fingerprint"),
        likeness(own, edited, bits).alias("near_edited"), likeness(own, following, bits).alias("near_next"),
    ]
