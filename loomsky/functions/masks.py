"""Bit masks, invalid values, chunk masks: column expressions and small dimension tables."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, IntegerType, LongType, ShortType

#: integer that stands for no value
INVALID_INT = -9999
#: weights of zero values are this large
LARGEST = 1.7976931348623157e308
WORD = 0xFFFFFFFF

#: named ranges of subchannels (first, last): fixed values
FEATURES = {"Aromatic": (225, 235), "Aliphatic": (249, 259)}


def ignore_word(ignore: Iterable[int | str], names: dict[str, int] | None = None) -> int:
    """The bits to ignore, given by number or by name in ``names``, as one word."""
    word = 0
    for bit in ignore:
        word |= 1 << (names[bit] if isinstance(bit, str) else bit)
    return word & WORD


def is_flagged(dq: Column, ignore: Iterable[int | str] = (), names: dict[str, int] | None = None) -> Column:
    """Whether any bit that isn't ignored is set. A null mask has none."""
    return F.coalesce(dq, F.lit(0)).cast("bigint").bitwiseAND(F.lit(WORD & ~ignore_word(ignore, names))) != 0


def is_good(dq: Column, ignore: Iterable[int | str] = (), names: dict[str, int] | None = None) -> Column:
    return ~is_flagged(dq, ignore, names)


def expand_bits(dq: Column, bits: int = 32, ignore: Iterable[int | str] = (), names: dict[str, int] | None = None) -> Column:
    """array<boolean> of the mask's bits; ignored ones are false."""
    kept = F.coalesce(dq, F.lit(0)).cast("bigint").bitwiseAND(F.lit(WORD & ~ignore_word(ignore, names)))
    return F.array(*[F.shiftright(kept, b).bitwiseAND(F.lit(1)) == 1 for b in range(bits)])


def pack_bits(planes: Column) -> Column:
    """The mask of an array of booleans: bit b is set where the b-th is true."""
    # From the last bit to the first: each step doubles what has been gathered.
    return F.aggregate(F.reverse(planes), F.lit(0).cast("bigint"), lambda word, v: word * 2 + F.when(v, F.lit(1)).otherwise(F.lit(0)))


def invalid(df: DataFrame, column: str) -> Column:
    """Whether ``column`` holds no value: NaN among floats, -9999 among integers. Other types are an error. Null counts as none."""
    kind = df.schema[column].dataType
    if isinstance(kind, (DoubleType, FloatType)):
        return F.isnan(column) | F.col(column).isNull()
    if isinstance(kind, (IntegerType, LongType, ShortType)):
        return F.coalesce(F.col(column) == INVALID_INT, F.lit(True))
    raise TypeError(f"{column} is {kind.simpleString()}; an integer or a float is needed")


def nan_to_zero(df: DataFrame, value: str = "value", weight: str = "weight") -> DataFrame:
    """NaN values become 0 with weight 0."""
    bad = F.isnan(value)
    return df.withColumns({value: F.when(bad, 0.0).otherwise(F.col(value)), weight: F.when(bad, F.lit(0)).otherwise(F.col(weight))})


def inverse_square_weight(x: Column) -> Column:
    """1 / x ** 2; 0 for NaN, the largest finite number for 0."""
    return F.when(F.isnan(x), 0.0).when(x == 0, LARGEST).otherwise(1.0 / F.when(x == 0, 1.0).otherwise(x * x))


def header_flag_ok(flag: Column, missing: int = 2) -> Column:
    """Whether an exposure's astrometry flag is 0; a header without it counts as ``missing``."""
    return F.coalesce(flag, F.lit(missing)) == 0


def channel_mask(spark: SparkSession, channels: Sequence[int], *, n_channels: int = 17, n_sub: int = 10, pad: int = 0) -> DataFrame:
    """``chunk, valid``: the subchannels of ``channels`` (from 1 on), and ``pad`` more on either side, among n_channels * n_sub + 2."""
    size = n_channels * n_sub + 2
    chosen = spark.createDataFrame([(int(c),) for c in channels], "ch int").select(
        F.explode(F.sequence(((F.col("ch") - 1) * n_sub - pad + 1).cast("bigint"), (F.col("ch") * n_sub + pad).cast("bigint"))).alias("chunk")
    )
    chosen = chosen.where(F.col("chunk").between(0, size - 1)).distinct().withColumn("valid", F.lit(True))
    return spark.range(size).toDF("chunk").join(chosen, "chunk", "left").select("chunk", F.coalesce("valid", F.lit(False)).alias("valid"))


def feature_mask(spark: SparkSession, name: str, size: int) -> DataFrame:
    """``chunk, valid`` of a named range of subchannels."""
    first, last = FEATURES[name]
    return spark.range(size).toDF("chunk").withColumn("valid", F.col("chunk").between(first, last))


def strip_mask(mask: DataFrame, columns: int) -> DataFrame:
    """A subchannel mask, for each of ``columns`` strips: chunk = subchannel * columns + strip."""
    strips = F.explode(F.sequence(F.lit(0), F.lit(columns - 1)))
    return mask.select("chunk", "valid", strips.alias("_strip")).select((F.col("chunk") * columns + F.col("_strip")).alias("chunk"), "valid")


def valid_offsets(
    offsets: DataFrame, *, threshold: float = 0.01, normalize: bool = True, offset: str = "value", fraction: str = "coverage_frac"
) -> DataFrame:
    """``offsets`` where those with less coverage than ``threshold`` are 0; of the others, the mean is taken off if ``normalize``.

    Adds ``is_valid`` and ``mean_offset``, the mean of the valid ones (0 if there are none)."""
    ok = F.col(fraction) >= threshold
    mean = offsets.agg(F.coalesce(F.avg(F.when(ok, F.col(offset))), F.lit(0.0)).alias("mean_offset"))  # one row
    shifted = F.col(offset) - (F.col("mean_offset") if normalize else 0)
    return offsets.join(F.broadcast(mean)).withColumns({"is_valid": ok, offset: F.when(ok, shifted).otherwise(0.0)})
