"""The order of samples in an epoch: a keyed permutation of 0 .. n-1 as a column expression, so shuffling needs no sort, no state and no agreement between tasks.

The permutation is the swap-or-not shuffle: in each round a place x has one partner k - x (modulo n), and a hash of the round and of the greater of the two says for both whether
they change places.  Each round is its own inverse on pairs, so the whole is a bijection for any n.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.operators.sequences import limit_batches
from freshet.schema import BASIN

ROUNDS = 24
#: Samples of a task that finds the places of several epochs.
ROWS = 100_000


def round_keys(seed: int, epoch: int, rounds: int = ROUNDS) -> list[int]:
    """A number of 32 bits for each round, from MD5 of seed, epoch and round."""
    return [int(hashlib.md5(f"{seed}:{epoch}:{r}".encode()).hexdigest()[:8], 16) for r in range(rounds)]


def permuted(place: Column, n: Column | int, seed: int, epoch: int, rounds: int = ROUNDS) -> Column:
    """Where ``place`` (0 .. n-1) stands in the order of an epoch."""
    size = (n if isinstance(n, Column) else F.lit(n)).cast("long")
    keys = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(k).cast("long").alias("k")) for r, k in enumerate(round_keys(seed, epoch, rounds))])

    def turn(x: Column, key: Column) -> Column:
        other = F.pmod(key["k"] - x, size)
        digest = F.md5(F.concat_ws(":", F.lit(f"{seed}:{epoch}"), key["r"].cast("string"), F.greatest(x, other).cast("string")))
        return F.when(F.substring(digest, 1, 1) < "8", other).otherwise(x)

    return F.aggregate(keys, place.cast("long"), turn)


def epoch_batches(samples: DataFrame, n: int, size: int, seed: int, epoch: int, most: int = 0) -> DataFrame:
    """``samples`` (with ``sample_id`` 0 .. n-1) with place and batch in an epoch's order; ``most`` batches at most, if it is not 0."""
    out = samples.withColumn("place", permuted(F.col("sample_id"), n, seed, epoch))
    return limit_batches(out.withColumn("batch", F.floor(F.col("place") / size).cast("long")), most)


def places(samples: DataFrame, n: int, seed: int, orders: Sequence[int]) -> DataFrame:
    """(epoch, place) of each of ``samples`` (with ``sample_id`` 0 .. n-1) in several epochs' orders, in one pass, whose tasks are as many as the samples ask for."""
    dealt = samples.select("sample_id").repartition(max(1, -(-n // ROWS)), "sample_id")
    each = [F.struct(F.lit(e).alias("epoch"), permuted(F.col("sample_id"), n, seed, e).alias("place")) for e in orders]
    return dealt.select(F.explode(F.array(*each)).alias("of")).select("of.epoch", "of.place")


def by_basin(samples: DataFrame, n: int, size: int, seed: int, epoch: int) -> DataFrame:
    """As :func:`epoch_batches`, with batches numbered by basin and drawn in the epoch's order within each: a batch never mixes basins."""
    from pyspark.sql import Window

    out = samples.withColumn("place", permuted(F.col("sample_id"), n, seed, epoch))
    k = F.row_number().over(Window.partitionBy(BASIN).orderBy("place")) - 1
    return out.withColumn("batch", F.floor(k / size).cast("long"))
