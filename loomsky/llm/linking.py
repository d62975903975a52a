"""Components of sets that are alike, from the buckets of an index, without giving all pairs of a bucket.

Distance is one less the Jaccard similarity, and sets are alike within a limit of it. Four steps, each on what the ones before left in
different components:

* **Small buckets.** Members of buckets of up to ``FEW`` are compared with the least one, and then all pairs of those that aren't in one component by
  that: so a group of near copies gives entries in proportion to its members. Pairs are given where bits of their items allow that they are alike, and then compared, exactly.
* **Centres.** Each larger bucket elects a member that meets most others in all its buckets, and takes the centre of the most famous bucket
  in which that member lies. All members are compared with it, exactly. By the triangle inequality a member within the limit can't be alike
  to one beyond twice the limit. So where some are that far, they and those between go into the next round and elect a centre among the
  far ones. What is left after the last round keeps its bucket's first centre.
* **Second centres.** The symmetric difference of two sets is that of their differences from any third, so sets that are alike share a
  known part of their differences from the centre. In one order for all around a centre, what only they have before what they lack and
  what is usual there last, they share one of the first few; only these are entries. Each such item is a bucket again, with a centre of its own.
* **Pairs** that share one of these items, where sizes and the item's places in both leave it possible that enough is shared.

So a group of thousands of near copies, even where few of them are alike to its centre, gives entries in proportion to its members and
items, and no link is lost. Pairs that share an item are looked at one by one, up to the square of the number that share it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_up_to, components, gathered, stored

ROUNDS = 2
#: members of a bucket of which all pairs are compared
FEW = 64
#: longs of bits by which sets are told apart before they are compared
WORDS = 16
#: an item is usual around a centre where more than one in so many have it
USUAL = 32


def compared(pairs: DataFrame, sets: DataFrame, expand: Callable[[Column], Column] | None = None) -> DataFrame:
    """``pairs`` (a, b) with the sizes of their sets ``n_a, n_b``, what only one of them has, ``apart``, and the distance ``away``."""
    pairs = stored(pairs)
    centres = broadcast_up_to(stored(pairs.select("b").distinct()))
    one = sets.select(F.col("id").alias("a"), F.col("items").alias("items_a")).join(broadcast_up_to(pairs), "a")
    met = one.join(sets.select(F.col("id").alias("b"), F.col("items").alias("items_b")).join(centres, "b"), "b")
    if expand:
        met = met.select("a", "b", expand(F.col("items_a")).alias("items_a"), expand(F.col("items_b")).alias("items_b"))
    met = met.select(
        "a", "b", F.size("items_a").alias("n_a"), F.size("items_b").alias("n_b"),
        F.concat(F.array_sort(F.array_except("items_a", "items_b")), F.array_sort(F.array_except("items_b", "items_a"))).alias("apart"),
    )
    differ = F.size("apart")
    return met.withColumn("away", 2 * differ / (F.col("n_a") + F.col("n_b") + differ))


def prints(sets: DataFrame, spread: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``id``, ``most``, which is at least the size of its set, and ``w0, w1, ...``: bits, each set where some item of the set falls on it."""
    each = spread(sets) if spread else sets.select("id", F.explode("items").alias("item"))
    each = each.select("id", F.xxhash64("item").alias("h")).select("id", F.expr(f"cast(h & {WORDS - 1} as int)").alias("word"), F.expr("shiftleft(1L, cast(shiftright(h, 6) & 63 as int))").alias("bit"))
    each = each.groupBy("id", "word").agg(F.bit_or("bit").alias("bits"), F.count("*").alias("n"))
    words = [F.coalesce(F.max(F.when(F.col("word") == k, F.col("bits"))), F.lit(0)).alias(f"w{k:x}") for k in range(WORDS)]
    return each.groupBy("id").agg(F.sum("n").alias("most"), *words)


def alike_in_small(
    met: DataFrame,
    sets: DataFrame,
    percent: int,
    expand: Callable[[Column], Column] | None = None,
    spread: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Pairs (a, b) whose components are those of all pairs that meet in a bucket of ``met`` and are alike.

    All members are compared with the least of their bucket. Then those of a bucket that aren't in one component by now are compared, all with all.
    """
    known = broadcast_up_to(stored(prints(sets, spread)))

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Those of ``pairs`` that are alike. A bit that only one of them has is that of an item that only it has."""
        both = pairs.join(second(known.withColumnRenamed("id", "b"), "b"), "b").join(known.withColumnRenamed("id", "a"), "a")
        differ = sum((F.bit_count(F.col(f"w{k:x}").bitwiseXOR(F.col(f"w{k:x}2"))) for k in range(WORDS)), F.lit(0))
        both = stored(both.where((100 + percent) * differ <= (100 - percent) * (F.col("most") + F.col("most2"))).select("a", "b"))
        asked = broadcast_up_to(stored(both.select("b").distinct()))
        one = sets.select(F.col("id").alias("a"), F.col("items").alias("items_a")).join(broadcast_up_to(both), "a")
        met = one.join(sets.select(F.col("id").alias("b"), F.col("items").alias("items_b")).join(asked, "b"), "b")
        if expand:
            met = met.select("a", "b", *[expand(F.col(c)).alias(c) for c in ("items_a", "items_b")])
        shared = F.size(F.array_intersect("items_a", "items_b"))
        # Stored before it is asked for, so that sets are made once.
        met = stored(met.select("a", "b", ((100 + percent) * shared >= percent * (F.size("items_a") + F.size("items_b"))).alias("alike")))
        return met.where("alike").select("a", "b")

    small = met.select("key", "rep")
    buckets = small.groupBy("key").agg(F.min("rep").alias("b"), F.collect_set("rep").alias("reps"))
    star = confirmed(buckets.select("b", F.explode("reps").alias("a")).where("a <> b").distinct())
    found = stored(components(star))
    seats = named(small, found).groupBy("key").agg(F.min("rep").alias("low"), F.array_sort(F.collect_set(F.struct("c", "rep"))).alias("seats"))
    seats = seats.where("seats[0].c <> seats[size(seats) - 1].c").select("low", "seats", F.explode("seats").alias("one")).where("one.rep <> low")
    others = F.filter("seats", lambda x: (x.c > F.col("one.c")) & (x.rep != F.col("low")))
    rest = seats.select(F.col("one.rep").alias("rep"), F.explode(others).alias("other")).select(F.greatest("rep", "other.rep").alias("a"), F.least("rep", "other.rep").alias("b"))
    return found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(confirmed(rest.distinct()))


def named(df: DataFrame, found: DataFrame) -> DataFrame:
    """``df`` with the component ``c`` of each ``rep``; itself where it has none."""
    return df.join(broadcast_up_to(found.withColumnRenamed("node", "rep")), "rep", "left").withColumn("c", F.coalesce("component", "rep")).drop("component")


def second(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` with a 2 behind all columns but ``keys``."""
    return df.select(*keys, *[F.col(c).alias(f"{c}2") for c in df.columns if c not in keys])


def linked_components(
    met: DataFrame,
    sets: DataFrame,
    percent: int,
    *,
    expand: Callable[[Column], Column] | None = None,
    spread: Callable[[DataFrame], DataFrame] | None = None,
    rounds: int = ROUNDS,
) -> DataFrame:
    """``node, component`` of all nodes linked with another.

    ``met`` is ``key, rep, members``: the entries of buckets with at least two members. ``sets`` is ``id, items``: the set, of distinct items, of
    each node in ``met``. With ``expand``, ``items`` holds what it makes the set from, and only that is shuffled; ``spread`` then gives rows (id, item)
    of such a table, in which an item may be repeated. Nodes are linked where ``percent`` hundredths of the union are shared.
    """
    limit, slight = 1 - percent / 100, 1e-9
    in_small = alike_in_small(met.where(F.col("members") <= FEW), sets, percent, expand, spread)
    met = met.where(F.col("members") > FEW)
    if met.isEmpty():
        return components(in_small)
    fame = met.groupBy("rep").agg(F.sum("members").alias("fame"))
    hits = met.select("key", "rep").join(fame, "rep").withColumn("far", F.lit(True))
    firsts = []
    for turn in range(rounds):
        elected = hits.where("far").groupBy("key").agg(F.max_by(F.struct("fame", "rep"), F.struct("fame", -F.col("rep"))).alias("best"))
        # Any set may be the centre, so buckets take that of the most famous bucket in which their own centre lies: fewer of them, each with more members.
        elected = gathered(stored(elected.select("key", "best.fame", F.col("best.rep").alias("rep"))))
        seen = hits.select("key", "rep").join(F.broadcast(elected.select("rep").distinct()), "rep").join(elected.select("key", "fame", F.col("rep").alias("centre")), "key")
        seen = seen.groupBy("rep").agg(F.max_by("centre", F.struct("fame", -F.col("centre"))).alias("centre"))
        centres = elected.drop("fame").join(seen, "rep").drop("rep")
        hits = gathered(stored(hits.drop("far", "away").join(centres, "key")))
        home = hits.select("key", F.col("rep").alias("a"), F.col("centre").alias("b")) if turn == 0 else home
        first = compared(hits.where("rep <> centre").select(F.col("rep").alias("a"), F.col("centre").alias("b")).distinct(), sets, expand)
        first = stored(first.withColumn("apart", F.when((F.col("away") <= 2 * limit + slight) | F.lit(turn == 0), F.col("apart"))))
        firsts.append(first)
        distances = first.select(F.col("a").alias("rep"), F.col("b").alias("centre"), "away")
        hits = hits.join(distances, ["rep", "centre"]).where(F.col("away") > limit - slight)
        hits = hits.select("key", "rep", "fame", "away", (F.col("away") > 2 * limit - slight).alias("far"))
        left = hits.groupBy("key").agg(F.count_if("far").alias("far"), F.count("*").alias("n")).where("far > 0 and n > 1").select("key")
        hits = gathered(stored(hits.join(left, "key")))
        if hits.isEmpty():
            break
    first = reduce(DataFrame.unionByName, firsts)
    alike = first.where(F.col("away") <= limit + slight).select("a", "b").union(in_small)

    # Within twice the limit of a centre, or left over after the last round; where some aren't alike to it.
    lone = F.col("away") > limit + slight
    rest = hits.withColumnRenamed("rep", "a").join(home, ["key", "a"]).select("a", "b").distinct().withColumn("rest", F.lit(True))
    around = first.where("apart is not null").join(broadcast_up_to(stored(rest)), ["a", "b"], "left").where((F.col("away") <= 2 * limit + slight) | F.col("rest"))
    around = around.select(F.col("b").alias("centre"), F.col("a").alias("rep"), F.col("n_a").alias("n"), F.col("n_b").alias("n_c"), F.size("apart").alias("size"), "apart", lone.alias("lone"))
    around = stored(around.dropDuplicates(["centre", "rep"]))
    mixed = broadcast_up_to(stored(around.where("lone").select("centre").distinct()))
    around = around.join(mixed, "centre")

    # So many items may a set have that one alike to it, of which one is lone, has not.
    most = F.when(F.col("lone"), F.expr(f"{100 - percent} * n * (1 + 100 / {percent}) / {100 + percent}"))
    most = F.floor(most.otherwise(F.expr(f"(size + {100 - percent} * (n - n_c) / {100 + percent}) / 2")) + 1e-6).cast("int")
    upto = F.greatest(most, F.lit(-1)) + 1
    # Items that many have around a centre come last: those that it alone lacks or has.
    heads = around.select("centre", F.explode(F.slice("apart", 1, upto)).alias("item")).groupBy("centre", "item").agg(F.count("*").alias("having")).where(f"having > {FEW}")
    many = around.groupBy("centre").agg((F.count("*") / USUAL).alias("many"))
    usual = heads.join(F.broadcast(many), "centre").where("having > many").groupBy("centre").agg(F.array_sort(F.collect_list(F.struct("having", "item"))).getField("item").alias("usual"))
    around = around.join(broadcast_up_to(stored(usual)), "centre", "left").withColumn("usual", F.coalesce("usual", F.array().cast("array<bigint>")))
    around = around.withColumn("apart", F.concat(F.array_except("apart", "usual"), F.array_intersect("usual", "apart"))).drop("usual")
    entries = around.select("centre", "rep", "n", "size", "lone", F.posexplode(F.slice("apart", 1, upto)).alias("place", "item"))
    entries = entries.withColumn("place", F.col("place") + 1)
    met_again = entries.groupBy("centre", "item").agg(F.count("*").alias("having"), F.max("lone").alias("any")).where("having > 1 and any").select("centre", "item")
    entries = stored(entries.join(met_again, ["centre", "item"]))
    # What both must share of what they have besides the centre leaves this many places before the first that they share.
    can = F.expr(
        f"{percent} * greatest(n, n2) <= 100 * least(n, n2) and"
        f" {100 + percent} * (2 * (place - 1) - size + size2) <= {100 - percent} * (n + n2) and"
        f" {100 + percent} * (2 * (place2 - 1) - size2 + size) <= {100 - percent} * (n + n2) and"
        f" {100 + percent} * (size + size2 - 2 * (1 + least(size - place, size2 - place2))) <= {100 - percent} * (n + n2)"
    )
    parts = around.select("centre", "rep", "n", "apart")

    def links(pairs: DataFrame) -> DataFrame:
        """Those of ``pairs`` (centre, rep, rep2) that are alike."""
        both = pairs.join(parts, ["centre", "rep"]).join(second(parts, "centre"), ["centre", "rep2"])
        differ = "size(array_except(apart, apart2)) + size(array_except(apart2, apart))"
        return stored(both.where(f"{100 + percent} * ({differ}) <= {100 - percent} * (n + n2)").select(F.col("rep").alias("a"), F.col("rep2").alias("b")))

    best = entries.groupBy("centre", "item").agg(F.min(F.struct("size", "rep", "n", "place", "lone")).alias("best"))
    to_best = entries.join(best, ["centre", "item"]).select("*", *[F.col(f"best.{c}").alias(f"{c}2") for c in ("rep", "n", "size", "place", "lone")])
    to_best = to_best.where(can & F.expr("rep <> rep2 and (lone or lone2)")).select("centre", "rep", "rep2").distinct()
    found = stored(components(alike.union(links(to_best))))

    # Those that aren't of the largest component around their centre, which holds the centre where any is alike to it.
    seats = named(around.select("centre", "rep"), found)
    main = seats.groupBy("centre", "c").agg(F.count("*").alias("members")).groupBy("centre").agg(F.max_by("c", F.struct("members", "c")).alias("main"))
    seats = seats.join(broadcast_up_to(stored(main)), "centre")
    every = stored(entries.drop("lone").join(broadcast_up_to(stored(seats)), ["centre", "rep"]))
    pairs = every.where("c <> main").join(second(every.drop("main"), "centre", "item"), ["centre", "item"])
    pairs = pairs.where(can & F.expr("c <> c2 and (c2 = main or rep < rep2)")).select("centre", "rep", "rep2").distinct()
    more = links(pairs)
    return found if more.isEmpty() else components(found.toDF("a", "b").union(more))
