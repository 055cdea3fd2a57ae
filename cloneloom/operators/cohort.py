"""Cohorts: matching, crosswalks with fallback, relations, follow-up."""

from __future__ import annotations

import math
import re
import tempfile
import uuid
from collections.abc import Sequence
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cloneloom.operators.relational import places

#: The finest cells of a nearest search, as a power of 2 of the limits.
FINEST = 16


def shared_dir(spark: SparkSession) -> None:
    """Sets the folder of spark.checkpoint.dir; a temporary one only for a session in one process (tests)."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        path = sc.getConf().get("spark.checkpoint.dir")
        if not path and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="cloneloom-"))


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read from there: it is run once, and later plans start from the files."""
    shared_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _points(pool: DataFrame, key: str, equal: Sequence[str], near: Sequence[tuple[str, float]]) -> DataFrame:
    """Different places of a pool with their two smallest keys (k1, k2), so that a case that is in the pool itself finds another one."""
    columns = [*equal, *[c for c, _ in near]]
    known = pool.where(reduce(Column.__and__, [F.col(c).isNotNull() for c in (key, *columns)]))
    least = known.groupBy(*columns).agg(F.min(key).alias("k1"))
    if not columns:
        return least.withColumn("k2", F.lit(None).cast(dict(pool.dtypes)[key]))
    rest = known.withColumnsRenamed({c: f"_{c}" for c in (key, *columns)})
    second = rest.join(least, [F.col(f"_{c}").eqNullSafe(F.col(c)) for c in columns]).where(F.col(f"_{key}") > F.col("k1")).groupBy(*columns).agg(F.min(f"_{key}").alias("k2"))
    return least.join(second, columns, "left")


def nearest_points(cases: DataFrame, points: DataFrame, key: str, equal: Sequence[str], near: Sequence[tuple[str, float]]) -> DataFrame:
    """(key, match, dist, and _-names of the point's columns): the nearest point in reach of each case that has one.

    An ordered search in rings: near columns are cut into cells of a fraction f of their limits, and a case meets the
    points of its own and neighbouring cells.  What it finds within f is its nearest, for no nearer point is in another
    cell; only cases that find nothing so near go on, with cells twice as wide, up to the limits themselves.  The first
    fraction is such that a cell has about one point where points are densest.  dist is the sum of squared differences
    over the limits; ties go to the smaller key (k1, or k2 for the case that is k1 itself).
    """
    spark = cases.sparkSession
    shared_dir(spark)
    equal, near = [*equal, *[c for c, most in near if most == 0]], [(c, most) for c, most in near if most > 0]
    columns = [*equal, *[c for c, _ in near]]
    points = points.withColumnsRenamed({c: f"_{c}" for c in columns})
    cell = lambda c, most, f: F.floor(F.col(c) / (most * f))
    fraction = 1.0
    if near:
        densest = points.groupBy(*[f"_{c}" for c in equal], *[cell(f"_{c}", most, 1.0).alias(f"_cell{i}") for i, (c, most) in enumerate(near)]).count().agg(F.max("count")).first()[0] or 1
        fraction = 2.0 ** -min(FINEST, math.ceil(math.log2(densest) / len(near)))
    left, found = cases.select(key, *columns), []
    dist = sum((((F.col(c) - F.col(f"_{c}")) / most) ** 2 for c, most in near), F.lit(0.0))
    match = F.when(F.col(key) == F.col("k1"), F.col("k2")).otherwise(F.col("k1"))
    while True:
        a, b, on = left, points, [F.col(c) == F.col(f"_{c}") for c in equal]
        for i, (c, most) in enumerate(near):
            home = cell(c, most, fraction)
            a = a.withColumn(f"_at{i}", F.explode(F.sequence(home - 1, home + 1)))
            b = b.withColumn(f"_cell{i}", cell(f"_{c}", most, fraction))
            on.append(F.col(f"_at{i}") == F.col(f"_cell{i}"))
        met = (a.join(b, on) if on else a.crossJoin(F.broadcast(b))).withColumn("match", match).where("match is not null")  # without columns there is one point
        for c, most in near:
            met = met.where(F.abs(F.col(c) - F.col(f"_{c}")) <= most)
        best = F.min(F.struct(dist.alias("dist"), "match", *[f"_{c}" for c in columns])).alias("b")
        nearest = met.groupBy(key).agg(best).select(key, "b.match", "b.dist", *[f"b._{c}" for c in columns])
        if fraction >= 1:
            return reduce(DataFrame.unionByName, [*found, nearest])
        # A little inside the ring, so that rounding decides nothing.
        sure = nearest.where(F.col("dist") <= (fraction * (1 - 1e-6)) ** 2).checkpoint(eager=True)
        found.append(sure)
        left, fraction = left.join(sure.select(key), key, "left_anti").checkpoint(eager=True), fraction * 2
        if left.isEmpty():
            return reduce(DataFrame.unionByName, found)


def nearest_match(cases: DataFrame, pool: DataFrame, key: str, equal: Sequence[str], near: Sequence[tuple[str, float]]) -> DataFrame:
    """For each case its nearest pool member, with replacement (J14, J15): equal columns agree, near columns differ at most so much.

    Distance is the sum of squared differences over the limits; ties go to the smaller key.  Cases without a partner, and
    those with a null in a column that counts, stay with null.  Keys of cases are different.
    """
    best = nearest_points(cases, _points(pool, key, equal, near), key, equal, near)
    return cases.select(key).join(best.select(key, "match", "dist"), key, "left").select(key, "match", F.sqrt("dist").alias("dist"))


def greedy_match(
    cases: DataFrame, pool: DataFrame, key: str, equal: Sequence[str], near: Sequence[tuple[str, float]], rounds: int | None = None, seed: int = 1
) -> DataFrame:
    """Matching without replacement (J14): in each round every free case asks at its nearest place with free members, and these take the nearest askers.

    Askers of a place are numbered by distance, ties by a hash of key and seed, its members by such a hash; equal numbers
    are a match.  So a stratum of equal cases and members is matched in one round.  Rounds go on until no free case
    has a free member in reach; ``rounds`` stops earlier.  Nothing holds the pairs in reach: a round's rows are those of
    nearest_points.  What is free after a round is written to the checkpoint folder, where lineage ends.
    """
    shared_dir(cases.sparkSession)
    columns = [*equal, *[c for c, _ in near]]
    known = reduce(Column.__and__, [F.col(c).isNotNull() for c in (key, *columns)])
    free, members, out = cases.select(key, *columns).where(known), pool.select(key, *columns).where(known), []
    ends = [f"_{c}" for c in columns]
    name = F.to_json(F.struct(*[F.col(e).alias(f"c{i}") for i, e in enumerate(ends)])) if ends else F.lit("")
    for turn in count() if rounds is None else range(rounds):
        asks = nearest_points(free, _points(members, key, equal, near), key, equal, near).withColumn("_place", name).checkpoint(eager=True)
        if asks.isEmpty():
            break
        # Draws differ from round to round, so a case that is in the pool and draws itself draws another one later.
        by_case, by_member = ([F.xxhash64(F.lit(seed), F.lit(turn), F.lit(side), key).alias("draw"), F.col(key).alias("k")] for side in ("case", "member"))
        askers = places(asks.withColumn("_order", F.struct("dist", *by_case)), "_order", "_number", ["_place"]).select(key, "dist", "_place", "_number")
        asked = members.join(asks.select("_place", *ends).distinct(), reduce(Column.__and__, [F.col(c) == F.col(e) for c, e in zip(columns, ends)], F.lit(True)))
        asked = places(asked.withColumn("_order", F.struct(*by_member)), "_order", "_number", ["_place"]).select(F.col(key).alias("match"), "_place", "_number")
        won = askers.join(asked, ["_place", "_number"]).where(F.col(key) != F.col("match")).select(key, "match", F.sqrt("dist").alias("dist")).checkpoint(eager=True)
        out.append(won)
        free = free.join(won.select(key), key, "left_anti").checkpoint(eager=True)
        members = members.join(won.select(F.col("match").alias(key)), key, "left_anti").checkpoint(eager=True)
    if not out:
        return cases.select(key, F.col(key).alias("match"), F.lit(0.0).alias("dist")).limit(0)
    return reduce(DataFrame.unionByName, out)


def matched_by_rules(cases: DataFrame, pool: DataFrame, key: str, rules: Sequence[tuple[str, str, float | None]], seed: int = 1) -> DataFrame:
    """Matching by a list of rules (J15): (column, 'identity', None) or (column, 'delta', most), without replacement, nearest by the scaled columns.

    A case without a member in reach under all rules is tried under all but the last, and so on down to the first;
    rules_used tells how many held.  The seed decides between equal pairs.
    """
    out, free_cases, free_pool = [], cases, pool
    for used in range(len(rules), 0, -1):
        equal, near = [c for c, kind, _ in rules[:used] if kind == "identity"], [(c, most) for c, kind, most in rules[:used] if kind == "delta"]
        found = greedy_match(free_cases, free_pool, key, equal, near, seed=seed).withColumn("rules_used", F.lit(used))
        out.append(found)
        free_cases = free_cases.join(found.select(key), key, "left_anti")
        free_pool = free_pool.join(found.select(F.col("match").alias(key)), key, "left_anti")
    return reduce(DataFrame.unionByName, out)


def crosswalk(left: DataFrame, right: DataFrame, user: str, day: str, left_id: str, right_id: str) -> DataFrame:
    """Pairs of samples of a user on the same day; users' left samples without one pair with all of the user's right samples."""
    same = left.join(right, [user, day]).select(user, left_id, right_id, F.lit("date").alias("matched_on"))
    rest = left.join(same.select(left_id).distinct(), left_id, "left_anti").select(user, left_id)
    loose = rest.join(right.select(user, right_id), user).select(user, left_id, right_id, F.lit("user").alias("matched_on"))
    out = same.unionByName(loose)
    return out.withColumn("left_repeats", F.count("*").over(Window.partitionBy(left_id))).withColumn("right_repeats", F.count("*").over(Window.partitionBy(right_id)))


def relation_scores(pairs: DataFrame, people: DataFrame | None, person: str, groups: Sequence[str]) -> DataFrame:
    """Per pair 1 for each group id that both have and share, and their sum (J17); null ids are equal to nothing.

    Without people, pairs carry the ids of both (GROUP1, GROUP2), and are neither joined nor shuffled.
    """
    if people is None:
        out, sides = pairs, [(F.col(f"{g}1"), F.col(f"{g}2")) for g in groups]
    else:
        a = people.select(F.col(person).alias("sample1"), *[F.col(g).alias(f"a_{g}") for g in groups])
        b = people.select(F.col(person).alias("sample2"), *[F.col(g).alias(f"b_{g}") for g in groups])
        out, sides = pairs.join(a, "sample1").join(b, "sample2"), [(F.col(f"a_{g}"), F.col(f"b_{g}")) for g in groups]
    scores = [F.coalesce((x == y).cast("int"), F.lit(0)).alias(f"same_{g}") for g, (x, y) in zip(groups, sides)]
    out = out.select("sample1", "sample2", *scores)
    return out.withColumn("total", sum(F.col(f"same_{g}") for g in groups))


def enough_follow_up(df: DataFrame, outcome: str, days: str, limit: int) -> DataFrame:
    """Positives, and negatives followed for longer than the limit."""
    return df.where((F.col(outcome) == 1) | (F.col(days) > limit))
