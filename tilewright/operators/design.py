"""How rows are held out, copied, perturbed and compared: folds, simulated tests, sweeps, effects."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sampling import MOD, lcg


def draw(key: Column, seed: int) -> Column:
    """In [0, 1), by two turns of the arithmetic hash."""
    return lcg(lcg(key, seed)) / MOD


def contiguous(df: DataFrame, session: str, order: str, folds: int, block: int, key: Column) -> DataFrame:
    """fold: contiguous parts of each session; half: blocks of ``block`` rows hashed into two halves, so
    that neighbours stay together."""
    fold = F.ntile(folds).over(Window.partitionBy(session).orderBy(order)) - 1
    half = (lcg(lcg(key * 31 + F.floor(F.col(order) / block))) / 65536).cast("long") % 2
    return df.withColumns({"fold": fold, "half": half})


def nested(groups: DataFrame, key: str, outer: int, inner: int) -> DataFrame:
    """(key, outer, inner): for every outer fold each group once; inner is its fold among those that are
    not held out, -1 where the group is."""
    mine = (lcg(lcg(F.col(key))) / 65536).cast("long") % outer
    own = (lcg(lcg(F.col(key), 1)) / 65536).cast("long") % inner
    each = groups.select(key).distinct().withColumns({"mine": mine, "own": own, "outer": F.explode(F.sequence(F.lit(0), F.lit(outer - 1)))})
    return each.select(key, "outer", F.when(F.col("mine") == F.col("outer"), F.lit(-1)).otherwise(F.col("own")).cast("int").alias("inner"))


def dropout_copies(moments: DataFrame, keys: list[str], limb: str, key: Column, copies: int, shares: tuple[float, ...] = (0.30, 0.65)) -> DataFrame:
    """Copies of each moment that keep one limb, two or three (by a draw against ``shares``), the first
    in hash order."""
    c = moments.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    seed = key * 4 + F.col("copy")
    u = draw(seed, 3)
    c = c.withColumns({"keep": F.when(u < shares[0], 1).when(u < shares[1], 2).otherwise(3), "h": lcg(lcg(seed * 4 + F.col(limb), 5))})
    place = F.row_number().over(Window.partitionBy(*keys, "copy").orderBy("h", limb))
    return c.withColumn("place", place).where("place <= keep").drop("h", "place")


def simulated(moments: DataFrame, session: str, at: str, limb: str, valid: Column, key: Column) -> DataFrame:
    """A test made of sessions: one valid limb per moment, moments shuffled within the session, with the
    place of each one's true successor (null at a session's end)."""
    chosen = moments.where(valid).withColumn("h", lcg(lcg(key * 4 + F.col(limb), 7)))
    first = F.row_number().over(Window.partitionBy(session, at).orderBy("h", limb))
    one = chosen.withColumn("r", first).where("r = 1").drop("r", "h")
    one = one.withColumn("place", F.row_number().over(Window.partitionBy(session).orderBy(lcg(lcg(key, 11)), at)) - 1)
    return one.withColumn("next_place", F.lead("place").over(Window.partitionBy(session).orderBy(at)))


def noisy(links: DataFrame, others: DataFrame, share: float) -> DataFrame:
    """True links of which about ``share`` point to another candidate instead. ``others``: src, dst."""
    j = links.select("src", F.col("dst").alias("true")).join(others.select("src", F.col("dst").alias("other")), "src", "left")
    swap = (draw(F.col("src"), 13) < share) & F.col("other").isNotNull()
    return j.select("src", F.when(swap, F.col("other")).otherwise(F.col("true")).alias("dst"), swap.alias("swapped"))


def vote_sets(votes: DataFrame, size: int, least: float) -> DataFrame:
    """Sets of ``size`` voters of whom each pair differs in ``least`` of the rows or more, and what their
    majority gets right (the first voter decides where none has one). ``votes``: id, label, voter, vote.
    The voters are few; sets are made from the list of them."""
    names = [r.voter for r in votes.select("voter").distinct().orderBy("voter").collect()]
    a, b = votes.select("id", F.col("voter").alias("a"), F.col("vote").alias("x")), votes.select("id", F.col("voter").alias("b"), F.col("vote").alias("y"))
    differ = a.join(b, "id").where("a < b").groupBy("a", "b").agg(F.avg((F.col("x") != F.col("y")).cast("int")).alias("differ"))
    sets = votes.sparkSession.createDataFrame([(k, m, v) for k, s in enumerate(combinations(names, size)) for m, v in enumerate(s)], f"set int, member int, voter {dict(votes.dtypes)['voter']}")
    s, t = sets.select("set", F.col("voter").alias("a")), sets.select("set", F.col("voter").alias("b"))
    spread = s.join(t, "set").join(differ, ["a", "b"]).groupBy("set").agg(F.min("differ").alias("spread")).where(F.col("spread") >= least)
    cast = sets.join(spread, "set").join(votes, "voter")
    n = cast.groupBy("set", "spread", "id", "label", "vote").agg(F.count("*").alias("n"), F.min("member").alias("first"))
    best = F.row_number().over(Window.partitionBy("set", "id").orderBy(F.desc(F.when(F.col("n") * 2 > size, F.col("n")).otherwise(0)), "first"))
    won = n.withColumn("r", best).where("r = 1")
    return won.groupBy("set", "spread").agg(F.avg((F.col("vote") == F.col("label")).cast("int")).alias("right"))


def two_way(df: DataFrame, a: str, b: str, value: str, rounds: int) -> DataFrame:
    """(a, b, n, effect_a, effect_b, mean): additive effects by backfitting on the cells' sums."""
    cells = df.groupBy(a, b).agg(F.count("*").alias("n"), F.sum(value).alias("s"))
    total = cells.agg((F.sum("s") / F.sum("n")).alias("mean"))
    now = cells.crossJoin(F.broadcast(total)).withColumns({"effect_a": F.lit(0.0), "effect_b": F.lit(0.0)})  # one row
    for _ in range(rounds):
        for one, other in ((a, "b"), (b, "a")):
            w = Window.partitionBy(one)
            left = F.col("s") - F.col("n") * (F.col("mean") + F.col(f"effect_{other}"))
            now = now.withColumn("effect_a" if one == a else "effect_b", F.sum(left).over(w) / F.sum("n").over(w))
    return now.select(a, b, "n", "s", "effect_a", "effect_b", "mean")


def runs_test(df: DataFrame, by: str, order: str, flag: Column) -> DataFrame:
    """(by, n1, n0, runs, z): number of runs of a yes/no sequence against what chance gives."""
    w = Window.partitionBy(by).orderBy(order)
    x = df.withColumn("f", flag.cast("int"))
    x = x.withColumn("new", F.when(F.lag("f").over(w) == F.col("f"), 0).otherwise(1))
    g = x.groupBy(by).agg(F.sum("f").cast("long").alias("n1"), F.sum(1 - F.col("f")).cast("long").alias("n0"), F.sum("new").cast("long").alias("runs"))
    n1, n0 = F.col("n1").cast("double"), F.col("n0").cast("double")
    n = n1 + n0
    mean, var = 2 * n1 * n0 / n + 1, 2 * n1 * n0 * (2 * n1 * n0 - n) / (n * n * (n - 1))
    return g.where("n1 > 0 and n0 > 0 and n1 + n0 > 2").withColumn("z", F.when(var > 0, (F.col("runs") - mean) / F.sqrt(var)))


def smoothed_one_hot(vote: Column, cls: Column, classes: int, right: float) -> Column:
    return F.when(vote == cls, F.lit(right)).otherwise(F.lit((1 - right) / (classes - 1)))
