"""Label sequences and count constraints: Viterbi, forward-backward, IPF, null rates, bands, ICM."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .sampling import lcg


def ipf(df: DataFrame, targets: DataFrame, rounds: int, floor: float = 1e-12) -> DataFrame:
    """Rounds of scaling each class to its target and each row to one. ``df``: session, id, class, p;
    ``targets``: session, class, target. A class's total is a grouped sum joined back, a row's a window's."""
    now = df.join(targets, ["session", "class"])
    for _ in range(rounds):
        column = now.groupBy("session", "class").agg(F.sum("p").alias("__c"))  # combined before the shuffle
        now = now.join(column, ["session", "class"]).withColumn("p", F.col("p") * F.col("target") / F.greatest("__c", F.lit(floor))).drop("__c")
        now = now.withColumn("p", F.col("p") / F.greatest(F.sum("p").over(Window.partitionBy("id")), F.lit(floor)))
    return now.drop("target")


def ipf_grouped(df: DataFrame, targets: dict[int, float], rounds: int = 50) -> DataFrame:
    """The same for many rounds, one session in memory."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.pivot(index="id", columns="class", values="p").fillna(0.0)
        x, t = p.to_numpy(), np.array([targets[c] for c in p.columns])
        for _ in range(rounds):
            x = x * (t / np.maximum(x.sum(0), 1e-12))
            x = x / np.maximum(x.sum(1, keepdims=True), 1e-12)
        n, c = x.shape
        return pd.DataFrame({"session": pdf["session"].iloc[0], "id": np.repeat(p.index.to_numpy(), c), "class": np.tile(p.columns.to_numpy(), n), "p": x.ravel()})

    kinds = dict(df.dtypes)
    return df.select("session", "id", "class", "p").groupBy("session").applyInPandas(run, f"session {kinds['session']}, id {kinds['id']}, class {kinds['class']}, p double")


def null_rate(df: DataFrame, null: int, rate: float) -> DataFrame:
    """(session, id, is_null, shift): the share ``rate`` of greatest null margins becomes null. The
    logit shift that does it is minus the k-th largest margin, so no search is needed."""
    best = F.greatest(F.max(F.when(F.col("class") == null, F.col("p"))), F.lit(1e-9))
    other = F.greatest(F.max(F.when(F.col("class") != null, F.col("p"))), F.lit(1e-9))
    m = df.groupBy("session", "id").agg((F.ln(best) - F.ln(other)).alias("m"))
    w = Window.partitionBy("session")
    r = m.withColumns({"r": F.row_number().over(w.orderBy(F.desc(F.round("m", 6)), "id")), "k": F.floor(F.count("*").over(w) * rate + 0.5)})
    return r.select("session", "id", (F.col("r") <= F.col("k")).alias("is_null"), (-F.max(F.when(F.col("r") == F.col("k"), F.col("m"))).over(w)).alias("shift"))


def transitions(bigrams: DataFrame, alpha: float, classes: int) -> DataFrame:
    """(a, b, n, logp) with add-alpha smoothing over rows (a, b)."""
    c = bigrams.groupBy("a", "b").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("a"))
    return c.withColumn("logp", F.ln((F.col("n") + alpha) / (total + alpha * classes)))


def viterbi(scores: np.ndarray, switch: np.ndarray | float) -> np.ndarray:
    """Best labels for (T, C) scores; changing the label before row t costs switch[t]."""
    t, c = scores.shape
    cost = np.full(t, float(switch)) if np.isscalar(switch) else np.asarray(switch, float)
    best, back = scores[0].copy(), np.zeros((t, c), int)
    for i in range(1, t):
        top = int(best.argmax())
        stay = best >= best[top] - cost[i]
        back[i] = np.where(stay, np.arange(c), top)
        best = np.where(stay, best, best[top] - cost[i]) + scores[i]
    out = np.empty(t, int)
    out[-1] = best.argmax()
    for i in range(t - 1, 0, -1):
        out[i - 1] = back[i, out[i]]
    return out


def posterior(scores: np.ndarray, stay: float) -> np.ndarray:
    """Forward-backward over a sticky chain: P(label at t | all rows)."""
    t, c = scores.shape
    e = np.exp(scores - scores.max(1, keepdims=True))
    move = (1 - stay) / max(c - 1, 1)
    f, b = np.empty((t, c)), np.ones((t, c))
    f[0] = e[0] / e[0].sum()
    for i in range(1, t):
        x = e[i] * (f[i - 1] * (stay - move) + move * f[i - 1].sum())
        f[i] = x / x.sum()
    for i in range(t - 2, -1, -1):
        y = e[i + 1] * b[i + 1]
        x = y * (stay - move) + move * y.sum()
        b[i] = x / x.sum()
    p = f * b
    return p / p.sum(1, keepdims=True)


def icm(scores: np.ndarray, src: np.ndarray, dst: np.ndarray, w: np.ndarray, strength: float, rounds: int = 30) -> np.ndarray:
    """Potts relabelling: rows take the label of greatest score plus agreeing weight, half of them in
    turn, until none changes."""
    n, c = scores.shape
    label = scores.argmax(1)
    turn = (np.arange(n) * 2654435761 >> 7) % 2
    for k in range(rounds):
        total = scores.copy()
        np.add.at(total, (src, label[dst]), strength * w)
        new = np.where(turn == k % 2, total.argmax(1), label)
        if k and (new == label).all():
            break
        label = new
    return label


def banded(scores: np.ndarray, low: np.ndarray, high: np.ndarray, step: float = 0.25, rounds: int = 40, decode=None) -> np.ndarray:
    """Additive class biases until every count is within its band, or the rounds are over."""
    decode = decode or (lambda s: s.argmax(1))
    bias = np.zeros(scores.shape[1])
    for _ in range(rounds):
        label = decode(scores + bias)
        n = np.bincount(label, minlength=len(bias))
        if ((n >= low) & (n <= high)).all():
            break
        bias = bias + step * ((n < low).astype(float) - (n > high))
    return label


def segments(scores: np.ndarray, label: np.ndarray, low: np.ndarray, high: np.ndarray, rounds: int = 60) -> np.ndarray:
    """One class per run of ``label``, class prices adjusted towards the bands of counts (a Lagrangian
    heuristic for the integer program)."""
    cut = np.flatnonzero(np.diff(label)) + 1
    starts = np.concatenate([[0], cut])
    total = np.add.reduceat(scores, starts, axis=0)
    size = np.diff(np.append(starts, len(label)))
    price, best, worst = np.zeros(scores.shape[1]), None, np.inf
    for k in range(rounds):
        pick = (total - price * size[:, None]).argmax(1)
        n = np.bincount(pick, size, len(price))
        off = np.maximum(low - n, 0) + np.maximum(n - high, 0)
        cost = off.sum() * np.abs(scores).max() - total[np.arange(len(pick)), pick].sum()
        if cost < worst:
            best, worst = pick, cost
        if not off.any():
            break
        price = price + (np.sign(n - high) * (n > high) - (n < low)) * np.abs(scores).max() * 0.5 / (k + 1)
    return np.repeat(best, size)


def viterbi_padded(scores: np.ndarray, cost: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Best labels of many sequences at once: ``scores`` (B, T, C), ``cost`` (B, T) of changing the label
    before a row, ``length`` (B,). What lies past a sequence's end is meaningless."""
    n, t, c = scores.shape
    rows = np.arange(n)
    best, back = scores[:, 0].copy(), np.zeros((n, t, c), np.int32)
    for i in range(1, t):
        top = best.argmax(1)
        moved = best[rows, top] - cost[:, i]
        stay = best >= moved[:, None]
        back[:, i] = np.where(stay, np.arange(c), top[:, None])
        new = np.where(stay, best, moved[:, None]) + scores[:, i]
        best = np.where((i < length)[:, None], new, best)
    out = np.zeros((n, t), np.int32)
    last = best.argmax(1)
    for i in range(t - 1, -1, -1):
        last = np.where(i + 1 < length, back[rows, min(i + 1, t - 1), last], last)
        out[:, i] = last
    return out


def posterior_padded(scores: np.ndarray, stay: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Forward-backward over sticky chains: P(label at t | all rows); ``stay`` (B, T) before each row."""
    n, t, c = scores.shape
    e = np.exp(scores - scores.max(2, keepdims=True))
    move = ((1 - stay) / max(c - 1, 1))[:, :, None]
    keep = stay[:, :, None] - move
    f, b = np.empty((n, t, c)), np.ones((n, t, c))
    f[:, 0] = e[:, 0] / e[:, 0].sum(1, keepdims=True)
    for i in range(1, t):
        x = e[:, i] * (f[:, i - 1] * keep[:, i] + move[:, i] * f[:, i - 1].sum(1, keepdims=True))
        f[:, i] = x / x.sum(1, keepdims=True)
    for i in range(t - 2, -1, -1):
        y = e[:, i + 1] * b[:, i + 1]
        x = y * keep[:, i + 1] + move[:, i + 1] * y.sum(1, keepdims=True)
        b[:, i] = np.where((i + 1 < length)[:, None], x / x.sum(1, keepdims=True), 1.0)
    p = f * b
    return p / p.sum(2, keepdims=True)


#: Scores of one batch of padded sequences, at most (a longer sequence is a batch of its own).
CELLS = 4_000_000


def chains(rows: DataFrame, switch: float | str, *, floor: float = 1e-6, sticky: float | str | None = None) -> DataFrame:
    """(id, label, conf) by Viterbi (or sticky posterior) over rows (chain, pos, id, p array).

    ``switch`` and ``sticky`` are numbers, or columns: the cost of changing the label before a row, and
    the chance that it stays. Chains are sorted within partitions and decoded in padded batches.
    """
    given = sticky if sticky is not None else switch
    extra = F.col(given).cast("double") if isinstance(given, str) else F.lit(float(given))

    def decoded(pdf: pd.DataFrame):
        head = np.flatnonzero(np.concatenate([[True], pdf["chain"].to_numpy()[1:] != pdf["chain"].to_numpy()[:-1]]))
        size = np.diff(np.append(head, len(pdf)))
        s = np.log(np.maximum(np.stack(pdf["p"].to_numpy()), floor))
        x, c = pdf["extra"].to_numpy(), s.shape[1]
        order = np.argsort(size, kind="stable")
        lo = 0
        while lo < len(order):
            hi = lo + 1
            while hi < len(order) and (hi + 1 - lo) * size[order[hi]] * c <= CELLS:
                hi += 1
            some = order[lo:hi]
            length, t = size[some], int(size[some].max())
            at = head[some][:, None] + np.minimum(np.arange(t), length[:, None] - 1)
            inside = np.arange(t) < length[:, None]
            if sticky is None:
                label = viterbi_padded(s[at], x[at], length)[inside]
                conf = np.full(len(label), np.nan)
            else:
                p = posterior_padded(s[at], x[at], length)[inside]
                label, conf = p.argmax(1), p.max(1)
            yield pd.DataFrame({"id": pdf["id"].to_numpy()[at[inside]], "label": label.astype("int32"), "conf": conf})
            lo = hi

    def run(batches):
        held = None
        for pdf in batches:
            held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            chain = held["chain"].to_numpy()
            cut = int(np.flatnonzero(chain != chain[-1])[-1]) + 1 if len(chain) and (chain != chain[-1]).any() else 0
            if cut >= 50_000:
                yield from decoded(held.iloc[:cut].reset_index(drop=True))
                held = held.iloc[cut:].reset_index(drop=True)
        if held is not None and len(held):
            yield from decoded(held)

    kind = dict(rows.dtypes)["id"]
    ordered = rows.select("chain", "pos", "id", "p", extra.alias("extra")).repartition("chain").sortWithinPartitions("chain", "pos")
    return ordered.mapInPandas(run, f"id {kind}, label int, conf double")


def icm_rounds(scores: DataFrame, edges: DataFrame, strength: float, rounds: int, settle, coupling: DataFrame | None = None) -> DataFrame:
    """Potts relabelling as joins: in each round one half of the rows (by a hash) takes the class of
    greatest score plus ``strength`` times the weight of neighbours that have it. ``coupling`` (class,
    to, m), a row for a pair of classes, spreads a neighbour's weight over other classes too.
    ``scores``: id, class, s; ``edges``: src, dst, w; ``settle`` cuts the lineage. Returns id, class."""
    label = settle(best(scores, "s").select("id", "class"))
    half = (lcg(lcg(F.col("id"))) / 65536).cast("long") % 2
    for k in range(rounds):
        near = edges.join(label.select(F.col("id").alias("dst"), "class"), "dst").groupBy(F.col("src").alias("id"), "class").agg(F.sum("w").alias("w"))
        if coupling is not None:
            near = near.join(coupling, "class").groupBy("id", F.col("to").alias("class")).agg(F.sum(F.col("w") * F.col("m")).alias("w"))
        total = scores.join(near, ["id", "class"], "left").withColumn("s", F.col("s") + F.coalesce(F.col("w") * strength, F.lit(0.0)))
        new = best(total, "s").select("id", F.col("class").alias("new"))
        label = settle(label.join(new, "id").select("id", F.when(half == k % 2, F.col("new")).otherwise(F.col("class")).alias("class")))
    return label


def segment_labels(scores: DataFrame, placed: DataFrame, bands: DataFrame, price: float, rounds: int) -> DataFrame:
    """One class for each run of equal labels along a chain: the one of greatest summed score less the
    class's price for each row; prices move by ``price`` / round where a class's count is outside its
    band. ``scores``: session, id, class, s; ``placed``: id, chain, pos, label; ``bands``: session, class,
    lo, hi. Returns session, id, segment, class."""
    w = Window.partitionBy("chain").orderBy("pos")
    run = F.sum(F.when(F.lag("label").over(w) == F.col("label"), 0).otherwise(1)).over(w)
    seg = placed.withColumn("run", run).select("id", "chain", "run")
    total = scores.join(seg, "id").groupBy("session", "chain", "run", "class").agg(F.sum("s").alias("s"), F.count("*").alias("n"))
    prices = bands.withColumn("price", F.lit(0.0))

    def picked(prices):
        x = total.join(prices.select("session", "class", "price"), ["session", "class"]).withColumn("v", F.col("s") - F.col("price") * F.col("n"))
        r = F.row_number().over(Window.partitionBy("chain", "run").orderBy(F.desc(F.round("v", 6)), "class"))
        return x.withColumn("r", r).where("r = 1")

    for k in range(rounds):
        n = picked(prices).groupBy("session", "class").agg(F.sum("n").alias("n"))
        count = F.coalesce("n", F.lit(0))
        move = F.when(count > F.col("hi"), price / (k + 1)).when(count < F.col("lo"), -price / (k + 1)).otherwise(0.0)
        prices = prices.join(n, ["session", "class"], "left").select("session", "class", "lo", "hi", (F.col("price") + move).alias("price"))
    return seg.join(picked(prices).select("session", "chain", "run", "class"), ["chain", "run"]).select("session", "id", F.col("run").alias("segment"), "class")


def default_targets(rows: DataFrame, per_class: float, null_share: float, classes: int) -> DataFrame:
    """(session, class, target): class 0 takes what ``per_class`` for each of the others leaves, but at
    least ``null_share`` of the rows; the others share the rest. ``rows``: session, id."""
    n = rows.groupBy("session").agg(F.count("*").cast("double").alias("n"))
    null = F.greatest(F.col("n") - (classes - 1) * per_class, F.col("n") * null_share)
    each = n.select("session", "n", null.alias("null"), F.explode(F.sequence(F.lit(0), F.lit(classes - 1))).alias("class"))
    return each.select("session", "class", F.when(F.col("class") == 0, F.col("null")).otherwise((F.col("n") - F.col("null")) / (classes - 1)).alias("target"))


def powered(df: DataFrame, power: float, floor: float = 1e-12) -> DataFrame:
    """p ** power, each row's adding up to one again."""
    x = df.withColumn("p", F.pow(F.greatest("p", F.lit(floor)), F.lit(power)))
    return x.withColumn("p", F.col("p") / F.sum("p").over(Window.partitionBy("id")))


def mixed(a: DataFrame, b: DataFrame, w: float, floor: float = 1e-12) -> DataFrame:
    """a ** (1 - w) * b ** w, normalised: session, id, class, p."""
    j = a.join(b.select("id", "class", F.col("p").alias("q")), ["id", "class"])
    x = j.withColumn("p", F.pow(F.greatest("p", F.lit(floor)), F.lit(1 - w)) * F.pow(F.greatest("q", F.lit(floor)), F.lit(w)))
    return x.select("session", "id", "class", (F.col("p") / F.sum("p").over(Window.partitionBy("id"))).alias("p"))


def best(df: DataFrame, score: str = "p", by: str = "id") -> DataFrame:
    """The class of greatest score in each group (ties within 1e-6: smaller class)."""
    r = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(F.round(score, 6)), "class"))
    return df.withColumn("__r", r).where("__r = 1").drop("__r")


def finish(df: DataFrame, targets: DataFrame, sharpen: float = 0.5, rounds: int = 50) -> DataFrame:
    """Sharpen, fit to the targets, take the best class: session, id, class, p."""
    return best(ipf(powered(df, 1 / sharpen), targets, rounds))


def band_bias(df: DataFrame, bands: DataFrame, step: float, rounds: int) -> DataFrame:
    """(session, class, lo, hi, bias): in each round classes that have too few rows get ``step`` on all
    their scores, and those with too many lose it. ``df``: session, id, class, s; ``bands``: session,
    class, lo, hi."""
    bias = bands.withColumn("bias", F.lit(0.0))
    for _ in range(rounds):
        label = best(df.join(bias, ["session", "class"]).withColumn("s", F.col("s") + F.col("bias")), "s")
        n = label.groupBy("session", "class").agg(F.count("*").alias("n"))
        count = F.coalesce("n", F.lit(0))
        move = F.when(count < F.col("lo"), step).when(count > F.col("hi"), -step).otherwise(0.0)
        bias = bias.join(n, ["session", "class"], "left").select("session", "class", "lo", "hi", (F.col("bias") + move).alias("bias"))
    return bias


def count_bands(df: DataFrame, bands: DataFrame, step: float, rounds: int) -> DataFrame:
    """Labels whose counts are led into bands, with their biased scores: session, id, class, s."""
    bias = band_bias(df, bands, step, rounds)
    return best(df.join(bias, ["session", "class"]).select("session", "id", "class", (F.col("s") + F.col("bias")).alias("s")), "s")


def swap_gains(df: DataFrame, floor: float = 1e-9) -> DataFrame:
    """(session, a, b, gain, n): what a session's rows would gain if all rows labelled a were b and those
    labelled b were a, in summed log-probabilities. ``df``: session, id, class, p."""
    own = best(df).select("id", F.col("class").alias("label"))
    e = df.join(own, "id").groupBy("session", "label", "class").agg(F.sum(F.ln(F.greatest("p", F.lit(floor)))).alias("e"), F.count("*").alias("n"))
    home = e.where(F.col("label") == F.col("class")).select("session", "label", F.col("e").alias("h"), "n")
    away = e.where(F.col("label") != F.col("class")).select("session", "label", F.col("class").alias("other"), "e")
    one = away.join(home, ["session", "label"]).select("session", F.col("label").alias("a"), F.col("other").alias("b"), (F.col("e") - F.col("h")).alias("g"), "n")
    two = one.select("session", F.col("a").alias("b"), F.col("b").alias("a"), F.col("g").alias("g2"), F.col("n").alias("n2"))
    both = one.join(two, ["session", "a", "b"], "left").where((F.col("a") < F.col("b")) | F.col("g2").isNull())
    return both.select("session", "a", "b", (F.col("g") + F.coalesce("g2", F.lit(0.0))).alias("gain"), (F.col("n") + F.coalesce("n2", F.lit(0))).alias("n"))


def refined_segments(scores: DataFrame, placed: DataFrame, edges: DataFrame, strength: float) -> DataFrame:
    """Each run of equal labels along a chain as a whole takes the class of greatest summed score plus
    ``strength`` times the weight of neighbours outside it that have the class. ``scores``: id, class,
    s; ``placed``: id, chain, pos, label; ``edges``: src, dst, w. Returns id, chain, run, class."""
    w = Window.partitionBy("chain").orderBy("pos")
    run = F.sum(F.when(F.lag("label").over(w) == F.col("label"), 0).otherwise(1)).over(w)
    seg = placed.select("id", "chain", run.alias("run"), "label")
    own = scores.join(seg, "id").groupBy("chain", "run", "class").agg(F.sum("s").alias("s"))
    a = seg.select(F.col("id").alias("src"), "chain", "run")
    b = seg.select(F.col("id").alias("dst"), F.col("chain").alias("c2"), F.col("run").alias("r2"), F.col("label").alias("class"))
    votes = edges.join(a, "src").join(b, "dst").where("not (chain = c2 and run = r2)").groupBy("chain", "run", "class").agg(F.sum("w").alias("w"))
    total = own.join(votes, ["chain", "run", "class"], "left").withColumn("s", F.col("s") + strength * F.coalesce("w", F.lit(0.0)))
    r = F.row_number().over(Window.partitionBy("chain", "run").orderBy(F.desc(F.round("s", 6)), "class"))
    return seg.select("id", "chain", "run").join(total.withColumn("r", r).where("r = 1").select("chain", "run", "class"), ["chain", "run"])


def family_scores(df: DataFrame, family) -> DataFrame:
    """session, id, class, p, family, f: the family's log-sum-exp of log-probabilities beside each class."""
    x = df.withColumn("family", family)
    return x.withColumn("f", F.ln(F.sum("p").over(Window.partitionBy("id", "family"))))
