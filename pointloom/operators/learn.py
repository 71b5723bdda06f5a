"""Evaluation of predictions, and posteriors of arms from rewards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def softmax(scores: Column) -> Column:
    e = F.transform(scores, lambda x: F.exp(x - F.array_max(scores)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def argmax_class(probs: Column) -> Column:
    return (F.array_position(probs, F.array_max(probs)) - 1).cast("int")


def accuracy(preds: DataFrame) -> DataFrame:
    """Share of right classes and mean negative log-likelihood of (label, probs)."""
    hit = (argmax_class(F.col("probs")) == F.col("label")).cast("double")
    return preds.agg(F.avg(hit).alias("accuracy"), F.avg(-F.log(F.get("probs", F.col("label")))).alias("nll"), F.count("*").alias("n"))


def accuracy_by(preds: DataFrame, key: str) -> DataFrame:
    return preds.groupBy(key).agg(F.avg((argmax_class(F.col("probs")) == F.col("label")).cast("double")).alias("accuracy"), F.count("*").alias("n"))


def confusion(preds: DataFrame, k: int) -> DataFrame:
    """All k x k cells of label and prediction."""
    cells = preds.groupBy("label", argmax_class(F.col("probs")).alias("pred")).agg(F.count("*").alias("n"))
    grid = preds.sparkSession.range(k * k).select((F.col("id") / k).cast("int").alias("label"), (F.col("id") % k).cast("int").alias("pred"))
    return grid.join(cells, ["label", "pred"], "left").select("label", "pred", F.coalesce("n", F.lit(0)).alias("n"))


def binary_metrics(preds: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Error rate in percent, false-positive rate (0 without negatives), precision and recall (1 without positive
    predictions, as the library this follows has it; recall is null without positive labels)."""
    p, y = F.col("score") >= threshold, F.col("label") == 1
    c = preds.agg(F.count("*").alias("n"), F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"), F.count_if(~p & y).alias("fn"), F.count_if(~p & ~y).alias("tn"))
    none = F.col("tp") + F.col("fp") == 0
    return c.select(
        (100 * (F.col("fp") + F.col("fn")) / F.col("n")).alias("error_rate"), F.coalesce(F.col("fp") / F.nullif(F.col("fp") + F.col("tn"), F.lit(0)), F.lit(0.0)).alias("fpr"),
        F.when(none, 1.0).otherwise(F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0))).alias("precision"), F.when(none, 1.0).otherwise(F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0))).alias("recall"),
    )


def topk_error(preds: DataFrame, k: int) -> DataFrame:
    """Percent of rows whose label isn't among the k likeliest; ties go by class."""
    own = F.get("probs", F.col("label"))
    before = F.size(F.filter("probs", lambda x, i: (x > own) | ((x == own) & (i < F.col("label")))))
    return preds.agg((100 * F.avg((before >= k).cast("double"))).alias("error"))


def merge_labels(preds: DataFrame, mapping: DataFrame) -> DataFrame:
    """Probabilities summed over the classes that mapping (old, new) puts together."""
    each = preds.select("row_id", F.posexplode("probs").alias("old", "p"))
    return each.join(mapping, "old").groupBy("row_id", "new").agg(F.sum("p").alias("p"))


def flatten_multiclass(preds: DataFrame) -> DataFrame:
    return preds.select("row_id", "label", F.posexplode("probs").alias("cls", "score")).select("row_id", "cls", "score", (F.col("cls") == F.col("label")).cast("int").alias("label"))


def _counts(preds: DataFrame) -> DataFrame:
    """By distinct score: p and q, the positives and negatives at it; tp and fp, those at it or above; ap and aq, all."""
    from .rounds import running

    by = preds.groupBy("score").agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") != 1).alias("q"))
    c = running(by, [F.desc("score")], {"tp": F.col("p"), "fp": F.col("q")})
    return c.crossJoin(F.broadcast(by.agg(F.sum("p").alias("ap"), F.sum("q").alias("aq"))))  # one row


def curve(preds: DataFrame) -> DataFrame:
    """Precision, recall and false-positive rate at each distinct score, from high to low.

    Rows are summed by score first; running sums go by ranges of scores, so all-distinct scores are no single task's work.
    """
    return _counts(preds).select("score", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), (F.col("tp") / F.col("ap")).alias("recall"), (F.col("fp") / F.col("aq")).alias("fpr"))


def average_precision(preds: DataFrame) -> DataFrame:
    """Average precision, and area under the ROC curve by trapezoids."""
    rise, run = F.col("p") / F.col("ap"), F.col("q") / F.col("aq")
    return _counts(preds).agg(
        F.sum(rise * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("average_precision"), F.sum(run * (2 * F.col("tp") - F.col("p")) / F.col("ap") / 2).alias("roc_auc"))


def mispredicted(preds: DataFrame, right: bool = False) -> DataFrame:
    return preds.where((argmax_class(F.col("probs")) == F.col("label")) == F.lit(right))


def vote(preds: DataFrame, key: str) -> DataFrame:
    """Commonest class of each key, the least of equals; score: mean best probability of the rows that agree."""
    each = preds.select(key, argmax_class(F.col("probs")).alias("cls"), F.array_max("probs").alias("best"))
    n = each.groupBy(key, "cls").agg(F.count("*").alias("n"), F.avg("best").alias("score"))
    return n.groupBy(key).agg(F.max_by(F.struct("cls", "score"), F.struct("n", (-F.col("cls")).alias("c"))).alias("x")).select(key, "x.cls", "x.score")


def losses(df: DataFrame, truth: str, guess: str, weight: str) -> DataFrame:
    """Cross entropy, squared error, and squared error with normalised weights."""
    t, g, w = F.col(truth), F.col(guess), F.col(weight)
    return df.agg(F.avg(-(t * F.log(g) + (1 - t) * F.log(1 - g))).alias("cross_entropy"), F.avg((t - g) ** 2).alias("squared"), (F.sum(w * (t - g) ** 2) / F.sum(w)).alias("weighted"))


def beta_posterior(rewards: DataFrame, arms: DataFrame | None = None, a0: float = 1.0, b0: float = 1.0) -> DataFrame:
    """alpha, beta, mean and variance of each arm; rewards outside [0, 1] are an error; arms without rewards keep the prior."""
    ok = rewards.withColumn("v", F.when((F.col("v") >= 0) & (F.col("v") <= 1), F.col("v")).otherwise(F.raise_error(F.lit("reward outside [0, 1]")).cast("double")))
    s = ok.groupBy("arm").agg(F.sum("v").alias("s"), F.count("*").alias("n"))
    if arms is not None:
        s = arms.join(s, "arm", "left").select("arm", F.coalesce("s", F.lit(0.0)).alias("s"), F.coalesce("n", F.lit(0)).alias("n"))
    s = s.select("arm", (a0 + F.col("s")).alias("alpha"), (b0 + F.col("n") - F.col("s")).alias("beta"), "n")
    t = F.col("alpha") + F.col("beta")
    return s.select("*", (F.col("alpha") / t).alias("mean"), (F.col("alpha") * F.col("beta") / (t * t * (t + 1))).alias("variance"))


#: Twice the normal distribution function at 0.68.
BERNOULLI_WIDTH = 1.5034945


def bernoulli_posterior(rewards: DataFrame) -> DataFrame:
    p = rewards.groupBy("arm").agg(F.avg("v").alias("mean"), F.count("*").alias("n"))
    return p.withColumn("width", BERNOULLI_WIDTH * F.sqrt(F.col("mean") * (1 - F.col("mean")) / F.col("n")))


def gaussian_posterior(rewards: DataFrame, mode: str = "as written") -> DataFrame:
    """Mean, population variance, and uncertainty: variance / sqrt(n), or with mode "standard" variance / n."""
    g = rewards.groupBy("arm").agg(F.avg("v").alias("mean"), F.avg(F.col("v") * F.col("v")).alias("sq"), F.count("*").alias("n"))
    g = g.withColumn("variance", F.col("sq") - F.col("mean") ** 2)
    return g.select("arm", "mean", "variance", "n", (F.col("variance") / (F.col("n") if mode == "standard" else F.sqrt("n"))).alias("uncertainty"))


def best_arms(state: DataFrame) -> DataFrame:
    """All arms of the largest mean."""
    top = state.agg(F.max("mean").alias("_top"))
    return state.join(F.broadcast(top), F.col("mean") == F.col("_top")).drop("_top")


def best_arm_lcb(state: DataFrame, z: float) -> DataFrame:
    """The arm of the largest mean - z sd (a normal stand-in for the exact Beta quantile)."""
    return state.withColumn("lcb", F.col("mean") - z * F.sqrt("variance")).orderBy(F.desc("lcb"), "arm").limit(1)


def with_quantile(state: DataFrame, p: Column, name: str) -> DataFrame:
    """Adds the exact Beta quantile of each arm (alpha, beta) at p."""
    from ..functions import once
    from ..functions.beta import beta_quantile, log_beta

    s = once(state, p.alias("_at"), log_beta(F.col("alpha"), F.col("beta")).alias("_ln"))
    return s.withColumn(name, beta_quantile(F.col("_at"), F.col("alpha"), F.col("beta"), F.col("_ln"))).drop("_at", "_ln")


#: Arms whose quantiles are worked out first, and how far below the largest of these another one's may be and yet be worked out.
PILOTS, SLACK = 32, 1e-6


def may_be_largest(state: DataFrame, p: Column) -> DataFrame:
    """The arms (arm, alpha, beta, mean, variance) whose Beta quantile at p may be the largest; of equal alpha, beta and p the least arm.

    The quantiles of a few promising arms give a bound. Of each other arm, one value of the distribution function there
    tells on which side of it its quantile is.
    """
    from ..functions import once
    from ..functions.beta import beta_share, log_beta
    from .rounds import save

    cores = state.sparkSession.sparkContext.defaultParallelism  # arms are few bytes but much work
    s = save(once(state.repartition(4 * cores, "arm"), p.alias("_p"), log_beta(F.col("alpha"), F.col("beta")).alias("_lb")))
    odds = F.log((F.col("_p") + 1e-12) / (1 - F.col("_p") + 1e-12)) / 1.702  # close to the normal quantile
    pilots = save(s.orderBy(F.desc(F.col("mean") + odds * F.sqrt("variance")), "arm").limit(PILOTS).repartition(cores))
    bound = with_quantile(pilots, F.col("_p"), "_q").agg(F.max("_q")).first()[0]
    if bound is not None and SLACK < bound < 1:
        share = beta_share(F.lit(bound - SLACK), F.col("alpha"), F.col("beta"), F.col("_lb"))
        s = once(s, share.alias("_share")).where((F.col("_share") < F.col("_p")) | F.isnan("_share"))
    rows = s.groupBy("alpha", "beta", "_p").agg(F.min_by(F.struct(*state.columns), "arm").alias("x"))
    return rows.select("x.*")


def best_arm_quantile(state: DataFrame, p: float) -> DataFrame:
    """The arm with the largest lower confidence bound, the exact Beta quantile at p; the least arm of equals."""
    p = F.lit(float(p))
    return with_quantile(may_be_largest(state, p), p, "lcb").orderBy(F.desc("lcb"), "arm").limit(1)


def ucb_arm(state: DataFrame, b: float) -> DataFrame:
    return state.withColumn("ucb", F.col("mean") + b * F.sqrt("variance")).orderBy(F.desc("ucb"), "arm").limit(1)


def posterior_history(rewards: DataFrame, rate: int, a0: float = 1.0, b0: float = 1.0) -> DataFrame:
    """The posterior of each arm after every ``rate`` rewards, and after the last.

    Sums run over ranges of (arm, seq), so an arm with most of the rewards is shared among tasks.
    """
    from .rounds import running_within

    one = F.lit(1).cast("long")
    h = running_within(rewards.select("arm", "seq", "v"), ["arm"], [F.col("seq")], {"k": one, "s": F.col("v")}, {"n": one})
    return h.where((F.col("k") % rate == 0) | (F.col("k") == F.col("n"))).select("arm", "k", (a0 + F.col("s")).alias("alpha"), (b0 + F.col("k") - F.col("s")).alias("beta"))


class Stop:
    """When an arm has had enough rewards: a test of the rewards so far (k), the last one, the one before it, and the posterior's variance.

    The test is made of comparisons joined by ``&`` and ``|``, so it holds for columns and for numpy arrays alike. Rules
    are put together with ``&`` and ``|`` as well.
    """

    def __init__(self, test):
        self.test = test

    def __and__(self, other: Stop) -> Stop:
        return Stop(lambda *now: self.test(*now) & other.test(*now))

    def __or__(self, other: Stop) -> Stop:
        return Stop(lambda *now: self.test(*now) | other.test(*now))

    @classmethod
    def count(cls, most: int) -> Stop:
        return cls(lambda k, value, before, variance: k >= most)

    @classmethod
    def progress(cls, eps: float) -> Stop:
        """The last two rewards differ by less than eps; before the first one, the reward counts as 0."""
        return cls(lambda k, value, before, variance: (value - before < eps) & (before - value < eps))

    @classmethod
    def confidence(cls, eps: float) -> Stop:
        """The posterior's variance is below eps."""
        return cls(lambda k, value, before, variance: variance < eps)


def beta_variance(a, b):
    """Variance of a Beta distribution, of columns or arrays."""
    return a * b / ((a + b) * (a + b) * (a + b + 1))


def posterior_until(rewards: DataFrame, stop: Stop, a0: float = 1.0, b0: float = 1.0) -> DataFrame:
    """(arm, alpha, beta, n, stopped): each arm's posterior when ``stop`` first holds, or after its last reward if it never does.

    Rewards count in order of ``seq``; later ones than the stop are left out. Sums run over ranges of (arm, seq).
    """
    from .rounds import running_within

    h = running_within(rewards.select("arm", "seq", "v"), ["arm"], [F.col("seq")], {"n": F.lit(1).cast("long"), "s": F.col("v")}, previous={"before": F.col("v")})
    h = h.select("arm", "n", "v", F.coalesce("before", F.lit(0.0)).alias("before"), (a0 + F.col("s")).alias("alpha"), (b0 + F.col("n") - F.col("s")).alias("beta"))
    ends = stop.test(F.col("n"), F.col("v"), F.col("before"), beta_variance(F.col("alpha"), F.col("beta")))
    state = F.struct("n", "alpha", "beta")
    found = h.groupBy("arm").agg(F.min(F.when(ends, state)).alias("first"), F.max(state).alias("last"))
    now = F.coalesce("first", "last")
    return found.select("arm", now["alpha"].alias("alpha"), now["beta"].alias("beta"), now["n"].alias("n"), F.col("first").isNotNull().alias("stopped"))


def best_per_bin(state: DataFrame, k: int, seed: int) -> DataFrame:
    """Arms dealt into k bins by hash; the best of each."""
    from ..functions import uniform

    b = state.withColumn("bin", F.floor(uniform(seed, F.col("arm")) * k))
    return b.groupBy("bin").agg(F.max_by("arm", F.struct("mean", (-F.col("arm")).alias("o"))).alias("arm"))


def objective(df: DataFrame, kind: str, column: str = "value", b: float = 0.0) -> DataFrame:
    c = F.col(column)
    return df.withColumn("objective", {"negate": -c, "threshold": (c >= b).cast("double"), "identity": c}[kind])


def least_squares_terms(df: DataFrame, xs: list[str], y: str) -> DataFrame:
    """Sums for the normal equations: (i, j, s) with j = -1 for the right-hand side."""
    pairs = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), (F.col(a) * F.col(b)).alias("v")) for i, a in enumerate(xs) for j, b in enumerate(xs)] + [F.struct(F.lit(i).alias("i"), F.lit(-1).alias("j"), (F.col(a) * F.col(y)).alias("v")) for i, a in enumerate(xs)]
    return df.select(F.explode(F.array(*pairs)).alias("e")).groupBy("e.i", "e.j").agg(F.sum("e.v").alias("s"))
