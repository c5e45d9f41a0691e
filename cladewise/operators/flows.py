"""Flows between groups: sampling from the posterior, aggregation, key quantities, diagnostics.

draws: chain, sample, source, recipient, value (of log flows or flows).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .reports import numbered

QUANTILES = {"cl": 0.025, "il": 0.25, "m": 0.5, "iu": 0.75, "cu": 0.975}


def thinned(draws: DataFrame, burn_in: float = 0.0, every: int = 1, key: str = "sample", group: Sequence[str] = ()) -> DataFrame:
    """Without the first share of samples, then every k-th one; by group, or of all samples, which are then numbered by ranges."""
    own = draws.select(*group, key).distinct()
    if group:
        ranked = own.withColumns({"_r": F.row_number().over(Window.partitionBy(*group).orderBy(key)), "_n": F.count("*").over(Window.partitionBy(*group))})
    else:
        ranked = numbered(own, key, "_r").crossJoin(F.broadcast(own.agg(F.count("*").alias("_n"))))  # one row
    skip = F.floor(F.col("_n") * F.lit(burn_in))
    kept = ranked.where((F.col("_r") > skip) & ((F.col("_r") - skip - 1) % every == 0)).select(*group, key)
    return draws.join(kept, [*group, key], "left_semi")


def log_sums(draws: DataFrame, *keys: str, value: str = "value") -> DataFrame:
    """log of the sum of exp(value) by keys, shifted by the group's largest value."""
    top = draws.groupBy(*keys).agg(F.max(value).alias("_top"))
    return draws.join(top, list(keys)).groupBy(*keys).agg((F.first("_top") + F.log(F.sum(F.exp(F.col(value) - F.col("_top"))))).alias(value))


def to_target(draws: DataFrame, target: DataFrame, on: str = "pair_id") -> DataFrame:
    """Sums of flows (draws hold logs) over the target's source and recipient: sample, source, recipient, value."""
    return draws.join(target, on).groupBy("sample", "source", "recipient").agg(F.sum(F.exp("value")).alias("value"))


def proportions(flows: DataFrame, *within: str) -> DataFrame:
    """value over the sum of the sample, or of the sample and the named group."""
    return flows.withColumn("value", F.col("value") / F.sum("value").over(Window.partitionBy("sample", *within)))


def quantiles(rows: DataFrame, *keys: str, value: str = "value", shares: dict[str, float] = QUANTILES) -> DataFrame:
    """Named quantiles (linear interpolation); labelled() puts them into words."""
    out = rows.groupBy(*keys).agg(F.percentile(value, F.array(*map(F.lit, shares.values()))).alias("_p")).select(*keys, *[F.col("_p")[i].alias(n) for i, n in enumerate(shares)])
    return out


def labelled(rows: DataFrame) -> DataFrame:
    """rows with a label "median [lower - upper]" in percent of one decimal, halves to even."""
    percent = lambda c: F.concat(F.bround(F.col(c) * 100, 1).cast("decimal(20,1)").cast("string"), F.lit("%"))
    return rows.withColumn("label", F.concat(percent("m"), F.lit(" ["), percent("cl"), F.lit(" - "), percent("cu"), F.lit("]")))


def waifm(flows: DataFrame) -> DataFrame:
    """Of a source's flows the part that goes to each recipient."""
    return quantiles(proportions(flows, "source"), "source", "recipient")


def sources(flows: DataFrame) -> DataFrame:
    """Of a recipient's flows the part that comes from each source."""
    return quantiles(proportions(flows, "recipient"), "source", "recipient")


def ratios(flows: DataFrame, pairs: Sequence[tuple[str, tuple[str, str], tuple[str, str]]]) -> DataFrame:
    """Quantiles of ratios of two flows by sample; a flow that is missing counts as 0, a ratio to 0 is left out."""
    part = lambda p: F.coalesce(F.sum(F.when((F.col("source") == p[0]) & (F.col("recipient") == p[1]), F.col("value"))), F.lit(0.0))
    wide = flows.groupBy("sample").agg(*[part(p).alias(f"{side}{i}") for i, (_, a, b) in enumerate(pairs) for side, p in (("a", a), ("b", b))])
    each = F.array(*[F.struct(F.lit(n).alias("ratio"), F.try_divide(F.col(f"a{i}"), F.col(f"b{i}")).alias("value")) for i, (n, _, _) in enumerate(pairs)])
    return quantiles(wide.select("sample", F.inline(each)).where("value is not null"), "ratio")


def grid_counts(observed: DataFrame, sources_: DataFrame, recipients: DataFrame) -> DataFrame:
    """All pairs of categories with their counts, 0 where nothing was seen; counts of other categories stay."""
    grid = sources_.select("source").distinct().crossJoin(recipients.select("recipient").distinct())
    return grid.join(observed, ["source", "recipient"], "full").withColumn("obs", F.coalesce("obs", F.lit(0)))


def errors(estimates: DataFrame, truth: DataFrame, *keys: str) -> DataFrame:
    """Mean and worst absolute error of each replicate."""
    off = F.abs(F.col("value") - F.col("truth"))
    return estimates.join(truth, list(keys)).groupBy("replicate").agg(F.avg(off).alias("mae"), F.max(off).alias("worst"))


def band(age: Column, width: int) -> Column:
    """Right-open classes of a width: lower end."""
    return F.floor(age / width) * width


def imputed(rows: DataFrame, column: str, *by: str) -> DataFrame:
    """Nulls become the mean of the group, or of all."""
    whole = rows.agg(F.avg(column).alias("_all"))  # one row
    return rows.crossJoin(F.broadcast(whole)).withColumn(column, F.coalesce(F.col(column), F.avg(column).over(Window.partitionBy(*by)), F.col("_all"))).drop("_all")


# -- sampling ----------------------------------------------------------------------------------------------


def flow_posterior(obs: np.ndarray, source: np.ndarray, recipient: np.ndarray, prior: list[np.ndarray], steps: int, seed: int, joint: bool = False) -> tuple[np.ndarray, np.ndarray, float]:
    """Metropolis within Gibbs. Counts are Poisson with rate flow * xi_source * xi_recipient; flows have Gamma(0.8 / n, b) priors.

    obs: counts by pair; source, recipient: numbers of the pairs' unknown sampling probabilities; prior: draws of
    each of these. Odd steps propose one category's probability from its prior and weigh it by the
    likelihood of all pairs it takes part in, even steps draw the flows. joint: the probability and its pairs' flows
    are proposed together, the flows from their conditional, so that the ratio has the flows integrated out.
    Returns log flows and probabilities by step, and the share of proposals that were accepted.
    """
    rng, n = np.random.default_rng(seed), len(obs)
    xi = np.array([p[rng.integers(len(p))] for p in prior])
    mean = np.array([p.mean() for p in prior])
    p = np.clip(mean[source] * mean[recipient], 1e-9, 1)
    guess = np.where(obs > 0, obs / p, (1 - p) / p)
    shape, rate = 0.8 / n, 0.8 / guess.sum()

    def flows() -> np.ndarray:
        # The log of a gamma variate with a small shape: that of shape + 1, and a power of a uniform.
        a = shape + obs
        return np.log(rng.gamma(a + 1)) + np.log(rng.random(n)) / a - np.log(rate + xi[source] * xi[recipient])

    touch = [np.flatnonzero((source == c) | (recipient == c)) for c in range(len(prior))]
    log_flow = flows()
    kept, kept_xi, accepted, tried = [], [], 0, 0
    for _ in range(steps):
        for c in range(len(prior)):
            new = xi.copy()
            new[c] = prior[c][rng.integers(len(prior[c]))]
            t = touch[c]
            was, now = (x[source[t]] * x[recipient[t]] for x in (xi, new))
            gain = (obs[t] * (np.log(now) - np.log(was))).sum()
            if joint:
                gain -= ((shape + obs[t]) * (np.log(rate + now) - np.log(rate + was))).sum()
            else:
                gain -= (np.exp(log_flow[t]) * (now - was)).sum()
            tried += 1
            if np.log(rng.random()) < gain:
                xi, accepted = new, accepted + 1
                if joint:
                    log_flow[t] = flows()[t]
            if not joint:
                log_flow = flows()
        kept.append(log_flow.copy()), kept_xi.append(xi.copy())
    return np.array(kept), np.array(kept_xi), accepted / max(1, tried)


def flow_draws(obs: DataFrame, prior: DataFrame, chains: int = 4, steps: int = 200, seed: int = 42, joint: bool = False) -> DataFrame:
    """Posterior draws: chain, sample, source, recipient, value (log flow), accepted. Chains run side by side.

    obs (source, recipient, obs) and prior (category, p, and who: "source", "recipient" or null) are a study's
    category tables: pairs of population groups, not its people; each chain needs all of them and gets them with
    its group. A category may have a prior for each role; a prior without a role, or a table without the column,
    stands for both, and a category without a prior for one of its roles is an error.
    """
    prior = prior if "who" in prior.columns else prior.withColumn("who", F.lit(None).cast("string"))
    rows = obs.select(F.lit(0).alias("kind"), "source", "recipient", F.col("obs").cast("double").alias("x")).unionByName(prior.select(F.lit(1).alias("kind"), F.col("category").alias("source"), F.col("who").alias("recipient"), F.col("p").alias("x")))
    rows = rows.withColumn("chain", F.explode(F.sequence(F.lit(1), F.lit(chains))))

    def run(group: tuple, part: pd.DataFrame) -> pd.DataFrame:
        pairs = part[part["kind"] == 0].sort_values(["source", "recipient"])
        draws = {(c, None if pd.isna(w) else w): np.sort(g["x"].to_numpy()) for (c, w), g in part[part["kind"] == 1].groupby(["source", "recipient"], dropna=False)}
        # A prior for both roles is one unknown for both.
        names = sorted(draws, key=lambda n: (n[0], n[1] or ""))
        code = {n: i for i, n in enumerate(names)}
        of = lambda who: np.array([code[c, who] if (c, who) in code else code[c, None] for c in pairs[who]])
        flow, _, accepted = flow_posterior(pairs["x"].to_numpy(), of("source"), of("recipient"), [draws[c] for c in names], steps, seed + int(group[0]), joint)
        n = len(pairs)
        return pd.DataFrame({"chain": int(group[0]), "sample": np.repeat(np.arange(1, steps + 1), n), "source": np.tile(pairs["source"].to_numpy(), steps), "recipient": np.tile(pairs["recipient"].to_numpy(), steps), "value": flow.reshape(-1), "accepted": accepted})

    return rows.groupBy("chain").applyInPandas(run, "chain int, sample long, source string, recipient string, value double, accepted double")


#: Autocorrelations that are found one by one; if more are needed, all are by a Fourier transform.
LAGS = 64


def effective_size(x: np.ndarray) -> float:
    """Effective sample size from the autocorrelations up to the first pair that doesn't add up to more than 0. Later ones are not asked for, so the work is n log n at most."""
    n = len(x)
    if n < 4 or x.std() == 0:
        return float(n)
    x = x - x.mean()
    whole, total, rho = x @ x, 0.0, None
    for k in range(1, n - 1, 2):
        if k > LAGS and rho is None:
            f = np.fft.rfft(x, 1 << (2 * n - 1).bit_length())
            rho = np.fft.irfft(f * f.conj())[:n] / whole
        pair = (x[:-k] @ x[k:] + x[: -k - 1] @ x[k + 1 :]) / whole if rho is None else rho[k] + rho[k + 1]
        if pair <= 0:
            break
        total += pair
    return float(n / (1 + 2 * total))


def diagnostics(draws: DataFrame, *keys: str) -> DataFrame:
    """Per quantity: n, mean, sd, median, 95 % range, effective size. A group is one quantity's draws."""
    basic = draws.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.percentile("value", F.array(*map(F.lit, (0.025, 0.5, 0.975)))).alias("_p"))
    basic = basic.select(*keys, "n", "mean", "sd", F.col("_p")[1].alias("median"), F.col("_p")[0].alias("lower"), F.col("_p")[2].alias("upper"))

    def run(group: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([[*group, effective_size(rows.sort_values("sample")["value"].to_numpy())]], columns=[*keys, "ess"])

    kinds = ", ".join(f"{k} {draws.schema[k].dataType.simpleString()}" for k in keys)
    return basic.join(draws.select(*keys, "sample", "value").groupBy(*keys).applyInPandas(run, f"{kinds}, ess double"), list(keys))


def lowest(rows: DataFrame, column: str, k: int = 10) -> DataFrame:
    return rows.orderBy(column).limit(k)
