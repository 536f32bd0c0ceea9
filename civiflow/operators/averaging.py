"""Client-partitioned fitting of a linear model by parameter averaging."""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civiflow.operators.metrics import bin_sums, fold_bins, rates
from civiflow.operators.prep import class_weights

# ``_flat`` travels with the tasks, so executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def average_parameters(params: DataFrame, by: list[str], index: str = "idx") -> DataFrame:
    """Mean of client values weighted by their example counts.

    ``params`` is long: one row per (by, client, idx) with ``value`` and ``n``.
    """
    return params.groupBy(*by, index).agg((F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("value"))


def clip_scale(norm: Column, clip: float) -> Column:
    return F.least(F.lit(1.0), F.lit(float(clip)) / F.greatest(norm, F.lit(1e-12)))


def hashed_normal(seed: int, *keys: Column) -> Column:
    """Standard normal number that depends on the keys alone, so retries repeat it."""

    def uniform(salt: int) -> Column:
        h = F.pmod(F.xxhash64(*keys, F.lit(seed), F.lit(salt)), F.lit(1 << 52))
        return (h + F.lit(1.0)) / F.lit(float((1 << 52) + 1))

    return F.sqrt(F.lit(-2.0) * F.log(uniform(1))) * F.cos(F.lit(2 * math.pi) * uniform(2))


def protect_updates(
    client: DataFrame,
    reference: DataFrame,
    clip: float = 1.0,
    noise_multiplier: float = 1.0,
    seed: int = 42,
) -> DataFrame:
    """Clip each client's change to norm ``clip`` and add noise.

    ``client`` has (client, idx, value, n), ``reference`` (idx, value). Noise has
    deviation ``noise_multiplier * clip / max(sqrt(n), 1)``.
    """
    ref = reference.select("idx", F.col("value").alias("base"))
    moved = client.join(ref, "idx").withColumn("delta", F.col("value") - F.col("base"))
    norms = moved.groupBy("client").agg(F.sqrt(F.sum(F.col("delta") * F.col("delta"))).alias("update_norm"))
    sigma = F.lit(float(noise_multiplier * clip)) / F.greatest(F.sqrt("n"), F.lit(1.0))
    noise = sigma * hashed_normal(seed, F.col("client"), F.col("idx")) if noise_multiplier > 0 else F.lit(0.0)
    scaled = moved.join(norms, "client").withColumn("scale", clip_scale(F.col("update_norm"), clip))
    return scaled.select(
        "client",
        "idx",
        (F.col("base") + F.col("delta") * F.col("scale") + noise).alias("value"),
        "n",
        "update_norm",
        "scale",
    )


def stop_rounds(history: DataFrame, by: list[str], patience: int, min_delta: float = 1e-4) -> DataFrame:
    """Best round and rounds run under early stopping, per run.

    A round is a new best only if it beats the best so far by more than
    ``min_delta``; ``patience`` rounds without one end the run. The fold needs
    the rounds of one run in order, a few dozen entries.
    """
    start = F.struct(
        F.lit(float("-inf")).alias("best"),
        F.lit(0).alias("best_round"),
        F.lit(0).alias("stale"),
        F.lit(0).alias("rounds"),
    )

    def step(acc: Column, x: Column) -> Column:
        better = x["metric"] > acc["best"] + F.lit(min_delta)
        moved = F.struct(
            F.when(better, x["metric"]).otherwise(acc["best"]).alias("best"),
            F.when(better, x["round"]).otherwise(acc["best_round"]).alias("best_round"),
            F.when(better, F.lit(0)).otherwise(acc["stale"] + 1).alias("stale"),
            (acc["rounds"] + 1).alias("rounds"),
        )
        return F.when(acc["stale"] >= patience, acc).otherwise(moved)

    entry = F.struct(F.col("round").cast("int").alias("round"), F.col("metric").cast("double").alias("metric"))
    rounds = F.sort_array(F.collect_list(entry))
    return (
        history.groupBy(*by)
        .agg(F.aggregate(rounds, start, step).alias("s"))
        .select(
            *by,
            F.col("s.best_round").alias("best_round"),
            F.col("s.best").alias("best_metric"),
            F.col("s.rounds").alias("rounds_completed"),
        )
    )


def round_metrics(client_rounds: DataFrame, clients: list[str]) -> DataFrame:
    """Mean loss and macro-F1 per (run, round) with one macro-F1 column per client."""
    return client_rounds.groupBy("run", "round").agg(
        F.avg("train_loss").alias("mean_train_loss"),
        F.avg("macro_f1").alias("mean_val_macro_f1"),
        *[F.max(F.when(F.col("client") == c, F.col("macro_f1"))).alias(f"{c}_val_macro_f1") for c in clients],
    )


@dataclass(frozen=True)
class AveragingConfig:
    """Settings of one run; ``proximal_mu`` pulls clients to the shared model."""

    rounds: int = 8
    local_passes: int = 1
    learning_rate: float = 0.5
    proximal_mu: float = 0.0
    clip: float = 1.0
    noise_multiplier: float = 0.0
    patience: int = 4
    min_delta: float = 1e-4
    seed: int = 42


def entries(features: str = "features") -> tuple[Column, Column]:
    """Indices and values of a vector column; all of a dense vector."""
    v = F.unwrap_udt(features)
    return F.coalesce(v["indices"], F.sequence(F.lit(0), F.size(v["values"]) - 1)), v["values"]


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Items of all lists end to end, and how many each has."""
    return lists.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(lists).to_numpy(zero_copy_only=False)


def shift_of(df: DataFrame, features: str = "features") -> np.ndarray | None:
    """What each column is to be lowered by, where the vectors are stored without their shift."""
    noted = df.schema[features].metadata.get("shift")
    return None if noted is None else np.concatenate([np.zeros(noted["first"]), noted["values"]])


def _unshifted(w: np.ndarray, shift: np.ndarray | None) -> np.ndarray:
    """Weights that give vectors without their shift the same margins: the intercept bears it."""
    if shift is None:
        return w
    out = np.array(w, dtype=np.float64)
    out[..., -1] -= out[..., :-1] @ shift
    return out


def _scores(df: DataFrame, weights: list[np.ndarray], features: str) -> Column:
    """Scores of a row by each vector of weights, from one look at its entries."""
    flat, shared = _flat, _unshifted(np.stack(weights), shift_of(df, features))

    @F.arrow_udf("array<double>")
    def scores(indices: pa.Array, values: pa.Array) -> pa.Array:
        at, n = flat(indices)
        x = flat(values)[0]
        row = np.repeat(np.arange(len(n)), n)
        margin = np.stack([np.bincount(row, x * w[at], len(n)) + w[-1] for w in shared], axis=1)
        with np.errstate(over="ignore"):
            p = 1.0 / (1.0 + np.exp(-margin))
        ends = np.arange(0, p.size + 1, len(shared), dtype=np.int32)
        return pa.ListArray.from_arrays(ends, pa.array(p.ravel()))

    return scores(*entries(features))


def run_scores(df: DataFrame, weights: dict[str, np.ndarray], features: str = "features") -> DataFrame:
    """Rows once for each run, with its name and the ``score`` of its weights; the last weight is the intercept."""
    names = F.array(*map(F.lit, weights))
    each = F.arrays_zip(names.alias("run"), _scores(df, list(weights.values()), features).alias("score"))
    return df.select("*", F.inline(each))


def linear_scores(df: DataFrame, weights: np.ndarray, features: str = "features") -> DataFrame:
    """Add ``score`` of the shared model; the last weight is the intercept."""
    return df.withColumn("score", F.get(_scores(df, [weights], features), F.lit(0)))


def _gradients(train: DataFrame, per_client: dict[str, np.ndarray]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Mean weighted logistic gradient and loss per client, from one job for all.

    A client has one vector of weights, or one of each run. Rows stay where they
    are and only their entries other than zero are met; each task gives a vector
    per client and run, and their sums come back.
    """
    flat, shift = _flat, shift_of(train)
    sent = {c: np.atleast_2d(_unshifted(w, shift)) for c, w in per_client.items()}

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {c: [np.zeros(w.shape), np.zeros(len(w)), 0] for c, w in sent.items()}
        for batch in batches:
            clients = batch.column("client").to_numpy(zero_copy_only=False)
            for c in set(clients.tolist()) & set(sent):
                mine = batch.filter(pa.array(clients == c))
                total = sums[c]
                at, n = flat(mine.column("indices"))
                x = flat(mine.column("values"))[0]
                y, share = mine.column("label").to_numpy(), mine.column("pos_weight_of_row").to_numpy()
                row = np.repeat(np.arange(len(n)), n)
                for run, w in enumerate(sent[c]):
                    with np.errstate(over="ignore"):
                        p = 1.0 / (1.0 + np.exp(-(np.bincount(row, x * w[at], len(n)) + w[-1])))
                    residual = (p - y) * share
                    total[0][run] += np.bincount(at, x * residual[row], len(w))
                    total[0][run, -1] += residual.sum()
                    total[1][run] -= float((np.log(np.maximum(np.where(y == 1, p, 1.0 - p), 1e-15)) * share).sum())
                total[2] += len(n)
        met = [(c, run, s[0][run], s[1][run], s[2]) for c, s in sums.items() if s[2] for run in range(len(s[1]))]
        types = (pa.string(), pa.int32(), pa.list_(pa.float64()), pa.float64(), pa.int64())
        columns = [pa.array([m[i] for m in met], t) for i, t in enumerate(types)]
        yield pa.RecordBatch.from_arrays(columns, names=["client", "run", "g", "loss", "n"])

    indices, values = entries()
    rows = train.select("client", "label", "pos_weight_of_row", indices.alias("indices"), values.alias("values"))
    parts = rows.mapInArrow(partial, "client string, run int, g array<double>, loss double, n long")
    sums = parts.groupBy("client", "run").agg(
        vector_to_array(Summarizer.sum(array_to_vector("g"))).alias("g"), F.sum("loss").alias("loss"), F.sum("n").alias("n")
    )
    out = {}
    found = sums.toArrow().sort_by([("client", "ascending"), ("run", "ascending")])
    vectors = found["g"].combine_chunks()
    for i, (c, run, loss, n) in enumerate(zip(*(found[k].to_pylist() for k in ("client", "run", "loss", "n")))):
        g = vectors[i].values.to_numpy() / n
        if shift is not None:
            g = np.append(g[:-1] - shift * g[-1], g[-1])
        grads, losses = out.setdefault(c, ([], []))
        grads.append(g)
        losses.append(loss / n)
    return {c: (np.reshape(g, per_client[c].shape), np.array(losses) if per_client[c].ndim > 1 else losses[0]) for c, (g, losses) in out.items()}


def fit_by_averaging(
    train: DataFrame, val: DataFrame, config: AveragingConfig, run: str = "fedavg"
) -> tuple[np.ndarray, list[dict]]:
    """Rounds of local passes and averaging; returns the best weights and the history."""
    return fit_runs(train, val, {run: config})[run]


def fit_runs(train: DataFrame, val: DataFrame, variants: dict[str, AveragingConfig]) -> dict[str, tuple[np.ndarray, list[dict]]]:
    """Best weights and history of every run; the runs go side by side, so a pass reads the rows once for all.

    ``train`` and ``val`` are stored tables with ``client``, ``features`` and
    ``label``. Only the weights, a vector per client and run, visit the driver.
    """
    stats = class_weights(train, ["client"], "label").collect()
    clients = sorted(r["client"] for r in stats)
    n_of = {r["client"]: r["n"] for r in stats}
    pos = {r["client"]: float(r["pos_weight"]) for r in stats}
    pairs = [F.lit(x) for c in clients for x in (c, pos[c])]
    weighted = train.withColumn(
        "pos_weight_of_row",
        F.when(F.col("label") == 1, F.element_at(F.create_map(*pairs), F.col("client"))).otherwise(F.lit(1.0)),
    )
    width, total = train.select("features").first()["features"].size + 1, sum(n_of.values())
    shared = {run: np.zeros(width) for run in variants}
    best, best_metric, stale = dict(shared), dict.fromkeys(variants, -math.inf), dict.fromkeys(variants, 0)
    rng = {run: np.random.default_rng(config.seed) for run, config in variants.items()}
    history: dict[str, list[dict]] = {run: [] for run in variants}
    ended = set()
    for number in range(1, max((c.rounds for c in variants.values()), default=0) + 1):
        live = [run for run, c in variants.items() if number <= c.rounds and run not in ended]
        if not live:
            break
        local = {run: {c: shared[run].copy() for c in clients} for run in live}
        losses: dict[str, dict[str, float]] = {run: {} for run in live}
        for i in range(max(variants[run].local_passes for run in live)):
            now = [run for run in live if i < variants[run].local_passes]
            for c, (grads, means) in _gradients(weighted, {c: np.stack([local[run][c] for run in now]) for c in clients}).items():
                for run, grad, loss in zip(now, grads, means):
                    config = variants[run]
                    pull = config.proximal_mu * (local[run][c] - shared[run])
                    local[run][c] = local[run][c] - config.learning_rate * (grad + pull)
                    losses[run][c] = float(loss)
        for run in live:
            config = variants[run]
            if config.noise_multiplier > 0:
                local[run] = {c: _protect(w, shared[run], n_of[c], config, rng[run]) for c, w in local[run].items()}
            shared[run] = sum(local[run][c] * (n_of[c] / total) for c in clients)
        scored = run_scores(val, {run: shared[run] for run in live})
        f1s = _macro_f1(scored, ["run", "client"])
        for run in live:
            config, f1 = variants[run], {c: f1s[run, c] for c in clients}
            metric = float(np.mean([f1[c] for c in clients]))
            history[run] += [
                {"run": run, "round": number, "client": c, "train_loss": losses[run][c], "macro_f1": f1[c]} for c in clients
            ]
            if metric > best_metric[run] + config.min_delta:
                best[run], best_metric[run], stale[run] = shared[run], metric, 0
            else:
                stale[run] += 1
                if stale[run] >= config.patience:
                    ended.add(run)
    return {run: (best[run], history[run]) for run in variants}


def _protect(w: np.ndarray, shared: np.ndarray, n: int, config: AveragingConfig, rng) -> np.ndarray:
    delta = w - shared
    scale = min(1.0, config.clip / max(float(np.linalg.norm(delta)), 1e-12))
    sigma = config.noise_multiplier * config.clip / max(math.sqrt(n), 1.0)
    return shared + delta * scale + rng.normal(0.0, sigma, size=w.shape)


def _macro_f1(scored: DataFrame, by: list[str]) -> dict[tuple, float]:
    predictions = scored.select(*by, F.col("label").cast("int").alias("y_true"), "score")
    table = fold_bins(bin_sums(predictions, by), by).select(*by, rates()["macro_f1"].alias("f"))
    return {tuple(r)[:-1]: float(r["f"]) for r in table.collect()}


def client_macro_f1(scored: DataFrame) -> dict[str, float]:
    return {c: f for (c,), f in _macro_f1(scored, ["client"]).items()}


def variant_grid(train: DataFrame, val: DataFrame, variants: dict[str, AveragingConfig]) -> tuple[dict, DataFrame]:
    """Fit every named variant; the histories come back as one table."""
    fitted = fit_runs(train, val, variants)
    weights = {name: w for name, (w, _) in fitted.items()}
    rows = [r for _, history in fitted.values() for r in history]
    schema = "run string, round int, client string, train_loss double, macro_f1 double"
    return weights, train.sparkSession.createDataFrame(rows, schema)
