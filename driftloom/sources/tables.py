"""Readers and writers: Parquet, JSON lines, CSV and NumPy archives; registry; model store."""

from __future__ import annotations

import hashlib
import io
import pickle
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Environments by name: channels that an observer sees, and control rate in Hz.
ENVIRONMENTS = {"events": {"channels": ["value"], "hz": 1.0}, "lineitem": {"channels": ["quantity", "price", "discount", "tax"], "hz": 1.0}}


def dataset_path(root: str, env: str, name: str) -> str:
    return f"{root.rstrip('/')}/{env}/{name}"


def load(spark: SparkSession, root: str, env: str, name: str, channels: Sequence[str] | None = None) -> DataFrame:
    """A dataset; only the wanted channels are read from the files."""
    df = spark.read.parquet(dataset_path(root, env, name))
    return df if channels is None else df.select("ep", "t", *channels)


def split_and_normalize(states: DataFrame, episodes: DataFrame, channels: Sequence[str], sizes: dict[str, float], no_fail: Sequence[str] = (), *, seed: int = 0, normalize: bool = True) -> tuple[DataFrame, DataFrame]:
    """(states, episodes) with ``split``: stratified parts, channels as z-scores by the moments of ``train``; other rows are left out."""
    from ..operators.episodes import normalize_channels, stratified_split

    if normalize and "train" not in sizes:
        raise ValueError("normalizing needs a part named train")
    parts = stratified_split(episodes, sizes, no_fail, seed)
    marked = states.join(parts.select("ep", "split"), "ep")
    return (normalize_channels(marked, channels, F.col("split") == "train") if normalize else marked), parts


def load_splits(spark: SparkSession, root: str, key: str, sizes: dict[str, float], no_fail: Sequence[str] = (), *, channels: Sequence[str], seed: int = 0, normalize: bool = True) -> dict[str, tuple[DataFrame, DataFrame]]:
    """(states, episodes) of each part of the dataset ``env/name``, whose episodes lie beside it as ``name_episodes``."""
    env, name = key.split("/")
    states, parts = split_and_normalize(load(spark, root, env, name, channels), load(spark, root, env, f"{name}_episodes"), channels, sizes, no_fail, seed=seed, normalize=normalize)
    of = lambda df, part: df.filter(F.col("split") == part).drop("split")
    return {part: (of(states, part), of(parts, part)) for part in sizes}


def save(df: DataFrame, root: str, env: str, name: str, overwrite: bool = False) -> str:
    path = dataset_path(root, env, name)
    df.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)
    return path


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def get_or_build(spark: SparkSession, root: str, env: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    path = dataset_path(root, env, name)
    if not exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def output_dir(root: str, script: str, *parts: str) -> str:
    """The folder of a script's results below ``root``, named after the script."""
    return "/".join([root.rstrip("/"), script.rsplit("/", 1)[-1].removesuffix(".py"), *parts])


def rebuild_all(spark: SparkSession, root: str, builders: dict[str, Callable[[], DataFrame]]) -> dict[str, str | None]:
    """Rebuilds datasets ``env/name``, each by itself: a failure is noted as its message and the others go on."""
    done: dict[str, str | None] = {}
    for key, build in builders.items():
        try:
            build().write.mode("overwrite").parquet(f"{root.rstrip('/')}/{key}")
            done[key] = None
        except Exception as e:  # noqa: BLE001  the report holds it
            done[key] = f"{type(e).__name__}: {e}"
    return done


def time_call(fn: Callable[[], object], warm: int = 2, repeats: int = 5) -> float:
    """Mean seconds of a call after warm-up; a DataFrame is run in full."""
    import time

    def once() -> None:
        out = fn()
        if isinstance(out, DataFrame):
            out.write.format("noop").mode("overwrite").save()

    for _ in range(warm):
        once()
    start = time.perf_counter()
    for _ in range(repeats):
        once()
    return (time.perf_counter() - start) / repeats


def make_points(spark: SparkSession, kind: str, n: int, noise: float = 0.1, seed: int = 0) -> DataFrame:
    """(id, x, y) of two blobs, two moons, a spiral or a disc: uniform and normal draws by hash of the row."""
    u = lambda k: (F.shiftrightunsigned(F.xxhash64("id", F.lit(seed), F.lit(k)), 11) + 1) / F.lit(float((1 << 53) + 1))
    tau = 2 * np.pi
    radius, turn = F.sqrt(-2 * F.log(u(0))) * noise, tau * u(1)
    side, along = F.col("id") % 2, u(2)
    angle = np.pi * along
    centre = {
        "blobs": (2.0 * side - 1, F.lit(0.0)),
        "moons": (F.when(side == 0, F.cos(angle)).otherwise(1 - F.cos(angle)), F.when(side == 0, F.sin(angle)).otherwise(0.5 - F.sin(angle))),
        "spiral": (along * F.cos(2 * tau * along), along * F.sin(2 * tau * along)),
        "disc": (F.sqrt(along) * F.cos(tau * u(3)), F.sqrt(along) * F.sin(tau * u(3))),
    }[kind]
    spread = 0 if kind == "disc" else 1
    return spark.range(n).select("id", (centre[0] + spread * radius * F.cos(turn)).alias("x"), (centre[1] + spread * radius * F.sin(turn)).alias("y"))


def list_datasets(registry: dict[str, dict], env: str) -> list[str]:
    return sorted(k for k in registry if k.startswith(f"{env}/"))


def get_config(registry: dict[str, dict], key: str) -> dict:
    if key not in registry:
        raise KeyError(f"unknown dataset {key}; known: {', '.join(sorted(registry))}")
    return registry[key]


def read_npz(spark: SparkSession, path: str, array: str = "X") -> DataFrame:
    """States (ep, t, x) from NumPy archives with a (N, T, D) tensor; steps of NaN are left out.

    Episodes of several archives are numbered apart by the archive's path hash.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for where, content in zip(pdf["path"], pdf["content"], strict=True):
                with np.load(io.BytesIO(content), allow_pickle=False) as z:
                    x = z[array].astype(float)
                base = int(hashlib.sha1(where.encode()).hexdigest()[:8], 16) << 24
                for i, ep in enumerate(x):
                    ok = ~np.isnan(ep).any(1)
                    yield pd.DataFrame({"file": where, "ep": base + i, "t": np.flatnonzero(ok), "x": list(ep[ok])})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(work, "file string, ep long, t long, x array<double>")


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True)


def read_many(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Union of datasets by column name, with the file of each row; empty paths are skipped."""
    found = [p for p in paths if exists(spark, p)]
    return spark.read.option("mergeSchema", "true").parquet(*found).withColumn("file", F.input_file_name())


def save_run(config: dict, metrics: DataFrame, scores: DataFrame, path: str, run: str) -> None:
    """A run as two tables: one row of configuration and metrics, and its scores."""
    spark = metrics.sparkSession
    conf = spark.createDataFrame([(run, {str(k): str(v) for k, v in config.items()})], "run string, config map<string,string>")
    conf.crossJoin(F.broadcast(metrics)).write.mode("append").parquet(f"{path}/runs")
    scores.withColumn("run", F.lit(run)).write.mode("append").partitionBy("run").parquet(f"{path}/scores")


def model_key(params: dict, data: DataFrame) -> str:
    """Key of a fit: a hash of its parameters and of an order-free fingerprint of its rows."""
    row = data.agg(F.count("*"), F.sum(F.xxhash64(*data.columns).cast("decimal(38,0)"))).first()
    return hashlib.sha1(repr((sorted(params.items()), tuple(map(str, row)))).encode()).hexdigest()


def cached_fit(params: dict, data: DataFrame, folder: str, fit: Callable[[], object]) -> object:
    """A fitted model from the store, or fitted and stored; a model is small by construction."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
    store.create_dir(root, recursive=True)
    path = f"{root}/{model_key(params, data)}.pkl"
    if store.get_file_info(path).type == fs.FileType.File:
        with store.open_input_stream(path, compression=None) as f:
            return pickle.loads(f.read())
    model = fit()
    with store.open_output_stream(path, compression=None) as f:
        f.write(pickle.dumps(model))
    return model


def episode_lengths(flags: DataFrame) -> DataFrame:
    """(pos, length) of each terminal flag: steps since the one before."""
    from pyspark.sql import Window

    w = Window.partitionBy("run").orderBy("pos")
    ends = flags.filter("terminal = 1")
    return ends.withColumn("length", F.col("pos") - F.coalesce(F.lag("pos").over(w), F.lit(-1)))


def simulate_ou(spark: SparkSession, n: int, steps: int, theta: float = 1.0, sigma: float = 0.5, dt: float = 0.01, seed: int = 0) -> DataFrame:
    """States of Ornstein-Uhlenbeck paths; each path has its own seed, so any task can make it."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for ep in pdf["id"]:
                noise = np.random.default_rng([seed, int(ep)]).normal(size=steps - 1) * sigma * np.sqrt(dt)
                x = np.zeros(steps)
                for i in range(1, steps):
                    x[i] = x[i - 1] * (1 - theta * dt) + noise[i - 1]
                yield pd.DataFrame({"ep": ep, "t": np.arange(steps), "x": x})

    return spark.range(n).mapInPandas(work, "ep long, t long, x double")


def simulate_van_der_pol(spark: SparkSession, n: int, steps: int, mu: float = 1.0, sigma: float = 0.1, dt: float = 0.01, seed: int = 0) -> DataFrame:
    """States of noisy Van der Pol oscillators from random starts."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for ep in pdf["id"]:
                rng = np.random.default_rng([seed, int(ep)])
                path = np.zeros((steps, 2))
                path[0] = rng.uniform(-2, 2, 2)
                for i in range(1, steps):
                    x, v = path[i - 1]
                    path[i] = x + v * dt, v + (mu * (1 - x * x) * v - x) * dt + sigma * np.sqrt(dt) * rng.normal()
                yield pd.DataFrame({"ep": ep, "t": np.arange(steps), "x": path[:, 0], "v": path[:, 1]})

    return spark.range(n).mapInPandas(work, "ep long, t long, x double, v double")
