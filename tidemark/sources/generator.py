"""Synthetic runs: a byte-exact sequential generator, and one that scales.

The exact one draws from the published PCG XSL-RR 128/64 generator, so that streams can be pinned by their hash. It is
sequential by nature and meant for fixtures. ``scaled_run`` makes streams of the same shape with any number of rows as a
Spark job, with other numbers.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class GenConfig:
    """A run: every agent moves at each tick and emits at its rates, in ticks."""

    seed: int = 42
    agents: int = 8
    ticks: int = 1000
    tick_ns: int = 5_000_000
    pose_every: int = 1
    scalar_every: int = 5
    image_every: int = 100
    sigma: float = 0.05


# The generator's multipliers, increments and widths as published.
MULTIPLIER = 0x2360ED051FC65DA44385DF649FCCF645
SEED_MULTIPLIER, SEED_INCREMENT = 6364136223846793005, 11634580027462260723
M64, M128 = 2**64 - 1, 2**128 - 1


class Pcg64:
    def __init__(self, seed: int):
        state, words = seed, []
        for _ in range(8):
            state = (state * SEED_MULTIPLIER + SEED_INCREMENT) & M64
            words.append(self._rotate((((state >> 18) ^ state) >> 27) & 0xFFFFFFFF, state >> 59, 32))
        key = sum(w << 32 * i for i, w in enumerate(words))
        self.increment = (key >> 128) | 1
        self.state = ((key & M128) + self.increment) & M128
        self._step()

    @staticmethod
    def _rotate(x: int, by: int, bits: int) -> int:
        return (x >> by | x << (bits - by)) & (1 << bits) - 1

    def _step(self) -> None:
        self.state = (self.state * MULTIPLIER + self.increment) & M128

    def next_u64(self) -> int:
        self._step()
        return self._rotate((self.state >> 64 ^ self.state) & M64, self.state >> 122, 64)

    def uniform(self, low: float, high: float) -> float:
        while True:
            unit = (self.next_u64() >> 12) * 2.0**-52
            x = unit * (high - low) + low
            if x < high:
                return x

    def gaussian(self, sigma: float) -> float:
        """Box-Muller, the cosine branch only."""
        a, b = self.uniform(2.0**-52, 1.0), self.uniform(0.0, 1.0)
        return math.sqrt(-2.0 * math.log(a)) * math.cos(2.0 * math.pi * b) * sigma


def run_events(config: GenConfig = GenConfig()) -> Iterator[dict]:
    """Events of a run by tick, then agent in numeric order, then pose, scalar, image."""
    rng = Pcg64(config.seed)
    at = [[float(i), 0.0] for i in range(config.agents)]
    for tick in range(config.ticks):
        for i, xy in enumerate(at):
            xy[0] += rng.gaussian(config.sigma)
            xy[1] += rng.gaussian(config.sigma)
            base = {"entity_path": f"/agent/{i}", "timeline": "sim_time", "t_ns": tick * config.tick_ns}
            if tick % config.pose_every == 0:
                pose = {"kind": "Transform3D", "tx": xy[0], "ty": xy[1], "tz": 0.0, "qx": 0.0, "qy": 0.0, "qz": 0.0, "qw": 1.0}
                yield base | {"component": "pose", "payload": pose}
            if tick % config.scalar_every == 0:
                charge = 1.0 - tick / config.ticks
                yield base | {"component": "battery", "payload": {"kind": "Scalar", "value": charge, "unit": "ratio"}}
            if tick % config.image_every == 0:
                # What an image event of a run says.
                uri = f"synthetic://agent/{i}/tick/{tick}"
                image = {"kind": "ImageRef", "uri": uri, "width": 640, "height": 480, "format": "JPEG"}
                yield base | {"component": "camera", "payload": image}


def number(x: float) -> str:
    """A double in the shortest digits that read back, plain from 1e-5 up to 1e16, else with a bare exponent."""
    text = repr(x)
    if "e" not in text:
        return text
    digits, _, power = text.partition("e")
    p = int(power)
    if p == -5:
        sign, digits = ("-", digits[1:]) if digits[0] == "-" else ("", digits)
        return f"{sign}0.0000{digits.replace('.', '')}"
    return f"{digits}e{p}"


def _json(x) -> str:
    import json

    if isinstance(x, dict):
        return "{" + ",".join(f"{json.dumps(k)}:{_json(v)}" for k, v in x.items()) + "}"
    if isinstance(x, list):
        return "[" + ",".join(map(_json, x)) + "]"
    return number(x) if isinstance(x, float) else json.dumps(x, ensure_ascii=False)


def line(event: dict) -> str:
    return _json(event) + "\n"


def write_jsonl(events, path: str) -> int:
    """Write events in order, one line each, to a local file; its folders are made. Returns the count."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    n = 0
    with target.open("w", encoding="utf-8", newline="") as f:
        for n, e in enumerate(events, 1):
            f.write(line(e))
    return n


def count_by_kind(events) -> dict[str, int]:
    return dict(Counter(e["payload"]["kind"] for e in events))


def scaled_tables(spark: SparkSession, config: GenConfig = GenConfig()) -> dict[str, DataFrame]:
    """The tables of a run of any size by kind, as jobs: poses, scalars and images at their rates."""
    poses = scaled_run(spark, config).where(F.col("t_ns") % (config.tick_ns * config.pose_every) == 0)

    def every(ticks: int, *columns) -> DataFrame:
        number = F.floor(F.col("id") / config.agents)
        rows = spark.range(config.agents * -(-config.ticks // ticks)).select(
            "id", (number * ticks).cast("long").alias("tick"), F.concat(F.lit("/agent/"), F.col("id") % config.agents).alias("entity_path")
        )
        return rows.select((F.col("tick") * config.tick_ns).alias("t_ns"), "entity_path", *columns, F.col("id").alias("ingest_seq"))

    charge = F.lit(1.0) - F.col("tick") / F.lit(float(config.ticks))
    uri = F.concat(F.lit("synthetic:/"), "entity_path", F.lit("/tick/"), F.col("tick"))
    return {
        "Transform3D": poses,
        "Scalar": every(config.scalar_every, charge.alias("value"), F.lit("ratio").alias("unit")),
        "ImageRef": every(
            config.image_every, uri.alias("uri"), F.lit(640).alias("width"), F.lit(480).alias("height"), F.lit("JPEG").alias("format")
        ),
    }


def scaled_run(spark: SparkSession, config: GenConfig = GenConfig()) -> DataFrame:
    """Poses (t_ns, entity_path, ingest_seq, tx ... qw) of a run of any size, as a job.

    Each agent's steps are normal; its path is their running sum, a window over the agent.
    """
    steps = spark.range(config.agents * config.ticks).select(
        F.col("id").alias("ingest_seq"),
        (F.col("id") % config.agents).alias("agent"),
        (F.floor(F.col("id") / config.agents) * config.tick_ns).cast("long").alias("t_ns"),
        (F.randn(config.seed) * config.sigma).alias("dx"),
        (F.randn(config.seed + 1) * config.sigma).alias("dy"),
    )
    w = Window.partitionBy("agent").orderBy("t_ns")
    zero = F.lit(0.0)
    return steps.select(
        "t_ns",
        F.concat(F.lit("/agent/"), F.col("agent")).alias("entity_path"),
        "ingest_seq",
        (F.col("agent") + F.sum("dx").over(w)).alias("tx"),
        F.sum("dy").over(w).alias("ty"),
        *(zero.alias(c) for c in ("tz", "qx", "qy", "qz")),
        F.lit(1.0).alias("qw"),
    )
