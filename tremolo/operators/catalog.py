"""Registry of attacks and models, with typed parameters of their own."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Clip:
    """What an attack can use: columns of one clip, and the seed of its draws."""

    id: Column
    audio: Column
    rate: Column
    original: Column | None = None
    seed: str = "0"
    model: object | None = None


@dataclass(frozen=True)
class Attack:
    name: str
    kind: str
    run: Callable[..., Column]
    defaults: dict = field(default_factory=dict)
    needs: tuple[str, ...] = ()

    def params(self, given: dict | None = None) -> dict:
        """Defaults with what is given over them; None counts as not given."""
        given = {k: v for k, v in (given or {}).items() if v is not None}
        if unknown := set(given) - set(self.defaults):
            raise ValueError(f"{self.name} has no parameter {', '.join(sorted(unknown))}")
        return self.defaults | given


ATTACKS: dict[str, Attack] = {}
MODELS: dict[str, object] = {}


def register_attack(name: str, kind: str = "expression", needs: tuple[str, ...] = (), **defaults):
    """Decorator: fn(clip, **params) -> Column of the attacked audio, under a name."""

    def add(fn):
        ATTACKS[name] = Attack(name, kind, fn, defaults, needs)
        return fn

    return add


def register_model(model):
    MODELS[model.name] = model
    return model


def attack(name: str) -> Attack:
    if name not in ATTACKS:
        raise ValueError(f"unknown attack: {name}")
    return ATTACKS[name]


def model(name: str):
    if name not in MODELS:
        raise ValueError(f"unknown model: {name}; there are {', '.join(sorted(MODELS))}")
    return MODELS[name]


def attacked(name: str, clip: Clip, **given) -> Column:
    a = attack(name)
    for what in a.needs:
        if getattr(clip, what) is None:
            raise ValueError(f"{name} needs {what}")
    return a.run(clip, **a.params(given))


def apply(clips: DataFrame, name: str, seed: str = "0", model=None, original: str | None = None, **given) -> DataFrame:
    """Clips with the attacked audio in place of the audio."""
    other = F.col(original) if original else None
    got = attacked(name, Clip(F.col("clip_id"), F.col("audio"), F.col("sampling_rate"), other, seed, model), **given)
    return bind(clips, "audio", got) if attack(name).kind == "expression" else clips.withColumn("audio", got)


def bind(df: DataFrame, name: str, value: Column) -> DataFrame:
    """withColumn whose value is computed once for each row, whatever uses it later.

    Projections are merged, so a long expression that later lambdas use would be computed
    again for every sample; a generator of one row is a boundary without a shuffle.
    """
    one = F.explode(F.array(value)).alias(name)
    rest = [one if c == name else F.col(f"`{c}`") for c in df.columns]
    return df.select(*rest, *([] if name in df.columns else [one]))


def choose(names: list[str] | None) -> tuple[list[str], list[str]]:
    """Known names among those asked for (all, if none are), and the unknown ones."""
    if not names:
        return sorted(n for n, a in ATTACKS.items() if a.kind != "remote"), []
    return [n for n in names if n in ATTACKS], [n for n in names if n not in ATTACKS]


def attack_table(spark: SparkSession) -> DataFrame:
    """attack, kind and defaults as text by parameter."""
    rows = [(a.name, a.kind, {k: str(v) for k, v in a.defaults.items()}) for a in sorted(ATTACKS.values(), key=lambda a: a.name)]
    return spark.createDataFrame(rows, "attack string, kind string, params map<string,string>")


def model_table(spark: SparkSession) -> DataFrame:
    rows = [(m.name, m.rate, m.bits) for m in sorted(MODELS.values(), key=lambda m: m.name)]
    return spark.createDataFrame(rows, "model string, sampling_rate int, watermark_size int")


def merged_params(attacks: DataFrame, overrides: DataFrame) -> DataFrame:
    """Parameters of each attack: its defaults with overrides(attack, params) over them."""
    o = overrides.withColumnRenamed("params", "given")
    keep = F.map_filter(F.coalesce("given", F.create_map().cast("map<string,string>")), lambda k, v: v.isNotNull())
    rest = F.map_filter("params", lambda k, v: ~F.coalesce(F.map_contains_key(keep, k), F.lit(False)))
    return attacks.join(o, "attack", "left").select("attack", F.map_concat(rest, keep).alias("params"))
