"""Watermark models: a local spread-spectrum model, and the interface that remote ones share.

The local model adds pseudo-random chips and cancels the host's own correlation with them
(Cox et al. 1997; Malvar and Florencio 2003), so it is detected blindly by the sign of a
correlation. It stands in for models that run as services; its scores say nothing of theirs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tremolo.functions.arrays import let, lets
from tremolo.operators.catalog import register_model


@dataclass(frozen=True)
class SpreadModel:
    name: str
    seed: int = 1
    bits: int = 16
    rate: int = 16000
    alpha: float = 0.05
    #: Whether detection gives one score in place of a message.
    scores: bool = False

    def at(self, rate: int) -> SpreadModel:
        """The model for clips of a rate; this one works alike at all."""
        return self

    def chip(self, i: Column) -> Column:
        """+1 or -1 for a position, by integer arithmetic alone."""
        j = (i % 65536).cast("long")
        h = (j + 1) * (j + 3) * 48271 + (i.cast("long") + 7) * (69621 * (self.seed + 1))
        return F.when((h % 2147483647).bitwiseAND(F.lit(1024)) == 0, F.lit(-1.0)).otherwise(F.lit(1.0))

    def _sums(self, audio: Column) -> Column:
        """Correlation of each bit's samples with their chips; null for a bit without samples."""
        n = F.size(audio)
        own = lambda b: F.aggregate(F.sequence(b, n - 1, F.lit(self.bits)), F.lit(0.0), lambda s, i: s + F.get(audio, i) * self.chip(i))
        return F.transform(F.sequence(F.lit(0), F.lit(self.bits - 1)), lambda b: F.when(b < n, own(b)))

    def embed(self, audio: Column, bits: Column) -> Column:
        def marked(a: Column, w: Column) -> Column:
            count = lambda b: F.floor((F.size(a) - 1 - b) / self.bits) + 1
            push = F.transform(self._sums(a), lambda s, b: self.alpha * (2 * F.get(w, b) - 1) - s / count(b))
            return let(push, lambda p: F.transform(a, lambda x, i: x + self.chip(i) * F.get(p, (i % self.bits).cast("int"))))

        return lets([audio, bits], marked)

    def detect(self, audio: Column) -> Column:
        return let(audio, lambda a: F.transform(self._sums(a), lambda s: (s >= 0).cast("double")))


SPREAD_A = register_model(SpreadModel("SpreadA", 1))
SPREAD_B = register_model(SpreadModel("SpreadB", 2))

#: Rates and message lengths of services that sources.remote.register_services makes known.
SERVICES = {"AudioSealModel": (16000, 16), "WavMarkModel": (16000, 16), "SilentCipherModel": (16000, 40), "TimbreWMModel": (22050, 10), "PerthModel": (16000, 10)}
