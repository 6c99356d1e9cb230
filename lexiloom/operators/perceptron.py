"""The averaged perceptron: features, scoring, online training and averaging.

A model's weights are rows ``(feature, class, weight)``. Scoring is a join and
an aggregate; of equal scores the smallest class wins. Training is an
order-dependent fold, so it runs in one task; averaging is a projection.
"""

import random
from collections import defaultdict
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .sizes import sized

WEIGHTS = "feature string, class string, weight double"
STATE = "feature string, class string, weight double, total double, tstamp long"
#: The most weights of a model that is held in memory, for training and decoding in sequence.
HELD = 20_000_000


def round_half_even(x: Column, digits: int) -> Column:
    return F.rint(x * 10.0**digits) / 10.0**digits


def averaged(state: DataFrame, instances: int) -> DataFrame:
    """Averaged weights: ``(total + (instances - tstamp) * weight) / instances`` to three digits, zeros dropped."""
    if instances == 0:
        return state.select("feature", "class", "weight")
    mean = (F.col("total") + (F.lit(instances) - F.col("tstamp")) * F.col("weight")) / F.lit(float(instances))
    return state.select("feature", "class", round_half_even(mean, 3).alias("weight")).filter("weight <> 0")


def scores(features: DataFrame, weights: DataFrame, *keys: str, how: str = "inner") -> DataFrame:
    """``(keys, class, score)`` of items given as rows ``(keys, feature, value)``; only values above 0 count.

    With ``how="left"`` an item has a row of no class for its unknown features.
    """
    rows = features.filter("value > 0").join(sized(weights.select("feature", "class", "weight")), "feature", how)
    return rows.groupBy(*keys, "class").agg(F.sum(F.col("value") * F.col("weight")).alias("score"))


def predict(features: DataFrame, weights: DataFrame, *keys: str, how: str = "inner") -> DataFrame:
    """``(keys, class)`` of the best class; items without any known feature have no row, or with ``how="left"`` no class.

    Scores are rounded to six digits, beyond which weights of three digits carry
    nothing. Rows that lie together by some of the keys are not exchanged.
    """
    best = F.when(F.col("class").isNotNull(), F.struct((-F.round("score", 6)).alias("s"), F.col("class")))
    return scores(features, weights, *keys, how=how).groupBy(*keys).agg(F.min(best)["class"].alias("class"))


class Perceptron:
    """The model in memory, for training and for decoding in sequence."""

    def __init__(self, weights: dict[str, dict[str, float]] | None = None, instances: int = 0):
        self.weights: dict[str, dict[str, float]] = weights or {}
        self.totals: dict[tuple[str, str], float] = {}
        self.tstamps: dict[tuple[str, str], int] = {}
        self.instances = instances

    def predict(self, features: Iterable[str]) -> str | None:
        score: dict[str, float] = defaultdict(float)
        for f in features:
            for c, w in self.weights.get(f, {}).items():
                score[c] += w
        return min(score, key=lambda c: (-round(score[c], 6), c)) if score else None

    def update(self, truth: str, guess: str, features: Iterable[str]) -> None:
        """One step. Only a right guess counts as an instance; a wrong one takes the next number as its time."""
        if truth == guess:
            self.instances += 1
            return
        now = self.instances + 1
        for f in features:
            own = self.weights.setdefault(f, {})
            for c, v in ((truth, 1.0), (guess, -1.0)):
                w = own.get(c, 0.0)
                self.totals[f, c] = self.totals.get((f, c), 0.0) + (now - self.tstamps.get((f, c), 0)) * w
                self.tstamps[f, c] = now
                own[c] = w + v

    def average(self) -> "Perceptron":
        """Averages in place; the totals stay, so that further training goes on from them."""
        n = self.instances
        if n:
            for f, own in self.weights.items():
                mean = {c: round((self.totals.get((f, c), 0.0) + (n - self.tstamps.get((f, c), 0)) * w) / n * 1000) / 1000 for c, w in own.items()}
                self.weights[f] = {c: w for c, w in mean.items() if w}
            self.tstamps = dict.fromkeys(self.tstamps, 0)
            self.instances = 0
        return self

    def rows(self) -> list[tuple[str, str, float]]:
        return [(f, c, w) for f, own in sorted(self.weights.items()) for c, w in sorted(own.items())]

    def state(self) -> list[tuple[str, str, float | None, float | None, int | None]]:
        """Rows of STATE; a weight that averaging dropped is null, but its total stays."""
        known = {(f, c) for f, own in self.weights.items() for c in own} | set(self.totals)
        return [(f, c, self.weights.get(f, {}).get(c), self.totals.get((f, c)), self.tstamps.get((f, c))) for f, c in sorted(known)]

    @classmethod
    def of(cls, table: DataFrame) -> "Perceptron":
        """The model of rows of WEIGHTS or STATE, as it was between two trainings."""
        if table.limit(HELD + 1).count() > HELD:
            raise ValueError(f"a model of more than {HELD} weights is not held in memory")
        p = cls()
        full = "total" in table.columns
        for f, c, w, *rest in table.select("feature", "class", "weight", *(["total", "tstamp"] if full else [])).toLocalIterator():
            if w is not None:
                p.weights.setdefault(f, {})[c] = w
            if full and rest[0] is not None:
                p.totals[f, c] = rest[0]
            if full and rest[1] is not None:
                p.tstamps[f, c] = rest[1]
        return p

    def copy(self) -> "Perceptron":
        p = Perceptron({f: dict(own) for f, own in self.weights.items()}, self.instances)
        p.totals, p.tstamps = dict(self.totals), dict(self.tstamps)
        return p


def weights_only(table: DataFrame) -> DataFrame:
    """The rows of WEIGHTS in a table of WEIGHTS or STATE."""
    return table.filter("weight IS NOT NULL").select("feature", "class", "weight")


def shuffled(items: list, iterations: int, seed: int) -> list:
    """All items ``iterations`` times, in one random order."""
    many = [x for _ in range(iterations) for x in items]
    random.Random(seed).shuffle(many)
    return many


def train(examples: list[list[tuple[list[str], str]]], iterations: int, seed: int, fallback: str, start: Perceptron | None = None) -> Perceptron:
    """Trains on sequences of (features, class); ``fallback`` is the guess where no feature is known."""
    p = start or Perceptron()
    for sequence in shuffled(examples, iterations, seed):
        for features, truth in sequence:
            p.update(truth, p.predict(features) or fallback, features)
    return p.average()


def fit_in_one_task(sentences: DataFrame, fold, schema: str = WEIGHTS) -> DataFrame:
    """Runs ``fold(list of rows) -> rows`` over all sentences in one task.

    Rows are ``(order, tagged)``, sorted by ``order``, so that the result does not depend on the partitions.
    """

    def run(batches):
        import pyarrow as pa

        rows = [r for b in batches for r in b.to_pylist()]
        rows.sort(key=lambda r: repr(r["order"]))
        out = list(zip(*fold([r["tagged"] for r in rows])))
        if out:
            types = [pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
            names = ["feature", "class", "weight", "total", "tstamp"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names[: len(out)])

    return sentences.repartition(1).mapInArrow(run, schema)


def weights_of(spark: SparkSession, p: Perceptron) -> DataFrame:
    return spark.createDataFrame(p.rows(), WEIGHTS)
