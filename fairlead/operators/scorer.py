"""A feed-forward classifier applied to feature tables: probabilities of the zones, in Arrow batches.

The network's arrays are broadcast once; a task turns each batch of rows into one matrix and takes it through
standardisation, the normalised input, the residual blocks and the head. Rows don't meet, so nothing is shuffled.
"""

from __future__ import annotations

import io
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fairlead.functions.zones import CLASSES
from fairlead.operators import knn, stats

EPSILON = 1e-5
PROBABILITIES = tuple(f"p_{c.lower()}" for c in CLASSES)


@dataclass
class Norm:
    """Scale and shift by running averages."""

    scale: object
    shift: object
    mean: object
    variance: object

    def __call__(self, x):
        import numpy as np

        return (x - self.mean) / np.sqrt(self.variance + EPSILON) * self.scale + self.shift


@dataclass
class Block:
    """``gelu(norm(x w + b)) + (x p + q)``; without ``p`` the input itself is added."""

    w: object
    b: object
    norm: Norm
    p: object = None
    q: object = None


@dataclass
class Network:
    """Arrays of a trained network; matrices have a row for each input."""

    mean: object
    deviation: object
    w: object
    b: object
    norm: Norm | None = None
    blocks: list[Block] = field(default_factory=list)

    def probabilities(self, x):
        """A row of class probabilities for each row of features."""
        import numpy as np

        h = (x - self.mean) / self.deviation
        if self.norm is not None:
            h = self.norm(h)
        for k in self.blocks:
            h = gelu(k.norm(h @ k.w + k.b)) + (h if k.p is None else h @ k.p + k.q)
        z = h @ self.w + self.b
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def arrays(self) -> dict:
        out = {"mean": self.mean, "deviation": self.deviation, "w": self.w, "b": self.b}
        named = [("norm", self.norm)] + [(f"blocks.{i}.norm", k.norm) for i, k in enumerate(self.blocks)]
        out |= {f"{n}.{f}": getattr(v, f) for n, v in named if v is not None for f in ("scale", "shift", "mean", "variance")}
        return out | {f"blocks.{i}.{f}": getattr(k, f) for i, k in enumerate(self.blocks) for f in "wbpq" if getattr(k, f) is not None}

    @classmethod
    def of(cls, arrays: dict) -> Network:
        norm = lambda n: Norm(*[arrays[f"{n}.{f}"] for f in ("scale", "shift", "mean", "variance")])
        n = len({k.split(".")[1] for k in arrays if k.startswith("blocks.")})
        blocks = [Block(arrays[f"blocks.{i}.w"], arrays[f"blocks.{i}.b"], norm(f"blocks.{i}.norm"), arrays.get(f"blocks.{i}.p"), arrays.get(f"blocks.{i}.q")) for i in range(n)]
        return cls(arrays["mean"], arrays["deviation"], arrays["w"], arrays["b"], norm("norm") if "norm.scale" in arrays else None, blocks)


def gelu(x):
    """``x`` times the normal distribution function."""
    import math

    import numpy as np

    normal = np.fromiter((math.erf(v) for v in (x / math.sqrt(2)).reshape(-1).tolist()), float, x.size).reshape(x.shape)
    return 0.5 * x * (1 + normal)


def load(spark: SparkSession, path: str) -> Network:
    """From one ``.npz`` file (see :meth:`Network.arrays`) in any store that Spark reads."""
    import numpy as np

    content = spark.read.format("binaryFile").load(path).select("content").first()[0]
    with np.load(io.BytesIO(bytes(content))) as found:
        return Network.of({k: found[k].astype(float) for k in found.files})


def save(network: Network, path: str) -> None:
    import numpy as np

    np.savez_compressed(path, **network.arrays())


def score(table: DataFrame, network: Network, features: Sequence[str] = knn.FEATURES, keep: Sequence[str] = ("id",), code: str = "class_code") -> DataFrame:
    """The columns ``keep``, ``class_index`` (of equal ones the first), its name as ``code``, ``confidence`` and a ``p_``
    column for each class. A feature that is null, NaN or infinite counts as 0."""
    sent = table.sparkSession.sparkContext.broadcast(network)
    features, keep = list(features), list(keep)
    picked = table.select(*keep, *[F.col(c).cast("double").alias(f"__{i}") for i, c in enumerate(features)])
    own = [picked.schema[c] for c in keep]
    schema = T.StructType([*own, T.StructField("class_index", T.IntegerType()), T.StructField("confidence", T.DoubleType()), *[T.StructField(p, T.DoubleType()) for p in PROBABILITIES]])

    def run(frames: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for b in frames:
            x = np.stack([b[f"__{i}"].to_numpy(zero_copy_only=False).astype(float) for i in range(len(features))], axis=1)
            p = sent.value.probabilities(np.where(np.isfinite(x), x, 0.0))
            best = p.argmax(axis=1) if len(p) else np.zeros(0, np.int64)
            made = [pa.array(best.astype(np.int32)), pa.array(p[np.arange(len(p)), best]), *[pa.array(p[:, c]) for c in range(p.shape[1])]]
            yield pa.RecordBatch.from_arrays([*[b[c] for c in keep], *made], [*keep, "class_index", "confidence", *PROBABILITIES])

    found = picked.mapInArrow(run, schema)
    return found.withColumn(code, F.get(F.array(*map(F.lit, CLASSES)), "class_index"))


def score_points(points: DataFrame, index: DataFrame, network: Network) -> DataFrame:
    """Probabilities of points with measures; the depth that is shown is the measured one."""
    scored = score(knn.features(points, index), network)
    return scored.join(points.select("id", "latitude", "longitude", F.col("noaa_depth").alias("depth")), "id")


def score_cells(cells: DataFrame, index: DataFrame, network: Network) -> DataFrame:
    """Lattice cells (``lattice_id, row, col, lat, lon``) with ``class_index, confidence`` from bare coordinates: what a
    cost map is built from."""
    name = F.concat_ws("|", "lattice_id", "row", "col")
    asked = cells.select(name.alias("id"), F.col("lat").alias("latitude"), F.col("lon").alias("longitude"))
    scored = score(knn.coordinate_features(asked, index), network).select("id", "class_index", "confidence")
    return cells.withColumn("id", name).join(scored, "id").drop("id")


def centroid_network(table: DataFrame, label: str, features: Sequence[str]) -> Network:
    """A network without blocks whose logits are those of the nearest class mean among standardised features: a closed
    form of two aggregates, for use where no trained weights are at hand. A feature that doesn't vary has deviation 1."""
    import numpy as np

    spread = table.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(features) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    mean = np.array([spread[f"m{i}"] or 0.0 for i in range(len(features))])
    deviation = np.array([spread[f"s{i}"] or 1.0 for i in range(len(features))])
    rows = table.groupBy(label).agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(features)]).where(F.col(label).isin(*CLASSES)).collect()  # a row a class
    center = {r[label]: (np.array([r[f"m{i}"] for i in range(len(features))]) - mean) / deviation for r in rows}
    w = np.stack([center.get(c, np.zeros(len(features))) for c in CLASSES], axis=1)
    return Network(mean, deviation, w, np.array([-(w[:, i] ** 2).sum() / 2 if c in center else -1e9 for i, c in enumerate(CLASSES)]))


def macro_auc(scored: DataFrame, label: str) -> DataFrame:
    """``class_code, auc`` of each class against the rest, by its probability; the macro average is their mean."""
    out = None
    for c, p in zip(CLASSES, PROBABILITIES, strict=True):
        one = stats.roc_auc(scored.where(F.col(label).isNotNull()), F.col(label) == c, p).select(F.lit(c).alias("class_code"), "auc")
        out = one if out is None else out.unionByName(one)
    return out
