"""Compresses vectors to codes: each part of a vector becomes the index of the nearest entry of the part's codebook.

Components are integers (``floor(SCALE * x)``), so distances, sums and means are exact and results don't depend on how
rows are dealt. Codebooks (entries x length of a part, for each part) are broadcast. A task goes through its vectors in
Arrow batches: all squared distances of a batch follow from the norms and one int64 matrix product, the first least one
wins. For a round it hands on a row of sums for each entry it used; those are merged by a grouped shuffle, and the new
codebooks, of bounded size, are made from the merged rows.

Edge cases: vectors that are null, empty or hold null or non-finite components are dropped, as are those of another
length than the vector of least id (a codebook has one length). A length that the parts don't divide is filled with
zeros, which change no distance. Components are cut to the bound at which every distance fits 64 bits (beyond 2**26
for vectors of up to 256 components). A null id is coded but gives no first entry; an id that repeats gives one, the
least of its vectors. Fewer than ``entries`` ids give smaller codebooks; without any, nothing can be coded and the
result is empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fairlead.llm.common import batches, materialize
from fairlead.operators.shared import look_up

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors whose distances to a codebook are held at once.
BLOCK = 4096


def component_bound(length: int) -> int:
    """Integers up to this have squared distances below 2**63 over vectors of that length."""
    return int((2**60 / max(length, 1)) ** 0.5)


def _integers(vectors, scale: int, length: int | None):
    """``kept, flat, starts, lengths`` of an Arrow list array: which rows are kept (mask), and the integer components
    of all rows one after another, those of row ``i`` from ``starts[i]`` on."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    vectors = vectors.cast(pa.large_list(pa.float64()))
    valid = ~np.asarray(pc.is_null(vectors))
    sizes = np.asarray(pc.fill_null(pc.list_value_length(vectors), 0), np.int64)
    flat = np.asarray(vectors.flatten().fill_null(float("nan")), np.float64)  # a null row has no values there
    starts = np.cumsum(sizes) - sizes
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    kept = valid & (sizes > 0) & (bad[starts + sizes] == bad[starts])
    if length is not None:
        kept &= sizes == length
    return kept, flat, starts, sizes


def _matrix(flat, starts, rows, length: int, parts: int, scale: int):
    """Integer vectors of the given rows, filled up with zeros to a multiple of ``parts``."""
    import numpy as np

    bound = component_bound(length)
    x = flat[starts[rows][:, None] + np.arange(length)]
    whole = np.clip(np.floor(np.clip(x, -bound, bound) * scale), -bound, bound).astype(np.int64)
    return np.pad(whole, ((0, 0), (0, -length % parts)))


def _least(frames: Iterator, n: int, length: int | None, scale: int) -> Iterator:
    """The ``n`` least ids of a task with the least of their vectors."""
    import pyarrow as pa

    found: dict[int, list[float]] = {}
    for b in batches(frames):
        kept, flat, starts, sizes = _integers(b["embedding"], scale, length)
        ids = b["vec_id"].to_pylist()
        top = max(found) if len(found) >= n else None
        for i in kept.nonzero()[0].tolist():
            if ids[i] is not None and (top is None or ids[i] <= top):
                v = flat[starts[i] : starts[i] + sizes[i]].tolist()
                found[ids[i]] = min(found.get(ids[i], v), v)
                if len(found) > 4 * n:
                    found = {k: found[k] for k in sorted(found)[:n]}
                    top = max(found)
        found = {k: found[k] for k in sorted(found)[:n]}
    yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.list_(pa.float64()))], ["vec_id", "embedding"])


def _first_entries(vectors: DataFrame, entries: int, length: int | None, scale: int) -> list[tuple[int, list[float]]]:
    """The vectors of the ``entries`` least ids, in order: at most ``entries`` rows come to the driver."""
    least = vectors.mapInArrow(lambda frames: _least(frames, entries, length, scale), "vec_id long, embedding array<double>")
    rows = least.groupBy("vec_id").agg(F.min("embedding").alias("embedding")).orderBy("vec_id").limit(entries).collect()
    return [(r.vec_id, r.embedding) for r in rows]


def assign(part, book):
    """``index, distance`` of the nearest entry to each row: exact, the first of equally near ones."""
    import numpy as np

    norms, transposed = (book * book).sum(1), np.ascontiguousarray(book.T)
    index, distance = np.empty(len(part), np.int64), np.empty(len(part), np.int64)
    for a in range(0, len(part), BLOCK):
        x = part[a : a + BLOCK]
        apart = norms - 2 * (x @ transposed)  # the vector's own norm moves no comparison
        at = apart.argmin(1)
        index[a : a + BLOCK] = at
        distance[a : a + BLOCK] = apart[np.arange(len(x)), at] + (x * x).sum(1)
    return index, distance


def _coded(b, books, length: int, scale: int):
    """For a batch: rows kept, and for each part its integers, indexes and distances."""
    import numpy as np

    kept, flat, starts, _ = _integers(b["embedding"], scale, length)
    rows = kept.nonzero()[0]
    parts = np.split(_matrix(flat, starts, rows, length, len(books), scale), len(books), axis=1)
    return rows, [(p, *assign(p, book)) for p, book in zip(parts, books, strict=True)]


def _sums(frames: Iterator, books, length: int, scale: int) -> Iterator:
    """A row for each part and entry that a task used: the count and the sums of what it got."""
    import numpy as np
    import pyarrow as pa

    count = [np.zeros(len(b), np.int64) for b in books]
    total = [np.zeros(b.shape, np.int64) for b in books]
    for b in batches(frames):
        for k, (p, at, _) in enumerate(_coded(b, books, length, scale)[1]):
            order = at.argsort(kind="stable")
            used, first = np.unique(at[order], return_index=True)
            if len(used):
                total[k][used] += np.add.reduceat(p[order], first, axis=0)
                count[k][used] += np.diff([*first, len(at)])
    for k in range(len(books)):
        used = count[k].nonzero()[0]
        if len(used):
            sums = pa.array(total[k][used].tolist(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), k, np.int32)), pa.array(used.astype(np.int32)), pa.array(count[k][used]), sums], ["part", "entry", "n", "sums"])


def fit(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE):
    """``books, length``: a codebook (int64 array, entries x components) for each part, after ``rounds`` rounds."""
    import numpy as np

    first = _first_entries(vectors, entries, None, scale)
    if not first:
        return None, 0
    length = len(first[0][1])
    if any(len(v) != length for _, v in first):
        first = _first_entries(vectors, entries, length, scale)
    flat = np.array([v for _, v in first], np.float64)
    whole = _matrix(flat.reshape(-1), np.arange(len(flat)) * length, np.arange(len(flat)), length, parts, scale)
    books = [np.ascontiguousarray(b) for b in np.split(whole, parts, axis=1)]
    spark = vectors.sparkSession
    for _ in range(rounds):
        sent, width = spark.sparkContext.broadcast(books), books[0].shape[1]
        partial = vectors.mapInArrow(lambda frames, sent=sent: _sums(frames, sent.value, length, scale), "part int, entry int, n long, sums array<long>")
        merged = partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(width)]).alias("sums"))
        books = [b.copy() for b in books]
        for r in merged.collect():  # a row an entry
            books[r.part][r.entry] = [s // r.n for s in r.sums]
        sent.unpersist()
    return books, length


def books_sha256(books) -> str:
    return hashlib.sha256(",".join(str(x) for b in books or [] for x in b.reshape(-1).tolist()).encode()).hexdigest()


def _codes(frames: Iterator, books, length: int, scale: int) -> Iterator:
    import numpy as np
    import pyarrow as pa

    for b in batches(frames):
        rows, coded = _coded(b, books, length, scale)
        at = np.stack([at for _, at, _ in coded], axis=1)
        hexes = [f"{i:02x}" for i in range(max(len(b) for b in books))]
        codes = ["".join(hexes[i] for i in r) for r in at.tolist()]
        yield pa.RecordBatch.from_arrays([b["vec_id"].take(pa.array(rows)), b["label"].take(pa.array(rows)), pa.array(codes, pa.string()), pa.array(sum(d for _, _, d in coded))], ["vec_id", "label", "code", "error"])


def encode(vectors: DataFrame, books, length: int, scale: int = SCALE) -> DataFrame:
    """``vec_id, label, code, error`` of each vector: indexes in order of the parts, two hex digits each."""
    spark: SparkSession = vectors.sparkSession
    kinds = dict(zip(vectors.columns, vectors.schema.fields, strict=True))
    schema = T.StructType([kinds["vec_id"], kinds["label"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    if books is None:
        return spark.createDataFrame([], schema)
    sent = spark.sparkContext.broadcast(books)
    return vectors.mapInArrow(lambda frames: _codes(frames, sent.value, length, scale), schema)


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256``: one row a vector kept (see the module).

    Each round and the final pass read the vectors again, ids, vectors and labels only; what is written are the codes.
    Labels' errors go back to the rows by :func:`look_up`, whatever a label's share of the rows. At most 256 entries.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits a part: 1 to 256 entries")
    named = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding"), F.col(label_col).alias("label"))
    books, length = fit(named.select("vec_id", "embedding"), parts, entries, rounds, scale)
    coded = materialize(encode(named, books, length, scale), "codes")
    labels = materialize(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")), "label-errors")
    found = look_up(coded, labels, "label", "n")
    return found.select(F.col("vec_id").alias(id_col), "code", "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256"))
