"""Line dedup: documents probe a sharded minimal perfect hash over the repeated lines instead of joining lines.

1. Every document gives the 128-bit hashes of its long lines, once each; the distinct hashes that more than one
   document holds are indexed, with their number of documents and the largest id. (What one document holds can't go.)
2. Hashes are dealt to shards of bounded size. A task builds each shard's minimal perfect hash and three flat arrays
   that it indexes: fingerprints, counts and keepers.
3. Documents probe the arrays, and a line's count there decides whether it goes. While all shards together stay below
   a limit they are broadcast and no text moves; beyond, the most frequent lines alone are, and the hashes of the
   others go to the shards, salted, and only the lines to drop come back.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fairlead.llm.common import batches, materialize, small_batches

MIN_CHARS, MIN_DOCS = 20, 3
EDGE = b" \t\n\x0b\x0c\r"
#: Lines in a shard at most, about; bytes of all shards up to which they are broadcast.
SHARD_LINES, BROADCAST_BYTES = 50_000, 64 << 20
#: A document without an id comes before all others.
NO_ID = -(1 << 63)
#: When lines go to the shards, those with at least one in so many of all occurrences, that many at most, are broadcast;
#: the others, those that no other document has included, are dealt to groups of about GROUP_LINES.
FREQUENT, GROUP_LINES = 100_000, 500_000


def line_keys(text: bytes, min_chars: int = MIN_CHARS) -> list[bytes | None]:
    """Each line's key, or None where it is too short."""
    out = []
    for line in text.split(b"\n"):
        key = line.strip(EDGE).lower()  # of bytes: A-Z only
        out.append(key if len(key) >= min_chars and (key.isascii() or len(key.decode()) >= min_chars) else None)
    return out


def hash_key(key: bytes) -> tuple[int, int]:
    """128 bits as two signed 64-bit integers."""
    import xxhash

    return struct.unpack("<qq", xxhash.xxh3_128_digest(key))


class PerfectHash:
    """Minimal perfect hash over 128-bit keys, by levels (Limasset et al., 2017): on each level a key whose slot no
    other key shares sets its bit and the rest go on; a key's index is the number of set bits before its own."""

    GAMMA, LEVELS = 2, 40

    def __init__(self, sizes, words, ranks):
        self.sizes, self.words, self.ranks = sizes, words, ranks

    @staticmethod
    def _slots(a, b, level: int, size: int):
        import numpy as np

        with np.errstate(over="ignore"):
            x = a ^ (b + np.uint64(level) * np.uint64(0x9E3779B97F4A7C15))
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(31)
        return (x % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, a, b) -> PerfectHash:
        """``a, b``: the halves of distinct keys, as unsigned 64-bit integers."""
        import numpy as np

        sizes, bits = [], []
        for level in range(cls.LEVELS):
            if not len(a):
                break
            size = -(-max(64, cls.GAMMA * len(a)) // 64) * 64
            slots = cls._slots(a, b, level, size)
            alone = np.bincount(slots, minlength=size) == 1
            sizes.append(size)
            bits.append(alone)
            a, b = a[~alone[slots]], b[~alone[slots]]
        if len(a):
            raise ValueError("keys are not distinct")
        flat = np.concatenate(bits) if bits else np.zeros(0, bool)
        words = np.packbits(flat, bitorder="little").view(np.uint64)
        counts = np.bitwise_count(words).astype(np.int64)
        return cls(sizes, words, np.cumsum(counts) - counts)

    def index(self, a, b):
        """Each key's index, or -1 for a key that is surely not one of them."""
        import numpy as np

        out, open_, base = np.full(len(a), -1, np.int64), np.arange(len(a)), 0
        for level, size in enumerate(self.sizes):
            if not len(open_):
                break
            slots = self._slots(a[open_], b[open_], level, size) + base
            word, bit = slots >> 6, (slots & 63).astype(np.uint64)
            hit = (self.words[word] >> bit & np.uint64(1)).astype(bool)
            below = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
            out[open_[hit]] = (self.ranks[word] + np.bitwise_count(below))[hit]
            open_, base = open_[~hit], base + size
        return out


class Shard:
    """A perfect hash and the arrays it indexes. The fingerprint is the second half of a key; the hash itself takes
    both, so a line that isn't there passes with a probability below 2**-64."""

    def __init__(self, hashed: PerfectHash, fingerprints, counts, keepers):
        self.hashed, self.fingerprints, self.counts, self.keepers = hashed, fingerprints, counts, keepers

    @classmethod
    def build(cls, h1, h2, counts, keepers) -> Shard:
        import numpy as np

        a, b = h1.astype(np.int64).view(np.uint64), h2.astype(np.int64).view(np.uint64)
        hashed = PerfectHash.build(a, b)
        order = np.argsort(hashed.index(a, b))
        return cls(hashed, b[order], counts[order].astype(np.uint32), keepers[order].astype(np.int64))

    def to_bytes(self) -> bytes:
        import numpy as np

        sizes = np.array(self.hashed.sizes, np.int64)
        head = np.array([len(sizes), len(self.hashed.words), len(self.counts)], np.int64)
        return b"".join(x.tobytes() for x in (head, sizes, self.hashed.words, self.hashed.ranks, self.fingerprints, self.keepers, self.counts))

    @classmethod
    def from_bytes(cls, data: bytes) -> Shard:
        import numpy as np

        n_sizes, n_words, n = np.frombuffer(data, np.int64, 3)
        at, parts = 24, []
        for kind, k in ((np.int64, n_sizes), (np.uint64, n_words), (np.int64, n_words), (np.uint64, n), (np.int64, n), (np.uint32, n)):
            parts.append(np.frombuffer(data, kind, k, at))
            at += parts[-1].nbytes
        sizes, words, ranks, fingerprints, keepers, counts = parts
        return cls(PerfectHash(sizes.tolist(), words, ranks), fingerprints, counts, keepers)

    def probe(self, h1, h2):
        """``found, count, keeper`` for each key."""
        import numpy as np

        if not len(self.counts):
            zero = np.zeros(len(h1), np.int64)
            return zero.astype(bool), zero, zero
        a, b = h1.view(np.uint64), h2.view(np.uint64)
        i = self.hashed.index(a, b)
        found = (i >= 0) & (self.fingerprints[i] == b)
        return found, np.where(found, self.counts[i], 0), np.where(found, self.keepers[i], 0)


def _keys(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """``h1, h2, doc``: the long lines of each document, once each."""

    def run(frames: Iterator):
        import numpy as np
        import pyarrow as pa

        for batch in batches(frames):
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist(), strict=True):
                rows += [(*hash_key(k), NO_ID if doc is None else doc) for k in {k for k in line_keys(text or b"", min_chars) if k is not None}]
            cols = np.array(rows, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([pa.array(cols[:, i]) for i in range(3)], names=["h1", "h2", "doc"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "h1 long, h2 long, doc long")


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """``h1, h2, n, keeper``: the lines that more than one document holds, how many do, and the largest id of them."""
    counted = _keys(docs, id_col, text_col, min_chars).groupBy("h1", "h2").agg(F.count_distinct("doc").alias("n"), F.max("doc").alias("keeper")).where("n > 1")
    return materialize(counted, "lines")


def build_index(lines: DataFrame, n: int) -> tuple[DataFrame, int]:
    """``shard, data`` rows of all ``n`` lines, and the number of shards."""
    shards = max(1, -(-n // SHARD_LINES))

    def build(key, frame):
        import pandas as pd

        return pd.DataFrame({"shard": [key[0]], "data": [_shard_of(frame).to_bytes()]})

    # hashes are spread evenly, so a shard's size is bounded
    return lines.withColumn("shard", F.pmod("h1", F.lit(shards))).groupBy("shard").applyInPandas(build, "shard long, data binary"), shards


def _shard_of(frame) -> Shard:
    return Shard.build(*(frame[c].to_numpy() for c in ("h1", "h2", "n", "keeper")))


def _gone(shard: Shard, hashes, owners, min_docs: int):
    """Whether each line goes: by its count, and unless its document is the keeper."""
    import numpy as np

    found, count, keeper = shard.probe(np.ascontiguousarray(hashes[:, 0]), np.ascontiguousarray(hashes[:, 1]))
    return found & (count >= min_docs) & (keeper != owners)


def _in_groups(keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``keys`` with a ``salt``, and ``shard, salts``: each shard has as many groups as its probing lines need."""
    counts = materialize(keys.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / GROUP_LINES).alias("salts")), "shard-counts")
    salt = F.pmod(F.xxhash64("doc", "h2"), F.col("salts"))
    return keys.join(F.broadcast(counts), "shard").withColumn("salt", salt).drop("salts"), counts  # a row a shard


def _dropped_by_shard(docs: DataFrame, lines: DataFrame, n: int, frequent, id_col: str, text_col: str, min_chars: int, min_docs: int) -> DataFrame:
    """``doc, drop``: for each document that loses lines, the hashes of their keys, but for the ``frequent`` lines. The
    hashes of the probing lines are written once, so that each shard's can be counted before they are dealt."""
    index, shards = build_index(lines, n)

    def rare(frames):
        import numpy as np
        import pyarrow as pa

        known = Shard.from_bytes(frequent.value)
        for batch in batches(frames):
            h1, h2 = (np.ascontiguousarray(batch.column(i).to_numpy()) for i in range(2))
            yield batch.filter(pa.array(~known.probe(h1, h2)[0]))

    keys = _keys(docs, id_col, text_col, min_chars).mapInArrow(rare, "h1 long, h2 long, doc long")
    keys, counts = _in_groups(materialize(keys.withColumn("shard", F.pmod("h1", F.lit(shards))), "probing-lines"))
    copies = index.join(F.broadcast(counts), "shard").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).drop("salts")

    def probe(_, frame, data):
        import numpy as np

        if not len(data) or not len(frame):
            return frame.iloc[:0][["h1", "h2", "doc"]]
        gone = _gone(Shard.from_bytes(data["data"].iloc[0]), frame[["h1", "h2"]].to_numpy(np.int64), frame["doc"].to_numpy(), min_docs)
        return frame[gone][["h1", "h2", "doc"]]

    out = keys.groupBy("shard", "salt").cogroup(copies.groupBy("shard", "salt")).applyInPandas(probe, "h1 long, h2 long, doc long")
    return out.groupBy("doc").agg(F.collect_set(F.struct("h1", "h2")).alias("drop"))


def _sifted(text: bytes | None, drop: list[bool]) -> tuple[int, int, bytes]:
    lines = (text or b"").split(b"\n")
    kept = [x for x, d in zip(lines, drop, strict=True) if not d]
    return len(lines), len(lines) - len(kept), b"\n".join(kept)


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, broadcast_bytes: int = BROADCAST_BYTES, text: bool = True, carry: tuple[str, ...] = ()
) -> DataFrame:
    """One row a document: the id, ``n_lines, n_dropped, kept_sha256``, with ``text`` ``kept_text``, and ``carried_0``
    and so on, the columns named in ``carry``.

    A line's key is the line without white space at its ends and with A-Z lower-cased. Keys of at least ``min_chars``
    code points that at least ``min_docs`` documents hold lose all their lines but those of the largest id. Null or
    empty text is one empty line. Rows that repeat an id count as one document. Ids are whole numbers; a document
    without one comes before all others. If all lines go, the kept text is empty.
    """
    spark = docs.sparkSession
    small_batches(spark)
    lines = repeated_lines(docs, id_col, text_col, min_chars)
    size = lines.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()
    fields = T.StructType.fromDDL("doc long, n_lines long, n_dropped long, kept_sha256 string" + ", kept_text string" * text)
    for i, c in enumerate(carry):
        fields = fields.add(f"carried_{i}", docs.schema[c].dataType)
    carried = [F.col(c).alias(f"carried_{i}") for i, c in enumerate(carry)]

    def out(ids, sifted_, more):
        import pyarrow as pa

        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), *[pa.string()] * text]
        cols = [ids, *zip(*((a, b, hashlib.sha256(c).hexdigest(), *[c.decode()] * text) for a, b, c in sifted_), strict=True)]
        return pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(cols, kinds, strict=True)), *more], names=fields.names)

    if size.n * 32 <= broadcast_bytes:
        index, shards = build_index(lines, size.n)
        small = spark.sparkContext.broadcast({r.shard: bytes(r.data) for r in index.collect()})  # its size is checked above

        def probe(frames):
            import numpy as np
            import pyarrow as pa

            parts = {k: Shard.from_bytes(v) for k, v in small.value.items()}
            for batch in batches(frames):
                ids = batch.column(0).to_pylist()
                texts = batch.column(1).cast(pa.large_binary()).to_pylist()
                keys = [line_keys(t or b"", min_chars) for t in texts]
                at = [(i, j) for i, k in enumerate(keys) for j, x in enumerate(k) if x is not None]
                hashes = np.array([hash_key(keys[i][j]) for i, j in at], np.int64).reshape(-1, 2)
                owner = np.array([NO_ID if ids[i] is None else ids[i] for i, _ in at], np.int64)
                gone = np.zeros(len(at), bool)
                shard = hashes[:, 0] % shards
                for s, part in parts.items():
                    own = np.flatnonzero(shard == s)
                    gone[own] = _gone(part, hashes[own], owner[own], min_docs)
                drop = [[False] * len(k) for k in keys]
                for k in np.flatnonzero(gone).tolist():
                    i, j = at[k]
                    drop[i][j] = True
                yield out(ids, [_sifted(t, d) for t, d in zip(texts, drop, strict=True)], batch.columns[2:])

        sifted = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text"), *carried).mapInArrow(probe, fields)
    else:
        often = lines.where(F.col("n") * FREQUENT >= size.total).toPandas()  # FREQUENT rows at most
        frequent = spark.sparkContext.broadcast(_shard_of(often).to_bytes())
        drops = _dropped_by_shard(docs, lines, size.n, frequent, id_col, text_col, min_chars, min_docs)
        own = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text"), *carried)
        joined = own.join(drops, F.coalesce(own["__id"], F.lit(NO_ID)) == drops.doc, "left").select("__id", "__text", "drop", *[f"carried_{i}" for i in range(len(carry))])

        def sift(frames):
            import numpy as np
            import pyarrow as pa

            known = Shard.from_bytes(frequent.value)
            for batch in batches(frames):
                texts, ids = batch.column(1).cast(pa.large_binary()).to_pylist(), batch.column(0).to_pylist()
                done = []
                for i, t, drop in zip(ids, texts, batch.column(2).to_pylist(), strict=True):
                    drop = {(g["h1"], g["h2"]) for g in drop or ()}
                    keys = line_keys(t or b"", min_chars)
                    hashes = np.array([hash_key(k) if k is not None else (0, 0) for k in keys], np.int64).reshape(-1, 2)
                    gone = _gone(known, hashes, NO_ID if i is None else i, min_docs)
                    done.append(_sifted(t, [k is not None and (bool(g) or (a, b) in drop) for k, g, (a, b) in zip(keys, gone, hashes.tolist(), strict=True)]))
                yield out(ids, done, batch.columns[3:])

        sifted = joined.mapInArrow(sift, fields)
    kind = docs.schema[id_col].dataType
    return sifted.withColumnRenamed("doc", id_col).withColumn(id_col, F.col(id_col).cast(kind))


def deduplicated_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """The documents with what :func:`dedup_lines` keeps of their texts, all their columns, and ``chars_col``, if there
    is one, counted anew."""
    others = tuple(c for c in docs.columns if c not in (id_col, text_col, chars_col))
    found = dedup_lines(docs, id_col, text_col, carry=others)
    place = {c: F.col(f"carried_{i}") for i, c in enumerate(others)} | {id_col: F.col(id_col), text_col: F.col("kept_text")}
    if chars_col in docs.columns:
        place[chars_col] = F.char_length("kept_text").cast(docs.schema[chars_col].dataType)
    return found.select(*[place[c].alias(c) for c in docs.columns])
