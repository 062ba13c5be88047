"""How filters act on each other: what each of several filters removes, in every order of applying them.

Texts are read once, as Arrow buffers: a table of byte classes and prefix sums over a batch's bytes give words, capitals,
symbols and code points of every text at once, without a Python string. A word's hash is a difference of prefix sums
too; the hashes of a text are sorted, and equal neighbours are compared byte by byte, so that a text's distinct words
are exact (a text with unequal neighbours of one hash is counted by a set). Each document becomes five bits, the filters
that it fails, and a digest; documents with the same bits are counted together, and all 120 orders follow from those
32 counts a part.

Edge cases: null text counts as empty, a null part as the empty string. Null ids have no smaller ids and are smaller
than none, so such rows pass filter E; rows that repeat an id and its text don't fail E by each other. Of several labels
for an id, one with quality 1 (toxic 1) counts. An empty table has no part and gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairlead.llm.common import batches, materialize, small_batches
from fairlead.operators.shared import look_up

MIN_WORDS, MIN_DISTINCT_PCT, MAX_CAPITAL_PCT = 100, 80, 10
SYMBOLS = b"#$%&*|"
FILTERS = "ABCDE"
#: Bytes of text that are scanned at once; a longer text is scanned alone.
SCAN_BYTES = 4 << 20
_GAP, _CAPITAL, _SYMBOL, _POINT = 1, 2, 4, 8


def byte_classes():
    """Class bits of each byte: white space, capital, symbol, first byte of a code point."""
    import numpy as np

    c = np.zeros(256, np.uint8)
    c[[0x20, *range(0x09, 0x0E)]] |= _GAP
    c[ord("A") : ord("Z") + 1] |= _CAPITAL
    c[list(SYMBOLS)] |= _SYMBOL
    c[[b for b in range(256) if b & 0xC0 != 0x80]] |= _POINT
    return c


#: An odd multiplier, so that it has an inverse modulo 2**64; bytes are mapped to odd 64-bit numbers.
_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)


def _word_hashes(data, start, end):
    """A 64-bit hash of each word, from one running sum over all bytes (modulo 2**64)."""
    import numpy as np

    powers = np.full(len(data) + 1, _MULTIPLIER, np.uint64)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    letter = (np.arange(256, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) ^ np.uint64(0xA5A5A5A5A5A5A5A5)
    upto = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(letter[data] * powers[:-1], out=upto[1:])
    powers = np.full(len(data) + 1, _INVERSE, np.uint64)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    found = (upto[end] - upto[start]) * powers[start]
    found ^= found >> np.uint64(32)
    return (found * np.uint64(_MULTIPLIER)) ^ (end - start).astype(np.uint64)


def _distinct(data, start, end, doc, docs: int):
    """Distinct words of each text; words are in order of their texts."""
    import numpy as np

    if not len(start):
        return np.zeros(docs, np.int64)
    hashes = _word_hashes(data, start, end)
    bits = max(int(docs - 1).bit_length(), 1)
    key = (doc.astype(np.uint64) << np.uint64(64 - bits)) | (hashes >> np.uint64(bits))
    order = key.argsort(kind="stable")
    same = np.flatnonzero(key[order][1:] == key[order][:-1])
    a, b = order[same], order[same + 1]
    size = end[a] - start[a]
    differ = size != end[b] - start[b]
    check = np.where(differ, 0, size)
    step = np.arange(check.sum()) - np.repeat(np.cumsum(check) - check, check)
    unequal = data[np.repeat(start[a], check) + step] != data[np.repeat(start[b], check) + step]
    differ[np.repeat(np.arange(len(a)), check)[unequal]] = True
    found = np.bincount(doc, minlength=docs) - np.bincount(doc[a], minlength=docs)
    for d in np.unique(doc[a[differ]]).tolist():
        i, j = np.searchsorted(doc, [d, d + 1])
        found[d] = len({data[start[k] : end[k]].tobytes() for k in range(i, j)})
    return found


def scan_texts(data, offsets):
    """``n_words, n_distinct, n_capitals, n_symbols, n_points`` of the texts in a byte buffer, each an int64 array."""
    import numpy as np

    base, docs = int(offsets[0]), len(offsets) - 1
    at = offsets.astype(np.int64) - base
    data = data[base : base + int(at[-1])]
    kind = byte_classes()[data]

    def count(flag):
        sums = np.concatenate([[0], np.cumsum(flag, dtype=np.int64)])
        return sums[at[1:]] - sums[at[:-1]]

    word = np.zeros(len(data) + 1, bool)
    word[:-1] = (kind & _GAP) == 0
    before = np.concatenate([[False], word[:-1]])
    before[at] = False  # a text begins anew
    start = np.flatnonzero(word & ~before)
    after = np.concatenate([word[1:], [False]])
    cut = at[1:][at[1:] > 0] - 1  # and ends
    after[cut] = False
    end = np.flatnonzero(word & ~after) + 1
    doc = np.searchsorted(at, start, side="right") - 1
    return np.bincount(doc, minlength=docs).astype(np.int64), _distinct(data, start, end, doc, docs), count((kind & _CAPITAL) != 0), count((kind & _SYMBOL) != 0), count((kind & _POINT) != 0)


def text_failures(data, offsets):
    """The bits of the filters A to D that each text fails."""
    n, distinct, capitals, symbols, points = scan_texts(data, offsets)
    return (n < MIN_WORDS) * 1 + (100 * distinct < MIN_DISTINCT_PCT * n) * 2 + (100 * capitals > MAX_CAPITAL_PCT * points) * 4 + (symbols > 0) * 8


def _slices(offsets, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of texts of at most ``limit`` bytes, one text at least."""
    import numpy as np

    a = 0
    while a < len(offsets) - 1:
        b = max(int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1, a + 1)
        yield a, b
        a = b


def _scan(frames: Iterator) -> Iterator:
    import hashlib

    import numpy as np
    import pyarrow as pa

    for b in batches(frames):
        text = b["text"].cast(pa.large_binary()).fill_null(b"")
        _, ends, values = text.buffers()
        offsets = np.frombuffer(ends, np.int64)[text.offset : text.offset + len(text) + 1]
        data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
        bits = [text_failures(data, offsets[i : j + 1]) for i, j in _slices(offsets, SCAN_BYTES)]
        whole = memoryview(data)
        digests = [hashlib.sha256(whole[i:j]).digest() for i, j in itertools.pairwise(offsets.tolist())]
        yield pa.RecordBatch.from_arrays([b["doc"], b["part"], pa.array(np.concatenate(bits).astype(np.int32)), pa.array(digests, pa.binary())], ["doc", "part", "mask", "digest"])


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``doc, part, mask`` of each row: bit ``i`` of the mask is set where the row fails filter ``i`` of A to E.

    The texts are read once. A digest of 256 bits stands for a text; digests of more than one row are looked up, the
    frequent ones without a shuffle.
    """
    small_batches(docs.sparkSession)
    named = docs.select(F.col(id_col).alias("doc"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(text_col).alias("text"))
    kind = named.schema["doc"].dataType.simpleString()
    rows = materialize(named.mapInArrow(_scan, f"doc {kind}, part string, mask int, digest binary"), "masks")
    groups = rows.groupBy("digest").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.count(F.lit(1)).alias("n"))
    copies = materialize(groups.where(F.col("last") > F.col("first")).select("digest", "first", "n"), "copies")
    found = look_up(rows, copies, "digest", "n")
    late = F.when(F.col("doc") > F.col("first"), 16).otherwise(0)
    return found.select("doc", "part", (F.col("mask") + late).alias("mask"))


def order_steps() -> list[tuple[str, int, int, int]]:
    """Every order with its steps: ``order, step, bit`` of the step's filter, and the bits of those before it."""
    bit = {f: 1 << i for i, f in enumerate(FILTERS)}
    return [("".join(o), k + 1, bit[o[k]], sum(bit[f] for f in o[:k])) for o in itertools.permutations(FILTERS) for k in range(len(o))]


def interaction_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", quality_col: str = "quality", toxic_col: str = "toxic") -> DataFrame:
    """``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``: a row for
    each part, order and step.

    Rows are counted by id, part and mask before they meet the labels, so no id is hot there (it has a row for each
    part and mask at most); then by part and mask. The orders are made from a part's 32 counts.
    """
    seen = failures(docs, id_col, text_col, part_col).groupBy("doc", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    flags = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("l")).agg(*[F.max((F.coalesce(F.col(c), F.lit(0)) == 1).cast("int")).alias(name) for c, name in ((quality_col, "good"), (toxic_col, "toxic"))])
    marked = seen.join(flags, F.col("doc") == F.col("l"), "left")
    by_mask = marked.groupBy("part", "mask").agg(F.sum("n").alias("n"), *[F.sum(F.col("n") * F.coalesce(F.col(c), F.lit(0))).alias(c) for c in ("good", "toxic")])
    counts = by_mask.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("counts"))  # 32 at most

    def total(value: str, chosen) -> F.Column:
        return F.aggregate("counts", F.lit(0).cast("long"), lambda a, c: a + F.when(chosen(c.mask), c[value]).otherwise(0))

    steps = F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(s).alias("step"), F.lit(b).alias("bit"), F.lit(p).alias("prior")) for o, s, b, p in order_steps()])
    each = counts.withColumn("s", F.explode(steps)).select("part", "counts", "s.*")
    bit, prior = F.col("bit"), F.col("prior")
    here = lambda m: (m.bitwiseAND(bit) > 0) & (m.bitwiseAND(prior) == 0)
    table = each.select(
        "part", "filter_order", "step", "bit",
        total("n", lambda m: m.bitwiseAND(bit.bitwiseOR(prior)) == 0).alias("kept"),
        total("n", here).alias("removed"),
        total("n", lambda m: (m.bitwiseAND(bit) > 0) & (m.bitwiseAND(prior) > 0)).alias("redundant"),
        total("n", lambda m: m == bit).alias("unique_fails"),
        total("good", here).alias("good_lost"),
        total("toxic", here).alias("toxic_lost"),
    )
    table = materialize(table, "steps")
    shapley = table.groupBy(F.col("part").alias("p"), F.col("bit").alias("b")).agg(F.sum("removed").alias("shapley"))
    both = table.join(shapley, (F.col("part") == F.col("p")) & (F.col("bit") == F.col("b")))
    return both.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
