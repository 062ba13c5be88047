"""Near-duplicate documents: an exact n-gram Jaccard join with rare-first prefix filtering.

1. Every document becomes the set of its word n-grams (64-bit hashes). Documents with equal sets form a class, and
   one of each class goes on. The same pass counts n-grams in a table whose size grows with the input up to a bound;
   tasks' tables are added up in two steps, a slice of them at a time.
2. A set's n-grams are ordered rare first (by that table, then by hash: any fixed order is right, a rare-first one is
   fast). Two sets that are similar enough share one of their first ``size - ceil(t * size) + 1`` n-grams.
3. Sets meet on these prefix n-grams, sorted by ranges of n-gram and document, so that a frequent n-gram is spread over
   tasks. A pair must pass the length, positional and suffix filters, and is verified once.
4. Links only matter for the component they join. So each n-gram first links its sets to one of them, then, where they
   are in different components, to a few others; pairs that are in one component by then need no check, and the pairs of
   sets that are still in different components all get theirs, if their parity signatures don't rule it out.
   A group of thousands of near copies costs one check a member, and no link between components is lost.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairlead.llm.common import batches, materialize, small_batches

#: Slots of the table of counts at least and at most, a slot for SLOT_BYTES of text, and slots in a slice. A slot is a
#: byte once it is counted, so what is broadcast stays below 16 MB.
LEAST_SLOTS, MOST_SLOTS, SLOT_BYTES, SLICE = 1 << 22, 1 << 24, 256, 1 << 16
#: Members of pairs up to which texts are sought by a broadcast of ids.
MEMBERS = 2_000_000
#: Fixed bins of the suffix filter; 64-bit words of a set's parity signature; pivots of an n-gram in the second round.
BINS, WORDS, PIVOTS = 16, 4, 4
#: Members verified beside one copy of their pivot; sets of an n-gram in a block of the third round.
STAR, BLOCK = 64, 400
#: Halvings of the suffix filter where both sets are at hand.
DEPTH = 2
NEAR_WORDS, NEAR_PCT = 5, 80


def need(size_a, size_b, pct: int):
    """Least overlap of two sets with ``100 * overlap >= pct * union`` (integers or numpy arrays)."""
    return -(-pct * (size_a + size_b) // (100 + pct))


def shingle_sets(texts: list, n: int) -> list:
    """Each text's set of ``n``-word shingles as sorted 64-bit hashes; fewer words make one shingle, none make none."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    import xxhash

    lower = pc.ascii_lower(pa.array(["" if t is None else t for t in texts], pa.large_string()))
    split = pc.ascii_split_whitespace(lower)
    coded = split.values.dictionary_encode()
    names = coded.dictionary.to_pylist()
    hashes = np.array([xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in names], np.uint64)
    codes, offsets = coded.indices.to_numpy(), split.offsets.to_numpy()
    empty = np.array([w == "" for w in names], bool)
    real = ~empty[codes] if len(codes) else np.zeros(0, bool)
    counts = np.concatenate([[0], np.cumsum(real)])[offsets]  # words before each text
    words = hashes[codes[real]] if len(codes) else np.zeros(0, np.uint64)
    out = []
    with np.errstate(over="ignore"):
        mixed = None
        if len(words) >= n:
            mixed = words[: len(words) - n + 1].copy()
            for i in range(1, n):
                mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + words[i : len(words) - n + 1 + i]
            mixed ^= mixed >> np.uint64(31)
            mixed *= np.uint64(0xBF58476D1CE4E5B9)
            mixed ^= mixed >> np.uint64(29)
        for a, b in zip(counts[:-1].tolist(), counts[1:].tolist(), strict=True):
            if b - a >= n:
                out.append(np.unique(mixed[a : b - n + 1]))
            elif b > a:
                h = np.uint64(b - a)
                for w in words[a:b]:
                    h = h * np.uint64(0x94D049BB133111EB) + w
                out.append(np.array([h], np.uint64))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def _sets(docs: DataFrame, n: int, slots: int) -> DataFrame:
    """Rows of two kinds: ``doc, size, h1, h2`` for each document (equal sets have equal hashes), and ``slice, data`` with
    this task's counts of n-grams."""

    def run(frames: Iterator):
        import struct

        import numpy as np
        import pyarrow as pa
        import xxhash

        kinds = {"doc": pa.int64(), "size": pa.int32(), "h1": pa.int64(), "h2": pa.int64(), "slice": pa.int32(), "data": pa.binary()}
        counts = np.zeros(slots, np.uint32)

        def rows(length: int, **cols):
            return pa.RecordBatch.from_arrays([pa.array(cols[c], k) if c in cols else pa.nulls(length, k) for c, k in kinds.items()], names=list(kinds))

        for batch in batches(frames):
            sets = shingle_sets(batch.column(1).to_pylist(), n)
            at, times = np.unique(np.concatenate(sets) & np.uint64(slots - 1), return_counts=True)
            counts[at.astype(np.int64)] += times.astype(np.uint32)
            pairs = [struct.unpack("<qq", xxhash.xxh3_128_digest(s.tobytes())) for s in sets]
            yield rows(len(sets), doc=batch.column(0), size=[len(s) for s in sets], h1=[x for x, _ in pairs], h2=[y for _, y in pairs])
        used = [i for i in range(slots // SLICE) if counts[i * SLICE : (i + 1) * SLICE].any()]
        yield rows(len(used), slice=used, data=[zlib.compress(counts[i * SLICE : (i + 1) * SLICE].tobytes(), 1) for i in used])

    return docs.mapInArrow(run, "doc long, size int, h1 long, h2 long, slice int, data binary")


def _slots_for(docs: DataFrame) -> int:
    size = docs.agg(F.sum(F.octet_length("text").cast("long")).alias("n")).first().n or 0
    return min(MOST_SLOTS, max(LEAST_SLOTS, 1 << (size // SLOT_BYTES).bit_length()))


def _levels(sets: DataFrame, slots: int, tasks: int):
    """The whole table, a byte a slot: four times the binary logarithm of its count. Tasks' slices are added up by groups
    of about the square root of their number, then the groups'."""
    import numpy as np

    def add(frames):
        import pyarrow as pa

        total: dict[int, np.ndarray] = {}
        for batch in batches(frames):
            for i, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.frombuffer(zlib.decompress(data), np.uint32)
                total[i] = np.minimum(total[i].astype(np.uint64) + own, 0xFFFFFFFF).astype(np.uint32) if i in total else own
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([zlib.compress(v.tobytes(), 1) for v in total.values()], pa.binary())], names=["slice", "data"])

    def level(frames):
        import pyarrow as pa

        for batch in add(frames):
            of = [np.floor(4 * np.log2(np.frombuffer(zlib.decompress(d), np.uint32) + 1.0)).astype(np.uint8).tobytes() for d in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(of, pa.binary())], names=["slice", "data"])

    groups = max(1, round(tasks**0.5))
    parts = sets.where(F.col("slice").isNotNull()).select("slice", "data", F.pmod(F.xxhash64("data"), F.lit(groups)).alias("g"))
    some = parts.repartition("slice", "g").select("slice", "data").mapInArrow(add, "slice int, data binary")
    out = np.zeros(slots, np.uint8)
    for r in some.repartition("slice").mapInArrow(level, "slice int, data binary").collect():  # MOST_SLOTS bytes at most
        out[r["slice"] * SLICE : (r["slice"] + 1) * SLICE] = np.frombuffer(r["data"], np.uint8)
    return out


def _prefixes(docs: DataFrame, n: int, pct: int, levels) -> DataFrame:
    """``doc, size, prefix`` (n-grams, rare first), ``bins`` (how many of the set's n-grams fall in each of BINS) and
    ``sig`` (whether an odd number falls in each of 64 * WORDS)."""
    small = docs.sparkSession.sparkContext.broadcast(levels)  # MOST_SLOTS bytes at most

    def run(frames):
        import numpy as np
        import pyarrow as pa

        for batch in batches(frames):
            sets = shingle_sets(batch.column(1).to_pylist(), n)
            prefix, bins, sig = [], [], []
            table = small.value
            for s in sets:
                often = table[(s & np.uint64(len(table) - 1)).astype(np.int64)]
                keep = len(s) + (-pct * len(s) // 100) + 1 if len(s) else 0
                prefix.append(s[np.lexsort((s, often))[:keep]].view(np.int64))
                bins.append(np.bincount((s >> np.uint64(58)).astype(np.int64) % BINS, minlength=BINS).astype(np.int32))
                odd = np.bincount((s >> np.uint64(32)).astype(np.int64) % (64 * WORDS), minlength=64 * WORDS) & 1
                sig.append(np.packbits(odd.astype(bool), bitorder="little").view(np.int64))
            lengths = np.concatenate([[0], np.cumsum([len(p) for p in prefix])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(s) for s in sets], pa.int32()),
                    pa.ListArray.from_arrays(pa.array(lengths), pa.array(np.concatenate(prefix))),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, BINS * len(sets) + 1, BINS, dtype=np.int32)), pa.array(np.concatenate(bins))),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, WORDS * len(sets) + 1, WORDS, dtype=np.int32)), pa.array(np.concatenate(sig))),
                ],
                names=["doc", "size", "prefix", "bins", "sig"],
            )

    return docs.mapInArrow(run, "doc long, size int, prefix array<long>, bins array<int>, sig array<long>")


def _need(a, b, pct: int):
    return F.ceil(F.lit(pct) * (a + b) / (100 + pct))


def _may_link(size_a, at_a, size_b, at_b, pct: int):
    """Length and positional filters. The second is right for the first n-gram that two prefixes share, and every
    similar pair meets there."""
    long_enough = (F.least(size_a, size_b) * 100) >= (F.greatest(size_a, size_b) * pct)
    return long_enough & (1 + F.least(size_a - at_a - 1, size_b - at_b - 1) >= _need(size_a, size_b, pct))


def _near_signatures(sig_a, sig_b, size_a, size_b, pct: int):
    """Where signatures differ, so do sets: each differing bit is an n-gram at least that only one of them has."""
    apart = sum(F.bit_count(F.get(sig_a, F.lit(i)).bitwiseXOR(F.get(sig_b, F.lit(i)))) for i in range(WORDS))
    return size_a + size_b - apart >= 2 * _need(size_a, size_b, pct)


def _suffix_filter(pairs: DataFrame, sizes: DataFrame, pct: int) -> DataFrame:
    """Drops pairs whose overlap can't be enough, by signature and bin by bin (the suffix filter's bound with fixed
    pivots, before texts are fetched; :func:`hamming_bound` is the filter itself). ``pairs``: ``a, b``; ``sizes``: ``doc,
    size, bins, sig``."""
    a, b = (sizes.select(F.col("doc").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("size", "bins", "sig")]) for s in "ab")
    both = pairs.join(a, "a").join(b, "b")
    most = F.aggregate(F.zip_with("bins_a", "bins_b", lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    size_a, size_b = F.col("size_a"), F.col("size_b")
    return both.where((most >= _need(size_a, size_b, pct)) & _near_signatures(F.col("sig_a"), F.col("sig_b"), size_a, size_b, pct)).select("a", "b")


def hamming_bound(x, y, most: int, depth: int = DEPTH) -> int:
    """At least so many n-grams are in one of two sorted sets only; stops once that is more than ``most``. The suffix
    filter of Xiao et al. (2008): the sets are cut at the middle of the second, and each half's sizes give a bound."""
    if not depth or not len(x) or not len(y):
        return abs(len(x) - len(y))
    j = len(y) // 2
    i = int(x.searchsorted(y[j]))
    same = int(i < len(x) and x[i] == y[j])
    right = abs((len(x) - i - same) - (len(y) - j - 1)) + 1 - same
    low = abs(i - j) + right
    if low <= most:
        low = hamming_bound(x[:i], y[:j], most - right, depth - 1) + right
    if low <= most:
        left = low - right
        low = left + hamming_bound(x[i + same :], y[j + 1 :], most - left - 1 + same, depth - 1) + 1 - same
    return low


def _mixed(rows: DataFrame) -> DataFrame:
    """Those of ``rows`` whose n-gram stands in sets of different components (``label``), with ``n``, how many do."""
    open_ = rows.groupBy("gram").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("n")).where("low < high").select("gram", "n")
    return materialize(rows.drop("n").join(open_, "gram"), "mixed")


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` with the ``label`` of each set's component."""
    known = labels.withColumnRenamed("label", "known")
    return materialize(rows.drop("label").join(known, "doc", "left").withColumn("label", F.coalesce("known", "doc")).drop("known"), "labelled")


def _verified(pairs: DataFrame, docs: DataFrame, n: int, pct: int) -> DataFrame:
    """The pairs ``a, b`` (a written table) whose texts are similar enough. Only texts of members of pairs are moved. A
    pivot ``a`` and its partners meet in one place; many partners are dealt to many places, with a copy of the pivot in
    each."""
    if pairs.isEmpty():
        return pairs.select("a", "b")
    many = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / STAR).alias("places"))
    dealt = pairs.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("places")).alias("place"))
    dealt = materialize(dealt, "pairs")
    stars = dealt.select("a", "place", F.col("b").alias("member"), F.lit(1).alias("kind")).unionByName(dealt.select("a", "place", F.col("a").alias("member"), F.lit(0).alias("kind")).distinct())
    members = stars.select("member")
    wanted = F.broadcast(members) if 2 * dealt.count() <= MEMBERS else members.distinct()
    texts = docs.join(wanted, docs.doc == members.member, "left_semi")
    with_text = stars.join(texts.hint("merge"), stars.member == texts.doc).select("a", "place", "kind", "member", "text")

    def run(frames):
        import numpy as np
        import pyarrow as pa

        pivot, own = None, None
        for batch in batches(frames):
            a, kind, member = (batch.column(i).to_pylist() for i in (0, 2, 3))
            sets, found = shingle_sets(batch.column(4).to_pylist(), n), []
            for x, k, m, s in zip(a, kind, member, sets, strict=True):
                if k == 0:
                    pivot, own = x, s
                elif pivot == x and hamming_bound(own, s, len(own) + len(s) - 2 * need(len(own), len(s), pct)) <= len(own) + len(s) - 2 * need(len(own), len(s), pct):
                    both = len(np.intersect1d(own, s, assume_unique=True))
                    if both and 100 * both >= pct * (len(own) + len(s) - both):
                        found.append((x, m))
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.int64()), pa.array([q for _, q in found], pa.int64())], names=["a", "b"])

    return with_text.repartition("a", "place").sortWithinPartitions("a", "place", "kind", "member").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """``doc, label``: for each end of an edge ``a, b``, the least id in its component. Labels spread to neighbours and
    then follow themselves, so the rounds grow with the logarithm of a component's width; they end once no edge has
    different labels, as the least document of a component keeps its own."""
    both = materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("doc")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        ends = both.where("a < b").join(labels.select(F.col("doc").alias("a"), F.col("label").alias("of_a")), "a").join(labels.select(F.col("doc").alias("b"), F.col("label").alias("of_b")), "b")
        if ends.where("of_a <> of_b").isEmpty():
            return labels
        near = both.join(labels.select(F.col("doc").alias("b"), "label"), "b").groupBy(F.col("a").alias("doc")).agg(F.min("label").alias("near"))
        closer = labels.join(near, "doc").select("doc", F.least("label", "near").alias("new"))
        jump = labels.select(F.col("doc").alias("new"), F.col("label").alias("far"))
        labels = materialize(closer.join(jump, "new").select("doc", F.least("new", "far").alias("label")), "labels")


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (a written table) with more links: these join components, so the rounds run over the joined ones alone."""
    ends = links.select("a", "b")
    for end in "ab":
        ends = ends.join(labels.select(F.col("doc").alias(end), F.col("label").alias(f"of_{end}")), end, "left")
    joined = ends.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b")).where("a <> b").distinct()
    joined = materialize(joined, "joined")
    if joined.isEmpty():
        return labels
    moved = components(joined)
    old = labels.join(moved.select(F.col("doc").alias("label"), F.col("label").alias("now")), "label", "left").select("doc", F.coalesce("now", "label").alias("label"))
    return materialize(old.unionByName(moved.join(labels, "doc", "left_anti")), "labels")


def _met(placed: DataFrame) -> DataFrame:
    """``doc, size, at, gram, pivot, edge``: what meets others on its n-gram, with the first set that has it in its task.

    Rows are sorted by ranges of n-gram and document, so a frequent n-gram takes as many tasks as it needs. ``edge`` is
    set for the first and last n-gram of a task: others of it may be in the tasks beside."""
    schema = "doc long, size int, at int, gram long, pivot struct<doc:long,size:int,at:int>, edge boolean"

    def run(frames):
        import numpy as np
        import pyarrow as pa

        kinds = {"doc": pa.int64(), "size": pa.int32(), "at": pa.int32(), "gram": pa.int64()}

        def rows(cols, head, edge, keep):
            own = [pa.array(c, k) for c, k in zip(cols, kinds.values(), strict=True)]
            pivot = pa.StructArray.from_arrays([c.take(pa.array(head)) for c in own[:3]], list(kinds)[:3])
            return pa.RecordBatch.from_arrays([*own, pivot, pa.array(edge)], names=[*kinds, "pivot", "edge"]).filter(pa.array(keep))

        first, held, sent = None, None, False  # the task's first n-gram; the first row of the last one so far, and whether it has gone out
        for batch in batches(frames):
            cols = [batch.column(i).to_numpy() for i in range(4)]
            if held is not None:
                cols = [np.concatenate([h, c]) for h, c in zip(held, cols, strict=True)]
            gram = cols[3]
            first = gram[0] if first is None else first
            starts = np.concatenate([[True], gram[1:] != gram[:-1]])
            head = np.maximum.accumulate(np.where(starts, np.arange(len(gram)), 0))
            last = gram == gram[-1]
            keep = ~(starts & np.append(starts[1:], True)) | (gram == first)
            keep[last] = last.sum() > 1  # alone so far: more may come
            if held is not None and sent:
                keep[0] = False
            yield rows(cols, head, (gram == first) | last, keep)
            sent = bool(last.sum() > 1 or sent and held is not None and last[0])
            held = [c[[last.argmax()]] for c in cols]
        if held is not None and not sent:
            yield rows(held, np.zeros(1, np.int64), np.ones(1, bool), np.ones(1, bool))

    return placed.repartitionByRange("gram", "doc").sortWithinPartitions("gram", "doc").select("doc", "size", "at", "gram").mapInArrow(run, schema)


def _linked(docs: DataFrame, reps: DataFrame, n: int, pct: int, levels) -> DataFrame:
    """``doc, label``: the component of each of ``reps`` that is similar to another."""
    ordered = materialize(_prefixes(docs, n, pct, levels).join(reps, "doc", "left_semi"), "prefixes")
    met = materialize(_met(ordered.select("doc", "size", F.posexplode("prefix").alias("at", "gram"))), "met")
    sizes = ordered.select("doc", "size", "bins", "sig")

    beside = met.select("doc", "size", "at", "pivot")
    parts = met.where("edge").groupBy("gram", "pivot").agg(F.count(F.lit(1)).alias("n")).select("gram", "pivot")  # two n-grams a task
    over = parts.join(parts.groupBy("gram").agg(F.min("pivot").alias("least")), "gram").select("pivot.*", F.col("least").alias("pivot"))
    may = _may_link(F.col("size"), F.col("at"), F.col("pivot.size"), F.col("pivot.at"), pct)
    first = beside.unionByName(over).where((F.col("doc") != F.col("pivot.doc")) & may).select(F.least("pivot.doc", "doc").alias("a"), F.greatest("pivot.doc", "doc").alias("b")).distinct()
    first = materialize(_suffix_filter(first, sizes, pct), "first")
    labels = components(materialize(_verified(first, docs, n, pct), "links"))

    # more pivots for n-grams of many components, so that large groups of near copies are one by the third round
    mixed = _mixed(_labelled(met.drop("pivot", "edge"), labels))
    pivots = mixed.groupBy("gram").agg(F.array(*[F.min(F.struct(F.xxhash64("doc", F.lit(i)).alias("h"), "doc", "size", "at", "label")) for i in range(PIVOTS)]).alias("pivots"))
    beside = mixed.join(pivots, "gram").select("doc", "size", "at", "label", F.explode(F.array_distinct("pivots")).alias("pivot"))
    may = (F.col("label") != F.col("pivot.label")) & _may_link(F.col("size"), F.col("at"), F.col("pivot.size"), F.col("pivot.at"), pct)
    second = beside.where(may).select(F.least("doc", "pivot.doc").alias("a"), F.greatest("doc", "pivot.doc").alias("b")).distinct()
    second = materialize(_suffix_filter(second.join(first, ["a", "b"], "left_anti"), sizes, pct), "second")
    labels = _merged(labels, materialize(_verified(second, docs, n, pct), "links"))

    # what is still apart, each pair once: an n-gram's sets are dealt to blocks that each meet all its sets
    mixed = _mixed(_labelled(mixed, labels)).join(sizes.select("doc", "sig"), "doc")
    blocks = F.ceil(F.col("n") / BLOCK)
    x, y = (mixed.select("gram", *[F.col(c).alias(f"{c}_{s}") for c in ("doc", "size", "at", "label", "sig")], place.alias("block")) for s, place in (("a", F.pmod(F.xxhash64("doc"), blocks)), ("b", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))))
    may = _may_link(F.col("size_a"), F.col("at_a"), F.col("size_b"), F.col("at_b"), pct) & _near_signatures(F.col("sig_a"), F.col("sig_b"), F.col("size_a"), F.col("size_b"), pct)
    rest = x.join(y, ["gram", "block"]).where((F.col("doc_a") < F.col("doc_b")) & (F.col("label_a") != F.col("label_b")) & may).select(F.col("doc_a").alias("a"), F.col("doc_b").alias("b")).distinct()
    tried = first.unionByName(second)
    rest = materialize(_suffix_filter(rest.join(tried, ["a", "b"], "left_anti"), sizes, pct), "rest")
    return _merged(labels, materialize(_verified(rest, docs, n, pct), "links"))


def near_duplicates(docs: DataFrame, words: int = NEAR_WORDS, pct: int = NEAR_PCT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: the id, ``n_shingles, component_id``.

    Two documents link if 100 times their sets' intersection is at least ``pct`` times the union; a component is what
    links connect and its id the least in it. A text of fewer words is one shingle; without words, or null, it has
    none and links with nothing. Ids are whole numbers; a row without one forms a component of its own (null). Rows
    that repeat an id get the same component. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    named = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    slots = _slots_for(named)
    found = materialize(_sets(named, words, slots), "sets")
    levels = _levels(found, slots, named.rdd.getNumPartitions())
    sized = found.where(F.col("slice").isNull()).select("doc", "size", "h1", "h2")
    whole = sized.where((F.col("size") > 0) & F.col("doc").isNotNull())
    classes = materialize(whole.groupBy("h1", "h2", "size").agg(F.min("doc").alias("rep")), "classes")
    # links join classes; a row's class joins it to the rest
    labels = _linked(named, classes.select(F.col("rep").alias("doc")), words, pct, levels).withColumnRenamed("doc", "rep")
    labelled = classes.join(labels, "rep", "left").select("h1", "h2", F.coalesce("label", "rep").alias("label"))
    keyed = sized.join(labelled, ["h1", "h2"], "left")
    component = F.when((F.col("size") > 0) & F.col("doc").isNotNull(), F.col("label")).otherwise(F.col("doc"))
    return keyed.select(F.col("doc").cast(docs.schema[id_col].dataType).alias(id_col), F.col("size").cast("long").alias("n_shingles"), component.alias("component_id"))


def distinct_documents(docs: DataFrame, words: int = NEAR_WORDS, pct: int = NEAR_PCT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, that with the least id, with all its columns; rows without an id stay."""
    gone = near_duplicates(docs, words, pct, id_col, text_col).where(F.col("component_id") != F.col(id_col)).select(F.col(id_col).alias("__gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["__gone"], "left_anti")
