"""Language identification with bit-sliced Bloom filters.

All languages share one table of slots. A slot is a bitmask with a bit for each language, so the AND of an n-gram's
slots gives every language whose filter holds the n-gram at once; of more than 64 languages, 64 at a time. A text's n-grams are counted by language, each
count is corrected for its filter's false positives, and the largest share decides.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fairlead.llm.common import batches, small_batches

#: Code points in an n-gram; hashes a filter uses; slots of the shared table at least (its bytes are 1 to 8 times its
#: slots), and slots for each n-gram of the fullest filter and hash, so that no filter is filled by more than a quarter.
GRAM, HASHES, SLOTS, SPARE = 4, 2, 1 << 20, 4
#: Documents a language's filter is fitted to at most: those of least hash of their id. Bounds the fit.
TRAIN_DOCS = 1500
#: A language's filter takes an n-gram in at least this share of its training documents, unless another language
#: has it more often by this factor.
MIN_SHARE, DOMINANCE = 0.01, 3.0
#: Languages in a plane of the table: bits of a slot. More languages take more planes.
PLANE = 64
UNKNOWN = "und"

_letters = None


def _codes(text: str):
    """Lower-cased code points; all but letters become single spaces, with a space at both ends; None without letters."""
    import numpy as np

    global _letters
    if _letters is None:
        _letters = np.array([chr(i).isalpha() for i in range(0x110000)], bool)
    x = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters[x]
    if not letter.any():
        return None
    x = np.where(letter, x, 32)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first space of a run
    return np.concatenate([[32, 32], x[keep], [32, 32]]).astype(np.uint64)


def _grams(codes):
    """A 64-bit hash of each n-gram."""
    import numpy as np

    with np.errstate(over="ignore"):
        h = codes[: len(codes) - GRAM + 1].copy()
        for i in range(1, GRAM):
            h = (h << np.uint64(16)) ^ (h >> np.uint64(48)) ^ codes[i : len(codes) - GRAM + 1 + i]
        h *= np.uint64(0x9E3779B97F4A7C15)
        return h ^ (h >> np.uint64(29))


def _slots(hashes, n_slots: int):
    import numpy as np

    mask = np.uint64(n_slots - 1)
    step = hashes >> np.uint64(40) | np.uint64(1)
    return [(hashes + np.uint64(i) * step) & mask for i in range(HASHES)]


class Filters:
    """The fitted filters: sorted ``languages``, the ``table`` of masks and the most frequent language."""

    def __init__(self, languages: list[str], grams: list, common: str | None):
        import numpy as np

        kind = next((k for k, n in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32)) if len(languages) <= n), np.uint64)
        self.languages, self.common = languages, common
        most = max((len(h) for h in grams), default=0)
        self.slots = max(SLOTS, 1 << (HASHES * SPARE * most).bit_length())
        self.table = np.zeros((max(1, -(-len(languages) // PLANE)), self.slots), kind)
        for i, h in enumerate(grams):
            for s in _slots(h, self.slots):
                np.bitwise_or.at(self.table[i // PLANE], s.astype(np.int64), kind(1 << i % PLANE))
        fill = [float(np.mean(self.table[i // PLANE] >> kind(i % PLANE) & kind(1))) for i in range(len(languages))]
        self.false_rate = np.array([f**HASHES for f in fill])

    def held(self, hashes):
        """How many of the n-grams each language's filter holds."""
        import numpy as np

        slots, counts = [s.astype(np.int64) for s in _slots(hashes, self.slots)], []
        for plane in self.table:
            masks = plane[slots[0]]
            for s in slots[1:]:
                masks = masks & plane[s]
            if masks.dtype == np.uint8:
                of_mask = np.bincount(masks, minlength=256)
                counts += [of_mask[np.arange(256) >> i & 1 == 1].sum() for i in range(8)]
            else:
                counts += np.unpackbits(masks.view(np.uint8), bitorder="little").reshape(len(masks), -1).sum(0).tolist()
        return np.array(counts[: len(self.languages)])

    def shares(self, codes):
        """Each language's corrected count of the n-grams."""
        import numpy as np

        h = _grams(codes)
        return np.maximum(0.0, (self.held(h) - len(h) * self.false_rate) / np.maximum(1e-9, 1 - self.false_rate))

    def predict(self, text: str | None) -> tuple[str, float]:
        codes = _codes(text) if text else None
        if codes is None or not self.languages:
            return UNKNOWN, 0.0
        shares = self.shares(codes)
        total = float(shares.sum())
        if total <= 0:
            return self.common, 0.0
        best = int(shares.argmax())  # ties: the first in order of name
        return self.languages[best], float(shares[best]) / total


def held_out(id_col: str = "doc_id"):
    """Documents that nothing is learned from; so are those without an id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5, F.lit(0)) == 0


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = TRAIN_DOCS) -> Filters:
    """Filters from up to ``train_docs`` documents of each language that aren't held out."""
    small_batches(docs.sparkSession)
    labelled = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"))
    all_ = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}  # a row a language
    # of each language a share by hash that leaves enough and not much more, so the window sorts a bounded number
    buckets = 1 << 30
    limit = {k: min(buckets, int((1.5 * train_docs + 50) / n * buckets)) for k, n in all_.items()} or {"": 0}
    spread = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(buckets))
    enough = labelled.withColumn("h", spread).where(F.col("h") <= F.create_map(*[F.lit(x) for kv in limit.items() for x in kv])[F.col("lang")])
    by_hash = Window.partitionBy("lang").orderBy("h", "id")
    chosen = enough.withColumn("n", F.row_number().over(by_hash)).where(F.col("n") <= train_docs).select("id", "lang").distinct()
    sizes = {r["lang"]: r["count"] for r in chosen.groupBy("lang").count().collect()}

    def count(frames: Iterator):
        import numpy as np
        import pyarrow as pa

        for batch in batches(frames):
            of: dict[str, list] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if (codes := _codes(text)) is not None:
                    of.setdefault(lang, []).append(np.unique(_grams(codes)))
            for lang, parts in of.items():
                h, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(h), pa.string()), pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    keyed = docs.select(F.col(id_col).alias("d_id"), F.col(lang_col).alias("d_lang"), F.col(text_col).alias("d_text"))
    few = F.broadcast(chosen) if len(all_) <= PLANE else chosen  # at most PLANE x train_docs rows
    texts = keyed.join(few, (F.col("d_id") == F.col("id")) & (F.col("d_lang") == F.col("lang")), "left_semi")
    grams_of = texts.select("d_lang", "d_text").mapInArrow(count, "lang string, gram long, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n"))
    size_of = F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv]) if sizes else F.create_map(F.lit(""), F.lit(1))
    shares = grams_of.withColumn("share", F.col("n") / size_of[F.col("lang")]).where((F.col("share") >= MIN_SHARE) & (F.col("n") > 1))
    top = shares.groupBy("gram").agg(F.max("share").alias("top"), F.collect_list(F.struct("lang", "share")).alias("all"))
    # each n-gram kept is in a hundredth of a bounded number of documents, so this is bounded too
    rows = top.select("gram", F.transform(F.filter("all", lambda x: x.share * DOMINANCE >= F.col("top")), lambda x: x["lang"]).alias("langs")).toArrow()
    import numpy as np

    languages = sorted(sizes)
    held = rows.column("gram").to_numpy().view(np.uint64)
    grams: list[list] = [[] for _ in languages]
    place = {name: i for i, name in enumerate(languages)}
    for h, of in zip(held, rows.column("langs").to_pylist(), strict=True):
        for name in of:
            grams[place[name]].append(h)
    common = max(languages, key=lambda x: sizes[x]) if languages else None  # ties: the first in order of name
    return Filters(languages, [np.array(g, np.uint64) for g in grams], common)


def identify(docs: DataFrame, filters: Filters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: the id, ``held_out, lang_pred, score``; the score is the winner's share of the corrected
    counts. Null text and text without letters give ``und`` and 0, as does everything if nothing was learned; text
    with letters but no known n-gram gives the most frequent language and 0. Of languages that are equal, in a text's
    counts or in frequency, the first in order of name wins. Equal rows get equal results."""
    small_batches(docs.sparkSession)
    small = docs.sparkSession.sparkContext.broadcast(filters)  # SLOTS masks
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(frames):
        import pyarrow as pa

        for batch in batches(frames):
            found = [small.value.predict(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64())], names=[id_col, "held_out", "lang_pred", "score"])

    return docs.select(id_col, held_out(id_col).alias("held_out"), text_col).mapInArrow(run, f"`{id_col}` {id_type}, held_out boolean, lang_pred string, score double")
