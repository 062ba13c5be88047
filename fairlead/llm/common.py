"""What the operators of this subpackage share: Arrow batches, running sums, tokens and hashes.

Conventions that hold for every operator here:

* A document is named by its id column; rows that repeat an id with the same text get the same result.
* A null text counts as empty unless the operator says otherwise.
* Only the named columns are read; other columns, whatever they are called, do not matter.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fairlead.operators.shared import new_folder, release  # noqa: F401  the operators here take them from this module
from fairlead.operators.shared import written as materialize

#: Rows in an Arrow batch. Documents can be long, so a batch is kept well below Spark's default.
BATCH_ROWS = 500
BATCH_BYTES = 16 << 20


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the rows and bytes of an Arrow batch, and so the memory of a Python worker; a row beyond comes alone."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` names it (also inside lambdas)."""
    return F.transform(F.array(value), body)[0]


def row_key(*named: str | Column, text: str) -> Column:
    """What tells a row from others with the same id, or none: the named columns and 128 bits of hashes of the text."""
    return F.struct(*[F.col(c).alias(f"k{i}") if isinstance(c, str) else c.alias(f"k{i}") for i, c in enumerate(named)], F.xxhash64(F.col(text)).alias("t1"), F.xxhash64(F.lit(1), F.col(text)).alias("t2"))


def running(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``df`` with the sum of each of ``sums`` over the rows before, in ``order``. Rows are dealt by ranges of the order
    and added up range by range; only the ranges' own sums meet in one task."""
    dealt = materialize(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy("__range").agg(*[F.sum(c).alias(name) for name, c in sums.items()])
    upto = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(F.col("__range").alias("__r"), *[F.coalesce(F.sum(name).over(upto), F.lit(0)).alias(f"__{name}") for name in sums])
    within = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.join(F.broadcast(starts), F.col("__range") == F.col("__r"))
    return placed.select(*df.columns, *[(F.coalesce(F.sum(c).over(within), F.lit(0)) + F.col(f"__{name}")).alias(name) for name, c in sums.items()])


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; ``lower`` does the same and is faster where all is ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordTokens:
    """Token ids of whole texts for a tokenizer that drops white space, never joins across it and ends each word
    with a token of its own kind (``end_of_word_suffix``).

    Texts are cut into pieces that the tokenizer takes one by one anyway. The pieces of a batch are dictionary
    encoded, each different piece's ids are looked up, and pieces not seen before go through the tokenizer together.
    The ids are those of ``encode(text, add_special_tokens=False)``. About ``limit`` pieces are remembered.
    """

    def __init__(self, path: str, limit: int = 800_000):
        import json

        import numpy as np
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        suffix = json.loads(self.tokenizer.to_str())["model"]["end_of_word_suffix"]
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        self.limit = limit
        self._forget()

    def _forget(self) -> None:
        import numpy as np

        self.at: dict[str, int] = {"": 0}
        self.start = np.zeros(1024, np.int64)
        self.length = np.zeros(1024, np.int64)
        self.flat = np.zeros(4096, np.uint32)
        self.used = 0

    def _add(self, pieces: list[str], ids, cuts) -> None:
        """Pieces with their ids, one after another; piece ``i`` has those from ``cuts[i]`` to ``cuts[i + 1]``."""
        import numpy as np

        k, n, m = len(self.at), len(pieces), len(ids)
        while k + n > len(self.start):
            self.start, self.length = np.resize(self.start, 2 * len(self.start)), np.resize(self.length, 2 * len(self.length))
        while self.used + m > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[self.used : self.used + m] = ids
        self.start[k : k + n], self.length[k : k + n] = self.used + cuts[:-1], np.diff(cuts)
        self.used += m
        self.at.update(zip(pieces, range(k, k + n), strict=True))

    def _learn(self, pieces: list[str]) -> None:
        import numpy as np

        def one_by_one(some: list[str]) -> None:
            found = [e.ids for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
            cuts = np.cumsum([0, *map(len, found)])
            self._add(some, np.fromiter((i for e in found for i in e), np.uint32, cuts[-1]), cuts)

        # Letters only: one word each, so the ids of many at once fall apart at the word ends.
        words = [p for p in pieces if p.isalpha()]
        for i in range(0, len(words), 500):
            some = words[i : i + 500]
            ids = np.array(self.tokenizer.encode(" ".join(some), add_special_tokens=False).ids, np.uint32)
            cuts = np.concatenate([[0], np.flatnonzero(self.ends[ids]) + 1])
            if len(cuts) == len(some) + 1:
                self._add(some, ids, cuts)
            else:
                one_by_one(some)
        others = [p for p in pieces if not p.isalpha()]
        for i in range(0, len(others), 5000):
            one_by_one(others[i : i + 5000])

    @staticmethod
    def spaced(text: str) -> str | None:
        """The text with white space around each piece, or None where only the tokenizer itself can tell.

        Where all but white space, commas and full stops is letters and digits, and no comma or stop follows
        white space or another one, each comma or stop is a pre-token of its own and case is dropped. That is asked of
        the lower-cased text, as the tokenizer splits that.
        """
        # lower-cased first: a letter may become a letter and a mark, and a mark joins the comma or stop behind it
        lower = text.lower()
        raw = lower.encode("utf-8", "surrogatepass")
        letters = raw.translate(None, b" \n,.")
        if text.isascii():
            plain = letters.isalnum()
        else:  # the final sigma depends on what follows
            plain = letters.decode("utf-8", "surrogatepass").isalnum() and "\u03a3" not in text and unicodedata.is_normalized("NFC", text)
        if plain and text[0] not in ",.":
            kinds = raw.translate(_KINDS)
            if b" ," not in kinds and b",," not in kinds:
                return lower.replace(",", " , ").replace(".", " . ").replace("\n", " ")
        if _ODD_SPACE.search(text):
            return None
        return " ".join(text.split())

    def encode(self, texts: list[str | None]):
        """``ids, offsets``: the ids of all texts, one after another, as unsigned 32-bit integers, and where each
        text begins and the last ends."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        if len(self.at) > self.limit:
            self._forget()
        apart = {}
        spaced = [self.spaced(t) if t else "" for t in texts]
        for i, t in enumerate(spaced):
            if t is None:
                apart[i] = np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, np.uint32)
        split = pc.split_pattern(pa.array([t or "" for t in spaced], pa.large_string()), " ")
        coded = split.values.dictionary_encode()
        pieces, at = coded.dictionary.to_pylist(), self.at
        place = list(map(at.get, pieces))
        if None in place:
            self._learn([p for p, k in zip(pieces, place, strict=True) if k is None])
            place = list(map(at.get, pieces))
        which = np.array(place, np.int32)[coded.indices.to_numpy()]
        lengths, starts = self.length[which], self.start[which]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        at_ids = np.repeat((starts - ends[:-1]).astype(np.int32), lengths)  # fewer than 2**31 ids are remembered
        at_ids += np.arange(ends[-1], dtype=np.int32)
        ids = self.flat[at_ids]
        offsets = ends[split.offsets.to_numpy()]
        if apart:
            parts = [apart.get(i, ids[offsets[i] : offsets[i + 1]]) for i in range(len(texts))]
            ids = np.concatenate(parts)
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return ids, offsets


#: White space as a blank, commas and stops as a comma, all else as a letter.
_KINDS = bytes(32 if c in b" \n" else 44 if c in b",." else 97 for c in range(256))
#: What ``str.split`` takes for white space and the tokenizer doesn't.
_ODD_SPACE = re.compile("[\x1c-\x1f]")

_tokens: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    """One for each Python worker; workers serve many tasks."""
    if path not in _tokens:
        _tokens[path] = WordTokens(path)
    return _tokens[path]


def batches(frames: Iterator) -> Iterator:
    """Arrow batches that have rows."""
    return (b for b in frames if b.num_rows)
