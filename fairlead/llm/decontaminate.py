"""Benchmark decontamination by winnowing, in DataFrame functions only.

Words are hashed in k-grams; of each run of ``w`` k-grams the smallest hash is kept, for documents and benchmark
alike, so that any shared run of ``k + w - 1`` words shares a kept hash (Schleimer, Wilkerson and Aiken, 2003).
Kept hashes are joined, and each meeting is extended to the windows around it, which are compared by a hash of
their own. With k = 5 and w = 6 the guarantee covers the 10-word windows that count as contamination. Items shorter
than a window are one window each; they are found by the hash of all their words at every position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairlead.llm.common import ascii_lower, let, row_key

#: What is not a word: ASCII other than digits and letters. RAW_GAP is for text that is not lower-cased yet.
GAP, RAW_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Words in a k-gram, k-grams in a winnowing run, words in a window.
K, W = 5, 6
WINDOW = K + W - 1
#: A kept k-gram is one long: the upper bits are the hash that is compared, the lower ones its position. A string
#: has under 2**31 bytes, so under 2**30 words.
POSITION_BITS = 30
POSITION = (1 << POSITION_BITS) - 1


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAP), "")


def _fingerprints(words: Column) -> Column:
    """Array of ``hash, at, first, near``: the kept k-grams; ``near`` holds the k-gram hashes from position ``first``
    that the windows around it need."""

    def kept(h: Column) -> Column:
        tagged = F.transform(h, lambda x, i: x.bitwiseAND(F.lit(~POSITION)).bitwiseOR(i.cast("long")))
        smallest = let(tagged, lambda t: F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(t) - W), lambda i: F.least(*[F.get(t, i + j) for j in range(W)]))))

        def row(x: Column) -> Column:
            at = x.bitwiseAND(F.lit(POSITION)).cast("int")
            first = F.greatest(at - K, F.lit(0))
            return F.struct(F.shiftright(x, POSITION_BITS).alias("hash"), at.alias("at"), first.alias("first"), F.slice(h, first + 1, 2 * K + 1 - (K - (at - first))).alias("near"))

        return F.transform(smallest, row)

    grams = F.transform(F.sequence(F.lit(0), F.size(words) - K), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(K)]))
    none = F.array().cast("array<struct<hash:bigint,at:int,first:int,near:array<bigint>>>")
    return F.when(F.size(words) < WINDOW, none).otherwise(let(grams, kept))


def _window_hash(near: Column, i: Column) -> Column:
    """Of the window whose first k-gram is ``near[i]``; null outside the text."""
    a, b = F.get(near, i), F.get(near, i + K)
    return F.when(a.isNotNull() & b.isNotNull(), F.xxhash64(a, b))


def _exploded(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), F.explode(let(words_of(F.col(text_col)), _fingerprints)).alias("f")).select("id", "f.*")


def _long_hits(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_col: str, item_text: str) -> DataFrame:
    """``doc, item, start, stop`` for windows of full length."""
    around = F.filter(
        F.transform(F.sequence(F.lit(-(W - 1)), F.lit(0)), lambda d: F.struct(d.alias("d"), F.when(F.col("at") + d >= 0, _window_hash(F.col("near"), F.col("at") + d - F.col("first"))).alias("h"))),
        lambda e: e.h.isNotNull(),
    )
    bench = _exploded(items, item_col, item_text).select(F.col("id").alias("item"), F.col("hash").alias("item_hash"), around.alias("windows")).distinct()
    found = _exploded(docs, id_col, text_col).join(bench, F.col("hash") == F.col("item_hash"))
    same = F.filter("windows", lambda e: (F.col("at") + e.d >= 0) & (_window_hash(F.col("near"), F.col("at") + e.d - F.col("first")) == e.h))
    return found.select("id", "item", F.explode(F.transform(same, lambda e: F.col("at") + e.d)).alias("start")).select(F.col("id").alias("doc"), "item", "start", (F.col("start") + WINDOW).alias("stop"))


def _short_hits(docs: DataFrame, items: DataFrame, lengths: list[int], id_col: str, text_col: str, item_col: str, item_text: str) -> DataFrame:
    """The same for items of fewer words; ``lengths``: those that occur, under ``WINDOW``."""
    whole = let(words_of(F.col(item_text)), lambda w: F.struct(F.size(w).alias("n"), F.xxhash64(w).alias("h")))
    bench = items.select(F.col(item_col).alias("item"), whole.alias("w")).where(F.col("w.n").between(1, WINDOW - 1)).select("item", F.col("w.n").alias("item_n"), F.col("w.h").alias("item_h"))

    def at_each(w: Column) -> Column:
        none = F.array().cast("array<struct<start:int,n:int,h:bigint>>")
        of = lambda n: F.when(F.size(w) < n, none).otherwise(F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.struct(i.alias("start"), F.lit(n).alias("n"), F.xxhash64(F.slice(w, i + 1, n)).alias("h"))))
        return F.flatten(F.array(*[of(n) for n in lengths]))

    places = docs.select(F.col(id_col).alias("doc"), F.explode(let(words_of(F.col(text_col)), at_each)).alias("p")).select("doc", "p.*")
    return places.join(bench, (F.col("n") == F.col("item_n")) & (F.col("h") == F.col("item_h"))).select("doc", "item", "start", (F.col("start") + F.col("n")).alias("stop"))


def hits(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``doc, item, start, stop``: every place (in words, stop excluded) where a window of an item occurs."""
    found = _long_hits(docs, items, id_col, text_col, item_col, item_text)
    counts = items.select(F.size(words_of(F.col(item_text))).alias("n")).where(F.col("n").between(1, WINDOW - 1)).distinct()
    lengths = sorted(r.n for r in counts.collect())  # WINDOW - 1 rows at most
    return found.unionByName(_short_hits(docs, items, lengths, id_col, text_col, item_col, item_text)) if lengths else found


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row a document: the id, ``n_words, n_hit, n_items, items_sha256, contaminated``.

    Null text has no words, in documents and items; an item without words has no window. An item without an id
    counts as a hit but isn't listed. Rows that repeat an id share the hits of all of them (the same ones, if the
    rows are equal); a row without an id has the hits of its own text. Empty tables give no hits or no rows.
    """
    merged = F.aggregate(
        F.sort_array("spans"),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
        lambda a, s: F.struct((a.n + F.greatest(s.stop - F.greatest(s.start, a.end), F.lit(0))).cast("long").alias("n"), F.greatest(a.end, s.stop).alias("end")),
    )
    without = F.when(F.col(id_col).isNull(), row_key(text=text_col))
    keyed = docs.withColumn("__row", F.struct(F.col(id_col).alias("id"), without.alias("text")))
    by_doc = (
        hits(keyed, items, "__row", text_col, item_col, item_text)
        .groupBy("doc")
        .agg(F.collect_set(F.struct("start", "stop")).alias("spans"), F.collect_set(F.col("item").cast("string")).alias("names"))
        .select("doc", merged.n.alias("hit"), F.size("names").cast("long").alias("of"), F.sha2(F.array_join(F.sort_array("names"), ","), 256).alias("sha"))
    )
    n_words = F.size(F.array_remove(F.split(F.coalesce(F.col(text_col), F.lit("")), RAW_GAP), "")).cast("long")
    counted = keyed.select("__row", F.col(id_col), n_words.alias("n_words"))
    hit = F.coalesce("hit", F.lit(0).cast("long"))
    return counted.join(by_doc, counted["__row"] == by_doc.doc, "left").select(
        id_col, "n_words", hit.alias("n_hit"), F.coalesce("of", F.lit(0).cast("long")).alias("n_items"), F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("items_sha256"), (hit > 0).alias("contaminated")
    )


def clean_documents(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without a hit, with all their columns; each row by its own text, whatever its id."""
    keyed = docs.withColumn("__row", row_key(id_col, text=text_col))
    found = hits(keyed, items, "__row", text_col).select(F.col("doc").alias("__found")).distinct()
    return keyed.join(found, F.col("__row") == F.col("__found"), "left_anti").drop("__row")
