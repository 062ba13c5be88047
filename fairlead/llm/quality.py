"""Quality rules with host-level verdicts, in DataFrame functions only.

A document breaks the *base* rule if it is too short or repeats itself; it breaks a *soft* rule if it has many
symbols or many repeated lines. Failures are counted by host, each host's rate is shrunk by a beta prior fitted
to all hosts, and a host whose shrunk rate is high for any rule is condemned. The host's verdict goes back to its
documents as the limit that the soft rules use: strict in a condemned host, lenient elsewhere. A document that
breaks no rule is kept whatever its host.

The table of :func:`quality_rules` has those limits, as its SQL fixes them. :func:`kept_documents` is stricter: a host
that isn't condemned has the ordinary limits, less as far as its shrunk rate is above that of all documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairlead.llm.common import let, materialize, row_key

WORD_GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"

#: A document fails the base rule with fewer words, or with a larger percentage of its words in repeated windows.
MIN_WORDS, MAX_REPEAT_PCT, WINDOW = 10, 20, 5
#: Percentages for the soft rules: symbols of words, repeated lines of lines with a word.
STRICT = {"symbols": 10, "dup_lines": 30}
LENIENT = {"symbols": 100, "dup_lines": 50}
#: For filtering: limits of a host that fails no more often than all documents do.
ORDINARY = {"symbols": 30, "dup_lines": 50}
#: A host is condemned if the shrunk rate of any rule's failures is above this.
HOST_LIMIT = 0.5
#: Bounds of the prior's strength, in documents. The lower one keeps a host of a few documents from being condemned by
#: them where hosts differ so much that the fitted prior has next to no strength.
PRIOR_MIN, PRIOR_MAX = 10.0, 1000.0
RULES = ("base", "symbols", "dup_lines")


def repeated_words(words: Column, n: int = WINDOW) -> Column:
    """Words inside ``n``-word windows that occur twice or more in the array; windows are compared by a 64-bit hash."""

    def covered(at: Column) -> Column:
        """Positions covered by windows that start at the sorted positions ``at``."""
        new = F.transform(at, lambda x, k: F.least(F.lit(n), x - F.coalesce(F.get(at, k - 1), F.lit(-n))))
        return F.aggregate(new, F.lit(0), lambda a, x: a + x)

    def starts(windows: Column) -> Column:
        pairs = F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = let(
            pairs,
            lambda s: F.filter(
                s, lambda e, j: F.coalesce((F.get(s, j - 1).h == e.h) | (F.get(s, j + 1).h == e.h), F.get(s, j - 1).h == e.h, F.get(s, j + 1).h == e.h, F.lit(False))
            ),
        )
        return F.sort_array(F.transform(twice, lambda e: e.i))

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(n)]))
    some = let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(starts(h), covered)))
    return F.when(F.size(words) <= n, F.lit(0)).otherwise(some)


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """``doc, host`` and the counts of each whole text (see :func:`quality_rules`)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    of_words = let(
        F.array_remove(F.split(text, WORD_GAP), ""),
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated_words(w).cast("long").alias("n_repeat_words")),
    )
    of_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return docs.select(
        F.col(id_col).alias("doc"),
        F.col(host_col).alias("host"),
        (F.char_length(text) - F.char_length(F.regexp_replace(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        of_words.alias("w"),
        of_lines.alias("l"),
    ).select("doc", "host", "w.*", "n_symbols", "l.*")


def _failures(limits: dict[str, int | Column]) -> dict[str, Column]:
    return {
        "base": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words")),
        "symbols": 100 * F.col("n_symbols") > F.col("n_words") * limits["symbols"],
        "dup_lines": 100 * F.col("n_dup_lines") > F.col("n_lines") * limits["dup_lines"],
    }


def host_verdicts(measured: DataFrame) -> DataFrame:
    """``host, n_docs, host_rate, host_condemned, limit_symbols, limit_dup_lines``: one row a host; the rate is the
    largest of the rules'. A limit is the ordinary one times the rule's rate over all documents by the host's shrunk
    rate, in whole percent, from the strict one to the ordinary one; the strict one in a condemned host.

    The prior of each rule is a beta distribution whose mean is the rate over all documents and whose strength
    follows from the spread of the hosts' rates (method of moments).
    """
    fails = _failures(STRICT)
    hosts = materialize(measured.groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), *[F.sum(fails[r].cast("long")).alias(f"f_{r}") for r in RULES]), "hosts")
    total = hosts.agg(F.sum("n_docs").alias("n"), *[F.sum(f"f_{r}").alias(r) for r in RULES]).first()  # three counts
    if not total.n:
        return hosts.select("host", "n_docs", F.lit(0.0).alias("host_rate"), F.lit(False).alias("host_condemned"), *[F.lit(ORDINARY[r]).alias(f"limit_{r}") for r in STRICT])
    mean = {r: total[r] / total.n for r in RULES}
    spread = hosts.agg(*[F.avg(F.pow(F.col(f"f_{r}") / F.col("n_docs") - F.lit(mean[r]), F.lit(2.0))).alias(r) for r in RULES]).first()  # three numbers
    strength = {r: min(max(mean[r] * (1 - mean[r]) / spread[r] - 1, PRIOR_MIN), PRIOR_MAX) if spread[r] > 0 else PRIOR_MAX for r in RULES}
    shrunk = {r: (F.col(f"f_{r}") + F.lit(mean[r] * strength[r])) / (F.col("n_docs") + F.lit(strength[r])) for r in RULES}
    rate = F.greatest(*shrunk.values())
    # a rule that no document breaks has no rate to compare with
    moved = {r: F.round(F.lit(ORDINARY[r] * mean[r]) / shrunk[r]).cast("int") if mean[r] else F.lit(ORDINARY[r]) for r in STRICT}
    limits = [F.when(rate > HOST_LIMIT, STRICT[r]).otherwise(F.least(F.greatest(moved[r], F.lit(STRICT[r])), F.lit(ORDINARY[r]))).alias(f"limit_{r}") for r in STRICT]
    return hosts.select("host", "n_docs", rate.alias("host_rate"), (rate > HOST_LIMIT).alias("host_condemned"), *limits)


def _judged(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """The measures of each row, with ``base_failed, kept`` and its host's verdict."""
    m = materialize(measures(docs, id_col, text_col, host_col), "quality")
    v = host_verdicts(m).withColumnRenamed("host", "v_host")
    strict, lenient = _failures(STRICT), _failures(LENIENT)
    soft = lambda f: f["symbols"] | f["dup_lines"]
    judged = m.join(v.drop("n_docs"), m.host.eqNullSafe(v.v_host), "left").withColumn("base_failed", strict["base"])
    return judged.withColumn("kept", ~F.col("base_failed") & ~soft(lenient) & ~(F.col("host_condemned") & soft(strict)))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row a document: the id, ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    host_condemned``.

    Null text counts as empty: no words, so the base rule fails. Documents without a host form one host. Each of
    several equal rows gets its own row. An empty table gives an empty result. The texts are read once: their
    counts, a few numbers a document, are written to the shared folder for the two passes that follow.
    """
    judged = _judged(docs, id_col, text_col, host_col)
    return judged.select(F.col("doc").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_condemned")


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The documents that pass, with all their columns; each row by its own text and host, whatever its id.

    What :func:`quality_rules` doesn't keep goes, and what breaks its host's limits (see :func:`host_verdicts`).
    """
    moved = _failures({r: F.col(f"limit_{r}") for r in STRICT})
    passed = F.col("kept") & ~moved["symbols"] & ~moved["dup_lines"]
    keyed = docs.withColumn("__row", row_key(id_col, host_col, text=text_col))
    failed = _judged(keyed, "__row", text_col, host_col).where(~passed).select(F.col("doc").alias("__failed")).distinct()
    return keyed.join(failed, F.col("__row") == F.col("__failed"), "left_anti").drop("__row")
