"""Plain Python versions of what the operators compute, and documents with every awkward case."""

import hashlib
import random
import re

AWKWARD = [None, "", " ", "\n\n", "one", "a b c d e f g h i", "É É é", "\t x \x0b y\x0cz\r\n", "z" * 30_000, "word " * 3000, "the same line of text here\nthe same line of text here\nend"]


def documents(spark, texts, **more):
    """Columns that clash with likely internal names come along."""
    rows = [(i, t, ["en", "fr", None][i % 3], f"src{i % 4}" if i % 7 else None, len(t or ""), i, i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, doc long, host long")


def prose(seed, n, words=200, vocabulary=400):
    r = random.Random(seed)
    v = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8))) for _ in range(vocabulary)]
    return [" ".join(r.choice(v) for _ in range(r.randint(20, words))) for _ in range(n)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def ascii_lower(text):
    return (text or "").encode().lower().decode()


def collect(df, key="doc_id"):
    return {r[key]: r.asDict() for r in df.collect()}
