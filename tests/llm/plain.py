"""Plain-Python counterparts and test rows."""

from __future__ import annotations

import random
import re

from pyspark.sql import types as T

LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower_words(text):
    return words((text or "").translate(LOWER))


def shingles(text, size=5):
    w = lower_words(text)
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


#: Documents with columns that operators also use inside, or return.
SCHEMA = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()), ("id", T.StringType()), ("kept", T.StringType()), ("_text", T.LongType()), ("size", T.StringType()))])


def document(doc_id, text, lang="en", source="a"):
    return (doc_id, text, lang, source, None, "x", None, 1, "y")


PROSE = "the quick brown fox jumps over the lazy dog while seven wise owls watch from an old oak tree near a quiet river bank".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(PROSE) + str(r.randrange(40)) for _ in range(n))
