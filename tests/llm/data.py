"""Small documents for the tests: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"
#: Names of output columns, and names that the operators use within.
CLASHES = ["size", "shard", "slot", "virtual_slot", "text_crc32", "score", "spans", "labels", "n_words", "taken", "target", "source_size", "n_lines", "n_deleted", "failures", "items", "_x"]
CLASHES += ["_a", "_b", "_at", "_aside_score", "_aside_spans", "_copy", "_dkey", "_doc", "_end", "_hash", "_items", "_key", "_lane", "_lines", "_lot", "_no", "_offset", "_passes", "_rank"]
CLASHES += ["_record", "_rows", "_shard", "_source", "_spans", "_spans_0", "_start", "_text_hash", "at", "blocks", "copies", "dkey", "doc", "found", "fp", "h1", "kept_text", "lines", "places", "root", "text_hash", "z"]


def sentence(rng, n):
    return " ".join(rng.choice("the of and erin thonat wh bleor ingsh tion ea oned reas nthe ouer".split()) + str(rng.randrange(40)) for _ in range(n))


def rows():
    rng = random.Random(7)
    long = "\n".join(sentence(rng, 12) for _ in range(400))
    shared = "\n".join(sentence(rng, 14) for _ in range(6))
    out = [
        (1, None, "en", "a", None),
        (2, "", None, "a", 0),
        (3, " \t\n ", "en", None, 4),
        (4, long, "en", "b", len(long)),
        (5, long, "en", "b", len(long)),
        (6, "one two three", "en", "c", 13),
        (6, "one two three", "en", "c", 13),
        (None, "a text without an id but with words", "en", "c", 10),
        (None, None, None, None, None),
        (7, "word " * 50, "en", "a", 250),
        (8, sentence(rng, 30) + "\n" + shared + "\n" + sentence(rng, 30), "en", "b", 1),
        (9, sentence(rng, 30) + "\n" + shared + "\n" + sentence(rng, 30), "de", "d", 1),
        (10, "Released under the MIT License. Éä\U0001f600 ### $$$", "fr", "d", 1),
    ]
    return out + [(k, sentence(rng, rng.randrange(5, 120)), "en", f"s{k % 4}", 1) for k in range(11, 60)]


def documents(spark, clash=False):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(rows(), DOCUMENT)
    return docs.select("*", *[F.lit(f"kept {c}").alias(c) for c in CLASHES]) if clash else docs


def empty(spark):
    return spark.createDataFrame([], DOCUMENT)
