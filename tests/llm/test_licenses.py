import math
import random
import re

import pytest

from risklake.llm import licenses
from tests.llm.data import documents, empty


def tokens(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_base_matches_brute_force(spark):
    extra = [(k, t, "en", "z", 1) for k, t in enumerate(["CC BY cc by, apache-license apache license", "The GNU General Public License; gnu general public license", "mit mit license", "cc\nby"], 900)]
    docs = documents(spark, clash=True).select("doc_id", "text", "labels", "score").unionByName(spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("doc_id", "text", "'x' AS labels", "'y' AS score"))
    for r in licenses.scan(docs).collect():
        words = tokens(r["text"])
        hits = [(k, label) for phrase, label in licenses.BASE for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
        assert (r["n_words"], r["n_base"]) == (len(words), len(hits))
        assert (r["first_word"], r["last_word"]) == (min((k for k, _ in hits), default=None), max((k for k, _ in hits), default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in hits})) and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == (r["labels"] != "")


def test_templates_are_found_at_their_place_and_verified(spark):
    filler = [(k, f"plain words number {k} of the text and more", "en", "z", 1) for k in range(60)]
    rows = [
        (100, "x y z. Licensed under the Apache License, Version 2.0 (the rest)", "en", "z", 1),
        (101, "apache the license version under 2 0 licensed", "en", "z", 1),
        (102, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "en", "z", 1),
        (103, "licensed under cc by nc 5 0", "en", "z", 1),
    ]
    docs = spark.createDataFrame(filler + rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.scan(docs).collect()}
    assert got[100] == ("apache,apache-2.0", 1.0)
    assert got[101] == ("", 0.0)
    assert got[102][0] == "mit" and got[102][1] == 1.0
    assert got[103] == ("cc-by", licenses.BASE_SCORE)


def test_common_licences_keep_their_labels(spark):
    notices = {t.label: t.text for t in licenses.TEMPLATES if t.label in ("mit", "gpl-3.0", "bsd", "apache-2.0")}
    rows = [(k, f"own words {k} {notices[label]}" if k % 3 == 0 else f"plain words number {k}", label) for k in range(90) for label in [sorted(notices)[k // 3 % 2]]]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, label string")).collect()}
    assert all(got[k]["label"] in got[k]["labels"].split(",") and got[k]["score"] == 1 for k in range(0, 90, 3))
    assert all(got[k]["labels"] == "" for k in range(90) if k % 3)


def test_a_document_with_four_licences_has_four_labels(spark):
    wanted = ["mit", "bsd", "apache-2.0", "mpl-2.0"]
    apache = "licensed under the apache license version 2 0"
    notices = [apache if label == "apache-2.0" else max((t.text for t in licenses.TEMPLATES if t.label == label), key=len) for label in wanted]
    rows = [(k, f"plain words number {k} {apache if k < 12 else ''}") for k in range(500)] + [(500, " and then more text follows ".join(notices))]
    got = {r["doc_id"]: r["labels"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(wanted) <= set(got[500].split(","))


def brute_labels(rows):
    """Every offset of every template, in plain Python: label and best score of those that reach MIN_SCORE with their key phrases in place."""
    said = {k: tokens(t) for k, t in rows}
    sequences = [[w.decode() for w in licenses.template_words(t.text)] for t in licenses.TEMPLATES]
    every = {w for s in sequences for w in s}
    docs = {w: sum(w in set(words) for words in said.values()) for w in every}
    idf = {w: math.log((len(rows) + 1) / (docs[w] + 1)) + 1e-9 for w in every}
    out = {}
    for k, words in said.items():
        labels = {}
        for t, sequence in zip(licenses.TEMPLATES, sequences, strict=True):
            n, total, slack = len(sequence), sum(idf[w] for w in sequence), max(1, len(sequence) // 10)
            for offset in range(1 - n, len(words)):
                score = sum(idf[w] for q, w in enumerate(sequence) if 0 <= offset + q < len(words) and words[offset + q] == w) / total
                if score < licenses.MIN_SCORE:
                    continue
                placed = True
                for key in t.keys:
                    own = key.split()
                    places = [q for q in range(n) if sequence[q : q + len(own)] == own]
                    stands = [i for i in range(len(words)) if words[i : i + len(own)] == own]
                    placed &= any(abs(i - offset - q) <= slack for i in stands for q in places)
                if placed:
                    labels[t.label] = max(score, labels.get(t.label, 0))
        base = {label for phrase, label in licenses.BASE if f" {phrase} " in f" {' '.join(words)} "}
        out[k] = (",".join(sorted(base | set(labels))), round(max([licenses.BASE_SCORE * bool(base), *labels.values()]), 6))
    return out


@pytest.mark.parametrize("seed", range(2))
def test_labels_match_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = []
    for k in range(60):
        words = [rng.choice("plain words of the license and more text version 2 0 software under".split()) for _ in range(rng.randrange(0, 40))]
        for _ in range(rng.randrange(0, 5)):
            notice = licenses.template_words(rng.choice(licenses.TEMPLATES).text)
            notice = [rng.choice(["x", w.decode()]) if rng.random() < 0.3 else w.decode() for w in notice]
            words += notice[rng.randrange(0, 4) : len(notice) - rng.randrange(0, 4)] + ["then"] * rng.randrange(0, 3)
        rows.append((k, " ".join(words)))
    got = {r["doc_id"]: (r["labels"], round(r["score"], 6)) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_labels(rows) and sum(bool(labels) for labels, _ in got.values()) >= 15


@pytest.mark.parametrize("every", [1, 10, 40])
def test_a_notice_is_labelled_however_many_rows_carry_it(spark, every):
    notice = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
    rows = [(k, f"row {k} text. {notice}." if k % every == 0 else f"row {k} has plain text") for k in range(200)]
    got = {r["doc_id"]: r["labels"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: "bsd" if k % every == 0 else "" for k in range(200)}


def test_a_decoy_does_not_hide_a_notice(spark):
    notice = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
    decoy = "in binary forms with or without modification are permitted provided that the following conditions are met"
    rows = [(1, f"{decoy} and then {notice}"), (2, decoy), (3, f"{notice} {decoy}")] + [(k, f"plain row {k}") for k in range(10, 40)]
    got = {r["doc_id"]: r["labels"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1], got[2], got[3]) == ("bsd", "", "bsd")


def test_empty(spark):
    assert licenses.scan(empty(spark)).count() == 0


def reflowed(rng, text, cut):
    """The text in other lines and behind comment marks, without the last cut of its words."""
    words = text.split()
    words = words[: len(words) - int(cut * len(words))]
    lines, at = [], 0
    while at < len(words):
        n = rng.randrange(4, 14)
        lines.append(rng.choice(["# ", " * ", "// ", ""]) + " ".join(words[at : at + n]))
        at += n
    return "\n".join(lines)


def test_recall_on_cut_and_reflowed_bodies_titles_and_short_lines(spark):
    rng = random.Random(11)
    rows = [(t.label, reflowed(rng, t.text, cut)) for t in licenses.BODIES for cut in (0, 0.1, 0.2, 0.3) for _ in range(3)]
    rows += [(t.label, f"/* {t.text} */\ncode follows here") for t in licenses.short_forms() for _ in range(2)]
    rows += [("", f"plain words number {k} of a text that names no licence") for k in range(300)]
    docs = spark.createDataFrame([(k, f"own words {k} before\n{text}\nand after", label) for k, (label, text) in enumerate(rows)], "doc_id long, text string, label string").repartition(4)
    got = licenses.scan(docs).collect()
    named = [r for r in got if r["label"]]
    assert sum(r["label"] in r["labels"].split(",") for r in named) >= 0.9 * len(named)
    families = {"mit", "apache", "gpl", "cc-by"}
    strange = [(r["label"], r["labels"]) for r in got if not set(filter(None, r["labels"].split(","))) <= {r["label"], *families}]
    assert not strange and all(r["labels"] == "" for r in got if not r["label"])


def test_templates_are_loaded_from_a_table(spark, tmp_path):
    rows = [("house", "all rights to this house text stay with its owner", ["House-Text"])]
    schema = "label string, text string, keys array<string>"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "templates"))
    loaded = licenses.load_templates(spark.read.parquet(str(tmp_path / "templates")))
    docs = spark.createDataFrame([(1, "Note: all rights to this house-text stay with its owner."), (2, "rights stay with the owner"), (3, None)], "doc_id long, text string")
    assert {r["doc_id"]: r["labels"] for r in licenses.scan(docs, loaded).collect()} == {1: "house", 2: "", 3: ""}
    with pytest.raises(ValueError, match="key phrase"):
        licenses.load_templates(spark.createDataFrame([("none", "some words", None)], schema))
