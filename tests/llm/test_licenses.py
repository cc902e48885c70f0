"""License scan against a plain search of words and a recursive parser."""

import random
import re
import time

import pyarrow as pa
import pytest

from tremora.llm import licenses, registry
from tremora.session import table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain_places(text, phrases):
    words = [m[0] for m in WORD.finditer(lowered(text))]
    split = [(p.split(), label) for p, label in phrases]
    return len(words), sorted(
        (i, label) for i in range(len(words)) for p, label in split if words[i : i + len(p)] == p
    )


TEXTS = [
    None, "", " ", "é", "The MIT License (MIT)", "mit-license MIT\nLICENSE mitlicense", "GNU General   Public_License, cc by-sa 4.0, CC BY 4.0",
    "gnu gnu general public license license", "SPDX-License-Identifier: MIT OR (Apache-2.0 AND GPL-2.0-only WITH Classpath-exception-2.0)",
    '{"license": "MIT"}', "license = 'BSD-3-Clause'\nLicense: unknown stuff", "License: MIT and some", "Lizenz: MIT ünder CC BY", "// SPDX-License-Identifier: Foo-1.0 */",
    "permission is hereby granted, free of charge, to any person obtaining a copy", "the of by and " * 500 + "cc by", "mit license " * 300, "all rights reserved. all rights",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(None, "cc by", None), (3, "cc by", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, licenses string")


def test_places_equal_a_plain_search(spark, docs, sf):
    phrases = [(p, label) for label, p in licenses.PHRASES]
    for frame in (docs.select("doc_id", "text"), table(spark, sf, "documents").select("doc_id", "text")):
        for row in licenses.find_licenses(frame).collect():
            n, want = plain_places(row["text"], phrases)
            found = row["licenses"]
            assert found["n_words"] == n
            assert sorted((p["word"], p["label"]) for p in found["places"] if p["kind"] != "tag") == want
            for p in found["places"]:
                assert 0 <= p["start"] < p["end"] <= len(row["text"])
                if p["kind"] != "tag":
                    words = [m[0] for m in WORD.finditer(lowered(row["text"][p["start"] : p["end"]]))]
                    assert " ".join(words) in {q for q, label in phrases if label == p["label"]}


def test_digests_follow_the_contract(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in table(spark, sf, "documents").collect()}
    rows = registry.queries()["op11_license_scan"](spark, sf).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        n, places = plain_places(texts[r["doc_id"]], list(BASE.items()))
        at = [i for i, _ in places]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (
            n, len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))
        )
        labels = r["labels"].split(",") if r["labels"] else []
        assert labels == sorted(set(labels)) and {x for _, x in places} <= set(labels) and 0 <= r["score"] <= 1
        assert (r["score"] > 0) == bool(labels)


def test_tags_and_expressions(docs):
    found = {}
    for row in licenses.find_licenses(docs).where("doc_id is not null").collect():
        tags = [p for p in row["licenses"]["places"] if p["kind"] == "tag"]
        found.setdefault(row["doc_id"], []).extend(tags)
    assert {k: sorted({(p["expression"], p["permissive"]) for p in v}) for k, v in found.items() if v} == {
        8: [("MIT OR (Apache-2.0 AND GPL-2.0-only WITH Classpath-exception-2.0)", 1.0)],
        9: [("MIT", 1.0)],
        10: [("BSD-3-Clause", 1.0)],
        11: [("MIT", 1.0)],
        13: [("Foo-1.0", 0.0)]
    }
    assert {p["label"] for p in found[8]} == {"mit", "apache", "gpl"} and {p["label"] for p in found[13]} == {"other"}
    assert 9 in {r["doc_id"] for r in licenses.licensed(docs, 0.5).collect()}
    assert 13 not in {r["doc_id"] for r in licenses.licensed(docs, 0.5).collect()}


def plain_value(node):
    """Value of a tree: an identifier, ("WITH", id), or (op, left, right)."""
    if isinstance(node, str):
        return licenses.FAMILIES[licenses.family(node)]
    if node[0] == "WITH":
        return max(plain_value(node[1]), 0.5)
    return (min if node[0] == "AND" else max)(plain_value(node[1]), plain_value(node[2]))


def written(node, above=0):
    if isinstance(node, str):
        return node
    if node[0] == "WITH":
        return f"{node[1]} WITH LLVM-exception"
    rank = 2 if node[0] == "AND" else 1
    text = f"{written(node[1], rank)} {node[0]} {written(node[2], rank + 1)}"
    return f"({text})" if rank < above else text


def test_random_expressions_have_the_value_of_their_tree():
    rng = random.Random(3)
    ids = ["MIT", "GPL-2.0-or-later", "LGPL-2.1+", "Apache-2.0", "MPL-2.0", "AGPL-3.0-only", "CC-BY-NC-4.0", "BSL-1.0"]

    def tree(depth):
        if depth == 0 or rng.random() < 0.2:
            return rng.choice(ids) if rng.random() < 0.8 else ("WITH", rng.choice(ids))
        return rng.choice(["AND", "OR"]), tree(depth - 1), tree(depth - 1)

    for _ in range(400):
        node = tree(4)
        text = written(node)
        shown, value, labels = licenses.parse(text + rng.choice(["", " is it", ")", " AND", " OR (", "\n MIT"]))
        assert (shown, value) == (text, plain_value(node)), text
    assert licenses.parse("() MIT") is None and licenses.parse("AND MIT") is None and licenses.parse("") is None
    assert licenses.parse("MIT WITH MIT")[0] == "MIT" and licenses.parse("(MIT) WITH GCC-exception")[0] == "(MIT)"


def test_long_texts_take_linear_time():
    for run in (
        "mit " * 1_000_000, "gnu general public " * 250_000, "license: " * 500_000, "license: (" + "(" * 4_000_000,
        "license: MIT" + " OR MIT" * 500_000, "spdx-license-identifier: a" + "-a" * 2_000_000, "license" + " " * 4_000_000,
        "cc by sa " * 400_000,
    ):
        began = time.process_time()
        licenses.scan_slice(pa.array([run]))
        assert time.process_time() - began < 15, run[:30]


def test_empty_table(docs):
    assert licenses.find_licenses(docs.limit(0)).collect() == []
