"""Every query of the training-data operators over its whole table: columns, types and, where a contract fixes them,
values.
"""

import hashlib
import zlib

import numpy as np
import pytest
from test_corpus import WORD, brute_components, brute_counts
from test_scans import base_spans

from tremora.llm import classifier, registry
from tremora.llm.statistics import FEATURES
from tremora.session import table

COLUMNS = {
    "op1_fuzzy_passages": {
        "doc_id": "bigint",
        "start": "int",
        "end": "int",
        "home_doc_id": "bigint",
        "home_start": "int",
        "home_end": "int",
        "n_matched": "int",
        "identity": "double"
    },
    "op2_source_mixing": {"doc_id": "bigint", "probability": "double", "kept": "boolean"},
    "op3_secret_scan": {
        "doc_id": "bigint",
        "n_assign": "bigint",
        "n_access": "bigint",
        "n_hex": "bigint",
        "base_sha256": "string",
        "spans": "string"
    },
    "op4_quality_classifier": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op5_sentencepiece": {"doc_id": "bigint", "n_pieces": "bigint", "exact": "boolean", "ids": "array<int>"},
    "op6_quality_rules": {
        "doc_id": "bigint",
        "n_words": "bigint",
        "word_chars": "bigint",
        "n_symbols": "bigint",
        "n_dup_lines": "bigint",
        "n_repeat_words": "bigint",
        "base_failed": "boolean",
        "kept": "boolean"
    },
    "op7_token_binary": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
    "op8_warc_zip": {
        "page_id": "bigint",
        "payload_bytes": "bigint",
        "payload_digest": "string",
        "record_type": "string",
        "refers_to": "bigint"
    },
    "op9_minhash_near_dedup": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op10_jpeg_media": {
        "doc_id": "bigint",
        "n_bytes": "bigint",
        "payload_bytes": "bigint",
        "payload_sha256": "string",
        "tail_crc32": "bigint",
        "media_bytes": "bigint",
        "media_sha256": "string",
        "feature": "string"
    },
}


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r["doc_id"]: r["text"] for r in table(spark, sf, "documents").select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(name, spark, sf, texts):
    frame = registry.queries()[name](spark, sf)
    types = dict(frame.dtypes)
    assert COLUMNS[name].items() <= types.items()
    rows = frame.collect()
    if name == "op8_warc_zip":
        assert len(rows) == table(spark, sf, "pages").count()
        return
    assert {r["doc_id"] for r in rows} <= set(texts)
    if name != "op1_fuzzy_passages":
        assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    check = CHECKS.get(name)
    if check:
        check({r["doc_id"]: r for r in rows}, texts)


def spans(rows, texts):
    for k, r in rows.items():
        base = base_spans(texts[k])
        kinds = [x.split(":")[0] for x in base.split(",") if x]
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(kinds.count(x) for x in ("assign", "access", "hex"))


def held(rows, texts):
    for k, r in rows.items():
        assert r["held_out"] == (
            zlib.crc32(str(k).encode()) % 4 == 2
        ) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7)


def exact(rows, texts):
    assert all(r["exact"] for r in rows.values())


def rules(rows, texts):
    for k, r in rows.items():
        n, *rest, repeat = brute_counts(texts[k])
        failed = n < 50 or 100 * repeat > 50 * n
        assert (
            r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]
        ) == (n, *rest, repeat, failed)
        assert not (failed and r["kept"])


def starts(rows, texts):
    at = 0
    for k in sorted(rows):
        assert rows[k]["start"] == at
        at += rows[k]["n_tokens"]


def components(rows, texts):
    assert {
        k: (r["n_shingles"], r["component_id"], r["kept"]) for k, r in rows.items()
    } == brute_components(list(texts.items()))


CHECKS = {
    "op3_secret_scan": spans,
    "op4_quality_classifier": held,
    "op5_sentencepiece": exact,
    "op6_quality_rules": rules,
    "op7_token_binary": starts,
    "op9_minhash_near_dedup": components
}


# -- the classifier against a plain solve


def plain_statistics(text):
    """The statistics of a text, counted one by one."""
    words = WORD.findall(text)
    n, _, symbols, dup, repeat = brute_counts(text)
    if not words:
        return [0.0] * len(FEATURES)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    letters = max(sum(c.isascii() and c.isalpha() for c in text), 1)
    share = lambda f: sum(map(f, text)) / len(text)
    signs = set("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
    return [
        np.log1p(n), sum(map(len, words)) / n, symbols / n, dup / max(len(lines), 1), repeat / n, len(set(words)) / n, sum("A" <= c <= "Z" for c in text) / letters, share(lambda c: "0" <= c <= "9"), share(lambda c: c in signs),
        share(lambda c: ord(c) > 127), 1 - sum(map(len, words)) / len(text), np.log1p(n / max(len(lines), 1)), text.count("|") / n, text.count("!") / n, sum(len(w.encode()) <= 3 for w in words) / n, sum(text.count(c) for c in ".?") / n,
    ]


def test_scores_equal_a_plain_solve(spark, sf, texts):
    labels = {
        r["doc_id"]: r["quality"]
        for r in table(spark, sf, "labels").collect() if r["quality"] is not None and r["doc_id"] in texts
    }
    x = {k: np.array(plain_statistics(t or ""), dtype=np.float32).astype(float) for k, t in texts.items()}
    fold = {k: zlib.crc32(str(k).encode()) % 4 for k in texts}
    learn = sorted(k for k in labels if fold[k] in (0, 1))
    check = sorted(k for k in labels if fold[k] == 3)
    rows = np.array([x[k] for k in learn])
    mean, deviation = rows.mean(axis=0), np.maximum(np.where(rows.std(axis=0) == 0, 1.0, rows.std(axis=0)), 1e-6)
    frequencies, phases = classifier._frequencies(
        len(FEATURES), classifier.COSINES, np.sqrt(len(FEATURES)), classifier.SEED
    )

    def cosines(keys):
        z = np.clip((np.array([x[k] for k in keys]) - mean) / deviation, -6, 6)
        return np.hstack([np.sqrt(2 / classifier.COSINES) * np.cos(z @ frequencies + phases), np.ones((len(keys), 1))])

    c, y = cosines(learn), np.array([labels[k] for k in learn], float)
    weights = np.linalg.solve(
        c.T @ c + classifier.RIDGE * len(learn) * np.diag([*[1.0] * classifier.COSINES, 1e-6]), c.T @ y
    )
    bins = np.array([np.floor(max(-1.0, min(2.0, r)) * classifier.BINS + 0.5) for r in cosines(check) @ weights])
    at = np.unique(bins)
    weight, level = np.array([(bins == b).sum() for b in at], float), np.array(
        [np.mean([labels[k] for k, own in zip(check, bins, strict=True) if own == b]) for b in at]
    )
    fit = [
        max(
            min(np.average(level[a : b + 1], weights=weight[a : b + 1]) for b in range(i, len(at)))
            for a in range(i + 1)
        )
        for i in range(len(at))
    ]
    keys = sorted(texts)
    raw = cosines(keys) @ weights
    want = 0.99 * np.interp(raw, at / classifier.BINS, fit) + 0.01 / (1 + np.exp(-4 * (raw - 0.5)))
    got = {
        r["doc_id"]: r["score"]
        for r in classifier.classify(table(spark, sf, "documents"), table(spark, sf, "labels")).collect()
    }
    assert np.allclose([got[k] for k in keys], want, atol=1e-5)
