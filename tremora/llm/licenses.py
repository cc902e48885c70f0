"""License scan: names, notices and identifier tags found by one automaton, expressions read and evaluated.

A word automaton (Aho-Corasick) holds all phrases. The words of a slice are looked up in its vocabulary at once; only
runs of vocabulary words are walked, all runs of a slice in lockstep, and long runs are cut into pieces that overlap
by the longest phrase, so a text costs the same per word whatever it says. Behind an identifier tag
(``SPDX-License-Identifier:`` and the fields of package files) a shunting-yard parser reads the longest whole
expression of identifiers, ``AND``, ``OR``, ``WITH``, ``+`` and parentheses, and evaluates it: ``OR`` leaves the
choice of the more permissive side, ``AND`` binds to the less permissive one, an exception lifts a copyleft licence to
a weak one.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A to Z lower-cased. Defined results: a null or
empty text has no words and no places. Places may overlap ("cc by" stands in "cc by sa"). A tag without a readable
expression gives nothing. Matching is per row, so repeated rows get equal results, and other columns pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremora.llm.textscan import LOWER, Words, array_slices, code_point_ranks, text_buffers

# Phrases by label. The first four are the base phrases.
PHRASES = (
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
    ("agpl", "gnu affero general public license"),
    ("lgpl", "gnu lesser general public license"),
    ("lgpl", "gnu library general public license"),
    ("mpl", "mozilla public license"),
    ("epl", "eclipse public license"),
    ("isc", "isc license"),
    ("bsd", "bsd license"),
    ("bsl", "boost software license"),
    ("artistic", "artistic license"),
    ("zlib", "zlib license"),
    ("cc-by-sa", "cc by sa"),
    ("cc-by-nc", "cc by nc"),
    ("cc-by-nd", "cc by nd"),
    ("cc-by", "creative commons attribution"),
    ("cc-by-sa", "creative commons attribution sharealike"),
    ("cc-by-nc", "creative commons attribution noncommercial"),
    ("cc0", "cc0 1 0 universal"),
    ("proprietary", "all rights reserved"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose"),
    ("apache", "licensed under the apache license version 2 0"),
    ("gpl", "under the terms of the gnu general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license"),
    ("agpl", "under the terms of the gnu affero general public license"),
    ("mpl", "subject to the terms of the mozilla public license"),
    ("unlicense", "free and unencumbered software released into the public domain"),
)
BASE = 4
#: Words that stand before an expression, if a colon or an equals sign follows.
TAGS = ("spdx license identifier", "license expression", "license", "licence", "licenses")
# Families of identifiers and how permissive each is.
FAMILIES = {
    "mit": 1.0, "bsd": 1.0, "0bsd": 1.0, "isc": 1.0, "apache": 1.0, "zlib": 1.0, "bsl": 1.0, "unlicense": 1.0,
    "cc0": 1.0, "cc-by": 0.9, "artistic": 0.8, "mpl": 0.5, "epl": 0.5, "lgpl": 0.5, "cc-by-sa": 0.5, "cc-by-nd": 0.2,
    "gpl": 0.2, "agpl": 0.1, "cc-by-nc": 0.1, "proprietary": 0.0,
}
#: What an exception lifts a copyleft licence to, and what an identifier of no known family is worth.
LIFTED, OTHER = 0.5, 0.0
#: Shares of belief that a phrase of a few words, a longer notice and a tag are a licence statement.
NAME, NOTICE, TAG = 0.6, 0.9, 0.95
RESERVED = 0.3
NOTICE_WORDS = 6
#: Words of a run that are walked as one piece.
PIECE = 64

OUTSIDE = np.ones(256, dtype=bool)
OUTSIDE[0x30:0x3A] = OUTSIDE[0x41:0x5B] = OUTSIDE[0x61:0x7B] = OUTSIDE[0x80:] = False

PLACES = T.ArrayType(
    T.StructType(
        [
            T.StructField("kind", T.StringType()),
            T.StructField("label", T.StringType()),
            T.StructField("word", T.LongType()),
            T.StructField("start", T.IntegerType()),
            T.StructField("end", T.IntegerType()),
            T.StructField("expression", T.StringType()),
            T.StructField("permissive", T.DoubleType())
        ]
    )
)
FOUND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("places", PLACES)])
_ARROW = pa.struct(
    [
        ("kind", pa.string()),
        ("label", pa.string()),
        ("word", pa.int64()),
        ("start", pa.int32()),
        ("end", pa.int32()),
        ("expression", pa.string()),
        ("permissive", pa.float64())
    ]
)


class Phrases:
    """An Aho-Corasick automaton over words. States are numbered by breadth; failure links are folded into ``step``,
    ``more`` leads from a state to the next shorter suffix that ends a phrase.
    """

    def __init__(self, phrases: list[str]):
        split = [p.split() for p in phrases]
        self.words = sorted({w for p in split for w in p})
        self.longest = max(map(len, split))
        number = {w: i for i, w in enumerate(self.words)}
        children: list[dict[int, int]] = [{}]
        ends: dict[int, int] = {}
        for k, words in enumerate(split):
            state = 0
            for w in words:
                if number[w] not in children[state]:
                    children[state][number[w]] = len(children)
                    children.append({})
                state = children[state][number[w]]
            ends[state] = k
        n = len(children)
        self.size = np.array([len(p) for p in split])
        self.phrase = np.array([ends.get(s, -1) for s in range(n)])
        self.more = np.zeros(n, dtype=np.int64)
        self.step = np.zeros((n, len(self.words)), dtype=np.int64)
        fail, level = [0] * n, [0]
        while level:
            below = []
            for state in level:
                if state:
                    self.step[state] = self.step[fail[state]]
                for w, child in children[state].items():
                    fail[child] = int(self.step[fail[state], w]) if state else 0
                    self.more[child] = fail[child] if self.phrase[fail[child]] >= 0 else self.more[fail[child]]
                    self.step[state, w] = child
                    below.append(child)
            level = below
        width = max(map(len, self.words))
        self.letters = np.zeros((len(self.words), width), dtype=np.uint8)
        for i, w in enumerate(self.words):
            self.letters[i, : len(w)] = np.frombuffer(w.encode(), dtype=np.uint8)
        # of each size, the words as byte strings in order
        self.by_size = {
            size: (np.array([w.encode() for w in group]), np.array([number[w] for w in group]))
            for size in sorted({len(w) for w in self.words})
            if (group := [w for w in self.words if len(w) == size])
        }

    def numbers(self, lower: np.ndarray, words: Words) -> np.ndarray:
        """The vocabulary number of each word, -1 for others. Bytes are compared, so it is exact."""
        found = np.full(len(words.start), -1, dtype=np.int64)
        sizes = words.end - words.start
        for size, (known, number) in self.by_size.items():
            at = np.flatnonzero(sizes == size)
            if len(at):
                own = np.ascontiguousarray(lower[words.start[at][:, None] + np.arange(size)]).view(f"S{size}")[:, 0]
                place = np.minimum(np.searchsorted(known, own), len(known) - 1)
                same = known[place] == own
                found[at[same]] = number[place[same]]
        return found

    def places(self, numbers: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, last word) of every occurrence of every phrase among the words."""
        known = numbers >= 0
        joined = np.zeros(len(numbers), dtype=bool)
        joined[1:] = known[1:] & known[:-1] & (doc[1:] == doc[:-1])
        first = np.flatnonzero(known & ~joined)
        after = np.append(np.flatnonzero(~joined), len(numbers))
        last = after[np.searchsorted(after, first, side="right")]
        pieces = -(-(last - first) // PIECE)
        nth = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        own = np.repeat(first, pieces) + nth * PIECE  # the first word that a piece answers for
        end = np.minimum(np.repeat(last, pieces), own + PIECE)
        at = np.maximum(np.repeat(first, pieces), own - self.longest + 1)
        state = np.zeros(len(own), dtype=np.int64)
        phrases, ends = [], []
        while len(at):
            state = self.step[state, numbers[at]]
            hit = np.flatnonzero((at >= own) & ((self.phrase[state] >= 0) | (self.more[state] > 0)))
            node, word = state[hit], at[hit]
            node = np.where(self.phrase[node] >= 0, node, self.more[node])
            while len(node):
                phrases.append(self.phrase[node])
                ends.append(word)
                node = self.more[node]
                node, word = node[node > 0], word[node > 0]
            at = at + 1
            going = at < end
            at, own, end, state = at[going], own[going], end[going], state[going]
        if not phrases:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        return np.concatenate(phrases), np.concatenate(ends)


AUTOMATON = Phrases([p for _, p in PHRASES] + list(TAGS))

_SIGN = re.compile(rb"""["']?[ \t]{0,8}[:=][ \t]{0,8}["']?""")
_TOKEN = re.compile(rb"[ \t]*(?:[()]|[A-Za-z0-9]+(?:[.-]+[A-Za-z0-9]+)*\+?)")
_VARIANT = re.compile(r"(-?v?[0-9][0-9a-z.]*)?(-[a-z0-9.]+)*\+?")
_FAMILY_ORDER = sorted(FAMILIES, key=len, reverse=True)
_RANK = {"OR": 1, "AND": 2, "WITH": 3}


def family(identifier: str) -> str | None:
    """The family that an identifier belongs to: its longest beginning that is one; "other" for own references."""
    name = identifier.lower()
    if name.startswith("licenseref-"):
        return "other"
    return next(
        (f for f in _FAMILY_ORDER if name.startswith(f) and _VARIANT.fullmatch(name, len(f))), None
    )


def _tokens(raw: bytes, at: int, end: int) -> Iterator[tuple[str, int]]:
    """Tokens of an expression with the positions behind them."""
    while match := _TOKEN.match(raw, at, end):
        at = match.end()
        yield match[0].strip().decode(), at


def to_postfix(tokens: Iterator[tuple[str, int]], strict: bool = True) -> tuple[list[str], list[str], int] | None:
    """(postfix order, tokens, end) of the longest beginning that is a whole expression, by a shunting yard; None if
    there is none. With ``strict``, operands must be of a known family.
    """
    out: list[str] = []
    held: list[str] = []
    seen: list[str] = []
    depth, operand, exception = 0, True, False  # whether an operand is due, and whether it is an exception
    best: tuple[int, int, int, list[str]] | None = None
    for token, end in tokens:
        name = token.upper()
        if operand:
            if token == "(" and not exception:
                held.append(token)
                depth += 1
                seen.append(token)
                continue
            if token in "()" or name in _RANK:
                break
            if exception:
                if "exception" not in token.lower():
                    break
            elif strict and family(token) is None:
                break
            out.append(token)
            seen.append(token)
            operand = exception = False
        elif token == ")":
            if not depth:
                break
            while held[-1] != "(":
                out.append(held.pop())
            held.pop()
            depth -= 1
            seen.append(token)
        elif name in _RANK:
            if name == "WITH" and seen[-1] == ")":
                break
            while held and held[-1] != "(" and _RANK[held[-1]] >= _RANK[name]:
                out.append(held.pop())
            held.append(name)
            seen.append(name)
            operand, exception = True, name == "WITH"
            continue
        else:
            break
        if not depth:
            best = len(out), len(seen), end, held[:]
    if best is None:
        return None
    n, shown, end, left = best
    return out[:n] + left[::-1], seen[:shown], end


def evaluate(postfix: list[str]) -> tuple[float, frozenset[str]]:
    """(how permissive, labels) of an expression in postfix order."""
    stack: list[tuple[float, frozenset[str]]] = []
    for token in postfix:
        if token == "WITH":
            stack.pop()
            value, labels = stack.pop()
            stack.append((max(value, LIFTED), labels))
        elif token in _RANK:
            (b, more), (a, labels) = stack.pop(), stack.pop()
            stack.append((min(a, b) if token == "AND" else max(a, b), labels | more))
        else:
            own = family(token) or "other"
            stack.append((FAMILIES.get(own, OTHER), frozenset((own,))))
    return stack[0]


def parse(text: str, strict: bool = True) -> tuple[str, float, frozenset[str]] | None:
    """(expression in one form of writing, how permissive, labels) of what a text begins with."""
    raw = text.encode()
    read = to_postfix(_tokens(raw, 0, len(raw)), strict)
    if read is None:
        return None
    return (_shown(read[1]), *evaluate(read[0]))


def _shown(tokens: list[str]) -> str:
    return " ".join(tokens).replace("( ", "(").replace(" )", ")")


def _expressions(raw: bytes, tag: int, at: int, end: int) -> tuple[str, float, frozenset[str], int] | None:
    """What stands behind a tag that ends at ``at``."""
    sign = _SIGN.match(raw, at, end)
    if not sign:
        return None
    read = to_postfix(_tokens(raw, sign.end(), end), strict=tag > 0)
    if read is None:
        return None
    return (_shown(read[1]), *evaluate(read[0]), read[2])


def scan_slice(column: pa.Array) -> pa.Array:
    """Number of words and places of every text of a slice, places by word, then kind and label."""
    data, offsets = text_buffers(column)
    lower = LOWER[data]
    words = Words(data, offsets, hashes=False, outside=OUTSIDE)
    phrase, last = AUTOMATON.places(AUTOMATON.numbers(lower, words), words.doc)
    first = last - AUTOMATON.size[phrase] + 1
    found: list[tuple] = []
    named = phrase < len(PHRASES)
    for k, a, b in zip(phrase[named].tolist(), first[named].tolist(), last[named].tolist(), strict=True):
        kind = "base" if k < BASE else "name" if AUTOMATON.size[k] < NOTICE_WORDS else "notice"
        found.append((a, kind, PHRASES[k][0], int(words.start[a]), int(words.end[b]), None, None))
    raw = data.tobytes()
    # of tags that end at one word, the longest
    longest: dict[int, tuple[int, int]] = {}
    for k, a, b in zip(phrase[~named].tolist(), first[~named].tolist(), last[~named].tolist(), strict=True):
        if b not in longest or a < longest[b][0]:
            longest[b] = a, k - len(PHRASES)
    for b, (a, k) in longest.items():
        if read := _expressions(raw, k, int(words.end[b]), int(offsets[words.doc[b] + 1])):
            shown, value, labels, stop = read
            found += [(a, "tag", label, int(words.start[a]), stop, shown, value) for label in labels]
    found.sort(key=lambda x: x[:5])
    at = np.array([x[0] for x in found], dtype=np.int64)
    doc = words.doc[at]
    ranks = code_point_ranks(data)
    base = ranks[offsets[doc]]
    places = pa.StructArray.from_arrays(
        [
            pa.array([x[1] for x in found], pa.string()),
            pa.array([x[2] for x in found], pa.string()),
            pa.array(at - words.first[doc], pa.int64()),
            pa.array(ranks[np.array([x[3] for x in found], dtype=np.int64)] - base, pa.int32()),
            pa.array(ranks[np.array([x[4] for x in found], dtype=np.int64)] - base, pa.int32()),
            pa.array([x[5] for x in found], pa.string()),
            pa.array([x[6] for x in found], pa.float64())
        ],
        fields=list(_ARROW),
    )
    counts = np.zeros(len(column) + 1, dtype=np.int32)
    np.cumsum(np.bincount(doc, minlength=len(column)), out=counts[1:])
    return pa.StructArray.from_arrays(
        [pa.array(words.count, pa.int64()), pa.ListArray.from_arrays(pa.array(counts), places)],
        names=["n_words", "places"]
    )


@F.arrow_udf(FOUND)
def license_places(column: pa.Array) -> pa.Array:
    """Words and licence places of each text."""
    parts = [scan_slice(x) for x in array_slices(column)]
    return pa.concat_arrays(parts) if parts else pa.array(
        [], pa.struct([("n_words", pa.int64()), ("places", pa.list_(_ARROW))])
    )


def find_licenses(docs: DataFrame, text: str = "text", into: str = "licenses") -> DataFrame:
    """The input's rows with the words and places of each text; a column named ``into`` is replaced."""
    return docs.withColumn(into, license_places(F.col(text)))


def labels_of(places: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")


def belief(places: Column) -> Column:
    """How sure it is that a text states a licence: the labels' strongest signs, taken as independent."""
    sign = lambda p: F.when(p["kind"] == "tag", TAG).when(p["kind"] == "notice", NOTICE).when(
        p["label"] == "proprietary", RESERVED
    ).otherwise(NAME)
    signs = F.array_distinct(F.transform(places, lambda p: F.struct(p["label"].alias("l"), sign(p).alias("s"))))
    strongest = F.filter(
        signs, lambda x: ~F.exists(signs, lambda y: (y["l"] == x["l"]) & (y["s"] > x["s"]))
    )
    return F.round(
        1 - F.aggregate(F.array_sort(strongest), F.lit(1.0), lambda left, x: left * (1 - x["s"])), 6
    )


def licensed(docs: DataFrame, least: float, text: str = "text") -> DataFrame:
    """The documents all of whose licence expressions are at least so permissive; those without any stay."""
    found = find_licenses(docs, text, "__licenses")
    return found.where(
        ~F.exists("__licenses.places", lambda p: F.coalesce(p["permissive"] < least, F.lit(False)))
    ).drop("__licenses")


def op11_license_scan(spark, sf_dir):
    """Licences of ``documents``: base places, labels, expressions and the belief in them."""
    from tremora.session import table

    found = find_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    places = F.col("licenses.places")
    base = F.filter(places, lambda p: p["kind"] == "base")
    word = F.transform(base, lambda p: p["word"])
    shown = F.array_sort(F.array_distinct(F.filter(F.transform(places, lambda p: p["expression"]), F.isnotnull)))
    return found.select(
        "doc_id",
        F.col("licenses.n_words").alias("n_words"),
        F.size(base).cast("long").alias("n_base"),
        F.array_min(word).alias("first_word"),
        F.array_max(word).alias("last_word"),
        labels_of(base).alias("base_labels"),
        labels_of(places).alias("labels"),
        belief(places).alias("score"),
        F.array_join(shown, " | ").alias("expressions"),
        F.array_min(F.transform(places, lambda p: p["permissive"])).alias("permissive")
    )
