"""License scans: notices by an Aho-Corasick automaton over words, identifier tags by a shunting-yard parser.

The automaton's alphabet is the words of the phrases; any other word leads back to its root, so a text is read once, word by
word, whatever the number of phrases, and places that overlap are all found. Texts with the words of an identifier tag are
looked at again: what follows the tag on its line is an expression of `and`, `or`, `with` and parentheses. It is brought
into postfix order and evaluated: `or` grants the best of its sides, `and` the worst, `with` what the exception adds. An
expression ends where the next token can't continue it; one that is not well formed counts as evidence but names nothing.

Null texts count as empty: no word, no label, score 0. Very long texts are read whole, one at a time. Repeated rows and
equal texts are judged one by one; an empty table gives no rows. Places are in order of their start, then of the phrase, so
there are no ties. Extra columns pass through; a column of the input that has the name of a computed one is replaced.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

#: Phrases and labels of the base scan (fixed values).
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Further phrases: label, and how sure it is that a text with the phrase is under a licence.
NOTICES = {
    "gnu lesser general public license": ("lgpl", 0.9), "gnu library general public license": ("lgpl", 0.9), "gnu affero general public license": ("agpl", 0.9),
    "gnu free documentation license": ("gfdl", 0.9), "mozilla public license": ("mpl", 0.9), "eclipse public license": ("epl", 0.9),
    "european union public licence": ("eupl", 0.9), "boost software license": ("bsl", 0.9), "bsd license": ("bsd", 0.8), "isc license": ("isc", 0.8),
    "cc by sa": ("cc-by-sa", 0.8), "cc by nd": ("cc-by-nd", 0.8), "cc by nc": ("cc-by-nc", 0.8), "cc by nc sa": ("cc-by-nc-sa", 0.8), "cc by nc nd": ("cc-by-nc-nd", 0.8),
    "cc0": ("cc0", 0.6), "creative commons attribution": ("cc-by", 0.8), "public domain": ("public-domain", 0.4), "all rights reserved": ("all-rights-reserved", 0.6),
    "permission is hereby granted free of charge to any person obtaining a copy": ("mit", 0.95),
    "redistribution and use in source and binary forms": ("bsd", 0.95),
    "permission to use copy modify and or distribute this software for any purpose": ("isc", 0.95),
    "this is free and unencumbered software released into the public domain": ("unlicense", 0.95),
}
BASE_WEIGHT, TAG_WEIGHT, BROKEN_WEIGHT = 0.8, 0.95, 0.5
#: The words of an identifier tag, and the tag with its expression.
TAG = "spdx license identifier"
_TAGGED = re.compile(rb"(?i)spdx-license-identifier[ \t]*:[ \t]*([^\r\n]*)")
#: What a licence grants, by the first prefix that fits the lower-cased identifier: 1 permissive, 0 nothing. Others: UNKNOWN.
GRANTS = (
    ("cc-by-nc", 0.2), ("cc-by-nd", 0.2), ("cc-by-sa", 0.6), ("cc-by", 0.9), ("cc0", 1.0), ("mit", 1.0), ("bsd", 1.0), ("0bsd", 1.0), ("apache", 1.0), ("isc", 1.0),
    ("zlib", 1.0), ("unlicense", 1.0), ("bsl", 1.0), ("python", 1.0), ("lgpl", 0.6), ("mpl", 0.7), ("epl", 0.6), ("eupl", 0.5), ("agpl", 0.3), ("gpl", 0.4), ("none", 0.0), ("proprietary", 0.0),
)
UNKNOWN, EXCEPTION = 0.5, 0.2

_SEPARATED = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_TOKEN = re.compile(rb"[()]|[A-Za-z0-9.+:_-]+|\S")
_PRECEDENCE = {"or": 1, "and": 2, "with": 3}
_IDENTIFIER = re.compile(r"[a-z0-9][a-z0-9.:_-]*\+?")


def words(text: bytes) -> list[bytes]:
    return text.translate(_SEPARATED).split()


class Automaton:
    """Aho-Corasick over words: every node has its transitions completed by those of its longest proper suffix."""

    def __init__(self, phrases: Iterable[str]):
        self.go: list[dict[bytes, int]] = [{}]
        self.ends: list[list[tuple[int, str]]] = [[]]
        for phrase in phrases:
            node, ws = 0, words(phrase.encode())
            for w in ws:
                if w not in self.go[node]:
                    self.go[node][w] = len(self.go)
                    self.go.append({})
                    self.ends.append([])
                node = self.go[node][w]
            self.ends[node].append((len(ws), phrase))
        todo = deque((child, 0) for child in self.go[0].values())
        while todo:
            node, suffix = todo.popleft()
            self.ends[node] += self.ends[suffix]
            todo.extend((child, self.go[suffix].get(w, 0)) for w, child in self.go[node].items())
            self.go[node] = self.go[suffix] | self.go[node]

    def places(self, text: list[bytes]) -> list[tuple[int, str]]:
        """Start and phrase of every occurrence, in order."""
        node, found, go, ends = 0, [], self.go, self.ends
        for i, w in enumerate(text):
            node = go[node].get(w, 0)
            if node and ends[node]:
                found += [(i + 1 - n, phrase) for n, phrase in ends[node]]
        return sorted(found)


@dataclass
class Expression:
    """A tag's expression: its normal form, the licences that it names, and what it grants; broken: None."""

    text: str
    ids: list[str]
    grants: float | None


def grant(identifier: str) -> float:
    return next((g for prefix, g in GRANTS if identifier.startswith(prefix)), UNKNOWN)


def postfix(tokens: Iterator[str]) -> list[str] | None:
    """Shunting-yard: the tokens in postfix order up to the one that can't continue the expression; None if it is broken."""
    out: list[str] = []
    held: list[str] = []
    operand = False  # whether the last token closed an operand
    for t in tokens:
        if t in _PRECEDENCE and operand:
            while held and _PRECEDENCE.get(held[-1], 0) >= _PRECEDENCE[t]:
                out.append(held.pop())
            held.append(t)
            operand = False
        elif t == "(" and not operand and held[-1:] != ["with"]:
            held.append(t)
        elif t == ")" and operand and "(" in held:
            while held[-1] != "(":
                out.append(held.pop())
            held.pop()
        elif not operand and t not in _PRECEDENCE and _IDENTIFIER.fullmatch(t):
            out.append(t)
            operand = True
        elif operand and "(" not in held:
            break
        else:
            return None
    if not operand or "(" in held:
        return None
    return out + held[::-1]


def parse(raw: bytes) -> Expression:
    """The expression at the head of raw."""
    order = postfix(m.decode("utf-8", "replace").lower() for m in _TOKEN.findall(raw))
    if order is None:
        return Expression(raw.decode("utf-8", "replace").strip(), [], None)
    stack: list[tuple[str, int, float]] = []  # normal form, its weakest operator, grant
    ids: list[str] = []
    for t in order:
        if t not in _PRECEDENCE:
            stack.append((t, 4, grant(t)))
            continue
        (b, bp, bg), (a, ap, ag), p = stack.pop(), stack.pop(), _PRECEDENCE[t]
        if t == "with" and ap < 4:  # an exception belongs to one licence
            return Expression(raw.decode("utf-8", "replace").strip(), [], None)
        a, b = (f"({x})" if xp < p else x for x, xp in ((a, ap), (b, bp)))
        stack.append((f"{a} {t} {b}", p, max(ag, bg) if t == "or" else min(ag, bg) if t == "and" else min(1.0, ag + EXCEPTION)))
    after_with = False
    for t in stack[0][0].replace("(", " ").replace(")", " ").split():
        if t not in _PRECEDENCE and not after_with:
            ids.append(t)
        after_with = t == "with"
    return Expression(stack[0][0], sorted(set(ids)), stack[0][2])


def scan_text(text: bytes, automaton: Automaton, labels: dict[str, tuple[str, float]]) -> tuple:
    """n_words, places, expressions, labels, score and grants of one text."""
    ws = words(text)
    places = automaton.places(ws)
    phrases = sorted({p for _, p in places})
    found = [parse(m) for m in _TAGGED.findall(text)] if TAG in phrases else []
    named = {labels[p][0] for p in phrases if p != TAG} | {i for e in found for i in e.ids}
    doubt = 1.0
    for p in phrases:
        doubt *= 1 - labels[p][1]
    if found:
        doubt *= 1 - (TAG_WEIGHT if any(e.ids for e in found) else BROKEN_WEIGHT)
    grants = [e.grants for e in found if e.ids] or [grant(x) for x in sorted(named)]
    out = [{"phrase": p, "label": labels[p][0], "word": i} for i, p in places if p != TAG]
    return len(ws), out, [{"text": e.text, "ids": e.ids, "grants": e.grants} for e in found], sorted(named), round(1 - doubt, 9), min(grants, default=None)


_STRING, _LONG, _DOUBLE = T.StringType(), T.LongType(), T.DoubleType()
_KINDS = {
    "n_words": (pa.int64(), _LONG),
    "places": (pa.list_(pa.struct([("phrase", pa.string()), ("label", pa.string()), ("word", pa.int64())])), T.ArrayType(T.StructType([T.StructField("phrase", _STRING), T.StructField("label", _STRING), T.StructField("word", _LONG)]))),
    "expressions": (pa.list_(pa.struct([("text", pa.string()), ("ids", pa.list_(pa.string())), ("grants", pa.float64())])), T.ArrayType(T.StructType([T.StructField("text", _STRING), T.StructField("ids", T.ArrayType(_STRING)), T.StructField("grants", _DOUBLE)]))),
    "labels": (pa.list_(pa.string()), T.ArrayType(_STRING)),
    "score": (pa.float64(), _DOUBLE),
    "grants": (pa.float64(), _DOUBLE),
}


def license_scan(docs: DataFrame, text: str = "text", notices: dict[str, tuple[str, float]] | None = None) -> DataFrame:
    """docs with n_words, places (phrase, label and first word of each occurrence), expressions (of identifier tags), labels,
    score (how sure it is that the text is under a licence) and grants (the least that its tags grant, or else its notices;
    null without any). notices: phrases with label and weight besides those of BASE."""
    notices = NOTICES if notices is None else notices
    labels = {p: (label, BASE_WEIGHT) for p, label in BASE.items()} | {p: x for p, x in notices.items() if p not in BASE} | {TAG: ("", 0.0)}
    kept = [c for c in docs.columns if c.lower() not in _KINDS or c == text]
    names = [*kept, *(c for c in _KINDS if c != text)]
    at = kept.index(text)

    def work(batches):
        automaton = Automaton(labels)
        for b in batches:
            raw = b.column(at).cast(pa.binary())
            for first in range(0, b.num_rows, 1024):
                piece = b.slice(first, 1024)
                found = [scan_text(t.as_py() or b"", automaton, labels) for t in raw.slice(first, 1024)]
                cols = dict(zip(_KINDS, zip(*found, strict=True), strict=True))
                arrays = [*piece.columns, *(pa.array(cols[c], kind) for c, (kind, _) in _KINDS.items() if c != text)]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = T.StructType([*(docs.schema[c] for c in kept), *(T.StructField(c, kind) for c, (_, kind) in _KINDS.items() if c != text)])
    return docs.select(*(docs[f"`{c}`"] for c in kept)).mapInArrow(work, schema)


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("places", lambda x: x["phrase"].isin(list(BASE)))
    at = F.transform(base, lambda x: x["word"])
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(base, lambda x: x["label"]))), ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"),
        "score", F.array_join(F.transform("expressions", lambda x: x["text"]), "; ").alias("expressions"), "grants",
    )
