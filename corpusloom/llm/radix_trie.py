"""Byte radix tries with counters by source at their leaves, and their flat form, in which they travel and merge."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa


class Node:
    __slots__ = ("label", "kids", "counts", "docs")

    def __init__(self, label: bytes):
        self.label, self.kids, self.counts, self.docs = label, None, None, 0


def _shared(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by halving."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n  # a[:lo] is shared, a[:hi] isn't
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid)
    return lo


class Trie:
    def __init__(self):
        self.root, self.leaves = Node(b""), 0

    def leaf(self, term: bytes) -> Node:
        """The node of term, made if need be; a node counts as a leaf once it has counters."""
        node, i = self.root, 0
        while i < len(term):
            kids = node.kids
            if kids is None:
                kids = node.kids = {}
            kid = kids.get(term[i])
            if kid is None:
                node = kids[term[i]] = Node(term[i:])
                break
            label = kid.label
            if not term.startswith(label, i):
                n = _shared(label, term[i : i + len(label)])
                kid.label, upper = label[n:], Node(label[:n])
                upper.kids = {label[n]: kid}
                kids[term[i]] = kid = upper
                label = kid.label
            node, i = kid, i + len(label)
        if node.counts is None:
            node.counts = {}
            self.leaves += 1
        return node

    def walk(self) -> Iterator[tuple[bytes, Node]]:
        """Terms and leaves in the order of bytes, which is that of UTF-8."""
        todo = [(b"", self.root)]
        while todo:
            prefix, node = todo.pop()
            term = prefix + node.label
            if node.counts is not None:
                yield term, node
            if node.kids:
                todo.extend((term, node.kids[x]) for x in sorted(node.kids, reverse=True))


class Flat:
    """A run of leaves in order: each has the number of bytes it shares with the leaf before, and the rest of its bytes."""

    SCHEMA = "shared array<int>, tails array<binary>, docs array<long>, ends array<int>, sources array<int>, counts array<long>, names array<string>"
    KINDS = (pa.list_(pa.int32()), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.string()))

    def __init__(self):
        self.last, self.shared, self.tails, self.docs, self.ends, self.sources, self.counts = b"", [], [], [], [], [], []
        self.numbers: dict[str, int] = {}

    def add(self, term: bytes, node: Node) -> None:
        n = _shared(self.last, term)
        self.last = term
        self.shared.append(n)
        self.tails.append(term[n:])
        self.docs.append(node.docs)
        for source, count in node.counts.items():
            self.sources.append(self.numbers.setdefault(source, len(self.numbers)))
            self.counts.append(count)
        self.ends.append(len(self.counts))

    def columns(self) -> tuple:
        return self.shared, self.tails, self.docs, self.ends, self.sources, self.counts, list(self.numbers)


def terms(shared: list[int], tails: list[bytes]) -> Iterator[bytes]:
    return accumulate(zip(shared, tails, strict=True), lambda last, x: last[: x[0]] + x[1], initial=b"")


def merge(trie: Trie, known: dict[bytes, Node], shared, tails, docs, ends, sources, counts, names) -> None:
    """Adds a flat run to trie; known: its leaves by term, so that only new terms are looked for in it."""
    every, start = terms(shared, tails), 0
    next(every)
    for term, n, end in zip(every, docs, ends, strict=True):
        node = known.get(term)
        if node is None:
            node = known[term] = trie.leaf(term)
        node.docs += n
        held = node.counts
        for i in range(start, end):
            name = names[sources[i]]
            held[name] = held.get(name, 0) + counts[i]
        start = end
