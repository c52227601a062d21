"""Suffix automata of reference shards: passages of documents that also occur in a reference.

A shard is a bounded part of the reference; its automaton over word numbers is built on the driver (or once a shard) and
broadcast, and documents stream past it for their matching statistics: how long a run of words up to each place occurs in
the shard.  Words inside matches of at least ``window`` words are removed.

This suits references with a known bound, such as evaluation sets.  It does not suit a reference that grows with the corpus,
which is why ``substrings`` finds repeats within the corpus another way: every document has to meet every shard, and an
automaton takes about half a kilobyte a word in Python.  The README has the measured figures.

Null texts are empty; an empty reference removes nothing; repeated rows give repeated results.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


class SuffixAutomaton:
    """Of several word sequences; matches never cross from one into another."""

    def __init__(self, sequences: Iterable[list[bytes]]) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        for words in sequences:
            last = 0
            for w in words:
                last = self._extend(last, w)

    def _add(self, length: int, link: int, edges: dict[bytes, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(edges)
        return len(self.length) - 1

    def _extend(self, last: int, word: bytes) -> int:
        nxt, link, length = self.next, self.link, self.length
        known = nxt[last].get(word)
        if known is not None and length[known] == length[last] + 1:
            return known
        state = self._add(length[last] + 1, 0, {}) if known is None else -1
        p = last
        if known is None:
            while p >= 0 and word not in nxt[p]:
                nxt[p][word] = state
                p = link[p]
        if p < 0:
            return state
        q = nxt[p][word]
        if length[q] == length[p] + 1:
            link[state] = q
            return state
        copy = self._add(length[p] + 1, link[q], dict(nxt[q]))
        while p >= 0 and nxt[p].get(word) == q:
            nxt[p][word] = copy
            p = link[p]
        link[q] = copy
        if state < 0:
            return copy
        link[state] = copy
        return state

    def statistics(self, words: list[bytes]) -> list[int]:
        """At each place, how many words up to and with it are the end of a match."""
        nxt, link, length = self.next, self.link, self.length
        state = size = 0
        out = []
        for w in words:
            while state and w not in nxt[state]:
                state = link[state]
                size = length[state]
            if w in nxt[state]:
                state, size = nxt[state][w], size + 1
            out.append(size)
        return out


def covered(words: list[bytes], automata: Iterable[SuffixAutomaton], window: int) -> list[bool]:
    """Words in maximal matches of ``window`` words or more with any shard."""
    gone = [False] * len(words)
    for automaton in automata:
        for at, size in enumerate(automaton.statistics(words)):
            if size >= window:
                k = at
                while k > at - size and not gone[k]:
                    gone[k] = True
                    k -= 1
                if k > at - size:
                    gone[at - size + 1 : at + 1] = [True] * size
    return gone


def remove_reference(docs: DataFrame, reference: list[str], window: int = 35, shard_words: int = 200_000) -> DataFrame:
    """docs(text, ...) without the words that lie in passages of ``reference``.

    ``reference`` is a list on the driver and thus bounded; it is cut into shards of about ``shard_words`` words, texts
    whole, and each shard's automaton is broadcast.  All columns are kept; texts that lose nothing stay as they are.
    """
    shards: list[list[list[bytes]]] = [[]]
    size = 0
    for text in reference:
        words = (text or "").encode().split()
        if len(words) >= window:
            if size + len(words) > shard_words and shards[-1]:
                shards.append([])
                size = 0
            shards[-1].append(words)
            size += len(words)
    shared = [docs.sparkSession.sparkContext.broadcast(SuffixAutomaton(s)) for s in shards if s]
    place = docs.columns.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = [b.value for b in shared]
        for batch in batches:
            texts = []
            for text in batch.column(place):
                words = text.as_py().encode().split() if text.is_valid else []
                gone = covered(words, automata, window)
                texts.append(b" ".join(w for w, g in zip(words, gone, strict=True) if not g).decode() if any(gone) else text.as_py())
            columns = list(batch.columns)
            columns[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return docs.mapInArrow(cut, docs.schema)
