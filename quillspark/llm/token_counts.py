"""Token counts by a linear longest-match automaton.

The vocabulary is a trie.  Each node has a failure link, to the node that reading goes on from
when no child fits, and the number of tokens that the link pops off; with these a word's greedy
longest-match length is counted in one pass over its bytes, without building a piece.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import hold_batches, rested
from .vocab import BYTE_BPE_RANKS, path_of, pieces_of_ranks, read

#: Words remembered by a worker; beyond it the memory is emptied and filled anew.
REMEMBERED = 1 << 20


class Automaton:
    """Counts the tokens of greedy longest matches; a word that cannot be matched is one token."""

    def __init__(self, pieces: list[bytes]) -> None:
        child: dict[int, int] = {}
        token, edges = [False], [[]]
        for piece in pieces:
            node = 0
            for byte in piece:
                key = node << 8 | byte
                if key not in child:
                    child[key] = len(token)
                    edges[node].append((byte, len(token)))
                    token.append(False)
                    edges.append([])
                node = child[key]
            if piece:
                token[node] = True
        fail, pops = [-1] * len(token), [0] * len(token)
        queue = deque([0])
        while queue:
            u = queue.popleft()
            for byte, v in edges[u]:
                if token[v]:
                    fail[v], pops[v] = 0, 1
                else:
                    z, n = fail[u], pops[u]
                    while z >= 0 and (z << 8 | byte) not in child:
                        n += pops[z]
                        z = fail[z]
                    if z >= 0:
                        fail[v], pops[v] = child[z << 8 | byte], n
                queue.append(v)
        self.child, self.fail, self.pops = child, fail, pops

    def count(self, word: bytes) -> int:
        child, fail, pops = self.child, self.fail, self.pops
        node = n = 0
        for byte in word:
            while (after := child.get(node << 8 | byte)) is None:
                n += pops[node]
                node = fail[node]
                if node < 0:
                    return 1
            node = after
        while node:
            n += pops[node]
            node = fail[node]
            if node < 0:
                return 1
        return n


def _count(raw: Broadcast, start: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Automaton(raw.value)
        known: dict[bytes, int] = {}
        for batch in batches:
            words, tokens = [], []
            for text in batch.column("text"):
                own = (text.as_py() or "").encode().split()
                counts = list(map(known.get, own))
                if None in counts:
                    for w in set(own):
                        if w not in known:
                            if len(known) >= REMEMBERED:
                                known.clear()
                            known[w] = machine.count(start + w)
                    counts = [known[w] if w in known else machine.count(start + w) for w in own]
                words.append(len(own))
                tokens.append(sum(counts))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_words", "n_tokens"])

    return run


def token_counts(docs: DataFrame, id_col: str = "doc_id", text: str = "text", vocabulary: str | None = None, start: bytes = b" ") -> DataFrame:
    """doc_id, n_words and n_tokens of every document.

    Words are runs of anything but ASCII white space; each is counted with ``start`` before it,
    as pieces that begin a word do in the vocabulary (a ranks file; its path is a parameter).
    Null and empty texts have no words and no tokens.  Repeated rows each get a row.
    """
    hold_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    pieces = docs.sparkSession.sparkContext.broadcast(pieces_of_ranks(read(vocabulary or path_of(BYTE_BPE_RANKS))))
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")).mapInArrow(rested(_count(pieces, start)), f"doc_id {kind}, n_words long, n_tokens long")


def greedy(word: bytes, pieces: set[bytes]) -> int:
    """Tokens of a word by trying the longest piece first; for tests."""
    n = at = 0
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), 0)
        if not end:
            return 1
        at, n = end, n + 1
    return n
