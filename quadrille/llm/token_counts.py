"""Token counts by a linear longest-match automaton.

The vocabulary is a byte trie. Each node has a failure link and the number of pieces that are popped on the way: where
the trie has no edge for the next byte, the automaton pops those pieces and goes on from the linked node. Every byte of
a word is read once, and only numbers are added; no piece is ever built. Counts equal those of greedy longest match.
"""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Distinct words whose counts a worker remembers; above it the memory starts anew. It bounds memory, not results.
REMEMBERED = 200_000


def read_ranks(path: str) -> list[bytes]:
    """The pieces of a file with a base64 piece and its rank on each line. Read on the driver."""
    with open(path, "rb") as lines:
        return [base64.b64decode(line.split()[0]) for line in lines if line.strip()]


class Automaton:
    """Greedy longest-match counts over ``initial`` pieces at the start of a word and ``continuing`` pieces after it.

    ``boundary`` is put before each word. A word that no pieces cover counts as one unknown token.
    """

    def __init__(self, initial: Iterable[bytes], continuing: Iterable[bytes] | None = None, boundary: bytes = b" "):
        self.boundary = boundary
        self.edges: dict[int, int] = {}  # node * 256 + byte -> node
        initial = list(initial)
        self.start, self.inner, size = 0, 0 if continuing is None else 1, 1 if continuing is None else 2
        ends: set[int] = set()
        above: dict[int, tuple[int, int]] = {}
        for root, pieces in ((self.start, initial), *([] if continuing is None else [(self.inner, continuing)])):
            for piece in pieces:
                node = root
                for b in piece:
                    to = self.edges.get(node << 8 | b)
                    if to is None:
                        to = self.edges[node << 8 | b] = size
                        above[size] = (node, b)
                        size += 1
                    node = to
                if piece:
                    ends.add(node)
        self._link(size, ends, above)

    def _link(self, size: int, ends: set[int], above: dict[int, tuple[int, int]]) -> None:
        below: dict[int, list[int]] = {}
        for node, (parent, _) in above.items():
            below.setdefault(parent, []).append(node)
        self.fail, self.popped = [-1] * size, [0] * size
        queue = deque(below.get(self.start, []) + (below.get(self.inner, []) if self.inner != self.start else []))
        while queue:
            node = queue.popleft()
            queue.extend(below.get(node, ()))
            if node in ends:
                self.fail[node], self.popped[node] = self.inner, 1
                continue
            parent, b = above[node]
            count, z = self.popped[parent], self.fail[parent]
            while z >= 0 and (z << 8 | b) not in self.edges:
                count += self.popped[z]
                z = self.fail[z]
            if z >= 0:
                self.fail[node], self.popped[node] = self.edges[z << 8 | b], count
        self.rest = [-1] * size  # pieces still to pop where a word ends at the node; -1: it cannot end there
        self.rest[self.inner] = self.rest[self.start] = 0
        for node in range(size):
            path = []
            while self.rest[node] < 0 and self.fail[node] >= 0:
                path.append(node)
                node = self.fail[node]
            total = self.rest[node]
            for n in reversed(path):
                if total < 0:
                    break
                total = self.rest[n] = total + self.popped[n]

    def count(self, word: bytes) -> int:
        edges, fail, popped, u, n = self.edges, self.fail, self.popped, self.start, 0
        for b in self.boundary + word:
            to = edges.get(u << 8 | b)
            while to is None:
                n += popped[u]
                u = fail[u]
                if u < 0:
                    return 1
                to = edges.get(u << 8 | b)
            u = to
        return n + self.rest[u] if self.rest[u] >= 0 else 1


class Memo(dict):
    """Counts of the words seen so far."""

    def __init__(self, automaton: Automaton):
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        n = self.automaton.count(word)
        if len(word) <= 64:
            self[word] = n
        return n


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_tokens (long).

    Words are what ASCII white space separates in the UTF-8 text; each is matched with a space before it. Null, empty
    and blank texts have no tokens, repeated rows each get a row, other columns are not read. The automaton has a size
    bounded by the vocabulary and is broadcast; texts are read whole and nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Automaton(read_ranks(vocabulary)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(shared.value)
        for batch in batches:
            words, tokens = [], []
            for text in batch.column(1):
                found = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                words.append(len(found))
                tokens.append(sum(map(memo.__getitem__, found)))
                if len(memo) > REMEMBERED:
                    memo.clear()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words long, n_tokens long")
