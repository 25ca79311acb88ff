"""Word-piece counts by a linear longest-match automaton.

The vocabulary is a trie with two roots, one for pieces that begin a word and
one for pieces that continue it. A node's failure link leads to the node that
matching goes on from when no child fits, and the number of pieces completed
on the way there is computed once for each node. A word is counted in one pass
over its bytes, without going back and without building pieces.
"""

from __future__ import annotations

import base64
import hashlib
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Carried, prepare, with_arrow

#: Words whose counts a task remembers.
MEMO = 300_000


def vocabulary(path: str) -> list[bytes]:
    """Pieces of a tiktoken rank file: one base64 token and its rank a line."""
    with open(path, "rb") as source:
        return [base64.b64decode(line.split()[0]) for line in source if line.strip()]


class Automaton:
    """Greedy longest-match piece counts of single words.

    Pieces that start with a space begin words, others continue them; pieces
    with further white space take no part. A word that can't be matched whole
    counts as one unknown piece. With whole it is matched all the same: where
    no piece begins it, a lone space is a token of its own and continuing
    pieces follow, and a byte that no piece fits is a token.
    """

    def __init__(self, pieces: Iterable[bytes], whole: bool = False):
        self.whole = whole
        self.step: list[dict[int, int]] = [{}, {}]
        final = {0, 1}
        for piece in pieces:
            node, tail = (0, piece[1:]) if piece.startswith(b" ") else (1, piece)
            if not tail or tail.split() != [tail]:
                continue
            for byte in tail:
                node = self.step[node].setdefault(byte, len(self.step))
                if node == len(self.step):
                    self.step.append({})
            final.add(node)
        self.fail: list[int] = [-1] * len(self.step)
        self.popped = [0] * len(self.step)
        if whole:
            self.fail[0], self.popped[0] = 1, 1
        waiting = deque((root, byte, child) for root in (0, 1) for byte, child in self.step[root].items())
        while waiting:
            parent, byte, node = waiting.popleft()
            if node in final:
                self.fail[node], self.popped[node] = 1, 1
            else:
                link, popped = self.fail[parent], self.popped[parent]
                while link >= 0 and byte not in self.step[link]:
                    popped += self.popped[link]
                    link = self.fail[link]
                if link >= 0:
                    self.fail[node], self.popped[node] = self.step[link][byte], popped
                elif whole:  # from the continuing root, and no piece is this byte
                    self.fail[node], self.popped[node] = 1, popped + 1
            waiting.extend((node, b, child) for b, child in self.step[node].items())

    def count(self, word: bytes) -> int:
        step, fail, popped = self.step, self.fail, self.popped
        node = total = 0
        for byte in word:
            while byte not in step[node]:
                if fail[node] < 0:
                    if not self.whole:
                        return 1
                    total += 1
                    break
                total += popped[node]
                node = fail[node]
            else:
                node = step[node][byte]
        while node != 1:
            if fail[node] < 0:
                return 1
            total += popped[node]
            node = fail[node]
        return total


class _Memo(dict):
    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        found = self.automaton.count(word)
        if len(self) < MEMO and len(word) < 64:
            self[word] = found
        return found


_made: dict[tuple[str, bool], _Memo] = {}


def token_counts(docs: DataFrame, path: str, keep: list[str] | None = None, whole: bool = False) -> DataFrame:
    """doc_id, the columns named in keep, n_words and n_tokens for each row of docs.

    Words are split at ASCII white space in the whole text and counted by
    greedy longest match with the vocabulary file at path; a word that can't be
    matched counts as one unknown piece, or with whole as all its tokens, so
    that counts are lengths. Null and empty texts have no words; very long ones
    are counted whole. Rows are independent, so repeated rows and null ids come
    back as they are, and an empty table gives an empty result. A column in
    keep that is named like a result's comes back as <name>_in.
    """
    prepare(docs.sparkSession)
    carried = Carried(docs, keep or [], ["doc_id", "n_words", "n_tokens"])
    pieces, extra = vocabulary(path), carried.names
    named = hashlib.sha256(repr(pieces).encode()).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast(pieces)

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        key = (named, whole)
        if key not in _made:
            _made.clear()
            _made[key] = _Memo(Automaton(shared.value, whole))
        memo = _made[key].__getitem__
        words = [(x or "").encode().split() for x in batch["text"].to_pylist()]
        yield {c: batch[c] for c in ["doc_id", *extra]} | {"n_words": [len(x) for x in words], "n_tokens": [sum(map(memo, x)) for x in words]}

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *carried.columns)
    return carried.restored(with_arrow(source, run, ", ".join(["doc_id long", *carried.ddl, "n_words long, n_tokens long"])))
