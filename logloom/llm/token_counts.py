"""Token counts under a unigram model, by dynamic programming over a trie.

The model gives every piece of a vocabulary a cost, -log of its probability; a pre-token is cut
into the pieces of least total cost. Distinct pre-tokens are entered in a byte trie. The
forward score of a trie node, the least cost of cutting the bytes on its path, is computed when
the node is made, from the scores of its ancestors, so a prefix that many pre-tokens share is
scored once. A pre-token's node stores the number of pieces on its best path; a text's count is
the sum over its pre-tokens. Ties go to fewer pieces.

The public vocabularies carry no unigram probabilities, so these follow Zipf's law over the
ranks of a rank file: p(rank) ~ 1 / (rank + 1). Any other cost table can be passed in.

A worker keeps one trie for all its tasks and empties it at `MAX_NODES`, which bounds memory and
changes no count. Texts are read whole, in the scan, with no shuffle.

Defined results: a null or empty text counts 0; ids may be null or repeated, each row is
counted; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import base64
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.pretokens import PATTERN, Recent, cut_text, of_plain

MAX_NODES, MAX_WORDS = 250_000, 200_000
#: Costs are whole numbers, so that sums and ties are exact.
UNIT = 1_000_000


def rank_file(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}


def zipf_costs(ranks: dict[bytes, int]) -> dict[bytes, int]:
    """Costs of pieces by Zipf's law over their ranks."""
    total = math.log(sum(1 / (r + 1) for r in ranks.values()))
    return {piece: round(UNIT * (math.log(r + 1) + total)) for piece, r in ranks.items()}


class ScoredTrie:
    """Trie over pre-tokens; every node has its forward score (cost, pieces)."""

    def __init__(self, costs: dict[bytes, int]) -> None:
        self.costs = costs
        self.longest = max(map(len, costs), default=1)
        self.clear()

    def clear(self) -> None:
        self.children: list[dict[int, int]] = [{}]
        self.score: list[tuple[int, int]] = [(0, 0)]

    def count(self, token: bytes) -> int:
        """Pieces on the best path of a pre-token, which is entered if it is new."""
        node, path = 0, [self.score[0]]
        for at, byte in enumerate(token):
            below = self.children[node].get(byte)
            if below is None:
                below = self._grow(node, token, at + 1, path)
            path.append(self.score[below])
            node = below
        return path[-1][1]

    def _grow(self, parent: int, token: bytes, end: int, path: list[tuple[int, int]]) -> int:
        best = None
        for start in range(max(end - self.longest, 0), end):
            cost = self.costs.get(token[start:end])
            if cost is not None:
                before = path[start]
                score = (before[0] + cost, before[1] + 1)
                if best is None or score < best:
                    best = score
        if best is None:  # a byte the vocabulary lacks is a piece of its own, dearer than all
            before = path[end - 1]
            best = (before[0] + 100 * UNIT, before[1] + 1)
        self.children.append({})
        self.score.append(best)
        self.children[parent][token[end - 1]] = len(self.children) - 1
        return len(self.children) - 1


class Counter:
    """Token counts of texts; words are looked up before their pre-tokens are."""

    _shared: dict[str, Counter] = {}

    def __init__(self, costs: dict[bytes, int]) -> None:
        self.trie = ScoredTrie(costs)
        self.words = Recent(MAX_WORDS)

    @classmethod
    def of(cls, path: str) -> Counter:
        """One per worker process."""
        if path not in cls._shared:
            cls._shared[path] = cls(zipf_costs(rank_file(path)))
        return cls._shared[path]

    def plain(self, text: str) -> int:
        return sum(self.trie.count(t.encode()) for t in PATTERN.findall(text))

    def word(self, word: str) -> int:
        n = self.words.old.get(word) or sum(self.trie.count(t.encode()) for t in of_plain(word))
        self.words.new[word] = n
        return n

    def count(self, text: str) -> int:
        if len(self.trie.score) > MAX_NODES:
            self.trie.clear()
        self.words.turn()
        head, words, plain = cut_text(text)
        if not plain:
            return self.plain(head) + sum(self.plain(" " + w) for w in words)
        found = list(map(self.words.new.get, words))
        if None in found:
            found = [self.word(w) if n is None else n for w, n in zip(words, found)]
        return self.plain(head) + sum(found)


def token_count(text: Column, rank_path: str) -> Column:
    """Tokens of a text under the Zipf unigram model of a rank file."""
    @F.arrow_udf("long")
    def run(texts: pa.Array) -> pa.Array:
        counter = Counter.of(rank_path)
        return pa.array(np.fromiter((counter.count(t.as_py() or "") for t in texts), np.int64, len(texts)))

    return run(text)


def count_tokens(docs: DataFrame, rank_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_tokens."""
    return docs.select(F.col(id_col).alias("doc_id"), token_count(F.col(text_col), rank_path).alias("n_tokens"))
