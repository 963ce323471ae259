"""Greedy word-piece lengths by a linear longest-match automaton.

Two tries share their nodes' numbering: one of pieces that begin a word, one of pieces that
go on. Each node knows a failure link, the node that the unmatched rest of its string leads
to, and how many pieces are popped on the way there. So a word costs one step a character
(amortised), no piece is ever built, and there is no limit on a word's length.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm import common as C
from tallyspark.session import ship_package


@dataclass(frozen=True)
class Settings:
    model: str                  #: path of a sentencepiece model whose pieces are the vocabulary
    memo_words: int = 400_000   #: words whose count a worker remembers


class Automaton:
    """Pieces that begin a word and pieces that go on; ``count`` gives the greedy length.

    An empty piece among those that begin is the bare word mark: a word that no other piece
    begins is that piece and pieces that go on.
    """

    def __init__(self, begin: Iterable[str], go_on: Iterable[str]) -> None:
        self.step: list[dict[str, int]] = [{}, {}]  # node 0: before a word; node 1: inside it
        ends = [False, False]
        begin = list(begin)
        bare = "" in begin
        for root, pieces in ((0, begin), (1, go_on)):
            for piece in pieces:
                node = root
                for c in piece:
                    nxt = self.step[node].get(c)
                    if nxt is None:
                        nxt = len(self.step)
                        self.step[node][c] = nxt
                        self.step.append({})
                        ends.append(False)
                    node = nxt
                if node > 1:
                    ends[node] = True
        self.fail, self.pops = [-1] * len(ends), [0] * len(ends)
        if bare:
            self.fail[0], self.pops[0] = 1, 1
        queue = deque([0, 1])
        while queue:
            node = queue.popleft()
            for c, child in self.step[node].items():
                if ends[child]:
                    self.fail[child], self.pops[child] = 1, 1
                else:
                    z, popped = self.fail[node], self.pops[node]
                    while z >= 0 and c not in self.step[z]:
                        popped += self.pops[z]
                        z = self.fail[z]
                    if z >= 0:
                        self.fail[child], self.pops[child] = self.step[z][c], popped
                queue.append(child)

    def count(self, word: str) -> int:
        """Pieces of the greedy segmentation; 0 if the word has none (it is unknown)."""
        step, fail, pops = self.step, self.fail, self.pops
        node = total = 0
        for c in word:
            while c not in step[node]:
                total += pops[node]
                node = fail[node]
                if node < 0:
                    return 0
            node = step[node][c]
        while node > 1:
            total += pops[node]
            node = fail[node]
        return total if node == 1 else 0


def vocabulary(path: str) -> tuple[list[str], list[str]]:
    """(pieces that begin a word, without their mark; pieces that go on) of a sentencepiece model.

    The bare mark is the empty piece among those that begin.
    """
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    usual = [sp.id_to_piece(k) for k in range(sp.get_piece_size()) if not (sp.is_control(k) or sp.is_unknown(k) or sp.is_byte(k) or sp.is_unused(k))]
    mark = "▁"
    begin = [p[1:] for p in usual if p.startswith(mark) and mark not in p[1:]]
    return begin, [p for p in usual if mark not in p]


_AUTOMATA: dict[str, Automaton] = {}


def automaton(path: str) -> Automaton:
    if path not in _AUTOMATA:
        _AUTOMATA[path] = Automaton(*vocabulary(path))
    return _AUTOMATA[path]


def token_counts(docs: DataFrame, settings: Settings) -> DataFrame:
    """(doc_id, n_words, n_tokens, n_unknown) for every row of ``docs``.

    Words are runs between white space (``[\\x20\\x09-\\x0D]``); an unknown word
    (one that the pieces can't spell from left to right) is one token.
    Null and empty texts have none. Repeated rows get a row each, a null doc_id stays, an
    empty table gives no rows; columns besides doc_id and text are ignored.
    """
    s = settings
    ship_package(docs.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, memo = automaton(s.model).count, {}
        for b in batches:
            out = []
            for text in b.column(1):
                words = (text.as_py() or "").encode().split()
                tokens = unknown = 0
                for w in words:
                    n = memo.get(w)
                    if n is None:
                        n = count(w.decode())
                        if len(w) <= 48:
                            if len(memo) >= s.memo_words:
                                memo.clear()
                            memo[w] = n
                    tokens += n or 1
                    unknown += not n
                out.append((len(words), tokens, unknown))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *[pa.array([o[k] for o in out], pa.int64()) for k in range(3)]], names=["doc_id", "n_words", "n_tokens", "n_unknown"])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    return rows.mapInArrow(task, "doc_id long, n_words long, n_tokens long, n_unknown long")
