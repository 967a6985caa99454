"""Operator 3, token counts: linear longest-match over a word-piece vocabulary.

Greedy word-piece counts are read off a trie with failure links. A failure link
is taken when no longer piece fits: it pops the longest pieces of the string
matched so far and goes on at the node that holds the rest. The number of pieces
popped is stored with the link, so a word's token count is a sum along one
left-to-right pass; no piece is ever built and no character is read twice.

A vocabulary has pieces that begin a word and pieces that continue one. From a
byte-level vocabulary, entries that carry the space mark begin words and all
others continue them; bytes are the characters of the automaton, so any text is
covered. Words are runs of letters, runs of digits or single other characters
inside the white-space words, as in ``WORD_RULE``. A word that cannot be split
counts as one unknown token.

Distinct words are few, so each worker keeps counts of words seen in a
dictionary of at most ``CACHE_WORDS`` entries that is emptied when full.

Defined results: null and empty texts have no words and no tokens; texts are
counted whole; repeated rows count alike; extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
from collections import deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

ship(__name__)

CACHE_WORDS = 500_000
SCHEMA = "doc_id long, n_words long, n_tokens long, n_unknown long"
WORD_RULE = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|_")


def byte_alphabet() -> dict[str, int]:
    """The printable characters that byte-level vocabularies write for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def read_vocabulary(path: str) -> tuple[set[bytes], set[bytes]]:
    """Pieces that begin a word, and pieces that continue one, of a byte-level JSON vocabulary."""
    letters = byte_alphabet()
    if not os.path.exists(path):
        raise FileNotFoundError(f"no vocabulary at {path}; give the path of a byte-level tokenizer file (ADJUDICA_VOCABULARY for the query)")
    with open(path, encoding="utf-8") as f:
        entries = json.load(f)["model"]["vocab"]
    first, rest = set(), set()
    mark = "Ġ"
    for entry in entries:
        body = entry[1:] if entry.startswith(mark) else entry
        if body and all(ch in letters for ch in body) and mark not in body:
            (first if entry.startswith(mark) else rest).add(bytes(letters[ch] for ch in body))
    return first, rest


class Matcher:
    """Trie of begin pieces at node 0 and continue pieces at node 1, with failure links."""

    def __init__(self, first: set[bytes], rest: set[bytes]):
        self.next: list[dict[int, int]] = [{}, {}]
        ends: set[int] = set()
        for root, pieces in ((0, first), (1, rest)):
            for piece in sorted(pieces):
                at = root
                for b in piece:
                    if b not in self.next[at]:
                        self.next[at][b] = len(self.next)
                        self.next.append({})
                    at = self.next[at][b]
                ends.add(at)
        size = len(self.next)
        #: Node after popping, -1 if none; pieces popped on the way.
        self.fail, self.popped = [-1] * size, [0] * size
        queue = deque([0, 1])
        while queue:
            u = queue.popleft()
            for b, v in self.next[u].items():
                if v in ends:
                    self.fail[v], self.popped[v] = 1, 1
                else:
                    z, n = self.fail[u], self.popped[u]
                    while z >= 0 and b not in self.next[z]:
                        n += self.popped[z]
                        z = self.fail[z]
                    if z >= 0:
                        self.fail[v], self.popped[v] = self.next[z][b], n
                queue.append(v)

    def count(self, word: bytes) -> int:
        """Pieces of the greedy longest-match split; -1 if there is none."""
        nxt, fail, popped = self.next, self.fail, self.popped
        at = n = 0
        for b in word:
            while b not in nxt[at]:
                if fail[at] < 0:
                    return -1
                n += popped[at]
                at = fail[at]
            at = nxt[at][b]
        while at != 1:  # what is still held must pop whole
            if fail[at] < 0:
                return -1 if word else 0
            n += popped[at]
            at = fail[at]
        return n


def count_tokens(documents: DataFrame, vocabulary: str) -> DataFrame:
    """Word, token and unknown-word counts of every whole text. ``vocabulary``: path of the JSON file."""
    matcher = documents.sparkSession.sparkContext.broadcast(read_vocabulary(os.fspath(vocabulary)))

    def scan(batches):
        count = Matcher(*matcher.value).count
        seen: dict[str, int] = {}
        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                words = tokens = unknown = 0
                for word in WORD_RULE.findall(text or ""):
                    n = seen.get(word)
                    if n is None:
                        if len(seen) >= CACHE_WORDS:
                            seen.clear()
                        n = count(word.encode())
                        seen[word] = n
                    words += 1
                    if n < 0:
                        unknown += 1
                        n = 1
                    tokens += n
                rows.append((None if pd.isna(doc_id) else int(doc_id), words, tokens, unknown))
            yield pd.DataFrame(rows, columns=["doc_id", "n_words", "n_tokens", "n_unknown"]).astype({"doc_id": "Int64"})

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInPandas(scan, SCHEMA)
