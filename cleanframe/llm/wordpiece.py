"""Token counts by greedy longest-match word pieces, without building the pieces.

The vocabulary is a trie over bytes. Each node also has a failure link and a number of pieces: when the next byte has no
child, that many pieces of the word so far are final, and matching goes on at the linked node, without reading a byte
twice. A word costs time linear in its length. Links and numbers are computed once, on the driver, from the vocabulary.

A word is a run of bytes other than white space, taken with one leading space, as byte-level vocabularies hold word
beginnings. Every single byte must be in the vocabulary, so every word has pieces.

Edge cases. A null or empty text has 0 words and 0 tokens. Repeated rows are each counted. Null ids are kept.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .segment import Words, slices, words

SPACE = 0x20


@dataclass
class Automaton:
    """edge: sorted parent * 256 + byte; child: node behind each; fail, popped: link and pieces; ended: pieces at a word's end."""

    edge: np.ndarray
    child: np.ndarray
    fail: np.ndarray
    popped: np.ndarray
    ended: np.ndarray

    def step(self, node: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Child of each node, and whether there is one."""
        key = node * 256 + byte
        at = np.minimum(np.searchsorted(self.edge, key), len(self.edge) - 1)
        return self.child[at], self.edge[at] == key

    def count(self, w: Words) -> np.ndarray:
        """Number of pieces of each of the words, all words a byte at a time."""
        size = w.end - w.begin
        pieces = np.zeros(len(size), np.int64)
        if not len(size):
            return pieces
        order = np.argsort(-size, kind="stable")
        falling = -size[order]
        start = self.step(np.zeros(1, np.int64), np.array([SPACE]))[0][0]
        node = np.full(len(size), start)
        for i in range(int(size.max())):
            active = order[: np.searchsorted(falling, -i, "left")]  # words longer than i
            byte = w.data[w.begin[active] + i].astype(np.int64)
            while len(active):
                to, there = self.step(node[active], byte)
                node[active[there]] = to[there]
                active, byte = active[~there], byte[~there]
                pieces[active] += self.popped[node[active]]
                node[active] = self.fail[node[active]]
        return pieces + self.ended[node]


def build(vocabulary: list[bytes]) -> Automaton:
    """Trie, failure links and popped counts of a vocabulary that holds every single byte."""
    children: list[dict[int, int]] = [{}]
    token = [False]
    for piece in vocabulary:
        node = 0
        for byte in piece:
            to = children[node].get(byte)
            if to is None:
                to = children[node][byte] = len(children)
                children.append({})
                token.append(False)
            node = to
        token[node] = node > 0
    missing = [b for b in range(256) if not token[children[0].get(b, 0)]]
    if missing:
        raise ValueError(f"{len(missing)} single bytes are not in the vocabulary")
    fail, popped, ended = ([0] * len(children) for _ in range(3))
    level = [(0, byte, node) for byte, node in children[0].items()]
    while level:
        for parent, byte, node in level:
            if token[node]:
                fail[node], popped[node] = 0, 1
            else:
                link, count = fail[parent], popped[parent]
                while byte not in children[link]:
                    count += popped[link]
                    link = fail[link]
                fail[node], popped[node] = children[link][byte], count
            ended[node] = popped[node] + ended[fail[node]]
        level = [(node, byte, to) for _, _, node in level for byte, to in children[node].items()]
    edges = sorted((parent * 256 + byte, to) for parent, own in enumerate(children) for byte, to in own.items())
    arrays = ([e for e, _ in edges], [c for _, c in edges], fail, popped, ended)
    return Automaton(*(np.array(a, np.int64) for a in arrays))


def byte_vocabulary(path: str) -> list[bytes]:
    """The pieces of a byte-level BPE file as bytes.

    Such files write a byte that is no printable Latin-1 letter as a letter from U+0100 on, in order.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    letter = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}
    with open(path, encoding="utf-8") as f:
        pieces = json.load(f)["model"]["vocab"]
    return [bytes(letter[c] for c in piece) for piece in pieces if all(c in letter for c in piece)]


_SAME = np.arange(256, dtype=np.uint8)


def _count(automaton):
    def run(batches):
        a = Automaton(**automaton.value)
        for batch in batches:
            texts = batch.column("text")
            for low, high in slices(texts):
                w = words(texts.slice(low, high - low), _SAME)
                _, at, which = np.unique(w.hash, return_index=True, return_inverse=True)
                once = Words(w.data, w.begin[at], w.end[at], w.first, w.hash[at])
                pieces = np.concatenate([[0], np.cumsum(a.count(once)[which])])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(low, high - low), pa.array(np.diff(w.first)), pa.array(np.diff(pieces[w.first]))], ["doc_id", "n_words", "n_tokens"])

    return run


def token_counts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, n_words, n_tokens) for each row of (doc_id, text); ``tokenizer`` is the path of a byte-level BPE file."""
    automaton = docs.sparkSession.sparkContext.broadcast(vars(build(byte_vocabulary(tokenizer))))
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_count(automaton), "doc_id bigint, n_words bigint, n_tokens bigint")
