"""Encoding of a whole corpus with a public byte-level BPE vocabulary.

Speculate and verify: the longest token that fits is taken again and again, and the outcome is the exact one if every two
adjacent tokens are compatible, that is if their bytes together encode to just these two. Pairs are tested for all words of
a batch at once against the pairs already judged; only words with an incompatible pair are merged exactly.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slipworks.sources.tables import spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed value: the pattern that splits text before the merges of this public vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Words and pairs that a Python worker remembers; beyond that it forgets all and goes on.
MOST_WORDS, MOST_PAIRS = 400_000, 2_000_000


def read_ranks(path: str = VOCABULARY) -> list[bytes]:
    """The vocabulary's tokens in order of their ids."""
    with open(path, "rb") as lines:
        ranks = {int(i): base64.b64decode(token) for token, i in map(bytes.split, lines)}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("the ids of a vocabulary must be 0 to its size less 1")
    return [ranks[i] for i in range(len(ranks))]


class SpeculativeEncoder:
    def __init__(self, tokens: list[bytes]) -> None:
        self.tokens, self.ids, self.longest = tokens, {t: i for i, t in enumerate(tokens)}, max(map(len, tokens))
        self.lengths: dict[bytes, list[int]] = {}
        for t in tokens:
            self.lengths.setdefault(t[:2], []).append(len(t))
        self.lengths = {k: sorted(set(v), reverse=True) for k, v in self.lengths.items()}
        self.words: dict[str, tuple[int, ...]] = {}
        self.pairs, self.good = np.empty(0, np.int64), np.empty(0, bool)
        self.merged = 0

    def propose(self, word: bytes) -> list[int]:
        """The longest token at each place, from the left."""
        out, at, ids, end = [], 0, self.ids, len(word)
        while at < end:
            for n in self.lengths.get(word[at : at + 2], (1,)):
                token = ids.get(word[at : at + n])
                if token is not None and n <= end - at:
                    break
            else:
                n, token = 1, ids[word[at : at + 1]]
            out.append(token)
            at += n
        return out

    def merge(self, word: bytes) -> list[int]:
        """Exact merging: the adjacent parts with the lowest rank first, of equals the leftmost."""
        ids, n = self.ids, len(word)
        ends, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(ids[word[i : i + 2]], i, i + 2) for i in range(n - 1) if word[i : i + 2] in ids]
        heapq.heapify(heap)

        def offer(i: int) -> None:
            if i >= 0 and ends[i] < n:
                rank = ids.get(word[i : ends[ends[i]]])
                if rank is not None:
                    heapq.heappush(heap, (rank, i, ends[ends[i]]))

        while heap:
            _, i, end = heapq.heappop(heap)
            if not alive[i] or ends[i] >= n or ends[ends[i]] != end:
                continue
            gone = ends[i]
            alive[gone], ends[i] = False, end
            if end < n:
                before[end] = i
            offer(i)
            offer(before[i])
        return [ids[word[i : ends[i]]] for i in range(n) if alive[i]]

    def _judge(self, keys: np.ndarray) -> np.ndarray:
        """Whether each pair (left * size + right) is compatible."""
        size = len(self.tokens)
        at = np.searchsorted(self.pairs, keys)
        known = (at < len(self.pairs)) & (self.pairs[np.minimum(at, max(0, len(self.pairs) - 1))] == keys) if len(self.pairs) else np.zeros(len(keys), bool)
        new = keys[~known]
        if len(new):
            good = np.fromiter((self.merge(self.tokens[k // size] + self.tokens[k % size]) == [k // size, k % size] for k in new.tolist()), bool, len(new))
            if len(self.pairs) + len(new) > MOST_PAIRS:
                self.pairs, self.good = np.empty(0, np.int64), np.empty(0, bool)
                at, new, good = None, keys, np.fromiter((self.merge(self.tokens[k // size] + self.tokens[k % size]) == [k // size, k % size] for k in keys.tolist()), bool, len(keys))
            pairs, all_good = np.concatenate([self.pairs, new]), np.concatenate([self.good, good])
            order = np.argsort(pairs, kind="stable")
            self.pairs, self.good = pairs[order], all_good[order]
            at = np.searchsorted(self.pairs, keys)
        return self.good[at]

    def learn(self, words: list[str]) -> None:
        """Encodes words that are not remembered yet, all at once."""
        if len(self.words) + len(words) > MOST_WORDS:
            self.words.clear()
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        tried = [self.propose(b) for b in raw]
        counts = np.fromiter(map(len, tried), np.int64, len(tried))
        flat = np.fromiter((t for x in tried for t in x), np.int64, int(counts.sum()))
        of = np.repeat(np.arange(len(tried)), counts)
        inner = of[1:] == of[:-1]
        keys = (flat[:-1] * len(self.tokens) + flat[1:])[inner]
        failing: set[int] = set()
        if len(keys):
            kinds, back = np.unique(keys, return_inverse=True)
            failing = set(of[1:][inner][~self._judge(kinds)[back]].tolist())
        self.merged += len(failing)
        for i, w in enumerate(words):
            self.words[w] = tuple(self.merge(raw[i]) if i in failing else tried[i])

    def batch(self, texts: list[str | None]) -> list[list[str]]:
        """The words of each text, all of them remembered afterwards."""
        split = _SPLIT.findall
        parts = [split(t) if t else [] for t in texts]
        fresh = {w for p in parts for w in p if w not in self.words}
        if len(self.words) + len(fresh) > MOST_WORDS:  # learn forgets, so all words of the batch are fresh
            fresh = {w for p in parts for w in p}
        if fresh:
            self.learn(sorted(fresh))
        return parts

    def encode(self, text: str | None) -> list[int]:
        return [i for w in self.batch([text])[0] for i in self.words[w]]


_SPLIT = regex.compile(PATTERN)
_MADE: dict[bytes, SpeculativeEncoder] = {}


def _encoder(tokens: list[bytes]) -> SpeculativeEncoder:
    """One encoder for each Python worker and vocabulary, kept from task to task."""
    key = hashlib.sha256(b"".join(len(t).to_bytes(4) + t for t in tokens)).digest()
    if key not in _MADE:
        _MADE[key] = SpeculativeEncoder(tokens)
    return _MADE[key]


def encode(documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, ids): the token ids of each row's whole text without special tokens; the vocabulary's strings for special tokens
    are ordinary text. An empty or a null text has an empty list. Rows are kept as they come, repeats and null keys included.
    """
    return _mapped(documents, key, text, vocabulary, count=False)


def count_tokens(documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, tokens): the number of tokens of each row's whole text, 0 for an empty or a null text."""
    return _mapped(documents, key, text, vocabulary, count=True)


def _mapped(documents: DataFrame, key: str, text: str, vocabulary: str, count: bool) -> DataFrame:
    rows = documents.select(F.col(key).alias("k"), F.col(text).alias("t"))
    tokens = documents.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))  # under 2 MB
    kind = rows.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(tokens.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                parts, known = coder.batch(batch.column(1).to_pylist()), coder.words
                if count:
                    sizes = pa.array([sum([len(known[w]) for w in p]) for p in parts], pa.int64())
                    yield pa.RecordBatch.from_arrays([batch.column(0), sizes], ["k", "v"])
                    continue
                flat, offsets = array("i"), array("i", [0])
                for p in parts:
                    for w in p:
                        flat.extend(known[w])
                    offsets.append(len(flat))
                lists = pa.ListArray.from_arrays(pa.array(np.asarray(offsets), pa.int32()), pa.array(np.asarray(flat, dtype=np.int32), pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["k", "v"])

    out = spread(rows).mapInArrow(run, f"k {kind}, v {'bigint' if count else 'array<int>'}")
    return out.select(F.col("k").alias(key), F.col("v").alias("tokens" if count else "ids"))
