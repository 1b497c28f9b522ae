"""Encoding of a corpus with a public byte-level BPE by replaying its merges over all words of a block at once.

Instead of running the merge loop text by text, the distinct words of a block of documents are laid out as one linked
sequence of tokens, and an inverted index leads from each token pair to its positions. The merges that occur are applied
in rank order; each application touches only the two neighbours of the merged position. A word's pieces never reach over
its ends, so that blocks are independent of each other and the documents need no shuffle; words already known to a task
aren't replayed again.

Replay in rank order gives the same result as the usual loop, since a pair that contains a new token always has a higher
rank than the merge that made this token.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: The public pattern by which byte-level BPE splits texts into words.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Words kept per task; beyond it they are forgotten and replayed again when they recur. Results don't depend on it.
KNOWN_WORDS = 2_000_000


def byte_symbols() -> dict[str, int]:
    """The printable symbol of each byte in byte-level BPE vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class MergeReplay:
    """The merges of a byte-level BPE in rank order, replayed over many words at once."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        symbols = byte_symbols()
        self.byte_id = [0] * 256
        for s, b in symbols.items():
            self.byte_id[b] = vocab[s]
        self.rank: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        self.pairs: list[tuple[int, int]] = []
        for merge in model["merges"]:
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            pair = (vocab[a], vocab[b])
            self.rank[pair] = len(self.pairs)
            self.pairs.append(pair)
            self.made.append(vocab[a + b])

    def words(self, words: list[str]) -> list[tuple[int, ...]]:
        """The ids of each word."""
        tok: list[int] = []
        ends = []
        byte_id = self.byte_id
        for w in words:
            tok.extend(map(byte_id.__getitem__, w.encode("utf-8")))
            tok.append(-1)  # between two words
            ends.append(len(tok) - 1)
        n = len(tok)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = self.rank.get
        at: dict[int, list[int]] = {}
        for i, pair in enumerate(zip(tok, tok[1:])):
            if (r := rank(pair)) is not None:
                at.setdefault(r, []).append(i)
        queue = list(at)
        heapq.heapify(queue)
        while queue:
            r = heapq.heappop(queue)
            a, b = self.pairs[r]
            new = self.made[r]
            for i in sorted(at.pop(r)):
                j = nxt[i]
                if tok[i] != a or j >= n or tok[j] != b:  # changed by an earlier merge
                    continue
                k, h = nxt[j], prv[i]
                tok[i], tok[j] = new, -2
                nxt[i] = k
                if k < n:
                    prv[k] = i
                    if (q := rank((new, tok[k]))) is not None:
                        if q not in at:
                            at[q] = []
                            heapq.heappush(queue, q)
                        at[q].append(i)
                if h >= 0 and (q := rank((tok[h], new))) is not None:
                    if q not in at:
                        at[q] = []
                        heapq.heappush(queue, q)
                    at[q].append(h)
        out, start = [], 0
        for end in ends:
            out.append(tuple(t for t in tok[start:end] if t != -2))
            start = end + 1
        return out


def splitter(text: str) -> list[str]:
    """The words of a text; joined they are the text again."""
    return (_ASCII if text.isascii() else _ANY).findall(text)


_ANY = regex.compile(PATTERN)
_ASCII = re.compile(r"'(?:[sdmt]|ll|ve|re)| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)


def encode(documents: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``ids``, the list of token ids of each text without special tokens, one row per row of the input.

    Empty texts and null texts both have the empty list. Names of special tokens in a text are ordinary text. Blank
    texts have the ids of their white space. Columns other than the two named aren't read; rows that occur twice come out
    twice; an empty table gives an empty result. ``tokenizer_path`` must be readable on the executors.
    """
    source = documents.select(id_col, text_col)
    out = pa.schema([(id_col, pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay, known = MergeReplay(tokenizer_path), {}
        for batch in batches:
            split = [splitter(t) if t else () for t in batch.column(1).to_pylist()]
            if len(known) > KNOWN_WORDS:
                known.clear()
            new = list(set(chain.from_iterable(split)).difference(known))
            known.update(zip(new, replay.words(new)))
            flat: list[int] = []
            offsets = [0]
            for words in split:
                flat.extend(chain.from_iterable(map(known.__getitem__, words)))
                offsets.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), ids], schema=out)

    return source.mapInArrow(run, f"`{id_col}` bigint, ids array<int>")
