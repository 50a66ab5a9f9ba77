"""Exact token counts by heap-and-linked-list byte-pair merging.

A text is cut into pre-tokens by the byte-level pattern; the symbols of a
pre-token form a linked list, and a heap holds the ranks of its adjacent pairs.
The lowest-ranked pair is popped and merged until none is left. The count is
the number of initial symbols minus the merges made: no ids are written.

Nulls count as empty texts; an empty text has 0 tokens. Strings of added
tokens inside a text count as one token each, which is what the library does
unless told otherwise. Rows are independent, so repeated rows, extra columns
and empty tables need no care; an output column of a name that exists already
replaces it.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from trackloom.llm.common import TwoAges, held, small_batches

#: Fixed value: the byte-level pre-tokenizer's pattern.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Pre-tokens whose counts a worker remembers, twice over at most.
MEMO = 300_000
#: Longer pre-tokens are counted anew each time, so that the memo's size is bounded.
MEMO_CHARS = 64


def byte_alphabet() -> dict[int, str]:
    """The character that stands for each byte: itself where printable, else the next free one from 256 on."""
    shown = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return {b: chr(b if b in shown else next(spare)) for b in range(256)}


class PairMerger:
    """Counts tokens of a byte-level byte-pair vocabulary in the tokenizers library's file format."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or not pre.get("use_regex", True) or pre["add_prefix_space"] or spec["normalizer"] or model.get("ignore_merges"):
            raise ValueError(f"{path}: not a plain byte-level BPE vocabulary")
        vocab = model["vocab"]
        self.width = width = len(vocab) + 1
        self.initial = [vocab[c] for c in byte_alphabet().values()]
        self.rank: dict[int, int] = {}
        self.pair: list[int] = []
        self.made: list[int] = []
        for k, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            key = vocab[a] * width + vocab[b]
            self.rank.setdefault(key, k)
            self.pair.append(key)
            self.made.append(vocab[a + b])
        added = [t for t in spec["added_tokens"] if t["content"]]
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError(f"{path}: added tokens that take in their surroundings aren't supported")
        names = sorted((t["content"] for t in added), key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, names))) if names else None
        self.pieces = regex.compile(PRE_TOKEN).findall
        self.memo = TwoAges(MEMO)

    def count_bytes(self, data: bytes) -> int:
        """Tokens of one pre-token."""
        n = len(data)
        if n < 2:
            return n
        initial, rank, made, pair, width = self.initial, self.rank, self.made, self.pair, self.width
        ids = [initial[b] for b in data]
        heap = []
        for i in range(n - 1):
            r = rank.get(ids[i] * width + ids[i + 1])
            if r is not None:
                heap.append(r * n + i)  # lowest rank first, then leftmost
        if not heap:
            return n
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        left = n
        while heap:
            r, i = divmod(pop(heap), n)
            j = after[i]
            if j >= n or ids[i] < 0 or ids[i] * width + ids[j] != pair[r]:
                continue  # one of the two has merged meanwhile
            new = made[r]
            ids[i] = new
            ids[j] = -1
            k = after[i] = after[j]
            left -= 1
            if k < n:
                before[k] = i
                q = rank.get(new * width + ids[k])
                if q is not None:
                    push(heap, q * n + i)
            h = before[i]
            if h >= 0:
                q = rank.get(ids[h] * width + new)
                if q is not None:
                    push(heap, q * n + h)
        return left

    def count_plain(self, text: str) -> int:
        """Tokens of a text in which no added token is looked for."""
        memo = self.memo
        young, old = memo.young, memo.old
        total = 0
        for w in self.pieces(text):
            n = young.get(w)
            if n is None:
                n = old.get(w)
                if n is None:
                    n = self.count_bytes(w.encode())
                if len(w) <= MEMO_CHARS:
                    memo.put(w, n)
                    young, old = memo.young, memo.old
            total += n
        return total

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.added is None or not self.added.search(text):
            return self.count_plain(text)
        total = at = 0
        for m in self.added.finditer(text):
            total += 1 + self.count_plain(text[at : m.start()])
            at = m.end()
        return total + self.count_plain(text[at:])


def merger(path: str) -> PairMerger:
    return held(("merger", path), lambda: PairMerger(path))


def with_token_count(df: DataFrame, path: str, text_col: str = "text", out: str = "n_tokens") -> DataFrame:
    """``df`` with the number of tokens of each whole text; no shuffle, one pass."""
    small_batches(df.sparkSession)

    @arrow_udf("long")
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        count = merger(path).count
        for texts in batches:
            yield pa.array([count(t) for t in texts.to_pylist()], pa.int64())

    return df.withColumn(out, counted(F.col(text_col)))
