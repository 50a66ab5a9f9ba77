"""Toxicity by a bidirectional gated recurrent network with attention pooling.

Inputs are words and characters. A word is the embedding of the word itself and how
much oftener toxic training documents have it, if it is in the vocabulary (the
most frequent words), beside what its characters say: each character, with two on
either side, gives a state (the sum of an embedding for each of the five places,
through tanh), and attention of ``HEADS`` heads weighs the states of a word's
characters into as many vectors. So words unseen in training, misspelt ones among
them, are known by their characters. Two gated recurrent networks read a window of
``SPAN`` words in either direction, attention weighs their states into one vector,
and a linear layer gives the window's logit. A document's windows overlap by half
and cover its whole text; its logit is the largest of its windows'.

Words are runs of digits, letters and what isn't ASCII, lower-cased; a sign such as
* or @ between two of these is part of a word. Longer runs than ``LONGEST`` bytes
are read in pieces of that length.

Everything is numpy, training too: Adam on windows chosen anew each round, the
highest-scoring window of every training document (so clean documents contribute
their hardest windows) and random windows of clean ones. The frequencies a window is
given in training are those of documents of other folds than its own. Meanwhile some
words have a letter inside replaced, doubled or left out, and some are hidden from
the vocabulary, whatever the label. At the end the threshold between the classes is
placed at score 0.5.

* Null texts, empty texts and texts without a word score 0. Very long texts are
  read whole, ``CHUNK`` characters of text at a time at least.
* Labels other than 0 and 1 are left out; of several labels of an id the largest
  counts. Null ids are never learned from. Without labelled rows of both classes
  every text scores 0.
* Repeated rows each get their result; extra columns stay; an output column of a
  name that exists replaces it; empty tables give empty results.

The fit is bounded: ``TOXIC_DOCS`` and ``CLEAN_DOCS`` labelled rows by a hash of
the id, of those of at most ``LONGEST_TEXT`` characters, each learned from whole. The
model, 1 MB, is broadcast. Scoring is one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from trackloom.llm.common import held, small_batches

TOXIC_DOCS, CLEAN_DOCS, LONGEST_TEXT = 700, 1500, 16_000
SPAN, STEP = 32, 16
#: Bytes of a word, and places on either side that a character is seen with.
LONGEST, SIDE = 24, 2
WORD_DIM, CHAR_DIM, HEADS, HIDDEN, ATTEND = 6, 24, 2, 8, 8
WORDS = 12_000
ROUNDS, PASSES, BATCH, RATE, FOLDS = 5, 4, 256, 0.012, 5
#: Shares of a batch's words that are misspelt, and that are hidden from the vocabulary.
MISSPELT, HIDDEN_WORDS = 0.5, 0.3
#: Bytes of text that are looked at together.
CHUNK = 1 << 18

IS_WORD = np.zeros(256, bool)
IS_WORD[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(128, 256)]] = True
IS_SIGN = np.zeros(256, bool)
IS_SIGN[list(b"*@$!#%&+|~^")] = True
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)

class Powers:
    """Powers of the hash base and of its inverse, by position; grown as needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            self.up, self.down = (np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, b, np.uint64))]) for b in (BASE, INVERSE))
        return self.up, self.down


POWERS = Powers()


def mix(h: np.ndarray, kind: int) -> np.ndarray:
    h = h + np.uint64(kind * 0xD6E8FEB86659FD93 & (1 << 64) - 1)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ h >> np.uint64(32)


class Words:
    """The words of some texts: how many each has, the distinct ones' hashes and bytes, and which one each word is."""

    def __init__(self, texts: list[str | None]):
        raw = [t.lower().encode() if t else b"" for t in texts]
        size = np.array([len(r) + 1 for r in raw], np.int64)
        data = np.frombuffer(b" ".join(raw) + b" ", np.uint8) if raw else np.zeros(0, np.uint8)
        inside = IS_WORD[data]
        inside[1:-1] |= IS_SIGN[data[1:-1]] & inside[:-2] & inside[2:]
        turn = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if len(inside) and inside[0]:
            turn = np.concatenate([np.zeros(1, np.int64), turn])
        start, end = turn[0::2], turn[1::2]
        parts = -(-(end - start) // LONGEST)
        nth = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
        start, end = np.repeat(start, parts) + nth * LONGEST, np.repeat(end, parts)
        end = np.minimum(end, start + LONGEST)
        self.count = np.bincount(np.searchsorted(np.cumsum(size), start, side="right"), minlength=len(texts))
        up, down = POWERS.to(len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
        self.hash, first, self.which = np.unique(mix((total[end] - total[start]) * down[start], 0), return_index=True, return_inverse=True)
        at = start[first][:, None] + np.arange(LONGEST)
        self.bytes = np.where(at < end[first][:, None], data[np.minimum(at, len(data) - 1)], 0).astype(np.uint8) if len(data) else np.zeros((0, LONGEST), np.uint8)


class Slots:
    """Hash to index, 0 if unknown: one probe of a table of 2**20, checked by 32 more bits."""

    BITS = 20

    def __init__(self, keys: np.ndarray):
        """keys: by falling importance; of keys of one slot the first stays."""
        slot = keys >> np.uint64(64 - self.BITS)
        _, first = np.unique(slot, return_index=True)
        self.keys = keys[np.sort(first)]
        self.fill()

    def fill(self) -> None:
        slot = (self.keys >> np.uint64(64 - self.BITS)).astype(np.int64)
        self.index = np.zeros(1 << self.BITS, np.int32)
        self.check = np.zeros(1 << self.BITS, np.uint32)
        self.index[slot] = np.arange(1, len(self.keys) + 1)
        self.check[slot] = self.keys.astype(np.uint32)

    def __getstate__(self):
        return {"keys": self.keys}

    def __setstate__(self, state):
        self.keys = state["keys"]
        self.fill()

    def __call__(self, h: np.ndarray) -> np.ndarray:
        slot = (h >> np.uint64(64 - self.BITS)).astype(np.int64)
        return np.where(self.check[slot] == h.astype(np.uint32), self.index[slot], 0)


def vocabulary_of(hashes: np.ndarray, docs: np.ndarray, most: int) -> Slots:
    """The words that most documents have, two at least; docs: the number of documents with each."""
    order = np.argsort(-docs, kind="stable")
    return Slots(hashes[order[docs[order] >= 2][:most]])


def telling(seen: np.ndarray, n_toxic: float, n_clean: float) -> np.ndarray:
    """How much oftener toxic documents have each word (log, shrunk), from the numbers of clean and toxic documents with it; the first word is none."""
    b, a = seen[:, 0], seen[:, 1]
    told = (np.log((a + 0.5) / (n_toxic + 1)) - np.log((b + 0.5) / (n_clean + 1))) * (a + b) / (a + b + 6) / 2
    told[0] = 0
    return told.astype(np.float32)


def blocks(texts: list[str | None], size: int) -> Iterator[tuple[int, int]]:
    """Stretches of texts of about so many characters together, one text at least."""
    at = 0
    while at < len(texts):
        upto, total = at, 0
        while upto < len(texts) and (upto == at or total < size):
            total += len(texts[upto] or "")
            upto += 1
        yield at, upto
        at = upto


def windows(count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lay texts of ``count`` words out for reading: (index of the word at each place, with the number of words for none; first place of each window; its text).

    A text without a word has no window.
    """
    n = np.where(count > 0, np.maximum(0, -(-(count - SPAN) // STEP)) + 1, 0)
    room = np.where(n > 0, (n - 1) * STEP + SPAN, 0)
    base = np.cumsum(room) - room
    total = int(count.sum())
    place = np.repeat(base - (np.cumsum(count) - count), count) + np.arange(total)
    stream = np.full(int(room.sum()), total, np.int64)
    stream[place] = np.arange(total)
    owner = np.repeat(np.arange(len(count)), n)
    first = np.repeat(base, n) + (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)) * STEP
    return stream, first, owner


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def misspelt(words: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Words (rows of bytes) of four bytes or more with one inside replaced, doubled or left out; shorter ones as they are."""
    size = (words > 0).sum(axis=1)
    col = np.arange(LONGEST)
    at = 1 + (rng.random(len(words)) * np.maximum(size - 2, 1)).astype(np.int64)
    kind = np.where(size >= 4, rng.integers(0, 4, len(words)), 4)
    source = col - ((kind == 1)[:, None] & (col > at[:, None])) + ((kind == 2)[:, None] & (col >= at[:, None]))
    out = np.where(source < LONGEST, np.take_along_axis(words, np.minimum(source, LONGEST - 1), 1), 0).astype(np.uint8)
    other = np.frombuffer(b"*@$!" + b"abcdefghijklmnopqrstuvwxyz", np.uint8)
    put = np.flatnonzero((kind == 0) | (kind == 3))
    out[put, at[put]] = np.where(kind[put] == 0, other[rng.integers(0, 4, len(put))], other[rng.integers(0, len(other), len(put))])
    return out


class Network:
    """Weights, the forward pass over many windows, and gradients."""

    def __init__(self, vocabulary: Slots, told: np.ndarray, words: np.ndarray, seed: int = 7):
        """words: the bytes of the vocabulary's words; the first row is none."""
        rng = np.random.default_rng(seed)
        self.vocabulary, self.told, self.spelt = vocabulary, told, words
        self.known: np.ndarray | None = None
        self.shift = 0.0
        dim = WORD_DIM + 1 + HEADS * CHAR_DIM

        def small(*shape: int, by: float) -> np.ndarray:
            return (rng.standard_normal(shape) * by).astype(np.float32)

        self.p = {"word": small(len(vocabulary.keys) + 1, WORD_DIM, by=0.1)}
        self.p |= {f"char{k}": small(256, CHAR_DIM, by=0.3) for k in range(2 * SIDE + 1)}
        self.p |= {"char_b": np.zeros(CHAR_DIM, np.float32), "char_a": small(CHAR_DIM, HEADS, by=0.5)}
        for way in "fb":
            self.p |= {f"w{way}": small(dim, 3 * HIDDEN, by=0.3), f"u{way}": small(HIDDEN, 3 * HIDDEN, by=0.3), f"c{way}": np.zeros(3 * HIDDEN, np.float32)}
        self.p |= {"wa": small(2 * HIDDEN, ATTEND, by=0.3), "ba": np.zeros(ATTEND, np.float32), "va": small(ATTEND, by=0.3), "wo": small(2 * HIDDEN, by=0.3), "bo": np.zeros(1, np.float32)}

    def characters(self, words: np.ndarray, keep: list | None = None) -> np.ndarray:
        """What the characters of each word (a row of bytes, one at least) say."""
        p = self.p
        wide = np.zeros((len(words), LONGEST + 2 * SIDE), np.uint8)
        wide[:, SIDE:-SIDE] = words
        real = words > 0
        codes = [wide[:, k : k + LONGEST][real] for k in range(2 * SIDE + 1)]
        h = p["char0"][codes[0]] + p["char_b"]
        for k in range(1, 2 * SIDE + 1):
            h += p[f"char{k}"][codes[k]]
        np.tanh(h, out=h)
        size = real.sum(axis=1)
        first = np.cumsum(size) - size
        e = h @ p["char_a"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), size, axis=0)) if len(words) else e
        e /= np.repeat(np.add.reduceat(e, first), size, axis=0) if len(words) else 1
        out = np.concatenate([np.add.reduceat(h * e[:, k : k + 1], first) for k in range(HEADS)], 1) if len(words) else np.zeros((0, HEADS * CHAR_DIM), np.float32)
        if keep is not None:
            keep += [codes, h, e, size, first]
        return out

    def embed(self, index: np.ndarray, told: np.ndarray, words: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Inputs of words, given their index in the vocabulary, how telling they are, and their bytes."""
        return np.concatenate([self.p["word"][index], told[:, None], self.characters(words, keep)], 1)

    def run(self, way: str, x: np.ndarray, first: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States (place, window, unit) of one direction; x: input products by place of the stream."""
        u = self.p[f"u{way}"]
        h = np.zeros((len(first), HIDDEN), np.float32)
        out = np.empty((SPAN, len(first), HIDDEN), np.float32)
        for t in range(SPAN) if way == "f" else range(SPAN - 1, -1, -1):
            a = x[first + t]
            q = h @ u
            gate = 1 / (1 + np.exp(-(a[:, : 2 * HIDDEN] + q[:, : 2 * HIDDEN])))
            z, r = gate[:, :HIDDEN], gate[:, HIDDEN:]
            n = np.tanh(a[:, 2 * HIDDEN :] + r * q[:, 2 * HIDDEN :])
            if keep is not None:
                keep.append((t, h, z, r, n, q[:, 2 * HIDDEN :]))
            h = n + z * (h - n)
            out[t] = h
        return out

    def products(self, way: str, x: np.ndarray, stream: np.ndarray) -> np.ndarray:
        """Input products by place; places without a word have those of a zero input."""
        made = np.empty((len(x) + 1, 3 * HIDDEN), np.float32)
        np.matmul(x, self.p[f"w{way}"], out=made[:-1])
        made[-1] = 0
        made += self.p[f"c{way}"]
        return made[stream]

    def pooled(self, h: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Attention over places: (logits, weights, tanh layer, pooled states)."""
        p = self.p
        u = np.tanh(h @ p["wa"] + p["ba"])
        e = np.where(real, u @ p["va"], np.float32(-1e9))
        e = np.exp(e - e.max(axis=0))
        e /= e.sum(axis=0)
        c = np.einsum("tb,tbk->bk", e, h)
        return c @ p["wo"] + p["bo"][0], e, u, c

    def logits(self, x: np.ndarray, stream: np.ndarray, first: np.ndarray, block: int = 2048) -> np.ndarray:
        """A logit for each window."""
        if not len(first):
            return np.zeros(0, np.float32)
        by_way = {way: self.products(way, x, stream) for way in "fb"}
        out = np.empty(len(first), np.float32)
        places = np.arange(SPAN)[:, None]
        for at in range(0, len(first), block):
            own = first[at : at + block]
            h = np.concatenate([self.run(way, by_way[way], own) for way in "fb"], 2)
            out[at : at + block] = self.pooled(h, stream[own + places] < len(x))[0]
        return out

    def gradients(self, place: np.ndarray, index: np.ndarray, told: np.ndarray, words: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross entropy over windows; place (window, place): a row of the words, -1 for no word."""
        p, b = self.p, len(label)
        spelt: list = []
        x = self.embed(index, told, words, spelt)
        stream = np.where(place >= 0, place, len(x)).reshape(-1)
        first = np.arange(b) * SPAN
        kept: dict[str, list] = {"f": [], "b": []}
        h = np.concatenate([self.run(way, self.products(way, x, stream), first, kept[way]) for way in "fb"], 2)
        logit, e, u, c = self.pooled(h, (place >= 0).T)
        d = ((sigmoid(logit) - label) / b).astype(np.float32)
        out = {"wo": c.T @ d, "bo": np.array([d.sum()], np.float32)}
        dc = d[:, None] * p["wo"]
        dh = e[:, :, None] * dc
        de = np.einsum("bk,tbk->tb", dc, h)
        ds = e * (de - (e * de).sum(axis=0))
        du = ds[:, :, None] * p["va"] * (1 - u * u)
        out["va"] = np.einsum("tb,tbk->k", ds, u)
        out["ba"] = du.sum(axis=(0, 1))
        out["wa"] = np.einsum("tbi,tbj->ij", h, du, optimize=True)
        dh += du @ p["wa"].T
        dx = np.zeros_like(x)
        for way, part in (("f", dh[:, :, :HIDDEN]), ("b", dh[:, :, HIDDEN:])):
            u_ = p[f"u{way}"]
            gu = np.zeros_like(u_)
            da_all = np.zeros((b, SPAN, 3 * HIDDEN), np.float32)
            back = np.zeros((b, HIDDEN), np.float32)
            for t, hp, z, r, n, q in reversed(kept[way]):
                back = back + part[t]
                dn = back * (1 - z) * (1 - n * n)
                dz = back * (hp - n) * z * (1 - z)
                dr = dn * q * r * (1 - r)
                da_all[:, t] = np.concatenate([dz, dr, dn], 1)
                dq = np.concatenate([dz, dr, dn * r], 1)
                gu += hp.T @ dq
                back = back * z + dq @ u_.T
            out[f"u{way}"] = gu
            da = scattered(stream, da_all.reshape(-1, 3 * HIDDEN), len(x) + 1)  # by word: the same word has the same products
            out[f"c{way}"] = da.sum(axis=0)
            out[f"w{way}"] = x.T @ da[:-1]
            dx += da[:-1] @ p[f"w{way}"].T
        out["word"] = scattered(index, dx[:, :WORD_DIM], len(p["word"]))
        codes, h, e, size, first = spelt
        dh = np.zeros_like(h)
        out["char_a"] = np.zeros_like(p["char_a"])
        for k in range(HEADS):
            at = WORD_DIM + 1 + k * CHAR_DIM
            dv = np.repeat(dx[:, at : at + CHAR_DIM], size, axis=0)
            de = (dv * h).sum(axis=1)
            ds = e[:, k] * (de - np.repeat(np.add.reduceat(e[:, k] * de, first), size))
            out["char_a"][:, k] = h.T @ ds
            dh += dv * e[:, k : k + 1] + ds[:, None] * p["char_a"][:, k]
        dh *= 1 - h * h
        out["char_b"] = dh.sum(axis=0)
        for k, own in enumerate(codes):
            out[f"char{k}"] = scattered(own, dh, 256)
        return out

    def inputs(self, own: Words) -> np.ndarray:
        """Inputs of distinct words; those of the vocabulary are made once."""
        if self.known is None:
            self.known = self.in_blocks(np.arange(len(self.told)), self.spelt)
        index = self.vocabulary(own.hash)
        x = self.known[index]
        new = np.flatnonzero(index == 0)
        x[new] = self.in_blocks(index[new], own.bytes[new])
        return x

    def in_blocks(self, index: np.ndarray, words: np.ndarray, size: int = 2048) -> np.ndarray:
        """``embed`` a block at a time, which bounds its memory."""
        parts = [self.embed(index[k : k + size], self.told[index[k : k + size]], words[k : k + size]) for k in range(0, len(index), size)]
        return np.concatenate(parts) if parts else np.zeros((0, WORD_DIM + 1 + HEADS * CHAR_DIM), np.float32)

    def __getstate__(self):
        return self.__dict__ | {"known": None}

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Score of each whole text; 0 without a word."""
        out = np.zeros(len(texts))
        for at, upto in blocks(texts, CHUNK):
            own = Words(texts[at:upto])
            stream, first, owner = windows(own.count)
            logit = self.logits(self.inputs(own), np.append(own.which, len(own.hash))[stream], first)
            best = np.full(upto - at, -np.inf)
            np.maximum.at(best, owner, logit)
            out[at:upto] = np.where(own.count > 0, sigmoid(best - self.shift), 0.0)
        return out


def scattered(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    out = np.empty((n, rows.shape[1]), np.float32)
    for k in range(rows.shape[1]):
        out[:, k] = np.bincount(at, weights=rows[:, k], minlength=n)
    return out


def threshold(logit: np.ndarray, toxic: np.ndarray) -> float:
    """Where to split so that the share of errors, a false alarm counting twice, is least; the middle of the widest such gap."""
    order = np.argsort(logit, kind="stable")
    x, y = logit[order], toxic[order]
    missed = np.concatenate([[0], np.cumsum(y)]) / max(1, y.sum())
    false = ((1 - y).sum() - np.concatenate([[0], np.cumsum(1 - y)])) / max(1, (1 - y).sum())
    edge = np.concatenate([[x[0] - 1], (x[1:] + x[:-1]) / 2, [x[-1] + 1]])
    gap = np.concatenate([[0], x[1:] - x[:-1], [0]])
    loss = missed + 2 * false
    best = np.flatnonzero(loss <= loss.min() + 1e-12)
    return float(edge[best[np.argmax(gap[best])]])


def train(texts: list[str], labels: list[int], seed: int = 7) -> Network | None:
    """A network from whole labelled texts; None without both classes."""
    toxic = np.array(labels, np.float64)
    if not len(toxic) or toxic.min() == toxic.max():
        return None
    rng = np.random.default_rng(seed)
    laid = [(at, Words(texts[at:upto])) for at, upto in blocks(texts, CHUNK)]  # blocks bound the memory that training takes
    hashes, first = np.unique(np.concatenate([own.hash for _, own in laid]), return_index=True)
    if not len(hashes):
        return None
    words = np.concatenate([own.bytes for _, own in laid])[first]
    # which documents have which words, and of every block the word at each place of its windows
    held, place, owner, streams = [], [], [], []
    for at, own in laid:
        which = np.searchsorted(hashes, own.hash)[own.which]
        held.append(np.unique(np.repeat(np.arange(at, at + len(own.count)), own.count) * len(hashes) + which))
        stream, first, mine = windows(own.count)
        stream = np.append(which, -1)[stream].astype(np.int32)
        streams.append((stream, first))
        place.append(stream[first[:, None] + np.arange(SPAN)])
        owner.append(mine + at)
    del laid
    place, owner, held = np.concatenate(place), np.concatenate(owner), np.concatenate(held)
    doc, word = held // len(hashes), held % len(hashes)
    vocabulary = vocabulary_of(hashes, np.bincount(word, minlength=len(hashes)), WORDS)
    index = vocabulary(hashes)
    size = len(vocabulary.keys) + 1
    fold = rng.permutation(len(texts)) % FOLDS
    seen = np.stack([np.bincount(fold[doc[own]] * size + index[word[own]], minlength=FOLDS * size).reshape(FOLDS, size) for own in (toxic[doc] == 0, toxic[doc] == 1)], 2)
    docs = np.stack([np.bincount(fold, toxic == y, FOLDS) for y in (0, 1)], 1)
    told = [telling(seen.sum(axis=0) - seen[f], *(docs.sum(axis=0) - docs[f])[::-1]) for f in range(FOLDS)]
    spelt = np.full((size, LONGEST), ord(" "), np.uint8) * (np.arange(LONGEST) == 0)  # the first, none, has one character
    spelt[index[index > 0]] = words[index > 0]
    net = Network(vocabulary, telling(seen.sum(axis=0), *docs.sum(axis=0)[::-1]), spelt.astype(np.uint8), seed)
    fold = fold[owner]
    clean = np.flatnonzero(toxic[owner] == 0)
    moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    step = 0
    logit = np.empty(len(place), np.float32)
    for f, own in enumerate(told):  # before any training: the most telling word
        logit[fold == f] = np.where(place[fold == f] >= 0, own[index][place[fold == f]], -9).max(axis=1)
    for round_ in range(ROUNDS):
        order = np.lexsort((-logit, owner))
        top = order[np.concatenate([[True], owner[order][1:] != owner[order][:-1]])]
        more = rng.choice(clean, min(len(clean), 2 * len(texts)), replace=False)
        chosen = np.unique(np.concatenate([top, more]))
        for pass_ in range(PASSES):
            order = rng.permutation(chosen)
            parts = [own[at : at + BATCH] for f in range(FOLDS) for own in (order[fold[order] == f],) for at in range(0, len(own), BATCH)]
            rate = RATE * (1 - (round_ * PASSES + pass_) / (ROUNDS * PASSES)) ** 0.5
            for k in rng.permutation(len(parts)):
                pick = parts[k]
                seen, own = np.unique(place[pick], return_inverse=True)
                own = own.reshape(place[pick].shape) - (seen[0] < 0)
                seen = seen[seen >= 0]
                wrong = rng.random(len(seen)) < MISSPELT
                spelt = np.where(wrong[:, None], misspelt(words[seen], rng), words[seen])
                known = np.where(wrong | (rng.random(len(seen)) < HIDDEN_WORDS), 0, index[seen])
                grad = net.gradients(own, known, np.where(known, told[fold[pick[0]]][index[seen]], np.float32(0)), spelt, toxic[owner[pick]].astype(np.float32))
                step += 1
                for k, d in grad.items():
                    m, v = moment[k]
                    m *= 0.9
                    m += 0.1 * d
                    v *= 0.99
                    v += 0.01 * d * d
                    net.p[k] -= np.float32(rate / (1 - 0.9**step)) * m / (np.sqrt(v / np.float32(1 - 0.99**step)) + np.float32(1e-6))
        x = net.in_blocks(index, words)
        logit = np.concatenate([net.logits(x, np.where(stream < 0, len(x), stream), first) for stream, first in streams])
    best = np.full(len(texts), -np.inf)
    np.maximum.at(best, owner, logit)
    read = np.isfinite(best)
    net.shift = threshold(best[read], toxic[read])
    return net


def fit(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Network | None:
    """Train on a bounded sample of the labelled documents for which ``learn``, a condition on the id, holds."""
    own = labels.where(learn & F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.max(label_col).cast("int").alias("y"))
    ranked = own.withColumn("h", F.xxhash64(F.col(id_col).cast("string"), F.lit("toxicity")))
    drawn = [ranked.where(F.col("y") == y).orderBy("h", id_col).limit(n) for y, n in ((1, TOXIC_DOCS), (0, CLEAN_DOCS))]
    sample = drawn[0].unionByName(drawn[1]).select(F.col(id_col).alias("_i"), "y", "h")  # at most TOXIC_DOCS + CLEAN_DOCS rows

    short = docs.where(F.length(text_col) <= LONGEST_TEXT).select(F.col(id_col).alias("_i"), F.col(text_col).alias("_t"))
    rows = short.join(F.broadcast(sample), "_i").select("h", "y", F.col("_t").alias("t")).distinct().collect()
    rows.sort(key=lambda r: (r.h, r.t))
    return train([r.t for r in rows], [r.y for r in rows])


def with_toxicity(df: DataFrame, net: Network | None, text_col: str = "text", out: str = "toxicity") -> DataFrame:
    """``df`` with the score of each whole text, 0 to 1."""
    if net is None:
        return df.withColumn(out, F.lit(0.0))
    small_batches(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(net)

    @arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = held("toxicity", lambda: None) or sent.value
        for texts in batches:
            yield pa.array(own.scores(texts.to_pylist()))

    return df.withColumn(out, scored(F.col(text_col)))
