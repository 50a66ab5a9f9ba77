"""SentencePiece BPE: encoding by a merge-type prefix table, and decoding.

Every prefix of a text has a unique last token in its encoding. An automaton
over the vocabulary yields the tokens that end at a position; the last token of
that prefix is the one among them that is compatible with the last token of the
prefix before it, that is, whose encoding next to it leaves both whole. Walking
the table from the end gives the ids backwards. Two tokens are compatible if,
undoing the merges that made them in reverse order, no pair across their
border would have merged first.

No piece has the space mark after another character, so a text is cut before
each run of marks, and equal words share their result through a bounded memo.

Nulls are empty texts: no ids, and the empty string decoded. Rows are
independent, so repeated rows, extra columns and empty tables need no care; an
output column of a name that exists already replaces it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from trackloom.llm.common import TwoAges, held, small_batches

#: Fixed value: the character that stands for a space inside pieces.
MARK = "▁"

#: Words whose encodings a worker remembers, twice over at most; longer words are encoded anew.
MEMO = 50_000
MEMO_CHARS = 48
#: Pairs of tokens whose compatibility a worker remembers, twice over at most.
MEMO_PAIRS = 100_000


def merged_by_rank(symbols: list[str], rank: dict[str, int]) -> list[tuple[str, str, str]]:
    """The merges (left, right, whole) that byte-pair encoding makes of a few symbols, in order."""
    symbols, made = list(symbols), []
    while len(symbols) > 1:
        best = min(range(len(symbols) - 1), key=lambda i: (rank.get(symbols[i] + symbols[i + 1], len(rank)), i))
        whole = symbols[best] + symbols[best + 1]
        if whole not in rank:
            break
        made.append((symbols[best], symbols[best + 1], whole))
        symbols[best : best + 2] = [whole]
    return made


class PrefixTable:
    """Encoder and decoder for one SentencePiece BPE model."""

    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        kinds = [(sp.is_control(i), sp.is_byte(i), sp.is_unknown(i), sp.is_unused(i)) for i in range(n)]
        self.piece = [sp.id_to_piece(i) for i in range(n)]
        self.byte_id = {int(self.piece[i][3:5], 16): i for i in range(n) if kinds[i][1]}
        self.unknown = sp.unk_id()
        ids = [i for i in range(n) if not any(kinds[i])]
        if any(kinds[i][3] for i in range(n)):
            raise ValueError(f"{path}: unused pieces aren't supported")
        if any(re.search(f"[^{MARK}]{MARK}", self.piece[i]) for i in ids):
            raise ValueError(f"{path}: pieces with a space mark inside aren't supported")
        if sp.encode("  a  ", out_type=str) and sp.decode(sp.encode(" a ")) != " a ":
            raise ValueError(f"{path}: models that drop white space aren't supported")
        # Pieces of more than one character by descending score; of equal scores any is merged first, leftmost.
        long = sorted((i for i in ids if len(self.piece[i]) > 1), key=lambda i: (-sp.get_score(i), i))
        scores = {sp.get_score(i) for i in long if len(self.piece[i].strip(MARK))}
        if len(scores) < sum(1 for i in long if self.piece[i].strip(MARK)):
            raise ValueError(f"{path}: pieces of equal score aren't supported")
        rank, level = {}, -1
        for i in long:
            if not rank or sp.get_score(i) != level:
                at, level = len(rank), sp.get_score(i)
            rank[self.piece[i]] = at  # runs of marks share one score
        number = {self.piece[i]: i for i in ids}
        self.width = n
        #: By id: when it is made, -1 for single characters; and the two tokens it is made of.
        self.made_at = [-1] * n
        self.left, self.right = [-1] * n, [-1] * n
        whole = set(i for i in ids if len(self.piece[i]) == 1)
        for i in long:
            merges = merged_by_rank(list(self.piece[i]), rank)
            if merges and merges[-1][2] == self.piece[i]:
                a, b, _ = merges[-1]
                self.made_at[i], self.left[i], self.right[i] = rank[self.piece[i]], number[a], number[b]
                whole.add(i)
        #: For two tokens whose joined text is a piece: the rank of that merge.
        self.joins: dict[int, int] = {}
        for i in long:
            p = self.piece[i]
            for k in range(1, len(p)):
                a, b = number.get(p[:k]), number.get(p[k:])
                if a is not None and b is not None:
                    self.joins[a * n + b] = rank[p]
        self.ends = ahocorasick.Automaton()
        for i in whole:
            self.ends.add_word(self.piece[i], (len(self.piece[i]), i))
        self.ends.make_automaton()
        self.pairs = TwoAges(MEMO_PAIRS)
        self.memo = TwoAges(MEMO)
        self.name = [str(i) for i in range(n)]
        #: Text of each id, None for bytes.
        self.text = [None if kinds[i][1] else p.replace(MARK, " ") for i, p in enumerate(self.piece)]
        #: Nothing merges with a character that no piece has, so texts are also cut at line ends if that is one.
        self.cut_lines = not any("\n" in self.piece[i] for i in ids)
        self.words = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n" if self.cut_lines else f"{MARK}*[^{MARK}]+|{MARK}+").findall

    def compatible(self, a: int, b: int) -> bool:
        """Whether encoding the text of ``a`` followed by that of ``b`` gives just these two."""
        joins, made_at, width = self.joins, self.made_at, self.width
        until = 1 << 60  # when the pair at the border ceases to be adjacent
        cross_first = False  # of two merges of equal rank the left one is made first
        while True:
            r = joins.get(a * width + b)
            if r is not None and (r < until or r == until and cross_first):
                return False
            x, y = made_at[a], made_at[b]
            if x < 0 and y < 0:
                return True
            if x > y:
                until, cross_first = x, False
                a = self.right[a]
            else:
                until, cross_first = y, True
                b = self.left[b]

    def encode_word(self, word: str) -> list[int]:
        """Ids of a stretch of text whose marks are all at its beginning."""
        width, pairs, compatible = self.width, self.pairs, self.compatible
        known, known_before = pairs.young, pairs.old
        last = [-1] * (len(word) + 1)  # by length of the prefix; -1: none, or a character without a piece ends here
        done = 0
        for end, (size, t) in self.ends.iter(word):
            if end < done:
                continue  # this prefix has its last token
            before = last[end + 1 - size]
            if before >= 0 and size > 1:
                key = before * width + t
                ok = known.get(key)
                if ok is None:
                    ok = known_before.get(key)
                    if ok is None:
                        ok = compatible(before, t)
                    pairs.put(key, ok)
                    known, known_before = pairs.young, pairs.old
                if not ok:
                    continue
            # else the word begins with the token, or a character without a piece, with which nothing merges, comes before;
            # or a single character is left, since longer tokens come first: one of them must be the last
            done = end + 1
            last[done] = t
        ids, k, piece = [], len(word), self.piece
        while k:
            t = last[k]
            if t >= 0:
                ids.append(t)
                k -= len(piece[t])
            else:
                k -= 1
                if self.byte_id:
                    ids.extend([self.byte_id[b] for b in reversed(word[k].encode())])
                else:
                    ids.append(self.unknown)
        ids.reverse()
        return ids

    def plain(self, ids: list[int]) -> str:
        """Text of ids with all marks as spaces; byte pieces are joined to UTF-8."""
        try:
            return "".join([self.text[i] for i in ids])
        except TypeError:
            pass
        out, raw = [], bytearray()
        for i in ids:
            t = self.text[i]
            if t is None:
                raw.append(int(self.piece[i][3:5], 16))
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            out.append(t)
        return "".join(out) + raw.decode("utf-8", "replace")

    def decode(self, ids: list[int]) -> str:
        """Text of ids without the space that stands for the mark put in front."""
        text = self.plain(ids)
        return text[1:] if text.startswith(" ") else text

    def _entry(self, key: str) -> tuple[int, str, str]:
        """What a word's key stands for: see ``entries``."""
        memo = self.memo
        got = memo.old.get(key)
        if got is None:
            ids = self.encode_word(key[2:] if key.startswith("\n\n") else key if key.startswith("\n") else MARK + key)
            got = (len(ids), ",".join([self.name[i] for i in ids]), self.plain(ids))
        if len(key) <= MEMO_CHARS:
            memo.put(key, got)
        return got

    def entries(self, text: str) -> list[tuple[int, str, str]]:
        """(number of ids, ids joined by commas, text they stand for) of each word, in order.

        Words are looked up by keys: a word alone has a mark before it; a word after
        a line end comes with that; any other stretch has two line ends before it.
        """
        young, entry = self.memo.young.get, self._entry
        spaced = text.replace("\n", " \n")
        if self.cut_lines and "  " not in spaced and MARK not in spaced and spaced[0] != " ":
            keys = spaced.split(" ")
        else:
            keys = ["\n\n" + w for w in self.words(MARK + text.replace(" ", MARK))]
        out = []
        for w in keys:
            got = young(w)
            if got is None:
                got = entry(w)
                young = self.memo.young.get
            out.append(got)
        return out

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        return [int(i) for e in self.entries(text) if e[1] for i in e[1].split(",")]

    def summary(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, ids joined by commas, and the text decoded from them."""
        if not text:
            return 0, "", ""
        got = self.entries(text)
        decoded = "".join([e[2] for e in got])
        return sum([e[0] for e in got]), ",".join([e[1] for e in got]), decoded[1:] if decoded.startswith(" ") else decoded


def table(path: str) -> PrefixTable:
    return held(("table", path), lambda: PrefixTable(path))


def with_ids(df: DataFrame, path: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """``df`` with the ids of each whole text."""
    small_batches(df.sparkSession)

    @arrow_udf("array<int>")
    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        t = table(path)
        for texts in batches:
            yield pa.array([t.encode(x) for x in texts.to_pylist()], pa.list_(pa.int32()))

    return df.withColumn(out, encoded(F.col(text_col)))


def with_decoded(df: DataFrame, path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the text that each list of ids decodes to."""
    small_batches(df.sparkSession)

    @arrow_udf("string")
    def decoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        t = table(path)
        for ids in batches:
            yield pa.array([t.decode(x or []) for x in ids.to_pylist()], pa.string())

    return df.withColumn(out, decoded(F.col(ids_col)))


def with_round_trip(df: DataFrame, path: str, text_col: str = "text", out: str = "spm") -> DataFrame:
    """``df`` with a struct of n_tokens, ids (as text, comma-joined) and the decoded text, made in one pass."""
    small_batches(df.sparkSession)
    kind = pa.struct([("n_tokens", pa.int64()), ("ids", pa.string()), ("decoded", pa.string())])

    @arrow_udf("n_tokens long, ids string, decoded string")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        t = table(path)
        for texts in batches:
            n, ids, text = [list(x) for x in zip(*map(t.summary, texts.to_pylist()))] or ([], [], [])
            yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string())], fields=list(kind))

    return df.withColumn(out, both(F.col(text_col)))


def with_digests(df: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """``df`` with n_tokens, ids_sha256 and decoded_sha256; the digests are made next to the ids, so those don't travel."""
    import hashlib

    small_batches(df.sparkSession)
    names = ["n_tokens", "ids_sha256", "decoded_sha256"]

    @arrow_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digests(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        t, sha = table(path), hashlib.sha256
        for texts in batches:
            cols: list[list] = [[], [], []]
            for x in texts.to_pylist():
                n, ids, text = t.summary(x)
                cols[0].append(n)
                cols[1].append(sha(ids.encode()).hexdigest())
                cols[2].append(sha(text.encode()).hexdigest())
            yield pa.StructArray.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())], names=names)

    got = df.withColumn("_spm", digests(F.col(text_col)))
    return got.select(*[c for c in df.columns if c not in names], *[F.col(f"_spm.{n}").alias(n) for n in names])
