"""Byte-level BPE encoding and decoding by prefix dynamic programming.

Of all token sequences that spell a byte string, BPE yields exactly one, and every prefix
of the string has one too. The last token of a prefix's own encoding is therefore unique,
and it is the only token t that ends the prefix such that (last token of the rest, t) is a
*stable pair*: encoding the bytes of the two tokens gives those two tokens again. One array
with that last token for each prefix holds the encodings of all prefixes: bytes can be
appended at the cost of the new bytes, and after an edit only the positions up to where
the array agrees with the old one again are computed anew.

Text is first split by a pattern, each match being encoded separately.

Defined results: null or empty text has no tokens (n_tokens 0, the hash of no bytes);
texts of any length are encoded whole, in memory linear in the text; repeated and tied
rows each give a row; an empty table gives an empty table; other columns pass through
``encode`` untouched (an input column named like an output column is an error).
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Matches that begin with the same HEAD bytes share the last tokens of these prefixes and are continued by appending.
HEAD = 6
#: Ids are below 2 ** LEFT; a pair of ids is kept as one number.
LEFT = 24

PATTERN_COLUMNS = ("n_tokens", "ids_sha256", "decoded_sha256")


class BytePairs:
    """A rank vocabulary with the stable-pair test and the reversed trie of its tokens."""

    def __init__(self, ranks: dict[bytes, int], pair_cache: int = 1_000_000):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.pair_cache = pair_cache
        self._pairs: dict[int, bool] = {}
        #: Tokens by their last bytes: a byte leads to the rank of what has been read (-1: no token) and to the bytes before.
        self._trie: dict[int, list] = {}
        for token, rank in ranks.items():
            before = self._trie
            for byte in reversed(token):
                node = before.setdefault(byte, [-1, {}])
                before = node[1]
            node[0] = rank
        self._own: dict[int, bool] = {}

    def merge(self, data: bytes) -> list[int]:
        """Plain BPE of a short byte string: merge the lowest-ranked neighbours, leftmost first."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], 1 << 60))
            if parts[best] + parts[best + 1] not in self.ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return [self.ranks[p] for p in parts]

    def reachable(self, token: int) -> bool:
        """Whether the token's bytes encode to the token itself."""
        if token not in self._own:
            self._own[token] = self.merge(self.tokens[token]) == [token]
        return self._own[token]

    def stable(self, left: int, right: int) -> bool:
        key = (left << LEFT) + right
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) >= self.pair_cache:
                self._pairs.clear()
            known = self._pairs[key] = self.merge(self.tokens[left] + self.tokens[right]) == [left, right]
        return known


class PrefixTable:
    """The last token of every prefix of a byte string, open to appends and edits."""

    def __init__(self, pairs: BytePairs, data: bytes = b"", last: Iterable[int] = ()):
        """``last``: the last tokens of the first prefixes, where they are known."""
        self.pairs = pairs
        self.data = bytearray(data)
        self.last: list[int] = list(last)
        self._fill(len(self.last), len(data))

    def _fill(self, start: int, stop: int) -> None:
        """Last tokens of the prefixes that end at start+1 .. stop; those before are known."""
        pairs, data, last = self.pairs, self.data, self.last
        root, known, shift = pairs._trie, pairs._pairs, 1 << LEFT
        for end in range(start + 1, stop + 1):
            before, at = root, end
            while at:
                at -= 1
                node = before.get(data[at])
                if node is None:
                    raise ValueError("a byte is missing from the vocabulary")
                token, before = node
                if token >= 0:
                    if not at:
                        if pairs.reachable(token):
                            break
                    elif (good := known.get(last[at - 1] * shift + token)) or (
                        good is None and pairs.stable(last[at - 1], token)
                    ):
                        break
            else:
                raise ValueError("a byte is missing from the vocabulary")
            last.append(token)

    def append(self, more: bytes) -> None:
        self.data += more
        self._fill(len(self.last), len(self.data))

    def replace(self, start: int, stop: int, new: bytes) -> int:
        """Replace bytes start:stop; return how many positions were computed anew.

        Last tokens depend on at most as many earlier positions as the longest token has
        bytes; once so many in a row equal the old ones, all that follow are the old ones.
        """
        tail_bytes, tail_last = self.data[stop:], self.last[stop:]
        del self.data[start:], self.last[start:]
        self.append(new)
        self.data += tail_bytes
        longest = max(map(len, self.pairs.ranks))
        same, done = 0, len(new)
        for i, old in enumerate(tail_last):
            self._fill(len(self.last), len(self.last) + 1)
            token = self.last[-1]
            done += 1
            # the old value only carries over when its whole token lies in the tail
            same = same + 1 if token == old else 0
            if same >= longest:
                self.last += tail_last[i + 1 :]
                break
        return done

    def ids(self, end: int | None = None) -> list[int]:
        """Token ids of the whole string, or of its first ``end`` bytes."""
        out, at = [], len(self.last) if end is None else end
        while at:
            token = self.last[at - 1]
            out.append(token)
            at -= len(self.pairs.tokens[token])
        return out[::-1]


class Codec:
    """Texts to ids and back. ``cache`` bounds the pieces and words that a process remembers."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, cache: int = 300_000):
        self.pairs = BytePairs(ranks)
        self.split = regex.compile(pattern).findall
        self.cache = cache
        self._pieces: dict[str, str] = {}
        self._heads: dict[bytes, list[int]] = {}
        #: Ids of a word at the start of a line, and of a word after one blank.
        self._words: tuple[dict[str, str | None], dict[str, str | None]] = ({}, {})
        self._bytes = {str(rank): token for rank, token in self.pairs.tokens.items()}

    def _piece(self, piece: str) -> str:
        """The ids of a match of the pattern, each after a blank."""
        known = self._pieces.get(piece)
        if known is None:
            if len(self._pieces) >= self.cache:
                self._pieces.clear()
            data = piece.encode("utf-8", "surrogatepass")
            whole = self.pairs.ranks.get(data)
            if whole is not None and self.pairs.reachable(whole):
                known = f" {whole}"
            else:
                head, last = data[:HEAD], ()
                if len(data) > HEAD and (last := self._heads.get(head)) is None:
                    if len(self._heads) >= self.cache:
                        self._heads.clear()
                    last = self._heads[head] = PrefixTable(self.pairs, head).last
                known = "".join([f" {i}" for i in PrefixTable(self.pairs, data, last).ids()])
            if len(piece) <= 64:
                self._pieces[piece] = known
        return known

    def _word(self, blank: bool, word: str) -> str | None:
        """None for a word that is empty or borders on white space: its matches can reach beyond it."""
        if not word or word[-1].isspace() or word[0].isspace():
            return None
        if len(self._words[blank]) >= self.cache:
            self._words[blank].clear()
        known = "".join([self._piece(p) for p in self.split(" " + word if blank else word)])
        if len(word) <= 64:
            self._words[blank][word] = known
        return known

    def joined(self, text: str) -> str:
        """Decimal ids, each after a blank.

        A match never holds white space after another character, so where a line break or a
        single blank stands between two other characters, a match ends before it. Words
        between such places recur and are looked up; texts with other white space at a
        word's border are split by the pattern as a whole.
        """
        if not text:
            return ""
        if "\n\n\n" not in text and not text.endswith("\n\n"):
            out: list[str | None] = []
            (first, later), newline = self._words, self._piece("\n")
            for k, line in enumerate(text.split("\n")):
                if k:
                    out.append(newline)
                if line:
                    words = line.split(" ")
                    ids = first.get(words[0])
                    out.append(self._word(False, words[0]) if ids is None else ids)
                    del words[0]
                    found = list(map(later.get, words))
                    if None in found:
                        found = [self._word(True, w) if x is None else x for w, x in zip(words, found, strict=True)]
                    out += found
            if None not in out:
                return "".join(out)
        return "".join(map(self._piece, self.split(text)))

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for i in self.joined(text or "").split()]

    def decode(self, ids: Iterable[int]) -> bytes:
        """The bytes that ids stand for; an id outside the vocabulary is an error."""
        return b"".join([self.pairs.tokens[i] for i in ids])

    def digests(self, text: str | None) -> tuple[int, str, str]:
        ids = self.joined(text or "")[1:]
        listed = ids.split(" ") if ids else []
        back = b"".join(map(self._bytes.__getitem__, listed))
        return len(listed), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(back).hexdigest()


def read_ranks(path: str) -> dict[bytes, int]:
    """The rank file of a byte-level vocabulary: lines of base64 token and rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One codec for each vocabulary and Python worker; its caches outlive a task."""
    return Codec(read_ranks(path), pattern)


def _vacant(df: DataFrame, name: str) -> None:
    if name.lower() in (c.lower() for c in df.columns):
        raise ValueError(f"the table has a column {name} already")


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Adds ``out``: array of the text's token ids. An input column of that name is an error."""
    _vacant(docs, out)

    @F.pandas_udf("array<int>")
    def ids(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = codec(path, pattern)
        for batch in texts:
            yield batch.map(own.encode, na_action=None)

    return docs.withColumn(out, ids(F.col(text).cast("string")))


def decode(encoded: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds ``out``: the ids' bytes (null ids: null). An input column of that name is an error."""
    _vacant(encoded, out)

    @F.pandas_udf("binary")
    def back(lists: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = codec(path, pattern)
        for batch in lists:
            yield batch.map(lambda x: None if x is None else own.decode(x.tolist()))

    return encoded.withColumn(out, back(F.col(ids)))


def _digest(path: str, pattern: str, text: Column) -> Column:
    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = codec(path, pattern)
        for batch in texts:
            yield pd.DataFrame([own.digests(x) for x in batch], columns=list(PATTERN_COLUMNS))

    return digest(text)


def round_trip(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes and decodes every text; one row per document with counts and digests of ids and bytes."""
    return docs.select(key, _digest(path, pattern, F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("d")).select(
        key, "d.*"
    )
