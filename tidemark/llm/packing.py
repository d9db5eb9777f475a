"""Bounded-space online packing of tokenised documents into sequences of fixed length.

Each partition keeps a fixed number of open windows. A document's whole windows are emitted
as they are; what is left of it goes where it fits best. When it fits nowhere, the fullest
window is topped up with the document's head and emitted, and the rest is placed. When the
partition ends, its leftover windows are merged into full sequences, and the last stretch,
shorter than a window, is cut into sequences whose lengths are powers of two. So only whole
windows and powers of two come out, and nothing is padded. Memory is bounded by one batch
of rows and the open windows; there is no shuffle, and no task sees more than its split.

Defined results: null text counts as empty and still has its end token; long texts span as
many sequences as they need; repeated rows are packed each for itself; ties for the best
fit go to the window opened first; an empty table gives an empty table; further columns of
the input are ignored, whatever their names; rows without a key are packed under a null key.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

#: Columns of a piece after the key.
PIECE = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
#: White space in runs from here on goes to ``tokenizers``: the other matcher's stack is bounded.
LONG_BLANKS = re.compile(r"\s{100000}")


class Tokens:
    """Texts to little-endian 32-bit ids, as a ``tokenizers`` file gives them (add_special_tokens=False).

    A byte-level BPE file without further features, whose ids follow the order of its merges, is
    run by tiktoken's core, four times as fast, over the file's own tokens. Both merge neighbours by rank; they can only differ at a
    token that the file's merges do not make from its own bytes, so such tokens are left out
    of the ranks. Any other file, and texts with very long blanks, go to ``tokenizers`` itself.
    The strings of added tokens stand for these tokens, unless ``plain_specials`` is set.
    """

    def __init__(self, path: str, end_id: int = 0, plain_specials: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain_specials
        self.end = np.uint32(end_id).tobytes()
        with open(path, encoding="utf-8") as f:
            self.core, self.specials = self._fast(json.load(f), plain_specials)

    def _fast(self, said: dict, plain_specials: bool):
        """The core for this file and the strings of its added tokens; None where the file needs more than byte-level BPE."""
        model, split, added = said["model"], said["pre_tokenizer"] or {}, said["added_tokens"]
        odd = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
        plain = model.get("type") == "BPE" and not any(model.get(k) for k in odd) and not said["normalizer"] and not said["post_processor"]
        plain &= split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
        plain &= not any(x[k] for x in added for k in ("single_word", "lstrip", "rstrip")) and not (plain_specials and added and not all(x["special"] for x in added))
        # the core merges by the ids of the results: they must follow the order of the merges, each token coming from one merge
        vocab, pairs = model.get("vocab", {}), model.get("merges", [])
        made = [vocab.get(m.replace(" ", "") if isinstance(m, str) else "".join(m)) for m in pairs] if plain else []
        plain &= None not in made and all(a < b for a, b in pairwise(made)) and all(c in vocab for c in _bytes_of_letters())
        if not plain:
            return None, frozenset()
        from public_tokenizers import PATTERN
        from tiktoken import Encoding

        byte_of = _bytes_of_letters()
        specials = {} if plain_specials else {x["content"]: x["id"] for x in added}
        ranks = {}
        for token, k in model["vocab"].items():
            if all(c in byte_of for c in token) and [x.id for x in self.tokenizer.model.tokenize(token)] == [k]:
                ranks[bytes(byte_of[c] for c in token)] = k
        return Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=specials)._core_bpe, frozenset(specials)

    def ids(self, text: str) -> bytes:
        """The ids of a text, then the end id."""
        if self.core is None or len(text) >= 100_000 and LONG_BLANKS.search(text):
            found = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        else:
            found = bytes(self.core.encode_to_tiktoken_buffer(text, self.specials))
        return found + self.end


def _bytes_of_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable bytes for themselves, the others in order from U+0100."""
    own = [b for b in range(256) if chr(b).isprintable() and not chr(b).isspace() and b != 0xAD]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(others)}


class Packer:
    """Windows of one partition. ``place`` takes a document's ids; closed pieces gather in ``rows``."""

    def __init__(self, partition: int, window: int = 1024, open_windows: int = 16, with_ids: bool = False):
        self.window, self.with_ids, self.next_id = window, with_ids, partition << 33
        #: Open windows: filled length and pieces (key, start, ids, tokens of the document).
        self.open: list[tuple[int, list]] = [(0, []) for _ in range(open_windows)]
        self.rows: list[tuple] = []

    def _emit(self, pieces: list) -> None:
        offset = 0
        for key, start, ids, total in pieces:
            n = len(ids) // 4
            row = (key, start, n, zlib.crc32(ids), total, self.next_id, offset)
            self.rows.append((*row, np.frombuffer(ids, "<i4")) if self.with_ids else row)
            offset += n
        self.next_id += 1

    def place(self, key, ids: bytes) -> None:
        total, at = len(ids) // 4, 0
        while total - at >= self.window:
            self._emit([(key, at, ids[4 * at : 4 * (at + self.window)], total)])
            at += self.window
        while at < total:
            need = total - at
            fits = [k for k, (filled, _) in enumerate(self.open) if self.window - filled >= need]
            k = max(fits or range(len(self.open)), key=lambda k: self.open[k][0])
            filled, pieces = self.open.pop(k)
            n = min(need, self.window - filled)
            pieces.append((key, at, ids[4 * at : 4 * (at + n)], total))
            at += n
            if filled + n == self.window:
                self._emit(pieces)
                filled, pieces, n = 0, [], 0
            self.open.append((filled + n, pieces))

    def finish(self) -> None:
        """Merge the leftover windows; the last stretch is cut at powers of two."""
        left = [p for _, pieces in sorted(self.open, key=lambda x: -x[0]) for p in pieces]
        self.open = []
        tokens = sum(len(p[2]) // 4 for p in left)
        while tokens:
            room = self.window if tokens >= self.window else 1 << (tokens.bit_length() - 1)
            tokens -= room
            pieces = []
            while room:
                key, start, ids, total = left.pop(0)
                n = min(room, len(ids) // 4)
                pieces.append((key, start, ids[: 4 * n], total))
                if 4 * n < len(ids):
                    left.insert(0, (key, start + n, ids[4 * n :], total))
                room -= n
            self._emit(pieces)


@lru_cache(maxsize=1)
def tokens(path: str, end_id: int, plain_specials: bool) -> Tokens:
    """One for each Python worker."""
    return Tokens(path, end_id, plain_specials)


def pack(
    docs: DataFrame,
    path: str,
    key: str = "doc_id",
    text: str = "text",
    window: int = 1024,
    open_windows: int = 16,
    end_id: int = 0,
    with_ids: bool = False,
    plain_specials: bool = False,
    batch: int = 512,
) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset;
    with ``with_ids`` also the piece's ids. ``window`` must be a power of two."""
    if window & (window - 1):
        raise ValueError("window must be a power of two")
    fields = [StructField(key, docs.schema[key].dataType), *(StructField(c, LongType()) for c in PIECE)]
    schema = StructType(fields + [StructField("ids", ArrayType(IntegerType()))] * with_ids)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(TaskContext.get().partitionId(), window, open_windows, with_ids)

        def rows() -> pa.RecordBatch:
            out, packer.rows = packer.rows, []
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(arrow)], schema=arrow)

        own = tokens(path, end_id, plain_specials)
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                part = whole.slice(at, batch)
                # keys stay Arrow values, so that a null beside them leaves large integers whole
                for k, x in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    packer.place(k, own.ids(x))
                if packer.rows:
                    yield rows()
        packer.finish()
        if packer.rows:
            yield rows()

    return docs.select(key, F.coalesce(F.col(text).cast("string"), F.lit("")).alias(text)).mapInArrow(run, schema)
