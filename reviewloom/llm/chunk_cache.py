"""Byte-level BPE through a bounded table of the pieces between spaces.

A byte-level pre-tokenizer always breaks before white space that follows
something else, and what comes after such a break depends on later characters
only. So a text may be cut before every single space that stands between two
other characters, and the ids of the pieces, put together, are the ids of the
text. The distinct pieces of a group of texts are looked up once and their ids
gathered by number. The library encodes each piece once as long as the table holds
it; texts with rarer white space go to the library whole.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space besides the space, as the tokenizer or Python knows it.
_OTHER_SPACE = r"\t\n\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_UNSAFE = re.compile(f"[ {_OTHER_SPACE}] ")
#: A piece of one or two words (letters up to U+024F) with marks after them: the pre-tokenizer breaks at every border.
_LETTERS = "[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f]+"
_PLAIN = re.compile(f"( ?{_LETTERS})([.,;:!?]*)(?:(\\n)({_LETTERS})([.,;:!?]*))?")
TABLE_PIECES = 900_000
LONG_PIECE = 256
GROUP_CHARS = 1 << 21
JOINED_WORDS = 500
#: Fixed value: the letter that stands for a space in pieces of the vocabulary.
SPACE = "\u0120"

_ENCODERS: dict[str, "PieceEncoder"] = {}


def load_tokenizer(path: str):
    """The tokenizer of a file, with one thread: Spark's tasks are the parallelism."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class PieceEncoder:
    """Two bounded tables: the ids of pieces, and of the parts that plain pieces are made of."""

    def __init__(self, path: str, limit: int = TABLE_PIECES):
        self.tokenizer = load_tokenizer(path)
        self.limit = limit
        self.first: dict[str, bytes] = {}
        self.later: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        #: Which ids begin with a space.
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.leads = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.leads[[i for piece, i in vocabulary.items() if piece.startswith(SPACE)]] = True

    @classmethod
    def of(cls, path: str) -> "PieceEncoder":
        """One encoder for each worker and file; it lives as long as the worker."""
        if path not in _ENCODERS:
            _ENCODERS[path] = cls(path)
        return _ENCODERS[path]

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", x.ids).tobytes() for x in found]

    def _words(self, words: list[str]) -> Iterator[bytes]:
        """The ids of words that each begin with their only space: the library breaks there, so many go to it as one text."""
        joined = ["".join(words[i:i + JOINED_WORDS]) for i in range(0, len(words), JOINED_WORDS)]
        for at, found in enumerate(self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)):
            own = words[at * JOINED_WORDS:(at + 1) * JOINED_WORDS]
            ids = np.array(found.ids, "<u4")
            starts = np.flatnonzero(self.leads[ids])
            if len(starts) != len(own):
                yield from self._whole(own)
                continue
            plain, ends = ids.tobytes(), [*(4 * starts).tolist(), 4 * len(ids)]
            yield from [plain[a:b] for a, b in zip(ends, ends[1:])]

    def encode(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """The ids of each text, in order."""
        group, size = [], 0
        for text in texts:
            group.append(text)
            size += len(text)
            if size >= GROUP_CHARS:
                yield from self._group(group)
                group, size = [], 0
        yield from self._group(group)

    def _ids(self, table: dict[str, bytes], pieces: list[str], lead: str) -> list[bytes]:
        """The ids of distinct pieces; those the table misses are encoded, and all but long ones stay in it."""
        missing = [p for p in pieces if p not in table]
        if len(table) + len(missing) > self.limit:
            table.clear()
            missing = pieces
        whole = [p for p in missing if p.isalpha()]
        split = {p: [x for x in found.groups() if x] for p in missing if not p.isalpha() and (found := _PLAIN.fullmatch(lead + p))}
        whole += [p for p in missing if p not in split and not p.isalpha()]
        parts = {lead + p for p in whole}
        parts.update(*split.values())
        new = parts.difference(self.parts)
        if len(self.parts) + len(new) > self.limit:
            self.parts.clear()
            new = parts
        known = self.parts
        words = [x for x in new if x[:1] == " " and x[1:].isalpha()]
        known.update(zip(words, self._words(words)))
        others = [x for x in new if x not in known]
        known.update(zip(others, self._whole(others)))
        table.update(zip(whole, [known[lead + p] for p in whole]))
        table.update((p, b"".join([known[x] for x in own])) for p, own in split.items())
        out = list(map(table.__getitem__, pieces))
        for part in new:
            if len(part) > LONG_PIECE:
                del known[part]
        for piece in missing:
            if len(piece) > LONG_PIECE:
                del table[piece]
        return out

    def _group(self, texts: list[str]) -> Iterator[np.ndarray]:
        # Pieces after the first one of a text stand for themselves and the space before them.
        unsafe = [_UNSAFE.search(text) is not None for text in texts]
        lists = pc.split_pattern(pa.array([t for t, u in zip(texts, unsafe) if not u], pa.large_string()), " ")
        offsets, flat = lists.offsets.to_numpy(), lists.flatten()
        first = np.zeros(len(flat), bool)
        first[offsets[:-1]] = True
        codes, known = np.zeros(len(flat), np.int64), []
        for table, lead, places in ((self.later, " ", ~first), (self.first, "", first)):
            named = flat.filter(pa.array(places)).dictionary_encode()
            codes[places] = named.indices.to_numpy() + len(known)
            known += self._ids(table, named.dictionary.to_pylist(), lead)
        lengths = np.fromiter(map(len, known), np.int64, len(known)) // 4
        starts = np.concatenate([[0], np.cumsum(lengths)])
        ids = np.frombuffer(b"".join(known), "<u4")
        own = lengths[codes]
        ends = np.concatenate([[0], np.cumsum(own)])
        ids = ids[np.arange(ends[-1], dtype=np.int32) + np.repeat((starts[codes] - ends[:-1]).astype(np.int32), own)]
        bounds, at = ends[offsets], 0
        for text, whole in zip(texts, unsafe):
            if whole:
                yield np.frombuffer(self._whole([text])[0], "<u4")
            else:
                yield ids[bounds[at]:bounds[at + 1]]
                at += 1
