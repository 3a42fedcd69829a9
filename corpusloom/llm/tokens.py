"""Token ids by the tokenizers library, with repeated words encoded once."""

from __future__ import annotations

import os
import sys
from array import array

import numpy as np

from .common import CHUNK_BYTES, Words, column_bytes, mix, pieces

#: Pieces a worker remembers (about 30 bytes each); it starts afresh when they are more.
KEPT = 400_000

#: Marks that often end a word.
ENDS = ".,;:!?"

#: Bytes that are white space but for the space itself, and those that may begin or end such a character.
_BLANK = bytes([*range(0x09, 0x0E), *range(0x1C, 0x20)])
_MAY_BEGIN = bytes([*_BLANK, 0xC2, 0xE1, 0xE2, 0xE3])
_MAY_END = bytes([*_BLANK, *range(0x80, 0xC0)])


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if visible, else the next from 256 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {b: chr(b) for b in visible}
    for n, b in enumerate(b for b in range(256) if b not in table):
        table[b] = chr(256 + n)
    return table


def _among(values: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[np.frombuffer(values, np.uint8)] = True
    return table


class Memo:
    """Ids by the hash of a piece: sorted keys, place and number of the ids (-1: the text must be encoded whole)."""

    def __init__(self):
        self.keys, self.place, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return at, self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)

    def add(self, keys: np.ndarray, found: list) -> None:
        sizes = np.array([-1 if x is None else len(x) // 4 for x in found], np.int32)
        flat = np.frombuffer(b"".join(x or b"" for x in found), np.uint32)
        if self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(self.used + 2 * len(flat), np.uint32)])
        self.ids[self.used : self.used + len(flat)] = flat
        held = np.maximum(sizes, 0).astype(np.int64)
        place = self.used + np.cumsum(held) - held
        self.used += len(flat)
        at = np.searchsorted(self.keys, keys)
        self.keys, self.place, self.size = np.insert(self.keys, at, keys), np.insert(self.place, at, place), np.insert(self.size, at, sizes)


class Encoder:
    """Encodes texts with the tokenizer file at ``path`` (``add_special_tokens=False``).

    A byte-level BPE with the usual pre-tokenizer never joins across a single space that stands between two
    visible characters, so a text is cut there and each distinct piece (by a 64-bit hash) is encoded once by the
    library. Texts for which that does not hold, texts with a special token in them, and other kinds of tokenizers
    go through the library whole. The memo lives on a module of its own in the worker, so it outlasts a task.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        kept = sys.modules.setdefault("corpusloom_token_memo", type(sys)("corpusloom_token_memo"))
        if path not in kept.__dict__:
            from tokenizers import Tokenizer

            kept.__dict__[path] = {"library": Tokenizer.from_file(path)}
        self.kept = kept.__dict__[path]
        self.library = library = self.kept["library"]
        before = library.pre_tokenizer
        self.cut = before.__class__.__name__ == "ByteLevel" and not before.add_prefix_space and library.normalizer is None and library.model.__class__.__name__ == "BPE"
        self.model, self.letters = library.model, byte_letters()
        self.special = [t.content for t in library.get_added_tokens_decoder().values()]
        self.marks = {c: self.whole(c) for c in ENDS}

    @property
    def vocabulary(self) -> int:
        return self.library.get_vocab_size(with_added_tokens=True)

    def whole(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def letters_only(self, text: str) -> bytes:
        """A run of letters, perhaps after a space, is one word to the pre-tokenizer: the library's model has it at once."""
        return array("I", [t.id for t in self.model.tokenize(text.encode().decode("latin-1").translate(self.letters))]).tobytes()

    def _learn(self, memo: Memo, keys: np.ndarray, bare: np.ndarray, texts: list[str], heads: np.ndarray) -> None:
        """Encode the pieces ``texts``; ``bare`` are the hashes without the last byte."""
        at, known = memo.find(bare)
        found: list = []
        for i, text in enumerate(texts):
            lead = "" if heads[i] else " "
            if text.isalpha():
                found.append(self.letters_only(lead + text))
            elif text[-1] in self.marks and text[:-1].isalpha():
                if known[i] and memo.size[at[i]] >= 0:
                    a = memo.place[at[i]]
                    found.append(memo.ids[a : a + memo.size[at[i]]].tobytes() + self.marks[text[-1]])
                else:
                    found.append(self.letters_only(lead + text[:-1]) + self.marks[text[-1]])
            elif any(s in text for s in self.special):
                found.append(None)
            else:
                found.append(self.whole(lead + text))
        memo.add(keys, found)

    def encode_bytes(self, data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end (unsigned 32-bit), and the n + 1 borders between the texts."""
        docs = len(borders) - 1
        text = lambda d: data[borders[d] : borders[d + 1]].tobytes().decode()
        memo = self.kept.get("memo")
        if memo is None or len(memo.keys) > KEPT:
            memo = self.kept["memo"] = Memo()
        if not self.cut:
            parts = [np.frombuffer(self.whole(text(d)), np.uint32) for d in range(docs)]
            return np.concatenate([np.zeros(0, np.uint32), *parts]), np.cumsum([0, *map(len, parts)])
        w = Words(data, borders, b" ", lower=False)
        n = len(w.start)
        head = np.zeros(n, bool)
        head[w.first[:-1][np.diff(w.first) > 0]] = True
        turn = np.where(head, np.uint64(0x5851F42D4C957F2D), np.uint64(0))
        key = mix(w.hash ^ turn)
        # spaces must be those between two pieces, and none may stand between other white space
        spaces = np.zeros(len(data) + 1, np.int64)
        np.cumsum(data == 0x20, out=spaces[1:])
        odd = np.diff(spaces[borders]) != np.maximum(np.diff(w.first) - 1, 0)
        if n:
            close = _among(_MAY_BEGIN)[data[w.start[1:]]] & _among(_MAY_END)[data[w.end[:-1] - 1]] & ~head[1:]
            odd[w.doc[1:][close]] = True
        distinct, sample, inverse = np.unique(key, return_index=True, return_inverse=True)
        at, known = memo.find(distinct)
        if not known.all():
            new = sample[~known]
            bare = mix(w.part_hash(w.start[new], w.end[new] - 1) ^ turn[new])
            self._learn(memo, distinct[~known], bare, [data[a:b].tobytes().decode() for a, b in zip(w.start[new].tolist(), w.end[new].tolist())], head[new])
            at, _ = memo.find(distinct)
        size, place = memo.size[at][inverse].astype(np.int64), memo.place[at][inverse]
        odd[w.doc[size < 0]] = True
        size[odd[w.doc]] = 0
        first = np.cumsum(size) - size
        ids = memo.ids[np.repeat(place - first, size) + np.arange(int(size.sum()))]
        ends = np.append(first, size.sum())[w.first]
        if odd.any():
            parts = [np.frombuffer(self.whole(text(d)), np.uint32) if odd[d] else ids[ends[d] : ends[d + 1]] for d in range(docs)]
            return np.concatenate(parts), np.cumsum([0, *map(len, parts)])
        return ids, ends

    def encode_column(self, column) -> tuple[np.ndarray, np.ndarray]:
        """``encode_bytes`` of an Arrow column, a few MB at a time."""
        data, borders = column_bytes(column)
        ids, sizes = [np.zeros(0, np.uint32)], [np.zeros(1, np.int64)]
        for low, high in pieces(borders, CHUNK_BYTES):
            cut = borders[low : high + 1]
            got, ends = self.encode_bytes(data[cut[0] : cut[-1]], cut - cut[0])
            ids.append(got)
            sizes.append(np.diff(ends))
        return np.concatenate(ids), np.cumsum(np.concatenate(sizes))
