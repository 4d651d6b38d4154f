"""The tokenizers library over whole Arrow batches, asked once for each distinct piece.

For files that drop white space and never join what it separates, the ids of a text are those of its words one after
another; and a word of plain letters, digits and marks falls into runs of letters, single digits and runs of marks, each
of which has ids of its own.  Pieces are cut and numbered for a whole batch at once, and only those that a worker has
not met go to the library's model.  Words with any other character go through the whole tokenizer.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import shingles
from .bpe import _byte_alphabet

#: Bytes of pieces, and pieces, that a worker remembers; beyond them it forgets the rarer ones.  They bound memory and do not change results.
REMEMBERED_BYTES = 8_000_000
REMEMBERED = 400_000

#: What a file says of itself when a run of letters, and a run of marks, is one piece in lower case.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"

#: Kinds of bytes: what is neither a letter, a digit nor a mark of ASCII makes its word odd, and so does an apostrophe.
_LETTER, _DIGIT, _MARK, _ODD = 1, 2, 3, 4
_KINDS = np.full(256, _ODD, dtype=np.uint8)
_KINDS[33:127] = _MARK
_KINDS[48:58] = _DIGIT
_KINDS[65:91] = _KINDS[97:123] = _LETTER
_KINDS[39] = _ODD
#: Pieces as cut() leaves them of plain words, each one piece to the file too.
_PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+|[0-9]|[!-&(-/:-@\[-`{-~]+")


def cut(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, odd_pairs: tuple[bytes, ...] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words, side by side in data, in lower case where they are plain, and the first and one-past-last byte of each piece.

    Plain letters are those of ASCII and of Latin-1 with two bytes in UTF-8, which every Unicode version has.  Words with
    one of odd_pairs are not plain.
    """
    kind = _KINDS[data]
    for a, b in odd_pairs:
        kind[np.flatnonzero((data[:-1] == a) & (data[1:] == b))] = _ODD
    # C3 and a byte after it that is not that of the signs for times or division is a letter of Latin-1
    lead = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)) if len(data) else np.empty(0, dtype=np.int64)
    kind[lead] = kind[lead + 1] = _LETTER
    odd = np.add.reduceat(np.append(kind == _ODD, False).astype(np.int32), np.stack([starts, stops], 1).ravel())[::2] > 0 if len(starts) else np.empty(0, dtype=bool)
    begins = np.zeros(len(data) + 1, dtype=bool)
    begins[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    lower = data + 32 * ((data >= 65) & (data <= 90)).astype(np.uint8)
    after = lead + 1
    lower[after] += 32 * ((data[after] >= 0x80) & (data[after] <= 0x9E)).astype(np.uint8)
    if odd.any():
        edge = np.zeros(len(data) + 1, dtype=np.int8)
        edge[starts[odd]] = 1
        edge[stops[odd]] -= 1
        within = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
        begins[:-1][within] = False
        lower[within] = data[within]
    begins[starts] = True
    ends = begins.copy()
    ends[stops] = True
    ends[0] = False
    return lower, np.flatnonzero(begins[:-1]), np.flatnonzero(ends)


class WordEncoder:
    """A tokenizer file of any kind; ids come as unsigned integers of `width` bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.no_truncation()
        self._tokenizer.no_padding()
        self._model = self._tokenizer.model
        self.width = 2 if self._tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.code = {2: "<u2", 4: "<u4"}[self.width]
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        steps = (spec["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
        split = {"type": "Split", "pattern": {"Regex": _PATTERN}, "behavior": "Removed", "invert": True}
        plain_added = all(len(t["content"].encode()) > 1 and not any(c.isspace() for c in t["content"]) and not any(t[k] for k in ("single_word", "lstrip", "rstrip", "normalized")) for t in spec["added_tokens"])
        self._by_piece = plain_added and spec["normalizer"] == _NORMALIZER and steps[0] == split and [s["type"] for s in steps[1:]] == ["ByteLevel"] and not steps[1]["add_prefix_space"] and not steps[1]["use_regex"]
        # the strings of added tokens are found before anything is split
        self._odd_pairs = tuple({t["content"].encode()[:2] for t in spec["added_tokens"]})
        char_of = {b: c for c, b in _byte_alphabet().items()}
        self._alphabet = [char_of[b] for b in range(256)]
        self._known = pa.array([], pa.large_binary())
        self._place, self._length, self._hits = (np.empty(0, dtype=t) for t in (np.int64, np.int32, np.int32))
        self._pool = np.empty(0, dtype=self.code)

    def _made(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of each piece: plain ones from the model, as they need no normalizer and are not split again, others from the whole tokenizer."""
        out: list = []
        odd: list[int] = []
        tokenize, alphabet = self._model.tokenize, self._alphabet
        for i, piece in enumerate(pieces):
            if _PLAIN.fullmatch(piece):
                text = piece.decode() if piece.isascii() else "".join([alphabet[b] for b in piece])
                out.append([t.id for t in tokenize(text)])
            else:
                odd.append(i)
                out.append(None)
        for i, made in zip(odd, self._tokenizer.encode_batch([pieces[i].decode() for i in odd], add_special_tokens=False) if odd else [], strict=True):
            out[i] = made.ids
        return out

    def _learn(self, new: pa.Array) -> None:
        made = self._made(new.to_pylist())
        n = np.array([len(x) for x in made], dtype=np.int32)
        self._place = np.concatenate([self._place, len(self._pool) + np.cumsum(n, dtype=np.int64) - n])
        self._pool = np.concatenate([self._pool, np.fromiter((t for x in made for t in x), dtype=self.code, count=int(n.sum()))])
        self._length, self._hits = np.concatenate([self._length, n]), np.concatenate([self._hits, np.zeros(len(n), dtype=np.int32)])
        self._known = pa.concat_arrays([self._known, new])

    def _forget(self) -> None:
        """Keeps the pieces that came most often, half of what may be remembered at most."""
        most = REMEMBERED // 2
        order = np.argsort(-self._hits, kind="stable")[:most]
        keep = np.sort(order[self._hits[order] > 1])
        if self._known.nbytes > REMEMBERED_BYTES:
            lengths = pc.binary_length(self._known).to_numpy()[keep]
            keep = keep[np.cumsum(lengths) <= REMEMBERED_BYTES // 2]
        n = self._length[keep]
        upto = np.cumsum(n, dtype=np.int64) - n
        self._pool = self._pool[np.repeat(self._place[keep] - upto, n) + np.arange(int(n.sum()))]
        self._known, self._place, self._length, self._hits = self._known.take(pa.array(keep)), upto, n, self._hits[keep] // 4

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a column, side by side, and the offsets between texts; nulls are empty texts."""
        if not self._by_piece:
            made = [x.ids for x in self._tokenizer.encode_batch([x or "" for x in column.to_pylist()], add_special_tokens=False)]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in made])]).astype(np.int64)
            return np.fromiter((t for x in made for t in x), dtype=self.code, count=int(ends[-1])), ends
        data, ends = shingles.texts_of(column)
        starts, stops = shingles.spans(data, ends)
        words, contents = shingles.numbered(data, starts, stops)
        place, n = self._of_words(contents)
        # from where the ids of each distinct word lie side by side to where those of all words do
        place, n = place[words], n[words]
        upto = np.zeros(len(words) + 1, dtype=np.int64)
        np.cumsum(n, out=upto[1:])
        flat = self._flat[np.repeat(place - upto[:-1], n) + np.arange(upto[-1])]
        return flat, upto[np.searchsorted(starts, ends)]

    def _of_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The place in _flat, and the number, of the ids of each word."""
        data, ends = shingles.texts_of(words.view(pa.large_string()))
        lower, starts, stops = cut(data, ends[:-1], ends[1:], self._odd_pairs)
        codes, contents = shingles.numbered(lower, starts, stops)
        if len(self._known) > REMEMBERED or self._known.nbytes > REMEMBERED_BYTES:
            self._forget()
        at = pc.index_in(contents, value_set=self._known).fill_null(-1).to_numpy().astype(np.int64)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            at[missing] = len(self._known) + np.arange(len(missing))
            self._learn(contents.take(pa.array(missing)))
        self._hits[at] += 1
        place, n = self._place[at][codes], self._length[at][codes]
        upto = np.zeros(len(codes) + 1, dtype=np.int64)
        np.cumsum(n, out=upto[1:])
        self._flat = self._pool[np.repeat(place - upto[:-1], n) + np.arange(upto[-1])]
        bounds = upto[np.searchsorted(starts, ends)]
        return bounds[:-1], np.diff(bounds)
