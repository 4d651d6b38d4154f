"""BPE encoding and decoding, exact, by dynamic programming over prefixes.

For every prefix of a pre-token there is exactly one token that can end its encoding.  A suffix-match automaton over
the vocabulary lists the tokens that end at each position, longest first; a candidate is right when the unique last
token of the prefix before it and the candidate stay apart under the merge rules.  Storing one token for each prefix
gives back-pointers, and following them from the end gives the ids.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded, cache, lean

#: Entries in a worker's memory of segments, and the longest segment that is remembered.  They bound memory; beyond
#: them the work is done again, so results do not depend on them.
REMEMBERED = 400_000
REMEMBERED_CHARS = 40

_SEGMENT = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
_OTHER_BLANK = re.compile(r"[^\S \n]")
#: Segments that any byte-level pre-tokenizer splits into a word and its punctuation, in letters that every Unicode version has.
_PLAIN = re.compile(r"( ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,;:!?]*)")
_NEVER = 1 << 60


class PrefixBpe:
    """A byte-level BPE tokenizer file, encoded by the method above.

    Takes files whose model has no unknown token, prefix, word end or byte fallback, and whose added tokens are
    matched as plain strings; raises ValueError for others.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        odd = [k for k in ("unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "dropout", "ignore_merges") if model.get(k)]
        odd += [t["content"] for t in spec["added_tokens"] if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]]
        if model["type"] != "BPE" or spec["normalizer"] or spec["pre_tokenizer"].get("type") != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"] or odd:
            raise ValueError(f"{path}: not a plain byte-level BPE file {odd}")
        self._pre = Tokenizer.from_file(path).pre_tokenizer
        vocab: dict[str, int] = model["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._added = re.compile("|".join(re.escape(t) for t in sorted(added, key=len, reverse=True))) if added else None
        self._added_ids = added
        # time: when the merge rules can first make a token; single symbols are there from the start
        self._time = {vocab[t]: -1 for t in vocab if len(t) == 1}
        self._halves: dict[int, tuple[int, int]] = {}
        self._joins: dict[tuple[int, int], int] = {}
        for time, (a, b) in enumerate(merges):
            made = vocab[a + b]
            self._joins[vocab[a], vocab[b]] = time
            if made not in self._time:
                self._time[made], self._halves[made] = time, (vocab[a], vocab[b])
        self._apart: dict[tuple[int, int], bool] = {}
        self._automaton = ahocorasick.Automaton()
        for token, number in vocab.items():
            if number in self._time:
                self._automaton.add_word(token, (number, len(token)))
        self._automaton.make_automaton()
        self._bytes = _token_bytes(vocab, added)
        self._known: dict[str, bytes] = {}
        self._known_pieces: dict[str, bytes] = {}
        self._alphabet = [char for char, _ in sorted(_byte_alphabet().items(), key=lambda x: x[1])]

    def stay_apart(self, left: int, right: int) -> bool:
        """Whether merging leaves the two tokens as they are when they stand side by side.

        Undoes the merges of both tokens from the latest to the earliest.  Where a rule joins the two parts that
        meet at the border before either of them would have grown on, the border does not last.
        """
        key = (left, right)
        known = self._apart.get(key)
        if known is None:
            # left_until, right_until: the time at which the part on that side is taken into a larger one
            time, halves = self._time, self._halves
            left_until = right_until = _NEVER
            known = True
            while True:
                joined = self._joins.get((left, right))
                # of equal rules that overlap, the one further left comes first, so a join loses to the left one's growth
                if joined is not None and joined < left_until and joined <= right_until:
                    known = False
                    break
                a, b = time[left], time[right]
                if a < 0 and b < 0:
                    break
                if a > b:
                    left_until, left = a, halves[left][1]
                else:
                    right_until, right = b, halves[right][0]
            if len(self._apart) >= REMEMBERED:
                self._apart.clear()
            self._apart[key] = known
        return known

    def encode_piece(self, piece: str) -> list[int]:
        """The ids of one pre-token, given in the vocabulary's byte alphabet."""
        last: list[tuple[int, int] | None] = [None] * (len(piece) + 1)
        apart = self.stay_apart
        for end, (token, length) in self._automaton.iter(piece):
            if last[end + 1] is None:
                start = end + 1 - length
                if start == 0 or ((before := last[start]) is not None and apart(before[0], token)):
                    last[end + 1] = (token, start)
        ids, at = [], len(piece)
        while at:
            token, at = last[at]
            ids.append(token)
        return ids[::-1]

    def _word(self, word: str) -> bytes:
        made = self._known_pieces.get(word)
        if made is None:
            made = array("i", self.encode_piece("".join([self._alphabet[b] for b in word.encode()]))).tobytes()
            if len(self._known_pieces) >= REMEMBERED:
                self._known_pieces.clear()
            self._known_pieces[word] = made
        return made

    def _segment(self, segment: str) -> bytes:
        plain = _PLAIN.fullmatch(segment) if len(segment) <= REMEMBERED_CHARS else None
        if plain:
            made = self._word(plain[1]) + (self._word(plain[2]) if plain[2] else b"")
        else:
            out = array("i")
            for piece, _ in self._pre.pre_tokenize_str(segment):
                out.extend(self.encode_piece(piece))
            made = out.tobytes()
        if len(segment) <= REMEMBERED_CHARS:
            if len(self._known) >= REMEMBERED:
                self._known.clear()
            self._known[segment] = made
        return made

    def _ordinary(self, text: str) -> bytes:
        # A pre-token never holds blanks after other characters, so a text falls apart where a blank follows something
        # else.  Runs of blanks of other kinds than space and line feed are left to the pre-tokenizer.
        if _OTHER_BLANK.search(text):
            return b"".join(self._segment(x) for x in [text])
        parts = _SEGMENT.findall(text)
        known = self._known
        try:
            return b"".join(map(known.__getitem__, parts))
        except KeyError:
            return b"".join([known.get(x) or self._segment(x) for x in parts])

    def encode(self, text: str | None) -> bytes:
        """The ids of a text as native 32-bit integers, side by side; none for null."""
        if not text:
            return b""
        if self._added is None or not self._added.search(text):
            return self._ordinary(text)
        out, at = [], 0
        for found in self._added.finditer(text):
            out += [self._ordinary(text[at : found.start()]), array("i", [self._added_ids[found.group()]]).tobytes()]
            at = found.end()
        return b"".join([*out, self._ordinary(text[at:])])

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids, special tokens included; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self._bytes.__getitem__, ids)).decode("utf-8", "replace")


def _byte_alphabet() -> dict[str, int]:
    """Byte-level vocabularies write printable Latin-1 bytes as themselves and the others as the characters from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}


def _token_bytes(vocab: dict[str, int], added: dict[str, int]) -> dict[int, bytes]:
    """The bytes of each token."""
    byte_of = _byte_alphabet()
    out = {number: bytes(byte_of[c] for c in token) for token, number in vocab.items() if token not in added}
    return out | {number: token.encode() for token, number in added.items()}


_loaded: dict[str, PrefixBpe] = cache("bpe")


def load(path: str) -> PrefixBpe:
    """The tokenizer of a file, made once in each process."""
    if path not in _loaded:
        _loaded[path] = PrefixBpe(path)
    return _loaded[path]


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """One row for each input row: its id and its token ids (array of int; empty for null and empty texts).

    Rows with the same id or text stay separate rows; other columns of docs are not read.  Texts are taken whole.
    Ids are those of the tokenizer file's own library without special tokens added; strings of special tokens in a text
    become their ids, as there.
    """
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField(ids_col, T.ArrayType(T.IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer)
        for whole in batches:
            for batch in small(whole):
                made = [bpe.encode(x) for x in batch.column(1).to_pylist()]
                ends = array("i", [0])
                for x in made:
                    ends.append(ends[-1] + len(x) // 4)
                flat = pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(b"".join(made))])
                ids = pa.Array.from_buffers(pa.list_(pa.field("element", pa.int32(), False)), len(made), [None, pa.py_buffer(ends)], children=[flat])
                yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[id_col, ids_col])

    return bounded(docs).select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(lean(run, "bpe"), schema)


def small(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, a few at a time, so that long texts do not pile up in Python."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def decode(encoded: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """encoded with the text of its ids; null ids give an empty text.

    Keeps id_col and ids_col only.  Ids that the file does not have raise KeyError.
    """
    schema = T.StructType([encoded.schema[id_col], encoded.schema[ids_col], T.StructField(text_col, T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer)
        for whole in batches:
            for batch in small(whole):
                texts = [bpe.decode(x.values.to_numpy().tolist() if x.values is not None else []) for x in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=[id_col, ids_col, text_col])

    return bounded(encoded).select(id_col, ids_col).mapInArrow(lean(run, "bpe"), schema)
