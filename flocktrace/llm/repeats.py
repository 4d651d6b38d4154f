"""Repeated passages of a corpus, byte for byte, from enhanced suffix arrays.

Every window of `least` bytes picks an anchor, the substring of ANCHOR bytes in it with the least hash; equal windows pick
the same one.  A text thus falls into pieces: the windows that pick one occurrence of an anchor, and the text they span.
Pieces whose anchor occurs more than once are dealt by anchor, so that equal windows meet.  Identical pieces are one from
then on.  An anchor with very many different pieces is dealt by longer ones: its windows fall into halves by where the
anchor stands in them, and those of a half all reach some bytes further to one side, which are dealt by too; and so on.
In each share the suffixes that start at a repeated window are sorted and their common prefixes measured; a scan
with a stack walks the tree of common-prefix intervals, and an interval is a maximal repeat if its occurrences do not all
follow the same byte.  A group holds all of them, not only neighbours in the array.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, checked, dropped, lean, staged
from .shingles import mixed

LEAST = 100
ANCHOR = 32
#: Pieces that one suffix array takes, about, and different pieces of one anchor beyond which it is dealt by longer ones.
SHARE = 2_500
MOST_PIECES = 8_000
#: Positions that anchors are picked from together.  None of the three changes what is found.
BLOCK = 1 << 20


def _rolling(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of the `size` bytes from each position on."""
    h = mixed(data.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))
    out, covered, base, step = None, 0, 0x9E3779B97F4A7C15, 1
    power = 1
    while step <= size:
        if size & step:
            out = h if out is None else out[: len(data) - covered - step + 1] * np.uint64(pow(base, step, 1 << 64)) + h[covered : len(data) - step + 1]
            covered += step
        if step * 2 <= size:
            h = h[: len(h) - step] * np.uint64(pow(base, step, 1 << 64)) + h[step:]
        step *= 2
        power *= 2
    return mixed(out[: len(data) - size + 1])


def anchors(data: np.ndarray, least: int = LEAST, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each picked anchor its hash, its place and the first and last window that pick it; windows are numbered by their first byte."""
    found = []
    for at in range(0, max(0, len(data) - least + 1), BLOCK):
        own = data[at : at + BLOCK + least - 1]
        h = _rolling(own, anchor)
        span, n = least - anchor + 1, len(own) - least + 1
        # the least hash, leftmost of equal ones, over each run of `span` positions
        best, covered = (h & np.uint64(0xFFFFFFFFFFC00000)) | np.arange(len(h), dtype=np.uint64), 1
        while covered * 2 <= span:
            best = np.minimum(best[:-covered], best[covered:])
            covered *= 2
        best = np.minimum(best[:n], best[span - covered : span - covered + n])
        picked = (best & np.uint64(0x3FFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], picked[1:] != picked[:-1]]))
        last = np.concatenate([first[1:] - 1, [n - 1]])
        found.append((h[picked[first]].view(np.int64), picked[first] + at, first + at, last + at))
    if not found:
        return (np.empty(0, dtype=np.int64),) * 4
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def intervals(lcp: np.ndarray, least: int, rank: np.ndarray) -> Iterator[tuple[int, int, int, list[int]]]:
    """The common-prefix intervals of at least `least` bytes, children before parents: length, first, last and outdone.

    lcp[i] is what suffix i shares with suffix i - 1, rank[i] its place in the corpus.  outdone: the suffixes that are
    earliest in a child, or in no child, but not in this interval.  A suffix is outdone once, at the longest prefix that it
    shares with an earlier one.
    """
    places = rank.tolist()
    stack: list[tuple[int, int, list[int]]] = []
    for i, shared in enumerate([*lcp[1:].tolist(), 0], 1):
        left, open_ones = i - 1, [i - 1]
        while stack and stack[-1][0] > shared:
            length, left, members = stack.pop()
            members += open_ones
            best = min(members, key=places.__getitem__)
            yield length, left, i - 1, [m for m in members if m != best]
            open_ones = [best]
        if shared >= least:
            if stack and stack[-1][0] == shared:
                stack[-1][2].extend(open_ones)
            else:
                stack.append((shared, left, open_ones))


class SuffixArray:
    """The sorted suffixes of a share's pieces that start at a repeated window, with their common prefixes.

    A repeat that begins with a piece counts as maximal to the left, as what lies before is in another share.  rank: the
    place of each piece in the corpus.
    """

    def __init__(self, pieces: list[bytes], rank: list, least: int = LEAST):
        self.least = least
        lengths = np.array([len(p) for p in pieces], dtype=np.int64)
        data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        begins = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        windows = np.maximum(lengths - least + 1, 0)
        piece = np.repeat(np.arange(len(pieces)), windows)
        offset = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        starts = begins[piece] + offset
        if len(starts):
            # only suffixes whose first bytes come twice can share enough
            _, inverse, counts = np.unique(_rolling(data, least)[starts], return_inverse=True, return_counts=True)
            twice = counts[inverse] > 1
            piece, offset, starts = piece[twice], offset[twice], starts[twice]
        width = int(lengths.max()) if len(lengths) else 0
        rest = lengths[piece] - offset
        padded = np.concatenate([data, np.zeros(width, dtype=np.uint8)])
        rows = np.lib.stride_tricks.as_strided(padded, (len(data), width), (1, 1))[starts] if len(starts) else np.empty((0, 1), dtype=np.uint8)
        rows[np.arange(rows.shape[1]) >= rest[:, None]] = 0
        order = np.argsort(np.ascontiguousarray(rows).view(f"V{rows.shape[1]}").ravel(), kind="stable")
        rows, rest = rows[order], rest[order]
        self.piece, self.offset = piece[order], offset[order]
        lcp = np.zeros(len(rows), dtype=np.int64)
        for at in range(1, len(rows), 1 << 16):
            to = min(len(rows), at + (1 << 16))
            differ = rows[at:to] != rows[at - 1 : to - 1]
            lcp[at:to] = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        lcp[1:] = np.minimum(lcp[1:], np.minimum(rest[1:], rest[:-1]))
        self.lcp = lcp
        left = np.where(self.offset > 0, data[np.maximum(begins[self.piece] + self.offset - 1, 0)].astype(np.int64), -1 - np.arange(len(self.offset))) if len(rows) else np.empty(0, dtype=np.int64)
        # two suffixes of a run follow different bytes where this counter differs
        self._changes = np.concatenate([[0], np.cumsum(left[1:] != left[:-1])]).tolist()
        # pieces in the order of the corpus; within one, offsets
        by_rank = np.empty(len(pieces), dtype=np.int64)
        by_rank[sorted(range(len(pieces)), key=rank.__getitem__)] = np.arange(len(pieces))
        self._rank = by_rank[self.piece] * (width + 1) + self.offset

    def maximal(self) -> Iterator[tuple[int, int, int, list[int]]]:
        """Intervals whose suffixes do not all follow the same byte."""
        for length, first, last, outdone in intervals(self.lcp, self.least, self._rank):
            if self._changes[first] != self._changes[last]:
                yield length, first, last, outdone


def maximal_repeats(pieces: list[bytes], least: int = LEAST) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """The maximal repeats of a share: length and all occurrences (piece, offset)."""
    array = SuffixArray(pieces, list(range(len(pieces))), least)
    for length, first, last, _ in array.maximal():
        yield length, list(zip(array.piece[first : last + 1].tolist(), array.offset[first : last + 1].tolist(), strict=True))


_KEY = "doc_id {0}, tag long"


def _identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, tag and text; the tag, a hash of the text, tells texts with the same id apart."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("tag"), text.alias("text"))


def _alike(left: str, right: str) -> Column:
    """Whether rows of two tables are of the same text, null ids included."""
    return F.col(f"{left}.doc_id").eqNullSafe(F.col(f"{right}.doc_id")) & (F.col(f"{left}.tag") == F.col(f"{right}.tag"))


def _pieces(texts: DataFrame, least: int, anchor: int) -> DataFrame:
    """doc_id, tag, h, at, pos and piece for every piece whose anchor is picked more than once in texts; pos is the anchor's place in the piece."""
    texts = texts.select("doc_id", "tag", "text")
    key = _KEY.format(texts.schema["doc_id"].dataType.simpleString())

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = anchors(np.frombuffer(batch.column(2)[i].as_buffer(), dtype=np.uint8), least, anchor)
                n = len(found[0])
                if n:
                    yield pa.RecordBatch.from_arrays([_same(batch.column(0), i, n), _same(batch.column(1), i, n), pa.array(found[0]), *(pa.array(x.astype(np.int32)) for x in found[1:])], names=["doc_id", "tag", "h", "place", "lo", "hi"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                text, parts = batch.column(2)[i].as_buffer().to_pybytes(), batch.column(3)[i].values
                h, place, lo, hi = (parts.field(k) for k in range(4))
                los, his = lo.to_pylist(), hi.to_pylist()
                n = len(los)
                yield pa.RecordBatch.from_arrays([_same(batch.column(0), i, n), _same(batch.column(1), i, n), h, lo, pa.array(place.to_numpy() - lo.to_numpy()), pa.array([text[a : b + least] for a, b in zip(los, his, strict=True)], pa.binary())], names=["doc_id", "tag", "h", "at", "pos", "piece"])

    picked = texts.mapInArrow(lean(pick), f"{key}, h long, place int, lo int, hi int")
    # counted where they are dealt by anchor, so that anchors are picked and moved once, whatever their number
    often = picked.withColumn("c", F.count("*").over(Window.partitionBy("h"))).where("c > 1")
    kept = staged(often.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("h", "place", "lo", "hi")).alias("parts")), "kept")
    some = texts.alias("t").join(checked(kept.select("doc_id", "tag")).alias("k"), _alike("t", "k"), "left_semi")
    joined = some.alias("t").join(kept.alias("k"), _alike("t", "k")).select("t.doc_id", "t.tag", "text", "parts")
    pieces = staged(joined.mapInArrow(lean(cut), f"{key}, h long, at int, pos int, piece binary"), "pieces")
    dropped(kept)
    return pieces


def _same(column: pa.Array, i: int, n: int) -> pa.Array:
    return pa.repeat(column[i], n)


def _place(doc_id, tag, at) -> tuple:
    """Sorts as the corpus does, null ids last."""
    return doc_id is None, 0 if doc_id is None else doc_id, tag, at


def _deduplicated(pieces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The earliest of identical pieces of an anchor, and the others with its place."""
    same = pieces.groupBy("h", "piece").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag", "at", "pos", "lo", "hi")).alias("f"))
    hashed = [F.xxhash64("piece", F.lit(1)).alias("p1"), F.xxhash64("piece", F.lit(2)).alias("p2")]
    distinct = staged(same.select("h", "piece", *(F.col(f"f.{c}").alias(c) for c in ("doc_id", "tag", "at", "pos", "lo", "hi")), *hashed), "distinct")
    light = pieces.select("doc_id", "tag", "at", "h", F.octet_length("piece").alias("length"), *hashed)
    firsts = distinct.select("h", "p1", "p2", F.col("doc_id").alias("first_id"), F.col("tag").alias("first_tag"), F.col("at").alias("first_at"))
    copies = staged(light.join(firsts, ["h", "p1", "p2"]).where(~_is_first()).drop("h", "p1", "p2"), "copies")
    return distinct, copies


def _halved(crowded: DataFrame, least: int) -> DataFrame:
    """The windows of each piece in two pieces, those in which the anchor stands further left and further right.

    lo and hi bound the anchor's place in a window.  All windows of a half hold some bytes on one side of the anchor; these
    go into the hash by which the half is dealt, so equal windows still meet.
    """
    middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    ranges = F.explode(F.array(F.struct(F.col("lo").alias("lo"), middle.alias("hi")), F.struct(middle.alias("lo"), F.col("hi").alias("hi")))).alias("r")
    each = crowded.select("doc_id", "tag", "at", "pos", "piece", "h", ranges).select("doc_id", "tag", "at", "pos", "piece", "h", "r.lo", "r.hi")
    first = F.greatest(F.lit(0), F.col("pos") - F.col("hi") + 1)
    last = F.least(F.octet_length("piece") - least, F.col("pos") - F.col("lo"))
    bound = each.withColumns({"first": first, "last": last}).where("lo < hi and first <= last")
    around = F.substring("piece", F.col("pos") - F.col("lo") + 1, F.col("lo") + least - F.col("hi") + 1)
    return bound.select("doc_id", "tag", F.xxhash64("h", "lo", around).alias("h"), (F.col("at") + F.col("first")).alias("at"), (F.col("pos") - F.col("first")).alias("pos"), F.substring("piece", F.col("first") + 1, F.col("last") - F.col("first") + least).alias("piece"), "lo", "hi")


def _shares(texts: DataFrame, least: int, anchor: int, most_pieces: int) -> tuple[DataFrame, DataFrame]:
    """Distinct pieces with their anchor and share, and the copies of pieces.  Pieces that are alone with their anchor come along: to sort them out here would move all of them once more."""
    pieces = _pieces(texts, least, anchor).withColumns({"lo": F.lit(0), "hi": F.lit(least - anchor + 1)})
    ordinary, copies = [], []
    while True:
        distinct, same = _deduplicated(pieces)
        dropped(pieces)
        copies.append(same)
        counts = distinct.groupBy("h").agg(F.count("*").alias("c"), F.max(F.col("hi") - F.col("lo")).alias("span"))
        # a single place of the anchor leaves one window, the same in all
        crowd = staged(counts.where((F.col("c") > most_pieces) & (F.col("span") > 1)).select("h"), "crowd")
        crowded = not crowd.isEmpty()
        mine = distinct.join(checked(crowd), "h", "left_anti") if crowded else distinct
        shares = max(1, -(-distinct.count() // SHARE))
        ordinary.append(mine.select(F.concat(F.lit(f"{len(ordinary)} "), F.pmod(F.xxhash64("h", F.lit(3)), F.lit(shares))).alias("share"), "h", "doc_id", "tag", "at", "piece"))
        if not crowded:
            return reduce(DataFrame.unionByName, ordinary), reduce(DataFrame.unionByName, copies)
        pieces = staged(_halved(distinct.join(checked(crowd), "h", "left_semi"), least), "halved")


def _met(rows: pa.Table) -> pa.Table:
    """The pieces of a share that are not alone with their anchor."""
    _, inverse, counts = np.unique(rows["h"].to_numpy(), return_inverse=True, return_counts=True)
    return rows.filter(pa.array(counts[inverse] > 1))


def _is_first():
    return F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("tag") == F.col("first_tag")) & (F.col("at") == F.col("first_at"))


def repeat_groups(texts: DataFrame, least: int = LEAST, anchor: int = ANCHOR) -> tuple[DataFrame, DataFrame]:
    """Groups of repeats of at least `least` bytes among texts (doc_id, tag, text; distinct texts).

    The first table has a row for each group of maximal repeats: length and occurrences, an array of (doc_id, tag, at),
    earliest first.  Together the groups cover every byte that a repeat covers, but a repeat that is longer than a piece is
    told in several groups, and identical pieces are one occurrence; the second table tells them: doc_id, tag, at, length
    and, of the earliest with the same content, first_id, first_tag and first_at, one row for each but the earliest.
    """
    texts = bounded(texts)
    ordinary, copies = _shares(texts, least, anchor, MOST_PIECES)
    id_type = texts.schema["doc_id"].dataType.simpleString()

    def share(rows: pa.Table) -> pa.Table:
        rows = _met(rows)
        ids, tags, ats = rows["doc_id"].to_pylist(), rows["tag"].to_pylist(), rows["at"].to_pylist()
        lengths, lists = [], []
        for length, found in maximal_repeats(rows["piece"].to_pylist(), least):
            places = sorted(((ids[p], tags[p], ats[p] + o) for p, o in found), key=lambda x: _place(*x))
            lengths.append(length)
            lists.append([{"doc_id": d, "tag": t, "at": a} for d, t, a in places])
        return pa.table({"length": pa.array(lengths, pa.int32()), "occurrences": pa.array(lists, pa.list_(pa.struct([("doc_id", _arrow(id_type)), ("tag", pa.int64()), ("at", pa.int32())])))})

    return ordinary.groupBy("share").applyInArrow(share, f"length int, occurrences array<struct<doc_id:{id_type},tag:long,at:int>>"), copies


def later_spans(texts: DataFrame, least: int = LEAST, anchor: int = ANCHOR, most_pieces: int = MOST_PIECES) -> DataFrame:
    """doc_id, tag, at and length of what repeats something earlier: of every group of maximal repeats all occurrences but the earliest.

    A suffix is told once, at the longest prefix that it shares with an earlier one, which covers what it has in shorter
    groups; what touches within a piece is one row.
    """
    id_type = texts.schema["doc_id"].dataType.simpleString()
    ordinary, copies = _shares(texts, least, anchor, most_pieces)

    def share(rows: pa.Table) -> pa.Table:
        rows = _met(rows)
        ids, tags, ats = rows["doc_id"].to_pylist(), rows["tag"].to_pylist(), rows["at"].to_pylist()
        places = [_place(*x) for x in zip(ids, tags, ats, strict=True)]
        array = SuffixArray(rows["piece"].to_pylist(), places, least)
        which, spans_to = [], []
        for length, _, _, outdone in array.maximal():
            which += outdone
            spans_to += [length] * len(outdone)
        at = np.array(which, dtype=np.int64)
        piece, begin = array.piece[at], array.offset[at]
        end = begin + np.array(spans_to, dtype=np.int64)
        order = np.lexsort((begin, piece))
        out: list[list[int]] = []
        for p, a, b in zip(piece[order].tolist(), begin[order].tolist(), end[order].tolist(), strict=True):
            if out and out[-1][0] == p and a <= out[-1][2]:
                out[-1][2] = max(out[-1][2], b)
            else:
                out.append([p, a, b])
        return pa.table({"doc_id": pa.array([ids[p] for p, _, _ in out], rows["doc_id"].type), "tag": pa.array([tags[p] for p, _, _ in out], pa.int64()), "at": pa.array([ats[p] + a for p, a, _ in out], pa.int32()), "length": pa.array([b - a for _, a, b in out], pa.int32())})

    found = ordinary.groupBy("share").applyInArrow(share, f"doc_id {id_type}, tag long, at int, length int")
    return found.unionByName(copies.select("doc_id", "tag", "at", "length"))


def _arrow(id_type: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[id_type]


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, anchor: int = ANCHOR, most_pieces: int = MOST_PIECES) -> DataFrame:
    """For each distinct (doc_id, text): tag, text, copy and spans, the maximal runs [from, to) of bytes to remove.

    A byte goes if a string of `least` bytes over it also starts earlier, in a text with a smaller id or earlier in the
    same text.  Null ids come last; of different texts with one id, that with the smaller tag (a hash) is earlier, and rows
    alike in both are one document.  copy: the whole text is also that of an earlier row; then all of it goes if it has
    `least` bytes.  Null and empty texts lose nothing.  Offsets are in UTF-8 bytes.  An empty table gives no rows.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    identified = _identified(bounded(docs), id_col, text_col)
    identified = identified.withColumn("digest", F.unhex(F.md5("text")))
    by_id = identified.groupBy("tag", "digest", "doc_id").agg(F.count("*").alias("k"))
    firsts = by_id.groupBy("tag", "digest").agg(F.sum("k").alias("n"), F.min("doc_id").alias("least_id"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "k")).getField("k").alias("k"))
    # texts with one row need no join; of the others the row with the least id stays
    several = checked(staged(firsts.where("n > 1").select("tag", "digest", "least_id", (F.col("k") > 1).alias("alike")), "several"))
    marked = identified.join(several, ["tag", "digest"], "left")
    copy = F.coalesce(F.col("alike").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("least_id")), F.lit(False))
    told = marked.withColumn("copy", copy)
    distinct = told.drop("digest", "alike", "least_id")
    own = told.where(~F.col("copy") & (F.octet_length("text") >= least)).select("doc_id", "tag", "text", "digest", F.coalesce("alike", F.lit(False)).alias("alike"))
    # rows alike in id and text count once
    own = own.where(~F.col("alike")).unionByName(own.where("alike").dropDuplicates(["doc_id", "tag", "digest"])).select("doc_id", "tag", "text")
    found = later_spans(own, least, anchor, most_pieces)
    merged = staged(_merged(found.groupBy("doc_id", "tag").agg(F.collect_list(F.struct(F.col("at").alias("from"), (F.col("at") + F.col("length")).alias("to"))).alias("found"))), "found")
    ids = checked(merged.select("doc_id", "tag"))
    null_safe = _alike("d", "m")
    untouched = distinct.alias("d").join(ids.alias("m"), null_safe, "left_anti").withColumn("found", F.lit(None).cast("array<struct<from:int,to:int>>"))
    touched = distinct.alias("d").join(ids.alias("m"), null_safe, "left_semi").alias("d").join(merged.alias("m"), null_safe).select("d.*", "found")
    none = F.array().cast("array<struct<from:int,to:int>>")
    whole = F.array(F.struct(F.lit(0).alias("from"), F.octet_length("text").alias("to")))
    runs = F.when(F.col("copy"), F.when(F.octet_length("text") >= least, whole).otherwise(none)).when(F.col("found").isNull(), none).otherwise(F.col("found"))
    return untouched.unionByName(touched).select("doc_id", "tag", "text", "copy", runs.alias("spans"))


def _merged(found: DataFrame) -> DataFrame:
    """Overlapping and touching spans of each text as one, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            froms, tos, ends = [], [], [0]
            for parts in batch.column(2):
                a, b = (parts.values.field(k).to_numpy().astype(np.int64) for k in range(2))
                order = np.argsort(a, kind="stable")
                a, upto = a[order], np.maximum.accumulate(b[order])
                first = np.flatnonzero(np.concatenate([[True], a[1:] > upto[:-1]]))
                froms.append(a[first])
                tos.append(upto[np.concatenate([first[1:] - 1, [len(a) - 1]])])
                ends.append(ends[-1] + len(first))
            flat = [pa.array(np.concatenate(x).astype(np.int32)) if x else pa.array([], pa.int32()) for x in (froms, tos)]
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(flat, names=["from", "to"]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["doc_id", "tag", "found"])

    return found.mapInArrow(lean(run), found.schema)


def without(spanned: DataFrame, whole_characters: bool = False) -> DataFrame:
    """doc_id, tag, n_bytes, n_removed, n_spans and kept, the bytes outside the spans, for each row of spans().

    whole_characters gives up the bytes at the ends of spans that would cut a character, so that kept is UTF-8.
    """
    id_type = spanned.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                sizes, removed, counts, kept = [], [], [], []
                for i in range(batch.num_rows):
                    text, parts = batch.column(2)[i].as_buffer().to_pybytes(), batch.column(3)[i].as_py()
                    at, out, gone = 0, [], 0
                    for part in parts:
                        a, b = part["from"], part["to"]
                        if whole_characters:
                            while a < b and text[a] & 0xC0 == 0x80:
                                a += 1
                            while b > a and b < len(text) and text[b] & 0xC0 == 0x80:
                                b -= 1
                        out.append(text[at:a])
                        gone, at = gone + b - a, b
                    sizes.append(len(text))
                    removed.append(gone)
                    counts.append(len(parts))
                    kept.append(b"".join([*out, text[at:]]))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, pa.int64()) for x in (sizes, removed, counts)), pa.array(kept, pa.binary())], names=["doc_id", "tag", "n_bytes", "n_removed", "n_spans", "kept"])

    return spanned.select("doc_id", "tag", "text", "spans").mapInArrow(lean(run), f"doc_id {id_type}, tag long, n_bytes long, n_removed long, n_spans long, kept binary")
