"""Operators on texts against brute force, and on odd tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flocktrace.llm import bpe, jaccard, oph, queries, repeats, rules, shingles, token_store, wordids
from flocktrace.llm.queries import tokenizer_file

WORD = re.compile(r"[^\x20\x09-\x0d]+")
BYTE_BPE, WORD_BPE = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("word_bpe_49k.json")
ODD = [None, "", "   \n\t ", "one", "Êté déjà, vu! <|endoftext|>x", "a\u3000b\x1cc\x85d", "日本語 日本語", "don't  I'll \n\n x ", "x" * 3000, "# * $ % & | < >", "\x00 nul"]


def docs(spark, texts, ids=None):
    """Rows with columns whose names clash with those that operators make."""
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "s", 7, 1.5, [1]) for i, t in zip(ids, texts, strict=True)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n bigint, stats double, ids array<int>")


def _thue_morse(doublings):
    out = "a"
    for _ in range(doublings):
        out += out.translate(str.maketrans("ab", "ba"))
    return out


#: Long words that polynomial hashes modulo a power of two take for one.
TWINS = [_thue_morse(11), _thue_morse(11).translate(str.maketrans("ab", "ba"))]


def corpus(seed=1, n=250):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 7))) for _ in range(1500)]
    base = [[r.choice(vocabulary) for _ in range(r.randint(3, 90))] for _ in range(30)]
    passage = [[r.choice(vocabulary) for _ in range(60)] for _ in range(3)]
    out = list(ODD)
    for _ in range(n):
        w = list(r.choice(base)) if r.random() < 0.6 else [r.choice(vocabulary) for _ in range(r.randint(1, 60))]
        for _ in range(r.choice([0, 0, 1, 2, 5])):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        if r.random() < 0.3:
            at = r.randint(0, len(w))
            w = w[:at] + r.choice(passage) + w[at:]
        out.append((" " if r.random() < 0.9 else "\n").join(w))
    return out


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    texts = corpus()
    library = Tokenizer.from_file(BYTE_BPE)
    wanted = [x.ids for x in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    out = bpe.decode(bpe.encode(docs(spark, texts), BYTE_BPE), BYTE_BPE).orderBy("doc_id").collect()
    assert [r.ids for r in out] == wanted
    assert [r.decoded for r in out] == [library.decode(x, skip_special_tokens=False) for x in wanted]


def test_bpe_on_random_pieces():
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(BYTE_BPE), bpe.load(BYTE_BPE)
    r = random.Random(3)
    for _ in range(3000):
        text = "".join(r.choice("aehtsinor 'l  \n\té,!.0") for _ in range(r.randint(1, 40)))
        assert np.frombuffer(own.encode(text), dtype=np.int32).tolist() == library.encode(text, add_special_tokens=False).ids


def test_bpe_refuses_other_files():
    with pytest.raises(ValueError):
        bpe.PrefixBpe(WORD_BPE)


def test_empty_tables(spark):
    none = docs(spark, [])
    assert bpe.encode(none, BYTE_BPE).count() == 0
    assert jaccard.join(none).count() == 0
    assert repeats.without(repeats.spans(none)).count() == 0
    assert oph.with_next(oph.with_fingerprint(none), {"text": "next"}).count() == 0
    assert rules.judged(none, rules.DecisionList()).count() == 0


@pytest.mark.parametrize("tokenizer", [WORD_BPE, BYTE_BPE])
def test_store_round_trip(spark, tokenizer):
    from tokenizers import Tokenizer

    texts = corpus(2)
    texts += texts[40:60]
    path = token_store.new_store(spark)
    token_store.write(docs(spark, texts).repartition(3), path, tokenizer, end_id=1, least=8, usual=16, most=64)
    wanted = [[*x.ids, 1] for x in Tokenizer.from_file(tokenizer).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    got = token_store.read_ids(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in got] == list(range(len(texts))) and [r.ids for r in got] == wanted
    checks = token_store.read_checks(spark, path).orderBy("doc_id").collect()
    starts = np.cumsum([0, *map(len, wanted)])[:-1].tolist()
    assert [(c.start, c.n_tokens, c.ids_crc32) for c in checks] == [(s, len(w), zlib.crc32(np.array(w, dtype="<u4").tobytes())) for s, w in zip(starts, wanted, strict=True)]
    chunks = spark.read.parquet(f"{path}/chunks")
    assert chunks.count() == chunks.select("chunk_id").distinct().count() < sum(len(r.chunk_ids) for r in token_store.read_recipes(spark, path).collect())


def test_store_without_end_ids_holds_empty_texts(spark):
    texts, ids = ["", "one two", None, "three", "", "one two"], [1, 2, None, 2, 3, None]
    path = token_store.new_store(spark)
    token_store.write(docs(spark, texts, ids), path, WORD_BPE, least=8, usual=16, most=64)
    from tokenizers import Tokenizer

    wanted = sorted((repr(i), Tokenizer.from_file(WORD_BPE).encode(t or "", add_special_tokens=False).ids) for i, t in zip(ids, texts, strict=True))
    assert sorted((repr(r.doc_id), r.ids) for r in token_store.read_ids(spark, path).collect()) == wanted
    assert token_store.read_checks(spark, path).count() == 6
    none = token_store.new_store(spark)
    token_store.write(docs(spark, []), none, WORD_BPE, end_id=1)
    assert token_store.read_ids(spark, none).count() == token_store.read_checks(spark, none).count() == 0


def test_damaged_chunks_raise(spark):
    path = token_store.new_store(spark)
    token_store.write(docs(spark, ["some words here"]), path, WORD_BPE)
    chunk = spark.read.parquet(f"{path}/chunks").first()
    broken = spark.createDataFrame([(chunk.chunk_id, chunk.n_ids, bytearray(b"\x00" * len(chunk.payload)))], "chunk_id binary, n_ids int, payload binary")
    broken.write.mode("overwrite").parquet(f"{path}/chunks")
    with pytest.raises(Exception, match="damaged"):
        token_store.read_checks(spark, path).collect()


def _components(texts, ids, size, percent):
    sets = []
    for t in texts:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    parent = list(range(len(texts)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    parent[find(i)] = find(j)
    least = {}
    for i in range(len(texts)):
        least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return [(len(s), least[find(i)]) for i, s in enumerate(sets)]


@pytest.mark.parametrize("size,percent,most", [(4, 85, 48), (5, 80, 3), (2, 70, 2)])
def test_join_equals_all_pairs(spark, monkeypatch, size, percent, most):
    monkeypatch.setattr(jaccard, "LIST", most)
    texts = corpus(5)
    ids = [(i * 37) % 1009 for i in range(len(texts))]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(docs(spark, texts, ids), shingle=size, percent=percent).collect()}
    assert got == dict(zip(ids, _components(texts, ids, size, percent), strict=True))


def test_long_words_are_told_apart(spark):
    from tokenizers import Tokenizer

    a, b = TWINS
    texts = [a, b, f"{a} x y z", f"{b} x y z", f"{a}\n{b}\n{a}", " ".join([a, "q"] * 4 + [b, "q"] * 4)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(docs(spark, texts), shingle=4, percent=85).collect()}
    assert got == dict(enumerate(_components(texts, range(6), 4, 85)))
    flat, ends = wordids.WordEncoder(WORD_BPE).encode(pa.array(texts))
    library = Tokenizer.from_file(WORD_BPE)
    assert [flat[x:y].tolist() for x, y in zip(ends[:-1], ends[1:], strict=True)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    made = rules.statistics_of(pa.array(texts))
    assert made["n_dup_lines"].tolist() == [0, 0, 0, 0, 1, 0] and made["n_distinct_words"].tolist() == [1, 1, 4, 4, 2, 3] and made["n_repeat_words"].tolist() == [0] * 6
    assert len(np.unique(shingles.hashes(pa.array([x.encode() for x in TWINS])))) == 2


def test_word_ids_equal_the_library_on_all_pairs_of_characters():
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(WORD_BPE), wordids.WordEncoder(WORD_BPE)
    chars = [chr(c) for c in range(1, 0x180)] + list("\u0301\u0308\u3000\u212b日😀")
    r = random.Random(4)
    parts = [*"aAbz09.,!?'sStTrR|<>#éÉß×÷ \n\t-_$", "'s", "<|endoftext|>", "<|", "\u0301", "日"]
    texts = [a + b for a in chars for b in chars] + [f"x{a}{b}y" for a in chars for b in chars] + ["".join(r.choice(parts) for _ in range(r.randint(0, 25))) for _ in range(20000)]
    for at in range(0, len(texts), 20000):
        some = texts[at : at + 20000]
        flat, ends = own.encode(pa.array(some))
        for t, x, y, made in zip(some, ends[:-1], ends[1:], library.encode_batch(some, add_special_tokens=False), strict=True):
            assert flat[x:y].tolist() == made.ids, repr(t)


def test_forgetting_changes_no_ids(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(wordids, "REMEMBERED", 300)
    texts, own, library = corpus(21), wordids.WordEncoder(WORD_BPE), Tokenizer.from_file(WORD_BPE)
    for _ in range(2):
        for at in range(0, len(texts), 20):
            flat, ends = own.encode(pa.array(texts[at : at + 20]))
            assert [flat[x:y].tolist() for x, y in zip(ends[:-1], ends[1:], strict=True)] == [library.encode(t or "", add_special_tokens=False).ids for t in texts[at : at + 20]]


def test_sets_that_share_a_name_get_another(spark):
    rows = spark.createDataFrame([(1, 10, "x"), (1, 20, "y"), (1, 10, "z"), (2, 30, "w")], "sid long, sid_check long, what string")
    named = rows.groupBy("sid").agg(F.min("sid_check").alias("lo"), F.max("sid_check").alias("hi"))
    names = jaccard._clashes(rows, named, "sid", "sid_check")
    assert names == {(1, 20): 20} and jaccard._name(b"x", {jaccard._key(b"x"): 5}) == 5
    assert {r.what: r.sid for r in jaccard._renamed(rows, "sid", "sid_check", names).collect()} == {"x": 1, "y": 20, "z": 1, "w": 2}


def test_join_with_null_and_repeated_ids(spark):
    w = [f"w{i}" for i in range(30)]
    rows = [(None, " ".join(w)), (4, " ".join(w)), (4, " ".join([*w, "more"])), (None, "alone in the world"), (9, None), (None, ""), (4, "quite another text")]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"), shingle=4, percent=85).collect()), key=repr)
    assert got == sorted([(None, 27, 4), (4, 27, 4), (4, 28, 4), (None, 1, None), (9, 0, 9), (None, 0, None), (4, 1, 4)], key=repr)


def test_linked_sets_share_a_part():
    r = np.random.default_rng(1)
    for _ in range(300):
        n = int(r.integers(1, 120))
        x = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64))
        away = int(r.integers(0, max(1, len(x) * 3 // 20 + 1)))
        y = np.unique(np.concatenate([x[away:], r.integers(0, 1 << 63, int(r.integers(0, away + 1)), dtype=np.uint64)]))
        both = len(np.intersect1d(x, y))
        if both and 100 * both >= 85 * (len(x) + len(y) - both):
            assert set(jaccard.part_keys(x, 85)) & set(jaccard.part_keys(y, 85))


def _removed(texts, least):
    seen, out = set(), []
    for t in texts:
        b = (t or "").encode()
        gone = np.zeros(len(b), dtype=bool)
        for p in range(len(b) - least + 1):
            if b[p : p + least] in seen:
                gone[p : p + least] = True
            seen.add(b[p : p + least])
        kept = np.frombuffer(b, dtype=np.uint8)[~gone].tobytes()
        out.append((len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), kept))
    return out


@pytest.mark.parametrize("most_pieces", [8000, 1])
def test_repeats_equal_brute_force(spark, most_pieces):
    texts = corpus(7) + ["ab" * 400, "passage " * 60]
    texts += texts[30:50]
    got = repeats.without(repeats.spans(docs(spark, texts).repartition(3), most_pieces=most_pieces)).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got] == _removed(texts, 100)


def test_repeats_with_null_ids_and_repeated_rows(spark):
    p = "a shared passage of one hundred and forty bytes or a little more, that stands in three texts of which one has no id at all, as it may be"
    rows = [(1, f"x1 {p} end"), (None, f"y {p} other"), (2, f"zz {p}"), (2, f"zz {p}"), (5, f"x1 {p} end")]
    got = sorted((r.doc_id is None, r.doc_id, r.n_removed, r.n_spans) for r in repeats.without(repeats.spans(spark.createDataFrame(rows, "doc_id long, text string"))).collect())
    n = len(p)
    # 'y ' and ' other' stay of the null one, ' ' before the passage repeats too
    assert got == [(False, 1, 0, 0), (False, 2, n + 1, 1), (False, 2, n + 1, 1), (False, 5, len(rows[4][1]), 1), (True, None, n + 2, 1)]


def test_many_variants_of_one_anchor(spark):
    r = random.Random(3)
    anchor = "".join(r.choice("abcdefgh") for _ in range(60))
    texts = ["".join(r.choice("abcd") for _ in range(r.choice([30, 60]))) + anchor + "".join(r.choice("ab") for _ in range(40)) for _ in range(10000)]
    got = repeats.without(repeats.spans(docs(spark, texts).repartition(3))).orderBy("doc_id").collect()
    assert [(x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept)) for x in got] == _removed(texts, 100)


def test_maximal_repeats_hold_all_occurrences():
    r = random.Random(8)
    rnd = lambda n: bytes(r.choice(b"abcdefgh") for _ in range(n))
    p = rnd(150)
    pieces = [rnd(19) + b"S" + p + b"T" + rnd(8), rnd(4) + b"U" + p, rnd(29) + b"V" + p[10:] + b"W" + rnd(2), rnd(200)]
    found = {length: sorted(places) for length, places in repeats.maximal_repeats(pieces)}
    assert found[150] == [(0, 20), (1, 5)] and found[140] == [(0, 30), (1, 15), (2, 30)] and len(found) == 2


def test_groups_name_all_places(spark):
    p = "a passage of more than a hundred bytes, all of it the same wherever it stands, and long enough to be found at once"
    texts = docs(spark, [f"one {p} end", f"other {p}!", p[5:] + " and more"])
    identified = repeats._identified(texts, "doc_id", "text")
    groups, copies = repeats.repeat_groups(identified)
    found = {o.doc_id for g in groups.collect() for o in g.occurrences} | {r.doc_id for r in copies.collect()} | {r.first_id for r in copies.collect()}
    assert found == {0, 1, 2}


def test_whole_characters_stay(spark):
    texts = ["é" * 80 + "x", "y" + "é" * 80]
    for r in repeats.without(repeats.spans(docs(spark, texts)), whole_characters=True).collect():
        bytes(r.kept).decode()


def test_fingerprints_estimate_likeness(spark):
    texts = corpus(9)
    out = oph.with_fingerprint(docs(spark, texts).select("doc_id", "text")).orderBy("doc_id").collect()
    prints = [r.fingerprint for r in out]
    assert all(p == "" or len(p) == 512 for p in prints) and [p == "" for p in prints] == [not WORD.findall(t or "") for t in texts]
    assert len({p for t, p in zip(texts, prints, strict=True) if t == texts[20]}) == 1
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (WORD.findall(t or "") for t in texts)]
    long = [i for i, s in enumerate(sets) if len(s) >= 40][:80]
    pairs = [(i, j) for i in long for j in long if j < i]
    frame = spark.createDataFrame([(prints[i], prints[j], len(sets[i] & sets[j]) / len(sets[i] | sets[j])) for i, j in pairs], "a string, b string, j double")
    from pyspark.sql import functions as F

    error = np.array([r.e for r in frame.select((oph.likeness(F.col("a"), F.col("b")) - F.col("j")).alias("e")).collect()])
    assert abs(error.mean()) < 0.01 and np.abs(error).max() < 0.2


def test_next_is_the_lower_id_and_wraps(spark):
    df = docs(spark, ["a", "b", "c", None], [5, -3, 90, 7]).select("doc_id", "text")
    got = {r.doc_id: r.next for r in oph.with_next(df, {"text": "next"}).collect()}
    assert got == {90: None, 7: "a", 5: "b", -3: "c"}
    assert [r.next for r in oph.with_next(df.limit(1), {"text": "next"}).collect()] == ["a"]


def test_next_over_many_ranges_null_ids_and_names(spark):
    r = random.Random(13)
    rows = [(i, f"t{i}", "k") for i in range(0, 2000, 3)] + [(None, f"n{i}", "k") for i in range(300)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, _key string")
    out = oph.with_next(df, {"text": "next"}, tie=F.xxhash64("text"))
    assert out.columns == ["doc_id", "text", "_key", "next"]
    follows = {(x.doc_id, x.text): x.next for x in out.collect()}
    ids = sorted((x for x in rows if x[0] is not None), reverse=True)
    assert len(follows) == len(rows) and all(follows[a[:2]] == b[1] for a, b in zip(ids, ids[1:], strict=False))
    at, seen = follows[ids[-1][:2]], set()
    while (None, at) in follows and at not in seen:
        seen.add(at)
        at = follows[None, at]
    assert len(seen) == 300 and at == ids[0][1]
    names = oph.with_next(spark.createDataFrame([("x", "a"), ("b", "b"), (None, "c"), ("z", "e")], "doc_id string, text string"), {"text": "next"}).collect()
    assert {x.doc_id: x.next for x in names} == {"z": "a", "x": "b", "b": "c", None: "e"}


def test_fingerprint_query_equals_its_definition(spark, tmp_path):
    """Edited texts, their fingerprints and all likenesses against a plain version."""
    texts = [t for t in corpus(17, 40)]
    rows = list(zip([r * 7 % 101 for r in range(len(texts))], texts, strict=True))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    order = sorted(((i, t or "") for i, t in rows), reverse=True)
    following = {i: order[(k + 1) % len(order)][1] for k, (i, _) in enumerate(order)}
    cut = {i: t[: len(t) - len(t) // 2] + following[i][: len(t) // 2] for i, t in order}
    plain = oph.with_fingerprint(spark.createDataFrame([(t,) for t in {*cut.values(), *following.values()}], "text string")).collect()
    prints = {r.text: r.fingerprint for r in plain}

    def likeness(a, b):
        if a == b:
            return 1.0
        if not a or not b:
            return 0.0
        same = sum(a[k : k + 2] == b[k : k + 2] for k in range(0, 512, 2))
        return max(0.0, (same / 256 - 1 / 256) / (1 - 1 / 256))

    got = queries.op9_fingerprints(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    for r in got:
        text = dict(order)[r.doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(cut[r.doc_id].encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (prints[text], prints[cut[r.doc_id]])
        assert r.near_edited == pytest.approx(likeness(r.fingerprint, r.edited_fingerprint)) and r.near_next == pytest.approx(likeness(r.fingerprint, prints[following[r.doc_id]]))


def test_bins_hold_the_least_hashes(spark):
    """Bins before they are filled, and what fills them, by definition."""
    import random as rnd

    hashes = [[rnd.Random(k).randrange(-(1 << 63), 1 << 63) for k in range(j * 100, j * 100 + n)] for j, n in enumerate([0, 1, 3, 40, 900])]
    df = spark.createDataFrame(list(enumerate(hashes)), "k int, h array<long>")
    out = df.select("k", oph._bins(F.col("h"), 16).alias("bins")).withColumn("full", oph._densified(F.col("bins"), 16, 7)).orderBy("k").collect()
    for row, own in zip(out, hashes, strict=True):
        least = [None] * 16
        for h in own:
            packed = (h & (1 << 64) - 1) >> 64 - 40 - 4
            place, value = packed >> 40, packed & (1 << 40) - 1
            least[place] = value if least[place] is None else min(least[place], value)
        assert row.bins == (least if own else [])
        assert all(b == f if b is not None else f in least for b, f in zip(row.bins, row.full, strict=True)) and None not in row.full


def test_statistics_equal_their_definitions(spark):
    texts = [*corpus(11), "w1 w2 w3 w4 w5 w6 w7 w8 " * 3, "a line\na line\n\n \na line", "A\n\nA"]
    got = rules.with_statistics(docs(spark, texts)).orderBy("doc_id").collect()
    for row, text in zip(got, texts, strict=True):
        w = WORD.findall(text or "")
        windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        covered = {k for i, g in enumerate(windows) if windows.count(g) > 1 for k in range(i, i + 8)}
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        s = row.stats
        assert (s.n_words, s.word_chars, s.n_repeat_words, s.n_dup_lines, s.n_lines, s.n_distinct_words, s.n_chars) == (len(w), sum(map(len, w)), len(covered), len(lines) - len(set(lines)), len(lines), len(set(w)), len(text or ""))
        assert s.n_symbols == sum((text or "").count(c) for c in "#*$%&|<>")


def test_rules_learn_a_planted_threshold(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    texts = [" ".join(word() + ("###" if i % 3 == 0 else "") for _ in range(60)) for i in range(240)]
    df = docs(spark, texts)
    labels = spark.createDataFrame([(i, 0 if i % 3 == 0 else 1) for i in range(0, 240, 2)] + [(None, 1), (3, None)], "doc_id long, quality int")
    found = rules.fit(df, labels)
    assert found.rules and {x.doc_id for x in rules.judged(df, found).where("kept").collect()} == {i for i in range(240) if i % 3}
    assert rules.passed(df, found).columns == df.columns
    assert rules.fit(df, labels.limit(0)).rules == []


def test_rules_need_held_out_rows_and_break_ties_in_order():
    values = {"a": np.array([0.0, 0, 0, 1, 1, 1] * 4), "b": np.array([0.0, 0, 0, 1, 1, 1] * 4)}
    bad = values["a"] > 0
    none = rules.learn(values, bad, np.zeros(24, dtype=bool))
    assert none.rules == []  # nothing to accept a rule on
    some = rules.learn(values, bad, np.arange(24) % 2 == 0)
    assert [str(c) for c in some.rules[0]] == ["a >= 0.5"] and (some.rejects(values) == bad).all()


def test_learned_list_equals_plain_covering(spark):
    """Each rule's first condition has the greatest gain of all thresholds tried one by one."""
    r = np.random.default_rng(5)
    values = {k: r.random(300).round(2) for k in "abc"}
    bad = (values["b"] > 0.7) & (values["c"] < 0.6)
    rows = np.arange(300)
    gain, found = rules._best_condition(values, bad, rows)
    best = 0.0
    for v in values.values():
        edges = np.unique(v)
        for t in (edges[1:] + edges[:-1]) / 2:
            for covered in (v <= t, v >= t):
                p, n = (covered & bad).sum(), (covered & ~bad).sum()
                if p:
                    best = max(best, p * (np.log2(p / (p + n)) - np.log2(bad.mean())))
    assert gain == pytest.approx(best) and found.name in "bc"
    kept = rules.learn(values, bad, r.random(300) < 0.3)
    assert (kept.rejects(values) & ~bad).sum() <= 0.05 * max(1, kept.rejects(values).sum())


def test_digest_of_decoded(spark):
    out = bpe.decode(bpe.encode(docs(spark, ["déjà vu"]), BYTE_BPE), BYTE_BPE).first()
    assert hashlib.sha256(out.decoded.encode()).hexdigest() == hashlib.sha256("déjà vu".encode()).hexdigest()


def test_repeats_pick_anchors_once_and_move_pieces_once(spark, monkeypatch):
    draw = random.Random(11)
    passage = lambda: "".join(draw.choices("abcdefgh ", k=300))
    shared = [passage() for _ in range(4)]
    texts = [passage() + shared[i % 4] + passage() for i in range(24)]
    # as with large tables, nothing is small enough to be broadcast
    monkeypatch.setattr(repeats, "checked", lambda small: small)
    plans, stage = [], repeats.staged
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(repeats, "staged", lambda df, name: (plans.append(plan(df)), stage(df, name))[1])
    identified = repeats._identified(repeats.bounded(docs(spark, texts)), "doc_id", "text")
    ordinary, _ = repeats._shares(identified, repeats.LEAST, repeats.ANCHOR, repeats.MOST_PIECES)
    assert sum("place#" in p and "MapInArrow" in p for p in plans) == 1
    assert "Join" not in plan(ordinary)
    got = repeats.without(repeats.spans(docs(spark, texts))).orderBy("doc_id").collect()
    assert [r.n_removed >= 300 for r in got] == [i >= 4 for i in range(24)]
