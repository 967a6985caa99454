"""Operators 11, 12 and 13: against plain versions, and their defined edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from adjudica.llm import alignment, encoders, kdmeans, packing
from adjudica.llm.queries import ORACLE_SQL, PIECES, QUERIES, VOCABULARY, op11_packing, op12_alignment, op13_clustering

from ..oracle import duck, same

ODD = [
    None, "", " ", "  \n ", "a", "plain words here", "two  spaces and\ttabs \n\n lines ", "<|endoftext|> inside <s> x</s>", "é ﬁ 你好世界 مرحبا 🙂👩‍👩‍👧",
    "x" * 5000, " " * 3000, "tail ", "under▁score", "nul\0byte", "word " * 3000, "同じ" * 2000, "a\n b\r\n  c", "\n\n\nstart", "'s don't 12 345,6",
]


def documents(spark, texts, ids=None):
    rows = [(i, t, 1, 2) for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids int, block int")


@pytest.fixture(scope="module")
def exact():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCABULARY)


# -- 11 ------------------------------------------------------------------------------------


def check_pieces(rows, want: dict, capacity: int) -> int:
    """Every id once, sequences without gaps and not over capacity; the padding."""
    by_doc, by_sequence, padding = defaultdict(list), defaultdict(list), 0
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(want)
    for doc_id, pieces in by_doc.items():
        got, at = b"", 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert (r.start, len(r.ids), r.doc_tokens) == (at, 4 * r.length, len(want[doc_id]))
            got, at = got + bytes(r.ids), at + r.length
        assert np.frombuffer(got, "<u4").tolist() == want[doc_id]
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding


@pytest.mark.parametrize("capacity", [16, 1024])
def test_packed_pieces_hold_every_id_once(spark, exact, capacity):
    rng = random.Random(5)
    texts = ODD + [" ".join(rng.choices(["alpha", "be", "gamma9", "déjà", "x"], k=rng.randint(0, 700))) for _ in range(60)] + ["same text"] * 12
    want = {i: [*exact.encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}
    rows = packing.pack(documents(spark, texts).repartition(3), VOCABULARY, capacity).collect()
    assert check_pieces(rows, want, capacity) == 0


def test_packing_query_gives_the_digest_of_each_piece(spark):
    found = op11_packing(spark, "/root/testdata/sf0.001")
    assert found.columns == ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids_crc32"]
    pieces = packing.pack(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), VOCABULARY)
    crcs = {(r.doc_id, r.start): zlib.crc32(bytes(r.ids)) for r in pieces.collect()}
    got = {(r.doc_id, r.start): r.ids_crc32 for r in found.collect()}
    assert got == crcs


def test_repeated_and_null_ids_are_packed_each_by_itself(spark, exact):
    docs = documents(spark, ["one two", "one two", "three", None], [7, 7, None, None])
    rows = packing.pack(docs, VOCABULARY).collect()
    assert sorted((r.doc_id is None, r.doc_tokens) for r in rows if r.start == 0) == [(False, 3), (False, 3), (True, 1), (True, 2)]
    assert sum(r.length for r in rows) == 9
    assert packing.pack(docs.where("false"), VOCABULARY).collect() == []
    with pytest.raises(ValueError, match="power of two"):
        packing.pack(docs, VOCABULARY, 1000)


@pytest.mark.parametrize("counts", [{700: 50_001}, {1: 3}, {1023: 7, 1: 5}, {5: 10**9, 700: 10**6}, {}, {512: 4}, {3: 1}])
def test_plans_follow_lengths_and_not_documents(counts):
    slots, made = packing.plan(counts)
    tokens = sum(n * c for n, c in counts.items())
    assert sum(s.length * (s.last - s.first) for s in slots) == tokens
    assert made == tokens // 1024 + bin(tokens % 1024).count("1")
    assert len(slots) < 400


def test_every_rank_is_laid_once_without_padding():
    rng = random.Random(3)
    counts = {rng.randint(1, 63): rng.randint(1, 40) for _ in range(30)}
    slots, made = packing.plan(counts, 64)
    covered, filled = Counter(), defaultdict(list)
    for s in slots:
        for rank in range(s.first, s.last):
            covered.update((s.rest, rank, s.start + i) for i in range(s.length))
            sequence, offset = s.place(rank)
            filled[sequence].append((offset, s.length))
    assert covered == Counter((n, rank, i) for n, c in counts.items() for rank in range(c) for i in range(n))
    assert sorted(filled) == list(range(made))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 64 or at & (at - 1) == 0


def test_subset_sums_are_the_closest():
    rng = random.Random(8)
    for _ in range(60):
        counts = {rng.randint(1, 12): rng.randint(1, 3) for _ in range(3)}
        room = rng.randint(1, 30)
        sums = {0}
        for n, c in counts.items():
            sums = {s + n * k for s in sums for k in range(c + 1)}
        chosen = packing.closest(counts, room)
        assert sum(n * c for n, c in chosen.items()) == max(s for s in sums if s <= room)
        assert all(c <= counts[n] for n, c in chosen.items())


def test_rank_encoder_equals_the_files_tokenizer(exact):
    raw = encoders.read_file(VOCABULARY)
    texts = [t for t in ODD if t] + [" " * 400_000]  # the last is refused by the rank encoder's patterns
    assert encoders.byte_bpe(raw)(texts) == [exact.encode(t, add_special_tokens=False).ids for t in texts]
    assert encoders.byte_bpe(raw, special=False)(["<|endoftext|>"]) != [[50256]]
    with pytest.raises(FileNotFoundError, match="ADJUDICA"):
        encoders.read_file("/nowhere/v.json")


# -- 12 ------------------------------------------------------------------------------------


def plain_alignment(texts):
    """The result by its definition, over whole texts."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_side = Tokenizer.from_file(VOCABULARY)
    a_side.encode_special_tokens = True
    letters = {chr(b): b for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}
    letters |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(letters.values()))}
    a_bytes = {i: bytes(letters[c] for c in e) for e, i in a_side.get_vocab(with_added_tokens=False).items() if i != 50256}
    b_side = sentencepiece.SentencePieceProcessor(model_file=PIECES)

    def b_bytes(i):
        piece = b_side.id_to_piece(i)
        byte = re.fullmatch("<0x(..)>", piece)
        return bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode()

    out, links, seen = [], [], Counter()
    for text in texts:
        out.append([0, 0, 0, 0, 0, 0, ""])
        links.append(Counter())
        if not text:
            continue
        a, b = a_side.encode(" " + text, add_special_tokens=False).ids, b_side.encode(text)
        spelt = [b"".join(a_bytes[i] for i in a), b"".join(map(b_bytes, b))]
        if any(s != (" " + text).encode() for s in spelt):
            continue
        ends = [np.cumsum([len(f(i)) for i in ids]).tolist() for f, ids in ((a_bytes.get, a), (b_bytes, b))]
        groups, i, j = [], 0, 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            x, y = ends[0].index(end) + 1, ends[1].index(end) + 1
            groups.append((a[i:x], b[j:y]))
            i, j = x, y
        for left, right in groups:
            links[-1].update((p, q) for p in left for q in right)
        digest = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        out[-1] = [len(a), len(b), len(groups), sum(links[-1].values()), 0, 0, hashlib.sha256(digest.encode()).hexdigest()]
        seen.update(links[-1].keys())
    most = defaultdict(int)
    for (p, _), n in seen.items():
        most[p] = max(most[p], n)
    for row, found in zip(out, links, strict=True):
        row[4] = sum(n for k, n in found.items() if seen[k] == most[k[0]])
        row[5] = sum(n * seen[k] for k, n in found.items())
    return out


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("block", [200, 20_000_000])
def test_alignment_equals_its_definition(spark, monkeypatch, block):
    monkeypatch.setattr(alignment, "BLOCK_CHARS", block)
    rng = random.Random(6)
    pool = ["alignment", "naïve", "don't", "x.\nThen", "12,5", "zürich", "(see", "…", "a", "$$$", "l'été", "日本語"]
    texts = ODD + [" ".join(rng.choices(pool, k=rng.randint(1, 60))) for _ in range(30)] + ["same text"] * 3
    got = {r.doc_id: [r[c] for c in COLUMNS] for r in alignment.align_documents(documents(spark, texts).repartition(3), VOCABULARY, PIECES).collect()}
    assert got == dict(enumerate(plain_alignment(texts)))
    assert got[12] == [0, 0, 0, 0, 0, 0, ""]  # the piece for a space spells another character


def test_without_verified_cuts_the_result_is_the_same(spark, monkeypatch):
    texts = [t for t in ODD if t is None or len(t) < 200]
    assert alignment.separable(encoders.read_file(VOCABULARY), encoders.read_file(PIECES))
    monkeypatch.setattr(alignment, "separable", lambda *_: False)
    got = {r.doc_id: [r[c] for c in COLUMNS] for r in alignment.align_documents(documents(spark, texts), VOCABULARY, PIECES).collect()}
    assert got == dict(enumerate(plain_alignment(texts)))


def test_segments_join_to_the_text():
    for text in (t for t in ODD if t):
        found = alignment.segments(text, True)
        assert "".join(found) == " " + text and all(s[0] == " " for s in found) and all(len(s) > 1 or text == "" or s == " " + text for s in found)


def test_wide_groups_and_giant_segments(monkeypatch):
    aligner = alignment.Aligner(encoders.read_file(VOCABULARY), encoders.read_file(PIECES))
    texts = [" abc", " under▁", " 你好世界"]
    numbers, sizes = aligner.align(texts)
    assert sizes[1] == 0 and sizes[0] > 0
    ends = np.cumsum(sizes)
    words = [numbers[e - n : e] for e, n in zip(ends, sizes, strict=True)]
    raw, length = alignment.pack(numbers, sizes)
    back = alignment.unpack([raw[e - n : e] for e, n in zip(np.cumsum(length), length, strict=True)])
    assert back[0].tolist() == numbers.tolist() and back[1].tolist() == sizes.tolist()

    def table(order, giant):
        packed = lambda i: alignment.pack(words[i], sizes[i : i + 1])[0]
        columns = {"code": pa.array(order, pa.int32()), "words": pa.array([None if i == giant else packed(i) for i in order], pa.binary())}
        return pa.table(columns | {"wide": pa.array([words[i].astype("<u4").tobytes() if i == giant else None for i in order], pa.binary())})

    plain = alignment.Segments(table([0, 1, 2], None), 32_000)
    monkeypatch.setattr(alignment, "WIDE_GROUP", 0)
    monkeypatch.setattr(alignment, "DECODED", 2)
    wide = alignment.Segments(table([2, 0, 1], 2), 32_000)
    assert plain.text == wide.text
    for k in ("keys", "times", "pairs", "pairs_of", "sums"):
        assert getattr(plain, k).tolist() == getattr(wide, k).tolist()


def test_alignment_of_odd_tables(spark):
    docs = documents(spark, ["one two", "one two", None, "three"], [7, 7, None, None])
    rows = alignment.align_documents(docs, VOCABULARY, PIECES).collect()
    assert sorted((r.doc_id is None, r.n_a) for r in rows) == [(False, 2), (False, 2), (True, 0), (True, 1)]
    assert alignment.align_documents(docs.where("false"), VOCABULARY, PIECES).collect() == []
    assert op12_alignment(spark, "/root/testdata/sf0.001").columns == ["doc_id", *COLUMNS]


def test_a_segment_over_several_batches_keeps_its_alignment(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        rows = spark.createDataFrame([(b, 0, " word") for b in range(7)] + [(1, 1, " other")], "block long, code int, segment string")
        shipped = [spark.sparkContext.broadcast(encoders.read_file(p)) for p in (VOCABULARY, PIECES)]
        for narrow in (True, False):
            found = alignment.aligned(rows, *shipped, narrow).collect()
            assert len(found) == 8 and len({bytes(r.words or r.wide) for r in found}) == 2
            assert all((r.wide is None) == narrow for r in found)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


# -- 13 ------------------------------------------------------------------------------------


def plain_clusters(rows, k=8, rounds=10):
    kept = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    mark = lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    kept.sort(key=mark)
    table = np.array([v for _, v in kept], dtype=np.int64).reshape(len(kept), 64)
    centroids = table[:k].copy()
    nearest = lambda: ((table[:, None] - centroids[None]) ** 2).sum(axis=2)
    for _ in range(rounds):
        own = nearest().argmin(axis=1)
        for c in range(len(centroids)):
            if (own == c).any():
                centroids[c] = [int(s) // int((own == c).sum()) for s in table[own == c].sum(axis=0)]
    own, far = nearest().argmin(axis=1), nearest().min(axis=1)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    return sorted((-1 if i is None else i, int(c), int(d), int(far[own == c].sum()), int(far.sum()), digest[c]) for (i, _), c, d in zip(kept, own, far, strict=True))


def clusters(spark, rows, parts=3):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("cluster", F.lit(5)).repartition(parts)
    return sorted((-1 if r.vec_id is None else r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in kdmeans.report_clusters(table).collect())


@pytest.mark.parametrize("kind", ["blobs", "spread", "copies"])
def test_clusters_equal_plain_rounds(spark, monkeypatch, kind):
    monkeypatch.setattr(kdmeans, "TREE_ROWS", 100)
    rng = np.random.default_rng(9)
    if kind == "blobs":
        data = rng.normal(0, 4, (12, 64))[rng.integers(0, 12, 400)] + rng.normal(0, 0.2, (400, 64))
    elif kind == "spread":
        data = rng.normal(0, 1, (300, 64))
    else:
        data = np.round(rng.normal(0, 1, (9, 64)))[rng.choice(9, 350, p=[0.6, *[0.05] * 8])]
    rows = [(int(i), [float(x) for x in np.float32(v)]) for i, v in enumerate(data)]
    assert clusters(spark, rows) == plain_clusters(rows)


def test_vectors_that_are_left_out(spark):
    good = [[float(i % 7 - j % 3) for j in range(64)] for i in range(20)]
    rows = [(i, v) for i, v in enumerate(good)] + [(30, None), (31, []), (32, good[0][:63]), (33, [None, *good[0][1:]]), (34, [float("nan"), *good[0][1:]]), (35, [float("inf"), *good[0][1:]])]
    rows += [(3, good[3]), (3, good[4]), (None, good[5]), (None, good[6])]
    assert clusters(spark, rows) == plain_clusters(rows)
    beyond = [(i, v) for i, v in enumerate(good)] + [(40, [65536.0, *good[0][1:]])]
    assert clusters(spark, beyond) == plain_clusters(beyond[:-1])
    assert clusters(spark, rows[:3]) == plain_clusters(rows[:3])  # fewer than k
    assert clusters(spark, []) == [] and clusters(spark, [(1, None)]) == []


def test_trees_keep_counts_sums_and_boxes_and_prune():
    rng = np.random.default_rng(2)
    data = (rng.normal(0, 2000, (6, 64))[rng.integers(0, 6, 500)] + rng.normal(0, 30, (500, 64))).astype(np.int64)
    tree = kdmeans.grow(data)
    tree["vectors"] = data[tree["order"]]
    for at, (a, b) in enumerate(zip(tree["first"], tree["last"], strict=True)):
        own = tree["vectors"][a:b]
        assert (tree["sums"][at] == own.sum(axis=0)).all() and (tree["low"][at] == own.min(axis=0)).all() and (tree["high"][at] == own.max(axis=0)).all()
    centroids = data[[0, 50, 100, 150, 200, 250, 300, 350]]
    own, whole = kdmeans.descend(tree, centroids)
    gap = ((tree["vectors"][:, None] - centroids[None]) ** 2).sum(axis=2)
    assert (own == gap.argmin(axis=1)).all()
    assert sum(tree["last"][n] - tree["first"][n] for n, _ in whole) > 100  # whole nodes were given away
    counts, sums = kdmeans.totals(tree, centroids)
    assert counts.tolist() == np.bincount(own, minlength=8).tolist()
    assert all((sums[c] == tree["vectors"][own == c].sum(axis=0)).all() for c in range(8))


def test_a_tie_is_never_pruned():
    """Two equal centroids, and one just as far from a box corner: the smaller number wins."""
    data = np.array([[0, 0], [2, 0], [0, 2], [2, 2]] * 10, np.int64)
    tree = kdmeans.grow(data)
    tree["vectors"] = data[tree["order"]]
    centroids = np.array([[3, 1], [-1, 1], [3, 1]], np.int64)
    own, _ = kdmeans.descend(tree, centroids)
    assert (own == ((tree["vectors"][:, None] - centroids[None]) ** 2).sum(axis=2).argmin(axis=1)).all()


def test_clustering_query_columns(spark):
    assert op13_clustering(spark, "/root/testdata/sf0.001").columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


@pytest.fixture(scope="module")
def con():
    return duck("/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql_twins(spark, con, name):
    same(QUERIES[name](spark, "/root/testdata/sf0.001"), con, ORACLE_SQL[name])
