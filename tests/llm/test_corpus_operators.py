"""Operators 4, 6, 8, 9, 10 and the pipeline: against brute force, and their defined edge cases."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from adjudica.llm import decontaminate, linededup, linkage, mixing, neardup, suffixdedup
from adjudica.llm.common import Scratch
from adjudica.llm.queries import op6_mixing

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
RNG = np.random.default_rng(11)
VOCABULARY = [f"w{i}" for i in range(400)]


@pytest.fixture(autouse=True)
def own_draws():
    """Every test draws alike, whichever ran before it."""
    global RNG
    RNG = np.random.default_rng(11)


def documents(spark, texts, ids=None, sources=None):
    rows = [((ids or range(len(texts)))[i], t, "en", (sources or ["s"] * len(texts))[i], len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def prose(n):
    return " ".join(RNG.choice(VOCABULARY, n))


def edited(text, n):
    words = text.split(" ")
    for i in RNG.choice(len(words), n, replace=False):
        words[i] = f"x{RNG.integers(10**6)}"
    return " ".join(words)


def roots(ids, links):
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {i: find(i) for i in ids}


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def test_components_of_random_graphs(spark):
    for n, m in ((50, 40),):
        links = [tuple(map(int, RNG.integers(0, n, 2))) for _ in range(m)] + [(i, i + 1) for i in range(100, 130)]
        edges = spark.createDataFrame(links, "a long, b long")
        got = {r.id: r.component for r in linkage.components(edges, Scratch(spark, "t")).collect()}
        want = roots({x for e in links for x in e}, links)
        assert all(got.get(i, i) == want[i] for i in want)


def test_near_duplicates_equal_brute_force(spark):
    base = [prose(80) for _ in range(8)]
    texts = list(base)
    for b in base[:5]:
        texts += [edited(b, k) for k in (1, 2, 3, 4)] + [b, b.upper()]
    chain = prose(120)
    for _ in range(6):  # each near the one before, far from the first
        texts.append(chain)
        chain = edited(chain, 3)
    hub = prose(60)
    texts += [edited(hub, 1) for _ in range(25)] + [None, "", " \n", "a b", "A  B", "a b c d", "a b c d e", "w1 " * 5000]
    docs = documents(spark, texts).withColumn("kept", F.lit(7)).withColumn("component_id", F.lit(7))
    sets = [shingle_set(t) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    want = roots(range(len(texts)), links)
    rows = neardup.near_duplicates(docs.select("doc_id", "text")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)
    kept = sorted(r.doc_id for r in neardup.drop_near_duplicates(docs).collect())
    assert kept == sorted(i for i in want if want[i] == i)


def test_near_duplicates_of_one_base_around_the_threshold(spark):
    """Cut and edited copies on both sides of 0.75, so that stars leave much open: groups as by all pairs."""
    rng = np.random.default_rng(2)
    base = list(rng.choice(VOCABULARY, 140))
    texts = []
    for _ in range(70):
        a, n = rng.integers(0, 40), rng.integers(75, 141)
        words = base[a : a + n]
        for i in rng.integers(0, len(words), rng.integers(0, 4)):
            words[i] = f"x{rng.integers(3)}"
        texts.append(" ".join(words))
    sets = [shingle_set(t) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    want = roots(range(len(texts)), links)
    assert len(set(want.values())) > 2
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(documents(spark, texts)).collect()}
    assert got == want


def test_near_duplicates_repeated_rows_nulls_and_empty(spark):
    text = prose(40)
    docs = documents(spark, [text, text, text, None, None], [3, 3, None, 5, None])
    rows = neardup.near_duplicates(docs).collect()
    assert sorted((r.component_id or -1) for r in rows) == [-1, 3, 3, 3, 5]
    assert [r.doc_id for r in neardup.drop_near_duplicates(docs).where("text is not null").collect()] == [3]
    assert neardup.near_duplicates(documents(spark, [])).count() == 0


def test_min_max_halves_evaluations():
    """Minima and maxima each estimate the similarity: 64 evaluations give 128 values."""
    a = np.unique(RNG.integers(0, 2**63, 900).astype(np.uint64))
    b = np.concatenate([a[: len(a) * 6 // 7], np.unique(RNG.integers(0, 2**63, len(a) // 7).astype(np.uint64))])
    assert len(neardup.bands(a)) == 2 * neardup.PERMUTATIONS // neardup.ROWS
    share = np.mean(neardup.bands(a) == neardup.bands(np.unique(b)))
    assert 0.05 < share < 0.8 and (neardup.bands(a) == neardup.bands(a)).all()


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def line_form(line):
    return " ".join(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", line.lower()))


def lines_brute(rows):
    """Texts without repeated lines, by all pairs and full edit distances; rows: (doc_id, text), null ids last."""
    by_form = defaultdict(list)
    for n, (doc, text) in enumerate(rows):
        for p, line in enumerate(text.split("\n") if text is not None else ()):
            if line_form(line):
                by_form[line_form(line)].append((float("inf") if doc is None else doc, n, p))
    forms = sorted(by_form)
    close = lambda a, b: abs(len(a) - len(b)) <= int(max(len(a), len(b)) * 0.15) and edit(a, b) <= int(max(len(a), len(b)) * 0.15)
    links = [(i, j) for i, a in enumerate(forms) for j, b in enumerate(forms[:i]) if close(a, b)]
    group = roots(range(len(forms)), links)
    places = defaultdict(list)
    for i, f in enumerate(forms):
        places[group[i]] += by_form[f]
    gone = {k[1:] for ks in places.values() for k in sorted(ks)[1:]}
    return [t if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if (n, p) not in gone) for n, (_, t) in enumerate(rows)], len(links)


def test_line_dedup_equals_all_pairs(spark):
    first = [prose(30) for _ in range(12)]
    texts = ["\n".join(first[i : i + 3]) for i in range(0, 12, 3)]
    texts += [edited(first[0], 1) + "\nfresh line of its own number one\n" + first[4].upper() + "!", first[7] + "\n" + first[7] + "\nyes", None, "", "ab\nab\nab", "\n\n"]
    texts += [edited(first[i], 1) for i in range(12)] + [f"Page {i} of the very same report" for i in range(5)]
    want, links = lines_brute(list(enumerate(texts)))
    assert links > 12, "the case must hold fuzzy links"
    for r in linededup.dedup_lines(documents(spark, texts)).collect():
        assert r.text == want[r.doc_id], r.doc_id
        old = texts[r.doc_id]
        assert r.n_removed == (0 if old is None or old == r.text else len(old.split("\n")) - (len(r.text.split("\n")) if r.text else 0))


def test_line_dedup_edges(spark):
    line, other = prose(20), prose(20)
    long = " ".join(f"v{i}" for i in range(9_000)), " ".join(f"v{i if i % 50 else 0}" for i in range(9_000))
    rows = [(1, line), (None, line), (None, None), (4, other), (4, other), (5, long[0]), (6, long[1]), (7, "")]
    docs = documents(spark, [t for _, t in rows], [i for i, _ in rows])
    docs = docs.withColumn("n_lines", F.lit("clash")).withColumn("places", F.lit(0)).withColumn("group", F.lit(0))
    got = Counter((r.doc_id, r.text, r.n_removed) for r in linededup.dedup_lines(docs).collect())
    assert got == Counter({(1, line, 0): 1, (None, "", 1): 1, (None, None, 0): 1, (4, other, 0): 2, (5, long[0], 0): 1, (6, "", 1): 1, (7, "", 0): 1})
    assert linededup.dedup_lines(documents(spark, [])).count() == 0


def test_line_dedup_recall_of_similar_lines(spark):
    """One changed letter or word: found wherever the edit similarity alone says so, no SimHash asked."""
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnoprstuvw"), rng.integers(3, 9)))
    pairs = []
    for n in (5, 10, 20, 50):
        while sum(m == n for m, *_ in pairs) < 150:
            words = [word() for _ in range(n)]
            other = list(words)
            i = rng.integers(n)
            other[i] = word() if len(pairs) % 2 else other[i][:-1] + "z"
            a, b = " ".join(words), " ".join(other)
            if edit(a, b) <= 0.15 * max(len(a), len(b)):
                pairs.append((n, a, b))
    docs = documents(spark, [x for p in pairs for x in p[1:]])
    removed = {r.doc_id for r in linededup.dedup_lines(docs).where("n_removed = 1").collect()}
    assert not {i for i in removed if i % 2 == 0}
    for n in (5, 10, 20, 50):
        assert sum(2 * i + 1 in removed for i, p in enumerate(pairs) if p[0] == n) >= 0.9 * 150


def test_line_dedup_of_short_and_unspaced_lines(spark):
    chinese = "这是一个没有空格的很长的段落它在两个文档中完全相同"
    address = "https://example.org/" + "QUJDREVG" * 9
    docs = documents(spark, [f"Share on Facebook\n{chinese}\n--\nA", f"share on facebook!\n{address}\n--", f"{chinese}\n{address}\na\nB\n "])
    rows = {r.doc_id: r.text for r in linededup.dedup_lines(docs).collect()}
    assert rows == {0: f"Share on Facebook\n{chinese}\n--\nA", 1: f"{address}\n--", 2: "B\n "}


@pytest.mark.parametrize("seed", range(4))
def test_lines_that_share_a_passage_are_not_candidates(spark, seed):
    """Keys ask all quarters: a passage of half a line makes no block of its own.

    Words of the other half are all different: with words of a small vocabulary a
    few lines pick the same ones there by chance, and meet for that reason.
    """
    rng = np.random.default_rng(seed)
    other = lambda: " ".join(np.base_repr(x, 36).lower() for x in rng.integers(36**5, 36**6, 40))
    passage = other()
    docs = documents(spark, [f"{other()} {passage}" if i % 2 else f"{passage} {other()}" for i in range(40)])
    keys = linededup.with_keys(linededup.forms_of(docs)).select("line", F.explode(F.array(*linededup.KEYS)).alias("block"))
    assert keys.groupBy("block").count().where("count > 1").count() == 0
    assert linededup.dedup_lines(docs).agg(F.sum("n_removed")).first()[0] == 0


def test_simhash_counts_bits(spark):
    features = spark.createDataFrame([("alpha beta gamma",), ("one",)], "form string")
    rows = features.select("form", F.split("form", " ").alias("words")).select("form", linededup.word_features("words").alias("h")).collect()
    got = {r.form: r.sim for r in linededup.with_simhash(features.withColumn("line", F.xxhash64("form"))).join(features.withColumn("id", F.xxhash64("form")), "id").collect()}
    for r in rows:
        bits = [sum(h >> i & 1 for h in r.h) * 2 > len(r.h) for i in range(64)]
        want = sum(1 << i for i, b in enumerate(bits) if b)
        assert got[r.form] & (2**64 - 1) == want


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def test_decontamination_equals_brute_force(spark):
    items = [(1, prose(25)), (2, "Only four Words here"), (10, prose(10)), (3, None), (4, "!!!"), (None, prose(12)), (5, "zwölf ärger")]
    items += [(6, items[0][1])]
    benchmark = spark.createDataFrame(items, "item_id long, text string").withColumn("words", F.lit(1))
    inside = items[0][1].split(" ")
    texts = [
        prose(50), prose(5) + " " + items[0][1].upper() + "! " + prose(9), " ".join(inside[:9]), " ".join(inside[3:14]), "say ONLY, four words-here", None, "",
        items[2][1] + " " + items[2][1], prose(3) + " zwölf  ärger " + prose(3), prose(20_000) + " " + items[5][1], "!!!",
    ]
    docs = documents(spark, texts).withColumn("items", F.lit(0)).withColumn("n_words", F.lit(0))
    grams = defaultdict(set)
    for k, t in items:
        w = terms(t)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            grams[tuple(w[i : i + n])].add("null" if k is None else str(k))
    rows = {r.doc_id: r for r in decontaminate.report_contamination(docs, benchmark).collect()}
    clean = []
    for d, t in enumerate(texts):
        w, hit, found = terms(t), set(), set()
        for n in {len(g) for g in grams}:
            for i in range(len(w) - n + 1):
                if g := grams.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= g
        assert (rows[d].n_words, rows[d].n_hit, rows[d].n_items, rows[d]["items"]) == (len(w), len(hit), len(found), sorted(found)), d
        clean += [d] * (not hit)
    kept = decontaminate.remove_contaminated(docs, benchmark)
    assert sorted(r.doc_id for r in kept.collect()) == clean and kept.columns == docs.columns
    masked = {r.doc_id: r.text for r in decontaminate.mask_spans(docs, benchmark).collect()}
    assert masked[0] == texts[0] and masked[7] == "" and len(terms(masked[1])) == 14
    assert decontaminate.report_contamination(documents(spark, []), benchmark).count() == 0
    assert decontaminate.report_contamination(docs, benchmark.limit(0)).where("contaminated").count() == 0
    again = documents(spark, [texts[1], texts[1], texts[1]], [1, 1, None])
    assert {r.n_hit for r in decontaminate.report_contamination(again, benchmark).collect()} == {25}


def test_mixing_meets_targets(spark):
    sizes = RNG.integers(1, 60, 900)
    sources = [["a", "b", "c", None][i % 4 if i < 400 else 0] for i in range(900)]
    docs = documents(spark, ["w " * int(n) for n in sizes], sources=sources).withColumn("size", F.lit("clash")).withColumn("weight", F.lit(1))
    rows = mixing.mix_sources(docs.drop("size")).collect()
    total, own, taken = int(sizes.sum()), Counter(), Counter()
    for r in rows:
        own[r.source] += r.size
        taken[r.source] += r.size * r.copies
        assert r.copies <= 3
    weight = {"a": 1, "b": 2, "c": 3, None: 1}
    want, open_, left = {}, set(weight), float(total)
    while True:  # share, cap, share again
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] > 3 * own[s]]
        if not over:
            break
        for s in over:
            want[s] = 3.0 * own[s]
            left -= want[s]
            open_.remove(s)
    want |= {s: level * weight[s] for s in open_}
    for r in rows:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == own[r.source]
    for s in want:
        assert abs(taken[s] - want[s]) <= max(0.03 * want[s], 80)
    again = {(r.doc_id, r.copies) for r in mixing.mix_sources(docs.drop("size").repartition(7)).collect()}
    assert again == {(r.doc_id, r.copies) for r in rows}
    drawn = Counter(r.doc_id for r in mixing.take(docs).collect())
    assert drawn == Counter({r.doc_id: r.copies for r in rows if r.copies})


def test_mixing_edges(spark):
    assert mixing.mix_sources(documents(spark, [])).count() == 0
    rows = mixing.mix_sources(documents(spark, [None, "", "a b c"], [1, None, 1], ["s", None, "t"])).collect()
    assert sum(r.copies * r.size for r in rows) in (0, 3, 6) and len(rows) == 3
    none = mixing.mix_sources(documents(spark, [None, ""], sources=[None, "z"])).collect()
    assert all(r.target == 0 and r.copies == 0 for r in none)
    same = mixing.take(documents(spark, ["a b"] * 6, [1] * 6, ["s"] * 3 + ["t"] * 3)).count()
    assert 5 <= same <= 7


def test_mixing_query_takes_whole_documents(spark):
    rows = op6_mixing(spark, "/root/testdata/sf0.001").collect()
    assert all(r.taken % max(r.size, 1) == 0 and r.taken <= 3 * r.size for r in rows)


def repeats_brute(data):
    seen = Counter(b[i : i + 400] for b in data for i in range(len(b) - 399))
    out = []
    for b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 399):
            if seen[b[i : i + 400]] > 1:
                gone[i : i + 400] = True
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_dedup_equals_brute_force(spark):
    letters = list("abcdefgh éß")
    noise = lambda n: "".join(RNG.choice(letters, n))
    p, q = noise(380), noise(700)
    texts = [noise(900), noise(200) + q + noise(300), q[:450] + noise(500), noise(30) + q[200:660] + noise(90), q, q, noise(100) + p + noise(100), p + noise(10), None, "", "short"]
    texts += ["a" * 1500, "xy" * 900, "a" * 399 + "b", noise(500) + q[:399], noise(350) + q[-350:] + q[:390], ("lorem ipsum dolor " * 60) + noise(50)]
    base = noise(2500)
    for _ in range(12):  # near copies, each changed at a few places
        b = list(base)
        for i in RNG.choice(len(b), 3, replace=False):
            b[i] = "#"
        texts.append("".join(b))
    want = repeats_brute([(t or "").encode() for t in texts])
    rows = {r.doc_id: r for r in suffixdedup.report_repeats(documents(spark, texts).withColumn("places", F.lit(0))).collect()}
    for i, w in enumerate(want):
        assert (rows[i].n_bytes, rows[i].n_removed, rows[i].n_spans, rows[i].kept_sha256) == w, i


def test_suffix_dedup_keeps_the_last_row_of_a_long_rank(spark, monkeypatch):
    """A rank that overflows what is held and ends with its Arrow batch keeps all its places."""
    monkeypatch.setattr(suffixdedup, "HELD", 3)
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, partitions = spark.conf.get(batch), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set(batch, 5)
    spark.conf.set("spark.sql.shuffle.partitions", 2)
    try:
        rows = [(0, 1, p) for p in range(5)] + [(r, 1, 10 * r) for r in range(1, 4)] + [(9, 1, p) for p in range(200, 230)]
        kept = suffixdedup.drop_unique(spark.createDataFrame(rows, "rank long, text_hash long, place long"), Scratch(spark, "t")).collect()
    finally:
        spark.conf.set(batch, before)
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
    assert {r.place for r in kept if r["rank"] == 0} == set(range(5))


def test_suffix_dedup_blocks_and_edges(spark, monkeypatch):
    assert suffixdedup.report_repeats(documents(spark, [])).count() == 0
    data = RNG.integers(0, 256, 5000, dtype=np.uint8)
    whole = suffixdedup.chosen(data)
    monkeypatch.setattr(suffixdedup, "BLOCK", 700)
    assert (suffixdedup.chosen(data) == whole).all()
    gaps = np.diff(whole)
    assert gaps.max() <= suffixdedup.STRETCH
    text = prose(200)
    rows = suffixdedup.report_repeats(documents(spark, [text, text, text[:300]], [1, 1, None])).collect()
    assert sorted(r.n_removed for r in rows) == [0, len(text), len(text)]


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_duplicates", "decontamination", "mixing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / str(i)))
        kept = spark.read.parquet(str(tmp_path / str(i)))
        assert kept.columns == columns and kept.count() > 0, name
        if name == "near_duplicates":
            sets = {r.doc_id: shingle_set(r.text) for r in kept.collect()}
            ids = sorted(sets)
            assert not any(sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) for x, a in enumerate(ids) for b in ids[:x] if sets[b])
        if name == "decontamination":
            grams = set()
            for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
                w = terms(r.text)
                grams |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))}
            for r in kept.collect():
                w = terms(r.text)
                assert not any(tuple(w[i : i + 10]) in grams for i in range(len(w) - 9))
        docs = kept


def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    """Nulls, empty texts, ties, repeated rows and columns with the operators' own names, by brute force where rows are few."""
    import corpus_pipeline

    sf = str(tmp_path)
    line, other = prose(30), prose(30)
    bad = "zorgful snarkbane " + prose(10)
    texts = [(1, line + "\n" + other), (2, line), (2, line), (3, None), (4, ""), (5, edited(other, 1) + "\n" + prose(25)), (None, prose(22)), (6, "benchmark words " * 8), (7, bad)]
    texts += [(100 + i, f"zorgful snarkbane {prose(12)}" if i % 2 else prose(12)) for i in range(60)]
    docs = documents(spark, [t for _, t in texts], [i for i, _ in texts], ["a" if n % 2 else None for n in range(len(texts))])
    for c in ("toxicity_score", "n_lines", "n_removed", "group", "line", "places", "component_id", "kept", "text_hash", "size", "target", "copies", "score", "item"):
        docs = docs.withColumn(c, F.lit(f"own {c}"))
    spark.createDataFrame([(100 + i, 1, i % 2) for i in range(60)] + [(1, None, None), (2, 1, 0), (2, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([("x", "benchmark words " * 5), ("y", None), (None, "")], "item_id string, text string").write.parquet(f"{sf}/benchmark.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        out.write.parquet(f"{sf}/{name}")
        before, docs = docs, spark.read.parquet(f"{sf}/{name}")
        assert docs.columns == before.columns
        assert docs.where("toxicity_score <> 'own toxicity_score' or n_lines <> 'own n_lines' or kept <> 'own kept' or copies <> 'own copies'").isEmpty()
        old, kept[name] = [(r.doc_id, r.text) for r in before.collect()], Counter((r.doc_id, r.text) for r in docs.collect())
        if name == "toxicity":
            toxic = lambda t: "zorgful" in (t or "")
            assert kept[name] == Counter(x for x in old if not toxic(x[1]))
        if name == "line_dedup":
            want, _ = lines_brute(list(dict.fromkeys(old)))
            cut = dict(zip(dict.fromkeys(old), want, strict=True))
            assert kept[name] == Counter((d, cut[d, t]) for d, t in old if cut[d, t] == t or (cut[d, t] or "").strip())
        if name == "near_duplicates":
            assert kept[name][3, None] == kept[name][4, ""] == 1 and max(kept[name].values()) == 1
        if name == "decontamination":
            assert Counter(old) - kept[name] == Counter({(6, "benchmark words " * 8): 1})
    left = spark.read.parquet(f"{sf}/decontamination")
    words = sum(len((r.text or "").split()) for r in left.collect())
    taken = sum(len(t.split()) * n for (_, t), n in kept["mixing"].items())
    assert abs(taken - words) < 60 and (3, None) not in kept["mixing"]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), sf).isEmpty()


def test_scratch_holds_live_tables_only(spark):
    """A stage's tables go when the next one starts, unless its input reads them."""
    from adjudica.llm.common import sweep

    a, b = Scratch(spark, "t"), Scratch(spark, "t")
    docs, stale = a.save(spark.range(3).toDF("id")), b.save(spark.range(3).toDF("id"))
    sweep(docs)
    assert docs.count() == 3 and a in Scratch.opened and b not in Scratch.opened
    with pytest.raises(Exception, match="(?i)not.?exist|no such|not found"):
        spark.read.parquet(stale._scratch_path).count()


def test_line_candidates_of_long_lines(spark):
    """Unrelated long lines that share common words are no candidates; edited ones are, up to the edits allowed."""
    common = [f"{a}{b}" for a in ("the", "and", "of", "in") for b in ("", "re", "th")]
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "ou", "ti"]
    word = lambda: RNG.choice(common) if RNG.random() < 0.3 else "".join(RNG.choice(syllables, 3))
    lines = [" ".join(word() for _ in range(170)) for _ in range(40)]

    def scattered(line):
        letters = list(line)
        for i in RNG.choice(len(letters), int(len(letters) * 0.14), replace=False):
            letters[i] = RNG.choice(list("abcdefgh")) if letters[i] != " " else " "
        return "".join(letters)

    rows = [(i, x) for i, x in enumerate(lines)] + [(100 + i, scattered(x)) for i, x in enumerate(lines)]
    told = linededup.with_simhash(spark.createDataFrame(rows, "line long, form string"))
    x, y = told.select(*[F.col(c).alias(f"a_{c}") for c in told.columns]), told.select(*[F.col(c).alias(f"b_{c}") for c in told.columns])
    met = x.join(y, (F.col("a_id") < F.col("b_id")) & linededup.near(lambda c: F.col(f"a_{c}"), lambda c: F.col(f"b_{c}")))
    found = {(r.a_id, r.b_id) for r in met.select("a_id", "b_id").collect()}
    assert {(i, 100 + i) for i in range(40)} <= found
    assert sum(b % 100 != a % 100 for a, b in found) < 30


def test_line_candidates_of_lines_that_repeat_a_passage(spark):
    """Few different features don't make unrelated lines candidates: each counts once in every part of its line."""
    rng = np.random.default_rng(11)
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "ou", "ti"]
    word = lambda: rng.choice(["the", "and", "of", "in"]) if rng.random() < 0.3 else "".join(rng.choice(syllables, 3))
    lines = [" ".join([" ".join(word() for _ in range(14))] * 12) for _ in range(40)]

    def scattered(line):
        letters = list(line)
        for i in rng.choice(len(letters), int(len(letters) * 0.14), replace=False):
            letters[i] = rng.choice(list("abcdefgh")) if letters[i] != " " else " "
        return "".join(letters)

    rows = [(i, x) for i, x in enumerate(lines)] + [(100 + i, scattered(x)) for i, x in enumerate(lines)]
    told = linededup.with_simhash(spark.createDataFrame(rows, "line long, form string"))
    x, y = told.select(*[F.col(c).alias(f"a_{c}") for c in told.columns]), told.select(*[F.col(c).alias(f"b_{c}") for c in told.columns])
    met = x.join(y, (F.col("a_id") < F.col("b_id")) & linededup.near(lambda c: F.col(f"a_{c}"), lambda c: F.col(f"b_{c}")))
    found = {(r.a_id, r.b_id) for r in met.select("a_id", "b_id").collect()}
    assert {(i, 100 + i) for i in range(40)} <= found
    assert sum(b % 100 != a % 100 for a, b in found) < 30


def test_generated_code_of_line_candidates_is_compiled(spark, capsys):
    """The JVM interprets methods of over 8,000 bytes for good."""
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # an adaptive plan shows its code only once it has run
    try:
        linededup.with_simhash(spark.createDataFrame([(1, "a b c")], "line long, form string")).explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) < 8_000


def test_lines_of_separators_outside_ascii_have_words(spark):
    """U+0085 and U+2028 are no ASCII signs: a repeated line of one goes, lines of signs alone stay."""
    docs = documents(spark, ["\u2028\n--\n\u0085", "\u2028\n--\n \n\u0085"])
    assert {r.doc_id: r.text for r in linededup.dedup_lines(docs).collect()} == {0: "\u2028\n--\n\u0085", 1: "--\n "}


def test_texts_are_cut_in_bounded_parts(spark):
    """A part ends near PART bytes, however many texts a batch holds; every row is in one part."""
    sizes = [400, 0, 3_000_000, 7, *[900_000] * 9, 0]
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    found = suffixdedup.parts(offsets)
    assert [i for a, b in found for i in range(a, b)] == list(range(len(sizes)))
    assert all(offsets[b] - offsets[a] <= suffixdedup.PART + max(sizes[a:b]) for a, b in found) and len(found) > 5
    assert suffixdedup.parts(np.zeros(1, np.int64)) == []
    passage = prose(200)
    got = suffixdedup.report_repeats(documents(spark, [f"{prose(30)} {passage} {i}" for i in range(5)])).collect()
    assert all(r.n_removed >= len(passage) and r.n_spans == 1 for r in got)


def test_line_keys_are_made_once_for_each_form(spark):
    """A repeated line has its keys made once, whatever its place; lines near the bound of a kind have two rows."""
    line = " ".join(f"word{i}" for i in range(12))
    docs = documents(spark, [f"{line}\n{line.upper()}\nAlpha, beta - gamma: delta epsilon {i // 20}" for i in range(40)])
    forms = linededup.forms_of(docs)
    assert forms.count() == 120
    got = linededup.with_keys(forms)
    assert got.count() == 3 and got.select("line").distinct().count() == 3
    assert got.where(F.col(linededup.KEYS[0]).isNull()).count() == 0


def test_symbols_bound_edits(spark):
    """UNIT times the distance of symbols is never below that of characters, so that it may link at once."""
    rng = np.random.default_rng(8)
    vocabulary = ["a", "of", "the", "tions", "interest", "ñandú", "straßenbahnhaltestelle", "x" * 40]
    rows = []
    for i in range(120):
        a = [str(rng.choice(vocabulary)) for _ in range(30)]
        b = list(a)
        for _ in range(rng.integers(1, 9)):
            at = int(rng.integers(len(b)))
            b[at : at + int(rng.integers(0, 2))] = [str(rng.choice(vocabulary)) for _ in range(rng.integers(0, 3))]
        rows += [(2 * i, " ".join(a)), (2 * i + 1, " ".join(b))]
    told = linededup.with_symbols(spark.createDataFrame(rows, "line long, form string"))
    x, y = (told.select((F.col("line") - side).alias("k"), F.col("form").alias(f"form_{side}"), F.col("symbols").alias(f"s_{side}")) for side in (0, 1))
    bound = F.levenshtein("s_0", "s_1") * linededup.UNIT - F.levenshtein("form_0", "form_1")
    got = [r[0] for r in x.join(y, "k").where("k % 2 = 0").select(bound).collect()]
    assert len(got) == 120 and min(got) >= 0


@pytest.mark.parametrize("size", [40, 90, 300, 900])
def test_edited_lines_without_spaces_are_linked(spark, size):
    """An edit at the start of a line of one word is one edit, not all of its SimHash."""
    rng = np.random.default_rng(size)
    rows = []
    for i in range(20):
        letters = rng.choice(list("abcdefghijklmnopqrstuvwxyz"), size)
        other = "".join(letters[:3]) + ("q" if letters[3] != "q" else "x") + "".join(letters[4:])
        rows += [(2 * i, "".join(letters)), (2 * i + 1, other)]
    told = linededup.with_simhash(spark.createDataFrame(rows, "line long, form string"))
    x, y = told.select(*[F.col(c).alias(f"a_{c}") for c in told.columns]), told.select(*[F.col(c).alias(f"b_{c}") for c in told.columns])
    met = x.join(y, (F.col("b_id") == F.col("a_id") + 1) & (F.col("a_id") % 2 == 0) & linededup.near(lambda c: F.col(f"a_{c}"), lambda c: F.col(f"b_{c}")))
    assert met.count() == 20
