"""Operators 1, 2, 3, 5, 7: against brute force, and their defined edge cases."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from adjudica.llm import pii, quality, tokens, toxicity, urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, sources=None):
    rows = [(i, t, "en", (sources or ["s"] * len(texts))[i], len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def brute_base(text):
    """The contract's patterns, word for word."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        odd = sum(d[-1::-2]) + sum(sum(divmod(2 * x, 10)) for x in d[-2::-2])
        if 14 <= len(d) <= 19 and odd % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


CARD = "4539 1488 0343 6467"
PII_TEXTS = [
    f"write to a.b+c@mail.example.com or +1 (555) 010-2222, host 10.0.0.255 card {CARD}.",
    "1.2.3.4.5.6.7.8 and 300.1.1.1 and 001.02.3.4 and @x.y and a@b and a@b.c@d.e",
    "é ü +49 30 1234567 ünï@dom.de x@y.z..w", "", None, "a" * 50_000 + "@" + "b" * 10, "9" * 30_000, "1-" * 500,
    'token = "deadbeef00112233445566" later deadbeef00112233445566 again', "@" * 2000, "a@" * 2000, "+" * 100 + "1" * 50,
]


def test_pii_base_matches_plain_patterns(spark):
    rng = np.random.default_rng(3)
    noise = ["".join(rng.choice(list("a1.@+- ()9"), 60)) for _ in range(200)]
    docs = documents(spark, PII_TEXTS + noise)
    got = {r.doc_id: r for r in pii.find_personal_data(docs).collect()}
    assert len(got) == len(PII_TEXTS + noise)
    for i, t in enumerate(PII_TEXTS + noise):
        want = brute_base(t or "")
        assert [got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone] == [sum(k == j for _, k, _ in want) for j in range(4)], t
        joined = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert got[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), t
        own = set(got[i].spans.split(",")) - {""}
        assert {x for x in joined.split(",") if x} <= own


def test_pii_repeats_share_a_label():
    """The bare repeat of a string that one context shows to be a credential is labelled too."""
    texts = [f'x password="ab12cd34ef{i}" y and plain words 12 of them ab12cd34ef{i} end' for i in range(30)] + ["room 12 of 40, year 1999"] * 30
    weights = pii.train(texts)
    spans = [s for _, s in pii.label(["key = 77aa88bb99cc far away " + "w " * 50 + "then 77aa88bb99cc", "in 1999 room 12"], weights)]
    assert [k for _, k, _ in spans[0]] == [4, 4]
    assert spans[1] == []


def test_pii_long_runs_and_similar_strings():
    """Cost is linear in unspaced text; a failing card number stays unmarked; strings of one stem share an edge."""
    import time

    start = time.perf_counter()
    assert list(pii.nodes("语" * 200_000, [])) == [] and len(list(pii.nodes("x1" * 100_000, []))) == 1
    assert time.perf_counter() - start < 2
    weights = pii.train(["card 4111111111111111 or 4111111111111113 and room 12"] * 20)
    (base, spans), (_, odd) = pii.label(["card 4111111111111111 ok", "number 4111111111111112 ok"], weights)
    assert base == spans == [(5, 2, 21)] and odd == []
    field = pii.pooled(list(pii.nodes("sk_live_1a then " + "w " * 40 + "sk_live_2b", [])))
    assert pii.edges(field, 0) == ([], [(0, 1)])


def test_pii_message_passing_agrees_with_enumeration():
    rng = np.random.default_rng(0)
    unary, w = rng.normal(size=(4, 3)), np.eye(3) * 1.5
    pairs = [(0, 1), (1, 2), (2, 3)]  # a tree, where passing is exact
    best, total = None, np.zeros((4, 3))
    for code in np.ndindex(3, 3, 3, 3):
        p = np.exp(sum(unary[i, c] for i, c in enumerate(code)) + sum(w[code[a], code[b]] for a, b in pairs))
        for i, c in enumerate(code):
            total[i, c] += p
    best = total.argmax(1)
    assert (pii.infer(unary, [(pairs, w)], rounds=40) == best).all()


@pytest.mark.parametrize("n", [50, 1000])
def test_pii_all_repeats_share_a_label(n):
    """At production defaults, a credential's last bare repeat is labelled as its first."""
    texts = [f'x password="ab12cd34ef{i}" y and plain words 12 of them ab12cd34ef{i} end' for i in range(30)] + ["room 12 of 40, year 1999"] * 30
    texts += [f"see 99ff88ee77{i} here, 99ff88ee77{i} there" for i in range(60)]
    weights = pii.train(texts)
    bare = ("w " * 50 + "then 77aa88bb99cc ") * n
    (_, spans), (_, plain) = pii.label(["key = 77aa88bb99cc far away " + bare, bare], weights)
    assert [k for _, k, _ in spans] == [4] * (n + 1)
    assert plain == []


def test_pii_messages_pass_along_a_whole_chain():
    unary = np.zeros((60, 3))
    unary[0, 2] = 4.0
    pairs = [(i, i + 1) for i in range(59)]
    assert (pii.infer(unary, [(pairs, np.eye(3) * 4.0)]) == 2).all()


def test_pii_empty_table_and_extra_columns(spark):
    assert pii.find_personal_data(documents(spark, [])).count() == 0
    odd = documents(spark, ["a@b.c"] * 2).withColumn("spans", F.lit(1)).withColumn("base_sha256", F.lit(2)).withColumn("lang", F.lit(None))
    odd = odd.withColumn("doc_id", F.lit(None).cast("long"))
    assert [(r.n_email, r.n_spans, r.n_secret) for r in pii.find_personal_data(odd).collect()] == [(1, 1, 0)] * 2


def url_brute(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    rules = [("net", "/"), ("example.net", "/en/"), ("example.com", "/de/"), ("org", "/fr/")]
    fits = [h + p for h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits, key=len, default=None)


def test_url_rules(spark):
    texts = [
        None, "", "no scheme", "http://NET/", "http://net", "http://a.example.net/en/x", "http://a.example.net/en", "https://xexample.net/en/",
        "http://b.example.com/de/1?x=/fr/", "http://c.org/fr/#a", "http://c.org?/fr/", "x://y://net/", "http://example.net:80/en/", "http://a.net/" + "p" * 50_000,
        "http://shop.example.com/cart?id=1", "http://shop.example.com/a?phpsessid=1", "http://other.example.com/x\ny/z",
    ]
    pages = spark.createDataFrame([(i, u, 1, "v") for i, u in enumerate(texts + texts)], "page_id long, url string, host int, verdict string")
    rows = urls.judge_urls(pages).collect()
    assert len(rows) == 2 * len(texts)
    for r in rows:
        url = (texts + texts)[r.page_id]
        host, path, rule = url_brute(url)
        assert (r.host, r.path, r.rule) == (host, path, rule), url
        want = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}.get(rule)
        assert r.verdict == (want or ("block" if url and ("/cart" in url or "phpsessid" in url) else "allow"))
    assert urls.judge_urls(pages.limit(0)).count() == 0


def test_url_rules_without_tokens_and_in_capitals(spark):
    rules = [urls.host_rule("block", "Example.ORG", "/"), urls.pattern_rule("digits", "block", r"^[^/]*/[0-9]+$")]
    pages = spark.createDataFrame([(1, "http://a.example.org/x"), (2, "http://b.com/123"), (3, "http://b.com/x"), (4, None)], "page_id long, url string")
    pages = pages.withColumn("verdict", F.lit("old"))
    assert {r.page_id: r.verdict for r in urls.judge_urls(pages, rules).collect()} == {1: "block", 2: "block", 3: "allow", 4: "allow"}


def greedy(word, first, rest):
    n, at, pieces = 0, 0, first
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return -1
        n, at, pieces = n + 1, end, rest
    return n


def test_token_counts_equal_greedy_pieces():
    rng = np.random.default_rng(5)
    for _ in range(60):
        pieces = {bytes(rng.choice(list(b"ab"), rng.integers(1, 6)).tolist()) for _ in range(12)}
        rest = {p for p in pieces if rng.random() < 0.7}
        m = tokens.Matcher(pieces, rest)
        for _ in range(200):
            word = bytes(rng.choice(list(b"abc" if rng.random() < 0.1 else b"ab"), rng.integers(1, 14)).tolist())
            assert m.count(word) == greedy(word, pieces, rest)


def test_token_counts_over_texts(spark):
    path = "/opt/tokenizers/byte_bpe_50k.json"
    first, rest = tokens.read_vocabulary(path)
    texts = ["Hello, wörld! 12345 unbelievable", "", None, "x" * 100_000, "a_b\tc\n"]
    for r in tokens.count_tokens(documents(spark, texts).withColumn("n_tokens", F.lit(0)), path).collect():
        words = tokens.WORD_RULE.findall(texts[r.doc_id] or "")
        if r.doc_id == 3:
            assert r.n_words == 1 and r.n_tokens > 0
            continue
        n = [greedy(w.encode(), first, rest) for w in words]
        assert (r.n_words, r.n_tokens, r.n_unknown) == (len(words), sum(max(x, 1) for x in n), n.count(-1))
    assert tokens.count_tokens(documents(spark, []), path).count() == 0


def quality_brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams, hit = {}, set()
    for i in range(len(words) - 7):
        grams.setdefault(tuple(words[i : i + 8]), []).append(i)
    for at in grams.values():
        if len(at) > 1:
            hit |= {p for i in at for p in range(i, i + 8)}
    failed = len(words) < 20 or 100 * len(hit) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), failed


QUALITY_TEXTS = [
    None, "", " \n\t", "one two three", "w " * 40, " ".join(f"w{i}" for i in range(60)), " ".join(f"w{i % 11}" for i in range(60)),
    "a b c\nd e f\na b c\n\n \n \n" + " ".join(map(str, range(30))), "#$ é\u3000ü\x0b\x0c<>" * 9, " ".join(f"w{i}" for i in range(100)) + " w1 w2 w3 w4 w5 w6 w7 w8 w9",
    " ".join(f"q{i % 5000}" for i in range(12_000)),
]


def test_quality_counts(spark):
    docs = documents(spark, QUALITY_TEXTS, [None, "a", "a", "a", "a", "b", "b", "b", "b", None, "c"]).withColumn("host", F.lit(9)).withColumn("kept", F.lit(1))
    rows = {r.doc_id: r for r in quality.judge_quality(docs).collect()}
    assert len(rows) == len(QUALITY_TEXTS)
    for i, t in enumerate(QUALITY_TEXTS):
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == quality_brute(t), i
        assert not (r.kept and r.base_failed)
    assert quality.judge_quality(documents(spark, [])).count() == 0


def test_bad_host_takes_its_documents_along(spark):
    good = " ".join(f"word{i}" for i in range(40))
    docs = documents(spark, [good] * 20 + ["x"] * 19 + [good], ["a"] * 20 + ["b"] * 20)
    rows = {r.doc_id: r.kept for r in quality.judge_quality(docs).collect()}
    assert all(rows[i] for i in range(20)) and not any(rows[i] for i in range(20, 40))


def test_toxicity_learns_folds_and_spares(spark):
    plain = [f"you are a reader number {i} in many things and days" for i in range(60)]
    nasty = [f"you are a {'loser' if i % 2 else 'trash'} number {i} in many things" for i in range(60)]
    rows = [(i, t, int(i >= 60)) for i, t in enumerate(plain + nasty)]
    lexicon = toxicity.learn(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))
    assert {"loser", "trash"} <= set(lexicon.weights)
    probes = ["what a LOSER", "what a l0ser", "what a 1oser!", "what a \u0455cum l\u043eser", "take the trash can out", "a fine day", "", None, "trash " * 20_000]
    scored = toxicity.score_toxicity(documents(spark, probes), lexicon)
    assert scored.columns == [*documents(spark, []).columns, "toxicity_score"]
    s = [r.toxicity_score for r in sorted(scored.collect(), key=lambda r: r.doc_id)]
    assert min(s[:4]) > 0.5 > max(s[4:8]) and s[8] > 0.9 and all(0 <= x <= 1 for x in s)
    empty = toxicity.learn(spark.createDataFrame([], "doc_id long, text string, toxic int"))
    assert toxicity.score_toxicity(documents(spark, ["loser"]), empty).first().toxicity_score < 0.5
    assert toxicity.score_toxicity(documents(spark, []), empty).count() == 0


def test_toxicity_held_out(spark):
    """Held-out labels of the given table: nearly all right."""
    from adjudica.llm.queries import op7_toxicity

    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = op7_toxicity(spark, sf).join(labels, "doc_id").where("held_out").select("predicted", "toxic").collect()
    assert np.mean([r.predicted == r.toxic for r in rows]) > 0.95
    hit = sum(r.predicted == r.toxic == 1 for r in rows)
    assert hit >= 0.6 * sum(r.toxic == 1 for r in rows) > 0 and hit >= 0.8 * sum(r.predicted == 1 for r in rows)


def test_toxicity_of_odd_labels(spark):
    """Rows without a label teach nothing, repeated ones count each, and a null id is never held out."""
    plain = [(i, f"a plain sentence number {i} about many things", 0) for i in range(60)]
    nasty = [(100 + i, f"you are a zorgful {i} in many things", 1) for i in range(60)]
    docs = documents(spark, [t for _, t, _ in plain + nasty] + ["zorgful"])
    labels = spark.createDataFrame([(i, y) for i, (_, _, y) in enumerate(plain + nasty)] * 2 + [(None, 1), (120, None)], "doc_id long, toxic int")
    rows = toxicity.training_rows(docs, labels)
    assert rows.where("toxic is null or doc_id is null").isEmpty()
    assert "zorgful" in toxicity.learn(rows).weights


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 10, 13])
def test_window_steps_cover_any_length(n):
    from adjudica.llm.windows import steps

    made = {1}
    for size, left, offset in steps(n):
        assert left in made and size - left in made and offset == left
        made.add(size)
    assert n in made


def test_toxicity_training_rows_have_one_plan(spark):
    """A broadcast of few labels would become a shuffle of texts as labels grow."""
    docs = documents(spark, ["a fool", "a friend", None])
    rows = toxicity.training_rows(docs, spark.range(3).selectExpr("id as doc_id", "cast(id % 2 as int) as toxic"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
