"""Each operator against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import base64
import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sieveline.llm import bagminhash, byte_bpe, components, html_extract, langid, line_dedup, mixing, quality, queries, secret_ledger, topk, url_filter, words

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, line string, host string, id long, bands string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def odd_docs(spark, rows=None):
    """Nulls, empty and long texts, repeated rows, and columns whose names operators might use."""
    long_ = " ".join(f"w{i % 977}x" for i in range(30000))
    data = [(1, "a b c d e f", "en"), (1, "a b c d e f", "en"), (2, None, None), (3, "", "en"), (None, "null id text of some words", "de"), (4, long_, "en"), (5, " \n\n \t", None), (6, "é ß 日本 😀\nsecond", "fr")] if rows is None else rows
    return spark.createDataFrame([(d, t, lang, None if d == 2 else "s", len(t or ""), "x", "y", 9, "z") for d, t, lang in data], DOCS)


def empty(spark):
    return odd_docs(spark, [])


# words


def test_words_of_any_text():
    random.seed(1)
    texts = ["".join(random.choice(["a", "é", " ", "\n", "\x1c", "\xa0", "日", "b c", "\t"]) for _ in range(random.randint(0, 40))) for _ in range(300)] + [None, ""]
    for most in (1, 64, 1 << 16):
        got = []
        for _, buf, offs in words.each_slice(pa.array(texts, pa.string()), most):
            s, e, r = words.words(buf, offs)
            got += [[bytes(buf[a:b]).decode() for a, b, x in zip(s, e, r) if x == i] for i in range(len(offs) - 1)]
        assert got == [WORDS.findall(t or "") for t in texts]


# 1


def test_line_dedup(spark):
    rows = [(i, f"Menu bar\nown line {i}\n\n Menu bar \nMenu", "en") for i in range(10)] + [(10, None, "en"), (11, "", "en")]
    got = {r["doc_id"]: r for r in line_dedup.line_dedup(odd_docs(spark, rows), ratio=0.5).collect()}
    assert got[3]["text"] == "own line 3\n" and got[3]["__n_dropped"] == 3 and got[3]["line"] == "x"
    assert got[10]["text"] is None and got[11]["text"] == ""
    assert line_dedup.line_dedup(empty(spark)).count() == 0
    assert line_dedup.line_dedup(odd_docs(spark)).count() == 8


def test_line_dedup_counts_copies_once(spark):
    rows = [(i, "Copied one\nCopied two", "en") for i in range(5)] + [(5 + i, f"Menu bar\nown line {i}", "en") for i in range(4)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(odd_docs(spark, rows)).collect()}
    assert [got[i] for i in range(5)] == ["Copied one\nCopied two"] * 5 and got[6] == "own line 1"


def test_line_dedup_drops_rare_boilerplate(spark):
    rows = [(i, "\n".join([f"own line {i}"] + ["Rare ad."] * (i < 14) + ["License."] * (i in (17, 18, 19))), "en") for i in range(10, 210)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(odd_docs(spark, rows)).collect()}
    assert got[12] == "own line 12" and got[18] == "own line 18\nLicense."


def test_line_dedup_of_many_hosts_meets_lines_by_part(spark, monkeypatch):
    rows = [(i % 30, f"Menu bar\nown line {i}", "en") for i in range(60)] + [(0, None, "en"), (0, "Menu bar\nown line 0", "en")]
    df = odd_docs(spark, rows)
    want = sorted(map(str, line_dedup.line_dedup(df).collect()))
    monkeypatch.setattr(line_dedup, "SMALL_MB", -1)
    monkeypatch.setattr(line_dedup, "PAGES", 9)
    assert sorted(map(str, line_dedup.line_dedup(df).collect())) == want and sum("Menu" in r for r in want) == 2  # the two of the null host


def test_line_dedup_of_clashing_names_and_long_texts(spark):
    long_ = "\n".join(f"line {i}" for i in range(50000))
    df = spark.createDataFrame([(i, f"Menu\n{i}", "s", "a", "b", 7) for i in range(5)] + [(9, long_, "s", "a", "b", 7)], "doc_id long, text string, source string, __host string, gone string, __n_dropped int")
    got = {r["doc_id"]: r for r in line_dedup.line_dedup(df).collect()}
    assert got[3]["text"] == "3" and (got[3]["__host"], got[3]["gone"], got[3]["__n_dropped"]) == ("a", "b", 1) and got[9]["text"] == long_


def test_line_dedup_has_no_python(spark):
    assert "Python" not in queries.op1_line_dedup(spark, SF)._jdf.queryExecution().toString()


# 2


def vectors(spark, n=150, dims=24, seed=3):
    rng = np.random.default_rng(seed)
    data = [(i, [float(x) for x in rng.normal(0, 1, dims)], 0) for i in range(n)]
    data += [(1000 + i, [0.5] * dims, 0) for i in range(30)] + [(2000, None, 0), (2020, [1.0, None], 0), (2040, [float("nan")] * dims, 0), (2060, [float("inf")], 0), (2080, [1.0], 0), (2100, [], 0), (20, data[20][1], 0), (None, [1.0], 0), (None, [9.0] * dims, 0)]
    return spark.createDataFrame(data, "vec_id long, embedding array<float>, score int")


def test_topk_against_brute_force(spark):
    df = vectors(spark)
    rows = [(r[0], [math.floor(64 * x) for x in r[1]]) for r in df.collect() if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    want = Counter()
    for i, (q, x) in enumerate(rows):
        if q is not None and q % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(x, y)), 1 << 63 if c is None else c) for j, (c, y) in enumerate(rows) if i != j)[:20]
            want.update((q, k + 1, None if c == 1 << 63 else c, -s) for k, (s, c) in enumerate(best))
    is_query = F.col("vec_id") % 20 == 0
    for block, query_block in ((32, 4), (7, 1000), (1000, 1000)):
        got = topk.top_k(df, is_query, 20, block=block, query_block=query_block)
        assert Counter(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()) == want
    assert topk.top_k(df.where("false"), is_query, 20).count() == 0 and topk.top_k(df, F.lit(False), 20).count() == 0


def test_topk_of_huge_components():
    q, c = np.array([[2.0**60, 1.0]]), np.array([[2.0**60, 0.0], [1.0, 1.0]])
    assert topk.search(q, c, np.array([0]), np.array([1, 2]), np.array([1, 2]), 5)[2].tolist() == [2**63 - 1, 2**60 + 1]


# 3


def test_url_rules(spark):
    urls = ["http://a.net/", "HTTP://X.Example.NET/en/a?b", "https://example.com/de/x", "https://b.org/fr/1#x", "http://net", "ftp://a.net:80/", None, "no scheme", "http://example.net/de/", "http://b.example.com/en/", ""]
    want = ["net/", "example.net/en/", "example.com/de/", "org/fr/", None, None, None, None, "net/", None, None]
    got = {r["page_id"]: r for r in url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert [got[i]["rule"] for i in range(len(urls))] == want
    assert got[1]["host"] == "x.example.net" and got[1]["path"] == "/en/a" and got[1]["verdict"] == "allow"
    assert (got[6]["host"], got[6]["path"], got[6]["verdict"]) == ("", "", "allow") and got[7]["host"] == ""
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_url_trees_on_held_out_urls(spark):
    random.seed(5)
    good = [(f"https://www.{random.choice(['news', 'book', 'wiki'])}{i % 9}.example.org/a/{random.choice('abc')}", 0.0) for i in range(120)]
    bad = [(f"http://win{random.randint(1000, 9999)}-{i}.example.org/x?a={i}&b={random.random()}", 1.0) for i in range(120)]
    train = spark.createDataFrame(good[:80] + bad[:80], "url string, label double")
    rest = spark.createDataFrame([(i, u, y) for i, (u, y) in enumerate(good[80:] + bad[80:])], "page_id long, url string, y double")
    got = url_filter.judge(rest, rules=(), labelled=train).join(rest.select("page_id", "y"), "page_id").collect()
    assert sum((r["verdict"] == "block") == (r["y"] > 0) for r in got) >= 0.9 * len(got)


def test_url_rules_come_before_seeds(spark):
    row = spark.createDataFrame([("m.casino-win.example.org", "allow"), ("a.poker.io", None), ("b.io", None), ("c.io", "block")], "h string, v string")
    assert [r[0] for r in row.select(url_filter.label(F.col("h"), F.col("v"))).collect()] == [0.0, 1.0, None, 1.0]


def test_url_features_by_brute_force(spark):
    urls = ["http://www.a-b.x1.example.com/p/q.html?a=1&b=%20#f", "https://é😀.org/??", "x://h", "http://h/" + "Ab9" * 4000, ""]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    host, path = url_filter.host_path(F.col("url"))
    for r in url_filter._lexical(df.withColumns({"host": host, "path": path})).collect():
        u, n = r["url"], Counter(r["url"])
        assert r["f_entropy"] == pytest.approx(-sum(c / len(u) * math.log2(c / len(u)) for c in n.values()), abs=1e-9) and r["f_length"] == len(u)
        assert r["f_digits"] == pytest.approx(sum(c in "0123456789" for c in u) / max(1, len(u))) and r["f_params"] == u.count("=")


def test_url_rates_leave_the_own_fold_out(spark):
    random.seed(7)
    rows = [(f"http://s{i % 3}.example.org/p{i}", float(random.random() < 0.4)) for i in range(60)]
    df = spark.createDataFrame(rows + rows[:9], "url string, label double")  # repeated urls count once
    host, path = url_filter.host_path(F.col("url"))
    model = url_filter.Model(df.withColumns({"host": host, "path": path}))
    lexical = url_filter._lexical(df.distinct().withColumns({"host": host, "path": path, "fold": F.pmod(F.xxhash64(F.lit(5), "url"), F.lit(url_filter.FOLDS))}))
    own = [r.asDict() for r in model.rated(lexical, True).collect()]
    assert len(own) == 60
    for r in own:
        rest = [x["label"] for x in own if x["site"] == r["site"] and x["fold"] != r["fold"]]
        assert r["f_site_rate"] == pytest.approx((sum(rest) + 1) / (len(rest) + 2))


def test_urls_of_one_zone_get_both_verdicts(spark):
    random.seed(9)
    good = lambda i: f"https://www.{random.choice(['news', 'book', 'wiki'])}{i % 9}.example.com/{random.choice(['about', 'story'])}/{random.choice('abc')}"
    bad = lambda i: f"http://win{random.randint(1000, 9999)}-{i}.example.com/x?a={i}&b={random.random()}&c={random.random()}"
    train = spark.createDataFrame([(good(i), 0.0) for i in range(150)] + [(bad(i), 1.0) for i in range(150)], "url string, label double")
    pages = spark.createDataFrame([(i, good(i) if i % 2 else bad(i)) for i in range(200)], "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(pages, rules=(), labelled=train).collect()}
    assert sum(got[i] == ("allow" if i % 2 else "block") for i in got) >= 190


def test_url_filters_have_no_python(spark):
    plan = queries.op3_url_filters(spark, SF)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_urls_of_odd_tables(spark):
    same = "http://spam.example.io/a"
    data = [(i, same, "x", "y") for i in range(300)] + [(300, "http://good.example.org/fr/x", "x", "y"), (301, "http://h/" + "a/" * 50000, "x", "y"), (None, None, "x", "y")]
    df = spark.createDataFrame(data, "page_id long, url string, host string, label string")
    got = url_filter.judge(df).collect()
    assert len(got) == len(data) and {r["verdict"] for r in got if r["page_id"] and r["page_id"] < 300} in ({"allow"}, {"block"})
    assert {r["verdict"] for r in url_filter.judge(df.where("page_id = 300 or page_id = 301")).collect()} == {"allow"}  # labels of one kind: no trees


# 4


def test_bpe_equals_tiktoken(spark):
    tiktoken = pytest.importorskip("tiktoken")
    path, pattern = byte_bpe.default_files()
    own = byte_bpe.codec(path, pattern)
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    other = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    random.seed(2)
    parts = ["a", "b", " ", "  ", "\n", "\t", "é", "ß", "日本", "😀", "1", "23", "'s", "'ll", "th", "ing", "!!", "...", "\x1c", "\x85", "²", "the,", "Word.", "\r\n"]
    texts = ["".join(random.choice(parts) for _ in range(random.randint(0, 40))) for _ in range(4000)] + ["a" * 20000, "thing" * 4000, " " * 5000, "ab cd\n" * 3000]
    texts += [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    for t in texts:
        ids = own.ids(t)
        assert ids == ",".join(map(str, other.encode_ordinary(t)))
        assert own.decode(ids) == t.encode()


def test_bpe_tables(spark):
    files = byte_bpe.default_files()
    got = {r["doc_id"]: r for r in byte_bpe.digests(odd_docs(spark), *files).collect()}
    nothing = hashlib.sha256(b"").hexdigest()
    assert (got[2]["n_tokens"], got[2]["ids_sha256"], got[2]["decoded_sha256"]) == (0, nothing, nothing) == (got[3]["n_tokens"], got[3]["ids_sha256"], got[3]["decoded_sha256"])
    assert got[6]["decoded_sha256"] == hashlib.sha256("é ß 日本 😀\nsecond".encode()).hexdigest()
    encoded = byte_bpe.encode(odd_docs(spark), *files)
    assert {bytes(r["data"]).decode() for r in byte_bpe.decode(encoded, *files).collect()} == {r["text"] or "" for r in odd_docs(spark).collect()}
    assert byte_bpe.digests(empty(spark), *files).count() == 0


# 5


def brute_stats(t):
    w, lines, seen, dup = WORDS.findall(t or ""), (t or "").split("\n"), set(), 0
    n = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {j for i in range(len(w) - 7) if n[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    for x in lines:
        if WORDS.search(x):
            dup += x in seen
            seen.add(x)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(hit)


def test_quality_counts(spark):
    random.seed(4)
    texts = [None, "", "a " * 50, "x\nx\n x\nx"] + [" ".join(random.choice("abc#|") for _ in range(random.randint(1, 60))) + "\n" * random.randint(0, 3) for _ in range(200)]
    texts += [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    s = quality.statistics(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        assert tuple(int(s[k][i]) for k in quality.COUNTS) == brute_stats(t)


def test_quality_verdicts(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    train, test = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    got = quality.verdicts(docs, quality.fit(docs, train)).where("not base_failed").join(test, "doc_id").collect()
    good, bad = [r for r in got if r["quality"] == 1], [r for r in got if r["quality"] == 0]
    assert sum(r["kept"] for r in good) >= 0.98 * len(good) and sum(not r["kept"] for r in bad) >= 0.9 * len(bad)


def test_quality_without_labels(spark):
    model = quality.fit(odd_docs(spark), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    got = quality.verdicts(odd_docs(spark), model).collect()
    assert len(got) == 8 and all(r["kept"] != r["base_failed"] for r in got)
    assert quality.keep(empty(spark), model).count() == 0
    assert quality.keep(odd_docs(spark), model).columns == odd_docs(spark).columns


# 6


def brute_targets(sizes, weights=(5, 2, 1)):
    names = sorted((k for k in sizes if k is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    out, left, open_ = {}, sum(sizes.values()), set(names)
    while open_:
        unit = left / sum(w[s] for s in open_)
        full = {s for s in open_ if unit * w[s] > 3 * sizes[s]}
        if not full:
            return out | {s: unit * w[s] for s in open_}
        out |= {s: 3.0 * sizes[s] for s in full}
        left -= sum(3 * sizes[s] for s in full)
        open_ -= full
    return out


def test_mixing(spark):
    random.seed(6)
    data = [(i, " ".join(["w"] * random.randint(0, 200)), random.choice("abbbbbbcdé")) for i in range(3000)] + [(5000, None, None), (5001, "x y z", None), (5002, "", "zz")]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    sizes = Counter()
    for _, t, s in data:
        sizes[s] += len((t or "").split())
    want, taken = brute_targets(sizes), Counter()
    assert len(got) == len(data)
    for r in got:
        assert r["__copies"] in (0, 1, 2, 3) and r["__words"] == sizes[r["source"]] and r["__target"] == pytest.approx(want[r["source"]], rel=1e-9, abs=1e-6)
        taken[r["source"]] += r["__copies"] * r["__size"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 200 if sizes[s] > 1000 else abs(taken[s] - want[s]) <= 9
    again = mixing.mix(df.repartition(3)).collect()
    assert {(r["doc_id"], r["__copies"]) for r in again} == {(r["doc_id"], r["__copies"]) for r in got}
    assert mixing.mix(empty(spark)).count() == 0 and mixing.mix(odd_docs(spark)).count() == 8


def test_mixing_rates_by_brute_force(spark):
    random.seed(16)
    data = [(i, " ".join(["w"] * random.randint(0, 60)), random.choice("aabbbc"), 1, 2) for i in range(900)]
    got = mixing.mix(spark.createDataFrame(data, "doc_id long, text string, source string, row int, __of int")).collect()
    for s in "abc":
        own = [r for r in got if r["source"] == s]
        low, high = -5.0, 5.0
        for _ in range(200):
            lam = (low + high) / 2
            low, high = (lam, high) if sum(min(3.0, math.exp(lam * r["__size"])) * r["__size"] for r in own) < own[0]["__target"] else (low, lam)
        assert all(r["__rate"] == pytest.approx(min(3.0, math.exp(lam * r["__size"])), rel=1e-4) and abs(r["__copies"] - r["__rate"]) <= 1 for r in own)
        assert sum(r["__copies"] for r in own) == pytest.approx(sum(r["__rate"] for r in own), abs=1)
    assert {(r["row"], r["__of"]) for r in got} == {(1, 2)}


# 7


PAGES = [
    ("<html><body><nav>Menu</nav><div class='ad'>Buy</div><article><h1>T &amp; x</h1><p>One<br>two</p><p>three  four</article><footer>F</footer>", "T & x One two three four"),
    ("<div id=content><p>Long text of the page here.</p><ul><li>a<li>b</ul></div><div class='sidebar'><p>Side</p></div>", "Long text of the page here. a b"),
    ("<article><p>Body</p><section class='comments'><p>Reader says</p></section><form><p>f</p></form></article>", "Body"),
    ("<script>var t='</p>';</script><style>p{}</style><p>x&nbsp;&lt;b&gt;</p><!-- c --><noscript>n</noscript>", "x <b>"),
    (None, ""),
    ("", ""),
    ("<p>" + "long " * 20000, ("long " * 20000).strip()),
    ("<div><p>a<b>b</b>c</p", "abc"),
]


def test_html(spark):
    df = spark.createDataFrame([(i, f"http://h{i}.example.org/", h, "x") for i, (h, _) in enumerate(PAGES)], "page_id long, url string, html string, path string")
    got = {r["page_id"]: r for r in html_extract.extract(df).collect()}
    assert [got[i]["text"] for i in range(len(PAGES))] == [t for _, t in PAGES]
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert html_extract.extract(df.where("false")).count() == 0


def test_html_consensus(spark):
    page = "<div class='box a1'><p>{}</p></div><div class='text t{}'><p>{}</p></div>"
    rows = [(i, "http://h/", page.format("tip " * 3, i, "main text " * 20)) for i in range(9)] + [(9, "http://h/", page.format("a very long tip " * 9, 9, "short main"))]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[9] == "short main" and got[0] == ("main text " * 20).strip()


def test_html_names_of_boxes(spark):
    body = "words of the story " * 10
    rows = [
        (0, "http://a/", f"<article><p>{body}</p><section class='notice-board-history'>Old boards.</section><div class='social-policy'>Policy.</div></article>", f"{body}Old boards. Policy."),
        (1, "http://b/", f"<body><div class='post-related-research'>{body}</div><div class='x'>short</div></body>", body.strip()),
        (2, "http://c/", f"<body><div class=main><p>{body}</p><div class='related-posts'>Other</div></div><aside>Side</aside><div class='cookie-notice'>We use</div></body>", body.strip()),
        (3, "http://d/", "<div class='ad'>All there is</div>", "All there is"),
        (4, "http://e/", "<p>one <span class='share'>x</span> two</p>", "one two"),
    ]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, kept string")).collect()}
    assert got == {i: t for i, _, _, t in rows}


def test_html_hosts_show_what_is_no_box(spark):
    random.seed(4)
    own = lambda: " ".join(random.choice("abcdefgh") * 4 for _ in range(40))
    texts = [(own(), own()) for _ in range(8)]
    rows = [(i, "http://h/", f"<body><div class=story>{a}<div class='comments'>{b}</div></div></body>") for i, (a, b) in enumerate(texts)]
    rows += [(10 + i, "http://g/", f"<body><div class=story>{a}<div class='notice'>Same notice on all pages, as long as the text of them or so</div></div></body>") for i, (a, _) in enumerate(texts)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"{a} {b}" for i, (a, b) in enumerate(texts)) and all(got[10 + i] == a for i, (a, _) in enumerate(texts))


def test_html_votes_by_brute_force(spark):
    random.seed(11)
    rows = []
    for i in range(120):
        blocks = [f"<div class='{random.choice(['a', 'b', 'c'])}{random.randint(1, 9)}'>{'text ' * random.randint(1, 60)}</div>" for _ in range(3)]
        rows.append((i, f"http://h{i % 5}/x", "".join(blocks)))
    rows += rows[:7]
    want = {}
    for _, u, h in rows:
        path, share = html_extract.read(h).best()
        want.setdefault(u[7:9], Counter())[path] += share
    got = html_extract.winners(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == 5
    for r in got:
        top = max(want[r["host"]].values())
        assert want[r["host"]][r["path"]] == pytest.approx(top)


def test_html_of_many_hosts_meets_winners_by_part(spark, monkeypatch):
    rows = [(i, f"http://h{i % 3}/", f"<div class='box'>tip</div><div class='text'>{'main text ' * 20}{i}</div>") for i in range(40)] + [(1, "http://h1/", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = sorted(map(str, html_extract.extract(df).collect()))
    monkeypatch.setattr(html_extract, "SMALL_MB", -1)
    monkeypatch.setattr(html_extract, "PAGES", 4)
    assert sorted(map(str, html_extract.extract(df).collect())) == want and len(want) == 41


def test_html_deep_pages_take_linear_time():
    page = html_extract.read("<div>" * 60000 + "x" * 40000 + "<div class=ad>y" * 20000)
    assert page.text(None) == "x" * 40000


# 8


def shingles(t):
    w = (t or "").split()
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else Counter([tuple(w)] if w else [])


def similarity(a, b):
    a, b = shingles(a), shingles(b)
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def test_signatures_are_unbiased():
    rng, off = np.random.default_rng(5), []
    for it in range(150):
        v = rng.integers(0, 1 << 62, rng.integers(3, 80), dtype=np.uint64)
        a, b = rng.integers(0, 6, len(v)) * (9 if it % 4 == 0 else 1), rng.integers(0, 6, len(v))
        if a.sum() and b.sum():
            g, r, c = np.concatenate([v[a > 0], v[b > 0]]), np.repeat([0, 1], [(a > 0).sum(), (b > 0).sum()]), np.concatenate([a[a > 0], b[b > 0]])
            s = bagminhash.signatures(g, r, c, 2, 256)
            off.append((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(off)) < 0.01 and np.std(off) < 0.045


def test_near_dedup_against_brute_force(spark):
    random.seed(8)
    base = [[f"w{random.randint(0, 400)}" for _ in range(random.randint(20, 200))] for _ in range(12)]
    data, n = [], 0
    for b in base:
        for k in range(40 if b is base[0] else 6):
            w = list(b)
            for _ in range(random.choice([0, 0, 1, 2, 4])):
                w[random.randrange(len(w))] = f"v{random.randint(0, 10**6)}"
            n += 1
            data.append((n, " ".join(w), "en"))
    data += [(900, "a b c", "en"), (901, "a  b c", "en"), (902, "", "en"), (903, None, "en"), (904, "a b d", "en"), (905, "x " * 50, "en"), (906, "x " * 45, "en"), (907, "x " * 20, "en"), (1, data[0][1], "en"), (None, "a b c", "en")]
    got = {r["id"]: r["class_id"] for r in bagminhash.classes(odd_docs(spark, data)).collect()}
    top = {d: d for d, _, _ in data if d}

    def root(x):
        return x if top[x] == x else root(top[x])

    for i, (a, s, _) in enumerate(data):
        for b, t, _ in data[:i]:
            if a and b and ((s or "") == (t or "") or similarity(s, t) >= 0.8):
                x, y = root(a), root(b)
                top[max(x, y)] = min(x, y)
    assert {d: got[d] for d in top} == {d: root(d) for d in top} and got[None] is None
    kept = bagminhash.near_dedup(odd_docs(spark, data)).collect()
    assert sorted(r["doc_id"] for r in kept if r["doc_id"]) == sorted({root(d) for d in top})
    assert bagminhash.classes(empty(spark)).count() == 0


def test_prefixes_lose_no_link(spark):
    random.seed(12)
    common = [f"c{i}" for i in range(40)]
    data = []
    for i in range(240):  # a passage that all share, and own words that some share; repeated windows and sizes of all kinds
        own = [f"o{i % 60}x{j}" for j in range(random.choice([6, 14, 30, 60]))]
        w = common[: random.choice([20, 40])] + own + (own if i % 7 == 0 else [])
        for _ in range(random.choice([0, 1, 2, 3])):
            w[random.randrange(len(w))] = f"v{i}"
        data.append((i, " ".join(w), i % 5 if i < 40 else i))
    rows = spark.createDataFrame(data, "id long, text string, root long")
    got = {(r["a"], r["b"]) for r in bagminhash._prefix_pairs(rows.select("id", "root"), rows.select("id", "text"), 0.8).collect()}
    want = {(a, b) for b, t, y in data for a, s, x in data[:b] if x != y and similarity(s, t) >= 0.8}
    assert want and want <= got and len(got) < len(data) ** 2 / 8


def test_components(spark):
    random.seed(9)
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 200), (200, 150), (7, 7)]
    got = {r["id"]: r["root"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {150: 100, 200: 100}


# 9


def test_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = langid.predict(docs, langid.fit(docs)).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in got) >= 0.97 * len(got) and all(0 <= r["score"] <= 1 for r in got)


def test_languages_of_odd_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs)
    data = [(1, None, "en"), (2, "", "en"), (3, "123 ... “”", "en"), (4, "é", "en"), (5, "x" * 50000, "en"), (None, "the of and", "en"), (1, None, "en")]
    got = [(r["doc_id"], r["lang_pred"]) for r in langid.predict(odd_docs(spark, data), model).collect()]
    assert all((p == "und") == (d in (1, 2, 3)) for d, p in got) and len(got) == 7
    assert langid.predict(empty(spark), model).count() == 0
    none = langid.fit(empty(spark))
    assert {r["lang_pred"] for r in langid.predict(odd_docs(spark), none).collect()} == {"und"}


def test_languages_of_all_scripts(spark):
    words_ = {"ber": "ⴰⴱⴳ ⴷⴻⴼ ⴳⵀⵃ", "chu": "ⰀⰁⰂ ⰃⰄⰅ ⰆⰇⰈ", "hin": "हिन्दी भाषा में", "zho": "中文 語言", "ara": "اللغة العربية"}
    data = [(i, f"{t} {t}", lang) for i in range(60) for lang, t in words_.items()]
    model = langid.fit(odd_docs(spark, data))
    got = langid.predict(odd_docs(spark, [(k, t, None) for k, t in enumerate(words_.values())]), model).collect()
    assert {r["doc_id"]: r["lang_pred"] for r in got} == dict(enumerate(words_)) and all(r["score"] == 1 for r in got)
    mixed = langid.predict(odd_docs(spark, [(1, "中文 語言 中文 語言, ⴰⴱⴳ ⴷⴻⴼ ⴳⵀⵃ ⴰⴱⴳ!", None), (2, "「。」⁂ ̀", None)]), model).collect()
    assert {r["doc_id"]: r["spans"] for r in mixed} == {1: "zho:0:11,ber:13:28", 2: ""} and [r["lang_pred"] for r in mixed if r["doc_id"] == 2] == ["und"]


def test_viterbi_of_many_languages():
    rng = np.random.default_rng(2)
    for k in (127, 128, 200, 300):
        score = -rng.exponential(4, (60, k))
        label = langid.viterbi(score, np.zeros(60, np.int64), 6.0)
        best = score[0]
        for s in score[1:]:
            best = np.maximum(best, best.max() - 6) + s
        assert score[np.arange(60), label].sum() - 6 * (label[1:] != label[:-1]).sum() == pytest.approx(best.max(), abs=1e-4) and label.min() >= 0


def test_language_ties_go_to_the_first(spark):
    data = [(i, "same words here", lang) for i in range(80) for lang in ("b", "a")]
    got = langid.predict(odd_docs(spark, data[:4]), langid.fit(odd_docs(spark, data))).collect()
    assert {r["lang_pred"] for r in got} == {"a"}


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(1)
    for _ in range(200):
        size = rng.integers(1, 30, 5)
        row, score = np.repeat(np.arange(5), size), -rng.exponential(4, (size.sum(), 4)).astype(np.float32)
        label, only = langid.viterbi(score, row, 6.0), langid.constant(score, row, 5, 6.0)
        for r in range(5):
            x = score[row == r].astype(float)
            best = x[0]
            for s in x[1:]:
                best = np.maximum(best, best.max() - 6) + s
            path = label[row == r]
            assert sum(x[i][p] for i, p in enumerate(path)) - 6 * (path[1:] != path[:-1]).sum() == pytest.approx(best.max(), abs=1e-4)
            assert only[r] < 0 or set(path) == {only[r]}


# 10


def brute_spans(t):
    any_case = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    rules = ((rf"""({any_case})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8), ("AKIA[A-Z0-9]+", 0, 16), ("[0-9a-f]+", 0, 32))
    return sorted(((k, m.start(), m.end()) for k, (p, g, n) in enumerate(rules) for m in re.finditer(p, t or "") if len(m[g]) >= n), key=lambda s: (s[1], s[0]))


def test_secrets_against_plain_rules(spark):
    random.seed(3)
    parts = ["token=", "Secret: ", "API_KEY", "apikey='", "password", "passwd =", "abcdef12", "AKIA", "ABCD1234EFGH5678", "0123456789abcdef" * 2, "é", "\n", " ", "ſecret=", "=", "short", "x" * 9]
    texts = ["".join(random.choice(parts) for _ in range(random.randint(0, 12))) for _ in range(3000)] + [None, "", "z" * 100000 + "token=12345678"]
    for t in texts:
        assert [s for s in secret_ledger.find(t or "") if s[0] < secret_ledger.BASE] == brute_spans(t)
    df = odd_docs(spark, [(i, t, "en") for i, t in enumerate(texts)] + [(0, texts[0], "en"), (None, None, "en")])
    paths, entries = secret_ledger.scan(df)
    got = secret_ledger.findings(paths, entries).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        if r["doc_id"] is not None:
            own = brute_spans(texts[r["doc_id"]])
            said = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for k, s, e in own)
            assert r["base_sha256"] == hashlib.sha256(said.encode()).hexdigest() and (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == j for k, _, _ in own) for j in range(3))


def test_ledger_scans_only_new_blobs(spark, tmp_path):
    first = odd_docs(spark, [(1, "token=abcdefgh1", "en"), (2, "plain", "en")])
    second = odd_docs(spark, [(1, "plain", "en"), (3, "token=abcdefgh1", "en"), (4, "new secret=abcdefgh2", "en")])
    path = str(tmp_path / "ledger")
    assert {r["doc_id"]: r["n_assign"] for r in secret_ledger.scan_into(spark, first, path).collect()} == {1: 1, 2: 0}
    assert spark.read.parquet(path).count() == 2
    assert {r["doc_id"]: r["n_assign"] for r in secret_ledger.scan_into(spark, second, path).collect()} == {1: 0, 3: 1, 4: 1}
    assert spark.read.parquet(path).count() == 3
    assert secret_ledger.findings(*secret_ledger.scan(empty(spark))).count() == 0


def test_ledger_with_repeated_entries(spark, tmp_path):
    docs = odd_docs(spark, [(1, "token=abcdefgh1", "en"), (1, "token=abcdefgh1", "en"), (None, "token=abcdefgh1", "en"), (None, None, "en")])
    paths, entries = secret_ledger.scan(docs)
    assert entries.count() == 2  # the empty blob is one
    got = secret_ledger.findings(paths, entries.unionByName(entries)).collect()
    assert len(got) == 4 and sum(r["n_assign"] for r in got) == 3
    assert len(list(secret_ledger._scan(secret_ledger.RULES, [pa.RecordBatch.from_pydict({"blob": ["x", "x"], "text": ["a", "a"]})]))[0]) == 1


# pipeline


def test_pipeline_of_odd_rows(spark):
    import corpus_pipeline as p

    extra = odd_docs(spark).withColumn("__gone", F.lit(1)).withColumn("row", F.lit("x"))
    rows = extra.unionByName(spark.read.parquet(f"{SF}/documents.parquet").limit(60).withColumns({c: F.lit(None) for c in ("line", "host", "id", "bands", "__gone", "row")}), allowMissingColumns=True)
    kept = rows
    for name, stage in p.STAGES[:4]:
        n = kept.count()
        kept = stage(spark, kept, SF)
        assert kept.columns == list(p.COLUMNS) and 0 < kept.count() <= (n if name != "source mixing" else 3 * n), name
    assert p.STAGES[4][1](spark, kept, SF).count() == kept.count()


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = p.run(spark, SF)
    kept = p.STAGES[0][1](spark, docs, SF)
    assert kept.columns == list(p.COLUMNS) and [n for n, _ in p.STAGES] == ["quality rules", "line dedup", "near dedup", "source mixing", "byte BPE"]
    files = byte_bpe.default_files()
    one = docs.select(*p.COLUMNS)
    for _, stage in p.STAGES[:4]:
        one = stage(spark, one, SF)
        assert one.columns == list(p.COLUMNS)
    want = byte_bpe.encode(one, *files)
    assert sorted((r["doc_id"], r["n_tokens"]) for r in out.select("doc_id", "n_tokens").collect()) == sorted((r["doc_id"], r["n_tokens"]) for r in want.select("doc_id", "n_tokens").collect())
    for _, stage in p.STAGES:
        assert stage(spark, empty(spark).select(*p.COLUMNS), SF).count() == 0


COLUMNS = {
    "op2": "query_id rank vec_id score", "op3": "page_id host path rule verdict", "op4": "doc_id n_tokens ids_sha256 decoded_sha256", "op5": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op6": "doc_id size source_size target taken", "op7": "page_id url text n_chars", "op8": "doc_id class_id", "op9": "doc_id held_out lang_pred score", "op10": "doc_id n_assign n_access n_hex base_sha256 spans", "op1": "doc_id source text n_dropped",
}


def test_queries_have_columns(spark):
    assert {n.split("_")[0] for n in queries.QUERIES} == set(COLUMNS)
    for name, query in queries.QUERIES.items():
        assert set(COLUMNS[name.split("_")[0]].split()) <= set(query(spark, SF).columns), name


def test_verify_compares_each_text_of_a_repeated_id():
    own, other = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    for texts in ([other, own], [own, other]):
        b = pa.RecordBatch.from_arrays([pa.array([1, 1]), pa.array([2, 2]), pa.array([own, own]), pa.array(texts)], ["a", "b", "text_a", "text_b"])
        assert sum(out.num_rows for out in bagminhash._verify(0.8, [b])) == 1


def test_deep_containers_keep_paths_of_their_own():
    for around in ("<div>" * 200, "<div class='" + "alpha " * 150 + "'>", "<div><div class='" + "alpha " * 150 + "'>"):
        page = html_extract.read(f"{around}<div class='beta'>unmarked block</div><div class='gamma'>{'story words ' * 40}</div>")
        path = page.best()[0]
        assert page.text(path) == ("story words " * 40).strip() and len(set(page.path)) == len(page.path)
