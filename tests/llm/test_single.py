"""Language, packing, leaks, licences, search and pages on small cases."""

import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from rollbook.llm import decontaminate, language, licences, packing, pages, topk
from rollbook.llm.queries import ORACLES, QUERIES, tokenizer_path
from tests.llm.conftest import prose

SF = "/root/testdata/sf0.001"


def test_automaton_holds_all_substrings():
    text = b"abracadabra"
    states = language.automaton(text)

    def holds(s):
        at = 0
        for c in s:
            if c not in states[at]:
                return False
            at = states[at][c]
        return True

    subs = {text[i:j] for i in range(12) for j in range(i, 12)}
    assert all(holds(s) for s in subs) and not any(holds(s) for s in (b"abc", b"dd", b"rac a"))


def test_phrases_are_greedy_longest_matches():
    sample = b"the cat sat on the mat"
    parser = language.Parser({"x": sample})
    for text in (b"the cat", b"catmat", b"zzz", b"", b"on the cat on q"):
        n, at = 0, 0
        while at < len(text):
            end = at + 1
            while end <= len(text) and text[at:end] in sample:
                end += 1
            at = max(at + 1, end - 1)
            n += 1
        got = parser.phrases(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        assert got[0, 0] == n, text


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = language.held_out(F.col("doc_id"))
    got = language.identify(docs, language.fit(docs.where(~held))).join(docs.select("doc_id", "lang"), "doc_id").where(held).toPandas()
    assert (got.lang == got.lang_pred).mean() >= 0.95 and got.score.between(0, 1).all()


def test_language_edges(docs_of):
    rows = [(1, None), (2, ""), (3, "123 !?"), (4, "alpha beta " * 5000), (4, "gamma"), (None, "delta")]
    got = language.identify(docs_of(rows), {"en": b"alpha beta gamma delta", "xx": b"qqq www"}).collect()
    assert Counter((r.doc_id, r.lang_pred) for r in got) == Counter([(1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en"), (None, "en")])
    assert {r.lang_pred for r in language.identify(docs_of(rows), {}).collect()} == {"und"}
    assert language.fit(docs_of([])) == {} and language.identify(docs_of([]), {}).count() == 0


def fits(sizes, capacity):
    """Fewest sequences, by search."""
    sizes = sorted(sizes, reverse=True)
    best = [len(sizes)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] >= sizes[i] and bins[k] not in bins[:k]:
                go(i + 1, [*bins[:k], bins[k] - sizes[i], *bins[k + 1 :]])
        go(i + 1, [*bins, capacity - sizes[i]])

    go(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(40))
def test_dominance_keeps_a_best_packing(seed):
    r = random.Random(seed)
    sizes = [r.randint(1, 20) for _ in range(r.randint(1, 9))]
    count = Counter(sizes)
    fixed, left = packing.dominance(dict(count), 20)
    rest = [s for s, n in left.items() for _ in range(n)]
    assert Counter(s for items, n in fixed for s in items * n) + Counter(rest) == count
    assert all(sum(items) <= 20 for items, _ in fixed)
    assert sum(n for _, n in fixed) + fits(rest, 20) == fits(sizes, 20)
    bins = packing.best_fit(left, 20)
    assert Counter(s for items, n in bins for s in items * n) == Counter(rest) and all(sum(items) <= 20 for items, _ in bins)


def test_packing_round_trip(docs_of):
    from tokenizers import Tokenizer

    path = tokenizer_path()
    rows = [(1, None), (2, ""), (3, prose(1, 3000)), (4, "a|b | c <|endoftext|> Don't, é́. 日本　x"), (4, "same id"), (5, prose(2, 300)), (5, prose(2, 300)), (None, "no id")] + [(10 + k, prose(k, k)) for k in range(40)]
    got = packing.pack(docs_of(rows), path, 256).toPandas()
    tok = Tokenizer.from_file(path)
    want = Counter()
    for i, t in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for k in range(-(-len(ids) // 256)):
            part = ids[k * 256 : k * 256 + 256]
            want[(i, k, k * 256, len(part), zlib.crc32(part.tobytes()))] += 1
    have = Counter((None if math.isnan(a) else int(a), *map(int, b)) for a, b in zip(got.doc_id, got[["piece", "start", "length", "ids_crc32"]].itertuples(index=False)))
    assert have == want
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= 256
    assert packing.pack(docs_of([]), path).count() == 0


def test_myers_against_dynamic_programming():
    r = random.Random(3)
    for _ in range(60):
        p, t = (bytes(r.choice(b"abc") for _ in range(r.randint(1, n))) for n in (12, 40))
        row = list(range(len(p) + 1))
        best = row[-1]
        for c in t:
            new = [0]
            for i, x in enumerate(p):
                new.append(min(row[i] + (x != c), row[i + 1] + 1, new[i] + 1))
            row = new
            best = min(best, row[-1])
        assert decontaminate.myers(p, t)[0] == best


def test_leaks_within_the_budget(docs_of, spark):
    r = random.Random(8)
    items = [(k, prose(50 + k, 20)) for k in range(12)] + [(90, None), (91, "  "), (92, "Tiny One"), (93, prose(50, 20))]
    rows = [(1, None), (2, ""), (3, prose(7, 2000))]
    for k in range(12):
        text = list(items[k][1])
        for _ in range(k):
            text[r.randrange(len(text))] = "#"
        rows.append((100 + k, f"{prose(k, 30)}\n{''.join(text).upper()} \t{prose(k + 1, 30)}"))
    rows += [(200, "a tiny  one here"), (200, "nothing"), (None, items[2][1])]
    got = {(g.doc_id, g.item_id): g.edits for g in decontaminate.leaks(docs_of(rows), spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(5))).collect()}

    def norm(t):
        return re.sub(r"[\x20\x09-\x0D]+", " ", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")).strip(" ").encode()

    want = {}
    for i, t in rows:
        for k, x in items:
            if norm(x):
                edits = decontaminate.myers(norm(x), norm(t))[0]
                if edits <= decontaminate.budget(len(norm(x))):
                    want[i, k] = edits
    assert set(got) == set(want) and (100, 0) in got and (200, 92) in got and (None, 2) in got
    left = [x.doc_id for x in decontaminate.clean(docs_of(rows), spark.createDataFrame(items, "item_id long, text string")).collect()]
    assert None not in left and 100 not in left and {1, 2, 3} <= set(left)
    assert decontaminate.leaks(docs_of([]), spark.createDataFrame(items, "item_id long, text string")).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = con.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert Counter(tuple(r) for r in got.select(*names).collect()) == Counter(cur.fetchall())


def test_licences_edges(docs_of):
    rows = [(1, None), (2, ""), (3, "Released under the MIT-License; see also: CC BY-NC 4.0."), (4, "mit licenses, apache  license"), (4, "Redistribution and use in source and binary forms"), (None, "GNU General Public License, version 3"), (5, "word " * 50000 + "apache\nlicense")]
    got = {(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in licences.scan(docs_of(rows)).collect()}
    assert got == {
        (1, 0, 0, None, None, "", "", 0.0), (2, 0, 0, None, None, "", "", 0.0), (3, 12, 2, 3, 7, "cc-by,mit", "cc-by,cc-by-nc,mit", 1.0), (4, 4, 1, 2, 2, "apache", "apache", 1.0),
        (4, 8, 0, None, None, "", "bsd", 1.0), (None, 6, 1, 0, 0, "gpl", "gpl,gpl-3.0", 1.0), (5, 50002, 1, 50000, 50000, "apache", "apache", 1.0),
    }
    assert licences.scan(docs_of([])).count() == 0


def test_top_k_edges(spark):
    r = random.Random(4)
    rows = [(i, [r.gauss(0, 1) for _ in range(6)]) for i in range(0, 120)]
    rows += [(200, None), (201, [1.0, float("nan")] * 3), (202, [None] * 6), (203, []), (None, [1.0] * 6), (250, [5.0] * 6), (251, [5.0] * 6), (252, [5.0] * 6), (300, [1.0, 2.0]), (300, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit(1)).withColumn("score", F.lit(2))
    vectors = topk.scaled(df)
    got = [(x.query_id, x.rank, x.vec_id, x.score) for x in topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), 5).collect()]
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q, v in dict((i, v) for i, v in whole if i % 50 == 0).items():
        best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in whole if i != q and len(w) == len(v))[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert Counter(got) == Counter(want)
    assert topk.top_k(vectors.where("false"), vectors.where("false")).count() == 0


def test_pages(spark):
    shared = "Welcome to the site of many many pages"
    rows = [
        (1, "http://a.example/1", f"<html><head><title>T</title></head><body><nav><a>Home</a></nav><article><header><h1>By line</h1></header><h1>Head &amp; more</h1><p>One\n two<b>three</b></p><p>Four<br>five<div class='comments'>no</div><script>var x='</p>'</script></article><p>{shared}</p><footer>f</footer>"),
        (2, "http://a.example/2", f"<div>{shared}</div><p>unique text number two &lt;here&gt;</p><aside>x</aside>"),
        (3, "http://a.example/3", f"<div>{shared}</div><p>other words stand on page three</p><form>q<input></form>"),
        (3, "http://a.example/3", f"<div>{shared}</div><p>other words stand on page three</p><form>q<input></form>"),
        (4, None, None), (5, None, ""), (6, "x", "<p>"), (7, "http://b.example/", f"<p>{shared}</p>"), (None, "http://b.example/", "<main>" + "<p>long " * 20000 + "</main>"),
    ]
    got = [(r.page_id, r.text, r.n_chars) for r in pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("host", F.lit(2))).collect()]
    want = [(1, "Head & more\nOne twothree\nFour\nfive"), (2, "unique text number two <here>"), (3, "other words stand on page three"), (3, "other words stand on page three"), (4, ""), (5, ""), (6, ""), (7, shared), (None, "\n".join(["long"] * 20000))]
    assert Counter(got) == Counter((i, t, len(t)) for i, t in want)
    assert pages.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pipeline_stages_take_effect(docs_of, spark, tmp_path):
    import corpus_pipeline as pipeline

    passage = prose(77, 25)
    rows = [(i, f"{prose(i, 120)}\n{prose(i + 500, 60)}") for i in range(1, 30)] + [(40, "123 456"), (41, None), (42, rows_text := prose(1000, 100)), (43, rows_text + " changed"), (44, f"{prose(44, 50)} {passage} {prose(45, 50)}")]
    docs = docs_of(rows).select("doc_id", "text", "lang", "source", "n_chars")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = {}
    for name, stage in pipeline.STAGES:
        columns = docs.columns
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        assert name == "packing" or docs.columns == columns
    everyone = {i for i, _ in rows}
    assert kept["language"] == everyone - {40, 41}
    assert kept["near_duplicates"] == everyone - {40, 41, 43}
    assert kept["packing"] == kept["decontamination"] == everyone - {40, 41, 43, 44}


@pytest.mark.parametrize(
    "page,text",
    [
        ("<html><head><title>T</title><article><p>Body text here</p></article></html>", "Body text here"),
        ("<head><meta charset=utf-8><link rel=x><script>var a = '<p>no</p>'</script><main><p>One</p><p>Two</p></main>", "One\nTwo"),
        ("<html><head><title>T</title></head><body><article><p>A</p></article></body></html>", "A"),
        ("<article><p>A</p><button>Menu<p>B</p><p>C</p></article>", "A\nB\nC"),
        ("<article><p>A</p><button>Menu<p>B</p><button>Share</button><p>C</p></article>", "A\nB\nC"),
        ("<article><p>A</p><button><div>Icon</div></button><p>B</p></article>", "A\nB"),
        ("<article><p>A</p><noscript>turn it on<p>B</p></article>", "A\nB"),
        ("<article><p>A</p><noscript><p>turn it on</p></noscript><p>B</p></article>", "A\nB"),
        ("<article><p>A</p><select><option>1<option>2<p>B</p></article>", "A\nB"),
        ("<article><p>A <svg><text>x</text><p>B</p></article>", "A\nB"),
        ("<article><p>A</p><script>if (a < b) { <p>never</p>", "A"),
    ],
)
def test_left_out_end_tags_lose_no_text(page, text):
    assert "\n".join(t for t, kind in pages._blocks(page) if kind == 2) == text


@pytest.mark.parametrize("many", [2000, 1])
def test_repeated_blocks_inside_articles(spark, monkeypatch, many):
    """Blocks of articles that other pages of the host repeat go too, on hosts of many pages as on others; two versions of one article
    keep their text."""
    monkeypatch.setattr(pages, "HOST_PAGES", many)
    plea = "please sign up for our weekly letter and never miss a story"
    rows = [(i, "http://a.example/", f"<article><h1>Title {prose(i, 2)}</h1><p>{prose(i, 30)}</p><p>{plea}</p></article>") for i in range(1, 5)]
    rows += [(9, "http://c.example/", f"<main><p>{prose(9, 30)}</p><p>{plea}</p></main>")]
    body = [prose(20 + k, 12) for k in range(6)]
    rows += [(20, "http://d.example/1", "<article>" + "".join(f"<p>{x}</p>" for x in body) + "</article>"), (21, "http://d.example/2", "<article>" + "".join(f"<p>{x}</p>" for x in [*body[:5], prose(40, 12)]) + "</article>")]
    rows += [(30, "http://a.example/x", f"<p>{prose(30, 20)}</p><p>{plea}</p>")]
    want = {i: f"Title {prose(i, 2)}\n{prose(i, 30)}" for i in range(1, 5)}
    want |= {9: f"{prose(9, 30)}\n{plea}", 20: "\n".join(body), 21: "\n".join([*body[:5], prose(40, 12)]), 30: prose(30, 20)}
    assert {r.page_id: r.text for r in pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()} == want
