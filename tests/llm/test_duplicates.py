"""Near duplicates, repeated windows and substrings against brute force."""

import hashlib
import re
from collections import Counter

import pytest

from corpus_pipeline import drop_repeated_lines
from rollbook.llm.graph import components
from rollbook.llm.line_dedup import dedup_lines
from rollbook.llm import near_dedup
from rollbook.llm.near_dedup import least_matches, near_duplicates
from rollbook.llm.repeats import packed, remove_repeats, unpacked
from rollbook.llm.substrings import remove_substrings
from rollbook.llm.suffixes import suffix_array
from tests.llm.conftest import prose

WORD = r"[^\x20\x09-\x0D]+"


def edge_rows():
    base = prose(1, 200)
    near = base.split(" ")
    near[100] = "changed"
    far = prose(2, 120)
    return [
        (1, None), (2, ""), (3, "  \n\t "), (4, "Two words"), (5, "two WORDS"), (6, base), (7, " ".join(near)), (8, base.upper()), (9, far), (10, far + " " + base),
        (10, far + " " + base), (11, prose(3, 4000)), (12, "é ü " * 300), (13, "aaaa" * 400), (14, "x" * 1000 + base), (None, base), (15, far),
    ]


def words(text):
    return re.findall(WORD, text or "")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_near_duplicates_against_all_pairs(docs_of):
    rows = edge_rows()
    got = near_duplicates(docs_of(rows), size=4).collect()
    sets = {}
    for i, t in rows:
        w = words(low(t))
        sets.setdefault(i, set()).add(frozenset(tuple(w[j : j + 4]) for j in range(len(w) - 3)) if len(w) >= 4 else frozenset([tuple(w)] if w else []))
    ids = sorted(i for i in sets if i is not None)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert r.component_id == find(r.doc_id) and r.kept == (r.component_id == r.doc_id)
            assert r.n_shingles in {len(s) for s in sets[r.doc_id]}


def test_chain_of_copies_is_one_component(docs_of):
    text = prose(9, 150).split(" ")
    chain = []
    for k in range(30):
        text[(k * 5) % 150] = f"edit{k}"
        chain.append((k, " ".join(text)))
    assert {r.component_id for r in near_duplicates(docs_of(chain), size=4).collect()} == {0}


def test_large_component_meets_loose_copies(docs_of):
    import random

    r = random.Random(12)
    base = prose(31, 160).split(" ")

    def copy(edits):
        out = list(base)
        for k in r.sample(range(160), edits):
            out[k] = f"w{r.random()}"
        return " ".join(out)

    rows = [(i, copy(1)) for i in range(40)] + [(100 + i, copy(7 + i % 3)) for i in range(12)]
    sets = {i: frozenset(tuple(w[j : j + 4]) for j in range(len(w) - 3)) for i, w in ((i, t.lower().split(" ")) for i, t in rows)}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = {g.doc_id: g.component_id for g in near_duplicates(docs_of(rows), size=4).collect()}
    assert got == {i: find(i) for i in sets} and len(set(got.values())) > 1


def test_crowded_bucket_is_compared_in_blocks(docs_of, monkeypatch):
    """Texts that share a bucket but are not linked: only small buckets go on to rounds with a row per pair, and no link is lost."""
    common = [f"c{i}" for i in range(80)]
    texts = [" ".join(common + [f"own{d}x{i}" for i in range(20)]) for d in range(400)]
    texts += [t.rsplit(" ", 1)[0] + " other" for t in texts[:5]]
    asked = []
    real = near_dedup.link_buckets
    monkeypatch.setattr(near_dedup, "link_buckets", lambda open_, *a, **b: asked.append(open_) or real(open_, *a, **b))
    got = {r.doc_id: r.component_id for r in near_duplicates(docs_of(list(enumerate(texts))), size=4).collect()}
    assert got == {d: d - 400 if d >= 400 else d for d in range(405)}
    widest = [max([r["count"] for r in f.groupBy("key").count().collect()], default=0) for f in asked]
    assert widest[0] >= 100 and widest[-1] < near_dedup.CROWD


def test_bayes_bounds_rise():
    bounds = least_matches(0.8, 1e-6)
    assert [n for n, _ in bounds] == [32, 64, 96, 128]
    assert all(a[1] < b[1] <= 0.8 * b[0] for a, b in zip(bounds, bounds[1:]))


def test_word_windows_against_brute_force(docs_of):
    rows = edge_rows()
    first = {}
    for i, t in rows:
        if i is not None:
            w = words(t)
            for j in range(len(w) - 12):
                key = tuple(w[j : j + 13])
                first[key] = min(first.get(key, i), i)
    want = []
    for i, t in rows:
        w = words(t)
        gone = {j + k for j in range(len(w) - 12) for k in range(13) if i is not None and first[tuple(w[j : j + 13])] < i}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        want.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in remove_repeats(docs_of(rows)).collect()]
    assert Counter(got) == Counter(want)


@pytest.mark.parametrize("crowd", [512, 1])
def test_byte_windows_against_brute_force(docs_of, crowd):
    rows = [(i, t) for i, t in edge_rows()] + [(20, "z" * 399), (21, "z" * 900), (22, "q" * 400 + prose(5, 90)), (23, prose(5, 90) + "q" * 400)]
    seen = Counter(b[j : j + 400] for b in ((t or "").encode() for _, t in rows) for j in range(len(b) - 399))
    want = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for j in range(len(b) - 399):
            if seen[b[j : j + 400]] > 1:
                gone[j : j + 400] = b"\1" * 400
        spans = len(re.findall(b"\1+", bytes(gone)))
        want.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_substrings(docs_of(rows), crowd=crowd).collect()]
    assert Counter(got) == Counter(want)


@pytest.mark.parametrize("text", [[], [3], [1, 1, 1, 1], [2, 1, 2, 1, 2], [0, 5, 0, 5, 5, 0, 5, 0], list(b"mississippi" * 3), list(range(20, 0, -1))])
def test_suffix_array(text):
    assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def test_packed_round_trip():
    import numpy as np

    for values in ([], [0], [0, 0, 65534, 65535, 65536, 200000, 2**29 - 1]):
        assert unpacked(packed(np.array(values, np.int64))).tolist() == values


def test_lines(docs_of):
    line = "The quick brown fox jumps over the lazy dog near the river bank on day 17"
    rows = [(1, f"{line}\nown words of the first document here"), (2, f"intro of the second document, long\n{line.replace('17', '42').upper()}\n\nend"), (3, None), (4, ""), (5, "\n"), (6, line), (6, line), (7, "short"), (8, "short"), (None, "a null id has its own long enough line")]
    got = {(r.doc_id, r.text, r.n_lines, r.n_removed) for r in dedup_lines(docs_of(rows)).collect()}
    assert got == {
        (1, rows[0][1], 2, 0), (2, "intro of the second document, long\n\nend", 4, 1), (3, None, 0, 0), (4, "", 1, 0), (5, "\n", 2, 0), (6, "", 1, 1),
        (7, "short", 1, 0), (8, "short", 1, 0), (None, rows[9][1], 1, 0),
    }


def test_lines_link_near_ones(docs_of):
    a = prose(4, 80)
    b = a[:-1] + ("x" if a[-1] != "x" else "y")
    out = {r.doc_id: r.text for r in dedup_lines(docs_of([(1, a), (2, b), (3, prose(6, 80))])).collect()}
    assert out[1] == a and out[3] == prose(6, 80)
    assert out[2] in ("", b)  # SimHash may part them, edit similarity would not


def test_lines_recall_against_edit_distance(docs_of):
    import random

    r = random.Random(8)
    rows, near = [], set()
    for i in range(150):
        a = prose(1000 + i, r.randint(6, 60)).split(" ")
        b = list(a)
        for k in r.sample(range(len(a)), max(1, round(len(a) * r.uniform(0, 0.2)))):
            b[k] = prose(5000 + 100 * i + k, 1)
        a, b = " ".join(a), " ".join(b)
        row = list(range(len(b) + 1))
        for x in a:
            last, row = row, [row[0] + 1]
            for j, y in enumerate(b):
                row.append(min(last[j + 1] + 1, row[j] + 1, last[j] + (x != y)))
        rows += [(i, a), (1000 + i, b)]
        if a != b and 5 * row[-1] <= max(len(a), len(b)):
            near.add(1000 + i)
    gone = {g.doc_id for g in dedup_lines(docs_of(rows)).collect() if g.n_removed}
    assert len(near) > 100 and gone <= near
    assert len(gone) >= 0.97 * len(near), f"{len(gone)} of {len(near)} links found"


def test_short_lines_and_threshold(docs_of):
    rows = [(1, "Ja 5\nown"), (2, "ja, 7\n--\n\nx"), (3, "X\n--")]
    want = {1: "Ja 5\nown", 2: "--\n\nx", 3: "--"}
    assert {r.doc_id: r.text for r in dedup_lines(docs_of(rows), least_bytes=1).collect()} == want
    assert {r.doc_id: r.text for r in drop_repeated_lines(None, docs_of(rows), "").collect()} == want
    a = prose(4, 80)
    pair = docs_of([(1, a), (2, a.replace(" ", " x ", 1))])
    assert {r.doc_id: r.n_removed for r in dedup_lines(pair, percent=80).collect()} == {1: 0, 2: 1}
    assert {r.doc_id: r.n_removed for r in dedup_lines(pair, percent=100).collect()} == {1: 0, 2: 0}


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 90), (90, 95), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 90, 90: 90, 95: 90}


def test_empty_tables(docs_of):
    none = docs_of([])
    for f in (near_duplicates, remove_repeats, remove_substrings, dedup_lines):
        assert f(none).count() == 0


def test_lines_keep_columns_of_any_name(docs_of):
    from pyspark.sql import functions as F

    docs = docs_of([(1, "alpha beta gamma delta\nown line of one"), (2, "alpha beta gamma delta\nother line of two")])
    docs = docs.withColumns({"rid": F.lit("keep me"), "_rid": F.lit(1), "GONE": F.lit("too"), "__rid": F.lit(2), "__gone": F.lit(3)})
    out = dedup_lines(docs)
    assert set(docs.columns) <= set(out.columns)
    rows = {r["doc_id"]: (r["n_removed"], r["rid"], r["GONE"], r["__gone"]) for r in out.collect()}
    assert rows == {1: (0, "keep me", "too", 3), 2: (1, "keep me", "too", 3)}


def edits(x: str, y: str) -> int:
    row = list(range(len(y) + 1))
    for i, c in enumerate(x, 1):
        last, row = row, [i]
        for j, d in enumerate(y, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (c != d)))
    return row[-1]


@pytest.mark.parametrize("letters", ["ab", "abcdefghijk é", "".join(chr(0x4E00 + i) for i in range(300))])
def test_edits_within_a_limit(letters):
    import random

    import numpy as np

    from rollbook.llm.edits import Codes, within_edits

    r = random.Random(len(letters))
    texts = ["", "a"]
    for _ in range(24):
        x = [r.choice(letters) for _ in range(r.choice([1, 5, 63, 64, 65, 130, 260]))]
        y = list(x)
        for _ in range(r.randint(0, len(x) // 4 + 1)):
            at = r.randrange(len(y) + 1)
            y[at : at + r.randint(0, 1)] = r.choice(letters) * r.randint(0, 1)
        texts += ["".join(x), "".join(y)]
    a = np.arange(len(texts))
    a, b = np.concatenate([a, a]), np.concatenate([a ^ 1, np.roll(a, 3)])
    true = np.array([edits(texts[i], texts[j]) for i, j in zip(a, b)])
    codes = Codes(texts)
    for most in (np.maximum(codes.length[a], codes.length[b]) // 5, true, true - 1, true + 4, 0 * true + 9):
        assert (within_edits(codes, a, b, most) == (true <= most)).all()


@pytest.mark.parametrize("nodes,step", [(1024, 1 << 19), (5, 7)])
def test_lines_of_a_crowded_bucket(docs_of, monkeypatch, nodes, step):
    """Unlike lines with one passage in common, and chains of like ones among them: whole or in blocks, as by comparing every two."""
    import random

    from rollbook.llm import line_dedup

    monkeypatch.setattr(line_dedup, "BLOCK_NODES", nodes)
    monkeypatch.setattr(line_dedup, "STEP_PAIRS", step)
    r = random.Random(3)
    lines = []
    for i in range(14):
        words = f"{prose(100 + i, 9)} {prose(1, 12)} {prose(300 + i, 9)}".split(" ")
        lines.append(" ".join(words))
        for _ in range(i % 4):  # each differs from the one before
            words[r.randrange(9)] = prose(r.randrange(10**6), 1)
            lines.append(" ".join(words))
    near = [[100 * edits(x, y) <= 20 * max(len(x), len(y)) for y in lines] for x in lines]
    group = list(range(len(lines)))
    for _ in lines:
        group = [min(g for g, like in zip(group, row) if like) for row in near]
    assert len(set(group)) < len(lines) - 10
    got = {g.doc_id for g in dedup_lines(docs_of(list(enumerate(lines)))).collect() if g.n_removed}
    assert got == {i for i, g in enumerate(group) if g != i}
