"""Registered queries of the operators: whole tables in, whole results out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from rollbook.llm import alignment, decontaminate, language, licences, line_dedup, merkle, packing, pages, repeats, secrets, substrings, topk
from rollbook.llm.near_dedup import near_duplicates

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op8_minhash_near_dedup")
def op8(spark, sf_dir):
    return near_duplicates(_table(spark, sf_dir, "documents"), size=4, percent=80)


@query("op4_cross_parsing_language")
def op4(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    held = language.held_out(F.col("doc_id"))
    samples = language.fit(docs.where(~held))
    return language.identify(docs, samples).withColumn("held_out", held)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op9_dominance_best_fit")
def op9(spark, sf_dir):
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path(), capacity=2048)


@query("op3_pigeonhole_decontamination")
def op3(spark, sf_dir):
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def _licence_sql() -> str:
    phrases = {**licences.BASE, **licences.MORE}
    size = {p: len(p.split(" ")) for p in phrases}
    longest = {label: max(size[p] for p in phrases if phrases[p] == label) for label in phrases.values()}
    values = ", ".join(f"('{p}', '{label}', {str(p in licences.BASE).lower()}, {size[p]}, {longest[label]})" for p, label in phrases.items())
    keys = ", ".join(f"'{w}'" for w in sorted({w for p in phrases for w in p.split(" ")} & licences.KEYS))
    return r"""WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
 m AS (SELECT doc_id, w, len(w) AS n, list_filter(range(1, len(w) + 1), lambda i: w[i] IN (KEYS)) AS near FROM w),
 p AS (SELECT * FROM (VALUES PHRASES) AS t(phrase, label, base, size, longest)),
 e AS (SELECT doc_id, w, unnest(near) AS i FROM m),
 h AS (SELECT DISTINCT e.doc_id, p.*, s.start FROM e, p, LATERAL (SELECT unnest(range(greatest(0, i - size), i)) AS start) s WHERE array_to_string(w[start + 1 : start + size], ' ') = phrase),
 a AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
   list_sort(list_distinct(coalesce(list(label) FILTER (base), []))) AS b, list_sort(list_distinct(list(label))) AS l, max(size / longest) AS share FROM h GROUP BY doc_id)
SELECT m.doc_id, CAST(n AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
 coalesce(array_to_string(b, ','), '') AS base_labels, coalesce(array_to_string(l, ','), '') AS labels, CASE WHEN coalesce(n_base, 0) > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0)::DOUBLE END AS score
FROM m LEFT JOIN a USING (doc_id)""".replace("PHRASES", values).replace("KEYS", keys)


@query("op10_rare_token_licences", _licence_sql())
def op10(spark, sf_dir):
    return licences.scan(_table(spark, sf_dir, "documents"))


@query("op1_simhash_line_dedup")
def op1(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs, percent=80, least_bytes=1)


@query(
    "op6_pivot_top_k",
    """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
 SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5""",
)
def op6(spark, sf_dir):
    vectors = topk.scaled(_table(spark, sf_dir, "embeddings"), 256)
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5)


@query(
    "op7_fixed_block_repeats",
    r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
 g AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w WHERE len(w) >= 13),
 h AS (SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS s FROM g),
 m AS (SELECT s, min(doc_id) AS least FROM h GROUP BY s HAVING count(*) > 1),
 r AS (SELECT DISTINCT doc_id, i + j AS k FROM h JOIN m USING (s), (SELECT unnest(range(0, 13)) AS j) WHERE least < doc_id),
 n AS (SELECT doc_id, list(k) AS gone FROM r GROUP BY doc_id),
 k AS (SELECT w.doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed, list_transform(list_filter(range(1, len(w) + 1), lambda i: gone IS NULL OR NOT list_contains(gone, i)), lambda i: w[i]) AS kept FROM w LEFT JOIN n USING (doc_id))
 SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM k""",
)
def op7(spark, sf_dir):
    return repeats.remove_repeats(_table(spark, sf_dir, "documents"), size=13).drop("text")


@query("op2_host_suffix_extraction")
def op2(spark, sf_dir):
    return pages.main_text(_table(spark, sf_dir, "pages"))


@query("op5_lyndon_suffix_dedup")
def op5(spark, sf_dir):
    return substrings.remove_substrings(_table(spark, sf_dir, "documents"), size=400).drop("kept")


def _manifest_sql() -> str:
    def field(value: str, shown: str | None = None) -> str:
        return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen({shown or f'{value}::VARCHAR'}) || ':' || {shown or value} END"

    def leaf(n_chars: str) -> str:
        shown = f"({n_chars})::VARCHAR"
        return "sha256(concat(" + ", ".join([field("doc_id", "doc_id::VARCHAR"), field("source"), field("lang"), field("n_chars", shown), field("text")]) + "))"

    # crc32, bit by bit, over the digits of doc_id
    bits = "list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    digits = "list_transform(range(1, len(doc_id::VARCHAR) + 1), lambda i: ord(substr(doc_id::VARCHAR, i, 1))::BIGINT)"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, {digits}), lambda c, b: {bits}), 4294967295)"
    step = "(SELECT {0}, lvl + 1, i // 2, (any_value(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM {1} WHERE n > 1 GROUP BY {0}, lvl, i // 2)"
    return f"""WITH RECURSIVE leaf AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, h, t) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n, row_number() OVER () AS rid
   FROM (SELECT doc_id, lang, {leaf("n_chars")} AS h, CASE WHEN {crc} % 7 = 0 THEN {leaf("n_chars::HUGEINT + 1")} END AS t FROM documents)),
 node(lang, lvl, i, n, h) AS (SELECT lang, 0, i, n, h FROM leaf UNION ALL {step.format("lang", "node")}),
 seat AS (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM node WHERE n = 1),
 roof(one, lvl, i, n, h) AS (SELECT 1, 0, i, n, h FROM seat UNION ALL {step.format("one", "roof")}),
 way AS (SELECT rid, o.lvl, CASE WHEN s.h IS NULL THEN 'N' WHEN s.i < o.i THEN 'L' || s.h ELSE 'R' || s.h END AS s
     FROM leaf JOIN node o ON o.lang IS NOT DISTINCT FROM leaf.lang AND o.n > 1 AND o.i = leaf.i >> o.lvl
     LEFT JOIN node s ON s.lang IS NOT DISTINCT FROM o.lang AND s.lvl = o.lvl AND s.i = xor(o.i, 1)
   UNION ALL SELECT rid, 1000 + o.lvl, CASE WHEN s.h IS NULL THEN 'N' WHEN s.i < o.i THEN 'L' || s.h ELSE 'R' || s.h END
     FROM leaf JOIN seat ON seat.lang IS NOT DISTINCT FROM leaf.lang JOIN roof o ON o.n > 1 AND o.i = seat.i >> o.lvl LEFT JOIN roof s ON s.lvl = o.lvl AND s.i = xor(o.i, 1)),
 ways AS (SELECT rid, list(s ORDER BY lvl) AS p FROM way GROUP BY rid),
 told AS (SELECT leaf.doc_id, leaf.h AS leaf, seat.h AS subroot, (SELECT h FROM roof WHERE n = 1) AS root, sha256(array_to_string(list_transform(coalesce(p, []), lambda x: substr(x, 2)), '')) AS proof_sha256,
   list_reduce(list_prepend(coalesce(t, leaf.h), coalesce(p, [])), lambda acc, x: CASE x[1] WHEN 'L' THEN sha256(substr(x, 2) || acc) WHEN 'R' THEN sha256(acc || substr(x, 2)) ELSE sha256(acc) END) AS folded_root
   FROM leaf JOIN seat ON seat.lang IS NOT DISTINCT FROM leaf.lang LEFT JOIN ways USING (rid))
SELECT *, folded_root = root AS verified FROM told"""


@query("op13_merkle_manifest", _manifest_sql())
def op13(spark, sf_dir):
    return merkle.manifest(_table(spark, sf_dir, "documents"))


def _secrets_sql() -> str:
    """Matches and the texts between them alternate, so that places are sums of lengths."""
    lowered = "translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    quoted = lambda text: "'" + text.replace("'", "''") + "'"
    parts = [
        f"SELECT rid, {k} AS k, '{r.kind}' AS kind, {r.least} AS least, regexp_split_to_array({t}, {p}) AS gaps, regexp_extract_all({t}, {p}) AS m, regexp_extract_all({t}, {p}, {r.group}) AS g FROM d"
        for k, r in enumerate(secrets.RULES)
        for t, p in [(lowered if r.any_case else "t", quoted(r.pattern))]
    ]
    shown = "coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k){0}, '')"
    base = f"FILTER (k < {len(secrets.BASE)})"
    counts = ", ".join(f"CAST(count(*) FILTER (kind = '{r.kind}') AS BIGINT) AS n_{r.kind}" for r in secrets.BASE)
    return f"""WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t FROM documents),
 r AS ({" UNION ALL ".join(parts)}),
 i AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM r WHERE len(m) > 0),
 p AS (SELECT rid, k, kind, CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s, length(m[i]) AS n FROM i WHERE length(g[i]) >= least),
 q AS (SELECT *, s + n AS e FROM p)
SELECT doc_id, {counts}, sha256({shown.format(" " + base)}) AS base_sha256, {shown.format("")} AS spans FROM d LEFT JOIN q USING (rid) GROUP BY rid, doc_id"""


@query("op11_trigram_secrets", _secrets_sql())
def op11(spark, sf_dir):
    return secrets.digests(secrets.find(_table(spark, sf_dir, "documents")))


def token_files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@query("op12_lockstep_alignment")
def op12(spark, sf_dir):
    return alignment.link_tokens(_table(spark, sf_dir, "documents"), *token_files())
