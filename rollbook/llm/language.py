"""Language by cross-parsing: the language whose suffix automaton covers a text with the fewest longest-match phrases wins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rollbook.llm.hashing import flat, slices

#: Bounds of the labelled sample behind one language: rows drawn by hash, bytes taken of each row.
SAMPLE_ROWS, SAMPLE_BYTES = 48, 500
#: Phrases do not run across pieces of so many bytes; every piece of a text is parsed.
PIECE = 256


def automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of `text`; state 0 is the empty string, every state accepts a substring."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p != -1 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


class Parser:
    """Automata of all languages as one table: row = state, column = symbol, value = next state * 2 + (a phrase begins here)."""

    def __init__(self, samples: dict[str, bytes]):
        self.langs = sorted(samples)
        seen = sorted(set(b"".join(samples.values())))
        self.symbol = np.zeros(256, np.uint8)  # 0: a byte no sample holds
        self.symbol[seen] = np.arange(1, len(seen) + 1)
        self.width = len(seen) + 1
        self.tables = []
        for lang in self.langs:
            states = automaton(self.symbol[np.frombuffer(samples[lang], np.uint8)].tobytes())
            root = np.ones(self.width, np.int32)  # an unknown symbol is a phrase of its own
            for c, to in states[0].items():
                root[c] = to * 2 + 1
            table = np.tile(root, (len(states), 1))
            for i, to in enumerate(states[1:], 1):  # from the empty string, every symbol begins a phrase
                for c, j in to.items():
                    table[i, c] = j * 2
            self.tables.append(table.ravel())

    def phrases(self, data: np.ndarray, borders: np.ndarray) -> np.ndarray:
        """Phrases (rows x languages) that the pieces of each row fall into."""
        size = np.diff(borders)
        per_row = -(-size // PIECE)
        row = np.repeat(np.arange(len(size)), per_row)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(per_row) - per_row, per_row)
        start = borders[:-1][row] + nth * PIECE
        length = np.minimum(PIECE, borders[1:][row] - start)
        order = np.argsort(-length, kind="stable")
        row, start, length = row[order], start[order], length[order]
        symbols = self.symbol[data].astype(np.int32)
        out = np.zeros((len(size), len(self.langs)), np.int64)
        alive = [int(np.searchsorted(-length, -t, "left")) for t in range(PIECE)]  # pieces longer than t
        for k, table in enumerate(self.tables):
            state, begun = np.zeros(len(row), np.int32), np.zeros(len(row), np.int32)
            for t in range(PIECE):
                n = alive[t]
                if not n:
                    break
                step = table[state[:n] * self.width + symbols[start[:n] + t]]
                begun[:n] += step & 1
                state[:n] = step >> 1
            out[:, k] = np.bincount(row, weights=begun, minlength=len(size))
        return out


def normalised(texts: pa.Array) -> pa.Array:
    """Lower case, with every run of characters other than letters as one space."""
    return pc.replace_substring_regex(pc.utf8_lower(texts.cast(pa.large_string())), pattern=r"[\x00-\x60\x7B-\x7F]+", replacement=" ")


def fit(labelled: DataFrame, rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES) -> dict[str, bytes]:
    """Bytes to learn each language from: of `rows` rows per language, drawn by hash of the text, the `size` bytes from the
    middle on. At most rows x size bytes per language reach the driver."""
    text = F.col("text").cast("string")
    usable = labelled.select("lang", text.alias("text"), F.xxhash64(text).alias("h")).where("lang IS NOT NULL AND text RLIKE '\\\\p{L}'")
    first = usable.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).where(F.col("n") <= rows)
    start = F.greatest(F.lit(1), F.floor((F.length("text") - size) / 2).cast("int") + 1)
    taken = first.select("lang", "n", F.substring("text", start, F.lit(size)).alias("piece")).collect()
    out: dict[str, list[str]] = {}
    for r in sorted(taken, key=lambda r: (r["lang"], r["n"])):
        out.setdefault(r["lang"], []).append(r["piece"])
    return {lang: " ".join(normalised(pa.array(pieces)).to_pylist()).encode() for lang, pieces in out.items()}


def identify(docs: DataFrame, samples: dict[str, bytes]) -> DataFrame:
    """docs (doc_id, text) with lang_pred and score, one row per row.

    A text's phrases in a language are greedy longest matches with that language's sample (one more phrase begins wherever
    a match ends, and at every 256th byte). The language with the fewest phrases wins; ties go to the smaller name. score is
    1 - fewest / second fewest (1 with one language). Null text, or no letter in it: `und`, score 0. No samples: all `und`.
    Only doc_id and text are read; other columns are ignored."""
    made: list[Parser] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            made.append(Parser(samples))
        parser = made[0]
        for b in slices(batches, "text"):
            texts = b.column("text")
            letters = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            pred, score = np.full(b.num_rows, "und", object), np.zeros(b.num_rows)
            if len(parser.langs) and letters.any():
                counts = parser.phrases(*flat(normalised(texts)))
                best = counts.argmin(1)
                low = counts[np.arange(len(counts)), best]
                second = np.partition(counts, 1, axis=1)[:, 1] if len(parser.langs) > 1 else np.full(len(counts), np.inf)
                pred[letters] = np.array(parser.langs, object)[best[letters]]
                score[letters] = (1 - low / np.maximum(second, 1))[letters]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(pred, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out(doc_id) :
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))
