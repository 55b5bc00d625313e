"""Quality rules by repetition coverage: rolling hashes of several n-gram lengths in numpy.

The words of many texts are numbered and laid end to end. Prefix sums of the
numbers' hashes, weighted by powers of an odd base, give the hash of every window
of n words at once; equal windows of a text meet by sorting. Words and characters
covered by repeated windows are counted through difference arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, pieces

#: The largest share of characters that may lie in repeated windows of n words
#: (first occurrences not counted), by n; then of lines, in texts of MANY_LINES or more, and of
#: characters in lines, that repeat.
MOST_BY_LENGTH = {5: 0.15, 6: 0.14, 8: 0.12, 10: 0.10}
MOST_LINES, MANY_LINES, MOST_LINE_CHARS = 0.30, 10, 0.20
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\r\x0b\x0c"
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, dup_ngram_share double, dup_line_share double, dup_line_chars double, base_failed boolean, kept boolean"
_ARROW = pa.schema([("doc_id", pa.int64())] + [(c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [(c, pa.float64()) for c in ("dup_ngram_share", "dup_line_share", "dup_line_chars")] + [("base_failed", pa.bool_()), ("kept", pa.bool_())])


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads small numbers over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Windows:
    """The windows of the words of many texts. ``words``: numbers, text after text; ``bounds``: where texts begin, and the end."""

    def __init__(self, words: np.ndarray, bounds: np.ndarray):
        self.words, self.bounds = words, bounds
        counts = np.diff(bounds)
        self.owner = np.repeat(np.arange(len(counts)), counts)
        self.ends = np.repeat(bounds[1:], counts)
        powers = np.cumprod(np.full(len(words) + 1, BASE, np.uint64))
        self.back = np.cumprod(np.full(len(words) + 1, INVERSE, np.uint64))
        self.sums = np.concatenate(([np.uint64(0)], np.cumsum(_mixed(words.astype(np.uint64) + np.uint64(1)) * powers[: len(words)])))

    def repeated(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of windows of n words found twice or more in their text, and whether each is the first."""
        at = np.flatnonzero(np.arange(len(self.words)) + n <= self.ends)
        key = _mixed((self.sums[at + n] - self.sums[at]) * self.back[at]) ^ _mixed(self.owner[at].astype(np.uint64) + np.uint64(1 << 40))
        order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
        same = key[1:] == key[:-1]
        a, b = at[:-1][same], at[1:][same]
        if any((self.words[a + i] != self.words[b + i]).any() for i in range(n)) or (self.owner[a] != self.owner[b]).any():
            return self._by_content(n)
        first = np.concatenate(([True], ~same))[: len(at)]
        more = np.concatenate((same, [False]))[: len(at)]
        twice = ~first | more
        return at[twice], first[twice]

    def _by_content(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The same by comparing words, for a batch in which two windows share a hash."""
        at = np.flatnonzero(np.arange(len(self.words)) + n <= self.ends)
        rows = np.column_stack([self.owner[at], *(self.words[at + i] for i in range(n))])
        _, start, group, count = np.unique(rows, axis=0, return_index=True, return_inverse=True, return_counts=True)
        first = np.zeros(len(at), bool)
        first[start] = True
        twice = count[group.ravel()] > 1
        return at[twice], first[twice]

    def covered(self, starts: np.ndarray, n: int) -> np.ndarray:
        """Whether each word lies in one of the windows."""
        size = len(self.words) + 1
        edge = np.bincount(starts, minlength=size) - np.bincount(starts + n, minlength=size)
        return np.cumsum(edge)[:-1] > 0

    def by_text(self, values: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
        return sums[self.bounds[1:]] - sums[self.bounds[:-1]]


def measured(texts: list[str]) -> dict[str, np.ndarray]:
    """The columns of SCHEMA but doc_id, for each text."""
    number: dict[bytes, int] = {}
    words, lengths, bounds, rows = [], [], [0], []
    for text in texts:
        raw = text.encode("utf-8", "surrogatepass")
        own = raw.split()  # bytes split at ASCII white space only
        words += [number.setdefault(w, len(number)) for w in own]
        lengths += map(len, own) if len(raw) == len(text) else (len(w.decode("utf-8", "surrogatepass")) for w in own)
        bounds.append(len(words))
        seen, dup, dup_chars, lines, chars = set(), 0, 0, 0, 0
        for line in text.split("\n"):
            if line.strip(BLANKS):
                lines, chars = lines + 1, chars + len(line)
                if line in seen:
                    dup, dup_chars = dup + 1, dup_chars + len(line)
                seen.add(line)
        rows.append((len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), dup, dup / max(lines, 1), dup_chars / max(chars, 1), lines))
    bounds = np.array(bounds)
    windows, lengths = Windows(np.array(words, np.int64), bounds), np.array(lengths, np.int64)
    word_chars, symbols, dup, line_share, line_chars, lines = (np.array(x) for x in zip(*rows))
    total = np.maximum(windows.by_text(lengths), 1)
    starts, _ = windows.repeated(5)
    repeat = windows.by_text(windows.covered(starts, 5))
    share, over = np.zeros(len(texts)), np.zeros(len(texts), bool)
    for n, most in MOST_BY_LENGTH.items():
        starts, first = windows.repeated(n)
        found = windows.by_text(np.where(windows.covered(starts[~first], n), lengths, 0)) / total
        share, over = np.maximum(share, found), over | (found > most)
    count = np.diff(bounds)
    failed = (count < 10) | (100 * repeat > 20 * count)
    kept = ~failed & ~over & ((line_share <= MOST_LINES) | (lines < MANY_LINES)) & (line_chars <= MOST_LINE_CHARS)
    return {"n_words": count, "word_chars": word_chars, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": repeat, "dup_ngram_share": share, "dup_line_share": line_share, "dup_line_chars": line_chars, "base_failed": failed, "kept": kept}


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, texts in pieces(batches):
        yield pa.RecordBatch.from_arrays([ids, *(pa.array(v, _ARROW.field(c).type) for c, v in measured(texts).items())], schema=_ARROW)


def repetition(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """SCHEMA for every row: base counts, shares of repeated text, and the verdicts.

    A null or empty text has no words and fails. A text is taken whole; ids may be
    null or repeat. Other columns are ignored. No rows: no rows.
    """
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_rows, SCHEMA)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES = {"op9_quality_rules": op9_quality_rules}
ORACLES = {
    "op9_quality_rules": r"""
        WITH words AS (
            SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        windows AS (
            SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS key
            FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM words CROSS JOIN (VALUES (5), (6), (8), (10)) AS lengths(n))),
        ranked AS (
            SELECT doc_id, n, i, count(*) OVER (PARTITION BY doc_id, n, key) AS often, row_number() OVER (PARTITION BY doc_id, n, key ORDER BY i) AS place FROM windows),
        repeated AS (
            SELECT DISTINCT doc_id, i + unnest(range(0, 5)) AS i FROM ranked WHERE n = 5 AND often > 1),
        again AS (
            SELECT DISTINCT doc_id, n, i + unnest(range(0, n)) AS i FROM ranked WHERE place > 1),
        shares AS (
            SELECT a.doc_id, a.n, sum(length(w.w[a.i])) AS chars FROM again a JOIN words w ON a.doc_id = w.doc_id GROUP BY a.doc_id, a.n),
        lines AS (
            SELECT doc_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM words) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
        by_line AS (
            SELECT doc_id, line, count(*) AS n FROM lines GROUP BY doc_id, line),
        dup_lines AS (
            SELECT doc_id, sum(n) AS lines, sum(n - 1) AS dup, sum(n * length(line)) AS chars, sum((n - 1) * length(line)) AS dup_chars FROM by_line GROUP BY doc_id),
        base AS (
            SELECT w.doc_id, len(w.w) AS n_words, CAST(coalesce(list_sum([length(x) for x in w.w]), 0) AS BIGINT) AS word_chars,
                   length(w.text) - length(regexp_replace(w.text, '[#*$%&|<>]', '', 'g')) AS n_symbols, CAST(coalesce(d.dup, 0) AS BIGINT) AS n_dup_lines,
                   coalesce(r.n, 0) AS n_repeat_words, coalesce(d.lines, 0) AS lines, coalesce(d.dup, 0) / greatest(coalesce(d.lines, 0), 1) AS line_share,
                   coalesce(d.dup_chars, 0) / greatest(coalesce(d.chars, 0), 1) AS line_chars, coalesce(s.five, 0) AS five, coalesce(s.six, 0) AS six, coalesce(s.eight, 0) AS eight, coalesce(s.ten, 0) AS ten
            FROM words w LEFT JOIN dup_lines d ON w.doc_id = d.doc_id
            LEFT JOIN (SELECT doc_id, count(*) AS n FROM repeated GROUP BY doc_id) r ON w.doc_id = r.doc_id
            LEFT JOIN (SELECT doc_id, sum(chars) FILTER (WHERE n = 5) AS five, sum(chars) FILTER (WHERE n = 6) AS six,
                              sum(chars) FILTER (WHERE n = 8) AS eight, sum(chars) FILTER (WHERE n = 10) AS ten FROM shares GROUP BY doc_id) s ON w.doc_id = s.doc_id)
        SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
               n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
               NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR five / greatest(word_chars, 1) > CAST(0.15 AS DOUBLE) OR six / greatest(word_chars, 1) > CAST(0.14 AS DOUBLE)
                    OR eight / greatest(word_chars, 1) > CAST(0.12 AS DOUBLE) OR ten / greatest(word_chars, 1) > CAST(0.10 AS DOUBLE)
                    OR lines >= 10 AND line_share > CAST(0.30 AS DOUBLE) OR line_chars > CAST(0.20 AS DOUBLE)) AS kept
        FROM base"""
}
