"""Line-first quality rules.

Every line is judged by itself: punctuation, navigation, boilerplate and repetition rules. Lines that fail go, and a
document that loses more than `most_lost` of its word characters is rejected, as is one that fails the base rules.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import read_table, slices

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BLANK = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

# Starts of lines that are boilerplate of a page or of a licence.
BOILERPLATE = (
    "all rights reserved",
    "licensed under",
    "released under",
    "this work is licensed",
    "copyright",
    "cookie",
    "privacy policy",
    "terms of use",
    "click here",
    "share this",
    "subscribe to",
    "sign in",
)

# How a line ends that breaks off.
BREAKS = (",", "...", "…", "-", "–", "(", "[", "{", "/", "&", "+", "=")


@dataclass(frozen=True)
class LineRules:
    """symbols, bangs, separators: most of each for a word; upper: most upper-case letters of a line's letters;
    same_word: most of a line's words that only repeat the word before (lines of `long_line` words or more; such lines must
    not break off either); most_lost: share."""

    symbols: float = 0.3
    bangs: float = 0.5
    separators: float = 0.2
    upper: float = 0.7
    same_word: float = 0.3
    long_line: int = 6
    min_words: int = 10
    repeat_share: float = 0.2
    most_lost: float = 0.5


def line_fails(line: str, words: list[str], rules: LineRules) -> str:
    """The name of the rule that the line fails, or ''."""
    n = len(words)
    if sum(map(line.count, SYMBOLS)) > rules.symbols * n and line.count("|") <= rules.separators * n:
        return "symbols"
    if line.count("|") > rules.separators * n or line.count(" > ") + line.count("»") > rules.separators * n:
        return "navigation"
    if line.count("!") > rules.bangs * n and n >= 3:
        return "punctuation"
    if n >= rules.long_line and line.rstrip(BLANK).endswith(BREAKS):
        return "breaks off"
    if n >= 4:
        letters = len(line) - line.count(" ")
        if sum(map(str.isupper, line)) > rules.upper * letters:
            return "upper"
    if n >= rules.long_line and sum(map(eq, words, words[1:])) > rules.same_word * n:
        return "same word"
    if line.lstrip(BLANK).lower().startswith(BOILERPLATE) and n <= 40:
        return "boilerplate"
    return ""


def repeated_words(words: list[str], width: int = 5) -> int:
    """Words that lie in a window of `width` words found twice or more in the text."""
    if len(words) <= width:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    with np.errstate(over="ignore"):
        g = np.zeros(len(words) - width + 1, np.uint64)
        for k in range(width):
            g = g * np.uint64(0x9E3779B97F4A7C15) + (h[k : len(words) - width + 1 + k] ^ (h[k : len(words) - width + 1 + k] >> np.uint64(29)))
    order = np.argsort(g, kind="stable")
    same = np.empty(len(g), bool)
    s = g[order]
    eq = s[1:] == s[:-1]
    same[:] = False
    same[order[1:][eq]] = True
    same[order[:-1][eq]] = True
    if not same.any():
        return 0
    edge = np.zeros(len(words) + 1, np.int32)
    np.add.at(edge, np.flatnonzero(same), 1)
    np.add.at(edge, np.flatnonzero(same) + width, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def judge(text: str | None, rules: LineRules) -> dict:
    text = text or ""
    words = WORD.findall(text)
    n, word_chars = len(words), sum(map(len, words))
    dup = lost = 0
    seen: set[str] = set()
    good: list[str] = []
    for line in text.split("\n"):
        own = WORD.findall(line)
        if not own:
            continue
        again = line in seen
        dup += again
        seen.add(line)
        if again or line_fails(line, own, rules):
            lost += sum(map(len, own))
        else:
            good.append(line)
    repeats = repeated_words(words)
    base = n < rules.min_words or 100 * repeats > 100 * rules.repeat_share * n
    return {
        "n_words": n,
        "word_chars": word_chars,
        "n_symbols": sum(map(text.count, SYMBOLS)),
        "n_dup_lines": dup,
        "n_repeat_words": repeats,
        "base_failed": base,
        "lost_chars": lost,
        "kept": not base and lost <= rules.most_lost * word_chars,
        "clean_text": "\n".join(good),
    }


FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, lost_chars long, kept boolean"


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: LineRules | None = None, with_text: bool = False) -> DataFrame:
    """Per row: id, base figures, base_failed, lost_chars, kept, and with_text the lines that stay.

    Null and empty texts have no words and fail the base rules. Repeated rows are judged alike. Other columns are ignored.
    """
    rules = rules or LineRules()
    kind = dict(docs.dtypes)[id_col]

    def run(batches):
        for b in slices(batches, "text"):
            rows = [judge(t, rules) for t in b.column(1).to_pylist()]
            names = [f.split()[0] for f in FIELDS.split(", ")] + ["clean_text"] * with_text
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[k] for r in rows], pa.bool_() if k in ("base_failed", "kept") else pa.string() if k == "clean_text" else pa.int64()) for k in names)], ["id", *names])

    out = docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text").mapInArrow(run, f"id {kind}, {FIELDS}" + ", clean_text string" * with_text)
    return out.withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, text_col: str = "text", rules: LineRules | None = None) -> DataFrame:
    """The rows of docs whose verdict is kept, with all their columns; lines that fail are cut from the text.

    Texts without such a line are unchanged. Other columns that tell of the text, such as its length, are not adjusted.
    """
    rules = rules or LineRules()

    def run(batches):
        for b in slices(batches, text_col):
            k = b.schema.get_field_index(text_col)
            texts = b.column(k).to_pylist()
            told = [judge(t, rules) for t in texts]
            clean = pa.array([r["clean_text"] if r["lost_chars"] else t for t, r in zip(texts, told, strict=True)], b.schema.field(k).type)
            yield b.set_column(k, b.schema.field(k), clean).filter(pa.array([r["kept"] for r in told], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_rules(read_table(spark, sf_dir, "documents"))


def _sql(rules: LineRules) -> str:
    """The same verdicts in DuckDB's SQL."""
    count = lambda c: f"(length(line) - length(replace(line, '{c}', '')))"
    starts = " OR ".join(f"starts_with(lower(ltrim(line, chr(32) || chr(9) || chr(11) || chr(12) || chr(13))), '{b}')" for b in BOILERPLATE)
    bare = "rtrim(line, chr(32) || chr(9) || chr(11) || chr(12) || chr(13))"
    breaks = " OR ".join(f"ends_with({bare}, '{b}')" for b in BREAKS)
    symbols = "length(regexp_replace({0}, '[^#*$%&|<>]', '', 'g'))"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
words AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
grams AS (SELECT doc_id, i, ws[i:i + 4] AS g FROM words, unnest(range(1, len(ws) - 3)) AS r(i)),
twice AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) > 1 AS again FROM grams),
repeated AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM twice, unnest(range(0, 5)) AS r(j) WHERE again GROUP BY 1),
split AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS k FROM d),
lines AS (SELECT *, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS ws FROM split),
told AS (SELECT doc_id, line, len(ws) AS n, length(array_to_string(ws, '')) AS chars, row_number() OVER (PARTITION BY doc_id, line ORDER BY k) > 1 AS again,
  {symbols.format("line")} AS sym, {count("|")} AS pipes, {count("!")} AS bangs, {count(" > ")} / 3 + {count("»")} AS arrows,
  length(regexp_replace(line, '[^\p{{Lu}}]', '', 'g')) AS upper, length(line) - {count(" ")} AS letters,
  coalesce(list_sum(list_transform(range(1, len(ws)), lambda i: CAST(ws[i] = ws[i + 1] AS INTEGER))), 0) AS same,
  {starts} AS boiler, {breaks} AS breaks FROM lines WHERE len(ws) > 0),
judged AS (SELECT doc_id, chars, again, again OR (sym > {rules.symbols} * n AND pipes <= {rules.separators} * n) OR pipes > {rules.separators} * n OR arrows > {rules.separators} * n
  OR (bangs > {rules.bangs} * n AND n >= 3) OR (n >= 4 AND upper > {rules.upper} * letters) OR (n >= {rules.long_line} AND (breaks OR same > {rules.same_word} * n)) OR (boiler AND n <= 40) AS fails FROM told),
lost AS (SELECT doc_id, count(*) FILTER (WHERE again) AS n_dup_lines, coalesce(sum(chars) FILTER (WHERE fails), 0) AS lost_chars FROM judged GROUP BY 1),
base AS (SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, {symbols.format("t")} AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(lost_chars, 0) AS lost_chars
  FROM words LEFT JOIN repeated USING (doc_id) LEFT JOIN lost USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  n_words < {rules.min_words} OR 100 * n_repeat_words > {100 * rules.repeat_share} * n_words AS base_failed, CAST(lost_chars AS BIGINT) AS lost_chars,
  NOT (n_words < {rules.min_words} OR 100 * n_repeat_words > {100 * rules.repeat_share} * n_words) AND lost_chars <= {rules.most_lost} * word_chars AS kept FROM base
"""


SQL = _sql(LineRules())
