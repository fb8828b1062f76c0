r"""Quality rules, line first (operator 2).

Every line is judged by itself with three rules; failing lines are removed, and a
document that loses too much of its text is rejected:

* punctuation: symbols or repeated marks make up much of the line, or a long line
  has no sentence mark at all and neither has its paragraph (``wrapped``: the adjacent lines that a hard wrap has cut
  from one another, told from the document's own line widths); scripts that write no such marks (Thai, Lao) are exempt;
* navigation: the line is a row of menu entries (separators between words), or a
  known menu word alone;
* boilerplate: stock phrases are a large share of the words of the line (of the wrapped sentence, where
  the line is a piece of one), or the line repeats an earlier line of the same document.

Before that a document-wide base is measured on the words ``[^\x20\x09-\x0D]+``
(see ``COLUMNS``); a document that fails the base is rejected whatever its lines.

Defined cases: a null text counts as empty (no words, base fails); a null id stays a
row of its own; repeated rows each get their own result; an empty table gives an
empty result; other columns of the input are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache, cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ledgerflow.llm.common import documents, prepare, whole_row

COLUMNS = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
           "base_failed boolean, kept boolean, n_lines long, n_punctuation long, n_navigation long, "
           "n_boilerplate long, lost_share double, clean_text string")

# Symbols of the base rule, and the word windows of the repetition rule.
SYMBOLS = "#*$%&|<>"
WINDOW = 5


@dataclass(frozen=True)
class Rules:
    """Thresholds; the stock phrases are plain lists a user may replace."""

    min_words: int = 10
    max_repeat_percent: int = 20
    max_mark_share: float = 0.10      # symbols and repeated marks, per character that is not white space
    unpunctuated_words: int = 12      # a line of so many words needs a sentence mark in its paragraph
    min_separators: int = 2
    min_separator_share: float = 0.15  # separators per word of the line
    min_phrase_share: float = 0.30    # words of stock phrases per word of the line
    max_lost_share: float = 0.30      # of the document's word characters
    menu_words: tuple[str, ...] = ("home", "menu", "search", "login", "log in", "sign in", "sign up", "register",
                                   "next", "previous", "back to top", "contact", "about", "sitemap", "skip to content")
    stock_phrases: tuple[str, ...] = ("all rights reserved", "cookie policy", "we use cookies", "privacy policy",
                                      "terms of use", "terms of service", "lorem ipsum", "enable javascript",
                                      "click here", "read more", "subscribe to our newsletter", "powered by")


_MARKS = re.compile(r"[#*$%&|<>~^=_{}\\]|([!?])\1+|\.{4,}|-{3,}")
_SENTENCE = re.compile(r"[.!?,;:…。！？，،؟।॥۔؛、；：．｡։።፣។၊။།]")
_UNMARKED_SCRIPT = re.compile(r"[\u0E00-\u0EFF]")
_SEPARATORS = frozenset("| > >> » › • · / →".split())


@dataclass
class Wrapping:
    """Per line the number of its paragraph and of its sentence, as far as a hard wrap has cut them into lines."""

    paragraph: list[int]
    sentence: list[int]
    lines: list[str]

    @cached_property
    def marked(self) -> set[int]:
        """The paragraphs with a sentence mark."""
        return {p for p, line in zip(self.paragraph, self.lines) if _SENTENCE.search(line)}

    @cached_property
    def _pieces(self) -> dict[int, list[str]]:
        out: dict[int, list[str]] = {}
        for s, line in zip(self.sentence, self.lines):
            out.setdefault(s, []).append(line)
        return out

    def whole(self, at: int) -> str:
        """The line with those before and behind it that belong to its sentence."""
        return " ".join(self._pieces[self.sentence[at]])


def wrapped(lines: list[str]) -> Wrapping:
    """Which adjacent lines a hard wrap has cut from one another.

    A wrap to some width leaves a line only when the next one's first word does not fit any more, so two lines tell
    of widths from the longer one's up to where that word would have fitted. The document's width is the one that most pairs of
    lines tell of, at least two (the smallest of several). A pair is one paragraph if it tells of the document's width; or, whatever the
    width, if no mark ends the upper line and the lower one begins with a small letter. Pairs of the second kind are
    one sentence. A blank line, or a lower line that no wrap could have left, parts them.
    """
    words = [line.split() for line in lines]
    widths = [len(line.rstrip()) for line in lines]
    pairs: dict[int, tuple[int, int]] = {}
    for i in range(len(lines) - 1):
        if words[i] and words[i + 1]:
            low, high = max(widths[i], widths[i + 1]), widths[i] + 1 + len(words[i + 1][0])
            if low < high:
                pairs[i] = (low, high)
    # The number of pairs that tell of a width grows at their lows only.
    lows, highs = sorted(a for a, _ in pairs.values()), sorted(b for _, b in pairs.values())
    told = {a: bisect_right(lows, a) - bisect_right(highs, a) for a in set(lows)}
    width = min((a for a in told if told[a] == max(told.values())), default=-1)
    if told.get(width, 0) < 2:
        width = -1
    paragraph, sentence = [0] * len(lines), [0] * len(lines)
    for i in range(1, len(lines)):
        pair = pairs.get(i - 1)
        goes_on = pair is not None and not _SENTENCE.match(words[i - 1][-1][-1]) and words[i][0][0].islower()
        one = goes_on or pair is not None and pair[0] <= width < pair[1]
        paragraph[i] = paragraph[i - 1] + (not one)
        sentence[i] = sentence[i - 1] + (not goes_on)
    return Wrapping(paragraph, sentence, lines)


def needs_marks(words: list[str], rules: Rules) -> bool:
    """Whether a line is long enough for a sentence mark, and in a script that writes them."""
    if len(words) < rules.unpunctuated_words:
        return False
    unmarked = sum(len(_UNMARKED_SCRIPT.findall(w)) for w in words)
    return 2 * unmarked < sum(map(len, words))


def line_failure(line: str, words: list[str], earlier: bool, rules: Rules, phrases: re.Pattern,
                 marked: Callable[[], bool] = lambda: False, sentence: Callable[[], str] | None = None) -> str | None:
    """The first rule that the line breaks, or None. ``words`` are the line's words, at least one; ``marked`` tells
    whether the other lines of its paragraph have a sentence mark, ``sentence`` gives the line with its wrapped
    neighbours."""
    separators = sum(w in _SEPARATORS for w in words)
    if separators >= rules.min_separators and separators >= rules.min_separator_share * len(words):
        return "navigation"
    if len(words) <= 4 and " ".join(words).strip(".:!").lower() in rules.menu_words:
        return "navigation"
    marks = sum(m.end() - m.start() for m in _MARKS.finditer(line))
    if marks >= 2 and marks > rules.max_mark_share * sum(map(len, words)):
        return "punctuation"
    if not _SENTENCE.search(line) and needs_marks(words, rules) and not marked():
        return "punctuation"
    if earlier or phrases.search(line) and min(
            phrase_share(line, phrases), phrase_share(sentence() if sentence else line, phrases)) >= rules.min_phrase_share:
        return "boilerplate"
    return None


def phrase_pattern(rules: Rules) -> re.Pattern:
    """The stock phrases as whole words."""
    return re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, rules.stock_phrases)) + r")(?!\w)" if rules.stock_phrases else r"(?!)",
                      re.I)


def phrase_share(text: str, phrases: re.Pattern) -> float:
    """Words of stock phrases per word; 1 for a text without words."""
    words = len(text.split())
    return sum(len(m.group().split()) for m in phrases.finditer(text)) / words if words else 1.0


def repeated_words(words: list[bytes]) -> int:
    """Words covered by a 5-word window that occurs at least twice."""
    if len(words) <= WINDOW:
        return 0
    windows = list(zip(*(words[i:] for i in range(WINDOW))))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    covered = end = 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered += i + WINDOW - max(end, i)
            end = i + WINDOW
    return covered


_SPACE = re.compile(r"[\x20\x09-\x0D]+")


def judge(text: str | None, rules: Rules, phrases: re.Pattern) -> tuple:
    """The result columns of one text, without its id."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    word_chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    symbols = sum(map(text.count, SYMBOLS))
    repeats = repeated_words(words)
    base_failed = len(words) < rules.min_words or 100 * repeats > rules.max_repeat_percent * len(words)
    seen: set[str] = set()
    dup = lost = n_lines = 0
    failed = {"punctuation": 0, "navigation": 0, "boilerplate": 0}
    kept_lines = []
    lines = text.split("\n")
    wrapping = cache(lambda: wrapped(lines))  # few texts ask for it
    for i, line in enumerate(lines):
        own = [w for w in _SPACE.split(line) if w]
        if not own:
            kept_lines.append(line)
            continue
        n_lines += 1
        earlier = line in seen
        dup += earlier
        seen.add(line)
        rule = line_failure(line, own, earlier, rules, phrases, lambda: wrapping().paragraph[i] in wrapping().marked,
                            lambda: wrapping().whole(i))
        if rule is None:
            kept_lines.append(line)
        else:
            failed[rule] += 1
            lost += sum(map(len, own))
    share = lost / word_chars if word_chars else 0.0
    kept = not base_failed and share <= rules.max_lost_share
    return (len(words), word_chars, symbols, dup, repeats, base_failed, kept, n_lines, failed["punctuation"],
            failed["navigation"], failed["boilerplate"], share, "\n".join(kept_lines))


def clean_lines(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with the base, the verdict and the text left after line removal (``COLUMNS``).

    A narrow step: every document is judged in the task that reads it, nothing is shuffled.
    """
    prepare(docs.sparkSession)
    names = [c.split()[0] for c in COLUMNS.split(", ")][1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = phrase_pattern(rules)
        for batch in batches:
            out = [judge(t, rules, phrases) for t in batch.column("text").to_pylist()]
            cols = list(zip(*out)) if out else [[] for _ in names]
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()] * 4 + [pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["doc_id", *names])

    return documents(docs, id_col, text_col).mapInArrow(run, COLUMNS)


def keep_good(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The documents that pass, with failing lines removed from their text; all columns of ``docs`` stay.

    The rows carry their columns through the judging step as one struct, so that no
    join is needed and no column name can clash with a result's.
    """
    prepare(docs.sparkSession)
    packed = docs.select(whole_row(docs).alias("row"), F.col("text").alias("text"))
    schema = StructType([packed.schema["row"], StructField("clean_text", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = phrase_pattern(rules)
        for batch in batches:
            out = [judge(t, rules, phrases) for t in batch.column("text").to_pylist()]
            good = pa.array([o[6] for o in out], pa.bool_())
            texts = pa.array([o[12] for o in out], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("row"), texts], ["row", "clean_text"]).filter(good)

    out = packed.mapInArrow(run, schema)
    return with_text(out, docs.columns, F.col("clean_text"))


def with_text(packed: DataFrame, columns: list[str], text) -> DataFrame:
    """Unpack ``row`` with a new text, and its character count where the table carries one."""
    fresh = {"text": text, "n_chars": F.length(text).cast("long")}
    return packed.select(*(fresh.get(c, F.col("row").getField(c)).alias(c) for c in columns))
