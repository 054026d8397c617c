"""Quality rules, line first.

Each line is judged: lines that are navigation, boilerplate or mostly links, and lines made of symbols, capitals or
exclamations go, as do runs of short lines that end in no mark of punctuation (menus), and lines that the document has already
had twice; what is left is the cleaned text.  A document that loses too much of its text this way is rejected, as is one that fails the base rules (too few
words, or too many of them in repeated three-word windows).  Documents are independent, so the work is one pass of Arrow
batches without a shuffle.

Edge cases: a null or empty text has no words and fails; a text of one line loses all or nothing; lines are told apart
exactly, and lines without a word never count as repeats; repeated rows are each judged alike.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MIN_WORDS = 50
#: Percent of words in repeated windows, and of characters lost with failed lines, above which a document goes.
MAX_REPEATED = 50
MAX_LOST = 60
#: Percent of a line's words that carry symbols, and of its letters that are capitals, above which the line goes.
MAX_SYMBOLS = 50
MAX_CAPITALS = 50
#: Percent of a line's characters that are letters or digits, below which the line goes; low, as code is half marks.
MIN_LETTERS = 30
SYMBOLS = re.compile(r"[#*$%&|<>]")
#: Figures with their sign (12.5%, $40) are no symbol words, nor is a line in bold made of them.
_FIGURE = re.compile(rb"[$#&<>]?[-+]?\d[\d.,:/]*%?[.,;:)]*")
_BOLD = re.compile(r"\s*\*{1,3}[^*\s](?:[^*]*[^*\s])?\*{1,3}[.:]?\s*")
#: Marks of navigation between items, and the least number of them in a line of navigation, whatever its length.
_BAR = re.compile(r"\s[|»›·•]\s|\s>\s")
MIN_BARS = 3
#: How a sentence ends; a line of a few short items that does not end so is navigation with fewer marks, too.
_ENDED = re.compile(r"""[.!?…:;。！？][)"'»”’\]]*\s*$""")
#: Words of a line of a menu, and how many such lines in a row make one.
MENU_WORDS, MENU_LINES = 3, 4
#: Bytes above which a word is none of a menu (lines of keys have such).
LONG_WORD = 30
#: Percent of a line's words that are links, or exclamations, above which it goes.
MAX_LINKS = 50
#: A line of at least so many words goes from its third time on.
REPEATED_WORDS = 4
_LINK = (b"http://", b"https://", b"www.", b"mailto:")
#: The armour of keys stays, so that the secret scan finds a key whole.
_ARMOUR = re.compile(r"-----(?:BEGIN|END) ")
#: Boilerplate that stands alone on a short line.
_BOILER = re.compile(r"(?i)^\W*(?:home|menu|search|share this|read more|click here|sign in|log in|subscribe|cookie policy|privacy policy|terms of (?:use|service)|all rights reserved|copyright|©|javascript|lorem ipsum)\b.{0,80}$")
COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, lost_chars long, kept boolean, clean_text string"


def repeated_words(words: list) -> int:
    """Words that stand in a three-word window found at least twice, the first included."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    if len(seen) == n:
        return 0
    pairs = ids[:-1] * len(seen) + ids[1:]
    if len(seen) > 1 << 21:  # three ids no longer fit one integer
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * len(seen) + ids[2:]
    order = np.sort(windows)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    hit = np.isin(windows, twice)
    cover = np.zeros(n, bool)
    for k in range(3):
        cover[k : n - 2 + k] |= hit
    return int(cover.sum())


@lru_cache(1 << 16)
def _kind(c: str) -> int:
    """3 for a capital, 2 for another letter or the mark on one, 1 for a digit, 0 for what is neither."""
    kind = unicodedata.category(c)
    return 3 if kind in ("Lu", "Lt") else 2 if kind[0] in "LM" else 1 if kind[0] == "N" else 0


def shares(line: str) -> tuple[int, int, int, int]:
    """Capitals, letters, letters and digits, and characters that are not white space."""
    found = [0, 0, 0, 0]
    chars = 0
    for c, n in Counter(line).items():
        if not c.isspace():
            chars += n
            found[_kind(c)] += n
    return found[3], found[3] + found[2], found[3] + found[2] + found[1], chars


def line_fails(line: str, words: list[bytes]) -> bool:
    """Navigation, boilerplate, or a line that is mostly symbols or capitals."""
    n = len(words)
    if not n or _ARMOUR.search(line):
        return False
    if n <= 14 and _BOILER.search(line):
        return True
    bars = len(_BAR.findall(line))
    if bars >= MIN_BARS and 2 * bars + 1 >= n * 0.6:
        return True
    # Items of up to two and a half words on average, or of one where a single mark stands between two.
    if bars and n - bars <= (2.5 if bars > 1 else 1) * (bars + 1) and not _ENDED.search(line):
        return True
    capitals, letters, alnum, chars = shares(line)
    if chars >= 4 and not alnum or chars >= 8 and 100 * alnum < MIN_LETTERS * chars:
        return True
    if SYMBOLS.search(line) and not _BOLD.fullmatch(line):
        last, anywhere = (sum(1 for w in words if test(w) and not _FIGURE.fullmatch(w)) for test in (lambda w: w[-1:] in b"#*$%&|<>", lambda w: SYMBOLS.search(w.decode())))
        if 100 * (anywhere if n >= 3 else last) > MAX_SYMBOLS * n:
            return True
    if n >= 2 and 100 * sum(1 for w in words if w.lower().startswith(_LINK)) > MAX_LINKS * n:
        return True
    if n >= 4 and 100 * sum(1 for w in words if w[-1:] == b"!") > MAX_LINKS * n:
        return True
    return 100 * capitals > MAX_CAPITALS * letters and (n >= 8 or n >= 3 and line.rstrip().endswith("!"))


def in_menus(short: list[bool | None]) -> list[bool]:
    """Which lines stand in a run of short ones; None is a line without a word, which neither counts nor ends a run."""
    out, run = [False] * len(short), []
    for i, is_short in enumerate([*short, False]):
        if is_short:
            run.append(i)
        elif is_short is not None:
            if len(run) >= MENU_LINES:
                for k in run:
                    out[k] = True
            run = []
    return out


def is_short(line: str, words: list[bytes]) -> bool | None:
    """A line of few words that ends in no mark of punctuation; None for one without a word."""
    return None if not words else len(words) <= MENU_WORDS and max(map(len, words)) <= LONG_WORD and not _ENDED.search(line) and not _ARMOUR.search(line) and line[-1:] not in ",{}()[]"


def judge(text: str | None) -> tuple:
    text = text or ""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    chars = len(text) - sum(text.count(c) for c in " \t\n\x0b\f\r")
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    lines = text.split("\n")
    seen: Counter[str] = Counter()
    repeats, lost, clean = 0, 0, []
    split = [words] if len(lines) == 1 else [line.encode().split() for line in lines]
    menu = in_menus([is_short(line, own) for line, own in zip(lines, split)]) if len(lines) >= MENU_LINES else [False] * len(lines)
    for line, own, listed in zip(lines, split, menu):
        if own:
            repeats += line in seen
            seen[line] += 1
            if listed or seen[line] > 2 and len(own) >= REPEATED_WORDS and not _ARMOUR.search(line) or line_fails(line, own):
                lost += len(line)
                continue
        clean.append(line)
    repeated = repeated_words(words)
    failed = n < MIN_WORDS or 100 * repeated > MAX_REPEATED * n
    kept = not failed and 100 * lost <= MAX_LOST * max(1, len(text))
    return n, chars, symbols, repeats, repeated, failed, lost, kept, "\n".join(clean) if lost else text


def judge_documents(docs: DataFrame, text: str = "text", keep: list[str] | None = None, clean: bool = True) -> DataFrame:
    """The columns ``keep`` (all but clashing ones by default) with the statistics, verdict and cleaned text of each row."""
    from pyspark.sql import types as T

    added = T.StructType.fromDDL(COLUMNS) if not isinstance(COLUMNS, T.StructType) else COLUMNS
    added = T.StructType([f for f in added.fields if clean or f.name != "clean_text"])
    names = {f.name for f in added.fields}
    keep = [c for c in (docs.columns if keep is None else keep) if c not in names]
    source = docs.select(*keep, docs[text].alias("__text"))
    schema = T.StructType([source.schema[c] for c in keep] + added.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(at, 256) for at in range(0, max(1, whole.num_rows), 256)):
                rows = [judge(t) for t in batch.column("__text").to_pylist()]
                kinds = [pa.int64()] * 5 + [pa.bool_(), pa.int64(), pa.bool_(), pa.string()]
                made = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds[: len(added.fields)])]
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + made, names=keep + [f.name for f in added.fields])

    return source.mapInArrow(run, schema)
