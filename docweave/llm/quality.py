"""Quality rules, lines first."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

#: Phrases that mark a line as boilerplate, in lower case; others are learned from the corpus.
BOILERPLATE = (
    "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "enable javascript",
    "lorem ipsum", "click here", "sign up for", "subscribe to our", "powered by", "copyright ©",
)
#: Separators that make a line navigation from this many on.
NAVIGATION, NAVIGATION_LEAST = "|»›•·", 3
#: A line of so many words is prose and must end in closing punctuation; of so many at least, all capitalised and open, it is a row of links.
PROSE, LINKS = 8, 4
#: Open lines of at most so many words are a menu if so many follow each other.
MENU_WORDS, MENU_LINES = 4, 3
#: A line is learned as boilerplate if so many different lines stand before it (or after it) in the corpus, at least one for so many
#: documents of it, and at least a quarter of the documents that have it. So lines of copied documents, whose neighbours are copied too, aren't.
LEAST_CONTEXTS, DOCS_A_CONTEXT, CONTEXT_SHARE = 20, 20_000, 4
#: Characters that count as symbols; a line fails with as many of them as words, times 2, or more.
SYMBOLS = "#*$%&|<>"
#: A document is rejected if more than this many hundredths of its words are in removed lines.
MOST_LOST = 50
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30

RULES = ("punctuation", "navigation", "boilerplate")

_DIGITS = re.compile(r"\d+")
_WORD = re.compile(r"[^ \t-\r]+")
_SYMBOL = re.compile("[" + re.escape(SYMBOLS) + "]")
_SEPARATOR = re.compile("[" + re.escape(NAVIGATION) + "]")
_ENDS = re.compile(r"[.!?…:;,。！？)\"'»”’\]][#*$%&|<> \t-\r]*$")


def closed(line: str) -> bool:
    return bool(_ENDS.search(line))


def line_hash(line: str) -> int:
    """Of the line's words in lower case, with digits alike; signed."""
    import xxhash

    return xxhash.xxh3_64_intdigest(_DIGITS.sub("0", " ".join(_WORD.findall(line.lower()))).encode("utf-8", "surrogatepass")) - (1 << 63)


def line_fails(line: str, words: list[str], menu: bool = False, learned=frozenset()) -> str | None:
    """The rule that removes a line of words (at least one), or None.

    punctuation: symbols at least half as many as words, or no closing punctuation with fewer than 3 words or PROSE or more;
    navigation: separators, a row of links, or menu (the line is in a run of short open lines); boilerplate: a known phrase or a learned line.
    """
    n = len(words)
    separators = len(_SEPARATOR.findall(line))
    if separators >= NAVIGATION_LEAST or menu:
        return "navigation"
    if 2 * len(_SYMBOL.findall(line)) >= max(n, 2):
        return "punctuation"
    if not closed(line):
        if n >= LINKS and all(w[:1].isupper() or not w[:1].isalpha() for w in words):
            return "navigation"
        if n < 3 or n >= PROSE:
            return "punctuation"
    low = line.lower()
    return "boilerplate" if any(p in low for p in BOILERPLATE) or learned and line_hash(line) in learned else None


def in_menus(lines: list[tuple[str, list[str]]]) -> list[bool]:
    """Which of the lines (with words) are in a run of MENU_LINES or more short open ones."""
    short = [len(words) <= MENU_WORDS and not closed(line) for line, words in lines]
    out, start = [False] * len(lines), 0
    for k in range(len(lines) + 1):
        if k == len(lines) or not short[k]:
            if k - start >= MENU_LINES:
                out[start:k] = [True] * (k - start)
            start = k + 1
    return out


def repeated_words(words: list[str]) -> int:
    """Words in WINDOW-word windows that occur twice or more in words, the first occurrence included."""
    windows = list(zip(*(words[k:] for k in range(WINDOW)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    counts, covered, upto = Counter(windows), 0, 0
    for at, w in enumerate(windows):
        if counts[w] > 1:
            covered += at + WINDOW - max(at, upto)
            upto = at + WINDOW
    return covered


def assess(text: str, learned=frozenset()) -> dict:
    words: list[str] = []
    seen: set[str] = set()
    dup = lost = 0
    by_rule: Counter = Counter()
    kept_lines = []
    lines = [(line, _WORD.findall(line)) for line in text.split("\n")]
    menus = iter(in_menus([x for x in lines if x[1]]))
    for line, found in lines:
        if not found:
            kept_lines.append(line)
            continue
        words += found
        dup += line in seen
        seen.add(line)
        if rule := line_fails(line, found, next(menus), learned):
            lost += len(found)
            by_rule[rule] += 1
        else:
            kept_lines.append(line)
    again = repeated_words(words)
    failed = len(words) < LEAST_WORDS or 100 * again > MOST_REPEATED * len(words)
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(_SYMBOL.findall(text)), "n_dup_lines": dup, "n_repeat_words": again,
        "base_failed": failed, "n_removed_lines": by_rule.total(), "n_lost_words": lost, **{f"n_{r}_lines": by_rule[r] for r in RULES}, "kept": not failed and 100 * lost <= MOST_LOST * len(words), "cleaned": "\n".join(kept_lines),
    }


def boilerplate_lines(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(line): hashes of the lines that the corpus itself shows to be boilerplate, by LEAST_CONTEXTS and the rest.

    Each text gives its distinct (line, line before) and (line, line after) once, as hashes. All documents count; no line is gathered
    anywhere: pairs are counted first, then the pairs of a line. There are at most DOCS_A_CONTEXT times as many such lines as a document
    has lines on average, which bounds the table at any size of the corpus.
    """

    def make():
        def compute(texts):
            out = {"at": [], "side": [], "beside": []}
            for t in texts:
                marks = [line_hash(line) for line in (t or "").split("\n") if _WORD.search(line)]
                pairs = {(a, 0, b) for a, b in zip(marks, [0, *marks], strict=False)} | {(a, 1, b) for a, b in zip(marks, [*marks[1:], 0], strict=False)}
                for k, name in enumerate(out):
                    out[name].append([p[k] for p in pairs])
            return out

        return compute

    fields = {"at": "array<bigint>", "side": "array<int>", "beside": "array<bigint>"}
    rows = map_texts(docs.select(F.lit(0).alias("_one"), F.col(text_col).alias("_text")), "_one", "_text", fields, make)
    pairs = rows.select(F.inline(F.arrays_zip("at", "side", "beside"))).groupBy("at", "side", "beside").agg(F.count("*").alias("n"))
    lines = pairs.groupBy("at", "side").agg(F.count("*").alias("contexts"), F.sum("n").alias("n"))
    least = max(LEAST_CONTEXTS, docs.count() // DOCS_A_CONTEXT)
    return lines.where((F.col("contexts") >= least) & (F.col("contexts") * CONTEXT_SHARE >= F.col("n"))).select(F.col("at").alias("line")).distinct()


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", learned: DataFrame | None = None) -> DataFrame:
    """Returns id_col, the counts of the whole text, base_failed, n_removed_lines, n_lost_words, lines by rule, kept and the cleaned text.

    Each line with a word is judged by the rules of line_fails and removed if one holds; a document goes if the base
    rules fail or if over MOST_LOST percent of its words were in removed lines. learned: boilerplate_lines() of the corpus (of docs, if not given).
    Null and empty texts have no words, so they fail the base rules; their cleaned text is empty. Each repeated row gets a row; other columns aren't read.
    """
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    fields = dict.fromkeys(counts, "bigint") | {"base_failed": "boolean", "n_removed_lines": "bigint", "n_lost_words": "bigint"}
    fields |= {f"n_{r}_lines": "bigint" for r in RULES} | {"kept": "boolean", "cleaned": "string"}
    rows = (boilerplate_lines(docs, text_col) if learned is None else learned).select("line").collect()  # bounded, see there
    sent = docs.sparkSession.sparkContext.broadcast(frozenset(r["line"] for r in rows))

    def make():
        known = sent.value

        def compute(texts):
            found = [assess(t or "", known) for t in texts]
            return {name: [x[name] for x in found] for name in fields}

        return compute

    return map_texts(docs, id_col, text_col, fields, make)


def quality_report(docs: DataFrame) -> DataFrame:
    """All of clean() but the text itself, of which the digest stays."""
    return clean(docs).withColumn("cleaned_sha256", F.sha2("cleaned", 256)).drop("cleaned")
