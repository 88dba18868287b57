"""URL filters: all glob rules at once in a bit-parallel automaton."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts


@dataclass(frozen=True)
class Rule:
    """verdict for hosts that are host or below it (host may hold globs) with paths that begin with path."""

    host: str
    path: str
    verdict: str
    name: str | None = None

    @property
    def label(self) -> str:
        return self.name or f"{self.host}{self.path}"

    def globs(self) -> list[str]:
        """Over host + path: * stands for any run without a slash, ** for any run."""
        return [f"{self.host}{self.path}**", f"*.{self.host}{self.path}**"]


RULES = (
    Rule("com", "/", "allow"),
    Rule("example.com", "/en/", "block"),
    Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"),
    Rule("net", "/fr/", "block"),
)
#: Globs for urls that no rule above fits: (glob over host + path, verdict); else DEFAULT.
EXTRA = (("*spam*/**", "block"), ("*pills*/**", "block"), ("*casino*/**", "block"), ("**/login/**", "block"))
DEFAULT = "allow"


class Automaton:
    """Shift-And over several words of 64 bits: bit j of a pattern is set when its first j literals are matched.

    A star keeps its bit: under * for any character but a slash, under ** for all. All patterns advance with two
    shifts and masks for each character of a url, and all urls of a batch advance together.
    """

    def __init__(self, globs: list[str]):
        bits: list[tuple[str | None, str]] = []  # of each bit: the literal that sets it, and the star that keeps it
        self.starts, self.ends = [], []
        for glob in globs:
            at, first = 0, True
            self.starts.append(len(bits))
            literal: str | None = None
            while first or at < len(glob):
                if not first:
                    literal, at = glob[at], at + 1
                star = "**" if glob.startswith("**", at) else "*" if glob.startswith("*", at) else ""
                at += len(star)
                while glob.startswith("*", at):
                    star, at = "**", at + 1
                bits.append((literal, star))
                first = False
            self.ends.append(len(bits) - 1)
        self.words = words = max(1, -(-len(bits) // 64))
        chars = sorted({c for c, _ in bits if c} | {"/"})
        self.alphabet = np.array([ord(c) for c in chars], np.uint32)
        self.sets = np.zeros((len(chars) + 1, words), np.uint64)  # the last row: characters of no pattern
        self.keeps = np.zeros((len(chars) + 1, words), np.uint64)
        self.begin = np.zeros(words, np.uint64)
        for j, (literal, star) in enumerate(bits):
            mask = np.uint64(1 << (j % 64))
            if literal:
                self.sets[chars.index(literal), j // 64] |= mask
            if star:
                rows = [k for k in range(len(chars) + 1) if star == "**" or k == len(chars) or chars[k] != "/"]
                self.keeps[rows, j // 64] |= mask
        for j in self.starts:
            self.begin[j // 64] |= np.uint64(1 << (j % 64))

    def codes(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        at = np.searchsorted(self.alphabet, points).clip(max=len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == points, at, len(self.alphabet))

    def match(self, texts: list[str]) -> np.ndarray:
        """Booleans (texts, patterns): which patterns fit each whole text."""
        codes = [self.codes(t) for t in texts]
        lengths = np.array([len(c) for c in codes], np.int64)
        order = np.argsort(-lengths, kind="stable")
        flat = np.concatenate([codes[i] for i in order]) if len(order) else np.zeros(0, np.int64)
        begins = np.concatenate([[0], np.cumsum(lengths[order])])[:-1] if len(order) else np.zeros(0, np.int64)
        state = np.tile(self.begin, (len(texts), 1))
        one, top = np.uint64(1), np.uint64(63)
        fixed = np.zeros(len(texts), bool)  # states that no further character changes
        settled = np.bitwise_and.reduce(self.keeps, axis=0)
        final = np.zeros(self.words, np.uint64)
        for j in self.ends:
            final[j // 64] |= np.uint64(1 << (j % 64))
        settled &= final
        live = np.arange(len(texts))
        step = 0
        while len(live):
            live = live[lengths[order[live]] > step]
            live = live[~fixed[live]]
            if not len(live):
                break
            c = flat[begins[live] + step]
            now = state[live]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            now = (moved & self.sets[c]) | (now & self.keeps[c])
            state[live] = now
            fixed[live] = ~(now & ~settled).any(axis=1)
            step += 1
        out = np.zeros((len(texts), len(self.ends)), bool)
        for k, j in enumerate(self.ends):
            out[order, k] = (state[:, j // 64] >> np.uint64(j % 64)) & one > 0
        return out


def canonical(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without "://"."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    for mark in "?#":
        rest = rest.split(mark, 1)[0]
    host, slash, path = rest.partition("/")
    return host.translate(_LOWER), slash + path


_LOWER = {c: c + 32 for c in range(65, 91)}


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, extra=EXTRA, default: str = DEFAULT, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Returns (id_col, host, path, rule, verdict) for each row of pages.

    Among the rules that fit, the longest (host and path together; ties: the first given) decides. Without one, rule is null
    and the first glob of extra that fits decides, else default. Null urls and urls without "://" have empty host
    and path, fit no rule, and get default. Repeated rows each get a row; other columns aren't read.
    """
    globs = [(g, k) for k, r in enumerate(rules) for g in r.globs()] + [(g, len(rules) + k) for k, (g, _) in enumerate(extra)]
    order = sorted(range(len(rules)), key=lambda k: (-len(rules[k].host) - len(rules[k].path), k)) + list(range(len(rules), len(rules) + len(extra)))
    labels = [r.label for r in rules] + [None] * len(extra)
    verdicts = [r.verdict for r in rules] + [v for _, v in extra]

    def make():
        automaton = Automaton([g for g, _ in globs])
        owner = np.array([k for _, k in globs], np.int64)
        rank = np.empty(len(order) + 1, np.int64)
        rank[order] = np.arange(len(order))

        def compute(urls):
            parts = [canonical(u) for u in urls]
            hit = automaton.match([h + p for h, p in parts])
            first = np.where(hit, rank[owner][None, :], len(order)).min(axis=1, initial=len(order)).tolist()
            chosen = [order[f] if f < len(order) else None for f in first]
            return {
                "host": [h for h, _ in parts],
                "path": [p for _, p in parts],
                "rule": [None if k is None else labels[k] for k in chosen],
                "verdict": [default if k is None else verdicts[k] for k in chosen],
            }

        return compute

    return map_texts(pages, id_col, url_col, {"host": "string", "path": "string", "rule": "string", "verdict": "string"}, make)


SQL = r"""
WITH split AS (
  SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE
    regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    CASE WHEN strpos(rest, '/') = 0 THEN '' ELSE substr(rest, strpos(rest, '/')) END AS path FROM split),
judged AS (
  SELECT page_id, host, path, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM parts)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN path <> '' AND regexp_matches(host, 'spam|pills|casino') THEN 'block'
  WHEN contains(path, '/login/') THEN 'block' ELSE 'allow' END AS verdict FROM judged
"""
