"""Language identification by compression with per-language dictionaries."""

from __future__ import annotations

import math
import random
import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, remainder, sampled, slices

#: Bounds of what is learned: documents of each language for its dictionary and as many again for the margin (about, by hash),
#: bytes taken of each, from anywhere in it, bytes of a dictionary.
SAMPLE_DOCS, PIECE_BYTES, DICTIONARY_BYTES = 400, 1500, 96 << 10
#: A text is rejected if its second size is larger than its best by at most margin * sqrt(best) bytes: what chance matches give grows about
#: with the root of the size. The margin rejects this share of so many texts of random letters, but not more than half of what this
#: quantile of learned texts, of at least so many bytes, has.
NOISE_SHARE, NOISE_TEXTS, NOISE_WORDS, MARGIN_QUANTILE, MARGIN_BYTES = 0.99, 100, 200, 0.005, 200

_WORDS = re.compile(r"[^\W\d_]+")


@dataclass
class Learned:
    """Raw-content dictionaries by label value, and by how many roots of the best size the second must be larger."""

    dictionaries: dict[str, bytes] = field(default_factory=dict)
    margin: float = 0.0


def plain(text: str) -> bytes:
    """The words of letters of text in lower case, joined by blanks; empty if it has no letter (Unicode L; numbers such as ½ aren't)."""
    words = _WORDS.findall(text.lower())
    if not all(map(str.isalpha, words)):
        words = [v for w in words for v in "".join(c if c.isalpha() else " " for c in w).split()]
    return " ".join(words).encode("utf-8", "ignore")


def piece_of(words: bytes, size: int = PIECE_BYTES) -> bytes:
    """At most size bytes of words, from the run of three words with the least hash on; those before it where the end comes first.

    So pieces come from anywhere in a text, and near copies mostly give the same one.
    """
    if len(words) <= size:
        return words
    begins = np.flatnonzero(np.frombuffer(b" " + words, np.uint8) == 32).tolist()
    at = min((zlib.crc32(words[a:b]), a) for a, b in zip(begins, [*begins[3:], len(words)], strict=False))[1]
    last = min(int(np.searchsorted(begins, len(words) - size)), len(begins) - 1)
    at = min(at, begins[last])
    return words[at : at + size].rsplit(b" ", 1)[0] if at + size < len(words) else words[at:]


def few_of_each(texts: list[bytes], room: int = DICTIONARY_BYTES) -> bytes:
    """Pieces of all texts but near copies, of equal length where texts are long enough, room bytes at most.

    Texts come in the order of a hash. A text of which at least half the runs of three words are in those before it is a near copy.
    """
    known: set[int] = set()
    apart = []
    for text in sorted(texts, key=lambda t: (zlib.crc32(t), t)):
        words = text.split()
        runs = {hash(tuple(words[i : i + 3])) for i in range(max(1, len(words) - 2))}
        if 2 * len(runs & known) < len(runs):
            apart.append(text)
            known |= runs
    share, left = 0, room - len(apart)
    for k, n in enumerate(sorted(map(len, apart))):
        share = left // (len(apart) - k)
        if n > share:
            break
        share, left = n, left - n
    pieces = []
    for text in apart:
        at = zlib.crc32(text, 1) % (len(text) - share + 1) if len(text) > share else 0
        pieces.append(text[at : at + share])
    return b" ".join(pieces)


def learn(docs: DataFrame, label_col: str = "lang", text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> Learned:
    """A dictionary for each label value, and the margin below which a text is rejected, from a bounded sample of docs.

    About 2 * sample_docs documents a label are drawn by a hash of the text; piece_of() the whole text of each goes to the driver.
    Half of them (by another hash) make the dictionaries, the other half, compressed with these, the margin.
    Rows without label, text or letters teach nothing; no rows give no dictionaries.
    """
    rows = docs.select(F.col(label_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null and text is not null")
    drawn = sampled(rows, "lang", F.col("text"), 2 * sample_docs)

    def make():
        return lambda texts: {"piece": [piece_of(plain(t)).decode("utf-8", "ignore") for t in texts]}

    pieces = map_texts(drawn, "lang", "text", {"piece": "string"}, make).where("piece <> ''").distinct()
    by: dict[str, list[bytes]] = {}
    other: list[tuple[str, bytes]] = []
    for lang, piece in sorted(tuple(r) for r in pieces.collect()):
        raw = piece.encode()
        if zlib.crc32(raw, 2) % 2:
            other.append((lang, raw))
        else:
            by.setdefault(lang, []).append(raw)
    learned = Learned({lang: few_of_each(texts) for lang, texts in sorted(by.items())})
    learned.margin = margin_of(learned, other)
    return learned


def margin_of(learned: Learned, texts: list[tuple[str, bytes]]) -> float:
    """The margin from (label, text) of learned rows that no dictionary has, and from texts of random letters."""
    names, sizes_of = list(learned.dictionaries), sizer(learned)
    if len(names) < 2:
        return 0.0

    def roots(raw: bytes) -> tuple[int, int, float]:
        sizes = sizes_of(raw)
        best, second = sorted(range(len(sizes)), key=lambda k: (sizes[k], k))[:2]
        return best, sizes[best], (sizes[second] - sizes[best]) / math.sqrt(sizes[best])

    letters = sorted({c for raw in learned.dictionaries.values() for c in raw.decode("utf-8", "ignore")} - {" "})
    rng = random.Random(0)
    noise = [" ".join("".join(rng.choices(letters, k=rng.randrange(2, 9))) for _ in range(NOISE_WORDS)).encode() for _ in range(NOISE_TEXTS)]
    margin = float(np.quantile([roots(raw)[2] for raw in noise], NOISE_SHARE))
    right = [apart for lang, raw in texts for best, size, apart in [roots(raw)] if names[best] == lang and size >= MARGIN_BYTES]
    return min(margin, float(np.quantile(right, MARGIN_QUANTILE)) / 2) if right else margin


def sizer(learned: Learned):
    """A function from bytes to their compressed size with each dictionary; one setting for texts of any length."""
    import zstandard

    codecs = []
    for raw in learned.dictionaries.values():
        d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        how = zstandard.ZstdCompressionParameters.from_level(9, write_content_size=False, write_dict_id=False, write_checksum=False)
        d.precompute_compress(compression_params=how)
        codecs.append(zstandard.ZstdCompressor(dict_data=d, compression_params=how))
    return lambda data: [len(c.compress(data)) for c in codecs]


def identify(docs: DataFrame, learned: Learned, id_col: str = "doc_id", text_col: str = "text", min_margin: float | None = None) -> DataFrame:
    """Returns (id_col, lang_pred, score, rejected, sizes array<int>) for each row of docs.

    The whole text, reduced to words of letters, is compressed by zstandard with each language's dictionary;
    the smallest wins (ties: the first by name). score is the winner's share of 2**-(size difference in bytes),
    so equal sizes share it. rejected: no letters, nothing learned, or a second best that is larger by at most
    min_margin (the learned one if not given) times the root of the best size: of a few words only ties or a byte, of longer texts
    what fits two languages or none. Null texts and texts without letters get lang_pred
    "und" and score 0. Each repeated row gets a row; columns besides the two aren't read.
    """
    make = _identifier(learned, min_margin)
    return map_texts(docs, id_col, text_col, {"lang_pred": "string", "score": "double", "rejected": "boolean", "sizes": "array<int>"}, make)


def keep_identified(docs: DataFrame, learned: Learned, text_col: str = "text", min_margin: float | None = None) -> DataFrame:
    """The rows of docs that identify() doesn't reject, with all columns, filtered where they stand."""
    make = _identifier(learned, min_margin)
    at = docs.columns.index(text_col)

    def run(batches):
        compute = make()
        for batch in batches:
            for rows in slices(batch, at):
                yield rows.filter(pa.array([not r for r in compute(rows.column(at).to_pylist())["rejected"]], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def _identifier(learned: Learned, min_margin: float | None):
    margin = learned.margin if min_margin is None else min_margin

    def make():
        names, sizes_of = list(learned.dictionaries), sizer(learned)

        def compute(texts):
            out = {"lang_pred": [], "score": [], "rejected": [], "sizes": []}
            for t in texts:
                data = plain(t) if t else b""
                sizes = sizes_of(data) if data else []
                order = sorted(range(len(sizes)), key=lambda k: (sizes[k], k))
                best = sizes[order[0]] if sizes else 0
                weights = [2.0 ** -min(s - best, 60) for s in sizes]
                narrow = len(order) > 1 and sizes[order[1]] - best <= margin * math.sqrt(best)
                out["lang_pred"].append(names[order[0]] if order else "und")
                out["score"].append(weights[order[0]] / sum(weights) if order else 0.0)
                out["rejected"].append(not order or narrow)
                out["sizes"].append(sizes)
            return out

        return compute

    return make


def language_report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected; learns where crc32(doc_id) mod 3 is not 1."""
    learned = learn(docs.where(remainder("doc_id", 3) != 1))
    out = identify(docs, learned)
    return out.select("doc_id", F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
