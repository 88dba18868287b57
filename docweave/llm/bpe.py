"""Byte-level BPE: encoding with forced boundaries, decoding, and token counts."""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_texts

#: Entries a task keeps of what it has encoded; then it starts again, so memory stays bounded.
MEMO = 400_000
#: Bytes of piece counts that are broadcast at most, and what a row of them takes besides its word.
KNOWN_BYTES, ROW_BYTES = 32 << 20, 64
#: Pre-tokens that are counted in one call.
WORDS = 8192

#: Fixed value: the published pattern of byte-level pre-tokens.
PRE_TOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters that this pattern takes alike here and in the library, whose Unicode tables are of another version.
_ALIKE = re.compile("[\0-\u0557\u2000-\u2063\u20a0-\u20bf\u2190-\u23ff\u3001-\u303f\u3041-\u3096\u30a0-\u30ff\u4e00-\u9fa5\uac00-\ud7a3\uff01-\uff5e\U0001f300-\U0001f5ff]*")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary, by the rule that GPT-2 published."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokens:
    """A tokenizers file: its library object, special tokens, and whether its pre-tokens are the published byte-level ones."""

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_str(tokenizer_json)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.spec = json.loads(tokenizer_json)
        self.special_ids = {t["content"]: t["id"] for t in self.spec["added_tokens"]}
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.special_ids, key=len, reverse=True))) + ")") if self.special_ids else None
        before = self.spec["pre_tokenizer"] or {}
        self.published = not self.spec["normalizer"] and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)

    def parts(self, text: str) -> Iterator[str | int]:
        """text between special tokens, and those tokens' ids."""
        for i, part in enumerate(self._special.split(text) if self._special else [text]):
            if part:
                yield self.special_ids[part] if i % 2 else part


class Codec(Tokens):
    """Encodes and decodes with a tokenizers file by forced-boundary splitting.

    A pair of bytes that is inside no vocabulary token can be inside no token of an encoding, so a text
    may be cut between the two, if the split into pre-tokens also stays as it is: the first byte must not
    end white space (the pattern looks ahead after it), the second must begin a character and not be an
    apostrophe (a contraction starts with it). The mask of such pairs cuts the bytes of a whole text; each distinct fragment is
    encoded alone, once for as long as the memo holds it, and the ids of a text's fragments are concatenated.
    A file with other pre-tokens than the published byte-level ones has no certain cuts but its special tokens.
    """

    def __init__(self, tokenizer_json: str):
        super().__init__(tokenizer_json)
        if hasattr(self.lib.model, "_resize_cache"):
            # the library keeps a cache for each of its threads, which outlives the object, and a worker serves many tasks; the memo does its work here
            self.lib.model._resize_cache(0)
        letters = byte_alphabet()
        vocab = self.spec["model"]["vocab"]
        self.pieces: list[bytes] = [b""] * (1 + max([*vocab.values(), *self.special_ids.values()]))
        inside = np.zeros((256, 256), bool)
        for token, i in vocab.items():
            self.pieces[i] = raw = bytes(letters[c] for c in token)
            for a, b in zip(raw, raw[1:], strict=False):
                inside[a, b] = True
        for token, i in self.special_ids.items():
            self.pieces[i] = token.encode()
        self.forced = ~inside
        blank_ends = [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, *range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]
        self.forced[blank_ends, :] = False
        self.forced[:, 0x80:0xC0] = False
        self.forced[:, 0x27] = False
        self.forced &= self.published
        self.table = np.frombuffer(b"".join(self.pieces), np.uint8)
        self.lengths = np.array([len(raw) for raw in self.pieces], np.int64)
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.known: dict[bytes, bytes] = {}

    def fragments(self, text: str) -> list[bytes]:
        """The UTF-8 bytes of text, cut at every forced pair."""
        raw = text.encode("utf-8", "surrogatepass")
        data = np.frombuffer(raw, np.uint8)
        cuts = (np.flatnonzero(self.forced[data[:-1], data[1:]]) + 1).tolist()
        return [raw[a:b] for a, b in zip([0, *cuts], [*cuts, len(raw)], strict=True)]

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        cut_up = [[p if isinstance(p, int) else self.fragments(p) for p in self.parts(t)] for t in texts]
        if len(self.known) > MEMO:
            self.known.clear()
        new = list(set(chain.from_iterable(p for parts in cut_up for p in parts if not isinstance(p, int))) - self.known.keys())
        encoded = self.lib.encode_batch_fast([f.decode("utf-8", "surrogatepass") for f in new], add_special_tokens=False)
        self.known.update((f, np.array(e.ids, np.int32).tobytes()) for f, e in zip(new, encoded, strict=True))
        out = []
        for parts in cut_up:
            ids = [np.int32(p).tobytes() if isinstance(p, int) else b"".join(map(self.known.__getitem__, p)) for p in parts]
            out.append(np.frombuffer(b"".join(ids), np.int32))
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, special tokens kept; bytes that aren't UTF-8 become U+FFFD."""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        at = np.repeat(self.offsets[ids] - (ends - lengths), lengths)
        return self.table[at + np.arange(len(at))].tobytes().decode("utf-8", "replace")


class PreTokens(Tokens):
    """Splits texts into the pre-tokens of a tokenizers file, and counts the pieces of one."""

    def __init__(self, tokenizer_json: str):
        import regex

        super().__init__(tokenizer_json)
        self._find = regex.compile(PRE_TOKEN).findall
        stands = {b: c for c, b in byte_alphabet().items()}
        self._stands = {b: ord(c) for b, c in stands.items()}

    def split(self, text: str) -> tuple[Counter, int]:
        """How often each pre-token is in text, and how many special tokens are.

        Published byte-level pre-tokens are as in the text, others as the library writes them.
        """
        found, special = Counter(), 0
        for part in self.parts(text):
            if isinstance(part, int):
                special += 1
            elif self.published and _ALIKE.fullmatch(part):
                found.update(self._find(part))
            elif self.published:
                found.update(part[a:b] for _, (a, b) in self.lib.pre_tokenizer.pre_tokenize_str(part))
            else:
                normal = self.lib.normalizer.normalize_str(part) if self.lib.normalizer else part
                found.update(w for w, _ in self.lib.pre_tokenizer.pre_tokenize_str(normal)) if self.lib.pre_tokenizer else found.update([normal])
        return found, special

    def pieces(self, word: str) -> int:
        if self.published:
            word = word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self._stands)
        return len(self.lib.model.tokenize(word))


def read_spec(tokenizer_path: str) -> str:
    with open(tokenizer_path, encoding="utf-8") as f:
        return f.read()


def encode_decode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns (id_col, ids array<int>, decoded string) for each row of docs, whole texts.

    Null and empty texts have no ids and decode to the empty text. Repeated rows each get a row. An
    empty table gives an empty table. Other columns of docs aren't read, whatever their names.
    """
    spec = read_spec(tokenizer_path)

    def make():
        codec = Codec(spec)

        def compute(texts):
            ids = codec.encode_batch([t or "" for t in texts])
            return {"ids": ids, "decoded": [codec.decode(i) for i in ids]}

        return compute

    return map_texts(docs, id_col, text_col, {"ids": "array<int>", "decoded": "string"}, make)


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", known_bytes: int = KNOWN_BYTES) -> DataFrame:
    """Returns (id_col, n_bytes, n_tokens) for each row of docs, without ids.

    1. One pass over the texts gives the frequencies of the pre-tokens of each, which are written to a table.
    2. The pieces of each distinct pre-token of that table are counted once.
    3. Frequencies and counts are joined, and the products summed by text. Counts of the most widespread pre-tokens, as many as
       known_bytes takes by their measured bytes, are joined by a broadcast, so that no such pre-token is a hot key and its rows aren't
       moved; the others by a shuffle. Which way a pre-token takes changes no result.

    Null and empty texts have 0 bytes and 0 tokens. Repeated rows each get a row. An empty table
    gives an empty table. Other columns of docs aren't read, whatever their names.
    """
    spec = read_spec(tokenizer_path)
    texts = cut(frequencies(docs.select(F.col(id_col).alias("_key"), F.col(text_col).alias("_body")), spec), compression="zstd")
    pieces = cut(piece_counts(texts.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n")), spec))
    least = commonly(pieces, known_bytes)
    common = F.broadcast(pieces.where(F.col("n") >= least).select("word", "pieces"))
    rows = texts.select("_key", "f1", F.inline(F.arrays_zip(F.col("words").alias("word"), F.col("counts").alias("freq"))))
    sums = texts.select("_key", "f1", "n_bytes", F.lit(1).cast("long").alias("copies"), F.col("special").alias("tokens"))
    joins = [rows.join(common, "word")]
    if least > 1:
        joins.append(rows.join(common, "word", "left_anti").join(pieces.where(F.col("n") < least).select("word", "pieces").hint("merge"), "word"))
    for joined in joins:
        sums = sums.unionByName(joined.select("_key", "f1", F.lit(0).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("copies"), (F.col("freq") * F.col("pieces")).alias("tokens")))
    # rows of the same id and text fall together, and come apart again
    sums = sums.groupBy("_key", "f1").agg(F.max("n_bytes").alias("n_bytes"), F.sum("copies").alias("copies"), F.sum("tokens").alias("tokens"))
    sums = sums.select("*", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    return sums.select(F.col("_key").alias(id_col), "n_bytes", F.expr("tokens div copies").alias("n_tokens"))


def frequencies(texts: DataFrame, spec: str) -> DataFrame:
    """(_key, f1, n_bytes, special, words, counts) for each text: a hash (it only tells texts of one id apart), its special tokens, its distinct pre-tokens and how often each is in it."""

    def make():
        import xxhash

        split = PreTokens(spec).split

        def compute(texts):
            out = {"f1": [], "n_bytes": [], "special": [], "words": [], "counts": []}
            for t in texts:
                raw = t.encode("utf-8", "surrogatepass") if t else b""
                found, special = split(t) if t else ({}, 0)
                out["f1"].append(xxhash.xxh3_64_intdigest(raw) - (1 << 63))
                out["n_bytes"].append(len(raw))
                out["special"].append(special)
                out["words"].append(list(found))
                out["counts"].append(list(found.values()) if found else [])
            return out

        return compute

    fields = {"f1": "bigint", "n_bytes": "bigint", "special": "bigint", "words": "array<string>", "counts": "array<int>"}
    return map_texts(texts, "_key", "_body", fields, make)


def piece_counts(words: DataFrame, spec: str) -> DataFrame:
    """(word, n, pieces): the count of pieces for each row of words."""

    def make():
        pieces = PreTokens(spec).pieces
        return lambda words: {"pieces": [pieces(w) for w in words]}

    counted = map_texts(words.select(F.struct("word", "n").alias("of"), "word"), "of", "word", {"pieces": "bigint"}, make, slice_rows=WORDS)
    return counted.select("of.word", "of.n", "pieces")


def commonly(pieces: DataFrame, known_bytes: int) -> int:
    """The least n, a power of two, from which on the rows of pieces take at most known_bytes; 1 if all do."""
    size = F.sum(F.octet_length("word") + F.lit(ROW_BYTES)).alias("size")
    by = {r["e"]: r["size"] for r in pieces.groupBy(F.floor(F.log2("n")).alias("e")).agg(size).collect()}  # 64 rows at most
    least, room = max(by, default=-1) + 1, known_bytes
    for e in sorted(by, reverse=True):
        room -= by[e]
        if room < 0:
            return 2**least
        least = e
    return 1


def token_count_report(docs: DataFrame, tokenizer_path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit."""
    return token_counts(docs, tokenizer_path).withColumn("over_limit", F.col("n_tokens") > limit)


def encoding_report(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the decoded text."""
    out = encode_decode(docs, tokenizer_path)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
