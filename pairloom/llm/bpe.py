"""BPE encoding and decoding with a contiguous rank array (operator 3).

A word is held as its part boundaries and, beside them, the rank of the merge
of each two neighbouring parts.  Encoding scans the ranks for the minimum,
deletes that boundary and refreshes the two ranks next to it, until no
neighbours can merge.  For the short words of ordinary text the scan is
cheaper than a heap; a word beyond ``SCAN_LIMIT`` symbols (a run of
punctuation, text without spaces) uses a heap over a linked list, which merges
in the same order (lowest rank, leftmost first)."""

from __future__ import annotations

import hashlib
import heapq
import json
import sys
import unicodedata
from array import array

import numpy as np
import regex
from pyspark.sql import DataFrame

from pairloom.llm.common import CACHE_ENTRIES, map_texts, slim

SCAN_LIMIT = 128
NO_RANK = 1 << 60
ENCODE_SCHEMA = "doc_id long, ids binary, n_tokens long"
DIGEST_SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

LITTLE = sys.byteorder == "little"


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: printable Latin-1
    bytes stand for themselves, the others for code points from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class WordBpe:
    """Encoder and decoder for a word-end BPE tokenizer file (.json)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = dict(model["vocab"])
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        #: both part ids in one integer -> rank of their merge; merged id by rank
        self.ranks = {self.vocab[a] << 32 | self.vocab[b]: r for r, (a, b) in enumerate(merges)}
        self.merged = [self.vocab[a + b] for a, b in merges]
        alphabet = byte_alphabet()
        self.byte_id = [self.vocab[c] for c in alphabet]
        self.last_id = [self.vocab[c + self.suffix] for c in alphabet]
        self.token = {i: t for t, i in (*self.vocab.items(), *self.special.items())}
        pattern = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        self.words = regex.compile(pattern.replace(r"\s", r"\p{White_Space}"))
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        self.cache: dict[str, bytes] = {}

    def _scan(self, parts: list[int]) -> list[int]:
        get, merged = self.ranks.get, self.merged
        ranks = [get(a << 32 | b, NO_RANK) for a, b in zip(parts, parts[1:])]
        while ranks:
            low = min(ranks)
            if low == NO_RANK:
                break
            i = ranks.index(low)
            new = parts[i] = merged[low]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(parts[i - 1] << 32 | new, NO_RANK)
            if i < len(ranks):
                ranks[i] = get(new << 32 | parts[i + 1], NO_RANK)
        return parts

    def _heap(self, parts: list[int]) -> list[int]:
        n, get = len(parts), self.ranks.get
        left, right, alive = [*range(-1, n - 1)], [*range(1, n + 1)], [True] * n
        heap = [(r, i) for i in range(n - 1) if (r := get(parts[i] << 32 | parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = right[i] if alive[i] else n
            if j >= n or get(parts[i] << 32 | parts[j]) != r:
                continue  # a neighbour has changed since
            parts[i], alive[j], right[i] = self.merged[r], False, right[j]
            if right[i] < n:
                left[right[i]] = i
            for p, q in ((left[i], i), (i, right[i])):
                if p >= 0 and q < n and (r := get(parts[p] << 32 | parts[q])) is not None:
                    heapq.heappush(heap, (r, p))
        return [p for p, x in zip(parts, alive) if x]

    def word_ids(self, word: str) -> list[int]:
        raw = word.encode()
        parts = [self.byte_id[b] for b in raw[:-1]]
        parts.append(self.last_id[raw[-1]])
        return self._scan(parts) if len(parts) <= SCAN_LIMIT else self._heap(parts)

    def _plain(self, text: str) -> list[bytes]:
        # white space only separates words, so it need not be collapsed first;
        # lower case character by character: no final-sigma rule
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        cache, out = self.cache, []
        for chunk in text.lower().split(" "):
            ids = cache.get(chunk)
            out.append(self._chunk(chunk) if ids is None else ids)
        return out

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a stretch without blanks: its words, one after the other."""
        cache = self.cache
        if len(cache) >= CACHE_ENTRIES:
            cache.clear()
        parts = []
        for w in self.words.findall(chunk):
            ids = cache.get(w)
            if ids is None:
                ids = array("I", self.word_ids(w))
                if not LITTLE:
                    ids.byteswap()
                ids = ids.tobytes()
                if len(w) <= 64:
                    cache[w] = ids
            parts.append(ids)
        ids = b"".join(parts)
        if len(chunk) <= 64:
            cache[chunk] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Token ids as little-endian unsigned 32-bit integers."""
        out, at = [], 0
        for m in self.specials.finditer(text):
            out += self._plain(text[at : m.start()])
            out.append(np.asarray([self.special[m[0]]], "<u4").tobytes())
            at = m.end()
        out += self._plain(text[at:] if at else text)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The tokenizer has no decoder, so tokens are joined by spaces."""
        return " ".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit), n_tokens per row.
    Null and empty texts have no ids; a null doc_id stays null; repeated rows
    give repeated results; no rows give no rows; other columns are ignored.
    ``path`` must be readable on every executor.  No shuffle."""

    def make():
        bpe = WordBpe(path)

        def fn(ids, texts):
            got = [bpe.encode(t) for t in texts]
            return [ids, got, [len(g) // 4 for g in got]]

        return fn

    return map_texts(slim(df, id_col, text_col), make, ENCODE_SCHEMA)


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and decoded text of a table with an ``ids`` column as `encode`
    writes it.  Null ids decode to the empty text."""

    def make():
        bpe = WordBpe(path)
        return lambda ids, raw: [ids, [bpe.decode(r or b"") for r in raw]]

    return map_texts(df.select(df[id_col].cast("long").alias("doc_id"), df[ids_col].alias("text")),
                     make, "doc_id long, text string")


def round_trip_digests(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, then decode the ids again, and return both digests per row."""

    def make():
        bpe = WordBpe(path)

        def fn(ids, texts):
            got = [bpe.encode(t) for t in texts]
            return [ids, [len(g) // 4 for g in got], [hashlib.sha256(g).hexdigest() for g in got],
                    [hashlib.sha256(bpe.decode(g).encode()).hexdigest() for g in got]]

        return fn

    return map_texts(slim(df, id_col, text_col), make, DIGEST_SCHEMA)


def op3_bpe_round_trip(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    return round_trip_digests(docs, public_tokenizers.path("word_bpe_49k.json"))
