"""Token counts by overlap resynchronisation (operator 1).

Ordinary texts are encoded whole.  A huge text is encoded in overlapping
chunks with offsets, and two chunks are spliced at a position where both have
a token boundary and which is *proven* stable: a BPE merge joins two adjacent
symbols only into a vocabulary piece, so no merge can cross a pair of
characters that stands inside no piece.  Everything left of such a position is
encoded independently of everything right of it, whatever the rest of the text
is.  If an overlap holds no stable common boundary it is widened, and once it
would swallow the chunk the chunk itself grows, up to the whole text.

The argument needs an identity normaliser; a model with another one is encoded
whole (`splice_ok`)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from pairloom.llm.common import map_texts, slim

CHUNK_CHARS = 16_384
OVERLAP_CHARS = 128
SCHEMA = "doc_id long, n_bytes long, n_tokens long, n_chunks int, n_widened int"


class Counter:
    """Counts the tokens of texts with one sentencepiece model."""

    def __init__(self, model_file: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.chunk, self.overlap = chunk, overlap
        self.inside = set()
        for i in range(self.sp.get_piece_size()):
            if not (self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_byte(i) or self.sp.is_unused(i)):
                p = self.sp.id_to_piece(i)
                self.inside.update(a + b for a, b in zip(p, p[1:]))
        # texts must reach the model unchanged but for the space mark
        probe = "a  b\tc\nÅÅﬁ　 d "
        self.splice_ok = self.sp.normalize(probe) == "▁" + probe.replace(" ", "▁")

    def stable(self, text: str, p: int) -> bool:
        return text[p - 1 : p + 1].replace(" ", "▁") not in self.inside

    def begins(self, text: str, start: int, end: int) -> np.ndarray:
        """Absolute first-character offsets of the tokens of text[start:end]."""
        offsets = self.sp.encode(text[start:end], return_type="offset_mapping")["offsets"]
        return np.fromiter((a for a, _ in offsets), np.int64, len(offsets)) + start

    def splice(self, text: str) -> tuple[int, int, int]:
        """(tokens, chunks, widened overlaps) of a text longer than a chunk."""
        n, size = len(text), self.chunk
        start = cut = total = widened = 0
        chunks, end = 1, min(self.chunk, n)
        cur = self.begins(text, 0, end)
        while end < n:
            overlap = self.overlap
            while True:
                nstart = end - overlap
                if nstart <= cut:
                    # no stable place in the whole chunk: let the chunk grow
                    size *= 2
                    end = min(start + size, n)
                    cur, overlap = self.begins(text, start, end), self.overlap
                    if end == n:
                        break
                    continue
                nend = min(nstart + self.chunk + overlap, n)
                nxt = self.begins(text, nstart, nend)
                common = np.intersect1d(cur[cur > nstart], nxt[nxt > nstart])
                p = next((int(x) for x in common if x > cut and self.stable(text, int(x))), None)
                if p is not None:
                    total += int(np.count_nonzero((cur >= cut) & (cur < p)))
                    start, cut, cur, end, size = nstart, p, nxt, nend, self.chunk
                    chunks += 1
                    break
                overlap *= 2
                widened += 1
        return total + int(np.count_nonzero(cur >= cut)), chunks, widened

    def count(self, texts: list[str]) -> list[tuple[int, int, int]]:
        huge = [self.splice_ok and len(t) > self.chunk for t in texts]
        plain = [t for t, h in zip(texts, huge) if not h]
        got = []
        for at in range(0, len(plain), 32):
            got += [len(ids) for ids in self.sp.encode(plain[at : at + 32], num_threads=1, return_type="numpy")]
        left = iter(got)
        return [self.splice(t) if h else (next(left), 1, 0) for t, h in zip(texts, huge)]


def token_counts(df: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text",
                 chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """One row per input row: doc_id, n_bytes (UTF-8), n_tokens, n_chunks,
    n_widened.  Null and empty texts have 0 bytes and 0 tokens; a null id
    stays null; repeated rows give repeated results; no rows give no rows;
    other columns are ignored.  ``model_file`` must be readable on every
    executor.  No shuffle."""

    def make():
        counter = Counter(model_file, chunk, overlap)

        def fn(ids, texts):
            got = counter.count(texts)
            return [ids, [len(t.encode()) for t in texts], *map(list, zip(*got))]

        return fn

    return map_texts(slim(df, id_col, text_col), make, SCHEMA)


def op1_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    out = token_counts(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"),
                      "n_chunks", "n_widened")
