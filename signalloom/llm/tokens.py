"""Exact token counts of whole texts; huge texts by overlap resynchronisation.

A long text is encoded in chunks that overlap. Two neighbouring encodings are spliced at a boundary
that both have in the overlap and that is proven stable: no piece of the vocabulary contains the two
characters next to it, so no merge can ever cross it, whatever stands around. What lies on either
side is then encoded as in the whole text. If an overlap holds no such boundary it is widened, up to the
chunk. A run of characters that has none over a whole chunk is encoded at once, so work stays in proportion.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map, picked

#: Characters of a chunk and of the first overlap; longer texts than one chunk are spliced.
CHUNK, OVERLAP = 16_384, 128
OVER_LIMIT = 4096
SPACE = "▁"  # how the vocabulary writes a space


class Model:
    """A sentencepiece model with what splicing needs to know of its vocabulary."""

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pairs = set()
        for i in range(self.sp.get_piece_size()):
            piece = self.sp.id_to_piece(i)
            self.pairs.update(piece[j : j + 2] for j in range(len(piece) - 1))

    def stable(self, text: str, at: int) -> bool:
        """No vocabulary piece holds the characters before and after `at`."""
        return text[at - 1 : at + 1].replace(" ", SPACE) not in self.pairs

    def next_stable(self, text: str, first: int, last: int) -> int | None:
        """The first stable place from `first` up to, but not including, `last`."""
        return next((x for x in range(max(first, 1), last) if self.stable(text, x)), None)

    def between(self, text: str, first: int, last: int) -> int:
        """Pieces from one stable place (or the beginning) to another (or the end), by the library at once. The
        character before keeps the mark of a text's beginning away from them."""
        before = len(self.sp.encode(text[first - 1 : first])) if first else 0
        return len(self.sp.encode(text[max(first - 1, 0) : last], num_threads=1)) - before

    def plain(self, text: str) -> bool:
        """The normaliser only writes spaces as SPACE and may put one in front, so offsets hold."""
        return self.sp.normalize(text).removeprefix(SPACE) == text.replace(" ", SPACE).removeprefix(SPACE)

    def starts(self, text: str) -> list[int]:
        """Where each piece of the encoded text begins, in characters; the library tells it in UTF-8 bytes."""
        at = [p.begin for p in self.sp.encode(text, return_type="proto").pieces]
        if not text.isascii():
            raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
            at = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))[at].tolist()
        return at

    def count(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
        if len(text) <= chunk or not self.plain(text):
            return len(self.sp.encode(text, num_threads=1))
        total, done = 0, 0  # pieces before `done` are counted
        begin, end = 0, chunk
        now = self.starts(text[:chunk])
        while end < len(text):
            wide, found = overlap, None
            while found is None and end - wide > begin:
                nxt, stop = end - wide, min(len(text), end + chunk)
                if self.next_stable(text, max(nxt, done) + 1, end) is not None:
                    after, ours = [nxt + x for x in self.starts(text[nxt:stop])], {begin + x for x in now}
                    # a chunk's own first and last pieces may differ from those of the whole text
                    found = next((x for x in after if max(nxt, done) < x < end and x in ours and self.stable(text, x)), None)
                wide *= 2
            if found is None:  # as wide as the chunk, and in vain: this unbroken run is encoded once, to its end
                found = self.next_stable(text, end, len(text)) or len(text)
                total += self.between(text, done, found)
                if found == len(text):
                    return total
                begin, end, done = found - 1, min(len(text), found - 1 + chunk), found
                now = self.starts(text[begin:end])
                continue
            total += sum(done <= begin + x < found for x in now)
            begin, end, now, done = nxt, stop, [x - nxt for x in after], found
        return total + sum(x + begin >= done for x in now)


@lru_cache(maxsize=4)
def load(path: str) -> Model:
    return Model(path)


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = OVER_LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of docs, without a shuffle.

    A null text counts as empty: no bytes and no tokens. No begin, end or other special tokens are added,
    and such strings in a text are encoded as the library does by default. Rows are independent, so
    repeated rows, null ids and an empty table need no rule; extra columns of any name are ignored.
    """

    def rows(b: pa.RecordBatch) -> dict:
        model = load(model_path)
        texts = [t or "" for t in b.column("text").to_pylist()]
        short = [i for i, t in enumerate(texts) if len(t) <= chunk]
        counts = [0] * len(texts)
        for i, ids in zip(short, model.sp.encode([texts[i] for i in short], num_threads=1), strict=True):
            counts[i] = len(ids)
        for i, t in enumerate(texts):
            if len(t) > chunk:
                counts[i] = model.count(t, chunk, overlap)
        return {"doc_id": b.column("doc_id"), "n_bytes": [len(t.encode("utf-8", "surrogatepass")) for t in texts], "n_tokens": counts, "over_limit": [n > limit for n in counts]}

    return arrow_map(picked(docs, doc_id=id_col, text=text_col), rows, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
