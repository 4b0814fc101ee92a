"""Token counts of whole texts, huge ones by overlapping chunks.

A text of over `chunk` characters is encoded in chunks that overlap; each
chunk's tokens carry character offsets into the text. Two neighbours are spliced
at a stable common boundary: a white-space character inside the overlap after
which both hold a token at the same offset, where the tokens from there on, up
to the end of the overlap's last white space, are the same ids at the same
offsets. The tokenizer drops white space before it merges, and its patterns and
special strings hold none, so no token and no merge reaches across: what follows
a white-space character does not depend on what stands before it. If an overlap
has no such place (a run without white space), it is widened, at last to the
rest of the text. Short texts are encoded whole; their white-space-separated
pieces are looked up in a memo of encoded pieces, for the same reason.

Rows: null and empty texts have no bytes and no tokens; repeated rows are counted
one by one; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLANK = re.compile(r"[ \t\n\r]")
PIECE = re.compile(r"[^ \t\n\r]+")


def load(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def encoded(tokenizer, text: str, start: int, end: int) -> list[tuple[int, int]]:
    """(offset in the whole text, id) of the tokens of text[start:end]."""
    found = tokenizer.encode(text[start:end], add_special_tokens=False)
    return [(start + at, token) for (at, _), token in zip(found.offsets, found.ids, strict=True)]


def stable(text: str, left: list[tuple[int, int]], right: list[tuple[int, int]], start: int, end: int) -> int | None:
    """Offset of a proven common boundary within the overlap [start, end).

    It follows the overlap's first white space; the tokens between it and the
    overlap's last white space, at least one, must be the same on both sides.
    """
    first = BLANK.search(text, start, end)
    last = end
    while last > start and text[last - 1] not in " \t\n\r":
        last -= 1
    if first is None or last <= first.end():
        return None
    cut = first.end()
    ours = [x for x in left if cut <= x[0] < last]
    theirs = [x for x in right if cut <= x[0] < last]
    return cut if ours and ours == theirs else None


def count_huge(tokenizer, text: str, chunk: int, overlap: int) -> int:
    """Tokens of a text, spliced from overlapping chunks."""
    total, start = 0, 0  # tokens at offsets below `start` are counted
    end = min(len(text), chunk)
    left = encoded(tokenizer, text, 0, end)
    while end < len(text):
        wide = overlap
        while True:
            begin = max(start, end - wide)
            after = min(len(text), begin + max(chunk, 2 * wide))
            right = encoded(tokenizer, text, begin, after)
            cut = stable(text, left, right, begin, end)
            if cut is not None:
                break
            if begin == start and after == len(text):  # widened to all that is left
                return total + len(right)
            if begin == start:  # no boundary in the whole left chunk: take a longer one
                end = min(len(text), start + 2 * (end - start))
                left = encoded(tokenizer, text, start, end)
                if end == len(text):
                    return total + sum(x[0] >= start for x in left)
            wide *= 2
        total += sum(start <= x[0] < cut for x in left)
        left, start, end = [x for x in right if x[0] >= cut], cut, after
    return total + sum(x[0] >= start for x in left)


class Counted:
    """Counts tokens; remembers those of `most` pieces."""

    def __init__(self, path: str, chunk: int = 16_384, overlap: int = 512, most: int = 500_000):
        self.tokenizer, self.chunk, self.overlap, self.most, self.memo = load(path), chunk, overlap, most, {}

    def counts(self, texts: list[str]) -> list[int]:
        short = [Counter(PIECE.findall(t)) if len(t) <= self.chunk else None for t in texts]
        memo = self.memo
        new = list({p for c in short if c for p in c if p not in memo})
        if len(memo) + len(new) > self.most:
            memo.clear()
            new = list({p for c in short if c for p in c})
        for i in range(0, len(new), 50_000):
            part = new[i : i + 50_000]
            memo |= {p: len(e) for p, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True)}
        return [count_huge(self.tokenizer, t, self.chunk, self.overlap) if c is None else sum(n * memo[p] for p, n in c.items()) for t, c in zip(texts, short, strict=True)]


def count_tokens(documents: DataFrame, path: str, limit: int = 2048, chunk: int = 16_384, overlap: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document."""

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        counted = Counted(path, chunk, overlap)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            counts = [n for i in range(0, len(texts), 500) for n in counted.counts(texts[i : i + 500])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    found = documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
    return found.withColumn("over_limit", F.col("n_tokens") > limit)
