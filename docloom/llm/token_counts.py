"""Token counts that follow edits.

A document's tree has its pre-tokens as leaves, each with its number of tokens,
and sums of both children above them; the root has the document's count. An
edit touches the leaves that its range overlaps. Splitting starts again a few
pre-tokens before the edit and goes on until a pre-token begins where one began
before, past the edit: from there on nothing can differ, since where the next
pre-token ends depends only on the text from its start on. The new counts are
put at the first touched leaf, the others become 0, and the sums on the paths
to the root are updated.

Pre-tokens are those of a byte-level BPE vocabulary; each distinct one is
encoded once for each Python worker, within a bound.

Defined results: null texts count as empty; an edit outside the text is moved
to its end; overlapping edits are applied in order of their start, each to what
the earlier ones left of the old text; no edits give the old count. Every row
gets a row, repeated ones too. Only doc_id and text are read.
"""

from __future__ import annotations

import base64
import functools
import gc
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import begin, pieces, schema, text_of

#: Pre-tokens to go back before an edit: white space ends one character short of a word, and looks one ahead.
CONTEXT = 2
KNOWN = 400_000
BATCH_BYTES = 1 << 20


class Tokenizer:
    """Splits text and counts the tokens of pre-tokens."""

    def __init__(self, name: str = "byte_bpe_50k.tiktoken"):
        import public_tokenizers
        import regex
        import tiktoken

        with open(public_tokenizers.path(name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.known: dict[str, int] = {}

    def count(self, pre: str) -> int:
        n = self.known.get(pre)
        if n is None:
            n = len(self.encoding.encode_ordinary(pre))
            if len(self.known) < KNOWN:
                self.known[pre] = n
        return n

    def split(self, text: str) -> list[str]:
        return self.pattern.findall(text)


@functools.cache
def _tokenizer(name: str) -> Tokenizer:
    return Tokenizer(name)


class Tree:
    """A segment tree over the pre-tokens of one text."""

    def __init__(self, text: str, tokenizer: Tokenizer):
        self.text, self.tokenizer, self.encoded = text, tokenizer, 0
        split = tokenizer.split(text)
        self.starts = np.cumsum([0, *map(len, split)]).tolist()  # of each leaf, then the length of the text
        assert self.starts[-1] == len(text), "the pattern covers every character"
        self.size = 1 << max(0, len(split) - 1).bit_length()
        level = np.zeros(self.size, np.int64)
        level[: len(split)] = list(map(tokenizer.count, split))
        levels = [level]
        while len(level) > 1:
            level = level[0::2] + level[1::2]
            levels.append(level)
        self.sums = np.concatenate([np.zeros(1, np.int64), *levels[::-1]])  # node i has children 2i and 2i + 1

    @property
    def total(self) -> int:
        return int(self.sums[1])

    def update(self, leaf: int, value: int) -> None:
        i = self.size + leaf
        change = value - int(self.sums[i])
        while change and i:
            self.sums[i] += change
            i //= 2

    def range_sum(self, a: int, b: int) -> int:
        """Tokens of leaves a to b - 1, from O(log n) nodes."""
        out, a, b = 0, a + self.size, b + self.size
        while a < b:
            if a & 1:
                out, a = out + int(self.sums[a]), a + 1
            if b & 1:
                b -= 1
                out += int(self.sums[b])
            a, b = a // 2, b // 2
        return out

    def edit(self, edits: list[tuple[int, int, str]]) -> str:
        """Apply (start, length, replacement) to the text the tree was made for; the new text."""
        n, out, last, pending = len(self.text), [], 0, []
        for start, length, new in sorted(edits):
            start = min(max(start, last), n)
            end = min(max(start, start + length), n)
            pending.append((start, end, new))
            out += [self.text[last:start], new]
            last = end
        out.append(self.text[last:])
        text = "".join(out)
        shift, i = 0, 0  # of the new text against the old one, behind the edits done
        done = 0  # first leaf that no edit has touched yet
        while i < len(pending):
            start, end, new = pending[i]
            leaf = max(done, bisect_right(self.starts, start) - 1 - CONTEXT, 0)
            at = self.starts[leaf] + shift
            shift += len(new) - (end - start)
            i += 1
            count, stop = 0, len(self.starts) - 1
            for m in self.tokenizer.pattern.finditer(text, at):
                old = m.start() - shift
                # Edits that begin in what is being split, or so soon after it that it looks at them, belong to this region.
                while i < len(pending) and pending[i][0] <= old + len(m[0]) + CONTEXT:
                    shift += len(pending[i][2]) - (pending[i][1] - pending[i][0])
                    end = pending[i][1]
                    i += 1
                    old = m.start() - shift
                k = bisect_left(self.starts, old)
                if old >= end and k < len(self.starts) and self.starts[k] == old and k > leaf:
                    stop = k
                    break
                count += self.tokenizer.count(m[0])
                self.encoded += 1
            stop = max(stop, leaf)
            if stop > leaf:
                self.update(leaf, count)
                for k in range(leaf + 1, stop):
                    self.update(k, 0)
            elif len(self.starts) == 1:  # there was no leaf at all: the tree is that of an empty text
                self.update(0, count)
            done = stop
        return text


def count_after_edits(docs: DataFrame, edits: str = "edits", tokenizer: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """doc_id, tokens before and after the edits, pre-tokens in the tree and those that were encoded again.

    ``edits``: a column of array<struct<start int, length int, text string>>, in characters of the text; null is none.
    """
    out = schema("doc_id long, n_tokens long, n_tokens_edited long, n_pretokens long, n_reencoded long, n_edits long")

    def run(batches):
        begin("token counts", _tokenizer.cache_clear)
        gc.disable()
        tok = _tokenizer(tokenizer)
        for rows in pieces(batches, BATCH_BYTES, "doc_id", "edits", "text"):
            found = []
            for doc_id, changes, text in rows:
                tree = Tree(text, tok)
                before = tree.total
                todo = [(e["start"], e["length"], e["text"] or "") for e in changes or []]
                tree.edit(todo)
                found.append((doc_id, before, tree.total, len(tree.starts) - 1, tree.encoded, len(todo)))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], out.names)

    return text_of(docs, F.col(edits).alias("edits")).mapInArrow(run, out)


def sample_edits(seed: str = "edit-1") -> object:
    """A column of three edits to each text, at places drawn from hashes: an insertion, a deletion and a replacement.

    They stand for an annotator's changes where a table has none of its own.
    """
    n = F.char_length(F.coalesce("text", F.lit("")))
    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))

    def one(k: int, length: int, new: str):
        place = F.pmod(F.xxhash64(F.lit(f"{seed}-{k}"), doc), n + 1)
        return F.struct(place.cast("int").alias("start"), F.lit(length).alias("length"), F.lit(new).alias("text"))

    return F.array(one(0, 0, " inserted by hand, twice"), one(1, 40, ""), one(2, 12, "Redacted-2024"))
