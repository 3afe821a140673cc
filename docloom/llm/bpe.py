"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the text's code points cuts it where its low bits are zero,
so equal passages are cut alike in whatever document they stand. A chunk is
encoded once, as if it were a text of its own, and then taken from the store of
chunks. A cut may have split a word, and then the tokens on both sides are
wrong. Such a join is repaired: the last two words of the one chunk and the first
two of the next are encoded again as they stand together, and must agree with the
chunks' own tokens in the outer two words. If they don't, the two whole chunks are
encoded together and must agree up to those words, and last the whole text is.
Agreement is exact, as ``verify`` makes sure that tokens of the vocabulary never
depend on what stands beyond ASCII white space; other vocabularies are refused.

The store is one for each Python worker, holds at most ``STORE_BYTES``, beside ``WORD_BYTES`` of single words,
and takes no more words, or is emptied of chunks, when full; a chunk that several workers meet is encoded by each.
Sharing it among all would need the texts to be shuffled, which costs more than
it saves.

Defined results: a null text counts as empty, and has no tokens; every row gets
a row, repeated ones too; only doc_id and text are read.
"""

from __future__ import annotations

import functools
import gc
import hashlib
import os
import random
import re
from collections.abc import Iterable, Iterator
from struct import pack, unpack
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import begin, mix64, pieces, schema, text_of

STORE_BYTES, WORD_BYTES = 16 << 20, 56 << 20
BATCH_BYTES = 1 << 20
_SPACES = frozenset(" \t\n\r\x0b\x0c")
_WINDOW, _BITS, _MIN, _MAX = 16, 8, 128, 4096


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def cuts(text: str, window: int = _WINDOW, bits: int = _BITS, least: int = _MIN, most: int = _MAX) -> list[int]:
    """Ends of the text's chunks, the last one its length."""
    n, out, last = len(text), [], 0
    if n > least:
        h = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        base, length = 0xD6E8FEB86659FD93, 1
        while length < window and len(h) > length:
            h = h[:-length] * np.uint64(base) + h[length:]
            base, length = base * base % 2**64, length * 2
        for at in (np.flatnonzero((mix64(h) & np.uint64((1 << bits) - 1)) == 0) + window).tolist():
            while at - last > most:
                last += most
                out.append(last)
            if at - last >= least and at < n:
                out.append(at)
                last = at
    while n - last > most:
        last += most
        out.append(last)
    out.append(n)
    return out


def chunks(text: str) -> list[str]:
    """The text cut at its rolling hash; a chunk of under four words grows over the next."""
    out, last = [], 0
    for end in cuts(text):
        if end == len(text) or len(text[last:end].encode().split(None, 3)) == 4:
            out.append(text[last:end])
            last = end
    if len(out) > 1 and len(out[-1].encode().split(None, 3)) < 4:
        out[-2:] = [out[-2] + out[-1]]
    return out


_BEFORE_MARK = re.compile(rb"(?<=[a-z])(?=[.,!*$%&#])")


def words(text: str) -> list[bytes]:
    """A piece's words, at white space and between a letter and a mark, where pre-tokens always end.

    The vocabulary lowers case, so words are kept in lower case; but strings of special tokens count as they stand.
    """
    b = text.encode()
    return b.split() if b"<|" in b else _BEFORE_MARK.sub(b" ", b.lower()).split()


class Encoder:
    """Encodes and decodes as the vocabulary's library does, piece by piece."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        # Decoded texts end in the space that the decoder, which this vocabulary leaves out, puts between tokens.
        names = {i: x for x, i in self.tokenizer.get_vocab(with_added_tokens=True).items()}
        self.names = [names.get(i, "").encode() + b" " for i in range(max(names) + 1)]
        self.store: dict[str, Chunk] = {}
        self.ids: dict[bytes, bytes] = {}
        self.used = self.word_bytes = self.encoded = self.reused = self.repaired = self.widened = 0

    def library(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts, as little-endian 32-bit integers."""
        return [pack(f"<{len(e.ids)}I", *e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def decoded(self, ids: bytes) -> bytes:
        return b"".join(map(self.names.__getitem__, unpack(f"<{len(ids) // 4}I", ids)))

    def chunk(self, text: str) -> Chunk:
        of = self.ids.__getitem__
        ids = b"".join(map(of, words(text)))
        b = text.encode()
        first, last = b.split(None, 2)[:2], b.rsplit(None, 2)[-2:]
        if len(first) < 2:  # it is a text's only chunk
            return Chunk(ids, self.decoded(ids), b"", b"", 0, 0, b"", b"")
        head, tail = ([b"".join(map(of, words(w.decode()))) for w in x] for x in (first, last))
        return Chunk(ids, self.decoded(ids), b" ".join(first), b" ".join(last), len(head[0]) + len(head[1]), len(tail[0]) + len(tail[1]), head[1], tail[0])

    def fill(self, texts: Iterable[str]) -> None:
        """Encode the chunks that the store doesn't hold yet; of their words, those that no earlier chunk had."""
        if self.used > STORE_BYTES:
            self.store.clear()
            self.used = 0
        missing = dict.fromkeys(x for x in texts if x not in self.store)
        self.encoded += len(missing)
        new = list({w for x in missing for w in words(x)}.difference(self.ids))
        # Where special tokens' strings make the whole chunk's words count as they stand, its outer words may not.
        new += {w for x in missing if "<|" in x for part in (x.encode().split(None, 2)[:2], x.encode().rsplit(None, 2)[-2:]) for y in part for w in words(y.decode())}.difference(self.ids, new)
        for at in range(0, len(new), 4096):
            some = new[at : at + 4096]
            self.ids.update(zip(some, self.library([w.decode() for w in some]), strict=True))
        for x in missing:
            entry = self.store[x] = self.chunk(x)
            self.used += 4 * len(x) + len(entry.ids) + len(entry.text) + 900
        grown = sum(len(w) + len(self.ids[w]) + 170 for w in new)
        if self.word_bytes + grown > WORD_BYTES:  # full: the frequent words came early and stay
            for w in new:
                del self.ids[w]
        else:
            self.word_bytes += grown

    def widen(self, a: str, b: str) -> bytes | None:
        """The ids between the outer words of two chunks, from both chunks together; None if they don't agree."""
        self.widened += 1
        (both,), x, y = self.library([a + b]), self.store[a], self.store[b]
        left, right = x.ids[: len(x.ids) - x.n_tail + len(x.before)], y.ids[y.n_head - len(y.after) :]
        if len(both) < len(left) + len(right) or not (both.startswith(left) and both.endswith(right)):
            return None
        return both[len(left) - len(x.before) : len(both) - len(right) + len(y.after)]

    def encode_all(self, texts: list[str]) -> Iterator[tuple[bytes, bytes]]:
        """For each text its ids as little-endian 32-bit integers, and its decoded text in UTF-8."""
        split = [chunks(x) for x in texts]
        self.fill(x for p in split for x in p)
        self.reused += sum(map(len, split))
        # A join is damaged only if there is no white space on either side of it.
        joins = dict.fromkeys((a, b) for p in split for a, b in zip(p, p[1:]) if a[-1] not in _SPACES and b[0] not in _SPACES)
        self.repaired += len(joins)
        found = self.library([(self.store[a].tail + self.store[b].head).decode() for a, b in joins])
        for (a, b), ids in zip(list(joins), found, strict=True):
            x, y = self.store[a].before, self.store[b].after
            agree = len(ids) >= len(x) + len(y) and ids.startswith(x) and ids.endswith(y)
            joins[a, b] = ids if agree else self.widen(a, b)
        for text, p in zip(texts, split, strict=True):
            ids, decoded, skip, skip_text = [], [], 0, 0
            for a, b in zip(p, [*p[1:], None]):
                x = self.store[a]
                if (a, b) not in joins:
                    ids.append(x.ids[skip:])
                    decoded.append(x.text[skip_text:])
                    skip = skip_text = 0
                    continue
                middle = joins[a, b]
                if middle is None:
                    ids = self.library([text])
                    decoded = [self.decoded(ids[0])]
                    break
                cut = len(x.ids) - x.n_tail
                ids += [x.ids[skip:cut], middle]
                decoded += [x.text[skip_text : len(x.text) - len(self.decoded(x.ids[cut:]))], self.decoded(middle)]
                y = self.store[b]
                skip, skip_text = y.n_head, len(self.decoded(y.ids[: y.n_head]))
            yield b"".join(ids), b"".join(decoded)[:-1]

    def verify(self) -> None:
        """Refuse vocabularies for which words, taken alone, don't give a text's tokens."""
        rng = random.Random(1)
        some = ["a", "B", "é", "E\u0301", " ", "\n", "\t ", "'s", "'", "12", ".", "!!", "_", "<|endoftext|>", "<|", "ß", "中", "\u3000", "\u00a0", "İ", "Σ", "…", "abc", "THE", "ing"]
        for _ in range(300):
            text = "".join(rng.choice(some) for _ in range(rng.randint(1, 30)))
            ids = self.library([text])[0]
            alone = b"".join(self.library([w.decode() for w in words(text)]))
            plain = self.tokenizer.decode(list(unpack(f"<{len(ids) // 4}I", ids)), skip_special_tokens=False)
            if alone != ids or self.decoded(ids)[:-1] != plain.encode():
                raise ValueError("tokens of this vocabulary depend on what stands beyond white space")


class Chunk(NamedTuple):
    """A chunk encoded alone; ids as little-endian 32-bit integers, counts in bytes of these."""

    ids: bytes
    text: bytes  # decoded, with the space after the last token
    head: bytes  # the first two words
    tail: bytes  # the last two words
    n_head: int
    n_tail: int
    after: bytes  # ids of the second word, which no join can touch
    before: bytes  # ids of the last word but one


@functools.cache
def _encoder(path: str) -> Encoder:
    """One for each Python worker, kept from task to task, until another operator begins there."""
    return Encoder(path)


@functools.cache
def _verified(path: str) -> str:
    Encoder(path).verify()
    return path


def encode(docs: DataFrame, path: str | None = None, ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (unless not wanted), and digests of ids and decoded text for each document."""
    path = _verified(path or vocabulary())
    out = schema("doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids)

    def run(batches):
        begin("bpe", _encoder.cache_clear)
        gc.disable()  # nothing here makes cycles, and collections would walk the stores again and again
        encoder = _encoder(path)
        for rows in pieces(batches, BATCH_BYTES, "doc_id", "text"):
            found = {"doc_id": [r[0] for r in rows], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            raw = []
            for b, decoded in encoder.encode_all([r[1] for r in rows]):
                found["n_tokens"].append(len(b) // 4)
                found["ids_sha256"].append(hashlib.sha256(b).hexdigest())
                found["decoded_sha256"].append(hashlib.sha256(decoded).hexdigest())
                raw.append(b)
            cols = [pa.array(found["doc_id"], pa.int64()), pa.array(found["n_tokens"], pa.int64()), pa.array(found["ids_sha256"]), pa.array(found["decoded_sha256"])]
            if ids:
                ends = np.cumsum([0, *found["n_tokens"]]).astype(np.int32)
                cols.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(raw), "<i4"))))
            yield pa.RecordBatch.from_arrays(cols, out.names)

    return text_of(docs).mapInArrow(run, out)
