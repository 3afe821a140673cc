"""Removal of long repeats by distributed prefix doubling.

A suffix array by prefix doubling ranks all positions by their first 1, 2, 4,
... symbols; positions whose rank is unique drop out, and doubling ends at the
threshold. Two observations make that affordable for large inputs:

* Only some positions have to be carried. Of the ``min_len - k + 1`` strings of
  k symbols that begin in a window of ``min_len``, the one with the least hash
  (the leftmost of equals) is the window's anchor. Equal windows have equal
  anchors at equal offsets, so a window is a repeat only if its anchor's k
  symbols are. Runs of windows with one anchor make one row.
* A rank only has to be equal where prefixes are equal and different where
  they aren't, so a fingerprint of the prefix serves as the rank, and no round
  needs a global order. Spark sorts or hashes (rank, offset) pairs to find the
  equal ones.

Rounds, at growing lengths: first k symbols (the anchor; unique ones drop out)
together with the whole stretch that the run's windows cover (if it is
repeated, all the run's windows are, and they are settled); then, for what is
left, groups of ``GROUP`` neighbouring windows by the symbols that all of them
share (unique: dropped) and by the symbols that any of them has (repeated:
settled); last, single windows. Ranks that settle anything have 128 bits.

There are two kinds of symbols, and both go through the same rounds at once:

* Bytes (``min_bytes``): a window is a repeat if it stands anywhere else, the
  same document included.
* Words (``min_words``), each by a hash of 64 bits: a window is a repeat if it
  stands in another document, whatever white space lies between the words. This
  is what finds passages of over 50 words, many of which have under 400 bytes.

Defined results: texts are taken as UTF-8, null as empty; matches never cross
documents; rows that repeat a text remove each other wholly by bytes, and are
one document by words if they repeat the id, too; texts under the threshold
stay; every row gets a row; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import begin, byte_table, discard, hashed_words, kept, keyed, materialize, schema, sliced, sweep, temporary, window_hashes, word_hashes_of

MIN_BYTES, MIN_WORDS, GROUP, BLOCK = 400, 51, 16, 1 << 18
BYTES, WORDS = 0, 1  # kinds of symbols
WIDTH = (1, 8)  # bytes of a symbol, by kind
_RANK = "r1 long, r2 long"


def anchor_size(min_len: int) -> int:
    """k: about a third of the threshold. Anchors are then one in about a third of the threshold, too."""
    return max(1, min_len * 8 // 25)


def _digests(parts: list[bytes]) -> np.ndarray:
    import xxhash

    return np.frombuffer(b"".join([xxhash.xxh3_128_digest(x) for x in parts]), "<i8").reshape(-1, 2)


def _windows(texts: list[np.ndarray], min_len: int, block: int = BLOCK):
    """Blocks of whole texts, or of stretches of long ones: (symbols, [(text's number, its offset, start, end in the block)])."""
    held, used, spans = [], 0, []
    for i, text in enumerate(texts):
        if len(text) < min_len:
            continue
        for at in range(0, len(text) - min_len + 1, block):
            part = text[at : at + block + min_len - 1]
            if used and used + len(part) > block + min_len:
                yield np.concatenate(held), spans
                held, used, spans = [], 0, []
            held.append(part)
            spans.append((i, at, used, used + len(part)))
            used += len(part)
    if held:
        yield np.concatenate(held), spans


_TABLE = byte_table(20)


def runs(texts: list[np.ndarray], min_len: int, block: int = BLOCK):
    """Runs of windows with one anchor: (text's number, first window, last window, anchor, anchor's hash) as arrays, by block.

    ``texts``: arrays of bytes, or of words' hashes.
    """
    k = anchor_size(min_len)
    for data, spans in _windows(texts, min_len, block):
        h = window_hashes(_TABLE[data] if data.dtype == np.uint8 else data, k)
        key = (h & ~np.uint64(0xFFFFFF)) | np.arange(len(h), dtype=np.uint64)  # least hash, then leftmost
        w, length = min_len - k + 1, 1
        while length * 2 <= w:
            key = np.minimum(key[:-length], key[length:])
            length *= 2
        if length < w:
            key = np.minimum(key[: len(key) - (w - length)], key[w - length :])
        anchor = (key & np.uint64(0xFFFFFF)).astype(np.int64)  # of the window at each place
        number = np.full(len(anchor), -1, np.int64)
        for j, (_, _, a, b) in enumerate(spans):
            number[a : b - min_len + 1] = j
        edge = np.flatnonzero((np.diff(anchor) != 0) | (np.diff(number) != 0)) + 1
        first = np.concatenate([[0], edge])
        last = np.concatenate([edge, [len(anchor)]]) - 1
        inside = number[first] >= 0
        first, last = first[inside], last[inside]
        j = number[first]
        where = np.array([(i, at - a) for i, at, a, _ in spans], np.int64)
        yield where[j, 0], first + where[j, 1], last + where[j, 1], anchor[first] + where[j, 1], h[anchor[first]].view(np.int64)


def _symbols(texts: list[bytes], kind: int) -> tuple[list[np.ndarray], list[bytes]]:
    """Each text as an array of symbols, and the same as bytes."""
    if kind == BYTES:
        return [np.frombuffer(t, np.uint8) for t in texts], texts
    words = word_hashes_of(texts)
    return words, [w.tobytes() for w in words]


def _anchors(batches, least: dict[int, int], out):
    begin("suffix dedup")
    for batch in sliced(batches, 128):
        ids, ths, texts = batch.column("doc_id"), batch.column("th"), batch.column("text").cast(pa.binary()).to_pylist()
        for kind, min_len in least.items():
            w = WIDTH[kind]
            arrays, raw = _symbols(texts, kind)
            for i, first, last, anchor, h in runs(arrays, min_len):
                d = _digests([raw[n][w * a : w * (b + min_len)] for n, a, b in zip(i.tolist(), first.tolist(), last.tolist(), strict=True)])
                # The place of the anchor within the run belongs to the rank: equal runs have equal offsets.
                tag = (anchor - first) * np.int64(0x9E3779B1)
                kinds = np.full(len(i), kind, np.int8)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(i)), ths.take(pa.array(i)), *[pa.array(x) for x in (kinds, first, (last - first).astype(np.int32), (anchor - first).astype(np.int32), h, d[:, 0] ^ tag, d[:, 1])]], out.names)


def _stretches(batches, least: dict[int, int], out):
    """The symbols that the listed runs cover, cut out of the texts."""
    types = [pa.int64()] * 2 + [pa.int8(), pa.int64()] + [pa.int32()] * 2 + [pa.int64(), pa.binary()]
    for batch in sliced(batches, 32):
        for r in batch.to_pylist():
            text, symbols, rows = r["text"].encode(), {}, []
            for x in r["runs"]:
                if x["kind"] not in symbols:
                    symbols[x["kind"]] = text if x["kind"] == BYTES else hashed_words(text)[2].tobytes()
                w = WIDTH[x["kind"]]
                rows.append((r["doc_id"], r["th"], x["kind"], x["first"], x["n"], x["at"], x["g"], symbols[x["kind"]][w * x["first"] : w * (x["first"] + x["n"] + least[x["kind"]])]))
            for a in range(0, len(rows), 4096):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[a : a + 4096], strict=True), types, strict=True)], out.names)


def _groups(batches, least: dict[int, int], out):
    """Groups of neighbouring windows, by their distance to the anchor: ranks of what all share, and of what any has.

    A run that has a group only in part still has all that the group's windows share, but no rank of the whole.
    """
    types = [pa.int64()] * 2 + [pa.int8(), pa.int64(), pa.int32(), pa.int64()] + [pa.int32()] * 3 + [pa.int64()] * 2
    for batch in sliced(batches, 256):
        rows, shared, united = [], [], []
        for r in batch.to_pylist():
            s, at, n, w, min_len = r["symbols"], r["at"], r["n"], WIDTH[r["kind"]], least[r["kind"]]
            # Window i of the run begins at - i symbols before the anchor.
            for c in range((at - n) // GROUP, at // GROUP + 1):
                far, near = c * GROUP + GROUP - 1, c * GROUP
                shared.append(s[w * (at - near) : w * max(at - near, at - far + min_len)])
                whole = far <= at and near >= at - n
                if whole:
                    united.append(s[w * (at - far) : w * (at - near + min_len)])
                rows.append((r["doc_id"], r["th"], r["kind"], r["first"], at, r["g"], c, min(far, at), max(near, at - n), whole))
        if rows:
            c, u = _digests(shared), iter(_digests(united).tolist() if united else ())
            ranks = [next(u) if r[-1] else (None, None) for r in rows]
            cols = [list(x) for x in zip(*[(*r[:-1], *k) for r, k in zip(rows, ranks, strict=True)], strict=True)]
            yield pa.RecordBatch.from_arrays([*[pa.array(x, t) for x, t in zip(cols, types, strict=True)], pa.array(c[:, 0]), pa.array(c[:, 1])], out.names)


def _singles(batches, least: dict[int, int], out):
    for batch in sliced(batches, 256):
        rows, parts = [], []
        for r in batch.to_pylist():
            s, at, w, min_len = r["symbols"], r["at"], WIDTH[r["kind"]], least[r["kind"]]
            for x in r["groups"]:
                for off in range(x["near"], x["far"] + 1):
                    rows.append((r["doc_id"], r["th"], r["kind"], r["first"] + at - off))
                    parts.append(s[w * (at - off) : w * (at - off + min_len)])
        if rows:
            d = _digests(parts)
            cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64(), pa.int64(), pa.int8(), pa.int64()], strict=True)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(d[:, 0]), pa.array(d[:, 1])], out.names)


def _shared(rows: DataFrame, key: list[str]) -> DataFrame:
    """The keys that stand twice or more.

    They are aggregated before they are shuffled, so a frequent one is no burden, and written before rows
    are joined with them: adaptive execution can split a frequent key's rows only then.
    """
    return materialize(rows.groupBy(*key).agg(F.count("*").alias("copies")).filter("copies > 1").drop("copies"), "shared")


def _repeated(rows: DataFrame, key: list[str], *one: str) -> DataFrame:
    """The keys that are repeats, by the rule of their kind, with copies of them as ``xs``: columns ``one`` of two copies, from two documents where there are two."""
    row = F.struct("doc_id", "th", *one)
    found = rows.groupBy(*key).agg(F.count("*").alias("copies"), F.min("kind").alias("kind"), F.min(row).alias("lo"), F.max(row).alias("hi"))
    elsewhere = ~(F.col("lo.doc_id").eqNullSafe(F.col("hi.doc_id")) & (F.col("lo.th") == F.col("hi.th")))
    found = found.filter((F.col("copies") > 1) & ((F.col("kind") == BYTES) | elsewhere))
    # Any copy will do as a partner by bytes; by words, at least one copy must be of another document than the partner's.
    return materialize(found.select(*key, "kind", F.when(F.col("kind") == BYTES, F.array("lo")).otherwise(F.array("lo", "hi")).alias("xs")), "repeated")


def _partners(repeated: DataFrame, among: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Copies of what is settled that may still be partners: those with a key that something open has, too."""
    rows = repeated.join(materialize(among.select(*key).distinct(), "contested"), key, "left_semi")
    return rows.select("*", F.explode("xs").alias("x")).select(*[f"x.{c}" if c not in (*key, "kind") else c for c in columns])


def repeated_spans(docs: DataFrame, min_bytes: int | None = MIN_BYTES, min_words: int | None = None) -> DataFrame:
    """doc_id, th, kind, first, last: windows first to last of a document are repeats. ``docs``: doc_id, text, th."""
    least = {k: n for k, n in ((BYTES, min_bytes), (WORDS, min_words)) if n is not None}
    cols = "doc_id long, th long, kind byte, first long, n int, at int, g long"
    a = schema(f"{cols}, {_RANK}")
    anchors = materialize(docs.mapInArrow(lambda b: _anchors(b, least, a), a), "anchors")
    twice = _shared(anchors, ["g"])
    shared = materialize(anchors.join(twice, "g", "left_semi"), "shared")
    discard(anchors, twice)
    sweep(docs.sparkSession)
    span = "doc_id", "th", "kind", "first"
    if shared.isEmpty():
        return shared.select(*span, F.col("first").alias("last"))
    rank = ["r1", "r2", "g"]
    whole = _repeated(shared, rank, "first", "n", "at")
    names = ["doc_id", "th", "kind", "first", "n", "at", "g"]
    ranked = materialize(shared.join(whole.select(*rank, F.lit(True).alias("settled")), rank, "left").select(*names, F.coalesce("settled", F.lit(False)).alias("settled")), "ranked")
    settled = ranked.filter("settled").select("doc_id", "th", "kind", "first", (F.col("first") + F.col("n")).alias("last"))
    open_runs = ranked.filter("not settled").drop("settled")
    if open_runs.isEmpty():
        return settled
    # Copies of each whole stretch stand for its settled runs among those still open: they are partners, too.
    todo = open_runs.unionByName(_partners(whole, open_runs, ["g"], names))
    by_doc = materialize(todo.groupBy("doc_id", "th").agg(F.collect_list(F.struct("kind", "first", "n", "at", "g")).alias("runs")), "open")
    discard(shared, whole)
    sweep(docs.sparkSession)
    texts = docs.select(F.col("doc_id").alias("d"), F.col("th").alias("t"), "text")
    # A merge join at every size, as below: at scale the list of documents is too large to send to all.
    found = by_doc.hint("merge").join(texts, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t"))).dropDuplicates(["doc_id", "th"])
    s = schema(f"{cols}, symbols binary")
    stretches = materialize(found.select("doc_id", "th", "runs", "text").mapInArrow(lambda b: _stretches(b, least, s), s), "stretches")
    discard(by_doc)
    g = schema("doc_id long, th long, kind byte, first long, at int, g long, c int, far int, near int, u1 long, u2 long, c1 long, c2 long")
    groups = materialize(stretches.mapInArrow(lambda b: _groups(b, least, g), g), "groups")
    key = ["g", "c", "c1", "c2"]
    common = materialize(groups.join(_shared(groups, key), key, "left_semi"), "common")
    discard(groups)
    sweep(docs.sparkSession)
    rank = ["g", "c", "u1", "u2"]
    # Where the symbols that any window has are equal, so are those that all share: each such group is in ``common``.
    united = _repeated(common.filter("u1 is not null"), rank, "first", "far", "near")
    names = ["doc_id", "th", "kind", "first", "far", "near", "g", "c"]
    first = F.col("first") + F.col("at")
    ranked = materialize(common.join(united.select(*rank, F.lit(True).alias("settled")), rank, "left").select(*names, "at", F.coalesce("settled", F.lit(False)).alias("settled")), "ranked")
    settled_groups = ranked.filter("settled").select("doc_id", "th", "kind", (first - F.col("far")).alias("first"), (first - F.col("near")).alias("last"))
    # Copies of each settled group take part in the last round, as partners of windows in groups that aren't settled.
    unsettled = ranked.filter("not settled").select(*names)
    if unsettled.isEmpty():
        return settled.unionByName(settled_groups)
    rest = unsettled.unionByName(_partners(united, unsettled, ["g", "c"], names)).groupBy("doc_id", "th", "kind", "first").agg(F.collect_list(F.struct("far", "near")).alias("groups"))
    rest = rest.select(F.col("doc_id").alias("d"), F.col("th").alias("t"), F.col("kind").alias("k"), F.col("first").alias("f"), "groups")
    on = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")) & (F.col("kind") == F.col("k")) & (F.col("first") == F.col("f"))
    w = schema(f"doc_id long, th long, kind byte, first long, {_RANK}")
    windows = materialize(stretches.join(rest, on).select("doc_id", "th", "kind", "first", "at", "symbols", "groups").mapInArrow(lambda b: _singles(b, least, w), w), "windows")
    discard(stretches)
    singles = windows.join(_repeated(windows, ["r1", "r2"]), ["r1", "r2"], "left_semi").select("doc_id", "th", "kind", "first", F.col("first").alias("last"))
    return settled.unionByName(settled_groups).unionByName(singles)


def covered(spans: list[tuple[int, int]], min_len: int) -> list[tuple[int, int]]:
    """Maximal runs of symbols (start, end) that windows first to last of the spans cover."""
    out: list[list[int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], last + min_len)
        else:
            out.append([first, last + min_len])
    return [(a, b) for a, b in out]


def _with_spans(docs: DataFrame, *least: int | None) -> DataFrame:
    """``docs`` (with doc_id, th, text) and each one's spans, an array of (kind, first, last), null without any."""
    with temporary() as written:
        spans = repeated_spans(docs.select("doc_id", "text", "th"), *least).groupBy("doc_id", "th").agg(F.collect_set(F.struct("kind", "first", "last")).alias("spans"))
        spans = kept(materialize(spans, "spans"), written).select(F.col("doc_id").alias("__d"), F.col("th").alias("__t"), "spans")
    sweep(docs.sparkSession)
    return docs.join(spans.hint("merge"), docs["doc_id"].eqNullSafe(F.col("__d")) & (docs["th"] == F.col("__t")), "left").drop("__d", "__t")


def _cuts(spans: list[dict] | None, kind: int, min_len: int | None) -> list[tuple[int, int]]:
    return covered([(x["first"], x["last"]) for x in spans if x["kind"] == kind], min_len) if spans and min_len is not None else []


def remove(docs: DataFrame, min_bytes: int = MIN_BYTES, min_words: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the bytes that are left by ``min_bytes``) of each document.

    With ``min_words`` also n_passages and n_passage_words: maximal runs of words that repeat in other documents, and their words.
    """
    out = schema("doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary" + ", n_passages long, n_passage_words long" * (min_words is not None))

    def run(batches):
        for batch in sliced(batches, 256):
            ids, texts, spans = batch.column("doc_id"), batch.column("text").cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist()
            n, gone, pieces, digests, left, passages, words = [], [], [], [], [], [], []
            for text, s in zip(texts, spans, strict=True):
                cut = _cuts(s, BYTES, min_bytes)
                kept = text
                if cut:
                    edges = [0, *[e for c in cut for e in c], len(text)]
                    kept = b"".join([text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)])
                n.append(len(text))
                gone.append(len(text) - len(kept))
                pieces.append(len(cut))
                digests.append(hashlib.sha256(kept).hexdigest())
                left.append(kept)
                found = _cuts(s, WORDS, min_words)
                passages.append(len(found))
                words.append(sum(b - a for a, b in found))
            cols = [ids, pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(pieces, pa.int64()), pa.array(digests, pa.string()), pa.array(left, pa.binary()), pa.array(passages, pa.int64()), pa.array(words, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols[: len(out)], out.names)

    return _with_spans(keyed(docs), min_bytes, min_words).select("doc_id", "text", "spans").mapInArrow(run, out)


def cut_text(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the characters that lie wholly in the given byte runs."""
    b, out, last = text.encode(), [], 0
    for start, end in spans:
        while start < end and b[start] & 0xC0 == 0x80:  # the first byte of the character isn't covered
            start += 1
        while end > start and end < len(b) and b[end] & 0xC0 == 0x80:
            end -= 1
        out.append(b[last:start])
        last = end
    return b"".join([*out, b[last:]]).decode()


def _without(text: str, spans: list[dict], min_bytes: int | None, min_words: int | None) -> str:
    cut = _cuts(spans, BYTES, min_bytes)
    if found := _cuts(spans, WORDS, min_words):
        starts, ends, _ = hashed_words(text.encode())
        cut = covered(cut + [(int(starts[a]), int(ends[b - 1])) for a, b in found], 0)
    return cut_text(text, cut)


def strip(docs: DataFrame, min_bytes: int | None = MIN_BYTES, min_words: int | None = None) -> DataFrame:
    """The rows of a documents table with the repeats taken out of their texts, and n_chars to match.

    A passage goes from its first word's start to its last word's end. Characters that are only partly covered by
    bytes stay, as a text can't hold a part of one.
    """
    own = docs.schema
    names = [f"__c{i}" for i in range(len(own))]
    renamed = docs.toDF(*names)
    text, doc_id = names[own.names.index("text")], names[own.names.index("doc_id")]
    keys = renamed.withColumns({"doc_id": F.col(doc_id).cast("long"), "text": F.coalesce(F.col(text), F.lit("")), "th": F.xxhash64(F.coalesce(F.col(text), F.lit("")))})
    found = _with_spans(keys, min_bytes, min_words).select(*names, "spans")

    def run(batches):
        for batch in sliced(batches, 256):
            texts, spans = batch.column(text).to_pylist(), batch.column("spans").to_pylist()
            kept = [t if not s else _without(t, s, min_bytes, min_words) for t, s in zip(texts, spans, strict=True)]
            cols = {c: batch.column(c) for c in names} | {text: pa.array(kept, pa.string())}
            if "n_chars" in own.names:
                i = names[own.names.index("n_chars")]
                cols[i] = pa.array([len(a) if b else c for a, b, c in zip(kept, spans, cols[i].to_pylist(), strict=True)], cols[i].type)
            yield pa.RecordBatch.from_arrays([cols[c] for c in names], own.names)

    return found.mapInArrow(run, own)
