"""Exact near-duplicate components by an n-gram Jaccard join with prefix filtering.

1. Each text becomes the set of hashes (64 bits) of its 5-word shingles. Equal
   sets form a class; a class takes part once, whatever its number of copies.
2. Tokens are put in one order for all: rare first, by the number of sets that
   have them. Two sets that are similar enough share a token among the first
   ``n - ceil(t n) + 1`` of either, so a set with that many tokens of its own
   has no partner. This is found twice. First over all sets with a part of
   their tokens (those under a bound of their hash, or all if they are few):
   most sets have enough tokens of their own among these and leave. A token is
   a set's own only if no set that it can be linked with has it, so sets in
   reach of one that counts all its tokens post all of theirs, too. Then over
   those that are left with all their tokens, which gives the prefixes.
   Tokens are dealt into bins as bytes and counted over all documents there.
3. Sets with a common prefix token are candidates, subject to the length filter
   and the positional filter; each pair is verified once, first by the suffix
   filter (the difference of the sets' counts in ``PARTS`` parts of the hash
   space bounds their symmetric difference), then exactly.
4. Only components are wanted, so pairs inside a component needn't be looked
   at. A few rounds take ``FEW`` tokens of each prefix and pair the members of
   a token's list with ``PIVOTS`` members that all have in common; after that,
   all pairs of all prefix tokens that stand in different components are
   verified, without exception. A large group of near copies costs a multiple
   of its size and not its square, as long as its members are linked with one
   another; links are never capped.

Defined results: only A-Z are lower-cased; texts without words (or null) have
the empty set, 0 shingles, and are their own component; with under 5 words the
whole sequence is one shingle; the component is the smallest doc_id, ids that
are null don't count (a component without ids has null); every row gets a row.
Only doc_id and text are read. Sets are compared by digests of 128 bits, of
which 64 name a set; different sets of one name are given other names.
"""

from __future__ import annotations

import math
import tempfile
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import begin, byte_table, keyed, materialize, mix64, partitions, pieces, schema, sliced
from .components import stars

WORDS, PERCENT, COUNTED, SMALL, FEW, PIVOTS, ROUNDS, PARTS = 5, 75, 0.36, 64, 5, 5, 6, 16
BIN_ROWS, BATCH_BYTES, BLOCK_TOKENS = 400_000, 1 << 19, 1 << 17
WITNESS = 0  # the id of the empty set, which has no tokens, in postings that aren't counted for their set
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_PLACES = byte_table(77)[:64]


@cache
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    def powers(x: int) -> np.ndarray:
        out = np.full(1 << bits, x, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return powers(_BASE), powers(pow(_BASE, -1, 1 << 64))


_TABLE = byte_table(5)


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words, from sums of prefixes: a word's hash doesn't depend on its place."""
    x = np.frombuffer(data, np.uint8)
    gap = _SPACE[x]
    edge = np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = _powers(max(20, len(x).bit_length()))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_TABLE[x] * up[: len(x)], dtype=np.uint64)])
    return starts, mix64((sums[ends] - sums[starts]) * down[starts])


def shingle_sets(texts: list[bytes], k: int = WORDS) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes."""
    if not texts:
        return []
    data = b"\n".join(texts).lower()
    starts, h = word_hashes(data)
    begins = np.cumsum([0, *[len(t) + 1 for t in texts]])
    at = np.searchsorted(starts, begins)
    n = max(0, len(h) - k + 1)
    s = np.zeros(n, np.uint64)
    for j in range(k):
        s += h[j : j + n] * _PLACES[j]
    s = mix64(s)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(s[a : b - k + 1]))
        elif b > a:
            whole = (h[a:b] * _PLACES[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(mix64(np.array([whole], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_ids(s: np.ndarray, bits: int = 64) -> tuple[int, int]:
    """Both halves of a set's digest of 128 bits. The first names the set, the second tells apart two sets of one name. ``bits``: of the name, fewer in tests."""
    import xxhash

    if not len(s):
        return 0, 0
    a, b = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), "<i8").tolist()
    return (a if bits == 64 else a % (1 << bits) + 1), b


def other_id(first: int, second: int) -> int:
    """The name of a set whose first name another set has, too."""
    return int(mix64(np.array([(first * 3 + second) % (1 << 64)], np.uint64)).view(np.int64)[0])


def prefix(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def overlap(total: int, percent: int = PERCENT) -> int:
    """Common tokens that two sets with this many tokens together need."""
    return -(-percent * total // (100 + percent))


def _bound(counted: float) -> np.uint64:
    return np.uint64(int(counted * 2**64))


def _counted(s: np.ndarray, bound: np.uint64) -> np.ndarray:
    return s if len(s) <= SMALL else s[: int(np.searchsorted(s, bound))]


def _reach(percent: int) -> int:
    """The size of the largest set that a set of ``SMALL`` tokens can be linked with."""
    return SMALL * 100 // percent


def _witness(s: np.ndarray, bound: np.uint64, reach: int) -> np.ndarray:
    """The tokens of a set that aren't counted for it, but that small sets, which count all theirs, can share with it."""
    return s[int(np.searchsorted(s, bound)) :] if SMALL < len(s) <= reach else s[:0]


def _profile(batches, out, counted: float, k: int, bits: int):
    """A row for each document: its set's two ids and size, and how many of its tokens are counted first."""
    begin("n-gram join", _powers.cache_clear)
    bound = _bound(counted)
    for rows in pieces(batches, BATCH_BYTES, "doc_id", "th", "text"):
        sets = shingle_sets([r[2].encode() for r in rows], k)
        ids = [set_ids(s, bits) for s in sets]
        cols = [[r[0] for r in rows], [r[1] for r in rows], [i for i, _ in ids], [i for _, i in ids], [len(s) for s in sets], [len(_counted(s, bound)) for s in sets]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 4 + [pa.int32()] * 2, strict=True)], out.names)


def _binned(ids: list[int], toks: list[np.ndarray], bins: int, names: list[str]) -> pa.RecordBatch:
    """A row for each bin: the tokens as bytes, and ids of sets with their numbers of tokens."""
    tok, doc = np.concatenate(toks), np.repeat(np.arange(len(ids)), [len(x) for x in toks])
    where = (tok % np.uint64(bins)).astype(np.int64)
    order = np.argsort(where, kind="stable")  # by bin, within it by document
    tok, doc, where = tok[order], doc[order], where[order]
    all_ids = np.array(ids, np.int64)
    cut = np.concatenate([[0], np.flatnonzero(np.diff(where)) + 1, [len(where)]])
    cols = [[], [], [], []]
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        d = doc[a:b]
        first = np.concatenate([[0], np.flatnonzero(np.diff(d)) + 1])
        cols[0].append(int(where[a]))
        cols[1].append(tok[a:b].tobytes())
        cols[2].append(all_ids[d[first]].tobytes())
        cols[3].append(np.diff(np.concatenate([first, [b - a]])).astype("<u4").tobytes())
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *[pa.array(c, pa.binary()) for c in cols[1:]]], names)


def _post_texts(batches, out, counted: float, k: int, bins: int, percent: int, bits: int):
    """The tokens that are counted first, and those of witnesses; a set that stands in a task again is left out."""
    begin("n-gram join", _powers.cache_clear)
    bound, reach, seen = _bound(counted), _reach(percent), set()
    for rows in pieces(batches, BATCH_BYTES, "odd", "text"):
        toks, ids = [], []
        for (odd, _), s in zip(rows, shingle_sets([r[1].encode() for r in rows], k), strict=True):
            pair = set_ids(s, bits)
            if len(s) and (i := other_id(*pair) if odd else pair[0]) not in seen:
                if len(seen) < 1_000_000:
                    seen.add(i)
                toks.append(_counted(s, bound))
                ids.append(i)
                if len(more := _witness(s, bound, reach)):
                    toks.append(more)
                    ids.append(WITNESS)
        if toks and sum(map(len, toks)):
            yield _binned(ids, toks, bins, out.names)


def _post_sets(batches, out, bins: int):
    for rows in pieces(batches, 4 << 20, "rid", "set"):
        yield _binned([r[0] for r in rows], [np.frombuffer(r[1], np.uint64) for r in rows], bins, out.names)


def _numbers(toks: bytes, ids: bytes, sizes: bytes) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, np.int64)
    return np.frombuffer(toks, np.uint64), np.repeat(i, np.frombuffer(sizes, "<u4"))


def _merge(values: np.ndarray, counts: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    v, c = np.unique(new, return_counts=True)
    if not len(values):
        return v, c
    both = np.concatenate([values, v])
    out, at = np.unique(both, return_inverse=True)
    return out, np.bincount(at, np.concatenate([counts, c])).astype(np.int64)


def _shared(batches, out, tokens: bool, bins: int, flush: int = 200_000):
    """Of a bin's postings, those with a token that two sets or more have, packed for the sets' own bins.

    A row has ids of sets with their numbers of such tokens, and if wanted the
    tokens with their numbers of postings. Memory holds the bin's different
    tokens; the postings wait in a temporary file, so a token of a great many
    documents takes no more than any other.
    """
    values, counts, held, waiting = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0
    with tempfile.SpooledTemporaryFile(max_size=8 << 20) as spool:
        for batch in batches:
            for toks, ids, sizes in zip(*(batch.column(c).to_pylist() for c in ("toks", "ids", "sizes")), strict=True):
                spool.write(np.array([len(toks), len(ids), len(sizes)], np.int64).tobytes() + toks + ids + sizes)
                held.append(np.frombuffer(toks, np.uint64))
                waiting += len(held[-1])
                if waiting >= flush:
                    values, counts = _merge(values, counts, np.concatenate(held))
                    held, waiting = [], 0
        if held:
            values, counts = _merge(values, counts, np.concatenate(held))
        twice = counts > 1
        values, counts = values[twice], counts[twice]
        spool.seek(0)
        hits, n = [], 0
        while len(values) and (head := spool.read(24)):
            a, b, c = np.frombuffer(head, np.int64).tolist()
            tok, doc = _numbers(spool.read(a), spool.read(b), spool.read(c))
            at = np.searchsorted(values, tok)
            at[at == len(values)] = 0
            hit = (values[at] == tok) & (doc != WITNESS)
            hits.append((doc[hit], tok[hit], counts[at[hit]]))
            n += int(hit.sum())
            if n >= flush:
                yield from _packed(hits, tokens, bins, out.names)
                hits, n = [], 0
        if n:
            yield from _packed(hits, tokens, bins, out.names)


def _packed(hits: list, tokens: bool, bins: int, names: list[str]):
    doc, tok, df = (np.concatenate(x) for x in zip(*hits, strict=True))
    where = (doc.view(np.uint64) % np.uint64(bins)).astype(np.int64)
    order = np.lexsort((doc, where))
    doc, tok, df, where = doc[order], tok[order], df[order], where[order]
    cut = np.concatenate([[0], np.flatnonzero(np.diff(where)) + 1, [len(where)]])
    cols = [[], [], [], [], []]
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        ids, sizes = np.unique(doc[a:b], return_counts=True)
        row = (int(where[a]), ids.tobytes(), sizes.astype("<u4").tobytes(), tok[a:b].tobytes() if tokens else None, np.minimum(df[a:b], 2**32 - 1).astype("<u4").tobytes() if tokens else None)
        for c, v in zip(cols, row, strict=True):
            c.append(v)
    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *[pa.array(c, pa.binary()) for c in cols[1:]]], names)


def _sums(batches, out):
    """Sets with their numbers of shared tokens, from all the bins of tokens."""
    ids, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        for i, n in zip(batch.column("ids").to_pylist(), batch.column("sizes").to_pylist(), strict=True):
            both, at = np.unique(np.concatenate([ids, np.frombuffer(i, np.int64)]), return_inverse=True)
            ids, sums = both, np.bincount(at, np.concatenate([sums, np.frombuffer(n, "<u4")]), len(both)).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(sums)], out.names)


def _post_sizes(batches, out, bins: int):
    """The sizes of sets, packed like tokens: a row with no tokens, and sizes in the place of their numbers."""
    for batch in batches:
        ids, n = batch.column("rid").to_numpy(zero_copy_only=False), batch.column("n").to_numpy(zero_copy_only=False)
        where = (ids.view(np.uint64) % np.uint64(bins)).astype(np.int64)
        order = np.argsort(where, kind="stable")
        ids, n, where = ids[order], n[order], where[order]
        cut = np.concatenate([[0], np.flatnonzero(np.diff(where)) + 1, [len(where)]]) if len(ids) else np.zeros(1, int)
        rows = [(int(where[a]), ids[a:b].tobytes(), n[a:b].astype("<u4").tobytes()) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
        cols = [list(c) for c in zip(*rows, strict=True)] or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary()), *[pa.array([None] * len(rows), pa.binary())] * 2], out.names)


def _prefixes(batches, out, percent: int):
    """The shared tokens of each set's prefix with their places, rare first. A bin of sets holds all that its sets share."""
    got, known = [], []
    for batch in batches:
        for i, n, t, d in zip(*(batch.column(c).to_pylist() for c in ("ids", "sizes", "toks", "dfs")), strict=True):
            ids, n = np.frombuffer(i, np.int64), np.frombuffer(n, "<u4").astype(np.int64)
            if t is None:
                known.append((ids, n))
            else:
                got.append((np.repeat(ids, n), np.frombuffer(t, np.uint64), np.frombuffer(d, "<u4")))
    if not got:
        return
    ids, sizes = (np.concatenate(x) for x in zip(*known, strict=True))
    by_id = np.argsort(ids)
    ids, sizes = ids[by_id], sizes[by_id]
    doc, tok, df = (np.concatenate(x) for x in zip(*got, strict=True))
    order = np.lexsort((tok, df, doc))
    doc, tok = doc[order], tok[order]
    first = np.concatenate([[0], np.flatnonzero(np.diff(doc)) + 1])
    shared = np.diff(np.concatenate([first, [len(doc)]]))
    size = sizes[np.searchsorted(ids, doc[first])]
    place = np.arange(len(doc)) - np.repeat(first - (size - shared), shared)  # behind the tokens that are the set's own
    n = np.repeat(size, shared)
    keep = place < n + percent * -n // 100 + 1
    doc, tok, n, place = doc[keep], tok[keep], n[keep], place[keep]
    for at in range(0, len(doc), 100_000):
        part = slice(at, at + 100_000)
        yield pa.RecordBatch.from_arrays([pa.array(tok[part].view(np.int64)), pa.array(doc[part]), pa.array(n[part].astype(np.int32)), pa.array(place[part].astype(np.int32))], out.names)


def _sets(batches, out, k: int):
    for rows in pieces(batches, BATCH_BYTES, "rid", "text"):
        sets = shingle_sets([r[1].encode() for r in rows], k)
        parts = [np.bincount((s >> np.uint64(60)).astype(np.int64), minlength=PARTS).astype("<i4").tobytes() for s in sets]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array(parts, pa.binary())], out.names)


def _linked(batches, out, percent: int):
    """The pairs whose sets are similar enough."""
    for batch in sliced(batches, 256):
        keep = []
        for sa, sb, pa_, pb in zip(*(batch.column(c).to_pylist() for c in ("set_a", "set_b", "parts_a", "parts_b")), strict=True):
            total = (len(sa) + len(sb)) // 8
            need = overlap(total, percent)
            if int(np.abs(np.frombuffer(pa_, "<i4") - np.frombuffer(pb, "<i4")).sum()) > total - 2 * need:  # the suffix filter
                keep.append(False)
                continue
            x, y = np.frombuffer(sa, np.uint64), np.frombuffer(sb, np.uint64)
            at = np.searchsorted(y, x)
            at[at == len(y)] = 0
            common = int((y[at] == x).sum())
            keep.append(100 * common >= percent * (total - common))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], out.names).filter(pa.array(keep, pa.bool_()))


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    out = schema("a long, b long")
    one = sets.select(F.col("rid").alias("a"), F.col("set").alias("set_a"), F.col("parts").alias("parts_a"))
    two = sets.select(F.col("rid").alias("b"), F.col("set").alias("set_b"), F.col("parts").alias("parts_b"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "set_a", "set_b", "parts_a", "parts_b").mapInArrow(lambda x: _linked(x, out, percent), out)


def _possible(percent: int):
    """The length and positional filters on a common token: x is at place pos of n in one set, y in the other."""
    small, large = F.least("x.n", "y.n"), F.greatest("x.n", "y.n")
    need = F.ceil((F.col("x.n") + F.col("y.n")) * percent / F.lit(100 + percent))
    most = F.least("x.pos", "y.pos") + 1 + F.least(F.col("x.n") - F.col("x.pos") - 1, F.col("y.n") - F.col("y.pos") - 1)
    return (small * 100 >= large * percent) & (most >= need)


def _ordered(x: DataFrame) -> DataFrame:
    return x.select(F.least("x.rid", "y.rid").alias("a"), F.greatest("x.rid", "y.rid").alias("b")).filter("a <> b").distinct()


def _placed(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """The lists' rows with their components so far, and whether that is the list's largest."""
    rows = lists.join(labels.select(F.col("a").alias("rid"), F.col("b").alias("label")), "rid", "left").withColumn("comp", F.coalesce("label", "rid")).drop("label")
    rows = materialize(rows, "placed")
    main = rows.groupBy("token", "comp").agg(F.count("*").alias("m")).groupBy("token").agg(F.max_by("comp", F.struct("m", "comp")).alias("main"), F.count("*").alias("comps"))
    return rows.join(main.filter("comps > 1").drop("comps"), "token")


def links(docs: DataFrame, classes: DataFrame, k: int, percent: int, counted: float, bits: int = 64) -> DataFrame | None:
    """Stars (a, b) over the ids of sets: every set in a component of two or more, with the component's least id."""
    spark = docs.sparkSession
    need = F.col("n") - F.ceil(F.col("n") * percent / F.lit(100)) + 1
    binned = schema("bin int, toks binary, ids binary, sizes binary")

    def bins(postings: int | None) -> int:
        return max(partitions(spark), -(-int(postings or 0) // BIN_ROWS))

    n = bins(classes.agg(F.sum(F.when(F.col("n") <= _reach(percent), F.col("n")).otherwise(F.col("k")))).first()[0])
    posted = docs.select("odd", "text").mapInArrow(lambda b: _post_texts(b, binned, counted, k, n, percent, bits), binned).repartition(n, "bin")
    packed, c = schema("bin int, ids binary, sizes binary, toks binary, dfs binary"), schema("rid long, shared long")
    counts = posted.mapInArrow(lambda b: _shared(b, packed, False, n), packed).select("bin", "ids", "sizes").repartition(n, "bin").mapInArrow(lambda b: _sums(b, c), c)
    left = classes.join(counts.hint("merge"), "rid", "left").filter(F.col("k") - F.coalesce("shared", F.lit(0)) < need)
    left = materialize(left.select("rid", "n", F.col("rep.doc_id").alias("d"), F.col("rep.th").alias("t")), "left")
    s = schema("rid long, n int, set binary, parts binary")
    # A merge join at every size: at scale these ids are too many to send to all.
    texts = docs.join(left.hint("merge"), docs["doc_id"].eqNullSafe(F.col("d")) & (docs["th"] == F.col("t"))).select("rid", "text").dropDuplicates(["rid"])
    sets = materialize(texts.mapInArrow(lambda b: _sets(b, s, k), s), "sets")
    m = bins(sets.agg(F.sum("n")).first()[0])
    q = schema("token long, rid long, n int, pos int")
    shared = sets.select("rid", "set").mapInArrow(lambda b: _post_sets(b, binned, m), binned).repartition(m, "bin").mapInArrow(lambda b: _shared(b, packed, True, m), packed)
    # The sets' sizes go the same way as their tokens.
    sizes = sets.select("rid", "n").mapInArrow(lambda b: _post_sizes(b, packed, m), packed)
    lists = materialize(shared.unionByName(sizes).repartition(m, "bin").mapInArrow(lambda b: _prefixes(b, q, percent), q), "prefixes")
    several = lists.groupBy("token").agg(F.count("*").alias("m")).filter("m > 1")
    lists = materialize(lists.join(several.select("token"), "token", "left_semi"), "lists")
    # For the first rounds: the few tokens of each prefix that a hash puts first, which sets alike mostly have in common.
    some = lists.groupBy("rid").agg(F.slice(F.array_sort(F.collect_list(F.struct(F.xxhash64("token").alias("h"), "token", "n", "pos"))), 1, FEW).alias("few"))
    few = materialize(some.select("rid", F.explode("few").alias("x")).select("x.token", "rid", "x.n", "x.pos"), "few")

    def seeded(seed: int):
        return F.xxhash64(F.lit(seed), "rid")

    labels = done = strays = None
    for turn in range(ROUNDS):
        members = few if labels is None else _placed(few, labels)
        stray = members
        if labels is not None:
            stray = materialize(members.filter("comp <> main"), "stray")
            now = stray.select("rid").distinct().count()
            if now == 0 or (strays is not None and now * 4 > strays * 3):
                break
            strays = now
        pool = members if labels is None else members.filter("comp = main")
        row = F.struct("rid", "n", "pos")
        pivots = pool.groupBy("token").agg(*[F.min_by(row, seeded(turn * PIVOTS + i)).alias(f"p{i}") for i in range(PIVOTS)])
        pivots = pivots.select("token", F.explode(F.array_distinct(F.array(*[F.col(f"p{i}") for i in range(PIVOTS)]))).alias("p")).select("token", "p.rid", "p.n", "p.pos")
        pairs = _ordered(stray.alias("x").join(pivots.alias("y"), (F.col("x.token") == F.col("y.token")) & (F.col("x.rid") != F.col("y.rid")) & _possible(percent)))
        pairs = materialize(pairs if done is None else pairs.join(done, ["a", "b"], "left_anti"), "pairs")
        edges = materialize(_verify(pairs, sets, percent), "links")
        done = pairs if done is None else done.unionByName(pairs)
        labels = stars(edges if labels is None else labels.unionByName(edges))
    # What is left: every pair of a list that stands in two components, whichever they are.
    return stars(labels.unionByName(_across(_placed(lists, labels), sets, percent)))


def _across(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """All links between rows of one list that stand in different components.

    Of two such rows one isn't in the list's largest component. So for each
    component that is the largest of some lists, the strays of these lists are
    compared with all rows of these lists, in blocks of a bounded number of
    tokens: no row is made for a pair, only for two blocks and for a link. Blocks
    hold sets of like size, and meet only where the length filter lets them; two
    strays are compared once.
    """
    out = schema("a long, b long")
    rows = members.select(F.col("main").alias("c"), "rid", "n", "comp", (F.col("comp") != F.col("main")).alias("stray")).distinct()
    rows = materialize(rows, "strays")

    # Sets whose sizes differ by a factor of 100 / percent at most are in the same class or in neighbouring ones.
    size = F.floor(F.log("n") / F.lit(math.log(100.1 / percent))).cast("int")

    def blocks(x: DataFrame, tokens: int, name: str) -> DataFrame:
        x = x.withColumn("size", size)
        count = x.groupBy("c", "size").agg(F.ceil(F.sum("n") / F.lit(tokens)).alias("blocks"))
        y = x.join(count, ["c", "size"]).withColumn("block", F.pmod(F.xxhash64("rid"), F.col("blocks")))
        y = y.join(sets.select("rid", "set"), "rid")
        return y.groupBy("c", "size", "block").agg(F.collect_list(F.struct("rid", "comp", "set")).alias(name)).drop("block")

    one = materialize(blocks(rows.filter("stray"), BLOCK_TOKENS // 4, "x"), "stray-blocks")
    two = materialize(blocks(rows, BLOCK_TOKENS, "y"), "blocks")
    one = one.withColumn("size", F.explode(F.sequence(F.col("size") - 1, F.col("size") + 1)))
    return one.join(two, ["c", "size"]).select("c", "x", "y").mapInArrow(lambda b: _compare(b, out, percent), out)


def _compare(batches, out, percent: int):
    """Links between two blocks: for each set of the first, the tokens it has in common with every set of the second."""
    for batch in sliced(batches, 1):
        for r in batch.to_pylist():
            y = [np.frombuffer(v["set"], np.uint64) for v in r["y"]]
            ids, comps, sizes = np.array([v["rid"] for v in r["y"]]), np.array([v["comp"] for v in r["y"]]), np.array([len(v) for v in y])
            tok, owner = np.concatenate(y), np.repeat(np.arange(len(y)), sizes)
            order = np.argsort(tok, kind="stable")
            tok, owner = tok[order], owner[order]
            main = comps == r["c"]
            a, b = [], []
            for v in r["x"]:
                x = np.frombuffer(v["set"], np.uint64)
                common = np.zeros(len(y), np.int64)
                for at in range(0, len(x), 4096):
                    part = x[at : at + 4096]
                    low, high = np.searchsorted(tok, part), np.searchsorted(tok, part, "right")
                    n = high - low
                    where = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
                    common += np.bincount(owner[where], minlength=len(y))
                hit = (100 * common >= percent * (len(x) + sizes - common)) & (comps != v["comp"]) & (main | (ids > v["rid"]))
                b += ids[hit].tolist()
                a += [v["rid"]] * int(hit.sum())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], out.names)


def _classes(profile: DataFrame, *more) -> DataFrame:
    """A row for each set: its sizes, one document that has it, and the least id (null only if it has no other)."""
    sizes = F.min("n").alias("n"), F.min("k").alias("k")
    return materialize(profile.filter("n > 0").groupBy("rid").agg(*sizes, F.min(F.struct("doc_id", "th")).alias("rep"), F.min("doc_id").alias("least"), *more), "classes")


def _named(docs: DataFrame, profile: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``docs`` with ``odd``, the profile and the classes, with other ids for sets that share their first id with a different set."""
    classes = _classes(profile, F.min("alt").alias("lo"), F.max("alt").alias("hi"))
    twice = classes.filter("lo <> hi").select("rid", "lo")
    if twice.count() == 0:  # as good as always: some 70 sets of 5e10
        return docs.withColumn("odd", F.lit(False)), profile.drop("alt"), classes
    twice = materialize(twice, "twice")
    marked = profile.join(twice, "rid", "left").withColumn("odd", (F.col("n") > 0) & F.coalesce(F.col("alt") != F.col("lo"), F.lit(False)))
    out = schema("doc_id long, th long, rid long, n int, k int, odd boolean")

    def renamed(batches):
        for batch in batches:
            rid = [other_id(r, a) if o else r for r, a, o in zip(*(batch.column(c).to_pylist() for c in ("rid", "alt", "odd")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(rid, pa.int64()), batch.column("n"), batch.column("k"), batch.column("odd")], out.names)

    marked = materialize(marked.select("doc_id", "th", "rid", "alt", "n", "k", "odd").mapInArrow(renamed, out), "renamed")
    odd = materialize(marked.filter("odd").select(F.col("doc_id").alias("__d"), F.col("th").alias("__t")).distinct(), "odd")
    docs = docs.join(odd.withColumn("odd", F.lit(True)), docs["doc_id"].eqNullSafe(F.col("__d")) & (docs["th"] == F.col("__t")), "left")
    return docs.withColumn("odd", F.coalesce("odd", F.lit(False))).drop("__d", "__t"), marked.drop("odd"), _classes(marked)


def _found(docs: DataFrame, k: int, percent: int, counted: float | None, bits: int = 64) -> DataFrame:
    """doc_id, th, n, comp (the component's own number, null without words) and component_id of each row."""
    docs = keyed(docs)
    counted = max(COUNTED, 1 - percent / 100 + 0.11) if counted is None else counted
    m = schema("doc_id long, th long, rid long, alt long, n int, k int")
    profile = materialize(docs.mapInArrow(lambda b: _profile(b, m, counted, k, bits), m), "profile")
    docs, profile, classes = _named(docs, profile)
    star = links(docs, classes, k, percent, counted, bits)
    classes = classes.select("rid", "least").join(star.select(F.col("a").alias("rid"), F.col("b").alias("label")), "rid", "left").withColumn("comp", F.coalesce("label", "rid"))
    comps = classes.groupBy("comp").agg(F.min("least").alias("component_id"))
    classes = materialize(classes.join(comps, "comp").select(F.col("rid").alias("r"), "comp", "component_id"), "components")
    out = profile.join(classes, (F.col("rid") == F.col("r")) & (F.col("n") > 0), "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "th", "n", "comp", component.alias("component_id"))


def near_duplicates(docs: DataFrame, k: int = WORDS, percent: int = PERCENT, counted: float | None = None, bits: int = 64) -> DataFrame:
    """doc_id, th (a hash of the text), n_shingles and component_id of each row of a documents table."""
    return _found(docs, k, percent, counted, bits).select("doc_id", "th", F.col("n").cast("long").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of a documents table with exactly one row of each component.

    It is the one with the smallest id (null comes last), then with the least
    hash of the text, then with the least other columns. Rows without words
    have no near copies: they stay, but for rows that repeat an id and text,
    of which one stays.
    """
    # Rows of one id and text are counted before they are shuffled, so many copies are no burden.
    rows = _found(docs, k, percent, None).groupBy("doc_id", "th").agg(F.count("*").alias("copies"), F.min("n").alias("n"), F.min("comp").alias("comp"))
    rows = materialize(rows, "rows")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th", "copies")
    keep = rows.filter("n > 0").groupBy("comp").agg(F.min(first).alias("x")).select("x.doc_id", "x.th", "x.copies")
    bare = rows.filter("n = 0").select("doc_id", "th", F.when(F.col("doc_id").isNull(), 1).otherwise(F.col("copies")).alias("copies"))
    keep = keep.unionByName(bare).select(F.col("doc_id").alias("__d"), F.col("th").alias("__t"), "copies")
    keep = materialize(keep, "keep")
    th = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    same = docs["doc_id"].cast("long").eqNullSafe(F.col("__d")) & (th == F.col("__t"))
    out = docs.join(keep.filter("copies = 1").hint("merge"), same, "left_semi")
    repeated = materialize(keep.filter("copies > 1").drop("copies"), "repeated")
    if repeated.isEmpty():
        return out
    # Mostly few; the written table's true size tells the planner whether they are.
    one = docs.join(repeated, same).groupBy("__d", "__t").agg(F.min(F.struct(*docs.columns)).alias("__row"))
    return out.unionByName(one.select("__row.*"))
