"""The training-data operators against brute force, exact round trips and edge cases."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import bpe, chat, classifier, common, language, mixing, ngram_join, quality_rules, suffix_dedup, token_counts, topk

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [(None, None, "en", None, None), (1, "", "en", "s", 0), (2, "word " * 3000, None, "s", 1), (2, "word " * 3000, "fr", "s", 1), (3, "É\x00 ß <|endoftext|> x", "de", None, 5), (None, "tie", "en", "t", 3)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    # A column with a name that operators use themselves mustn't matter.
    return spark.createDataFrame([(*r, "mine", 7) for r in ODD], SCHEMA + ", th string, size int")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_mixing(spark, odd, empty):
    rows = [(i, "w " * (i % 9 + 1), "en", f"s{i % 3}" if i % 4 else None, 1) for i in range(400)]
    out = mixing.draw(spark.createDataFrame(rows, SCHEMA)).collect()
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += len(WORD.findall(r[1]))
    total, left = 1.5 * sum(sizes.values()), {s: w for s, w in zip(["s0", "s1", "s2", None], [3, 1, 2, 3], strict=True)}
    want = {}
    while left:
        level = (total - sum(want.values())) / sum(left.values())
        over = [s for s, w in left.items() if level * w > 2 * sizes[s]]
        if not over:
            want |= {s: level * w for s, w in left.items()}
            break
        for s in over:
            want[s] = 2 * sizes[s]
            del left[s]
    got = {rows[r.doc_id][3]: (r.source_size, r.target) for r in out}
    assert {s: v[0] for s, v in got.items()} == dict(sizes)
    assert all(abs(got[s][1] - want[s]) < 1e-6 for s in want)
    assert all(r.taken in (0, r.size, 2 * r.size) for r in out)
    taken = collections.Counter()
    for r in out:
        taken[rows[r.doc_id][3]] += r.taken
    assert all(abs(taken[s] - want[s]) < 0.2 * want[s] for s in want)
    assert mixing.mix(odd).columns == odd.columns and mixing.draw(odd).count() == len(ODD)
    assert mixing.mix(empty).count() == mixing.draw(empty).count() == 0


def test_bpe(spark, odd, empty):
    random.seed(1)
    texts = ["".join(random.choice(["the ", "É", "don't ", "\n", "<|endoftext|>", "x.", "１", "…", "Σ", "  ", "İ", "é"]) for _ in range(random.randint(0, 400))) for _ in range(60)]
    passage = " ".join(f"shared{random.randint(0, 999)} passage" for _ in range(600))
    texts += ["a" * 5000, "a b " + "c" * 5000, "shared passage " * 200, *[f"{i} {passage} {i}" for i in range(9)], "", "\u3000  "]
    e = bpe.Encoder(bpe.vocabulary())
    for text, (ids, decoded) in zip(texts, e.encode_all(texts), strict=True):
        want = e.tokenizer.encode(text, add_special_tokens=False).ids
        assert list(np.frombuffer(ids, "<u4")) == want and decoded.decode() == e.tokenizer.decode(want, skip_special_tokens=False)
        assert "".join(bpe.chunks(text)) == text
    assert e.reused > e.encoded and e.repaired and not e.widened
    with pytest.raises(ValueError, match="beyond white space"):
        bpe.encode(odd, bpe.vocabulary("byte_bpe_50k.json"))
    rows = bpe.encode(odd).collect()
    assert len(rows) == len(ODD) and all(len(r.ids) == r.n_tokens for r in rows)
    assert {r.ids_sha256 for r in rows if r.n_tokens == 0} == {hashlib.sha256(b"").hexdigest()}
    assert bpe.encode(empty).count() == 0


def test_bpe_joins(monkeypatch):
    """Cuts at every few characters, in words, marks, special tokens and between a letter and its accent."""
    random.seed(9)
    for least in (1, 5, 40):
        monkeypatch.setattr(bpe, "cuts", lambda text, n=least: [*range(n, len(text), n), len(text)])
        e = bpe.Encoder(bpe.vocabulary())
        texts = ["".join(random.choice(["the", "E\u0301", "don't ", "\n", "<|endoftext|>", "THING", "ing", "x.", "12", "…", "Σ", " ", " ", "e\u0301"]) for _ in range(random.randint(0, 150))) for _ in range(80)]
        for text, (ids, decoded) in zip(texts, e.encode_all(texts), strict=True):
            want = e.tokenizer.encode(text, add_special_tokens=False).ids
            assert list(np.frombuffer(ids, "<u4")) == want and decoded.decode() == e.tokenizer.decode(want, skip_special_tokens=False)
        assert e.repaired
    # Chunks that don't agree with their join are encoded together, then with the whole text.
    e = bpe.Encoder(bpe.vocabulary())
    plain = e.chunk
    monkeypatch.setattr(e, "chunk", lambda x: plain(x)._replace(before=b"no"))
    assert [np.frombuffer(i, "<u4").tolist() for i, _ in e.encode_all(texts)] == [e.tokenizer.encode(t, add_special_tokens=False).ids for t in texts] and e.widened


def test_viterbi_and_repeats():
    rng = np.random.default_rng(0)
    for _ in range(50):
        n = int(rng.integers(1, 8))
        unary, moves = rng.normal(size=(n, 2)), rng.normal(size=(2, 2))

        def score(path, unary=unary, moves=moves):
            return sum(unary[i, p] for i, p in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:], strict=False))

        best = max((tuple(map(int, f"{k:0{n}b}")) for k in range(2**n)), key=score)
        assert abs(score(quality_rules.viterbi(unary, moves).tolist()) - score(best)) < 1e-9
        words = [bytes([97 + int(x)]) for x in rng.integers(0, 2, int(rng.integers(0, 40)))]
        windows = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
        assert quality_rules.repeated_words(words) == len(covered)


def test_quality_rules(spark, odd, empty):
    good = "\n".join(" ".join(f"word{i * 7 + j} of the" for j in range(6)) + "." for i in range(6))
    bad = "\n".join(" ".join(f"W{i * 7 + j}$$$ |" for j in range(6)) for i in range(6))
    docs = spark.createDataFrame([(i, good.replace("word", f"w{i}x") if i % 2 else bad.replace("W", f"W{i}"), "en", "s", 1) for i in range(40)], SCHEMA)
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    kept = {r.doc_id: r.kept for r in quality_rules.apply_rules(docs, quality_rules.train(docs, labels)).collect()}
    assert all(kept[i] == bool(i % 2) for i in range(40))
    rows = quality_rules.apply_rules(odd, quality_rules.train(odd, None)).collect()
    assert len(rows) == len(ODD) and all(r.base_failed for r in rows)
    assert quality_rules.apply_rules(empty, quality_rules.prior_model()).count() == 0


def brute_repeats(texts, length):
    raw = [(t or "").encode() for t in texts]
    counts = collections.Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if counts[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, y in zip(b, gone, strict=True) if not y)
        out.append((len(b), sum(gone), sum(gone[i] and not (i and gone[i - 1]) for i in range(len(b))), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize(("length", "alphabet"), [(8, "ab"), (40, "abcdefgh é")])
def test_suffix_dedup(spark, odd, empty, length, alphabet):
    random.seed(length)
    base = ["".join(random.choice(alphabet) for _ in range(random.randint(0, 300))) for _ in range(20)]
    texts = [*base, None, "", "a" * 500, base[0]]
    for _ in range(40):
        a, b = random.choice(base), random.choice(base)
        i = random.randint(0, len(a))
        texts.append(a[:i] + random.choice(["", "x", "ab"]) + b[random.randint(0, len(b)) :])
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove(docs, length).collect()}
    assert [got[i] for i in range(len(texts))] == brute_repeats(texts, length)
    left = {r.doc_id: r.text for r in suffix_dedup.strip(docs, length).collect()}
    assert all(left[i] == t for i, t in enumerate(texts) if not got[i][1])
    if length == 8:
        assert suffix_dedup.strip(odd, length).columns == odd.columns
        assert suffix_dedup.remove(odd).count() == len(ODD) and suffix_dedup.remove(empty).count() == 0


def test_suffix_dedup_at_400_bytes(spark):
    """The production threshold: passages of 399 to 401 bytes and more, edits inside, runs of one letter, copies in thousands."""
    random.seed(400)

    def passage(n):
        return "".join(random.choice("abcdefghijklm nopqrstuvwxyz ") for _ in range(n))

    texts = ["z" * 399, "y" * 400, "x" * 401, "x" * 402, "é" * 300]
    for n in (398, 399, 400, 401, 402, 700, 5000):
        p = passage(n)
        texts += [passage(300) + p + passage(200), p + passage(900), passage(10) + p]
    p = passage(3000)
    texts += [p[:i] + "#" + p[i:] for i in range(0, 3000, 350)] + [p[1000:1900] + passage(50) + p[:450]] + [passage(600)] * 300
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove(docs).collect()}
    assert [got[i] for i in range(len(texts))] == brute_repeats(texts, 400)


def brute_passages(rows, length):
    """Runs of words that windows of so many words, standing in another document as well, cover."""
    words = [WORD.findall(t or "") for _, t in rows]
    where = collections.defaultdict(set)
    for row, w in zip(rows, words, strict=True):
        for i in range(len(w) - length + 1):
            where[tuple(w[i : i + length])].add(row)
    out = []
    for w in words:
        hit = {j for i in range(len(w) - length + 1) if len(where[tuple(w[i : i + length])]) > 1 for j in range(i, i + length)}
        out.append((sum(j - 1 not in hit for j in hit), len(hit), [x for j, x in enumerate(w) if j not in hit]))
    return out


@pytest.mark.parametrize(("length", "size"), [(7, 4), (51, 5000)])
def test_passages_of_words(spark, odd, empty, length, size):
    random.seed(length)

    def passage(n):
        return [f"é{random.randint(0, size)}" for _ in range(n)]

    base = [passage(random.randint(0, 5 * length)) for _ in range(12)]
    shared = [passage(n) for n in (length - 1, length, length + 1, 3 * length)]
    texts = [None, "", "w " * 9 * length, " ".join(base[0]), " ".join(base[0])]
    for i in range(70):
        a, b = list(random.choice(base)), random.choice(base)
        for p in random.sample(shared, i % 3):
            j = random.randint(0, len(a))
            a[j:j] = p * random.choice([1, 1, 2])
        j = random.randint(0, len(a))
        texts.append(random.choice([" ", "\n", " \t"]).join(a[:j] + passage(i % 2) + b[random.randint(0, len(b)) :]))
    rows = [(i if i % 9 else None, t) for i, t in enumerate(texts)] + [(3, texts[3]), (5000, texts[7])] + [(6, texts[6])] * 2
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], SCHEMA)

    def key(r):
        return tuple(-1 if x is None else x for x in r)

    got = sorted(((r.doc_id, r.n_bytes, r.n_passages, r.n_passage_words) for r in suffix_dedup.remove(docs, min_words=length).collect()), key=key)
    want = brute_passages(rows, length)
    assert got == sorted(((d, len((t or "").encode()), n, m) for (d, t), (n, m, _) in zip(rows, want, strict=True)), key=key)
    left = sorted((key((r.doc_id, *WORD.findall(r.text or ""))) for r in suffix_dedup.strip(docs, None, length).collect()), key=str)
    assert left == sorted((key((d, *w)) for (d, _), (_, _, w) in zip(rows, want, strict=True)), key=str)
    if length == 7:
        assert suffix_dedup.strip(odd, None, length).columns == odd.columns and suffix_dedup.strip(empty, None, length).count() == 0


def test_hashes_of_words():
    text = ("é" * 3 + " \t" + "ab\n" * 700_000 + "x" * 3_000_000 + " " + "y" * 200_000 + "z").encode()
    starts, ends, h = common.hashed_words(text)
    assert [text[a:b] for a, b in zip(starts, ends, strict=True)] == text.split() and len(set(h.tolist())) == len(set(text.split()))
    texts = [b"", b" ", text, b"ab", b"\xc3\xa9\xc3\xa9\xc3\xa9 q"]
    got = common.word_hashes_of(texts)
    assert [len(x) for x in got] == [len(t.split()) for t in texts] and (got[2] == h).all() and got[3][0] == h[1] and got[4][0] == h[0]


@pytest.mark.parametrize(("high", "spread"), [(3, 1), (300, 40), (2**29, 1), (2**40, 3)])
def test_maxscore_over_shards(high, spread):
    """Thresholds carried from shard to shard lose nothing, at ties, with numbers of any size and in any order of shards."""
    rng = np.random.default_rng(high % 97)
    x = (rng.integers(-high, high + 1, (700, 24)) // rng.integers(1, spread + 1, 24)).astype(np.int64)
    x[500:560], ids = x[7], np.arange(700)
    for order in (ids, ids[::-1], rng.permutation(ids)):
        best, found = [[] for _ in range(14)], []
        for at in range(0, 700, 90):
            some = order[at : at + 90]
            found += topk.maxscore((ids[::50], x[::50]), (some, x[some]), 5, best, step=4)
        for q in range(0, 700, 50):
            true = [(-sum(int(a) * int(b) for a, b in zip(x[q], x[c], strict=True)), c) for c in range(700) if c != q]
            assert sorted((-s, c) for a, c, s in found if a == q)[:5] == sorted(true)[:5]
            assert best[q // 50] == [-s for s, _ in sorted(true)[:5]]
    short = topk.maxscore((ids[:1], x[:1]), (ids[:3], x[:3]), 5)
    assert len(short) == 2


def test_topk(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), [float(x) for x in rng.normal(size=16)]) for i in range(700)]
    rows += [(50, None), (51, [None] * 16), (52, [float("nan")] * 16), (None, [1.0] * 16), (701, rows[0][1]), (701, rows[0][1]), (702, [1.0, 2.0]), (750, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    vectors = topk.quantized(df).cache()
    got = sorted(map(tuple, topk.search(vectors, F.col("vec_id") % 50 == 0, shard=100).select("query_id", "rank", "vec_id", "score").collect()))
    plain = [(r.vec_id, np.array([*r.v, *[0] * (16 - len(r.v))])) for r in vectors.collect()]
    want = []
    for q, v in plain:
        if q % 50 == 0:
            best = sorted((-int(v @ w), i) for i, w in plain if i != q)[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == sorted(want)
    assert topk.search(vectors.filter("false"), F.lit(True)).count() == 0


def brute_components(rows):
    sets = []
    for _, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common):
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)]


def test_ngram_join(spark, odd, empty):
    random.seed(5)
    vocabulary = [f"w{i}" for i in range(60)]
    base = [[random.choice(vocabulary) for _ in range(random.randint(1, 120))] for _ in range(12)]
    rows = []
    for i in range(260):
        w = list(random.choice(base))
        for _ in range(random.randint(0, 5)):
            p = random.randint(0, len(w))
            if random.random() < 0.5:
                w.insert(p, random.choice(vocabulary))
            elif w:
                w.pop(min(p, len(w) - 1))
        rows.append((i if i % 50 else None, " ".join(w).upper() if i % 3 == 0 else "\n".join(w)))
    rows += [(9000, ""), (9001, None), (9002, "a b"), (9003, "A  b"), (9005, "É b"), (9006, "é b"), (5, rows[5][1])]
    got = [tuple(r) for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).drop("th").collect()]

    def key(r):
        return tuple(-1 if x is None else x for x in r)

    assert sorted(got, key=key) == sorted(brute_components(rows), key=key)
    # Names of a few bits, which many different sets share.
    got = [tuple(r) for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), bits=4).drop("th").collect()]
    assert sorted(got, key=key) == sorted(brute_components(rows), key=key)
    kept = ngram_join.keep_one(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {None, 1, 2, 3}
    assert ngram_join.near_duplicates(empty).count() == 0


def test_ngram_join_across_sizes(spark):
    """Links between sets of which one counts all its tokens first and the other only a part."""
    rows = []
    for small, large in [(60, 70), (64, 65), (64, 85), (64, 86), (50, 66), (65, 86), (63, 64), (70, 93)] * 4:
        g = len(rows)
        words = [f"g{g}w{i}" for i in range(large + 4)]
        rows += [(g, " ".join(words[: small + 4])), (g + 1, " ".join(words))]
    for percent in (75, 60):
        got = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=percent).collect()}
        sizes = [len(t.split()) - 4 for _, t in rows]
        assert got == {d: d - d % 2 if 100 * sizes[d - d % 2] >= percent * sizes[d - d % 2 + 1] else d for d, _ in rows}


def test_one_row_of_each_component_stays(spark):
    def text(g, n=120):
        return " ".join(f"g{g}w{i}" for i in range(n))

    rows = [(1, text(1), "en", "s", 1), (1, text(1), "en", "s", 1), (1, text(1), "de", "s", 1), (2, text(1), "en", "s", 1)]  # repeated rows
    rows += [(3, text(3), "en", "s", 1), (3, text(3) + " more", "en", "s", 1), (4, text(3) + " other", "en", "s", 1)]  # near copies under one id
    rows += [(None, text(5), "en", "s", 1)] * 3 + [(None, text(5) + " more", "en", "s", 1)]  # no id at all
    rows += [(None, text(6), "en", "s", 1), (6, text(6), "en", "s", 1)]
    rows += [(7, text(7), "en", "s", 1), (7, text(8), "en", "s", 1)]  # one id, two components
    rows += [(9, " ", "en", "s", 1), (9, " ", "en", "s", 1), (9, "", "en", "s", 1), (None, "", "en", "s", 1), (None, "", "en", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = ngram_join.keep_one(docs)
    got = sorted((r.doc_id or 0, (r.text or "").split(" ")[0], r.lang) for r in kept.collect())
    assert got == [(0, "", "en"), (0, "", "en"), (0, "g5w0", "en"), (1, "g1w0", "de"), (3, "g3w0", "en"), (6, "g6w0", "en"), (7, "g7w0", "en"), (7, "g8w0", "en"), (9, "", "en"), (9, "", "en")]
    left = sorted((r.doc_id or 0, len(r.text)) for r in suffix_dedup.strip(kept).collect() if r.text.strip())
    assert [d for d, _ in left] == [0, 1, 3, 6, 7, 7] and all(n >= len(text(1)) for _, n in left)


def test_token_counts(spark, odd, empty):
    tok = token_counts._tokenizer("byte_bpe_50k.tiktoken")
    random.seed(3)
    for _ in range(800):
        text = "".join(random.choice(["a", "b", " ", "  ", "\n", "'s", "1", "é", ".", "ab", "\t"]) for _ in range(random.randint(0, 30)))
        edits = [(random.randint(-1, 35), random.randint(0, 8), random.choice(["", " ", "x", " y", "\n\n", "'s z", "12"])) for _ in range(random.randint(0, 5))]
        tree = token_counts.Tree(text, tok)
        new = tree.edit(edits)
        assert tree.total == len(tok.encoding.encode_ordinary(new)) == tree.range_sum(0, tree.size)
    docs = odd.withColumn("edits", token_counts.sample_edits())
    assert token_counts.count_after_edits(docs).count() == len(ODD)
    assert token_counts.count_after_edits(empty.withColumn("edits", F.lit(None).cast("array<struct<start:int,length:int,text:string>>"))).count() == 0


def test_chat_trees(spark):
    rows = [(1, 1, None, "user", "hi <s> \\l [x]", 0.0), (1, 2, 1, "assistant", "one </s>", 1.0), (1, 3, 1, "assistant", "two", 5.0), (1, 4, 3, "user", None, 0.0), (1, 5, 4, "assistant", "né\n<|im_end|>\n", 1.0), (1, 6, 4, "assistant", "other", 0.5), (2, 1, 7, None, "orphan", None), (3, 1, 2, "user", "cycle", 0.0), (3, 2, 1, "user", "cycle", 0.0)]
    messages = spark.createDataFrame(rows, "tree_id long, msg_id long, parent_id long, role string, text string, score double")
    out = {(r.tree_id, r.leaf): r for r in chat.format_paths(messages, best=None).withColumn("turns", chat.parse(F.col("formatted"))).withColumn("said", chat.loss_text(F.col("formatted"), F.col("loss"))).collect()}
    assert set(out) == {(1, 2), (1, 5), (1, 6), (2, 1)}
    best = out[(1, 5)]
    assert best["rank"] == 1 and best["score"] == 6.0 and best["said"] == "twoné\n<|im_end|>\n"
    assert [tuple(t) for t in best["turns"]] == [("user", "hi <s> \\l [x]"), ("assistant", "two"), ("user", ""), ("assistant", "né\n<|im_end|>\n")]
    assert "<s>" not in best["formatted"] and {r.leaf for r in chat.format_paths(messages).collect()} == {5, 1}
    long = spark.createDataFrame([(9, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(300)], "conv_id long, turn long, role string, text string")
    one = chat.format_paths(chat.from_turns(long)).withColumn("turns", chat.parse(F.col("formatted"))).first()
    assert [t.text for t in one.turns] == [f"t{i}" for i in range(300)]
    assert chat.format_paths(chat.from_turns(long.filter("false"))).count() == 0


def test_language(spark, odd, empty):
    words = {"en": "the of and house water".split(), "de": "der und nicht wasser haus".split()}
    random.seed(1)
    docs = spark.createDataFrame([(i, " ".join(random.choice(words[lang]) + random.choice("abcdef") for _ in range(60)), lang, "s", 1) for i in range(120) for lang in [("en", "de")[i % 2]]], SCHEMA)
    content = language.dictionaries(docs, lambda i: i % 4 != 2)
    rows = {r.doc_id: r for r in language.identify(docs, content).collect()}
    assert all(rows[i].lang_pred == ("en", "de")[i % 2] and 0.5 < rows[i].score <= 1 for i in range(120))
    assert language.keep_identified(docs, content).count() == 120
    found = language.identify(odd, content).collect()
    assert len(found) == len(ODD) and {(r.lang_pred, r.score, r.rejected) for r in found if r.doc_id == 1} == {("und", 0.0, True)}
    assert language.dictionaries(empty, lambda i: i > 0) == {} and {r.lang_pred for r in language.identify(odd, {}).collect()} == {"und"}
    assert language.identify(empty, content).count() == 0


def test_classifier(spark, odd, empty):
    random.seed(1)
    rows = [(i, " ".join(f"{random.choice('abcdefg')}{random.choice('xyz')}" + ("$$$" if i % 2 == 0 else "") for _ in range(50)), "en", "s", 1) for i in range(300)]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = classifier.train(docs, docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality")), classifier.trained_on(5))
    found = classifier.score(docs, model).collect()
    assert sum(r.predicted == r.doc_id % 2 for r in found) > 0.97 * len(found)
    assert all(0 <= r.score <= 1 for r in classifier.score(odd, model).collect()) and classifier.score(odd, model).count() == len(ODD)
    untaught = classifier.train(empty, docs.select("doc_id", F.lit(1).alias("quality")).limit(0), classifier.trained_on(5))
    assert {r.score for r in classifier.score(odd, untaught).collect()} == {0.5} and classifier.score(empty, model).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    random.seed(2)
    texts = [" ".join(random.choice("the of and house water river stone".split()) + random.choice("abcdefgh") for _ in range(random.randint(30, 90))) for _ in range(40)]
    passage = " ".join(f"shared{i}" for i in range(70))
    texts += [texts[0], texts[1] + " tail", "1234", None, texts[2] + " " + passage, passage + " " + texts[3] * 2]
    spark.createDataFrame([(i, t, "en" if i % 2 else "de", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r.doc_id for r in rows}
    assert not ids & {40, 42, 43} and all(len(r.ids) == r.n_tokens for r in rows)
