"""Tokenizer alignment, exact search and prefix tries against brute force, on odd inputs too."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from fieldspark.llm import pivot_index as pivot
from fieldspark.llm import prefix_trie as trie
from fieldspark.llm import token_alignment as align
from fieldspark.llm.common import table
from fieldspark.llm.catalogue import QUERIES

SMALL = "/root/testdata/sf0.001"

# --- tokenizers -----------------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def coders():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(f"{align.TOKENIZERS}/byte_bpe_50k.json")
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=f"{align.TOKENIZERS}/piece_bpe_32k.model")


def brute_tokens(coders, text):
    a, b = coders
    alphabet = align.byte_level_alphabet()
    if not text:
        return [], []
    left = a.encode(" " + text, add_special_tokens=False)
    left = [(i, bytes(alphabet[c] for c in a.id_to_token(i))) for i in left.ids]
    right = [(i, bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
    want = (" " + text).encode()
    return (left, right) if b"".join(t for _, t in left) == want == b"".join(t for _, t in right) else ([], [])


def brute_alignment(coders, texts):
    docs, counts = [], Counter()
    for text in texts:
        sides = []
        for tokens in brute_tokens(coders, text):
            at, spans = 0, []
            for i, t in tokens:
                spans.append((i, at, at + len(t)))
                at += len(t)
            sides.append(spans)
        a, b = sides
        links = [(i, j) for i, p, q in a for j, r, s in b if p < s and r < q]
        cuts = sorted({q for *_, q in a} & {s for *_, s in b})
        groups, last = [], 0
        for c in cuts:
            groups.append("|".join(",".join(str(i) for i, _, q in side if last < q <= c) for side in (a, b)))
            last = c
        counts.update(set(links))
        docs.append((len(a), len(b), groups, links))
    highest = defaultdict(int)
    for (i, _), n in counts.items():
        highest[i] = max(highest[i], n)
    return [
        (na, nb, len(g), len(li), sum(counts[x] == highest[x[0]] for x in li), sum(counts[x] for x in li),
         hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")
        for na, nb, g, li in docs
    ]


ODD_TEXTS = [None, "", " ", "a", "  two  blanks ", "line\r\n\r\n\tend\n", "<|endoftext|> <s> </s> <unk>", "lower ▁ one eighth", "naïve Straße 東京 🙂👍🏽", "\x00\x01\x1f",
             "don't we'll they've 12345 67", "é   x", "aaaa" * 900, "the same", "the same", "the same"]


def test_alignment_is_brute_force(spark, coders):
    rng = random.Random(5)
    texts = ODD_TEXTS + [" ".join(rng.choice(["tokenizer", "the", "Über", "naïve", "x1", "12", "\n", "…", "aß", "ing"]) for _ in range(rng.randrange(60))) for _ in range(40)]
    rows = [(i if i % 7 else None, t, "p", 1, i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, block string, pairs int, nth int").repartition(5)
    got = align.align_documents(docs).collect()
    want = [(r[0], *w) for r, w in zip(rows, brute_alignment(coders, texts))]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted([(r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in got], key=key) == sorted(want, key=key)
    assert align.align_documents(docs.limit(0)).count() == 0


def test_blocks_do_not_change_results(spark, monkeypatch):
    docs = table(spark, SMALL, "documents").limit(60)
    whole = sorted(map(tuple, align.align_documents(docs).collect()))
    monkeypatch.setattr(align, "BLOCK_BYTES", 500)
    assert sorted(map(tuple, align.align_documents(docs.repartition(3)).collect())) == whole


def test_groups_spell_the_text(spark):
    docs = spark.createDataFrame([(1, "naïve tokens, Straße"), (2, None), (3, "x")], "doc_id long, text string")
    a, b = align.vocabularies(align.TOKENIZERS)
    spelled = {1: [b"", b""], 3: [b"", b""]}
    for r in align.token_groups(docs).orderBy("doc_id", "nth").collect():
        for side, (v, ids) in enumerate(((a, r.a), (b, r.b))):
            piece = b"".join(v.token[i].as_py() for i in ids)
            assert len(piece) == r.end - r.begin
            spelled[r.doc_id][side] += piece
    assert spelled == {1: [" naïve tokens, Straße".encode()] * 2, 3: [b" x"] * 2}


def test_ranks_give_the_ids_of_the_vocabulary_file(coders):
    """Every code point of the first planes, in places where the splitting rule depends on its class."""
    a, _ = align.vocabularies(align.TOKENIZERS)
    texts = [f"a{c}b1{c}2 {c}!{c}! {c}  {c}" for c in map(chr, [*range(0x3100), *range(0xF900, 0x10000), *range(0x1F300, 0x1F700)])]
    want = [e.ids for e in coders[0].encode_batch([" " + t for t in texts], add_special_tokens=False)]
    assert [list(x) for x in a.encode(texts)] == want


# --- search ---------------------------------------------------------------------------------------------------------------------------


def brute_top(rows, every=100, top=10):
    def ints(v):
        if v is None or any(x is None or not math.isfinite(x) for x in v):
            return None
        return [math.floor(1024 * float(x)) for x in v]

    usable = [(i, r, x) for i, (r, v) in enumerate(rows) if (x := ints(v)) is not None]
    out = []
    for i, r, x in usable:
        if r is None or r % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(x, y)), s is None, s if s is not None else 0) for j, s, y in usable if j != i)
        out += [(r, n, None if none else s, -score) for n, (score, none, s) in enumerate(scored[:top], 1)]
    return sorted(out, key=str)


def found(df):
    return sorted([(r.query_id, r.rank, r.vec_id, r.score) for r in df.collect()], key=str)


def small(spark, rows):
    schema = "vec_id long, embedding array<float>, row string, x int, pivot string, members int, q string"
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], "r", 1, "p", 2, "q") for i, v in rows], schema)


def test_search_is_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((6, 8)) * 2
    rows = [(i, list(map(float, np.float32(centres[i % 6] * rng.uniform(0.2, 2) + 0.2 * rng.standard_normal(8))))) for i in range(1500)]
    rows += [(5000 + i, rows[3][1]) for i in range(300)]  # a group of copies
    for name, value in {"ANNULUS": 40, "BLOCK": 30, "GROUP": 3, "FIRST": 50, "GROWTH": 4}.items():
        monkeypatch.setattr(pivot, name, value)
    assert found(pivot.top_products(small(spark, rows).repartition(4))) == brute_top(rows)


def test_queries_come_in_chunks(spark, monkeypatch):
    """The driver and each task hold one chunk of queries, however many there are, and no query is copied for each annulus that it opens."""
    rng = np.random.default_rng(5)
    rows = [(i, list(map(float, np.float32(rng.standard_normal(6))))) for i in range(1200)] + [(0, [0.5] * 6), (None, [0.25] * 6)]
    for name, value in {"ANNULUS": 40, "FIRST": 100, "GROWTH": 4, "CHUNK": 40 * 6 * 8}.items():
        monkeypatch.setattr(pivot, name, value)
    sizes, search_chunk = [], pivot._search_chunk
    monkeypatch.setattr(pivot, "_search_chunk", lambda index, sc, own, q, top: sizes.append(len(q)) or search_chunk(index, sc, own, q, top))
    assert found(pivot.top_products(small(spark, rows).repartition(4), every=10)) == brute_top(rows, every=10)
    assert sum(sizes) == 121 and max(sizes) <= 80


def test_bounds_leave_blocks_out(spark, monkeypatch):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((30, 6))
    x = np.concatenate([c / np.linalg.norm(c) * 1000 + rng.standard_normal((100, 6)) * 15 for c in centres]).round()
    pivots = pivot.farthest_first(x[::7], float((x * x).sum(1).max()), 30)
    d = pivots.of_points(x)
    near = d.argmin(1)
    rows = [(p, 0, d[near == p, p].min(), d[near == p, p].max(), int((near == p).sum())) for p in range(len(pivots.x)) if (near == p).any()]
    annuli = pivot.Annuli(pivots, rows)
    q = x[::50]
    scores = q @ x.T
    assert all((scores[:, near == p].max(1) <= annuli.highest(q)[:, k]).all() for k, p in enumerate(annuli.pivot))
    least = np.sort(scores, 1)[:, -11]
    assert annuli.opened(q, least, 0, len(x)).mean() < 0.4


def test_search_on_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (100, None), (200, [nan, 1.0]), (300, [inf, 0.0]), (400, [None, 1.0]), (500, [0.0, 0.0]), (None, [1.0, 2.0]), (None, [3.0, 1.0]),
            (1, [1.0, 2.0]), (1, [1.0, 2.0]), (0, [1.0, 2.0]), (600, [5.0]), (700, []), (-100, [-0.1, 0.30001]), (800, [1e6, -3e7]), (3, [65536.5, 2.0]), (2, [0.3, -7.25])]
    assert found(pivot.top_products(small(spark, rows))) == brute_top(rows)
    assert found(pivot.top_products(small(spark, [(0, [1.0])]))) == []
    assert pivot.top_products(small(spark, rows[:1]).limit(0)).count() == 0
    assert pivot.top_products(small(spark, [(7, None)])).count() == 0


def test_products_are_exact_beyond_doubles():
    a = np.array([[2.0**24, 2.0**24 - 1, 1.0]] * 2)
    assert pivot.products(a, a)[0, 0] == 2**48 + (2**24 - 1) ** 2 + 1
    big = np.full((1, 64), 2.0**24 - 1)
    assert pivot.products(big, big)[0, 0] == 64 * (2**24 - 1) ** 2


# --- tries ----------------------------------------------------------------------------------------------------------------------------


def brute_trie(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            text = text or ""
            convs[c].append((turn is not None, turn or 0, role or "", hashlib.md5(text.encode()).hexdigest(), text))
    convs = {c: [(r, t) for *_, r, _, t in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(math.fmod(c, 100))
        built[c] = tuple(convs.get(base, [])[:h] + own[h:])
    nodes = defaultdict(list)
    for c, p in built.items():
        for d in range(len(p) + 1):
            nodes[p[:d]].append(c)
    kids = defaultdict(list)
    for n in nodes:
        if n:
            kids[n[:-1]].append(n)
    leaves, saved = {}, {}
    for n in sorted(nodes, key=len, reverse=True):
        leaves[n] = sum(leaves[k] for k in kids[n]) or 1
        saved[n] = sum(saved[k] for k in kids[n]) + ((len(nodes[n]) - 1) * len(n[-1][1]) if n else 0)
    return sorted(
        (min(m), len(n), min(nodes[n[:-1]]) if n else None, len(m), len(kids[n]), leaves[n], saved[n],
         hashlib.sha256(",".join(str(c) for c in sorted(m) if len(built[c]) == len(n)).encode()).hexdigest())
        for n, m in nodes.items()
    )


def trie_of(spark, rows):
    df = spark.createDataFrame([(*r, "n", 1, "d") for r in rows], "conv_id long, turn long, role string, text string, node string, size int, depth string")
    got = trie.prefix_trie(trie.with_shared_starts(trie.turn_lists(df.repartition(3)))).collect()
    return sorted(map(tuple, got), key=lambda r: r[:2] + (r[3],)), got


def family(seed, n, long=12):
    rng = random.Random(seed)
    return [(c, t, rng.choice(["user", "assistant"]), rng.choice(["a", "bb", "ccc", "é🙂"])) for c in rng.sample(range(-50, 900), n) for t in range(rng.randrange(1, long))]


@pytest.mark.parametrize("conversations, turns", [(4096, 32768), (7, 100), (1, 5), (50, 9)])
def test_trie_is_brute_force(spark, monkeypatch, conversations, turns):
    monkeypatch.setattr(trie, "SHARD_CONVERSATIONS", conversations)
    monkeypatch.setattr(trie, "SHARD_TURNS", turns)
    rows = family(conversations, 150) + [(2000 + 100 * i, t, "user", f"hot {t}") for i in range(60) for t in range(20)]
    got, _ = trie_of(spark, rows)
    assert got == sorted(brute_trie(rows), key=lambda r: r[:2] + (r[3],))


def test_trie_of_odd_conversations(spark):
    rows = [(1, None, None, None), (1, None, "user", ""), (1, 2, "user", "x"), (1, 2, "user", "x"), (1, 2, "assistant", "b"), (None, 0, "user", "lost"), (100, 0, None, "y"),
            (103, 0, "user", "only"), (205, 0, "user", "no base"), (-7, 3, "user", "neg"), (-107, 3, "user", "z" * 100_000), (300, 0, "a:b", "c"), (300, 1, "a", "b:c")]
    got, _ = trie_of(spark, rows)
    assert got == sorted(brute_trie(rows), key=lambda r: r[:2] + (r[3],))
    assert trie_of(spark, rows[5:6])[0] == []


def test_streamed_digest_joins_chunks():
    batch = lambda *r: pa.RecordBatch.from_pylist([dict(zip(("node", "first_end", "ends"), x)) for x in r])
    out = [x for b in trie._stream_digests([batch((b"a", 1, "1,2"), (b"a", 3, "3")), batch((b"a", 4, "4"), (b"b", 9, "9"))]) for x in b.to_pylist()]
    assert [(x["node"], x["ends_sha256"]) for x in out] == [(b"a", hashlib.sha256(b"1,2,3,4").hexdigest()), (b"b", hashlib.sha256(b"9").hexdigest())]


def test_alignment_query_is_brute_force(spark, coders):
    docs = [tuple(r) for r in table(spark, SMALL, "documents").select("doc_id", "text").collect()]
    short = [(i, t) for i, t in docs]
    got = QUERIES["op11_token_alignment"](spark, SMALL).collect()
    assert sorted((r.doc_id, r.n_a, r.n_b, r.groups_sha256) for r in got) == sorted(
        (i, *((len(x), len(y)) if x else (0, 0)), digest) for i, t in short for x, y in [brute_tokens(coders, t)] for digest in [brute_digest(x, y)]
    )


def brute_digest(a, b):
    groups, i, j, p, q, left, right = [], 0, 0, 0, 0, [], []
    while i < len(a) or j < len(b):
        if p <= q and i < len(a):
            left.append(str(a[i][0]))
            p += len(a[i][1])
            i += 1
        else:
            right.append(str(b[j][0]))
            q += len(b[j][1])
            j += 1
        if p == q and left and right:
            groups.append(",".join(left) + "|" + ",".join(right))
            left, right = [], []
    return hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
