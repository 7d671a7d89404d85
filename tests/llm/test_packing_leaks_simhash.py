"""Packing, benchmark search and SimHash against brute force."""

import zlib

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from labelmill.llm import decontaminate, packing, queries, simhash

DOCS = "doc_id long, text string, lang string, sequence_id string, fp string, root string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, None, "x", "y", "z") for i, t in rows], DOCS)


EDGE = [(1, None), (2, ""), (3, "one"), (4, "one two"), (5, "a b c " * 3000), (5, "a b c " * 3000), (None, "null id"),
        (6, "Ünïcode ’s don't <|endoftext|> x\x1fy z   fin"), (7, "<|endoftext|>"), (8, "a<| b|>  \t\n c")]


def tokens(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [2]


@pytest.mark.parametrize("source", ["edge", "table"])
def test_packing_holds_every_id_once(spark, source):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    if source == "edge":
        docs, size = docs_of(spark, EDGE).repartition(5), 64
    else:
        docs, size = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(20), 4096
    want = {}
    for row in docs.collect():
        want.setdefault(row.doc_id, []).append(tokens(tokenizer, row.text))
    pieces = packing.pack(docs, queries.tokenizer_path(), size=size, spaces=4).collect()
    by_doc = {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
    assert by_doc.keys() == want.keys()
    for doc, own in by_doc.items():
        assert sum(p.length for p in own) == sum(map(len, want[doc]))
        for p in own:
            assert any(p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(np.array(
                ids[p.start:p.start + p.length], dtype="<u4").tobytes()) for ids in want[doc])
    by_sequence = {}
    for p in pieces:
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    used = sum(p.length for p in pieces)
    assert used >= 0.9 * size * (len(by_sequence) - 4)
    assert packing.pack(docs_of(spark, []), queries.tokenizer_path()).count() == 0


def brute_hits(docs, items):
    def shingles(text, width=None):
        words = decontaminate.words_of(text)
        width = width or min(5, len(words))
        return {tuple(words[i:i + width]) for i in range(len(words) - width + 1)} if words else set(), width

    out = set()
    for item, text in items:
        own, width = shingles(text or "")
        for doc, body in docs:
            shared = len(own & shingles(body or "", width)[0]) if own else 0
            if own and shared >= 0.8 * len(own):
                out.add((doc, item, shared))
    return out


def test_benchmark_hits(spark, monkeypatch):
    monkeypatch.setattr(decontaminate.common, "BLOCK_BYTES", 3000)
    text = " ".join(f"w{i}" for i in range(40))
    long = " ".join(f"x{i % 977}y{i}" for i in range(3000))
    rows = [(1, None), (2, ""), (3, text.upper()), (4, f"{long} {text.replace(' ', ', ')}! {long}"), (5, text[:90]),
            (6, "w1 w2 w3"), (None, text), (8, "w0 w1 " + text.replace("w20", "zz")), (8, text), (9, f"«{text}»—{text}")]
    items = [(1, text), (2, "w1 w2"), (3, None), (4, ""), (5, "!!"), (1, text), (None, "w1 w2 w3 w4")]
    bench = spark.createDataFrame([(i, t, "c") for i, t in items], "item_id long, text string, doc_id string")
    for block in (1 << 20, 100):
        got = [(r.doc_id, r.item_id, r.shared_shingles) for r in
               decontaminate.benchmark_hits(docs_of(spark, rows), bench, block_bytes=block).collect()]
        assert set(got) == brute_hits(rows, items)
    kept = decontaminate.clean_documents(docs_of(spark, rows), bench.filter("item_id = 1"))
    assert kept.columns == [c.split()[0] for c in DOCS.split(", ")]
    assert {r.doc_id for r in kept.collect()} == {1, 2, 5, 6}
    assert decontaminate.benchmark_hits(docs_of(spark, []), bench).count() == 0
    assert decontaminate.benchmark_hits(docs_of(spark, rows), bench.limit(0)).count() == 0


def test_benchmark_hits_on_table(spark):
    folder = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id, r.shared_shingles) for r in queries.op5_decontaminate(spark, folder).collect()}
    assert got == brute_hits(docs, items)


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    values = sorted(set(fps))
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    return {v: find(v) for v in values}


def check_simhash(rows, found):
    fps = [brute_fingerprint(t) for _, t in rows]
    root = brute_components(fps)
    least = {}
    for (doc, _), fp in zip(rows, fps):
        have = least.get(root[fp])
        least[root[fp]] = doc if have is None else have if doc is None else min(have, doc)
    want = sorted(((doc, fp, least[root[fp]]) for (doc, _), fp in zip(rows, fps)), key=str)
    assert sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in found), key=str) == want


@pytest.mark.parametrize("shard_rows", [20_000, 30])
def test_simhash_components(spark, shard_rows):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows += [(None if i is None else i + 5000, t) for i, t in EDGE]
    base = " ".join(f"w{i}" for i in range(300))
    rows += [(1000 + i, base.replace(f"w{i} ", f"v{i} ")) for i in range(60)] + [(2000, base), (2001, base)]
    docs = docs_of(spark, rows)
    check_simhash(rows, simhash.near_duplicates(docs, shard_rows).collect())
    kept = simhash.keep_one(docs, shard_rows)
    assert kept.columns == docs.columns
    least = {r.component_id for r in simhash.near_duplicates(docs, shard_rows).collect()}
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted(least, key=str)
    assert simhash.near_duplicates(docs_of(spark, [])).count() == 0


def test_close_pairs_are_exact():
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (40, 60, 3)).astype(np.uint64)
    points = np.unique(centre[:, None] ^ flips[..., 0] ^ flips[..., 1] ^ (flips[..., 2] * (rng.random((40, 60)) < 0.5)))
    got = {(a, b) for x, y in simhash.close_pairs(points, 2) for a, b in zip(x.tolist(), y.tolist())}
    want = {(i, j) for i in range(len(points)) for j in np.flatnonzero(
        np.bitwise_count(points ^ points[i]) <= 2).tolist() if i < j}
    assert got == want
    tree = simhash.shard_tree(points[::3], 40, 2)
    met = set()
    for _, at in simhash.route(points, tree, 2):
        met |= {(a, b) for a, b in want if a in set(at.tolist()) and b in set(at.tolist())}
    assert met == want


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(100, 101), (101, 100), (7, 7)], "u long, v long")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {101: 100}


@pytest.mark.parametrize("limit", [40, 200, 3000])
def test_long_texts_are_searched_whole(monkeypatch, limit):
    """Texts cut into parts give what whole texts give, also for items that lie across cuts."""
    monkeypatch.setattr(decontaminate.common, "BLOCK_BYTES", limit)
    rng = np.random.default_rng(limit)
    vocabulary = ["über", "the", "x1", "naïve", "—", "y", "«z»", "日本", "and"] + [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary, n))) for i, n in enumerate((3, 6, 9, 25, 60))]
    texts = [None, "", "   "]
    for _ in range(25):
        parts = [" ".join(rng.choice(vocabulary, rng.integers(0, 40))) for _ in range(4)]
        parts[rng.integers(4)] += " " + items[rng.integers(5)][1].upper()
        texts.append(rng.choice([" ", "\n", ", "]).join(parts))
    index = decontaminate.Index(items, 0.8)
    got = {(row, index.items[item][0], shared) for row, item, shared in decontaminate._hits(index, texts, 0.8)}
    assert got == brute_hits(list(enumerate(texts)), items)


def test_every_letter_before_a_sign_has_the_tokenizer_s_ids():
    """A letter may be taken apart by the tokenizer, so the sign behind it must not be cut off."""
    import sys

    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    tokenizer = Tokenizer.from_file(path)
    letters = [c for c in map(chr, range(sys.maxunicode + 1)) if c.isalpha()]
    letters = [c for c in letters if not "一" <= c <= "鿿" and not "가" <= c <= "힣" and c < "\U00020000"]
    words = [w for c in letters for w in (f"{c}.", f"a{c},", f"{c}b.", f"A{c}B,")]
    for at in range(0, len(words), 5000):
        texts = [" ".join(words[i:i + 50]) for i in range(at, min(at + 5000, len(words)), 50)]
        want = tokenizer.encode_batch(texts, add_special_tokens=False)
        for text, ids, e in zip(texts, packing.word_ids(path).encode(texts), want):
            assert ids.tolist() == e.ids, text
    assert packing.word_ids(path).encode(["Ali İ. Yılmaz dedi."])[0].tolist() == tokens(tokenizer, "Ali İ. Yılmaz dedi.")[:-1]
