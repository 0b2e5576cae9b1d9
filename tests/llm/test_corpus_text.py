"""Exact dedup, shingle joins, tokens, packing and pieces against brute force on small awkward tables."""

import functools
import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from eligrid.llm.golomb_dedup import exact_duplicates, rice_decode, rice_encode
from eligrid.llm.group_jaccard import jaccard_groups
from eligrid.llm.harmonic_pack import pack, pieces
from eligrid.llm.queries import vocabulary_file
from eligrid.llm.tokens import Encoder
from eligrid.llm.trie_pieces import Pieces, decode, encode
from eligrid.llm.wavelet import WaveletMatrix, dump, parse, read_documents, write_shards

SCHEMA = "doc_id long, text string, kept string, group_size int, text_sha256 string, size int, _found int, lang string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y", 2, 3, None) for i, t in rows], SCHEMA)


def awkward():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    rows = [(1, None), (2, ""), (3, "   \n\t "), (4, "One two"), (5, "one TWO"), (None, "lonely text here now and then"), (None, "lonely text here now and then")]
    rows += [(6, "same row"), (6, "same row"), (7, "é É ß"), (8, "é é ß"), (9, "x" * 200_000), (10, "word " * 60_000)]
    base = [rng.choice(words) for _ in range(120)]
    for i in range(20, 60):
        text = list(base)
        for _ in range(rng.randint(0, 4)):
            text[rng.randrange(len(text))] = rng.choice(words)
        rows.append((i, " ".join(text)))
    rows += [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 40)))) for i in range(60, 120)]
    rows += [(i, "a hot passage that very many of the documents share word for word " + " ".join(rng.choice(words) for _ in range(8))) for i in range(120, 160)]
    rows += [(i, "Copied text of a third of all rows") for i in range(160, 260)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return awkward()


def test_rice_round_trip():
    gaps = np.array([0, 1, 2**40, 7, 0, 99], np.uint64)
    assert (rice_decode(len(gaps), *rice_encode(gaps)) == gaps).all()


@pytest.mark.parametrize("block_rows", [7, 1 << 17])
def test_exact_duplicates(spark, rows, block_rows):
    got = exact_duplicates(table(spark, rows).repartition(3), block_rows=block_rows).collect()
    lower = lambda t: (t or "").encode().lower()
    groups = {}
    for i, t in rows:
        groups.setdefault(lower(t), []).append(i)
    want = sorted(str((i, max((x for x in groups[lower(t)] if x is not None), default=None), len(groups[lower(t)]), hashlib.sha256(lower(t)).hexdigest())) for i, t in rows)
    assert sorted(str((r.doc_id, r.keep_id, r.group_size, r.text_sha256)) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_exact_duplicates_of_nothing(spark):
    assert exact_duplicates(table(spark, [])).collect() == []


def brute_jaccard(rows, words=5, percent=80):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                parent[find(i)] = find(j)
    lowest = {}
    for i, (doc, _) in enumerate(rows):
        lowest.setdefault(find(i), []).append(doc)
    lowest = {k: min((d for d in v if d is not None), default=None) for k, v in lowest.items()}
    return sorted(str((doc, len(sets[i]), lowest[find(i)])) for i, (doc, _) in enumerate(rows))


@pytest.mark.parametrize("frequent_from,frequent_keys", [(8, 2_000_000), (2, 2_000_000), (2, 40), (1000, 10)])
def test_jaccard_groups(spark, rows, frequent_from, frequent_keys):
    got = jaccard_groups(table(spark, rows).repartition(3), frequent_from=frequent_from, frequent_keys=frequent_keys).collect()
    assert sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in got) == brute_jaccard(rows)


def test_jaccard_groups_of_nothing(spark):
    assert jaccard_groups(table(spark, [])).collect() == []


@pytest.mark.parametrize("name,blanks", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_word_by_word_encoding_equals_the_library(rows, name, blanks):
    whole, parts = library(name), Encoder(vocabulary_file(name), blanks)
    rng = random.Random(3)
    signs = "aAbZ éÉßΣİ日  \n\t\r\x1c .,'s!?19<|endoftext|> don't  \n\n "
    texts = [t or "" for _, t in rows] + ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    texts += ["<|ENDOFTEXT|>", "x<|endoftext|>. y", "á ́b é."]
    for t in texts:
        ids = whole.encode(t, add_special_tokens=False).ids
        assert parts.encode(t) == struct.pack(f"<{len(ids)}I", *ids), repr(t)


@functools.cache
def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_file(name))


@functools.cache
def ids_of(name, text):
    return library(name).encode(text or "", add_special_tokens=False).ids + [2]


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


def test_wavelet_matrix_lookups():
    rng = np.random.default_rng(2)
    ids = rng.integers(0, 700, 3000).astype(np.uint32)
    matrix, docs, lengths = parse(dump(ids, [None, 4], [1000, 2000], 10))
    assert (matrix.decode() == ids).all() and docs == [None, 4] and lengths.tolist() == [1000, 2000]
    assert [matrix.access(i) for i in range(0, 3000, 61)] == ids[::61].tolist()
    for symbol in (int(ids[0]), 699, 701, 5000):
        places = np.flatnonzero(ids == symbol).tolist()
        assert matrix.count(symbol) == len(places) and matrix.rank(symbol, 1500) == sum(p < 1500 for p in places)
        assert [matrix.select(symbol, k) for k in range(len(places))] == places
    empty = WaveletMatrix.build(ids[:0], 10)
    assert len(empty.decode()) == 0 and empty.count(3) == 0


@pytest.mark.parametrize("file_ids", [500, 1 << 21])
def test_wavelet_shards(spark, rows, file_ids):
    docs = table(spark, rows).repartition(3)
    got = read_documents(spark, *write_shards(docs, vocabulary_file("byte_bpe_50k.json"), 50257, file_ids=file_ids)).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    at, want = 0, []
    for i, t in order:
        ids = ids_of("byte_bpe_50k.json", t)
        want.append((i, at, len(ids), crc(ids)))
        at += len(ids)
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_harmonic_packing(spark, rows):
    sequences = pack(table(spark, rows).repartition(3), vocabulary_file("word_bpe_49k.json"))
    got = pieces(sequences).collect()
    want = sorted(str((i, ids_of("word_bpe_49k.json", t))) for i, t in rows)
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for members in by_sequence.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096 and at & (at - 1) == 0, "no sequence needs padding"
        assert len({r.length for r in members}) == 1, "a bin belongs to one class"
    held = {r["sequence_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in sequences.collect()}
    assert all(crc(held[r.sequence_id][r.offset : r.offset + r.length]) == r.ids_crc32 for r in got)
    starts = {}
    for r in got:
        starts.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, held[r.sequence_id][r.offset : r.offset + r.length]))
    unique = [(k, v) for k, v in starts.items() if sum(str(w).startswith(f"({k[0]},") for w in want) == 1]
    for (doc, total), parts in unique:
        ids = [x for _, part in sorted(parts) for x in part]
        assert len(ids) == total and str((doc, ids)) in want
    assert sum(r.length for r in got) == sum(len(ids_of("word_bpe_49k.json", t)) for _, t in rows)


def test_shared_prefix_pieces_equal_the_library(spark, rows):
    import sentencepiece

    path = vocabulary_file("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    short = [(i, t if t is None else t[:5000]) for i, t in rows]
    got = decode(encode(table(spark, short).repartition(3), path), path).collect()
    want = sorted(str((i, library.encode(t or ""), t or "")) for i, t in short)
    assert sorted(str((r.doc_id, np.frombuffer(r.ids, "<u4").tolist(), r.decoded)) for r in got) == want
    rng = random.Random(9)
    signs = "aAbeé日本  \n\tthe▁<0x>ing.,0123ß😀"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 30))) for _ in range(800)]
    for text, ids in zip(texts, Pieces(path, "bpe").encode_texts(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text)


def test_whole_long_texts_equal_the_library(spark, rows):
    import sentencepiece

    path = vocabulary_file("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    long = [(i, t) for i, t in rows if t and len(t) > 5000]
    assert max(len(t) for _, t in long) >= 200_000
    got = decode(encode(table(spark, long).repartition(2), path), path).collect()
    assert sorted((r.doc_id, np.frombuffer(r.ids, "<u4").tolist(), r.decoded) for r in got) == sorted((i, library.encode(t), t) for i, t in long)


def test_unigram_pieces_have_the_best_score():
    known = Pieces(vocabulary_file("piece_bpe_32k.model"), "unigram")

    def best(word):
        table = [0.0]
        for end in range(1, len(word) + 1):
            table.append(max(table[s] + (known.scores[known.ids[word[s:end]]] if word[s:end] in known.ids else known.unknown) for s in range(end) if word[s:end] in known.ids or end - s == 1))
        return table[-1]

    for word, ids in known.encode_words({"▁hello", "▁help", "▁helping", "a", "▁"}).items():
        assert sum(known.scores[i] for i in ids) == best(word)


def test_empty_tables(spark):
    none = table(spark, [])
    path = vocabulary_file("piece_bpe_32k.model")
    assert decode(encode(none, path), path).collect() == []
    assert pieces(pack(none, vocabulary_file("word_bpe_49k.json"))).collect() == []
    assert read_documents(spark, *write_shards(none, vocabulary_file("byte_bpe_50k.json"), 50257)).collect() == []


def test_words_before_symbols_are_merged_once():
    import struct

    from eligrid.llm.queries import vocabulary_file
    from eligrid.llm.tokens import Encoder

    encoder = Encoder(vocabulary_file("byte_bpe_50k.json"), True)
    texts = ["Hain*** çelle&&& can't. a_b U.S. x$,. 3%%% it's-- ok!?", "a\nHain***\n***\n.b", "***", "Hain<|endoftext|> Hain***<|endoftext|>", "a***\u0301 b"]
    for text in texts:
        whole = encoder.tokenizer.encode(text, add_special_tokens=False).ids
        assert encoder.encode(text) == struct.pack(f"<{len(whole)}I", *whole)
    words = [a + b for a in "abcdefghij" for b in "klmnopqrst"]
    encoder.encode(" ".join(["a", *(w + "***" for w in words)]))
    assert set(encoder.later) >= set(words)
