"""Token counts, byte-level BPE, packing and language identification."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from jobstrata.llm import byte_bpe, language_id, packing, token_counts
from jobstrata.llm.queries import BYTE_RANKS, WORD_MERGES, WORD_PIECES
from tests.llm import brute


def odd_texts(count):
    rng = random.Random(1)
    signs = list("aàLl'’strevmd 1²  \n\t 　\u0085!?.-🙂日本é́") + ["'s", "'re", "'ll", "'ve", " '", "  \n", "the", "ing"]
    return ["".join(rng.choice(signs) for _ in range(rng.randint(0, 30))) for _ in range(count)] + [None, "", "a" * 5000, "ab" * 3000, "'"]


@pytest.fixture(scope="module")
def odd_docs(spark):
    return spark.createDataFrame(list(enumerate(odd_texts(3000))), "doc_id long, text string")


def test_automaton_is_greedy():
    rng = random.Random(2)
    for _ in range(60):
        initial = {"".join(rng.choices("abc", k=rng.randint(1, 4))) for _ in range(rng.randint(1, 12))}
        inner = {"".join(rng.choices("abc", k=rng.randint(1, 4))) for _ in range(rng.randint(0, 12))}
        automaton = token_counts.Automaton(initial, inner)
        for _ in range(60):
            word = "".join(rng.choices("abcd", weights=[5, 5, 5, 1], k=rng.randint(1, 12)))
            assert automaton.count(word) == (brute.greedy_pieces(word, initial, inner) or 0), (word, initial, inner)


def test_token_counts(odd_docs, edge_docs, no_docs):
    initial, inner = map(set, token_counts.vocabulary(WORD_PIECES))
    texts = dict(enumerate(odd_texts(3000)))
    for r in token_counts.count_tokens(odd_docs, WORD_PIECES).collect():
        found = [brute.greedy_pieces(w, initial, inner) for w in token_counts.SPLIT.findall(texts[r.doc_id] or "")]
        assert (r.n_words, r.n_tokens, r.n_unknown) == (len(found), sum(n or 1 for n in found), found.count(None))
    rows = token_counts.count_tokens(edge_docs, WORD_PIECES).collect()
    assert len(rows) == edge_docs.count() and all(r.n_tokens == 0 for r in rows if r.doc_id in (4, 5, 6))
    assert token_counts.count_tokens(no_docs, WORD_PIECES).count() == 0


def test_bpe_equals_tiktoken(odd_docs, edge_docs, no_docs):
    with open(BYTE_RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for docs in (odd_docs, edge_docs):
        encoded = byte_bpe.encode(docs, BYTE_RANKS)
        texts = docs.select("doc_id", "text").collect()
        rows = encoded.collect()
        assert [r.doc_id for r in rows] == [t.doc_id for t in texts]
        for r, t in zip(rows, texts):
            ids = coder.encode_ordinary(t.text or "")
            assert r.ids == ids
            assert r.ends == list(np.cumsum([len(coder.decode_single_token_bytes(i)) for i in ids]))
        for r, t in zip(byte_bpe.digests(byte_bpe.decode(encoded, BYTE_RANKS)).collect(), texts):
            ids = coder.encode_ordinary(t.text or "")
            assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
            assert r.decoded_sha256 == hashlib.sha256((t.text or "").encode()).hexdigest()
    assert byte_bpe.digests(byte_bpe.decode(byte_bpe.encode(no_docs, BYTE_RANKS), BYTE_RANKS)).count() == 0


def test_long_merges_equal_short_ones():
    rng = random.Random(4)
    ranks = {bytes([b]): b for b in range(256)}
    for rank in range(256, 400):
        ranks.setdefault(b"".join(rng.choice(list(ranks)) for _ in range(2))[:9], rank)
    ranks = {t: r for t, r in ranks.items()}
    for _ in range(200):
        piece = bytes(rng.choices(range(90, 100), k=rng.randint(2, 60)))
        assert byte_bpe._merge_long(piece, ranks) == byte_bpe.merge(piece, ranks) or piece in ranks


def test_packing(odd_docs, edge_docs, no_docs):
    tokenizer = Tokenizer.from_file(WORD_MERGES)
    tokenizer.encode_special_tokens = True
    for docs in (odd_docs, edge_docs):
        rows = packing.pack(docs, WORD_MERGES).toPandas()
        want = sorted(
            (str(t.doc_id), start, zlib.crc32(np.array(ids[start:start + 4096], "<u4").tobytes()), len(ids))
            for t in docs.select("doc_id", "text").collect()
            for ids in [tokenizer.encode(t.text or "", add_special_tokens=False).ids + [2]] for start in range(0, len(ids), 4096))
        ids = [str(None if i != i else int(i)) for i in rows.doc_id]
        assert sorted(zip(ids, rows.start, rows.ids_crc32, rows.doc_tokens)) == want
        for _, window in rows.sort_values("offset").groupby("sequence_id"):
            assert list(window.offset) == [0, *window.length.cumsum()[:-1]] and window.length.sum() <= 4096
    assert packing.pack(no_docs, WORD_MERGES).count() == 0


def test_best_fit_decreasing():
    rng = np.random.default_rng(0)
    for _ in range(100):
        window = int(rng.choice([7, 64, 100, 4096]))
        lengths = rng.integers(1, window + 1, int(rng.integers(0, 60)))
        number, offset = packing.best_fit(lengths, window)
        room = []
        for i in np.argsort(-lengths, kind="stable"):
            fits = [r for r in room if r >= lengths[i]]
            if fits:
                tightest = min(fits)
                assert window - offset[i] == tightest
                room.remove(tightest)
            else:
                assert offset[i] == 0
                tightest = window
            room.append(tightest - lengths[i])
        assert len(room) == len(set(number.tolist()))


def test_language(spark, sf_dir, edge_docs, no_docs):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    filters = language_id.learn(docs)
    held = docs.where(language_id.held_out(F.col("doc_id")) & F.col("lang").isNotNull())
    pairs = language_id.identify(held, filters).join(held.select("doc_id", "lang"), "doc_id").collect()
    assert len(pairs) > 30 and sum(r.lang == r.lang_pred for r in pairs) >= 0.95 * len(pairs)
    rows = language_id.identify(edge_docs, filters).collect()
    assert len(rows) == edge_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert all((r.lang_pred, r.score) == ("und", 0) for r in rows if r.doc_id in (4, 5, 6, 11))
    assert {r.lang_pred for r in language_id.identify(edge_docs, language_id.learn(no_docs)).collect()} == {"und"}
    assert language_id.identify(no_docs, filters).count() == 0


def test_many_languages():
    """More languages than bits in a word; counts are corrected by each filter's filling."""
    import pyarrow as pa

    names = [f"l{n:03}" for n in range(130)]
    filters = language_id.Filters(names)
    rng = random.Random(6)
    texts = {n: " ".join("".join(rng.choices("abcdefghijklmnop", k=8)) for _ in range(30)) for n in names}
    for name, text in texts.items():
        for _, hashes, _ in language_id._grams(pa.array([text])):
            filters.add(name, hashes)
    languages, score = filters.close().predict(pa.array(list(texts.values())))
    assert languages == names and min(score) > 0.9
