import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quantloom.llm import bpe, token_counts, token_ids
from quantloom.llm._store import Scratch
from quantloom.llm._words import WordEncoder, tokenizer_path

WORD, BYTE = "word_bpe_49k.json", "byte_bpe_50k.json"
ODD = ["", " ", "  ", "it's they're 'sun ’s 'S x'sy''s !'s 12 345 don't 've", " a  b\n\n c \n d \t", "é É ΑΣ İstanbul ﬁ x　y", "a<|endoftext|>b <|startoftext|><|endoftext|>", "\x1c a\x85b c\x00d \x1f", "x" * 3000, "ab'c" * 4000, "aaaa" * 900 + " " * 100 + "b", "日本語テキスト" * 50, "é" * 40, "\n" * 50 + "x", "word " * 5000]
ALPHABET = st.text(alphabet=st.sampled_from(list("abtTheS's'llre 1 .\n\té́Σ日<|>endoftext")), max_size=80)


@pytest.fixture(scope="module")
def word():
    return Tokenizer.from_file(tokenizer_path(WORD)), WordEncoder(WORD)


@pytest.fixture(scope="module")
def byte():
    return Tokenizer.from_file(tokenizer_path(BYTE)), token_counts.TokenCounter(BYTE), token_counts.TokenCounter(BYTE, chunk=7)


def test_words_and_chunks_encode_as_the_library(word):
    library, encoder = word
    chunks = bpe.ChunkEncoder(encoder).encode(ODD)
    ids, at = encoder.encode(ODD)
    for k, text in enumerate(ODD):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids[at[k] : at[k + 1]].tolist() == want == chunks[k].tolist()
        assert encoder.decode(chunks[k]) == library.decode(want, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(ALPHABET)
def test_random_texts_encode_as_the_library(word, text):
    library, encoder = word
    want = library.encode(text, add_special_tokens=False).ids
    assert encoder.encode([text])[0].tolist() == want
    assert bpe.ChunkEncoder(encoder).encode([text * 9])[0].tolist() == library.encode(text * 9, add_special_tokens=False).ids


def test_small_caches_start_anew():
    encoder = WordEncoder(WORD, 3, 2)
    library = Tokenizer.from_file(tokenizer_path(WORD))
    for _ in range(2):
        for text in ("one two three", "four five six seven", "one six"):
            assert encoder.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_shared_passages_have_shared_chunks():
    rng = np.random.default_rng(0)
    make = lambda n: " ".join("".join(map(chr, rng.integers(97, 123, 6))) for _ in range(n))
    passage = make(3000)
    parts = []
    for start in (make(200), make(500)):
        text = start + passage
        ends = bpe.chunk_ends(text)
        assert ends[-1] == len(text) and all(0 < b - a <= bpe.MOST for a, b in zip([0, *ends], ends))
        parts.append({text[a:b] for a, b in zip([0, *ends], ends)})
    assert len(parts[0] & parts[1]) > 5


def test_transducer_counts_as_the_library(byte):
    library, counter, short = byte
    for text in ODD:
        want = len(library.encode(text, add_special_tokens=False).ids)
        assert counter.count(text.encode()) == want
        if len(text) < 3000:
            assert short.count(text.encode()) == want


@settings(max_examples=300, deadline=None)
@given(ALPHABET)
def test_random_counts(byte, text):
    library, counter, short = byte
    want = len(library.encode(text, add_special_tokens=False).ids)
    assert counter.count(text.encode()) == want == short.count(text.encode())


def test_chunk_maps_compose_associatively(byte):
    machine = byte[2].machine
    maps = byte[2].chunk_maps("The cat's hat isn't there, unbelievable words")
    left = maps[0]
    for m in maps[1:]:
        left = left.then(m, machine)
    right = maps[-1]
    for m in maps[-2::-1]:
        right = m.then(right, machine)
    scanned = token_counts.prefix_scan(maps, machine)[-1]
    assert left.apply(machine, 0) == right.apply(machine, 0) == scanned.apply(machine, 0)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 50_000), st.integers(0, 2**32 - 1)), max_size=900), st.integers(0, 900), st.integers(0, 900))
def test_blocks_give_back_the_ids(ids, a, b):
    data = token_ids.pack(np.array(ids, np.uint32))
    assert token_ids.unpack(data).tolist() == ids
    assert token_ids.unpack(data, a, b).tolist() == ids[a:b]


def test_foreign_bytes_are_refused():
    with pytest.raises(ValueError):
        token_ids.unpack(b"XXXX" + bytes(16))


ROWS = [(5, "a b c", 1), (3, None, 2), (4, "", 3), (9, "Hello there " * 3000, 4), (5, "a b c", 5), (None, "no id", 6)]
SCHEMA = "doc_id long, text string, part int"


def test_counts_of_a_table(spark):
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(spark.createDataFrame(ROWS, SCHEMA)).collect()), key=str)
    library = Tokenizer.from_file(tokenizer_path(BYTE))
    size = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    assert got == sorted(((d, len((t or "").encode()), size(t), size(t) > 1024) for d, t, _ in ROWS), key=str)
    assert token_counts.count_tokens(spark.createDataFrame([], SCHEMA)).count() == 0


def test_encoding_of_a_table(spark):
    library = Tokenizer.from_file(tokenizer_path(WORD))
    got = bpe.encode_decode(spark.createDataFrame(ROWS, SCHEMA), with_ids=True).collect()
    assert len(got) == len(ROWS)
    texts = {d: t or "" for d, t, _ in ROWS}
    for r in got:
        want = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.ids == want and r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(want, skip_special_tokens=False).encode()).hexdigest()


def test_token_files(spark):
    library = Tokenizer.from_file(tokenizer_path(WORD))
    scratch = Scratch(spark, "t10")
    got = token_ids.read_token_files(token_ids.write_token_files(spark.createDataFrame(ROWS, SCHEMA), scratch, segment_ids=50), scratch).orderBy("start").collect()
    start = 0
    for r, (d, t, _) in zip(got, sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0))):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert len(got) == len(ROWS)
    empty = Scratch(spark, "t10e")
    assert token_ids.read_token_files(token_ids.write_token_files(spark.createDataFrame([], SCHEMA), empty), empty).count() == 0


def test_word_cache_is_packed_and_bounded():
    encoder = WordEncoder("word_bpe_49k.json")
    texts = [f"running word{k} of the x{k * 7919} corpus, it's 'quoted'" for k in range(2000)]
    fresh, at = encoder.encode(texts)
    assert all(isinstance(ids, bytes) for ids in encoder.words.values())  # four bytes an id, no objects
    assert encoder.most_raw <= 350_000 and encoder.most_words <= 200_000
    small = WordEncoder("word_bpe_49k.json", most_raw=100, most_words=50)
    parts = [small.encode(texts[k : k + 20])[0] for k in range(0, len(texts), 20)]
    assert np.concatenate(parts).tolist() == fresh.tolist() and at[-1] == len(fresh)
    assert len(small.index) < 400 and len(small.words) < 400
