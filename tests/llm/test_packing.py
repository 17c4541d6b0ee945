import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from demandgrid.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def ids(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [0]


def test_pieces_are_those_of_the_tokenizer(documents, hard_texts, tokenizer):
    rows = packing.pack(documents(list(enumerate(hard_texts))), PATH).collect()
    for doc_id, text in enumerate(hard_texts):
        want = ids(tokenizer, text)
        own = sorted((r for r in rows if r.doc_id == doc_id), key=lambda r: r.start)
        assert [r.start for r in own] == [0, *np.cumsum([r.length for r in own])[:-1]]
        assert sum(r.length for r in own) == len(want) == own[0].doc_tokens
        for r in own:
            assert r.ids_crc32 == zlib.crc32(np.array(want[r.start : r.start + r.length], "<u4").tobytes())


def test_sequences_are_full_and_gapless(documents, prose):
    table = documents([(i % 300, prose(i, i % 97 * 5)) for i in range(400)])
    rows = packing.pack(table, PATH, size=256).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    assert sorted(by) == list(range(len(by)))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 256
    assert sum(r.length for r in rows) > 0.98 * 256 * len(by)


def test_added_tokens_are_those_of_the_file(documents, tokenizer):
    texts = ["hello <|endoftext|> world", "<|endoftext|>", "a<|endoftext|><|endoftext|>b", "<|endoftext", "x <|ENDOFTEXT|>"]
    assert len(ids(tokenizer, texts[1])) == 2
    rows = packing.pack(documents(list(enumerate(texts))), PATH).collect()
    got = {r.doc_id: (r.doc_tokens, r.ids_crc32) for r in rows}
    want = [ids(tokenizer, t) for t in texts]
    assert got == {i: (len(w), zlib.crc32(np.array(w, "<u4").tobytes())) for i, w in enumerate(want)}


def test_empty_table(documents):
    assert packing.pack(documents([]), PATH).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 500), max_size=20))
def test_patterns_hold_every_length_once(lengths):
    held = Counter()
    for pattern, packs in packing.shortest_pack_first(lengths, 64):
        assert packs > 0 and sum(n * times for n, times in pattern) <= 64
        for n, times in pattern:
            held[n] += times * packs
    assert held == Counter(lengths)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=80), st.lists(st.sampled_from(["<|endoftext|>", " ", "a", "\n", "<|"])).map("".join), st.text(alphabet=st.sampled_from("ab's T\n\t é12ß!_<|>"), max_size=60)))
def test_any_text_gets_the_same_ids(text):
    encoder, tokenizer = test_any_text_gets_the_same_ids.__dict__.setdefault("pair", (packing.Encoder(PATH), Tokenizer.from_file(PATH)))
    assert encoder(text) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
