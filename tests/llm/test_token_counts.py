import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models, normalizers

from demandgrid.llm import token_counts
from demandgrid.llm.token_counts import SPACE, Vocabulary

PATH = public_tokenizers.path("piece_bpe_32k.model")


def exact(pieces, fallback):
    t = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=fallback))
    t.normalizer = normalizers.Sequence([normalizers.Prepend(SPACE), normalizers.Replace(" ", SPACE)])
    return t


@pytest.fixture(scope="module")
def pair():
    own = Vocabulary.load(PATH)
    return own, exact(with_bytes(own.pieces), True)


def with_bytes(pieces):
    """The pieces as that library wants them: an unknown one first, and those of the bytes that unknown characters fall back to."""
    return [("<unk>", 0.0), *((f"<0x{i:02X}>", 0.0) for i in range(256)), *pieces]


def plain_count(pieces, text):
    """Pieces of the best path, every substring looked up; longer last pieces win ties."""
    score = dict(pieces)
    longest, unknown = max(map(len, score)), min(score.values()) - 10
    marked = SPACE + text.replace(" ", SPACE)
    best = [(0.0, 0)]
    for end in range(1, len(marked) + 1):
        top = None
        for start in range(max(0, end - longest), end):
            if (part := marked[start:end]) in score:
                value = best[start][0] + score[part], best[start][1] + 1
            elif end - start == 1:
                value = best[start][0] + unknown, best[start][1] + len(part.encode())
            else:
                continue
            if top is None or value[0] > top[0]:
                top = value
        best.append(top)
    return best[-1][1]


def test_names_of_other_pieces_are_text(pair):
    """Against the pieces that the file marks as normal, read here again."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    other = {model.id_to_piece(i) for i in range(model.vocab_size()) if model.is_control(i) or model.is_unknown(i) or model.is_byte(i)}
    assert other and not other & {p for p, _ in pair[0].pieces}
    for text in ("a</s>b", "<s>", "x <unk> y", "<0x0A><0x41>", "\x07 a<s></s>"):
        assert pair[0].count(text) == plain_count(pair[0].pieces, text)
    assert pair[0].count("a</s>b") > 3


def test_counts_of_documents(documents, hard_texts, prose, pair):
    texts = [*hard_texts, *(prose(i, 300) for i in range(5)), "a   b    c ", "   ", SPACE + " x", "tab\tand\r\nlines\n\n\n"]
    rows = token_counts.count_tokens(documents(list(enumerate(texts))), PATH).collect()
    want = {i: len(pair[1].encode(t, add_special_tokens=False).ids) if t else 0 for i, t in enumerate(texts)}
    assert {r.doc_id: r.n_tokens for r in rows} == want
    assert token_counts.count_tokens(documents([]), PATH).collect() == []


@settings(max_examples=300, deadline=None)
@given(text=st.text(alphabet=st.sampled_from("ab c\n" + SPACE + "éß漢"), max_size=30))
def test_ties_follow_the_tokenizer(text):
    pieces = [("<unk>", 0.0), (SPACE, -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("ba", -2.0), ("aba", -3.0), (SPACE + "a", -2.0), ("bab", -2.5), ("é", -4.0)]
    own, other = Vocabulary(pieces, False), exact(pieces, False)
    assert own.count(text) == (len(other.encode(text, add_special_tokens=False).ids) if text else 0)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_any_text(text):
    own = test_any_text.__dict__.setdefault("own", Vocabulary.load(PATH))
    other = test_any_text.__dict__.setdefault("other", exact(with_bytes(own.pieces), True))
    assert own.count(text) == (len(other.encode(text, add_special_tokens=False).ids) if text else 0)
