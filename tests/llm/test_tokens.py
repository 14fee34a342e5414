import random

import pytest

from vazante.llm import tokens as T
from vazante.llm.transducer import Lexicon, _minimal, compile_lexicon

TEXTS = [
    "", None, " ", "\n\n", "a", "O gato's  comeu 12,5% — não?", "\x1c a\x1d\x1e b\x1f", "​ x ", "日本語 ١٢٣ ½ ⅷ",
    "<|endoftext|> fim", "\r\n\r\n a\t\tb ", "é ñ", "palavra " * 3000, "x" * 20_000, " " * 5000, "mesma linha", "mesma linha",
]


@pytest.fixture(scope="module")
def public():
    tokenizers = pytest.importorskip("tokenizers")
    try:
        t = tokenizers.Tokenizer.from_file(f"{T.TOKENIZER_DIR}/byte_bpe_50k.json")
    except Exception:
        pytest.skip("no vocabulary")
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_ids_equal_the_public_tokenizer(spark, public):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    for entries in (1, 5, 4000):  # whatever the lexicon holds, the ids are the same
        got = {r.id: r.ids for r in T.encode(docs, T.Vocabulary(entries=entries)).collect()}
        assert got == {k: public(t) for k, t in enumerate(TEXTS)}


def test_counts_are_lengths_and_extra_columns_are_ignored(spark, public):
    rows = [(k, "s", t, "clash") for k, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "id long, source string, text string, tokens string")
    assert {r.id: r.tokens for r in T.token_counts(docs).collect()} == {k: len(public(t)) for k, t in enumerate(TEXTS)}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "id long, text string")
    assert T.encode(docs).collect() == []


def test_automaton_is_minimal_and_ranks_are_exact():
    rng = random.Random(3)
    words = sorted({bytes(rng.choices(b"ab", k=rng.randint(1, 7))) for _ in range(90)})
    lexicon = Lexicon(compile_lexicon((w, [k, k + 1]) for k, w in enumerate(words)))
    others = [b"", b"c", b"ab" * 9]
    assert lexicon.ranks(words + others).tolist() == [*range(len(words)), -1, -1, -1]
    assert lexicon.pool[lexicon.offset[5] : lexicon.offset[6]].tolist() == [5, 6]

    def language(edges, final, state, word=b""):
        here = {word} if final[state] else set()
        for label, target in edges[state].items():
            here |= language(edges, final, target, word + bytes([label]))
        return here

    edges, final = _minimal(words)
    assert language(edges, final, 0) == set(words)
    reached, todo = set(), [0]
    while todo:
        s = todo.pop()
        if s not in reached:
            reached.add(s)
            todo += edges[s].values()
    rights = [frozenset(language(edges, final, s)) for s in reached]
    assert len(set(rights)) == len(rights)  # no two states accept the same rest


def test_file_is_mapped(tmp_path):
    path = tmp_path / "lexicon"
    path.write_bytes(compile_lexicon([(b"um", [7]), (b"uma", [8, 9])]))
    assert Lexicon(str(path)).ranks([b"uma", b"um", b"u"]).tolist() == [1, 0, -1]


def test_empty_lexicon():
    assert Lexicon(compile_lexicon([])).ranks([b"a", b""]).tolist() == [-1, -1]
