import random

import pytest

from vazante.llm import quality as Q
from vazante.llm import subjects as S

PROSE = "O banco central reduziu a taxa de juros nesta quarta-feira, disse o ministro. A decisão era esperada por analistas do mercado.\n"
CASES = {
    "prose": (PROSE * 3, None),
    "prose in capitals": (PROSE.upper() * 3, None),
    "one word a line": (PROSE.replace(" ", "\n") * 2, None),
    "prose with a list": (PROSE * 3 + "- leite\n- pão\n- ovos\n", None),
    "english": ("The council approved the new budget after a long meeting. It will be in force from March, the mayor said.", None),
    "list": ("Compras da semana\n- leite\n- pão de queijo\n- ovos\n- farinha de trigo\n", "list"),
    "plain list": ("\n".join(["relógio", "cabo de rede", "caderno", "mesa dobrável", "tijolo"]), "list"),
    "tab table": ("Nome\tValor\tData\nleite\t3,5\t12/05\npão\t1,2\t13/05\novos\t9\t14/05", "table"),
    "cells": ("<tr><td>leite</td><td>3</td></tr>\n<tr><td>pão</td><td>1</td></tr>", "table"),
    "menu": ("Início | Esportes | Contato | Busca | Entrar | Assine | Fotos | Vídeos", "junk"),
    "repeated": ("Assine já!\n" * 20, "junk"),
    "script": ("var a = document.getElementById('x');\nif(window.y){window.y.push(['load',0]);}", "junk"),
    "signs": ("=====\n~~~~~~~~\n#######", "junk"),
    "tags": ("#um #dois #tres #quatro #cinco", "junk"),
    "empty": ("", None), "blank": (" \n\t ", None), "null": (None, None),
}


@pytest.mark.parametrize("name", CASES)
def test_kinds(name):
    text, kind = CASES[name]
    assert Q.kind_of(Q.State.of(text or "").closed()) == kind


def test_chunks_cover_the_text():
    text = ("palavra " * 50 + "\n") * 20 + "x" * 3000
    for size in (64, 100, 1000):
        parts = list(Q.chunks(text, size))
        assert "".join(p for p, _ in parts) == text
        assert all(len(p) <= size for p, _ in parts[:-1])
    assert any(inside for _, inside in Q.chunks(text, 64))
    assert list(Q.chunks("", 5)) == [("", False)]
    assert [p for p, _ in Q.chunks("<td a b c d e f>um dois tres", 4)] == ["<td a b c d e f>um ", "dois ", "tres"]


SIGNS = [
    "um ", "dois, ", "tres. ", "\n", "\n\n", "| ", "12 ", "• ", "de ", "ã", "  ", "-", "Palavra ", "1. ", "a) ", "2ª ", "- ", "\t", "\r\n", "\r", "\xa0", ";", "();", "{", "<td x ", ">", "</td>",
    "fim…\"", "? ", "?", "»", " > ", " / ", " · ", "#tag ", ",", "3,5", "\ufffd", "início ", "x" * 25, "palavralonga", "_", "[x] ", "(b) ", "\u2028", "日本語", "1º ", "iv. ", "a:b ", "\": ",
]


def whole_and_parts(rng, text, size):
    whole = Q.State.of(text)
    parts = [Q.State.of(p, inside) for p, inside in Q.chunks(text, size)]
    left, right = parts[0], parts[-1]
    for p in parts[1:]:
        left = left.merge(p)
    for p in parts[-2::-1]:
        right = p.merge(right)
    while len(parts) > 1:  # any other order
        k = rng.randrange(len(parts) - 1)
        parts[k : k + 2] = [parts[k].merge(parts[k + 1])]
    return whole.closed(), [left.closed(), right.closed(), parts[0].closed()]


def test_chunks_change_no_count_and_no_kind():
    rng = random.Random(5)
    cut = 0
    for trial in range(3000):
        signs = rng.sample(SIGNS, rng.randint(3, len(SIGNS)))
        text = "".join(rng.choices(signs, k=rng.randint(1, 120)))
        size = rng.choice([1, 5, 20, 60, 200])
        cut += len(list(Q.chunks(text, size))) > 1
        whole, merged = whole_and_parts(rng, text, size)
        for other in merged:
            assert other == whole, (text, size)
            assert Q.kind_of(other) == Q.kind_of(whole)
    assert cut > 2000


def test_long_unbroken_strings_stay_whole():
    rng = random.Random(6)
    for text in ("abc " + "x" * 500 + " fim", "日本語" * 300, "<td " + "a b " * 200, " " * 400 + "fim", "a_b " * 100, "... " * 200):
        whole, merged = whole_and_parts(rng, text, 20)
        assert all(m == whole for m in merged)


def test_statistics_of_a_table(spark):
    rows = [(k, text, "x") for k, (text, _) in enumerate(CASES.values())] + [(90, PROSE * 3000, "x"), (91, "palavra" * 30_000, "x"), (92, "- item\n" * 20_000 + "- outro", "x")]
    docs = spark.createDataFrame(rows, "id long, text string, words string")
    whole = {r.id: r for r in Q.text_statistics(docs, 10**9).collect()}
    split = {r.id: r for r in Q.text_statistics(docs, 2000).collect()}
    assert len(whole) == len(rows)
    for i, r in whole.items():
        s = split[i]
        assert (r.words, r.lines, r.chars, r.kind) == (s.words, s.lines, s.chars, s.kind), i
        assert r.mean_word_length == pytest.approx(s.mean_word_length) and r.item_line_share == s.item_line_share
    assert whole[90].kind is None and whole[91].kind == "junk" and whole[14].words == 0 and whole[14].mean_word_length is None


def test_statistics_of_nothing(spark):
    assert Q.text_statistics(spark.createDataFrame([], "id long, text string")).count() == 0


TOPICS = {"esporte": "gol time placar torneio atleta treino", "saude": "hospital vacina doença médico exame vírus", "economia": "juros banco dólar inflação lucro mercado"}


def sentence(rng, topic):
    return "O relato de hoje cita " + " e ".join(rng.choices(TOPICS[topic].split(), k=5)) + " na cidade de ontem."


def test_subjects_of_mixed_documents(spark):
    rng = random.Random(2)
    docs, labels, truth = [], [], {}
    for k in range(260):
        topics = rng.sample(list(TOPICS), rng.choice([1, 1, 2]))
        docs.append((k, " ".join(sentence(rng, topics[i % len(topics)]) for i in range(6))))
        truth[k] = set(topics)
        if k < 160:
            labels += [(k, t) for t in topics]
    docs += [(900, None), (901, ""), (902, "juros e banco"), (903, " ".join(["Nada disso foi dito por aqui, segundo quem esteve lá."] * 6)), (904, sentence(rng, "saude") * 3000)]
    labels += [(5, None), (None, "saude"), (99_999, "saude"), (7, next(iter(truth[7])))]
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "id long, text string, subject string")
    found: dict = {}
    settings = S.SubjectSettings(buckets=1 << 12)
    for r in S.subjects_of(d, spark.createDataFrame(labels, "id long, subject string"), settings).collect():
        found.setdefault(r.id, set()).add(r.subject)
    held_out = range(160, 260)
    assert sum(found.get(k) == truth[k] for k in held_out) >= 95
    assert not {900, 901, 902} & set(found) and found[904] == {"saude"}


def test_subjects_without_labels(spark):
    docs = spark.createDataFrame([(1, "palavra " * 30)], "id long, text string")
    none = spark.createDataFrame([], "id long, subject string")
    assert S.subjects_of(docs, none).count() == 0
    empty = spark.createDataFrame([], "id long, text string")
    assert S.subjects_of(empty, spark.createDataFrame([(1, "saude")], "id long, subject string")).count() == 0


def test_sentences():
    assert [len(s) for s in S.sentences("Um dois três. Quatro cinco! Seis")] == [3, 2, 1]
    assert len(S.sentences("palavra " * 54)) == 3
