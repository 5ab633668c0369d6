import random

import numpy as np
import pytest

from lodestar.llm import language as G

EN = ["The analyst closed the lead before the flow had expired.", "Nobody on the branch remembers installing tevezi.exe on lab-x-7.", "Please check whether the driver also appears on other machines."]
DE = ["Die Nachtschicht fand den Treiber auf ws-pirati-46, bis die Besitzerin es bestätigt hat.", "Bitte prüfen, ob man die Datei auch auf anderen Rechnern sieht.", "Das Prüfgremium konnte es nicht nachstellen."]
ES = ["La analista cerró la pista porque nadie había aprobado el cambio.", "El equipo de triaje no pudo reproducirlo en los demás equipos."]
RU = ["Никто в филиале не помнит, чтобы это устанавливали на этой машине."]
JA = ["この支店のほかの端末にも予期しない接続があるかどうか確認してください。"]
LOG = "2025-03-21T00:00:00Z INFO [op-1] rows=5 | flow=F.1\n> listen 0.0.0.0:38286\n| tevezi.exe | 3 | 0xff |"


@pytest.fixture(scope="module")
def model():
    r = random.Random(1)
    rows = []
    for _ in range(60):
        for lang, s in (("en", EN), ("de", DE), ("es", ES), ("ru", RU), ("ja", JA)):
            rows.append((lang if r.random() < 0.85 else "nl", " ".join(r.choices(s, k=3))))
    return G.train(rows)


def spans(spark, model, docs):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "doc_id long, text string")
    return {(r.doc_id, r.para_no): (r.lang, r.sentences) for r in G.label_spans(df, model).where("sentences > 0 and (para_no = 0 or not main)").collect()}


def test_documents_and_stretches(spark, model):
    docs = [
        " ".join(EN),
        f"## heading\n\n{DE[0]} {DE[1]}\n\n{LOG}\n\n{EN[0]} {DE[2]}\n \n> {JA[0]}",
        "\r\n\r\n".join([ES[0], ES[1], RU[0]]),
        LOG,
        "",
        None,
        "   \n ",
        JA[0] * 3,
        "* " + EN[0].replace(" ", "\n> "),
        (DE[0] + " ") * 4000 + "\n\n" + EN[1],
        "mahefo-64 / hinese.exe\n\nEN heading without sign",
    ]
    assert spans(spark, model, docs) == {
        (0, 0): ("en", 3), (1, 0): ("de", 3), (1, 4): ("en", 1), (1, 5): ("ja", 1), (2, 0): ("es", 2), (2, 3): ("ru", 1),
        (7, 0): ("ja", 3), (8, 0): ("en", 1), (9, 0): ("de", 4000), (9, 2): ("en", 1),
    }


def test_labels(spark):
    good = ["en", " EN ", "en-US", "en_GB", "eng"]
    bad = [None, "", "  ", "und", "xx", "zxx", "de", "deu", "unknown"]
    rows = [(i, " ".join(EN), lab, "c") for i, lab in enumerate(good + bad)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, label string")
    got = sorted(tuple(r) for r in G.languages_found(df.union(df.limit(3))).collect())
    assert got == [(i, 0, "en") for i in range(len(good), len(good + bad))]


def test_empty(spark):
    assert G.languages_found(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0


def test_viterbi_as_brute_force():
    import itertools

    r = np.random.default_rng(3)
    for _ in range(40):
        n, k = int(r.integers(1, 7)), 3
        s = r.normal(0, 3, (n, k))
        best = max(itertools.product(range(k), repeat=n), key=lambda p: sum(s[i, x] for i, x in enumerate(p)) - 2.0 * sum(a != b for a, b in itertools.pairwise(p)))
        assert tuple(G.viterbi(s, np.array([0]), np.array([n]), 2.0)) == best
    s = r.normal(0, 3, (12, 3))
    both = G.viterbi(s, np.array([0, 5, 5]), np.array([5, 0, 7]), 2.0)
    assert (both == np.concatenate([G.viterbi(s[:5], np.array([0]), np.array([5]), 2.0), G.viterbi(s[5:], np.array([0]), np.array([7]), 2.0)])).all()


def test_held_out_accuracy(spark, small):
    """On documents not trained on, the found language is the label's in most cases; labels themselves are partly wrong."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    train, test = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")
    m = G.train(G.training_rows(train))
    got = {r.doc_id: r.lang for r in G.label_spans(test, m).where("para_no = 0").collect()}
    told = [(got[r.doc_id], G.label_code(r.lang)) for r in test.collect() if r.doc_id in got and G.label_code(r.lang)]
    assert sum(a == b for a, b in told) > 0.8 * len(told)


def test_undetermined_and_broken_sentences(spark):
    model = G.train([])
    docs = [(1, "Η ομάδα βρήκε το αρχείο στον διακομιστή σήμερα."), (2, "Користувач відкрив файл і їхній запит був виконаний."), (3, "管理员发现服务器上存在可疑文件并立即采取了措施。"), (4, "Qwrt zxcv bnmp lkjh."), (5, "the file of the host"), (6, None), (7, ""), (8, "攻撃者は端末にログインした。")]
    got = {r.doc_id: r for r in G.label_spans(spark.createDataFrame(docs, "doc_id long, text string"), model).where("para_no = 0").collect()}
    assert {i: r.lang for i, r in got.items()} == {1: "und", 2: "und", 3: "und", 4: "und", 5: "en", 6: "und", 7: "und", 8: "ja"}
    assert got[5].sentences == 0 and got[6].confidence == 0 and got[8].sentences == 1


def test_segments_have_places(spark):
    model = G.train([])
    text = "The user was in the file and it is not on the list of the host.\nIt is that.\n\nDer Angreifer ist auf dem Rechner und die Datei ist nicht mit der Liste\nvon dem Host."
    got = G.label_segments(spark.createDataFrame([(5, text), (6, None)], "doc_id long, text string"), model).orderBy("segment_no").collect()
    assert [(r.doc_id, r.segment_no, r.para_no, r.first_line, r.last_line, r.lang) for r in got] == [(5, 1, 1, 1, 2, "en"), (5, 2, 2, 4, 5, "de")]


def test_repeated_ids_keep_their_labels(spark):
    text = "The user was in the file and it is not on the list of the host."
    docs = spark.createDataFrame([(1, text, "en"), (1, text, "de"), (None, text, "fr")], "doc_id long, text string, lang string").coalesce(1)
    assert {tuple(r) for r in G.languages_found(docs).collect()} == {(1, 0, "en"), (None, 0, "en")}
