"""Mentions on held-out written texts, on sentences put down by hand and on dirty ones; redaction leaves the rest as it is."""

import pickle
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from stratalog.llm.boosting import BoostedTrees
from stratalog.llm.pii import KINDS, find, redact, trained
from stratalog.llm.pii_candidates import MODELS, candidates
from stratalog.llm.pii_text import Batch, Lexicon
from stratalog.llm.pii_training import Writer

sys.path.insert(0, str(Path(__file__).resolve().parent))
from pii_cases import cases

GIVEN = tuple(a + b for a in "Ael Bri Cor Dal Eri Fen Gil Hes".split() for b in "ard ek elle ik ina isse or wyn ana uve".split() if (a, b) != ("Cor", "uve"))
BRANDS = ("Tarn House", "Vesper Lund", "Brightmere")


@pytest.fixture(scope="module")
def detector():
    return trained(GIVEN, BRANDS)


def proposed(text: str, lexicon: Lexicon) -> set[tuple[str, int, int]]:
    batch = Batch([text], lexicon)
    return {("name" if m == "east" else m, int(a) - 1, int(b) - 1) for m, f in candidates(batch).items() for a, b in zip(f.start, f.end, strict=True)}


def test_trees_learn_a_rule_and_are_calibrated():
    r = np.random.default_rng(0)
    x = r.normal(size=(4000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    y = np.where(r.random(4000) < 0.1, 1 - y, y)
    model = BoostedTrees().fit(x[:3000], y[:3000])
    p = model.probability(x[3000:])
    assert ((p > 0.5) == (y[3000:] > 0.5)).mean() > 0.85 and abs(p.mean() - y[3000:].mean()) < 0.05
    assert len(model.probability(x[:0])) == 0


def test_trees_see_values_that_few_rows_have():
    x = np.zeros((5000, 3))
    x[::50, 1] = 1
    model = BoostedTrees().fit(x, x[:, 1])
    assert model.probability(np.array([[0, 1.0, 0], [0, 0.0, 0]])).round().tolist() == [1, 0]


def test_held_out_accuracy(detector):
    writer, hit, said, there = Writer(12345, list(GIVEN), list(BRANDS)), 0, 0, 0
    texts = [writer.text() for _ in range(600)]
    for (_, truth), got in zip(texts, detector.mentions([t for t, _ in texts]), strict=True):
        truth, got = {m[:2] for m in truth}, {m[:2] for m in got}
        hit, said, there = hit + len(got & truth), said + len(got), there + len(truth)
    assert hit / said > 0.95 and hit / there > 0.93


def test_accuracy_on_other_wording_and_public_names(detector):
    """The sentences of pii_cases; each kind of mention is found, and rightly, nine times in ten."""
    every = cases()
    assert len(every) >= 240
    hit, said, there = Counter(), Counter(), Counter()
    for (_, _, truth), got in zip(every, detector.mentions([t for _, t, _ in every]), strict=True):
        got = {(k, a) for k, a, _ in got}
        there.update(k for k, _ in truth)
        said.update(k for k, _ in got)
        hit.update(k for k, _ in got & truth)
    assert {k: (hit[k] / there[k] >= 0.9, hit[k] / said[k] >= 0.9) for k in KINDS} == dict.fromkeys(KINDS, (True, True)), (hit, said, there)


def test_no_sentence_is_taken_from_what_it_is_tested_on():
    from stratalog.llm import pii_training as t

    pieces = [p for kind in t.AROUND.values() for two in kind.values() for part in two for p in part] + [p for x in [*t.PLAIN.values(), t._ANYWHERE] for p in x]
    long = {q.strip() for p in pieces for q in __import__("re").split(r"\{\w\}", p) if len(q.strip()) >= 14 and " " in q.strip(" .,:'")}
    assert not [(p, s) for _, s, _ in cases() for p in long if p in s]


@pytest.mark.parametrize("order", [0, 1, 2])
def test_batches_do_not_change_mentions(detector, order):
    """A text has the same mentions alone, in any company and in any order."""
    texts = [t for _, t, _ in cases()][order::3] + ["", None, "\0", "\0\0 Call 01632 960 335 \0"]
    together = detector.mentions(texts)
    assert together == [detector.mentions([t])[0] for t in texts] and detector.mentions([]) == []
    assert detector.mentions(texts[::-1]) == together[::-1]
    assert pickle.loads(pickle.dumps(detector)).mentions(texts) == together


#: Sentences put down by hand, mentions in braces.
LABELLED = [
    ("email", "Mail me: {zoë.o'venn+shop@mail.quarrow.example}, thanks."), ("email", "write to {aelard [at] kontor [dot] vesper [dot] test} please"), ("email", "連絡先は{hes95＠fernbox.test}です。"),
    ("phone", "You can call {(718) 555-0193} any time."), ("phone", "電話は ０４９-５５５-０１７８ です".replace("０４９-５５５-０１７８", "{０４９-５５５-０１７８}")), ("phone", "(({01632) 960 342})".replace("(({", "({(")),
    ("id_number", "They printed {QQ 11 43 44 C} on the label."), ("id_number", "Me pidieron el DNI, {00404927 J}, para recogerlo."), ("id_number", "Meine Steuer-ID {L0X K6941 4} wollte man auch noch haben."),
    ("address", "The courier left it at {Flat 4, 116 Larkrise Street}, Elmsbarrow instead."), ("address", "Rücksendung an {Pinchbeckweg 193}."), ("address", "Ma nouvelle adresse : {52 bis rue du Marlpit}, 00354 Nesterholm."), ("address", "Devolver a {C/ Tollbrook, 12}."),
    ("name", "I, {Thornberg, Aelwyn}, paid in full."), ("name", "thanks {Brielle de la Vire}!"), ("name", "{Fenik Holcourt}さんが親切でした。"), ("name", "gez. {F. Thornmere}"), ("name", "my wife {HESARD DUNLUND} already mailed twice"), ("name", "Regards, {gilwyn lindtarn}"),
]
NONE = [
    "Order 293-15-3714 took a week.", "Invoice X44846337, dated 11/10/24.", "注文番号 783 765 6728。", "Code-barres 4897704547109.", "My daughter Aelina loves it.", "Thank you Vesper Lund!", "The Tarn House shop near Cobbler Street is closed.",
    "I follow @tinkertable for tips.", "See www.postfold.example for more.", "Llegó 8 días tarde y sin color.", "It was £115.99. 9 screws were missing.", "Size is 70x35x12 cm.", "", "   ",
]


@pytest.mark.parametrize("kind, marked", LABELLED)
def test_labelled(detector, kind, marked):
    text = marked.replace("{", "").replace("}", "")
    assert [(k, a) for k, a, _ in detector.mentions([text])[0]] == [(kind, marked.index("{"))]


@pytest.mark.parametrize("text", NONE)
def test_no_mention(detector, text):
    assert detector.mentions([text]) == [[]]


def test_frames(spark, detector):
    long = "It lives in the spare room. " * 20_000 + "Call me on 01632 960 335 now."
    rows = [(1, "🔑 Call me on 01632 960 335 now.", "a"), (2, None, "a"), (3, "", "a"), (4, long, "a"), (None, "Mail a@b.example", "a"), (1, "🔑 Call me on 01632 960 335 now.", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    assert sorted(map(tuple, find(df, detector).collect()), key=repr) == sorted([(1, "phone", 13), (1, "phone", 13), (4, "phone", len(long) - 18), (None, "email", 5)], key=repr)
    out = {r["doc_id"]: r["text"] for r in redact(df, detector).collect()}
    assert out[1] == "🔑 Call me on [PHONE] now." and out[2] is None and out[3] == "" and out[4] == long[:-18] + "[PHONE] now." and out[None] == "Mail [EMAIL]"
    assert find(df.where("false"), detector).count() == 0 and set(detector.models) == set(MODELS)


#: Given names outside the list and family names without one of the known ends.
OTHERS = [("Quoc", "Nguyen"), ("Tamsin", "Okafor"), ("Wojciech", "Zając"), ("Bo", "Li"), ("Siobhan", "Fitzgerald"), ("Zoë", "O'Tarrel"), ("Ibrahim", "Haddad"), ("Ñora", "Śliwak")]


def test_generator_recall_of_names_unlike_the_list(detector):
    lexicon, missed = detector.lexicon, []
    assert not any(lexicon.like_given(w.lower()) for pair in OTHERS for w in pair)
    for g, f in OTHERS:
        plain = [f"{g} {f}", f"{g} K. {f}", f"{f}, {g}", f"{g[0]}. {f}", f"{f}, {g[0]}.", f"{g} van der {f}", f"{g} {f}".upper()]
        forms = [("It came late. ", s, " was told so.") for s in plain] + [("", f"{g} {f}".lower(), "さんが親切でした。")] + [("regards, ", f"{g} {f}".lower(), "")] * (len(g + f) > 6)
        for before, name, after in forms:
            if ("name", len(before), len(before) + len(name)) not in proposed(before + name + after, lexicon):
                missed.append(before + name + after)
    assert missed == []


@pytest.mark.parametrize("number", ["12345", "1" * 40, "718-555-0193 2024-06-01", "01632 960123 01632 960124", "3 718-555-0193"])
def test_numbers_of_any_length_and_their_parts_are_proposed(detector, number):
    spans = {(a, b) for k, a, b in proposed(f"It is {number} here.", detector.lexicon) if k == "phone"}
    assert (6, 6 + len(number)) in spans
    for part in ("718-555-0193", "01632 960123", "01632 960124"):
        if part in number:
            assert (6 + number.index(part), 6 + number.index(part) + len(part)) in spans


@pytest.mark.parametrize("name", ["Ольга Иванова", "Γιώργος Παπαδόπουλος", "Li Wu", "Zoë Óin", "田中 太郎", "マリア・ガルシア"])
@pytest.mark.parametrize("before, after", [("I met Mr. ", "."), ("", "さん")])
def test_names_of_any_script_and_length_are_proposed(detector, name, before, after):
    assert ("name", len(before), len(before) + len(name)) in proposed(before + name + after, detector.lexicon)


@pytest.mark.parametrize("marked", ["C'est vraiment soigné.\n\n{Briard Śliwak}, du magasin, a été adorable.", "{Briana O'Tarrel}, de la tienda, fue muy amable.", "Regards, {Tamsin Okafor}", "I spoke to {Wojciech Zając} twice.", "Ich habe mit {Ibrahim Haddad} telefoniert."])
def test_names_unlike_the_list(detector, marked):
    assert [(k, a) for k, a, _ in detector.mentions([marked.replace("{", "").replace("}", "")])[0]] == [("name", marked.index("{"))]


@pytest.mark.parametrize("address", ["41 Lanternhall Road", "7b Mill Street", "52 bis rue du Marlpit", "Calle Tollbrook, 12", "Pinchbeckweg 193", "Am Lindenplatz 4a", "12 Harbour Parade", "Viale Roma 12", "10200 Lakeshore Boulevard", "123456 Long Way"])
@pytest.mark.parametrize("before, after", [("返品先:", "また買いたい"), ("返品先は", "です"), ("住所", "。"), ("カタカナ", "カタカナ"), ("I live at ", ".")])
def test_address_beside_kana(detector, address, before, after):
    assert ("address", len(before), len(before) + len(address)) in proposed(before + address + after, detector.lexicon)


@pytest.mark.parametrize("marked", ["返品先:{41 Lanternhall Road}また買いたいです。", "住所は{Pinchbeckweg 193}です。", "担当は{F. Thornmere}さんです。"])
def test_mention_beside_kana(detector, marked):
    assert [a for _, a, _ in detector.mentions([marked.replace("{", "").replace("}", "")])[0]] == [marked.index("{")]
