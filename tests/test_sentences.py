"""Sentence rules on texts of our own: one unit per list entry."""

import pytest

from ontoloom.operators import sentences

TEXTS = [
    ["It was Sgt. Miller who called.", "Gen. Smith left.", "Dr. No met Mrs. Jones and Prof. Lee."],
    ["Acme Inc. makes pumps.", "She works for Acme Inc.", "The pumps, valves, etc. are old.", "We sell pumps, valves, etc.", "Call us."],
    ["The max. value is 5.", "It takes approx. 3 days, i.e. half a week.", "See figs. 2 and 3, pp. 10-12, vol. IV.", "Is that so?", "Yes!"],
    ["At 7:30 p.m. the doors open.", "They close at 11 p.m.", "We met at 10 a.m. Eastern Time.", "By 5 p.m. Anna had gone."],
    ["J. R. R. Tolkien wrote it.", "The U.S. economy grew by 2.5 percent.", "Version 3.1.4 of main.py is out."],
    ["„Wer da?“, fragte er.", "Niemand antwortete.", "Am 3. Oktober 1990 war es, vgl. Abb. 2, bzw. Kap. 4.", "Er sagte: „Komm her. Setz dich.“", "Dann ging er."],
    ["M. Dupont habite av. Foch, p. ex. au n° 5.", "« Où vas-tu ? » demanda-t-elle.", "Il partit."],
    ["El Sr. López vive en la pág. 4.", "¿Cuándo viene Ud. a casa?", "¡Mañana!", "Bien."],
    ["O Dr. Sousa chegou às 9.30 h.", "A secç. 4 trata disso."],
    ["Он жил на ул. Мира, д. 5, и т. д. и т. п.", "Потом, т. е. весной, уехал.", "А. С. Пушкин родился в Москве."],
    ["他说：“今天下雨。别出门！”", "我们留在家里。", "真的吗？"],
    ["「行こう。」と彼は言った。", "雨が降っている。", "もう遅い！"],
    ["डॉ. शर्मा आए।", "वे कब गए?", "पता नहीं।"],
    ["1. First step.", "2. Second step: wait ... and see.", "(3) Third step."],
    ["THE SIGN \"STOP!\" IS RED.", "IT SAYS \"NO ENTRY.\"", "THEN IT ENDS."],
]


@pytest.mark.parametrize("want", TEXTS, ids=[t[0][:20] for t in TEXTS])
def test_units_of_own_texts(want):
    text = " ".join(want)
    assert [text[s:e] for s, e in sentences.units(text)] == want


def test_long_units_are_read_whole():
    text = "„" + "wort " * 40_000 + "Ende. Noch eins.“ So. " + "x " * 40_000 + "e.g. this. " + "y" * 100_000 + ". End"
    assert [text[s:e][-11:] for s, e in sentences.units(text)] == ["Noch eins.“", "So.", " e.g. this.", "yyyyyyyyyy.", "End"]


def test_every_language_has_a_cascade():
    for language in ("en", "de", "fr", "es", "pt", "ru", "hi", "zh", "ja", "*"):
        assert sentences.units("Ab cd. Ef", language) == [(0, 6), (7, 9)]
