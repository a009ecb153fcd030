import random
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import lookalike, textform

SAME = [
    ("Pla​ce", "Place"), ("a b", "a b"), ("a 　 b", "a b"), ("ｃafé", "café"), ("ﬁn", "fin"),
    ("Thoückνille", "Thoückville"), ("рapers", "papers"), ("Ｏ́", "Ó"), ("x，y", "x,y"), ("so­ft", "soft"), (" a ", "a"),
    ("e‍́", "é"), ("е́té", "été"),
]
DIFFERENT = [("Place", "place"), ("resume", "résumé"), ("a,b", "a.b"), ("a b", "ab"), ("Ласкад", "Jlackad"), ("сор", "cop")]


@pytest.mark.parametrize("a, b", SAME)
def test_equal_looking_texts_have_one_form(a, b):
    assert textform.form(a) == textform.form(b)


@pytest.mark.parametrize("a, b", DIFFERENT)
def test_case_accents_punctuation_and_other_alphabets_count(a, b):
    assert textform.form(a) != textform.form(b)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_form_is_stable_and_has_no_blanks_to_spare(text):
    made = textform.form(text)
    assert textform.form(made) == made
    assert made == " ".join(made.split()) and unicodedata.is_normalized("NFC", made)


ALPHABET = "aeoxAEOZ\u0430\u0435\u043e\u0421\u03b1\u0391\uff21\uff45\ufb01\u00e9\u1ec7\u01d8\u0301\u0300\u0308\u0327\u0323\u0302\u200b\u00ad\u200d\u2060 \u00a0.,-\uff0c1\u0661\uac00\u1100\u1161"


@settings(max_examples=1500, deadline=None)
@given(st.text(ALPHABET, max_size=12))
def test_form_equals_plain_rules(text):
    """The same rules, applied one after another to whole words."""
    visible = "".join(c for c in text if textform.RULES.get(c) != "")
    out = []
    for piece in visible.split():
        letters = "".join(textform.RULES.get(c, c) for c in unicodedata.normalize("NFD", "".join(textform.RULES.get(c, c) for c in piece)))
        for word in _words(letters):
            latin = any("LATIN" in unicodedata.name(c, "") for c in word)
            out.append("".join(textform.LATIN_RULES.get(c, c) for c in word) if latin else word)
        out.append(" ")
    want = unicodedata.normalize("NFC", " ".join("".join(out).split()))
    assert textform.form(text) == want


def _words(letters):
    """Runs of letters, marks and digits, and every other character by itself."""
    run = ""
    for c in letters:
        if unicodedata.category(c)[0] in "LMN":
            run += c
        else:
            yield from filter(None, (run, c))
            run = ""
    if run:
        yield run


def test_key_of_several_characters():
    read = textform.TRANSDUCER.read
    assert read("e\u0301") == ("\u00e9", "\u00e9") and read("\u0435\u0301") == ("\u0435\u0301", "\u00e9")
    assert read("u\u0308\u0301") == ("\u01d8", "\u01d8") and read("e\u0302\u0323") == read("e\u0323\u0302") == ("\u1ec7", "\u1ec7")
    assert textform.form("x\u0301\u0323") == textform.form("x\u0323\u0301")  # no composed letter


def test_rules_with_two_outputs_are_refused(monkeypatch):
    monkeypatch.setitem(textform.PUNCTUATION, "－", "~")
    with pytest.raises(ValueError, match="two outputs"):
        textform.build_rules()


def test_words():
    assert textform.words('<p class="a">A&amp;B</p><!-- x y --> café_Two 3') == ["a", "b", "café", "two", "3"]
    assert textform.words(None) == textform.words("") == textform.words("​") == []
    long = "wort " * 200_000
    assert len(textform.words(long)) == 200_000
    values, sizes = textform.shingle_batch([None, "", "a b", "a b c", "a b c a b c", long], 3)
    assert sizes.tolist() == [0, 0, 0, 1, 3, 1]


def test_pairs(spark):
    rows = [
        ("a", "Pl​ace", 1, "x"), ("b", "Place", 1, "x"), ("b", "Place", 2, "x"), ("c", "Place", 1, "x"), ("d", "place", 1, "x"), ("e", None, 1, "x"), ("f", "", 1, "x"),
        ("g", " ", 1, "x"), (None, "Pl­ace", 1, "x"), ("h", "z" * 300_000, 1, "x"), ("i", "z" * 300_000 + "​", 1, "x"),
    ]
    df = spark.createDataFrame(rows, "id string, hard_text string, loaded_at int, form string")
    got = {tuple(r) for r in lookalike.same_looking_pairs(df).collect()}
    assert got == {("a", "b"), ("a", "c"), ("f", "g"), ("h", "i")}
    assert lookalike.same_looking_pairs(df.limit(0)).count() == 0
    classes = {(r["class_id"], r["id"], r["texts"]) for r in lookalike.same_looking_classes(df).collect()}
    assert classes == {("a", "a", 2), ("a", "b", 2), ("a", "c", 2), ("f", "f", 2), ("f", "g", 2), ("h", "h", 2), ("h", "i", 2)}
    forms = {r["id"]: r["form"] for r in lookalike.with_form(df).collect()}
    assert forms["a"] == "Place" and forms["e"] is None and forms["g"] == ""


def test_pairs_equal_brute_force(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["a", "а", "ａ", "b", " ", "​", " "]) for _ in range(4)) for _ in range(150)]
    df = spark.createDataFrame([(f"{i:03}", t, 0) for i, t in enumerate(texts)], "id string, hard_text string, loaded_at int")
    got = sorted(tuple(r) for r in lookalike.same_looking_pairs(df).collect())
    assert got == [(f"{i:03}", f"{j:03}") for i in range(150) for j in range(i + 1, 150) if texts[i] != texts[j] and textform.form(texts[i]) == textform.form(texts[j])]
