"""What a name is, whom pronouns mean, and what becomes of rows whose names can't stand."""

import pytest

from tracewell.functions import names as N
from tracewell.functions.kernels import extraction_chunks
from tracewell.operators import assertions


@pytest.mark.parametrize("text, want", [("I saw it", True), ("Section I", False), ("see paragraph I", False), ("my office", True), ("Ann Roe", False), ("tell us", True), ("the US", False), ("your car", True), ("I'm here", True), ("Mystery", False)])
def test_pronouns_are_seen(text, want):
    assert N.has_pronoun(text) is want


@pytest.mark.parametrize(
    "text, page, want",
    [
        ("My Nguyen", "Later My Nguyen left the room.", False), ("Nguyen Thi My", "", False), ("MY OFFICE", "", True), ("My Office", "we met in My Office today", False), ("My office", "", True), ("and so was I.", "", True), ("Ann I. Roe", "", False),
        ("MY OFFICE", "I LEFT MY OFFICE", True), ("Me", "", True), ("o'my", "", False), ("US", "", False), ("it was OUR car", "", True),
    ],
)
def test_capitals_that_may_be_names(text, page, want):
    assert N.has_pronoun(text, page) is want


def test_undecided_words_stay():
    assert N.resolve("MY OFFICE", "Ann Roe") == "MY OFFICE" and N.resolve("My office", "Ann Roe") == "Ann Roe's office"
    assert N.resolve("and so was I.", "Ann Roe") == "and so was Ann Roe." and N.resolve("Ann I. Roe saw me", "Bob Poe") == "Ann I. Roe saw Bob Poe"


def test_pronouns_are_resolved():
    assert N.resolve("I've seen my car and told me so", "Ann Roe") == "Ann Roe has seen Roe's car and told Roe so"
    assert N.resolve("I am late, I don't know", "SSgt Ann Roe") == "SSgt Ann Roe is late, Roe does not know"
    assert N.resolve("we left", "Ann Roe") == "we left"
    assert N.resolve("you lied about your car", "Ann Roe", "Bob Poe") == "Bob Poe lied about Poe's car"
    assert N.resolve("you lied", "Ann Roe", "Ann Roe") == "you lied" and N.resolve("you lied", "Ann Roe", "Bob Poe", reported=True) == "you lied"
    assert N.resolve("Annex I applies", "Ann Roe") == "Annex I applies"


def test_quoted_speakers():
    assert N.quoted_speaker("I heard Ann Roe say you will regret it") == "Ann Roe"
    assert N.quoted_speaker("Afterward SSgt Al Duran said it, and Roe told me") == "SSgt Al Duran" and N.quoted_speaker("If I said so") == ""
    assert N.quoted_speaker('"Morgan said you will regret it"') == "Morgan" and N.quoted_speaker("Everyone said so") == ""
    assert N.quoted_speaker("Then Morgan said it") == "Morgan" and N.quoted_speaker("He said it") == "" and N.quoted_speaker("") == ""


def test_titles():
    assert N.without_title("SSgt J. Miller, Flight Chief, Acting") == "SSgt J. Miller" and N.without_title("Miller, SSgt Vance") == "Miller, SSgt Vance"
    assert N.clean_name("PERSON: Capt Ann Roe, Chief", "PERSON") == "Capt Ann Roe" and N.short_name("SSgt J. Miller") == "Miller"


def test_sentences_in_slots():
    assert N.sentence_shaped("I saw Nakamura sign it") and N.sentence_shaped("He was there all day and then he left.") and not N.sentence_shaped("de la Cruz y Ortega Ruiz")
    assert not N.sentence_shaped("my office") and not N.sentence_shaped("")


@pytest.mark.parametrize(
    "name, kind, why",
    [
        ("Ann Roe", "PERSON", ""), ("SSgt Ann Roe", "PERSON", ""), ("Zed Zulu", "PERSON", "not in the document"), ("the crew", "PERSON", "a role"), ("Night Clerk", "PERSON", "takes an article"), ("Wing Planner", "PERSON", "takes an article"),
        ("Roe's neighbors", "PERSON", "takes an article"), ("Approving Authority", "PERSON", "a form label"), ("Acme Corp", "ORG", ""), ("Zeta Corp", "ORG", "not in the document"), ("he", "PERSON", "not in the document"), ("Fire Marshal", "PERSON", "takes an article"),
    ],
)
def test_faults(name, kind, why):
    page = "Ann Roe met the crew of Acme Corp. The Night Clerk slept. A Wing Planner came with Roe's neighbors.\nApproving Authority: ______\nPaul R. Quill, Fire Marshal, agreed. he"
    assert N.name_fault(name, kind, page) == why


def test_rows_are_repaired(spark):
    page = "Interviewee: Ann Roe. I met Bob Poe at the gate. Morgan said: I will sue you."
    row = dict(page_text=page, header="", speaker="Ann Roe", event_date=None)
    cases = [
        ("PERSON", "I", "met", "PERSON", "Bob Poe", "I met Bob Poe at the gate."), ("PERSON", "Ann Roe", "heard", "CLAIM", "I will sue you", "Morgan said: I will sue you."),
        ("ALIEN", "Ann Roe", "met", "PERSON", "somebody who I think was at the gate", "I met Bob Poe at the gate."), ("PERSON", "Nobody Known", "met", "PERSON", "Bob Poe", "I met Bob Poe at the gate."),
    ]
    names = ("subject_type", "subject_name", "predicate", "object_type", "object_name", "quote")
    rows = spark.createDataFrame([{**row, "k": k, **dict(zip(names, c, strict=True))} for k, c in enumerate(cases)], "k int, page_text string, header string, speaker string, event_date string, " + ", ".join(f"{n} string" for n in names))
    got = [(r.subject_type, r.subject_name, r.object_type, r.object_name) for r in assertions.validate(rows, header="header", speaker="speaker").orderBy("k").collect()]
    assert got == [("PERSON", "Ann Roe", "PERSON", "Bob Poe"), ("PERSON", "Ann Roe", "CLAIM", "Morgan will sue you"), ("CLAIM", "Ann Roe", "CLAIM", "somebody who Ann Roe think was at the gate"), ("CLAIM", "Nobody Known", "PERSON", "Bob Poe")]


def test_extraction_chunks():
    assert extraction_chunks("a\n\nb") == ["a\n\nb"] and extraction_chunks(None) == [""]
    assert extraction_chunks("aaaa\n\nbbbb\n\ncc", 10) == ["aaaa\n\nbbbb", "cc"]
    assert extraction_chunks("one two. three four five six\n\nx", 10) == ["one two.", "three four", "five six", "x"]
    assert extraction_chunks("y" * 25, 10) == ["y" * 25]
