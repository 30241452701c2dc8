from __future__ import annotations

import pytest

from textloom.functions.chunk import LONGEST, chunk, sentences, split_near_middle
from textloom.functions.normalize import normalize_text
from textloom.functions.numbers import cardinal, from_roman, ordinal, spoken, to_roman
from textloom.functions.text import speech_text

SAID = [
    ("a $40B valuation", "a forty billion dollar valuation"), ("it costs $5 each", "it costs five dollars each"), ("₹1,200 cr", "one thousand two hundred crore rupees"), ("3 yrs ago", "3 years ago"), ("€5.50", "five euros and fifty cents"),
    ("$0.99", "ninety-nine cents"), ("$2–3M raised", "two to three million dollars raised"), ("$500K-$1M", "five hundred thousand to one million dollars"), ("401k plan", "401k plan"), ("4K video", "4K video"), ("up 12% YoY", "up twelve percent year over year"),
    ("10–20", "10 to 20"), ("they won 3-2", "they won 3 2"), ("between 5-3 and 9", "between 5 to 3 and 9"), ("Call 1-800-555-1234 now.", "Call 1-800-555-1234 now."), ("the 90s", "the nineties"), ("Set a 30s timeout.", "Set a thirty-second timeout."), ("lasted 30s", "lasted 30s"),
    ("1st and 22nd", "first and twenty-second"), ("7/10", "seven out of ten"), ("1½ hours", "1 and a half hours"), ("24/7", "twenty four seven"), ("3x faster", "three times faster"), ("~$5", "about five dollars"), ("12 km/h", "twelve kilometers per hour"), ("5m tall", "five meters tall"),
    ("10m users", "ten million users"), ("98.6°F", "ninety-eight point six degrees Fahrenheit"), ("2026-10-07", "October 7, 2026"), ("13/07/2026", "July 13, 2026"), ("9:05 a.m.", "nine oh five ay M."), ("17:30", "seventeen thirty"), ("1:23:45", "1:23:45"), ("World War II", "World War Two"),
    ("Henry VIII", "Henry the eighth"), ("Type C cable", "Type C cable"), ("ETFs", "E T Fs"), ("v0.3.0", "version zero point three point zero"), ("#BuildInPublic", "hashtag Build In Public"), ("w/ cheese w/o salt", "with cheese without salt"), ("etc. Then", "et cetera. Then"), ("No. 5", "number 5"), ("3.14", "3.14"),
]


@pytest.mark.parametrize(("shown", "said"), SAID)
def test_rules(shown, said):
    assert normalize_text(shown) == said


def test_rules_leave_their_own_output_alone():
    for _, said in SAID:
        assert normalize_text(normalize_text(said)) == normalize_text(said)


def test_number_words():
    assert cardinal(0) == "zero" and cardinal(1_000_015) == "one million fifteen" and cardinal(342) == "three hundred forty-two"
    assert ordinal(20) == "twentieth" and ordinal(112) == "one hundred twelfth"
    assert spoken("1,234.50") == "one thousand two hundred thirty-four point five zero"
    assert all(from_roman(to_roman(n)) == n for n in (1, 4, 9, 40, 399, 1994, 3999)) and from_roman("IIII") == 0


def test_speech():
    assert speech_text("See [1] https://x.y/z 😀 “hi” — ok") == 'See link "hi", ok.'
    assert speech_text("") == "" and speech_text("  ") == "" and speech_text("what?") == "what?"


CASES = [
    ("Wait for it. 2 minutes later it came.", 2), ("We met Dr. Smith vs. the board, e.g. the CFO, at 5 p.m. today.", 1), ("It rose 3.5 percent in the U.S. last year.", 1), ("1. buy milk and eggs. 2. go home.", 2), ("We need a Plan B. Then we can go home.", 2),
    ("J. R. R. Tolkien wrote it. Fans cheered.", 2), ("so did i. then we left.", 2),
]


@pytest.mark.parametrize(("text", "n"), CASES)
def test_sentences(text, n):
    assert len(sentences(text)) == n


def test_chunk_invariants():
    long = " ".join(f"word{i}" + ("," if i % 9 == 0 else "." if i % 31 == 0 else "") for i in range(900))
    for fast in (False, True):
        spans, before = chunk(long, "text", fast), 0
        for start, end, pause in spans:
            assert before <= start < end and end - start <= LONGEST and long[start:end] == long[start:end].strip() and pause > 0
            before = end
        assert spans[-1][2] == 450
    assert chunk("   ") == [] and chunk("A Heading", "heading") == [(0, 9, 700)] and chunk("Hello there.") == [(0, 12, 450)]


def test_no_cut_inside_amounts():
    filler = "the quarterly revenue figures were reported to investors on a very long call"
    for pad in range(0, 60, 7):
        text = f"{'x ' * pad}{filler} $2.5 million {filler} {filler} $2.5 million {filler}."
        assert not any(text[:end].endswith("$2.5") for _, end, _ in chunk(text))


def test_middle():
    assert split_near_middle("aaaaaaaaaaaa; bbbbbbbbbbbb") == ("aaaaaaaaaaaa;", "bbbbbbbbbbbb")
    assert split_near_middle("abcd") == ("ab", "cd") and split_near_middle("") is None


def test_budget():
    from textloom.functions.chunk import within_budget

    text = " ".join(f"word{i}" for i in range(200))
    parts = within_budget(text, 100)
    assert all(len(p) <= 100 for p in parts) and " ".join(parts) == text and within_budget("", 5) == [""]
