"""Main text of pages in languages that the stop words are not of, and tags of any length."""

from __future__ import annotations

import time

import pytest

from textloom.llm import html_text

PROSE = {
    "pl": "Wczoraj wieczorem mieszkańcy miasta zebrali się przed ratuszem, aby wysłuchać przemówienia burmistrza o planach przebudowy rynku. Prace mają potrwać dwa lata.",
    "fi": "Eilen illalla kaupungin asukkaat kokoontuivat kaupungintalon eteen kuulemaan pormestarin puhetta torin uudistamisesta. Työt kestävät kaksi vuotta.",
    "ru": "Вчера вечером жители города собрались перед ратушей, чтобы услышать речь мэра о планах перестройки площади. Работы продлятся два года.",
    "ja": "昨夜、市民は市役所の前に集まり、広場の再建計画についての市長の演説を聞いた。工事は二年間続く予定である。住民の多くは計画に賛成しているが、費用を心配する声もある。" * 2,
    "zh": "昨天晚上，市民聚集在市政厅前，听取市长关于广场重建计划的讲话。工程预计将持续两年。许多居民支持这一计划，但也有人担心费用问题。" * 2,
}


@pytest.mark.parametrize("lang", sorted(PROSE))
@pytest.mark.parametrize("wrap", ["div", "article"])
def test_other_languages(lang, wrap):
    prose = PROSE[lang]
    links = " ".join(f"<a href=x>{prose[i : i + 12]}</a>" for i in (0, 12, 24))
    page = f"<body><div>{links}</div><{wrap}>" + "".join(f"<p>{prose} {i}{prose[-1]}</p>" for i in range(3)) + f"</{wrap}><footer>{prose}</footer></body>"
    assert html_text.main_text(page).split("\n") == [f"{prose} {i}{prose[-1]}" for i in range(3)]


def test_a_notice_in_english_does_not_decide_the_language():
    prose = PROSE["pl"]
    page = "<div><p>We use cookies on this site and by the use of it you agree to this.</p></div>" + "".join(f"<p>{prose} {i}.</p>" for i in range(4))
    assert html_text.main_text(page).count(prose) == 4


@pytest.mark.parametrize("n", [10, 4000, 6000, 100_000])
def test_attributes_of_any_length(n):
    assert html_text.main_text(f'<p {"b" * n} title="{"x" * n}0>1" c=\'e>f\'>Text of the page.</p>') == "Text of the page."


@pytest.mark.parametrize("part", ['<a "x', "<a 'x>", "<", '<a b="">', "<a b='\"' c=\"'\" "])
def test_tags_left_open_take_linear_time(part):
    began = time.process_time()
    html_text.main_text(part * 4000)
    small = time.process_time() - began
    began = time.process_time()
    html_text.main_text(part * 16000)
    assert time.process_time() - began < 12 * max(small, 0.05)
