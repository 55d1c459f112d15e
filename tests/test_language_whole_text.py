"""Languages are told from whole texts, however long."""

import pytest

from loomtext.functions import language

HEADER = "The quick brown fox and the lazy dog of that time " * 60  # over 2,000 letters


@pytest.mark.parametrize(("body", "code"), [("Привет, как дела сегодня ", "rus"), ("مرحبا كيف حالك اليوم ", "ara"), ("今天天气很好我们去公园散步", "cmn")])
def test_script_of_a_long_body_counts(body, code):
    assert language.detect_text(HEADER + body * 400) == code
    assert language.detect_text(HEADER * 10 + body) == "eng"


def test_late_kana_tell_japanese():
    assert language.detect_text("漢字文章" * 600 + "これは日本語の文章です" * 400) == "jpn"
