"""Words that fall into letters and marks."""

import string

from credsieve.llm import tokens


def test_letters_and_the_marks_after_them_are_encoded_apart(monkeypatch):
    encoder = tokens.LowerWordEncoder(tokens.default_path("word_bpe_49k.json"))
    seen, library = [], encoder.whole
    monkeypatch.setattr(encoder, "whole", lambda text: seen.append(text) or library(text))
    words = ["Mi%%%", "señal,***", "a.", "É###", "Zip&&&", "del,%%%", "x$$$"]
    assert [encoder.ids(w) for w in words] == [library(w) for w in words]
    assert not any(c.isalpha() for text in seen for c in text)


def test_marks_of_every_kind_after_letters():
    encoder = tokens.LowerWordEncoder(tokens.default_path("word_bpe_49k.json"))
    marks = [*string.punctuation, *(a + b for a in string.punctuation for b in string.punctuation), "'s", "'S.", "<|", "<|x|>", "̸", "≮", ".́", "''s", "!'re"]
    for mark in marks:
        for word in (f"Caña{mark}", f"a{mark}", f"{mark}b", f"a{mark}b", f"a{mark}s."):
            assert encoder.ids(word) == encoder.whole(word), word


def test_words_of_a_plane_are_those_of_all_letters():
    from credsieve.llm import language

    every = "".join(f"{chr(i)} a{chr(i)}b " for i in range(0x10000))
    assert language._plane_word().findall(every) == language._WORD.findall(every)
    for text in ("Plain ASCII_words 4x", "É née Ⅷ²x", "a𝐀b ¿qué?", "\ud800a b", "İstanbul", ""):
        assert language.words_of(text) == language._WORD.findall(text.lower())
