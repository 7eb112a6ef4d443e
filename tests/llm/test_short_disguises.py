"""Disguises of fewer than three spelled digits."""

import pytest

from apisieve.llm import pii


@pytest.mark.parametrize(
    "text, found, kind",
    [
        ("host 10 dot 0 dot 0 dot 1 is up", "10 dot 0 dot 0 dot 1", "ip"),
        ("host 10 point 0 point 0 point 1.", "10 point 0 point 0 point 1", "ip"),
        ("call +49 170 five five 1234567 now", "+49 170 five five 1234567", "phone"),
        ("call plus 49 170 1234567 now", "plus 49 170 1234567", "phone"),
        ("10[dot]0[dot]0[dot]99 five days", "10[dot]0[dot]0[dot]99", "ip"),
    ],
)
def test_found(text, found, kind):
    base, added = pii.all_spans(text)
    assert base == [] and added == [(kind, text.index(found), text.index(found) + len(found))]


@pytest.mark.parametrize("text", ["one or two, three at most", "version 1 point 5", "300 dot 0 dot 0 dot 1", "plus 5 dash 7", "more at example.com"])
def test_rejected(text):
    assert pii.all_spans(text) == ([], [])
