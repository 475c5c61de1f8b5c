"""Answers are read to their ends: refusals after a long preamble."""

import os

import pytest
from quern.llm import defects as D
from test_defects import GOOD, PROMPT, judge  # noqa: F401

DATA = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not here")
LONG = "The valve of Dunaven Portal feeds the ledger through code AK-6097. Nobody expected the relay to fail after 12 shifts. The ledger of Dunaven Portal holds 12 nodes and the relay was tested on page 4. The pages involved are the pages of the relay, and the valve relates to the ledger by the code on page 7, which the owner checked twice. "
REFUSALS = ["I'm sorry, but I can't help with that.", "I am unable to answer this question.", "Unfortunately, I must decline to answer.", "I cannot assist with this request because it concerns the owner."]


def test_every_word_counts():
    languages = D.Languages(D.np.zeros((D.BUCKETS, len(D.LANGUAGES))), set())
    answers = [" ".join([*["word"] * n, middle, *["word"] * 60]) + "." for n in (10, 50, 100) for middle in ("refuse", "agree")]
    for a, b in zip(answers[::2], answers[1::2]):
        assert set(D.features(a, PROMPT, languages, {"refuse", "agree", "word"})) != set(D.features(b, PROMPT, languages, {"refuse", "agree", "word"}))


def test_refusals_after_a_preamble(judge):  # noqa: F811
    assert len(LONG.split()) > 40
    assert judge([(LONG + r, PROMPT) for r in REFUSALS]) == ["refusal"] * len(REFUSALS)
    assert judge([(LONG + GOOD, PROMPT), (LONG.strip(), PROMPT)]) == [None, None]
