"""Held-out accuracy on pairs broken on purpose, and the defined cases."""

import os

import pytest
from quern.llm import defects as D

DATA = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not here")


@pytest.fixture(scope="module")
def judge(spark):
    rows = D.sample_of(D.answer_pairs(spark, DATA).where("answer is not null and prompt is not null"), D.F.struct("table_name", "row_id"), 1200)
    texts = D.sample_of(spark.read.parquet(f"{DATA}/documents.parquet").where("lang in ('en', 'de', 'fr', 'es') and text is not null").select("doc_id", "text", "lang"), D.F.col("doc_id"), 500)
    return D.Judge.fit(list(zip(rows["answer"], rows["prompt"])), texts["text"].tolist(), texts["lang"].tolist())


PROMPT = "Consider the subgraph around AK-6097. The tested relay of Dunaven Portal holds 12 nodes. Explain how the valve relates to the ledger and name the pages involved."
GOOD = "The valve of Dunaven Portal feeds the ledger through code AK-6097. Nobody expected the relay to fail after 12 shifts."
CASES = [
    (GOOD, PROMPT, None),
    ("Table 10", PROMPT, None),
    ("- Harixor Hub: 688 gateways\n- Frooralin Hub: 258 prompts\n- Dunaven: 12 valves", PROMPT, None),
    (None, PROMPT, "empty"),
    ("", PROMPT, "empty"),
    ("​ \n", PROMPT, "empty"),
    ("N/A", PROMPT, "empty"),
    ("Answer:", PROMPT, "empty"),
    ("The valve of Dunaven Portal feeds the ledger through code AK-6097. Nobody expected the relay to fail after 12 shifts, yet the", PROMPT, "truncated"),
    ("I'm sorry, but I can't help with that.", PROMPT, "refusal"),
    ("Leider kann ich das nicht beantworten.", PROMPT, "refusal"),
    (PROMPT, PROMPT, "copy"),
    ("Während der Inventur hat Galenax Hub insgesamt 320 Rechnungen gezählt, davon waren 25.5 Prozent fehlerhaft. Die Richtlinie gilt für 1344 Abbildungen.", PROMPT, "language"),
    ("Während der Inventur hat Galenax Hub insgesamt 320 Rechnungen gezählt, davon waren 25.5 Prozent fehlerhaft.", PROMPT + " Answer in German.", None),
]


def test_cases(judge):
    assert [v for v, (_, _, want) in zip(judge([(a, p) for a, p, _ in CASES]), CASES) if v != want] == []


def test_no_prompt_no_copy_and_no_language(judge):
    assert set(judge([(GOOD, None), (PROMPT, None)])) <= {None, "truncated", "refusal"}


def test_held_out_accuracy(judge, spark):
    rows = D.answer_pairs(spark, "/root/testdata/sf0.001").where("answer is not null and prompt is not null").limit(400).toPandas()
    good = [(a, p) for (a, p), v in zip(zip(rows["answer"], rows["prompt"]), judge(list(zip(rows["answer"], rows["prompt"])))) if v is None]
    full = [(a, p, D.expected_language(p, [w.lower() for w in D._WORD.findall(p)], judge.languages)[0]) for a, p in good]
    own = [k for _, _, k in full]
    pairs, labels = D._examples(full, judge.languages, 99, own)
    told = judge(pairs)
    for k, name in enumerate(D.DEFECTS):
        truth, said = labels[:, k] == 1, [v == name for v in told]
        hit = sum(t and s for t, s in zip(truth, said))
        assert hit >= 0.85 * truth.sum() and hit >= 0.85 * sum(said), name


def test_empty_tables(spark):
    none = spark.createDataFrame([], "table_name string, row_id bigint, answer string, prompt string, lang string")
    assert D.defective(none, spark.createDataFrame([], "id bigint, text string, lang string")).count() == 0
