import re

import pytest
from test_jaccard import brute as components
from test_repetition import brute as measures
from test_secrets import brute as spans
from test_tiling import brute as tiles

import corpus_pipeline
from colscope.llm.jaccard import Jaccard
from colscope.llm.packing import encoder
from colscope.llm.queries import tokenizer_path
from colscope.llm.repetition import RepetitionRules

FOLDER = "/root/testdata/sf0.001"


def kept_by_rules(text):
    rules = RepetitionRules()
    n, chars, _, _, repeat, lines, *grams = measures(text, rules)
    return (n >= rules.min_words and 100 * repeat <= rules.max_window_words * n and 100 * lines <= rules.max_line_chars * chars
            and all(100 * g <= rules.max_ngram_chars[k] * chars for k, g in zip(sorted(rules.max_ngram_chars), grams)))


def leaks(text, items):
    words = re.findall(r"\w+", text.lower())
    for item in items:
        own = re.findall(r"\w+", item.lower())
        number = {w: k + 1 for k, w in enumerate(dict.fromkeys(own))}
        doc = [number.get(w, 0) for w in words]
        if len(own) >= 4 and 2 * sum(t[0] for t in tiles([number[w] for w in own], doc, 4)) >= len(own):
            return True
    return False


def masked(text):
    out, at = "", 0
    for start, _, _, end in spans(text):
        if start >= at or not out:
            out += text[at:start] + "[SECRET]"
        at = max(at, end)
    return out + text[at:]


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    own = {r.doc_id: r for r in docs.collect()}
    text = {i: r.text for i, r in own.items()}
    items = [r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    expected = {i: t for i, t in text.items() if kept_by_rules(t or "")}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "near duplicates", "decontamination", "secret scans", "best-fit packing"]
    for name, stage in corpus_pipeline.STAGES:
        if name == "near duplicates":
            expected = {i: expected[i] for i, _, root in components(sorted(expected.items()), Jaccard(5, 80, 100)) if i == root}
        elif name == "decontamination":
            gone = {i for i, t in expected.items() if leaks(t, items)}
            expected = {i: t for i, t in expected.items() if i not in gone}
        elif name == "secret scans":
            expected = {i: masked(t) for i, t in expected.items()}
        docs = stage(spark, docs, FOLDER)
        if name == names[-1]:
            break
        assert docs.columns == columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert {r.doc_id: r.text for r in docs.collect()} == expected, name
        for r in docs.collect():
            assert r.n_chars == (len(r.text) if r.text != text[r.doc_id] else own[r.doc_id].n_chars)
    tokens = {i: len(encoder(tokenizer_path()).tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in expected.items()}
    found = docs.collect()
    total = {}
    for r in found:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    assert total == tokens
    assert len({r.sequence_id for r in found}) == -(-sum(tokens.values()) // 2048)


def test_run_gives_what_the_stages_give(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
    parts = ("doc_id", "piece", "start", "length", "ids_crc32")
    assert sorted(docs.select(*parts).collect()) == sorted(corpus_pipeline.run(spark, FOLDER).select(*parts).collect())


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES[:-1], ids=lambda s: s[0])
def test_stages_take_odd_and_no_rows(spark, odd_docs, no_docs, stage):
    assert stage[1](spark, no_docs, FOLDER).count() == 0
    assert stage[1](spark, odd_docs, FOLDER).schema == odd_docs.schema


def test_near_copies_are_judged_by_five_words_and_eight_tenths(spark):
    words = [f"w{i}" for i in range(100)]
    changed = {k: " ".join([*words[:50], *(f"x{i}" for i in range(k)), *words[50 + k:]]) for k in (0, 3, 6, 9)}
    rows = [(10 * g + k, " ".join(w + f"g{g}" for w in t.split())) for g, other in enumerate((3, 6, 9)) for k, t in changed.items() if k in (0, other)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(r.doc_id for r in dict(corpus_pipeline.STAGES)["near duplicates"](spark, docs, FOLDER).collect())
    assert kept == [i for i, _, root in components(rows, Jaccard(5, 80, 100)) if i == root] == [0, 10, 20, 29]
