import random
import re

from pyspark.sql import functions as F

from colscope.llm import secrets
from colscope.llm.secrets import Rule, findings, mask_secrets, read_ledger, scan, spans_by_path, summary

ASSIGN = re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)


def brute(text):
    spans = [(m.start(), 1, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 2, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 3, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(spans)


def texts():
    pick = random.Random(6)
    parts = ["passwd:token:abcdef", "API_KEY = 'abc", "Token=", "secret: \"xY9/+-", "0123456789abcdef" * 2, "AKIA" + "X7" * 9,
             "AKIAAKIA", "é😀", " ", "\n", "password", ":", "=", "apikey", "deadbeef" * 3, "z"]
    return ["".join(pick.choice(parts) for _ in range(pick.randint(0, 25))) for _ in range(300)] + ["", None, "a" * 100_000]


def test_spans_equal_brute_force(spark, tmp_path):
    docs = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string")
    scan(docs, f"{tmp_path}/ledger")
    for r in spans_by_path(docs, f"{tmp_path}/ledger").collect():
        own = [(s.start, s.rank, s.kind, s.end) for s in r.secrets if s.kind in ("assign", "access", "hex")]
        assert own == brute(r.text or "")


def test_only_unseen_pairs_are_scanned(spark, tmp_path):
    path = f"{tmp_path}/ledger"
    first = [Rule("hex", "[0-9a-f]+", least=24)]
    later = [Rule("hex", "[0-9a-f]+", least=24), Rule("hex2", "[0-9a-f]+", least=30)]
    one = spark.createDataFrame([(1, "f" * 24), (2, "f" * 24), (3, "none")], "p int, text string")
    two = spark.createDataFrame([(4, "f" * 24), (5, "e" * 40)], "p int, text string")
    scan(one, path, rules=first)
    assert read_ledger(spark, path).count() == 2  # blobs, not paths
    scan(one, path, rules=first)
    assert read_ledger(spark, path).count() == 2
    scan(two, path, rules=first)
    assert read_ledger(spark, path).count() == 3
    scan(one.unionAll(two), path, rules=later)
    rows = read_ledger(spark, path).collect()
    assert len(rows) == 6 and sorted(len(r.rules) for r in rows) == [1] * 6
    assert {tuple(r.rules) for r in rows[:0]} == set()
    found = sorted((r.kind, r.start, r.end) for r in findings(read_ledger(spark, path), later).collect())
    assert found == [("hex", 0, 24), ("hex", 0, 40), ("hex2", 0, 40)]
    by_path = {r.p: len(r.secrets) for r in spans_by_path(one.unionAll(two), path, rules=later).collect()}
    assert by_path == {1: 1, 2: 1, 3: 0, 4: 1, 5: 2}
    # a changed rule has a new version and is scanned again
    scan(one, path, rules=[Rule("hex", "[0-9a-f]+", least=24, version=2)])
    assert read_ledger(spark, path).filter(F.array_contains("rules", "hex:2")).count() == 2


def test_masks_cover_overlapping_spans(spark, tmp_path):
    secret = "0123456789abcdef01234567"
    docs = spark.createDataFrame([
        (1, f"é😀 token={secret}, end {secret}", 50), (2, "clean", 5), (3, None, None), (4, secret, 24), (5, "", 0),
    ], "doc_id long, text string, n_chars long")
    out = mask_secrets(docs, f"{tmp_path}/ledger")
    assert out.schema == docs.schema
    assert {r.doc_id: (r.text, r.n_chars) for r in out.collect()} == {
        1: ("é😀 [SECRET], end [SECRET]", 26 - 1), 2: ("clean", 5), 3: (None, None), 4: ("[SECRET]", 8), 5: ("", 0)}


def test_odd_rows(odd_docs, no_docs, tmp_path):
    scan(odd_docs, f"{tmp_path}/a")
    rows = summary(spans_by_path(odd_docs, f"{tmp_path}/a")).collect()
    assert len(rows) == odd_docs.count() and all(r.spans == "" and r.n_hex == 0 for r in rows)
    masked = mask_secrets(odd_docs, f"{tmp_path}/b")
    assert masked.schema == odd_docs.schema and masked.exceptAll(odd_docs).count() == 0
    scan(no_docs, f"{tmp_path}/c")
    assert summary(spans_by_path(no_docs, f"{tmp_path}/c")).count() == 0


def test_main_path_has_no_python(spark, tmp_path):
    docs = spark.createDataFrame([(1, "password=abcdefg")], "doc_id long, text string")
    scan(docs, f"{tmp_path}/ledger")
    plan = summary(spans_by_path(docs, f"{tmp_path}/ledger"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and secrets.RULES[:3] == secrets.BASE_RULES
