import random
import zlib

import numpy as np
import pytest

from colscope.llm.packing import END, Encoder, best_fit, encoder, pack, sequences, token_pieces
from colscope.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def path():
    return tokenizer_path()


def whole(path, text):
    return encoder(path).tokenizer.encode(text or "", add_special_tokens=False).ids + [0]


def test_encoding_equals_the_tokenizer(path):
    pick, pool = random.Random(2), ["the", "Ärger", "x1", "'s", "don't", " ", "  ", "\n", "\n\n", "\t", "\xa0", "\x1c", "😀",
                                    "<|endoftext|>", ",", "...", "\r\n", "é"]
    texts = ["", None, " a", "a ", "\na", "a\n"] + ["".join(pick.choice(pool) + pick.choice(["", " "]) for _ in range(30))
                                                    for _ in range(400)]
    for text, ids in zip(texts, encoder(path).encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == whole(path, text)[:-1], repr(text)


def test_pieces_and_sequences(odd_docs, path):
    pieces = pack(token_pieces(odd_docs, path), per_group=4).collect()
    expected = []
    for r in odd_docs.collect():
        ids = whole(path, r.text)
        cuts = [0, *range((len(ids) - 1) % 2048 + 1, len(ids) + 1, 2048)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            raw = np.array(ids[a:b], "<u4").tobytes()
            expected.append((r.doc_id or -1, k, a, b - a, zlib.crc32(raw), raw))
    assert sorted((r.doc_id or -1, r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids)) for r in pieces) == sorted(expected)
    by_sequence = {}
    for r in pieces:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by_sequence) == -(-sum(r.length for r in pieces) // 2048)


def test_sequences_hold_their_pieces(spark, path):
    docs = spark.createDataFrame([(i, f"word{i} " * (i % 50)) for i in range(300)], "doc_id long, text string")
    packed = pack(token_pieces(docs, path, capacity=256), capacity=256, per_group=40, fan_in=2, slack=2)
    made = {r.sequence_id: np.frombuffer(r.ids, "<u4") for r in sequences(packed).collect()}
    for r in packed.collect():
        assert made[r.sequence_id][r.offset:r.offset + r.length].tobytes() == bytes(r.ids)
    assert all(len(x) <= 256 for x in made.values())
    assert sum(map(len, made.values())) == packed.agg({"length": "sum"}).first()[0]


def test_hierarchy_merges_underfull_bins(spark):
    pick = random.Random(4)
    lengths = [pick.choice([700, 900, 300, 50, 1100]) for _ in range(2000)]
    df = spark.createDataFrame(list(enumerate(lengths)), "k long, length long")
    many = pack(df, per_group=50, fan_in=4)
    one = pack(df, per_group=10**6)
    assert many.count() == one.count() == 2000
    n_many, n_one = (x.select("sequence_id").distinct().count() for x in (many, one))
    assert n_one <= n_many <= 1.03 * n_one


def test_best_fit_chooses_the_tightest_bin():
    bins, offsets, fill = best_fit([6, 5, 4, 3, 1], 10)
    assert (bins, offsets, fill) == ([0, 1, 0, 1, 1], [0, 0, 6, 5, 8], [10, 9])


def test_nothing_to_pack(no_docs, path):
    assert pack(token_pieces(no_docs, path)).count() == 0


def test_only_large_items_do_not_merge(spark):
    df = spark.createDataFrame([(i, 1500) for i in range(500)], "k long, length long")
    assert pack(df, per_group=20).select("sequence_id").distinct().count() == 500


def test_new_words_are_encoded_side_by_side_without_marks(path):
    words = ["one", "two,", "\nthree", "a\tb", "d'un", "\n\u00e9t\u00e9$$$", "42", "\u0120", "\u4f60\u597d", "x\u200b", "don't"]
    text = "one two, d'un \u00e9t\u00e9$$$\nthree a\tb 42 \u0120 \u4f60\u597d x\u200b don't\n\u00e9t\u00e9$$$"
    alone = Encoder(path)
    own = [alone._whole(w if w[0] == "\n" else " " + w) for w in words]
    own_encoder, seen = Encoder(path), []
    plain = own_encoder._whole
    own_encoder._whole = lambda t: seen.append(t) or plain(t)
    own_encoder._learn(words)
    assert [own_encoder.known[w] for w in words] == own
    assert len(seen) == 1 and END not in seen[0]
    assert Encoder(path).encode([text]) == [alone._whole(text)]
    marked = Encoder(path)
    marked.starts = None  # as for a tokenizer that does not work on bytes
    marked._learn(words)
    assert [marked.known[w] for w in words] == own
