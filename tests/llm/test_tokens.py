"""Encoding against the public libraries, decoding as a round trip, packing against its bounds."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stratalog.llm.bpe import StreamDecoder, StreamEncoder, Transducer, Vocabulary, decode, encode, vocabulary
from stratalog.llm.encode import decoded, token_counts, token_ids
from stratalog.llm.packing import OpenWindows, pack

tokenizers = pytest.importorskip("tokenizers")
ALPHABET = ["a", "b", "ab", " ", "  ", "\n", "\r\n", "'s", "'", "'r", "e", "'ll", "1", "12", "ß", "日", "🔑", "-", "--", "=", "　", "\xa0", "Z", "aaaa", "<|endoftext|>", "é", "é"]


@pytest.fixture(scope="module")
def v():
    return vocabulary()


@pytest.fixture(scope="module")
def truth():
    t = tokenizers.Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(ALPHABET), max_size=120), st.lists(st.integers(1, 9), min_size=1, max_size=20))
def test_any_cut_gives_the_same_ids(parts, steps):
    text, v = "".join(parts), vocabulary()
    t = tokenizers.Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json") if not hasattr(test_any_cut_gives_the_same_ids, "t") else test_any_cut_gives_the_same_ids.t
    t.encode_special_tokens = True
    test_any_cut_gives_the_same_ids.t = t
    ids = t.encode(text, add_special_tokens=False).ids
    assert encode(text, v) == ids
    encoder, out, at, i = StreamEncoder(v, window=16), [], 0, 0
    while at < len(text):
        out += encoder.feed(text[at : at + steps[i % len(steps)]])
        at, i = at + steps[i % len(steps)], i + 1
    assert out + encoder.finish() == ids
    decoder = StreamDecoder(v)
    assert "".join(decoder.feed([x]) for x in ids) + decoder.finish() == text == decode(ids, v)


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=200))
def test_any_text(text):
    v = vocabulary()
    assert decode(encode(text, v), v) == text


@pytest.mark.parametrize("text", ["a" * 150_000, " " * 150_000 + "x", "=" * 70_000 + "abc", "1234567890" * 8_000, "\n" * 70_000, "ab-=+" * 20_000, "日本" * 40_000])
def test_giant_pieces(v, truth, text):
    assert encode(text, v) == truth(text)


def test_memory_of_the_transducer_is_bounded(v):
    machine, out, most = Transducer(v), [], 0
    r = random.Random(1)
    for _ in range(300):
        out += machine.feed(bytes(r.choice(b"abcdefgh=") for _ in range(1000)))
        most = max(most, len(machine._bytes))
    out += machine.finish()
    assert most < 20 * v.lookahead and len(out) > 1000


def test_small_vocabulary_against_the_definition():
    r = random.Random(3)
    for _ in range(20):
        ranks = {bytes([c]): i for i, c in enumerate(b"abc")}
        while len(ranks) < 14:
            x = r.choice(list(ranks)) + r.choice(list(ranks))
            ranks.setdefault(x, len(ranks))
        v = Vocabulary(ranks)
        for _ in range(30):
            data = bytes(r.choice(b"abc") for _ in range(r.randrange(60)))
            machine, out = Transducer(v), []
            for i in range(0, len(data), 5):
                out += machine.feed(data[i : i + 5])
            tokens = [v.tokens[i] for i in out + machine.finish()]
            assert tokens == v.merged(data)


def test_damaged_bytes_become_replacement_characters(v):
    half = encode("🔑", v)[:1]
    assert decode(half, v) == "�"


def test_frames(spark):
    rows = [(1, "hello world", "x"), (2, "", "x"), (3, None, "x"), (None, "a", "x"), (1, "hello world", "x"), (9, "long " * 60_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = token_ids(df)
    got = {r["doc_id"]: r["ids"] for r in out.collect()}
    assert out.count() == 6 and got[1] == [31373, 995] and got[2] == got[3] == [] and len(got[9]) == 60_001
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts(df).collect()} == {k: len(x) for k, x in got.items()}
    back = {r["doc_id"]: r["text"] for r in decoded(out).collect()}
    assert back[1] == "hello world" and back[3] == "" and back[9] == rows[-1][1]
    assert decoded(spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")).collect()[0]["text"] is None
    assert token_ids(df.where("false")).count() == 0


def test_best_fit():
    w = OpenWindows(10, 2)
    assert [w.place(7, 1), w.place(5, 2), w.place(3, 3), w.place(5, 4)] == [1, 2, 1, 2]
    assert w.place(6, 5) == 5 and w.place(6, 6) == 6  # the fullest was given up
    assert len(w.open()) == 2


@pytest.mark.parametrize("parts, most", [(1, 64), (7, 64), (40, 4)])
def test_packing(spark, parts, most):
    r = random.Random(parts)
    sizes = [r.choice([None, 0, -3, 1, 5, 40, 100, 256, 300, 511, 512, 513, 1024, 2000]) if r.random() < 0.3 else r.randrange(1, 250) for _ in range(900)]
    df = spark.createDataFrame([(i % 800, n) for i, n in enumerate(sizes)], "id long, n long").repartition(parts).withColumnRenamed("id", "doc").selectExpr("*", "'c' AS container", "'f' AS `from`")
    rows = pack(df, "doc", "n", 512, most).collect()
    fill = {}
    for x in rows:
        assert 0 < x["tokens"] <= 512
        fill[x["container"]] = fill.get(x["container"], 0) + x["tokens"]
    wanted = [max(n or 0, 0) for n in sizes]
    assert max(fill.values()) <= 512 and sum(fill.values()) == sum(wanted) and len(rows) == sum(-(-n // 512) for n in wanted)
    assert len(fill) <= 1.1 * sum(wanted) / 512 + 2
    assert sum(x["piece"] == 1 for x in rows) == sum(n > 512 for n in wanted)
    assert pack(df.where("false"), "doc", "n", 512).count() == 0


def test_vocabularies_with_unreachable_tokens():
    """Small random vocabularies, many with tokens that no merge leads to, against the definition."""
    import random

    r = random.Random(3)
    for _ in range(60):
        tokens = [bytes([b]) for b in range(256)]
        while len(tokens) < 256 + r.randrange(2, 14):
            t = bytes(r.choice(b"abc") for _ in range(r.randrange(2, 6)))
            if t not in tokens:
                tokens.append(t)
        v = Vocabulary({t: i for i, t in enumerate(tokens)})
        for _ in range(40):
            data = "".join(r.choice("abc") for _ in range(r.randrange(1, 60)))
            assert [v.tokens[i] for i in v.piece(data)] == v.merged(data.encode())
