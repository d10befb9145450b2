import pytest

from statemill.llm import tokenization as tk
from statemill.llm.queries import PIECE_MODEL

TEXTS = [None, "", " ", "   ", "a", " a", "a ", "a  b", "  x\n\ny ", "▁a ▁ b", "\u0000x", "<s> </s> <unk> <0x41>", "𐍈 é 中文", "tab\tbar", "word " * 3000, "a", "a"]


@pytest.fixture(scope="module")
def model():
    with open(PIECE_MODEL, "rb") as f:
        return f.read()


def test_same_tokens_and_texts_as_sentencepiece(spark, model):
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_proto=model)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, token_ids string")
    rows = tk.decode(tk.encode(docs, model), model).orderBy("doc_id").collect()
    assert len(rows) == len(TEXTS)
    for t, r in zip(TEXTS, rows, strict=True):
        assert r.token_ids == (None if t is None else own.encode(t))
        assert r.decoded == (None if t is None else own.decode(own.encode(t)))


def test_whole_text_path_agrees(model):
    c = tk.Coder(model, verify=True, trip=True)
    texts = [t for t in TEXTS if t is not None]
    flat, ends, same = c.encode(texts)
    c.by_unit = False
    flat2, ends2, same2 = c.encode(texts)
    assert flat.tolist() == flat2.tolist() and ends.tolist() == ends2.tolist() and same == same2


def test_cache_may_overflow(model):
    c = tk.Coder(model, verify=True, trip=True, most_units=5)
    for t in ("a b c d a a b", "e f g h", "", "a b c d e f g h i j", "x \u2581 y", "a b x e a"):
        flat, ends, same = c.encode([t])
        assert flat.tolist() == (c.whole.encode(t, add_special_tokens=False).ids if t else [])
        assert ends.tolist() == [len(flat)] and same == [c.decode([flat.tolist()])[0] == t]


def test_cache_keeps_what_is_used_most(model):
    c = tk.Coder(model, verify=True, most_units=6)
    c.encode(["often often often more more once twice twice"])
    c.encode(["new words come in"])
    assert set(c.number) == {"often", "more", "twice", "new", "words", "come", "in"}
    before = {u: c.pool[c.start[k] : c.start[k] + c.size[k]].tolist() for u, k in c.number.items()}
    assert before["often"] == c.whole.encode("often", add_special_tokens=False).ids


def test_digest(spark, model):
    import hashlib
    import struct

    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    c = tk.Coder(model)
    for r in tk.token_digest(docs, model).collect():
        t = TEXTS[r.doc_id]
        if t is None:
            assert (r.n_tokens, r.ids_sha256, r.round_trip) == (None, None, None)
            continue
        ids = c.whole.encode(t, add_special_tokens=False).ids if t else []
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}i", *ids)).hexdigest()
        assert r.round_trip == (c.decode([ids])[0] == t)
    assert tk.token_digest(docs.limit(0), model).count() == 0


def test_unigram_model_is_rebuilt():
    def field(n, kind, payload):
        return bytes([n << 3 | kind]) + payload

    def blob(n, data):
        return field(n, 2, bytes([len(data)]) + data)

    import struct

    pieces = [("<unk>", 0.0, tk.UNKNOWN), ("▁", -1.0, 1), ("a", -2.0, 1), ("b", -2.5, 1), ("ab", -3.0, 1), ("▁ab", -3.2, 1)]
    data = b"".join(blob(1, blob(1, t.encode()) + field(2, 5, struct.pack("<f", s)) + field(3, 0, bytes([k]))) for t, s, k in pieces)
    data += blob(2, field(3, 0, b"\x01")) + blob(3, field(3, 0, b"\x01") + field(4, 0, b"\x01"))
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_proto=data)
    c = tk.Coder(data)
    for t in ("ab ab", "b a", "aab bb"):
        assert c.encode([t])[0].tolist() == own.encode(t)


def test_round_trip_column(spark):
    model = tk.read_model(spark, PIECE_MODEL)
    texts = [None, "", "plain words here", "two  spaces ", "\u2581 marker", "é ü 漢字 \U0001f600", " lead"]
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, round_trip int")
    rows = tk.decode(tk.encode(df, model, round_trip="round_trip"), model).collect()
    assert len(rows) == len(texts)
    assert all(r.round_trip == (None if r.text is None else r.decoded == r.text) for r in rows)
