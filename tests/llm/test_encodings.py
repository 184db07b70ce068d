import random
import zlib

import numpy as np
import pytest
import xxhash

from tidewell.llm import direct_codes as dac
from tidewell.llm import merge_dropout as md

public = pytest.importorskip("public_tokenizers")
ODD = ["", "  a", "a   b", " \n x", " a  b  \n c ", "don't  's x's 's", "\t a\t\tb \x1c c", "<|endoftext|> x<|endoftext|>", "é  ü\n\n  z 12 3", "x \n", " ", "   ", "a▁b ▁▁ c\n▁", "日本語 text 🙂", "x" * 300 + " y", "abc" * 90, "\n\n a", "ªb º Ωmega, ſt² Ⅷ a²"]


def version(text):
    """Spark's hash of a text, which orders the texts of one doc_id."""
    h = 42 if text is None else xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (1 << 64) * (h >> 63)


def mess(n=400):
    rnd = random.Random(2)
    return ODD + ["".join(rnd.choice(" \n\tab'1é%²Ω. the") for _ in range(rnd.randint(1, 14))) for _ in range(n)]


def test_token_cache_changes_nothing():
    e, texts = dac.Encoder(public.path(dac.VOCABULARY)), mess()
    assert e(texts) == e.whole(texts) == e(texts)
    e.known.clear()
    assert e(texts[::-1]) == e.whole(texts)[::-1]


def test_codes_round_trip_and_random_access():
    for ids in (np.arange(0), np.array([0, 255, 256, 65535, 65536, 2**31]), np.random.default_rng(0).integers(0, 70000, 3000), np.zeros(513, int)):
        levels = dac.pack(ids) if len(ids) else []
        if len(ids):
            assert (dac.unpack(levels) == ids).all() and [dac.access(levels, i) for i in range(0, len(ids), 3)] == ids[::3].tolist()


def test_op8(spark, docs, rows, none, monkeypatch):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public.path(dac.VOCABULARY))
    texts = [(2000 + i, x, *[None] * 7) for i, x in enumerate([*ODD, "a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>  y"])]
    rows = [*rows, *texts, (None, "another text without an id", *[None] * 7), (2000, "another text of one id", *[None] * 7)]
    docs = spark.createDataFrame(rows, docs.schema)
    folder = dac.new_folder(spark)
    files = dac.write(docs, folder, file_ids=3000)
    got = sorted(dac.read(files).collect(), key=lambda r: r.start)
    assert files.count() > 4
    want = []
    for d, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, version(r[1]))):
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        want.append((d, sum(w[2] for w in want[-1:]) + want[-1][1] if want else 0, len(ids), zlib.crc32(ids.tobytes())))
    assert [tuple(r) for r in got] == want
    one = files.orderBy("part", "seq").first()
    assert dac.token(one["file"], one["n_ids"] - 1) == 0
    ids = [i for d, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, version(r[1])))[: one["n_docs"]] for i in [*t.encode(text or "", add_special_tokens=False).ids, 0]]
    assert [dac.token(one["file"], i) for i in range(0, len(ids), 7)] == ids[::7] and 50256 in t.encode(ODD[7], add_special_tokens=False).ids
    with pytest.raises(IndexError):
        dac.token(one["file"], len(ids))
    assert dac.read(dac.write(none, dac.new_folder(spark))).isEmpty()


def test_without_dropout_it_is_the_model():
    import sentencepiece

    sp, e = sentencepiece.SentencePieceProcessor(model_file=md.model_path()), md.Encoder(md.model_path(), 0.0)
    texts = mess()
    for t, ids in zip(texts, e(texts, [0] * len(texts)), strict=True):
        assert e.decode(ids) == t.encode()
        if md.SPACE not in t:
            assert np.frombuffer(ids, "<u2").tolist() == sp.encode(t)


def test_batched_merging_is_the_agenda_and_varies():
    e = md.Encoder(md.model_path(), 0.3, 4, 5)
    texts = mess() + ["the quick brown fox jumps over the lazy dog " * 30]
    ids = e(texts, list(range(len(texts))))
    assert all(e.decode(x) == t.encode() for x, t in zip(ids, texts, strict=True))
    for k in list(e.known)[:600]:
        assert e.known[k] == e._bytes(e.agenda(k[1:], e.word_key(k)))
    fox = {e.known[v + " jumps"] for v in "0123" if v + " jumps" in e.known}
    assert len(fox) > 1 and md.Encoder(md.model_path(), 0.3, 4, 5)(texts, list(range(len(texts)))) == ids
    assert md.Encoder(md.model_path(), 0.3, 4, 6)(texts, list(range(len(texts)))) != ids


def test_op2(docs, rows, none):
    got = md.digest(docs).collect()
    assert len(got) == len(rows) and all(r.lossless for r in got)
    pieces = md.encode(docs)
    assert pieces.columns == [*docs.columns, "piece_ids"]
    back = md.decode(pieces).select("text", "decoded").collect()
    assert all(r.decoded == (r.text or "") for r in back)
    assert md.digest(none).isEmpty() and md.encode(none).isEmpty() and md.decode(md.encode(none)).isEmpty()


def test_every_occurrence_draws_for_itself():
    e = md.Encoder(md.model_path(), 0.1)
    none, n = md.Encoder(md.model_path(), 0.0), 1500
    plain = none._bytes(none.agenda(" jumps", 0))
    texts = ["jumps " * n, *mess(), "internationalization " * 300 + "straightforwardness" * 4 + " z"]
    keys, real = {}, e._occurrences
    e._occurrences = lambda words, k: [keys.setdefault((w, int(x)), b) for w, x, b in zip(words, k, real(words, k), strict=True)]
    ids = e(texts, list(range(len(texts))))
    assert all(e.decode(x) == t.encode() for x, t in zip(ids, texts, strict=True))
    assert len(keys) > n and all(b == e._bytes(e.agenda(w, k)) for (w, k), b in keys.items() if w not in ("\n", md.SPACE))
    # One word type: more segmentations than variants, and a rate of skips near its expectation, not a multiple of a quarter.
    jumps = [b for (w, _), b in keys.items() if w == " jumps"]
    offers = int(e.agendas.counts[e.agendas.number[" jumps"]])
    changed = sum(b != plain for b in jumps) / len(jumps)
    assert len(set(jumps)) > 4 and 0.02 < changed <= 1 - 0.9**offers + 0.03
    e._occurrences, e.agendas = real, md.Agendas(e.line, e.mark)
    assert e(texts[::-1], list(range(len(texts)))[::-1]) == ids[::-1]
    e.seed = 6
    assert e(texts, list(range(len(texts)))) != ids
