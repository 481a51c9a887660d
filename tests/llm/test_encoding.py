"""SentencePiece encoding against the library, fill-in-middle against a plain version, on ordinary and odd texts."""

import hashlib
import random
import struct

import pytest
import regex
import zstandard

from quillgraph.llm import fim, sentence_pieces

ODD = [(900, None), (901, ""), (902, " "), (903, "   \n\t "), (904, "a"), (None, "no id"), (905, "same"), (905, "same"), (905, "other"), (906, "▁ literal ▁▁"), (907, "<s> </s> <0x0A> <unk>"), (908, "\x00\x01 nul"), (909, "日本語の文章 한국어 😀👍🏽"), (910, "x" * 30_000), (911, "ab " * 9_000), (912, " " * 2_000), (913, "<P> marked"), (914, "<M"), (915, "é é ‍")]


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def texts(spark, sf):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").limit(80).collect()] + ODD


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, ids string, frames int").repartition(4)


def test_pieces_as_the_library(spark, texts, library):
    raw = sentence_pieces.default_model()
    want = []
    for i, t in texts:
        ids = library.encode(t or "", add_eos=True)
        decoded = library.decode(ids)
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), len((t or "").encode())))
    got = sentence_pieces.digests(frame(spark, texts), raw).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert sentence_pieces.digests(frame(spark, texts[:1]).limit(0), raw).count() == 0


def test_pieces_keep_their_places(spark, texts, library):
    raw = sentence_pieces.default_model()
    short = [(i, t) for i, t in texts if t is None or len(t) < 3_000]
    encoded = sentence_pieces.encode(frame(spark, short), raw, end=False)
    want = []
    for i, t in short:
        found = library.encode(t or "", return_type="proto").pieces
        want.append((i, [p.id for p in found], [p.begin for p in found], [p.end for p in found]))
    assert sorted(((r.doc_id, r.ids, r.begins, r.ends) for r in encoded.collect()), key=str) == sorted(want, key=str)
    back = sentence_pieces.decode(encoded, raw)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(((i, (t or "").replace("▁", " ")) for i, t in short), key=str)  # that letter stands for a space


def test_any_ids_decode_as_the_library(library):
    m, rng = sentence_pieces.Model(sentence_pieces.default_model()), random.Random(2)
    for _ in range(2_000):
        ids = [rng.choice([rng.randrange(32_000), rng.randrange(3, 259), rng.randrange(3), 259, 28705]) for _ in range(rng.randrange(14))]
        assert m.decode(ids) == library.decode(ids), ids


def test_random_texts(library):
    m, rng = sentence_pieces.Model(sentence_pieces.default_model()), random.Random(3)
    for _ in range(1_500):
        t = "".join(rng.choice(["ab", "the", "Z", "é", "中", "😀", " ", "  ", "\n", "▁", "<s>", "ing", "́", "한국"]) for _ in range(rng.choice([0, 1, 4, 60])))
        assert m.encode(t.encode())[0].tolist() == library.encode(t, add_eos=True), t


def varint(n):
    out = b""
    while True:
        out += bytes([n & 127 | (128 if n > 127 else 0)])
        n >>= 7
        if not n:
            return out


def message(*pairs):
    out = b""
    for number, value in pairs:
        if isinstance(value, bytes):
            out += varint(number << 3 | 2) + varint(len(value)) + value
        elif isinstance(value, float):
            out += varint(number << 3 | 5) + struct.pack("<f", value)
        else:
            out += varint(number << 3) + varint(value)
    return out


@pytest.mark.parametrize("squeezed", [0, 1])
@pytest.mark.parametrize("fallback", [0, 1])
def test_models_with_a_character_map(tmp_path, squeezed, fallback):
    """A made-up model whose normalisation is the compiled map of the library's own rules."""
    import sentencepiece

    try:
        made = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc_cf")
        parts = list(sentence_pieces.fields(made.serialized_model_proto()))
    except (AttributeError, RuntimeError, OSError) as e:
        pytest.skip(f"the library shows no compiled map: {e}")
    compiled = dict(sentence_pieces.fields(dict(parts)[3]))[2]
    assert len(compiled) > 1_000
    words = ["a", "b", "c", "ab", "abc", "▁", "▁a", "▁ab", "1", "2", "12", "ss", "s", "株", "▁▁", "é"]
    listed = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((f"<0x{b:02X}>", 0.0, 6) for b in range(256) if fallback), *((w, -float(i), 1) for i, w in enumerate(words)), ("[U]", 0.0, 4)]
    pieces = [(1, message((1, p.encode()), (2, score), (3, kind))) for p, score, kind in listed]
    trainer, normalizer = message((3, 2), (4, len(listed)), (35, fallback)), message((1, b"own"), (2, compiled), (3, 1), (4, squeezed), (5, 1))
    raw = message(*pieces, (2, trainer), (3, normalizer))
    (tmp_path / "own.model").write_bytes(raw)
    library = sentencepiece.SentencePieceProcessor(model_file=str(tmp_path / "own.model"))
    m, rng = sentence_pieces.Model(raw), random.Random(5)
    for _ in range(1_500):
        t = "".join(rng.choice(["A", "b", "ａｂ", "①", "㈱", "ß", " ", "  ", "　", "\t", "​", "é", "[U]", "C", "½", "x", "中", "▁"]) for _ in range(rng.choice([0, 1, 3, 12])))
        found = library.encode(t, return_type="proto").pieces
        ids, places = m.encode(t.encode(), end=False)
        assert ids.tolist() == [p.id for p in found], t
        if fallback or m.unknown not in ids:
            assert list(zip(places[:-1].tolist(), places[1:].tolist(), strict=True)) == [(p.begin, p.end) for p in found], t
        assert m.decode(ids) == library.decode(ids.tolist()), t


def plain_fim(doc_id, text):
    text = text or ""
    units = regex.findall(r"[A-Za-z]+|[^A-Za-z]", text, regex.S)
    digits = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digits[i : i + 8], 16) for i in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, middle, suffix = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    out = f"<S>{suffix}<P>{prefix}<M>{middle}" if h[3] % 100 < 20 else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return len(units), "spm" if h[3] % 100 < 20 else "psm", len(prefix), len(middle), out


def test_fim_against_a_plain_version(spark, texts):
    df = frame(spark, texts)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = [(i, *plain_fim(i, t)[:4], sha(plain_fim(i, t)[4]), sha(t or "")) for i, t in texts]
    assert sorted(map(tuple, fim.digests(df).collect()), key=str) == sorted(want, key=str)
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    done = fim.transform(fim.store(df), text=True)
    assert sorted(((r.doc_id, r.output) for r in done.collect()), key=str) == sorted(((i, plain_fim(i, t)[4]) for i, t in texts), key=str)
    assert sorted(map(tuple, fim.restore(done).collect()), key=str) == sorted(((i, t or "") for i, t in texts), key=str)
    assert fim.digests(df.limit(0)).count() == 0


@pytest.mark.parametrize("size", [5, 64])
def test_a_cut_opens_one_frame(monkeypatch, size):
    monkeypatch.setattr(fim, "FRAME", size)
    rng, compress = random.Random(size), zstandard.ZstdCompressor().compress
    for _ in range(300):
        text = "".join(rng.choice(["abc", "é", "中", " ", "<", "S>", "Q" * 40]) for _ in range(rng.randrange(60)))
        frames = list(fim.frames_of(text.encode(), compress))
        units = regex.findall(r"[A-Za-z]+|[^A-Za-z]", text)
        assert frames[-1]["units"] == len(units) and frames[-1]["chars"] == len(text)
        for n in range(len(units) + 1):
            reader = fim.Frames(frames)
            i, at, chars = reader.seek(n)
            assert reader.opened <= 1 and chars == len("".join(units[:n]))
            assert b"".join(reader.read((0, 0), (i, at))).decode() == "".join(units[:n])


def test_bytes_that_are_no_utf8(spark):
    df = spark.sql("SELECT 1L AS doc_id, cast(X'41FF42' AS string) AS text")
    assert fim.transform(fim.store(df), text=True).collect()[0].n == 3
    raw = sentence_pieces.default_model()
    assert sentence_pieces.decode(sentence_pieces.encode(df, raw), raw).collect()[0].decoded == "A�B"
