import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from llmdata import SF
from tracewalk.llm import bitplanes as bp
from tracewalk.llm import textkernel as tk

PATH = public_tokenizers.path("byte_bpe_50k.json")


def expected(rows):
    lib, start, out = Tokenizer.from_file(PATH), 0, []
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("planes", ["byte", "bit"])
def test_files_hold_what_the_library_gives(spark, planes):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    made = bp.write_token_files(docs, PATH, planes=planes, block_ids=1000)
    got = sorted(tuple(r) for r in bp.read_token_files(made).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    assert got == expected([(r.doc_id, r.text) for r in docs.collect()])


def test_odd_rows(odd_docs, no_docs):
    got = [tuple(r) for r in bp.read_token_files(bp.write_token_files(odd_docs, PATH)).collect()]
    want = expected([(r.doc_id, r.text) for r in odd_docs.collect()])
    assert sorted(got, key=lambda r: r[1]) == want
    assert bp.read_token_files(bp.write_token_files(no_docs, PATH)).count() == 0


@pytest.mark.parametrize("kind", ["byte", "bit"])
@pytest.mark.parametrize("n", [0, 1, 7, 1000])
def test_planes_round_trip(kind, n):
    ids = np.random.default_rng(n).integers(0, 1 << 32, n).astype(np.uint32)
    assert bp.from_planes(bp.to_planes(ids, kind), n).tolist() == ids.tolist()


def test_pieces_put_together_are_the_texts_ids():
    random.seed(11)
    letters = [*" \n\t'.,aéstZ1९٣ 　×Жя<|>-中 re'll\r\x0b", "  ", "'s", "\n\n", "<|endoftext|>", "'re", " '", " "]
    texts = ["".join(random.choice(letters) for _ in range(random.randint(0, 40))) for _ in range(20_000)]
    enc, lib = bp.PieceEncoder(PATH), Tokenizer.from_file(PATH)
    for first, end, data, offsets in tk.chunks(pa.array(texts), 50_000):
        ids, n = enc.encode(data, offsets)
        cuts = np.concatenate([[0], np.cumsum(n)])
        for i, e in enumerate(lib.encode_batch(texts[first:end], add_special_tokens=False)):
            assert ids[cuts[i] : cuts[i + 1]].tolist() == e.ids, repr(texts[first + i])


def test_cache_that_overflows(monkeypatch):
    monkeypatch.setattr(bp, "CACHE_PIECES", 50)
    texts = [f"word{i} other{i}" for i in range(500)]
    enc, lib = bp.PieceEncoder(PATH), Tokenizer.from_file(PATH)
    for first, end, data, offsets in tk.chunks(pa.array(texts), 300):
        ids, _ = enc.encode(data, offsets)
        assert ids.tolist() == [x for e in lib.encode_batch(texts[first:end], add_special_tokens=False) for x in e.ids]


def test_another_kind_of_tokenizer_is_encoded_whole():
    enc = bp.PieceEncoder(public_tokenizers.path("word_bpe_49k.json"))
    data = np.frombuffer(b"Hello  World", np.uint8)
    assert not enc.cuts and enc.encode(data, np.array([0, 12]))[0].tolist() == enc.tokenizer.encode("Hello  World", add_special_tokens=False).ids


def test_a_torn_file_is_refused(tmp_path):
    (tmp_path / "x").write_bytes(b"TWPLANE1" + b"\0" * 40)
    with pytest.raises(ValueError, match="whole"):
        bp.PlaneReader(f"file://{tmp_path}/x")


def test_every_ascii_character_is_cut_as_the_library_does():
    import random

    from tokenizers import Tokenizer

    library, enc, rng = Tokenizer.from_file(PATH), bp.PieceEncoder(PATH), random.Random(1)
    texts = ["a\x1c's b", "it\x1f's", *("".join(rng.choice("\x00\x0b\x1c\x1d\x1e\x1f\x7f \t\n's'ta1.é\u00a0\u0085") for _ in range(rng.randint(1, 9))) for _ in range(6000))]
    texts += ["".join(chr(rng.randrange(128)) for _ in range(12)) for _ in range(6000)]
    raw = [t.encode() for t in texts]
    ids, n = enc.encode(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]))
    got = [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
    assert got == [x.ids for x in library.encode_batch_fast(texts, add_special_tokens=False)]


def test_a_partition_is_cut_into_files(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").coalesce(1)
    setting, own = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set(setting, 5)
    try:
        made = bp.write_token_files(docs, PATH, file_texts=7)
    finally:
        spark.conf.set(setting, own)
    assert made.count() > 15
    whole = {tuple(r) for r in bp.read_token_files(bp.write_token_files(docs, PATH)).collect()}
    assert {tuple(r) for r in bp.read_token_files(made).collect()} == whole


def test_single_pre_tokens_go_to_the_model_alone(monkeypatch):
    """Words, numbers and punctuation cost no pass through the whole library, and their ids are the library's in every two-byte letter."""
    letters = [chr(c) for c in (*range(0xC0, 0x100), *range(0x400, 0x480)) if c not in (0xD7, 0xF7)]
    texts = [f"{c}a {c}{d}1 Zz{c}{d}..{c}" for c, d in zip(letters, letters[::-1], strict=True)] + ["a \x00\x7f!? 12 b", " lead", "end 9", "a"]
    lib, enc, passed = Tokenizer.from_file(PATH), bp.PieceEncoder(PATH), []
    whole = enc._library
    monkeypatch.setattr(enc, "_library", lambda pieces: passed.extend(pieces) or whole(pieces))

    def check(texts):
        ids, n = enc.encode(*next(tk.chunks(pa.array(texts)))[2:])
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [lib.encode(t, add_special_tokens=False).ids for t in texts]

    check(texts)
    assert not passed
    check(["it's  two\t中 ×x end ", "new words"])
    assert passed and not {"new", " words"} & set(passed)


def test_a_tokenizer_that_truncates_is_encoded_whole(tmp_path):
    lib = Tokenizer.from_file(PATH)
    lib.enable_truncation(3)
    lib.save(str(tmp_path / "short.json"))
    enc = bp.PieceEncoder(str(tmp_path / "short.json"))
    ids, n = enc.encode(*next(tk.chunks(pa.array(["one two three four five", "six"])))[2:])
    assert not enc.cuts and ids.tolist() == [x for t in ("one two three four five", "six") for x in lib.encode(t, add_special_tokens=False).ids] and n.tolist() == [3, 1]
