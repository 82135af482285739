"""BPE, token counts and archives against the libraries and plain Python."""

import base64
import hashlib
import struct
from collections import defaultdict

import numpy as np
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer as Library

from pricewell.llm import bpe, queries, token_counts, warc
from pricewell.llm.tables import read

SF = "/root/testdata/sf0.001"
ODD = [
    None,
    "",
    "a" * 30_000,
    " " * 3_000,
    "  \n\n x<|endoftext|>y <|endoftext|><|startoftext|> <|end oftext|>",
    "naïve café   　x 漢字仮名交じり文 ½²Ⅷ٣",
    "'s's'll I'LL don't 'S",
    "🙂🙃é​﻿" * 50,
    "\x00\x01\xff\x1c \x1d\x85  z",
    "ΑΣ ΑΣ Σ İ I i̇",
    "1234567890" * 99,
    "aaaa aaaaa aaaaaa\r\n\r\n \t x",
    "word " * 40_000,
]


@pytest.fixture(scope="module")
def own():
    return bpe.Tokenizer(queries.BYTE_BPE)


@pytest.fixture(scope="module")
def library():
    return Library.from_file(queries.BYTE_BPE)


@pytest.fixture(scope="module")
def words():
    return token_counts.library_tokenizer(queries.WORD_BPE)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" the'ing\n<|>")), max_size=60), max_size=8))
def test_ids_are_the_librarys(own, library, texts):
    got = [np.frombuffer(x, "<u4").tolist() for x in own.encode_batch(texts)]
    assert got == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    assert [own.decode(x) for x in got] == texts


def test_decode_of_cut_characters(own, library):
    ids = library.encode("🙂漢é", add_special_tokens=False).ids
    for end in range(len(ids) + 1):
        assert own.decode(ids[:end]) == library.decode(ids[:end], skip_special_tokens=False)


def test_encoding_forgets_and_goes_on(own, library, monkeypatch):
    monkeypatch.setattr(bpe.Tokenizer, "remembered", 3)
    texts = ["one two three four", "four five six", "one one"]
    for text in texts:
        assert np.frombuffer(own.encode_batch([text])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_bpe_of_all_documents_and_odd_texts(spark, library):
    odd = spark.createDataFrame([(-i, t, 1) for i, t in enumerate(ODD)] + [(None, "x", 1)], "doc_id long, text string, token_ids int")
    docs = read(spark, SF, "documents").select("doc_id", "text", F.lit(1).alias("token_ids")).union(odd)
    rows = bpe.encoded(docs, queries.BYTE_BPE).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.token_ids == library.encode(r.text or "", add_special_tokens=False).ids
        assert r.decoded == (r.text or "")
    for r in bpe.digests(odd.where("doc_id is not null"), queries.BYTE_BPE).collect():
        ids = library.encode(ODD[-r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((ODD[-r.doc_id] or "").encode()).hexdigest()
    assert bpe.digests(docs.limit(0), queries.BYTE_BPE).count() == 0


@settings(max_examples=400, deadline=None)
@given(
    st.lists(
        st.one_of(
            st.characters(exclude_categories=["Cs", "Zs", "Cc"]),
            st.sampled_from(["'s", "'", "'RE", "<|endoftext|>", "<|", "|>", "a", "Z", "7", "!", "=", "\u0338", "\u0301", "。", "か", "\u3099", "漢", "，"]),
        ),
        max_size=40,
    )
)
def test_parts_have_the_tokens_of_the_whole(words, pieces):
    text = "".join(pieces)
    found = list(token_counts.parts(text.encode(), 1))
    assert b"".join(found).decode() == text
    assert sum(len(words.encode(x.decode(), add_special_tokens=False)) for x in found) == len(words.encode(text, add_special_tokens=False))


def test_a_long_text_without_white_space(words):
    rng = np.random.default_rng(2)
    letters = "".join(rng.choice(list("abcXYZ0123456789+/=-_'|<>é漢。"), 2_000_000))
    known = {}
    text = (letters + " short").encode()
    assert max(map(len, token_counts.parts(letters.encode(), token_counts.PART))) < 20_000
    assert token_counts.lengths([text, b""], words, known, 50_000) == [len(words.encode(text.decode(), add_special_tokens=False)), 0]
    assert list(known) == [b"short"]


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        token_counts.library_tokenizer(queries.BYTE_BPE)


def test_token_counts(spark):
    library = Library.from_file(queries.WORD_BPE)
    odd = spark.createDataFrame([(-i, t, "x") for i, t in enumerate(ODD)] + [(None, "x", "x")], "doc_id long, text string, n_tokens string")
    docs = read(spark, SF, "documents").select("doc_id", "text", F.lit("x").alias("n_tokens")).union(odd)
    texts = docs.select("doc_id", "text").collect()
    got = token_counts.counted(docs, queries.WORD_BPE, batch_bytes=3_000).collect()
    want = [(r.doc_id, len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in texts]
    assert [(r.doc_id, r.n_bytes, r.n_tokens) for r in got] == want
    assert token_counts.counted(docs.limit(0), queries.WORD_BPE).count() == 0


PAGE = "page_id long, url string, html string, record_type string, payload string"


def expected(pages):
    groups = defaultdict(list)
    for i, _, html, *_ in pages:
        groups[html or ""].append(i)
    out = []
    for html, ids in groups.items():
        best = max(ids, key=lambda i: (i is not None, i or 0))
        left = 1
        for i in ids:
            first = i == best and left
            left -= bool(first)
            raw = html.encode()
            out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if first else "revisit", None if first else best))
    return sorted(out, key=repr)


def shown(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=repr)


def test_archives_of_all_pages(spark):
    pages = [tuple(r) for r in read(spark, SF, "pages").select("page_id", "url", "html").collect()]
    assert shown(queries.op10_zstd_warc(spark, SF)) == expected(pages)


@pytest.mark.parametrize("size", [16_000_000, 2_000])
def test_archives_of_odd_pages(spark, size, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", size)
    pages = [(i, f"http://x/{i}", f"page {i % 7} é", "a", "b") for i in range(200)]
    pages += [(300, None, None, None, None), (301, "u\r\nX: y", "", "a", "b"), (None, "u", "lone", "a", "b"), (None, "u", "page 3 é", "a", "b")]
    pages += [(400, "u", "again\r\n\r\nWARC/1.1", "a", "b")] * 3 + [(401, "u", "y" * 3_000_000, "a", "b")]
    df = spark.createDataFrame(pages, PAGE)
    out = warc.round_trip(df)
    assert shown(out) == expected(pages)
    told = {r.page_id: bytes(r.payload) for r in out.where("record_type = 'response' and page_id is not null").collect()}
    assert told[401] == b"y" * 3_000_000 and told[301] == b"" and told[400].endswith(b"WARC/1.1")
    assert warc.round_trip(df.limit(0)).count() == 0


@pytest.mark.parametrize("broadcast", ["10485760", "-1"])
def test_equal_rows_in_several_files(spark, tmp_path, broadcast):
    pages = [(i, f"http://x/{i % 50}", f"page {i} é", "a", "b") for i in range(50)] + [(None, None, None, "a", "b")]
    for _ in range(3):
        spark.createDataFrame(pages, PAGE).coalesce(1).write.mode("append").parquet(str(tmp_path / "pages"))
    spark.createDataFrame([(7, "http://a", "page 7 é", "a", "b"), (60, "u", "page 9 é", "a", "b")], PAGE).coalesce(1).write.mode("append").parquet(str(tmp_path / "pages"))
    df = spark.read.parquet(str(tmp_path / "pages"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        folder = f"file://{tmp_path}/archives"
        warc.write_archives(warc.deduplicated(df), folder, None).collect()
        out = warc.read_archives(spark, folder)
        assert shown(out) == expected([tuple(r) for r in df.collect()])
        assert out.where("record_type = 'response'").count() == 51
        assert out.where("page_id = 7 and record_type = 'response'").first().url == "http://a"
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    ids = [warc.parsed_record(r)[0]["warc-record-id"] for f in (tmp_path / "archives").glob("*.warc.zst") for r in warc.frames(f.read_bytes())]
    assert len(ids) == len(set(ids)) == 155


def test_frames_with_and_without_dictionary():
    words = [f"<p>paragraph {i} of {i * 7 % 13} pages about {'abcdefgh'[i % 8] * 9}</p>".encode() * 9 for i in range(400)]
    trained = zstandard.train_dictionary(4_096, words)
    packer = zstandard.ZstdCompressor(dict_data=trained)
    records = [warc.page_record(i, f"u{i}", "response", None, len(w), warc.base32_digest(hashlib.sha1(w).digest()), w) for i, w in enumerate(words)]
    packed = [packer.compress(r) for r in records]
    assert list(warc.frames(warc.dictionary_frame(trained.as_bytes()) + b"".join(packed))) == records
    raw_dictionary = struct.pack("<II", warc.DICTIONARY_MAGIC, len(trained.as_bytes())) + trained.as_bytes()
    assert list(warc.frames(raw_dictionary + b"".join(packed))) == records
    assert list(warc.frames(b"".join(zstandard.ZstdCompressor().compress(r) for r in records[:3]))) == records[:3]
    assert list(warc.frames(b"")) == []
    with pytest.raises(ValueError, match="cut off"):
        list(warc.frames(warc.dictionary_frame(trained.as_bytes()) + packed[0][:-3]))
    with pytest.raises(ValueError, match="cut off"):
        list(warc.frames(warc.dictionary_frame(trained.as_bytes())[:-9]))


def test_broken_records_are_told():
    good = warc.page_record(1, "u", "response", None, 3, warc.base32_digest(hashlib.sha1(b"abc").digest()), b"abc")
    assert warc.checked_page(good)[0] == 1
    for old, new in ((b"Content-Length: 3", b"Content-Length: 4"), (b"WARC/1.1", b"HTTP/1.1"), (b"abc\r\n", b"abd\r\n"), (b"WARC-Record-ID", b"X-Other"), (b"X-Payload-Length: 3", b"X-Payload-Length: 9"), (b"sha1:", b"md5:")):
        with pytest.raises(ValueError):
            warc.checked_page(good.replace(old, new))


def test_tokenizer_holds_little_at_a_time():
    import inspect

    assert inspect.signature(bpe.encoded).parameters["batch_bytes"].default <= 1_000_000
