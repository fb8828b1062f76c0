import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerflow.llm import cutting_stock, encoding, packing, records, token_counts
from ledgerflow.llm.queries import tokenizer_path
from tests.llm.helpers import awkward, documents, empty, prose

BYTE, WORDS = "byte_bpe_50k.json", "word_bpe_49k.json"
ODD = ["", "  ", " a", "a ", "a\n\nb", "a \n b", "a\tb c", "x<|endoftext|>y z", "a\n", "it's 12 3a DON'T", "a b  c",
       "ΑΣ ΣΑ\nΣ", "İ ǅ K é", "中文 文字", "ſ ẞ ﬁ", "a​b \x00 \x1f x", "٣٤ Ⅷ ½", "\U0001F600 x", "x" * 3000 + " " + "ab" * 900]


def library(name, texts):
    tok = encoding.Encoder(tokenizer_path(name)).tokenizer
    return [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("name", [BYTE, WORDS])
def test_encoder_gives_the_library_ids(name):
    texts = ODD + [prose(i, 80) for i in range(40)] + [t or "" for _, t in awkward()]
    own = encoding.Encoder(tokenizer_path(name))
    assert own.rule != "whole"
    for _ in range(2):  # the second time from the cache
        assert [list(struct.unpack(f"<{len(b) // 4}I", b)) for b in own.encode(texts)] == library(name, texts)
    assert own.rule != "whole"


@pytest.mark.parametrize("name,forms", [(BYTE, ["a{0}1 {0} b", "?{0}! {0}{0}x", "e{0}'s{0}"]), (WORDS, ["a{0}1{0}?{0} e\u0301{0}\u0308"])])
def test_every_code_point_has_the_library_ids(name, forms):
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    own, bad = encoding.Encoder(tokenizer_path(name)), 0
    for form in forms:  # beside letters, digits, marks, white space and itself
        texts = [" ".join(form.format(c) for c in points[k:k + 512]) for k in range(0, len(points), 512)]
        bad += sum(list(struct.unpack(f"<{len(b) // 4}I", b)) != ids for b, ids in zip(own.encode(texts), library(name, texts)))
    assert bad == 0
    if name == WORDS:  # the usual letters take the fast way
        assert sum(own.known.values()) > 100_000 and own._own_way("Ünïcödé—«ж中»") and not own._own_way("Σ") and not own._own_way("e\u0301")


def test_ids_do_not_depend_on_earlier_texts():
    odd = "a \ua7cb b \u1c89 c"
    fresh, used = (encoding.Encoder(tokenizer_path(WORDS)) for _ in range(2))
    used.encode([prose(i, 20) for i in range(100)])
    assert fresh.encode([odd]) == used.encode([odd]) == [struct.pack(f"<{len(i)}I", *i) for i in library(WORDS, [odd])]


def test_counts_match_the_library(spark):
    rows = awkward() + [(100 + i, t) for i, t in enumerate(ODD)]
    out = token_counts.count_tokens(documents(spark, rows), tokenizer_path(BYTE), chunk_chars=2000, overlap_chars=16).collect()
    expected = sorted((i or 0, len((t or "").encode()), len(ids), len(ids) > 1024)
                      for (i, t), ids in zip(rows, library(BYTE, [t or "" for _, t in rows])))
    assert sorted((r["doc_id"] or 0, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in out) == expected
    assert max(r["n_chunks"] for r in out) > 10
    assert token_counts.count_tokens(empty(spark), tokenizer_path(BYTE)).count() == 0


@pytest.mark.parametrize("text", [prose(3, 900), "x" * 9000, "ab1" * 2000, ("word" * 40 + "\n") * 60, " \n " * 2500,
                                  "a <|endoftext|> b" * 400, "x<|endoftext|>" * 600, "中文字" * 2000])
@pytest.mark.parametrize("chunk, overlap", [(64, 4), (500, 33), (1000, 128)])
def test_overlapping_chunks_are_spliced_exactly(text, chunk, overlap):
    tok = token_counts.tokenizer(tokenizer_path(BYTE))
    n, _ = token_counts.count_chunked(tok, text, chunk, overlap)
    assert n == len(tok.encode(text, add_special_tokens=False).ids)


def test_plan_covers_the_demand_exactly():
    rng = np.random.default_rng(4)
    for trial in range(20):
        demand = {int(c): int(n) for c, n in zip(rng.integers(1, 65, 25), rng.integers(1, 400, 25))}
        planned = cutting_stock.plan(demand, 64)
        held = {}
        for pattern, times in planned:
            assert sum(c * k for c, k in pattern) <= 64 and times > 0
            for c, k in pattern:
                held[c] = held.get(c, 0) + k * times
        assert held == demand
        bound = sum(c * n for c, n in demand.items()) / 64
        whole = sum(n for c, n in demand.items() if c > 32)
        relaxed = sum(cutting_stock.solve(demand, 64).values())
        assert relaxed >= max(bound, whole) - 1e-3
        assert sum(t for _, t in planned) <= relaxed + len(demand)


def test_knapsack_against_all_multisets():
    rng = np.random.default_rng(5)
    for _ in range(30):
        duals = np.zeros(9)
        duals[1:] = rng.random(8)
        best = {0: 0.0}
        for c in range(1, 21):
            best[c] = max([best[c - 1]] + [best[c - s] + duals[s] for s in range(1, min(8, c) + 1)])
        worth, chosen = cutting_stock.price(duals, 20)
        assert worth == pytest.approx(best[20]) and sum(chosen) <= 20 and sum(duals[chosen]) == pytest.approx(worth)


def test_packing_holds_every_id_once(spark):
    rows = awkward() + [(1000 + i, prose(i, 20 + 7 * i)) for i in range(60)]
    out = packing.pack(documents(spark, rows), tokenizer_path(BYTE), seq_len=512).collect()
    ids = library(BYTE, [t or "" for _, t in rows])
    expected = sorted(zlib.crc32(np.array(x + [1], "<u4")[a:a + 512].tobytes()) for x in ids for a in range(0, len(x) + 1, 512))
    assert sorted(r["ids_crc32"] for r in out) == expected
    sequences = {}
    for r in out:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted(sequences) == list(range(len(sequences)))
    used = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 512
        used += at
    assert used == sum(len(x) + 1 for x in ids) and len(sequences) <= 1.1 * used / 512 + 2
    assert packing.pack(empty(spark), tokenizer_path(BYTE)).count() == 0


def test_records_come_back_in_order(spark, tmpdir_path):
    rows = awkward()
    records.write_records(documents(spark, rows), f"{tmpdir_path}/a", tokenizer_path(WORDS), 2)
    out = sorted(records.global_starts(records.read_records(spark, f"{tmpdir_path}/a")).collect(), key=lambda r: r["start"])
    ids = library(WORDS, [t or "" for _, t in rows])
    assert [r["doc_id"] for r in out] == sorted([i for i, _ in rows], key=lambda i: (i is not None, i or 0))
    at = 0
    for r in out:
        assert r["start"] == at
        at += r["n_tokens"]
    expected = sorted((i or 0, len(x) + 1, zlib.crc32(np.array(x + [2], "<u4").tobytes())) for (i, _), x in zip(rows, ids))
    assert sorted((r["doc_id"] or 0, r["n_tokens"], r["ids_crc32"]) for r in out) == expected
    index = spark.read.parquet(f"{tmpdir_path}/a/index")
    assert index.count() == len(rows)
    first, again, other = ([(r["turn"], r["doc_id"], r["ids"]) for r in records.read_shuffled(spark, f"{tmpdir_path}/a", s)
                            .orderBy("turn").collect()] for s in (1, 1, 2))
    assert first == again and [f[1] for f in first] != [f[1] for f in other]
    assert sorted(len(f[2]) for f in first) == sorted(len(x) + 1 for x in ids)


def test_empty_records(spark, tmpdir_path):
    records.write_records(empty(spark), f"{tmpdir_path}/e", tokenizer_path(WORDS), 2)
    assert records.global_starts(records.read_records(spark, f"{tmpdir_path}/e")).count() == 0


def test_damage_is_noticed():
    data = records.frame(5, struct.pack("<3I", 1, 2, 3), 2) + b"\n"
    assert list(records.frames(memoryview(data))) == [(0, len(data))]
    assert records.read_frame(memoryview(data))[1].tolist() == [1, 2, 3]
    with pytest.raises(ValueError):
        records.read_frame(memoryview(data[:-8] + b"\x07" + data[-7:]))
    with pytest.raises(ValueError):
        list(records.frames(memoryview(b"\x01" + data[1:])))


def test_very_long_white_space_goes_to_the_library(monkeypatch):
    own = encoding.Encoder(tokenizer_path("byte_bpe_50k.json"))
    texts = ["a" + " " * 2_000_000 + "b", "a" + "\n" * 2_000_000, "plain text"]
    assert own.rule == "byte" and own.encode(texts) == own._library(texts)
    assert own.rule == "byte"
    monkeypatch.setattr(encoding, "long_space", lambda text: False)  # the panic itself
    assert own.encode(texts) == own._library(texts)


def test_one_row_a_hundred_thousand_times(spark, tmp_path):
    """Equal rows are spread over files and cells, and every one is there."""
    n = 100_000
    docs = spark.range(n).select(F.lit(7).cast("long").alias("doc_id"), F.lit("The same words again.").alias("text"))
    ids = library(BYTE, ["The same words again."])[0] + [1]
    packed = packing.pack(docs, tokenizer_path(BYTE))
    rows = packed.groupBy("sequence_id").agg(F.sum("length").alias("used"), F.max("offset").alias("last"), F.count("*").alias("n")).collect()
    assert sum(r["n"] for r in rows) >= n and sum(r["used"] for r in rows) == n * len(ids) and max(r["used"] for r in rows) <= 2048
    records.write_records(docs, f"{tmp_path}/r", tokenizer_path(WORDS), end_id=2, shard_bytes=200_000)
    back = records.read_records(spark, f"{tmp_path}/r").groupBy("file").agg(F.count("*").alias("n")).collect()
    assert sum(r["n"] for r in back) == n and len(back) > 4 and max(r["n"] for r in back) < n / 2


def test_frames_of_every_byte_survive_the_text_writer(spark, tmp_path):
    """Record files are bytes that pass through Spark's text writer: every value, line feeds and broken UTF-8 among them."""
    texts = [bytes([b]).decode("latin-1") * (1 + b % 5) + " é\n中 " * (b % 3) for b in range(256)]
    docs = documents(spark, list(enumerate(texts)), extra=False)
    records.write_records(docs, f"{tmp_path}/r", tokenizer_path(WORDS), end_id=2, shard_bytes=2_000)
    data = b"".join(r["content"] for r in spark.read.format("binaryFile").load(f"{tmp_path}/r/data/part-*").collect())
    assert len(set(data)) > 200 and b"\n" in data and b"\xff" in data
    back = {r["doc_id"]: r["n_tokens"] for r in records.read_records(spark, f"{tmp_path}/r").collect()}
    assert back == {i: len(ids) + 1 for i, ids in enumerate(library(WORDS, texts))}
