"""Operators 2, 5 and 10 against their libraries."""
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest

from assay_spark.llm.pattern_pack import WordIds, fit_repeats, pack_documents, plan_sequences
from assay_spark.llm.piece_codec import PieceVocabulary, encode_pieces, piece_digests
from assay_spark.llm.token_offsets import TokenSpans, attribute, section_tokens

EDGE = ["", " ", "a", "  two  spaces ", "\n", "x\n\n  y", "▁▁x ▁", "<s> </s> <0x0A>", "é́ ﬁ Å ½.", "日本語🙂👨‍👩‍👧", "x" * 300, "don't we'll.x it's,he'll",
        "<|endoftext|>x <|startoftext|>.", "İ.", "ΑΣ. Σ", "\x1cab\x85.", "à̈. b", "\t\r\xa0 a b.\n"]


def random_texts(n=60, seed=1):
    rng = random.Random(seed)
    alphabet = "abcde eth .,;!\n éßñ日🙂́'0123"
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(80))) for _ in range(n)]


@pytest.fixture(scope="module")
def pieces():
    return PieceVocabulary(P.path("piece_bpe_32k.model"))


def test_pieces_equal_the_library(pieces):
    texts = EDGE + random_texts()
    for t, got in zip(texts, pieces.encode(texts)):
        assert np.frombuffer(got, "<u4").tolist() == pieces.sp.encode(t, add_bos=True, add_eos=True), t


def test_both_agendas_agree(pieces):
    units = [u for t in random_texts(80, 2) for u in pieces.units.findall("▁" + t.replace(" ", "▁"))]
    assert pieces.merge_many(units) == [pieces.merge(u) for u in units]


def test_codec_rows(spark, docs, empty):
    out = encode_pieces(docs, P.path("piece_bpe_32k.model"), check="texts").collect()
    assert len(out) == docs.count()
    by = {r["doc_id"]: r for r in out}
    assert by[3]["ids"] == by[4]["ids"] == [1, 2] and by[4]["decoded"] == ""
    assert by[7]["decoded"] == "long " * 6000 + "end"
    digest = {r["doc_id"]: r for r in piece_digests(docs, P.path("piece_bpe_32k.model")).collect()}
    for i, r in by.items():
        assert digest[i]["n_tokens"] == len(r["ids"])
        assert digest[i]["ids_sha256"] == hashlib.sha256(np.array(r["ids"], "<u4").tobytes()).hexdigest()
    assert encode_pieces(empty, P.path("piece_bpe_32k.model")).count() == 0


def word_ids(texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    return [e.ids + [1] for e in tok.encode_batch(texts, add_special_tokens=False)]


def check_packing(rows, max_len):
    seqs = {}
    for r in rows:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in seqs.values():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert at <= max_len
    return len(seqs)


def test_packing(spark, docs, empty):
    out = pack_documents(docs, P.path("word_bpe_49k.json"), max_len=512).collect()
    n = check_packing(out, 512)
    want = []
    for i, t in [(r["doc_id"], r["text"] or "") for r in docs.collect()]:
        ids = word_ids([t])[0]
        want += [(i, p, at, len(ids[at:at + 512]), zlib.crc32(np.array(ids[at:at + 512], "<u4").tobytes())) for p, at in enumerate(range(0, len(ids), 512))]
    key = lambda r: (r[0] or -1, r[1:])
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out), key=key) == sorted(want, key=key)
    assert n <= -(-sum(w[3] for w in want) // 512) + 1
    assert pack_documents(empty, P.path("word_bpe_49k.json")).count() == 0


def test_word_ids_equal_the_library(spark):
    texts = EDGE + random_texts(80, 3)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    out = {r["doc_id"]: r for r in pack_documents(df, P.path("word_bpe_49k.json")).collect()}
    for k, ids in enumerate(word_ids(texts)):
        assert (out[k]["length"], out[k]["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), texts[k]


@pytest.mark.parametrize("seed", range(5))
def test_plan_uses_all_and_is_near_the_bound(seed):
    rng = np.random.default_rng(seed)
    counts = {}
    for v in np.clip(rng.lognormal(5, 1.3, 4000), 1, 1024).astype(int).tolist():
        counts[v] = counts.get(v, 0) + 1
    plan, used = plan_sequences(dict(counts), 1024), {}
    for parts, n in plan:
        assert sum(parts) <= 1024 and n > 0
        for v in parts:
            used[v] = used.get(v, 0) + n
    assert used == counts
    assert sum(n for _, n in plan) <= 1.01 * sum(k * n for k, n in counts.items()) / 1024 + 1


def test_fit_repeats_solves_a_small_system():
    patterns = np.array([[6, 4, 0], [5, 5, 0], [4, 4, 2]])
    hist = np.zeros(11)
    hist[[6, 5, 4, 2]] = [10, 8, 14, 2]
    assert np.allclose(fit_repeats(patterns, hist, 2000), [10, 4, 2], atol=0.2)


def test_token_spans_equal_whole_encoding():
    v = TokenSpans(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    for t in EDGE + random_texts(80, 4):
        assert v.lengths(t).tolist() == v.length[v.encoding.encode_ordinary(t)].tolist()


def test_rules_allocate_crossing_tokens():
    starts = np.array([0, 4, 6])
    lengths = np.array([3, 2, 5])  # spans 0-3, 3-5, 5-10
    assert attribute(lengths, starts, 10, "start").tolist() == [2, 1, 0]
    assert attribute(lengths, starts, 10, "end").tolist() == [1, 1, 1]
    assert attribute(lengths, starts, 10, "majority").tolist() == [2, 0, 1]


@pytest.mark.parametrize("rule", ["start", "end", "majority"])
def test_section_totals(spark, docs, empty, rule):
    v = TokenSpans(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    out = section_tokens(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, rule).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for i, t in texts.items():
        rows = [r for r in out if r["doc_id"] == i]
        times = 2 if i == 2 else 1  # a repeated row
        assert sum(r["n_tokens"] for r in rows) == times * len(v.encoding.encode_ordinary(t))
        assert sum(r["n_chars"] for r in rows) == times * len(t)
    assert section_tokens(empty, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def test_word_ids_equal_the_library(monkeypatch):
    import random

    import public_tokenizers
    from tokenizers import Tokenizer

    from assay_spark.llm import pattern_pack

    path = public_tokenizers.path("word_bpe_49k.json")
    tok, rng = Tokenizer.from_file(path), random.Random(0)
    some = "aB \u00e9'sSt\u00c9.,!?|#\n \t\x1c\xa0\u2003\u00df\u0130\u0131\u017fK\u030a\u00c5\u4e2d3\u00bd<|endoftext|>\u013a\u1e9e\u00ad_-"
    texts = ["", " ", "it's word, word. word### ### don't"] + ["".join(rng.choice(some) for _ in range(rng.randint(0, 60))) for _ in range(2000)]
    for entries in (1_500_000, 50):
        monkeypatch.setattr(pattern_pack, "CACHE_ENTRIES", entries)
        words = WordIds(path)
        got = [i for k in range(0, len(texts), 100) for i in words.encode(texts[k:k + 100], 1)]
        want = [np.array([*e.ids, 1], "<u4").tobytes() for e in tok.encode_batch(texts, add_special_tokens=False)]
        assert got == want
