import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from locuspark.llm.packing import Packer, pack
from locuspark.llm.token_counts import ChunkEncoder, token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", None, "   \n\t ", "Hello, world!", "It's we'll <|endoftext|>x a<|startoftext|>", "é ́x", "\xa0 a\x85b \x1c\x1dc", "ÀÉß Ñandú ÷×", "İstanbul ΣΑΣ ﬁ １２", "x" * 5000, "ab " * 3000, "a\x0bb\x0cc", "don't'", "日本語テキスト 123", "word,word;word", "naïve—café…"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "k", i) for i, t in enumerate(ODD)] + [(3, ODD[3], "k", 0), (None, "no id", "k", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, start long")


def library(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids


def test_counts_are_the_librarys(spark, docs):
    got = sorted(((r.doc_id is None, r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(docs, PATH).collect()), key=str)
    want = sorted(((r.doc_id is None, r.doc_id, len((r.text or "").encode()), n, n > 2048) for r in docs.collect() for n in [len(library(r.text))]), key=str)
    assert got == want


def test_a_small_cache_changes_nothing():
    texts = [(t or "").encode() for t in ODD] * 3
    want = [np.asarray(library(t.decode()), "<u4").tobytes() for t in texts]
    assert list(ChunkEncoder(PATH, limit=5).values(texts)) == want
    assert list(ChunkEncoder(PATH, lengths=True, limit=3, first={b"ab": 1}).values(texts)) == [len(w) // 4 for w in want]


def test_empty_table(spark, docs):
    assert token_counts(docs.limit(0), PATH).count() == 0
    assert pack(docs.limit(0), PATH).count() == 0


def test_packing_is_an_exact_round_trip(spark, docs):
    rows = pack(docs.where("doc_id is not null").dropDuplicates(["doc_id"]).repartition(3), PATH).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    seen, windows = {}, {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        ids = np.asarray(r.ids, "<u4")
        assert r.length == len(ids) and r.ids_crc32 == zlib.crc32(ids.tobytes())
        assert r.start == len(seen.setdefault(r.doc_id, []))
        seen[r.doc_id] += r.ids
        assert r.doc_tokens == len(library(texts[r.doc_id])) + 1
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert seen == {k: library(t) + [1] for k, t in texts.items() if k is not None}
    padding = 0
    for pieces in windows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding == 0


def test_repeated_rows_are_packed_each(spark, docs):
    assert {r.doc_id for r in pack(docs, PATH).collect()} == {r.doc_id for r in docs.collect()}
    assert pack(docs, PATH).groupBy().sum("length").first()[0] == sum(len(library(r.text)) + 1 for r in docs.collect())


def test_place_minimises_the_sum_of_squares():
    rng, p = np.random.default_rng(5), Packer(64)

    def total(count):
        return int((count[1:64] ** 2).sum())

    for size in rng.integers(1, 65, 400).tolist():
        options = {}
        for level in [0, *(h for h in range(1, 65 - size) if p.count[h])]:
            c = p.count.copy()
            if level:
                c[level] -= 1
            c[level + size] += level + size < 64
            options[level] = total(c)
        assert options[p.place(size)] == min(options.values())
        p.add((0, 0, size))


@pytest.mark.parametrize("parts", [1, 8, 32])
def test_sum_of_squares_places_nearly_all_tokens(parts):
    """The end of a partition moves a few percent of the tokens at most, wherever the input is cut, and pads nothing."""
    sizes = np.maximum(1, np.random.default_rng(7).lognormal(5.5, 1.2, 10_000)).astype(int)
    moved = 0
    for mine in np.array_split(sizes, parts):
        packer, done, seen = Packer(), [], {}
        for doc, n in enumerate(mine.tolist()):
            seen[doc] = n % 2048
            if seen[doc] and (full := packer.add((doc, 0, seen[doc]))):
                done.append(full)
        home = {piece[0]: k for k, window in enumerate(w for ws in packer.open.values() for w in ws) for piece in window}
        for window in packer.rest():
            size = sum(p[2] for p in window)
            assert size == 2048 or size & (size - 1) == 0
            held = {}
            for doc, _, n in window:
                held[home[doc]] = held.get(home[doc], 0) + n
            moved += size - max(held.values())
            done.append(window)
        ids = {}
        for doc, start, n in sorted(p for w in done for p in w):
            assert start == ids.get(doc, 0)
            ids[doc] = start + n
        assert ids == {d: n for d, n in seen.items() if n}
    assert moved < 0.04 * sizes.sum()


def test_a_file_with_other_rules_is_refused(tmp_path):
    import json

    rules = json.load(open(PATH, encoding="utf-8"))
    rules["normalizer"] = {"type": "Lowercase"}
    (tmp_path / "t.json").write_text(json.dumps(rules))
    with pytest.raises(ValueError):
        ChunkEncoder(str(tmp_path / "t.json"))


@pytest.mark.parametrize("lengths", [False, True])
def test_parts_are_cut_by_tokens_that_end_words(lengths):
    texts = ["Plain words, and MORE words!", "é, naïve café... don't", "words of any_kind 12 x"]
    library = Tokenizer.from_file(PATH)
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    encoder = ChunkEncoder(PATH, lengths=lengths)
    calls = []

    class Watched:
        def encode(self, text, **rest):
            calls.append(text)
            return library.encode(text, **rest)

    encoder.tokenizer = Watched()

    def value(ids):
        return len(ids) if lengths else np.asarray(ids, "<u4").tobytes()

    assert list(encoder.values([t.encode() for t in texts])) == [value(w) for w in want]
    assert sorted(calls) == ["12", "any_kind", "don't"]  # the rest needs no normal form
    encoder = ChunkEncoder(PATH, lengths=lengths)
    encoder.ends[:] = False  # a model whose tokens do not show where words end
    assert list(encoder.values([t.encode() for t in texts])) == [value(w) for w in want]
