"""Token ids, shards and packing against the tokenizer itself."""

import random
import zlib

import numpy as np
import pytest

from orrery.llm import packing, token_store, tokens

PATH = tokens.default_tokenizer()
ALPHABET = ["a", "word", "é", "ß", "中", " ", " ", "  ", "\n", "\n\n", " \n", "\t", ".", ",", "'s", "12", "<|endoftext|>", "<s>", "\r\n", "\x00", "ab.", "́", "😀", "\xa0", "don't"]


def texts(n, seed=1, most=30):
    draw = random.Random(seed)
    return ["".join(draw.choice(ALPHABET) for _ in range(draw.randrange(most))) for _ in range(n)]


def plain(text):
    return tokens.encoder(PATH).tokenizer.encode(text or "", add_special_tokens=False).ids


def test_cut_texts_have_the_ids_of_whole_ones():
    some = [*texts(4000), *(" ".join(texts(40, 5, 4)) for _ in range(20)), "a\n", "\na", " a", "a ", "a\n\nb", "\n", " "]
    for _ in range(2):  # the second time from the dictionary
        assert [np.frombuffer(x, "<u4").tolist() for x in tokens.encoder(PATH).encode(some)] == [plain(t) for t in some]


ROWS = [(5, "a b"), (3, None), (9, ""), (-2, "word " * 30_000), (4, "a b"), (5, "again"), (7, "é\n中"), (8, "x\ty")]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id int, text string, start int, length int").repartition(3)


def test_shards_are_read_back(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    index = token_store.write_shards(frame(spark, ROWS), path, shards=3)
    found = token_store.read_shards(index, path).orderBy("start").collect()
    assert [r["doc_id"] for r in found] == sorted(d for d, _ in ROWS)
    at = 0
    want = {}
    for d, t in ROWS:
        want.setdefault(d, []).append([*plain(t), 2])
    for r in found:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert ids in want[r["doc_id"]] and r["start"] == at and r["n_tokens"] == len(ids)
        want[r["doc_id"]].remove(ids)
        at += len(ids)
    assert not any(want.values())
    assert token_store.read_shards(token_store.write_shards(frame(spark, ROWS).where("false"), path + "0"), path + "0").count() == 0


@pytest.mark.parametrize("rows", [ROWS, [(i, t) for i, t in enumerate(texts(300, 3, 900))], [(1, None)] * 40, []])
def test_packing_is_whole_gapless_and_near_the_least_number_of_sequences(spark, rows):
    found = packing.pack_documents(frame(spark, rows), size=64).collect()
    size = 64
    docs = sorted((d, tuple([*plain(t), 0])) for d, t in rows)
    pieces = {}
    for r in found:
        pieces.setdefault((r["doc_id"], r["start"] == 0 and r["piece"] == 0), None)
    # each document's pieces, by their checksums
    want = []
    for d, ids in docs:
        n = len(ids)
        ends = list(range(n % size or size, n + 1, size)) if n > size else [n]
        for k, (a, b) in enumerate(zip([0, *ends], ends)):
            want.append((d, k, a, b - a, zlib.crc32(np.asarray(ids[a:b], "<u4").tobytes())))
    assert sorted(want) == sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found)
    bins = {}
    for r in found:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    total = sum(w[3] for w in want)
    assert len(bins) <= 1.1 * -(-total // size) + 1


def test_best_two_fit_replaces_the_smallest():
    counts = np.zeros(11, np.int64)
    counts[[6, 3, 2]] = 1, 1, 2  # greedy: 6 + 3; the 3 gives way to 2 + 2
    assert packing.plan_bins(counts) == [(1, [6, 2, 2]), (1, [3])]
