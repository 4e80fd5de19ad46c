"""Best-fit packing: every token of every document once, no document cut needlessly, few sequences."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from loomgraph.llm import best_fit

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id bigint, text string, piece int, item string, sequence_id string, `group` string"


TOKENIZER = Tokenizer.from_file(PATH)


def plain_ids(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 1]


def check(got, docs, limit):
    """docs: (doc_id, ids).  Returns the number of sequences."""
    want = Counter((d, k, at, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for d, ids in docs for k, at in enumerate(range(0, len(ids), limit)) for x in [ids[at : at + limit]])
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= limit
    return len(bins)


def least(docs, limit):
    sizes = [len(ids) for _, ids in docs]
    full = sum(n // limit for n in sizes)
    return full + -(-sum(n % limit for n in sizes) // limit)


def best_fit_at_once(docs, limit):
    sizes = [min(limit, len(ids) - at) for _, ids in docs for at in range(0, len(ids), limit)]
    return len(best_fit.best_fit(sizes, limit))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["alpha", "beta", "the", "of", "é"]) for _ in range(rng.choice([3, 10, 30, 60, 90]))) for _ in range(400)]
    texts += ["", None, " \n", "long " * 1500, "same text", "same text", "🙂 ok", "<|endoftext|> kept as text"]
    return [*enumerate(texts), (3, texts[3]), (None, "null id"), (None, None)]


@pytest.mark.parametrize("parts,keep,window", [(1, 4000, 100_000), (40, 4000, 100_000), (40, 12, 100_000), (3, 40, 64), (300, 4000, 100_000)])
def test_packs_everything_into_few(spark, rows, parts, keep, window):
    df = spark.createDataFrame([(i, t, 9, "x", "y", "z") for i, t in rows], SCHEMA).repartition(parts)
    docs = [(i, plain_ids(t)) for i, t in rows]
    out = best_fit.pack(df, PATH, limit=128, keep=keep, window=window)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    n = check(out.collect(), docs, 128)
    assert least(docs, 128) <= n <= (1.02 if keep == 4000 else 1.15) * best_fit_at_once(docs, 128) + 1


def test_items_that_fit_nothing_end_the_tree(spark):
    """Documents of more than half a sequence each stay alone, however few pieces a group may leave."""
    rows = [(k, "word " * 70) for k in range(200)]
    got = best_fit.pack(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(40), PATH, limit=128, keep=3).collect()
    assert check(got, [(k, plain_ids(t)) for k, t in rows], 128) == 200


def test_empty_table_and_reruns(spark, rows):
    df = spark.createDataFrame([(i, t, 9, "x", "y", "z") for i, t in rows], SCHEMA).repartition(7)
    assert best_fit.pack(df.limit(0), PATH).count() == 0
    a, b = (sorted(map(repr, best_fit.pack(df, PATH, limit=128).collect())) for _ in range(2))
    assert a == b


def test_best_fit_takes_the_least_room():
    assert sorted(sorted(held) for _, held in best_fit.best_fit([6, 5, 4, 3, 2], 10)) == [[0, 2], [1, 3, 4]]
    rng = random.Random(7)
    for _ in range(200):
        sizes = [rng.randint(1, 40) for _ in range(rng.randint(1, 60))]
        bins: list[list[int]] = []
        for s in sorted(sizes, reverse=True):
            fits = [b for b in bins if sum(b) + s <= 40]
            max(fits, key=sum).append(s) if fits else bins.append([s])
        got = best_fit.best_fit(sizes, 40)
        assert sorted(sum(sizes[k] for k in held) for _, held in got) == sorted(map(sum, bins))
        assert all(room == 40 - sum(sizes[k] for k in held) for room, held in got)


def test_whole_table(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    ids = [(r["doc_id"], plain_ids(r["text"])) for r in docs]
    got = best_fit.pack(spark.read.parquet(f"{data}/documents.parquet"), PATH).collect()
    assert check(got, ids, best_fit.LIMIT) <= best_fit_at_once(ids, best_fit.LIMIT)
