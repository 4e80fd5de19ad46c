"""Each operator against a brute-force version on a small fixture that holds the odd cases."""

import base64
import hashlib
import json
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash

from loomgraph.llm import html_extract, iblt, mixing, packing, pu_quality, rule_ledger, shards, simhash, toxicity, unigram_count

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, _text string, size bigint, copies int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def rows():
    """Nulls in any column, empty and long texts, ties, repeated rows, clashing names."""
    rng = random.Random(5)
    words = ["alpha", "Beta", "gamma.", "delta,", "é", "ñu", "the", "of", "x", "***", "THE", "a|b"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(40)]
    texts += [t + " tail" for t in texts[:8]] + ["one two three four five six seven eight nine ten\n" * 3, "", None, " \n\t ", "long " * 9000, "same same", "same same", "tab\tand\x0bvt", "a\n\nb\na", "🙂 ok"]
    out = [(k, t, "en" if k % 3 else None, None if k % 7 == 0 else f"s{k % 4}", len(t or "") or None, "clash", k, None) for k, t in enumerate(texts)]
    out += [out[3], out[3], (None, "null id text here", None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def plain_fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[k : k + 4]).encode(), 42) for k in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(points, radius=4):
    names = {p: p for p in points}

    def root(x):
        while names[x] != x:
            x = names[x]
        return x

    points = list(points)
    for i, a in enumerate(points):
        for b in points[:i]:
            if (a ^ b).bit_count() <= radius:
                x, y = root(a), root(b)
                names[max(x, y)] = min(x, y)
    return {p: root(p) for p in points}


def test_simhash_matches_brute_force(docs, rows, empty):
    got = simhash.near_duplicates(docs).select("doc_id", simhash.hex_fingerprint(simhash.F.col("fp")).alias("f"), "component_id").collect()
    assert len(got) == len(rows)
    prints = [(r[0], plain_fingerprint(r[1])) for r in rows]
    assert Counter((r["doc_id"], r["f"]) for r in got) == Counter((i, f"{f:016x}") for i, f in prints)
    root = plain_components({f for _, f in prints})
    least = {}
    for i, f in prints:
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    assert all(r["component_id"] == least.get(root[int(r["f"], 16)]) for r in got)
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({root[f] for _, f in prints})


def test_an_id_with_two_texts_keeps_a_row_in_each_component(spark):
    rng = random.Random(12)
    a, b, c, d = (" ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(40)) for _ in range(4))
    held = [(0, a), (1, a), (1, b), (5, c), (5, d), (7, c), (7, c), (None, d), (None, None), (9, "")]
    for rows in (held, held + [(5, c)], held[::-1]):
        kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()
        assert sorted((r["doc_id"], r["text"]) for r in kept) == sorted([(0, a), (1, b), (5, c), (5, d), (9, "")])


def test_a_component_of_repeated_ids_keeps_one_row(spark):
    rng = random.Random(13)
    x, y, z = (" ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(40)) for _ in range(3))
    held = [(5, x), (7, x), (7, y), (9, y), (11, z), (11, z + " " + y)]
    kept = sorted((r["doc_id"], r["text"]) for r in simhash.keep_one(spark.createDataFrame(held, "doc_id bigint, text string").repartition(3)).collect())
    prints = {t: plain_fingerprint(t) for _, t in held}
    root = plain_components(set(prints.values()))
    assert kept == sorted({root[prints[t]]: (i, t) for i, t in sorted(held, reverse=True)}.values())


CLASHING = "doc_id bigint, text string, lang string, source string, n_words string, failures string, score string, role int, _id bigint, id bigint, body string, _row string, row string, key string, _copies int, copies string, name string, size string, label int, tie string"


def test_stages_keep_clashing_columns(spark, rows):
    held = [(r[0], r[1], r[2], r[3], *[f"v{r[0]}" for _ in range(3)], 1, 2, r[0], "b", "r", "s", "k", 5, "c", "n", "z", 0, "t") for r in rows]
    df = spark.createDataFrame(held, CLASHING).repartition(3)
    some = spark.createDataFrame([(k, k % 2, int(k % 3 == 0)) for k in range(40)], "doc_id bigint, quality int, toxic int")
    whole = Counter(map(tuple, df.collect()))
    for out in (rule_ledger.keep(df), pu_quality.keep(df, some), simhash.keep_one(df), mixing.mixed(df)):
        assert out.columns == df.columns
        got = Counter(map(tuple, out.collect()))
        assert got and set(got) <= set(whole)
    assert pu_quality.classify(df, some).count() == toxicity.classify(df, some).count() == len(rows)
    assert mixing.mix(df).count() == shards.shard(df).count() == iblt.compare_with_edits(df).count() == len(rows)


def test_hubs_are_joined_aside(spark):
    """A star of very many points, chains into it, and points of their own."""
    pairs = [(0, k) for k in range(1, 2000)] + [(k, k + 5000) for k in range(1, 500)] + [(20000 + k, 20000) for k in range(1, 300)] + [(30000 + k, 30001 + k) for k in range(50)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    want = {k: 0 for k in range(2000)} | {k + 5000: 0 for k in range(1, 500)} | {20000 + k: 20000 for k in range(300)} | {30000 + k: 30000 for k in range(51)}
    assert got == want


def test_grids_grow_with_the_points():
    assert [simhash.grid(10**k) for k in (3, 6, 7, 8, 9, 10, 12)] == [7, 7, 8, 9, 10, 12, 12]
    assert len(simhash._masks(7)) == 35 and len(simhash._masks(8)) == 70 and all(m.bit_count() >= 24 for m in simhash._masks(7) if m >= 0)


@pytest.mark.parametrize("groups", [7, 9])
def test_simhash_links_every_component_of_planted_fingerprints(spark, groups):
    rng = random.Random(1)
    points = set()
    for _ in range(60):
        at = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            points.add(at)
            for _ in range(rng.randint(1, 5)):
                at ^= 1 << rng.randrange(64)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(p),) for p in points], "fp bigint")
    edges = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in simhash.links(df, groups=groups).collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in edges)
    want = plain_components(points)
    got = {r["node"] % (1 << 64): r["root"] for r in simhash.components(simhash.links(df, groups=groups)).collect()}
    groups = defaultdict(set)
    for p in points:
        groups[want[p]].add(got.get(p, signed(p)))
    assert all(len(g) == 1 for g in groups.values()) and len(set.union(*groups.values())) == len(groups)


def test_simhash_cells_of_any_size(monkeypatch):
    """Small cells, cells across batches, and cells dealt again in blocks give the same components."""
    monkeypatch.setattr(simhash, "SMALL", 3)
    monkeypatch.setattr(simhash, "CELL", 10)
    rng = random.Random(2)
    cells = {c: {rng.getrandbits(6) | c << 20 for _ in range(n)} for c, n in ((1, 2), (2, 7), (3, 60), (4, 1), (5, 30))}
    flat = [(0, c, p) for c in sorted(cells) for p in cells[c]]
    batch = lambda part: pa.RecordBatch.from_arrays([pa.array([x[0] for x in part], pa.int32()), pa.array([x[1] for x in part], pa.int64()), pa.array([x[2] for x in part], pa.int64())], names=["combo", "cell", "fp"])
    out = [r for b in simhash._cells(2)(batch(flat[k : k + 7]) for k in range(0, len(flat), 7)) for r in b.to_pylist()]
    edges = [(r["a"], r["b"]) for r in out if r["kind"] == 0]
    pairs = sorted({(r["combo"], r["cell"], min(r["block"], o), max(r["block"], o), r["block"], r["a"]) for r in out if r["kind"] == 1 for o in range(r["blocks"])})
    assert {x[1] for x in pairs} == {3, 5}
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
    blocks = pa.RecordBatch.from_arrays([pa.array([x[k] for x in pairs], t) for k, t in enumerate(kinds)], names=list("abcdef"))
    edges += [(r["a"], r["b"]) for b in simhash._block_pairs(2)(iter([blocks.slice(0, 11), blocks.slice(11)])) for r in b.to_pylist()]
    forest = {p: p for c in cells.values() for p in c}
    for a, b in edges:
        assert (a ^ b).bit_count() <= 2
        ra, rb = a, b
        while forest[ra] != ra:
            ra = forest[ra]
        while forest[rb] != rb:
            rb = forest[rb]
        forest[max(ra, rb)] = min(ra, rb)
    for c in cells.values():
        want = plain_components(c, 2)
        for p in c:
            r = p
            while forest[r] != r:
                r = forest[r]
            assert r == want[p]


PATH = public_tokenizers.path("word_bpe_49k.json")


def check_packing(got, texts_by_row, limit=2048):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(PATH)
    by_sequence = defaultdict(list)
    for r in got:
        by_sequence[r["sequence_id"]].append(r)
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= limit and (at == limit or at & (at - 1) == 0), at
        assert len(parts) <= packing.SEGMENTS
    total = sum(len(own.encode(t or "", add_special_tokens=False).ids) + 1 for t in texts_by_row)
    assert sum(r["length"] for r in got) == total
    return own


def test_packing_round_trip(docs, rows, empty):
    got = packing.pack(docs, PATH).collect()
    own = check_packing(got, [r[1] for r in rows])
    ids = {r[0]: own.encode(r[1] or "", add_special_tokens=False).ids + [1] for r in rows if r[0] is not None and [x[0] for x in rows].count(r[0]) == 1}
    for i, want in ids.items():
        parts = sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["start"])
        assert [r["start"] for r in parts] == [sum(p["length"] for p in parts[:k]) for k in range(len(parts))]
        for r in parts:
            assert r["ids_crc32"] == zlib.crc32(np.array(want[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) and r["doc_tokens"] == len(want)
    assert packing.pack(empty, PATH).count() == 0


def test_packing_keeps_all_three_limits(spark):
    rng = random.Random(3)
    packer = packing.Packer(limit=64, segments=3, loss=20, open_bins=4)
    lengths = [rng.randint(1, 150) for _ in range(400)]
    losses = [rng.randint(0, n) for n in lengths]
    done = []
    for k, (n, loss) in enumerate(zip(lengths, losses)):
        done += list(packer.add(k, 0, n, loss))
    done += list(packer.end())
    seen = Counter()
    loss_seen = Counter()
    for _, parts in done:
        assert sum(p[2] for p in parts) <= 64 and len(parts) <= 3 and sum(p[3] for p in parts) <= 20
        for key, start, length, loss in parts:
            seen[key] += length
            loss_seen[key] += loss
    assert [seen[k] for k in range(400)] == lengths and [loss_seen[k] for k in range(400)] == losses
    assert len({s for s, _ in done}) == len(done)


def test_short_texts_are_packed_without_padding(spark):
    df = spark.range(3000).selectExpr("id as doc_id", "'one two' as text")
    got = packing.pack(df, PATH).collect()
    check_packing(got, ["one two"] * 3000)
    sizes = Counter()
    for r in got:
        sizes[r["sequence_id"]] += r["length"]
    padded = sum(0 if n & (n - 1) == 0 else 2048 - n for n in sizes.values())
    assert padded <= 0.05 * sum(sizes.values())
    pieces = Counter(r["sequence_id"] for r in got)
    assert max(pieces.values()) <= packing.SEGMENTS


def test_prompts_make_the_third_limit_bind(spark):
    rng = random.Random(4)
    held = [(k, "one two three four five six seven " * rng.randint(1, 40), rng.choice([None, 0, 5, 10_000])) for k in range(300)]
    df = spark.createDataFrame(held, "doc_id bigint, text string, prompt int").repartition(2)
    loss = {}
    got = packing.pack(df, PATH, loss_limit=300, prompt_tokens="prompt").collect()
    own = check_packing(got, [t for _, t, _ in held])
    whole = Counter()
    for r in got:
        loss[r["sequence_id"]] = loss.get(r["sequence_id"], 0) + r["loss_tokens"]
        whole[r["doc_id"]] += r["loss_tokens"]
    assert 200 < max(loss.values()) <= 300
    for k, t, prompt in held:
        n = len(own.encode(t, add_special_tokens=False).ids) + 1
        assert whole[k] == n - min(n, prompt or 0)


def test_word_tokenizer_is_exact():
    raw = open(PATH, "rb").read()
    words = packing.WordTokenizer(raw)
    texts = ["İstanbul ΣΑΣ ß ﬁ x\x1cy", "a­b", "it's I'M don't we'Re 12ab3 _a_ $5.00 <|endoftext|> ok", "é ŉ ǆ ẞ", "\x85a\xa0b c　d", "", "١٢ 漢字 🙂🙂 a🙂", "'S'T''LL", "…—–“q”", "Tab\there\nand \x0b\x0c", "l'été n'est—pas FINI!"]
    assert words.ids(texts) == words.encode(texts)
    shape = json.loads(raw)["model"]
    # what makes merging by result the same as merging by pair
    assert len({a + b for a, b in shape["merges"]}) == len(shape["merges"])
    own = words.tokenizer.model
    ends = [t for t in shape["vocab"] if t.endswith("</w>")][::37]
    assert all([x.id for x in own.tokenize(t[:-4])] == [shape["vocab"][t]] for t in ends)


def plain_measures(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    counts = Counter(windows)
    covered = {k + j for k, w in enumerate(windows) if counts[w] > 1 for j in range(5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_rules_match_brute_force(docs, rows, empty):
    got = rule_ledger.quality_report(docs).collect()
    want = Counter((r[0], *plain_measures(r[1])) for r in rows)
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got) == want
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert r["kept"] == (not r["base_failed"] and not r["failures"] & rule_ledger.POLICIES[rule_ledger.CURRENT])
    table = {r["rule"]: r for r in rule_ledger.ablation(rule_ledger.ledger(docs)).collect()}
    for name, bit in rule_ledger.BIT.items():
        assert table[name]["fails"] == sum(bool(r["failures"] & bit) for r in got)
        assert table[name]["fails_alone"] == sum(r["failures"] == bit for r in got)
        assert table[name]["kept_without"] == sum(r["failures"] & ~bit == 0 for r in got)
    assert rule_ledger.quality_report(empty).count() == 0
    assert rule_ledger.keep(docs).columns == docs.columns


def plain_shards(rows, shards, share):
    """(id, size, crc, shard) by the law: rows in order of their text's hash, groups by their middle."""
    held = [(xxhash.xxh64_intdigest((t or "").encode(), 42), zlib.crc32((t or "").encode()), i, len((t or "").encode()) + 8) for i, t in rows]
    held = [(h - (1 << 64) if h >> 63 else h, c, i, n) for h, c, i, n in held]
    total, groups = sum(x[3] for x in held), Counter()
    for h, c, _, n in held:
        groups[h, c] += n
    out, before, row_before = [], {}, {}
    at = 0
    for key in sorted(groups):
        before[key] = row_before[key] = at
        at += groups[key]
    for h, c, i, n in sorted(held, key=lambda x: (x[0], x[1], x[2] is not None, x[2] or 0)):
        if groups[h, c] <= int(total * (share / shards)):
            middle = 2 * before[h, c] + groups[h, c]
        else:
            middle = 2 * row_before[h, c] + n
            row_before[h, c] += n
        out.append((i, n, c, min(shards - 1, middle * shards // (2 * total))))
    return out


@pytest.mark.parametrize("share", [0.02, 0.5, 2.0])
def test_shards_match_brute_force(docs, rows, empty, share):
    got = [r.asDict() for r in shards.shard(docs, 6, group_share=share).collect()]
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["shard"]) for r in got) == Counter(plain_shards([r[:2] for r in rows], 6, share))
    for s in {r["shard"] for r in got}:
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert {r["law"] for r in got} == {"bytes"} and {r["grown_shard"] for r in got} == {None}
    assert shards.shard(empty).count() == 0


def test_a_hot_text_is_dealt_over_shards_and_others_stay_together(spark):
    rng = random.Random(9)
    held = [(None, "hot text")] * 3000 + [(k, "".join(rng.choice("abcdef") for _ in range(rng.randint(1, 30)))) for k in range(3000)] + [(k, f"copies {k % 300}") for k in range(900)]
    got = shards.shard(spark.createDataFrame(held, "doc_id bigint, text string").repartition(7)).collect()
    sizes, groups, copies = Counter(), defaultdict(set), Counter()
    for r in got:
        sizes[r["shard"]] += r["size"]
        groups[r["text_crc32"]].add(r["shard"])
        copies[r["text_crc32"]] += 1
    assert len(got) == len(held) and max(sizes.values()) - min(sizes.values()) < 0.05 * sum(sizes.values()) / 24
    assert len(groups.pop(zlib.crc32(b"hot text"))) > 5
    assert all(len(where) == 1 for where in groups.values())


def test_shard_sizes_are_near_equal(spark):
    df = spark.range(5000).selectExpr("id as doc_id", "repeat('x', cast(id % 97 as int)) as text")
    sizes = Counter()
    for r in shards.shard(df).collect():
        sizes[r["shard"]] += r["size"]
    assert len(sizes) == 24 and max(sizes.values()) - min(sizes.values()) <= 2 * 105


PARAGRAPH = re.compile(iblt.PARAGRAPH)
hash42 = lambda t: xxhash.xxh64_intdigest(t.encode(), 42) >> 1


def test_sketches_match_brute_force(docs, rows, empty):
    got = iblt.compare_with_edits(docs).collect()
    assert len(got) == len(rows)
    order = sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, hash42(r[1]), r[1]))
    bag = lambda t: Counter(PARAGRAPH.findall(t))

    def likeness(a, b):
        a, b = bag(a), bag(b)
        union = sum((a | b).values())
        return round(sum((a & b).values()) / union, 9) if union else 1.0

    want = Counter()
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        want[(i, len(t), hashlib.sha256(edited.encode()).hexdigest(), likeness(t, edited), likeness(t, after))] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in got) == want
    assert iblt.compare_with_edits(empty).count() == 0


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def spark_hash(key, then):
    """What xxhash64 gives for a long and an int after it."""
    return signed(xxhash.xxh64_intdigest(then.to_bytes(4, "little"), xxhash.xxh64_intdigest((key % (1 << 64)).to_bytes(8, "little"), 42)))


def read_fingerprint(text):
    raw = base64.b64decode(text)
    cells = {}
    for at in range(2, len(raw), 18):
        part = raw[at : at + 18]
        cells[int.from_bytes(part[:2], "big")] = (int.from_bytes(part[2:6], "big"), signed(int.from_bytes(part[6:14], "big")), int.from_bytes(part[14:], "big"))
    return int.from_bytes(raw[:2], "big"), cells


def plain_peel(m, left, right):
    """Digests only in left and only in right, from two fingerprints of width m; None where peeling stops short."""
    diff = {}
    for k in {*left, *right}:
        a, b = left.get(k, (0, 0, 0)), right.get(k, (0, 0, 0))
        diff[k] = [a[0] - b[0], a[1] ^ b[1], a[2] ^ b[2]]
    found = {1: set(), -1: set()}
    while True:
        pure = next(((k, v) for k, v in diff.items() if abs(v[0]) == 1 and spark_hash(v[1], 7) & 0xFFFFFFFF == v[2]), None)
        if pure is None:
            return None if any(any(v) for v in diff.values()) else found
        n, key, check = pure[1]
        found[n].add(key)
        for t in range(3):
            cell = diff[t * m + spark_hash(key, 11 + t) % m]
            cell[0], cell[1], cell[2] = cell[0] - n, cell[1] ^ key, cell[2] ^ check


def test_fingerprints_of_equal_width_tell_the_likeness(spark):
    rng = random.Random(7)
    words = ["red", "and", "blue.", "a", "big", "house!", "stood", "near.", "the", "sea"]
    texts = ["\n".join(" ".join(rng.choice(words) for _ in range(30)) for _ in range(rng.randint(4, 9))) for _ in range(30)]
    held = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    seen = 0
    for r in iblt.compare_with_edits(held).collect():
        (m, a), (n, b) = read_fingerprint(r["fingerprint"]), read_fingerprint(r["edited_fingerprint"])
        size = sum(v[0] for v in a.values()) // 3
        assert size == len(PARAGRAPH.findall(texts[r["doc_id"]]))
        if m == n and (found := plain_peel(m, a, b)) is not None:
            seen += 1
            assert abs((size - len(found[1])) / (size + len(found[-1])) - r["near_edited"]) < 1e-9
    assert seen > 20


def test_an_insertion_moves_no_later_cut():
    rng = random.Random(3)
    line = " ".join("".join(rng.choice("abcdeilmnorst") for _ in range(rng.randint(2, 8))) + rng.choice(["", "", "", "", "."]) for _ in range(3000))
    before, after = PARAGRAPH.findall(line), PARAGRAPH.findall(line[:200] + " put in here" + line[200:])
    assert len(before) > 100 and len(set(before) ^ set(after)) <= 6 and "".join(before) == line


def test_repeated_and_null_ids_are_dealt_over_ranges(spark):
    rng = random.Random(11)
    held = [(None, f"n {rng.random()}") for _ in range(400)] + [(7, f"s {rng.random()}") for _ in range(500)] + [(k, f"o {k}") for k in range(300)]
    df = spark.createDataFrame(held, "id bigint, body string").withColumn("tie", iblt.F.shiftrightunsigned(iblt.F.xxhash64("body"), 1))
    got = df.withColumn("range", iblt.ranges(df, "id", "tie", 12)).collect()
    order = sorted(got, key=lambda r: (r["id"] is not None, r["id"] or 0, r["tie"]))
    numbers = [r["range"] for r in order]
    assert numbers == sorted(numbers) and max(Counter(numbers).values()) < 300 and len(set(numbers)) >= 8
    rows = iblt.with_next(df.select(iblt.F.col("id").alias("doc_id"), iblt.F.col("body").alias("text")), range_rows=100).collect()
    want = [(r["id"], r["body"], order[(k + 1) % len(order)]["body"]) for k, r in enumerate(order)]
    assert Counter((r["id"], r["body"], r["next"]) for r in rows) == Counter(want)


def test_equal_texts_have_equal_sketches(spark):
    df = spark.createDataFrame([(1, "a b c\nd"), (2, "a b c\nd"), (3, "other")], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in iblt.compare_with_edits(df).collect()}
    assert got[1]["fingerprint"] == got[2]["fingerprint"] != got[3]["fingerprint"]
    assert got[1]["near_next"] == 1.0 and got[3]["near_next"] == 0.0


def test_mix_invariants(spark, docs, rows, empty):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    size = Counter()
    for r in rows:
        size[r[3]] += len(WORD.findall(r[1] or ""))
    due = mixing.targets(list(size.items()))
    assert abs(sum(due.values()) - 1.5 * sum(size.values())) < 1e-6
    assert all(due[s] <= 2 * size[s] + 1e-9 for s in due)
    taken = Counter()
    for r in got:
        assert r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"] and r["source_size"] == size[r["source"]] and abs(r["target"] - due[r["source"]]) < 1e-6
        taken[r["source"]] += r["taken"]
    again = Counter(map(tuple, mixing.mix(docs.repartition(5)).collect()))
    assert again == Counter(map(tuple, got))
    assert mixing.mix(empty).count() == 0
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns


def test_mix_meets_targets_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP", 50)
    monkeypatch.setattr(mixing, "FAN_IN", 4)
    df = spark.range(6000).selectExpr("id as doc_id", "repeat('w ', cast(1 + id % 40 as int)) as text", "case when id % 3 = 0 then 'hot' else concat('s', id % 5) end as source")
    got = mixing.mix(df).collect()
    taken, target = Counter(), {}
    for r in got:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 41 for s in target), (taken, target)


def test_targets_match_a_plain_water_level():
    """The level that the weights raise, source by source, until the share is poured; a source takes no more than twice its size."""
    rng = random.Random(9)
    for _ in range(200):
        sizes = [(name, rng.choice([0, 1, 5, 40, 300, 9000])) for name in ["a", "b", "c", "d", None, "é", "Z"][: rng.randint(1, 7)]]
        got = mixing.targets(sizes)
        order = sorted((n for n, _ in sizes), key=lambda n: (n is None, n or ""))
        weight = {n: (5, 2, 1)[k % 3] for k, n in enumerate(order)}
        size, total = dict(sizes), sum(n for _, n in sizes)
        low, high = 0.0, 1e6
        for _ in range(200):
            level = (low + high) / 2
            poured = sum(min(2 * size[n], level * weight[n]) for n in size)
            low, high = (level, high) if poured < 1.5 * total else (low, level)
        want = {n: min(2 * size[n], high * weight[n]) for n in size}
        assert all(abs(got[n] - want[n]) < 1e-3 * max(1, total) for n in size), (sizes, got, want)


def test_mix_meets_targets_beside_long_texts(spark):
    held = [(k, "w " * n, "a") for k, n in enumerate([9000, 700, 650, 300, *[20] * 200, *[1] * 40])] + [(1000 + k, "w " * n, "b") for k, n in enumerate([40, 30, 20, 10])] + [(2000, "w " * 500, None)]
    got = mixing.mix(spark.createDataFrame(held, "doc_id bigint, text string, source string")).collect()
    taken, target = Counter(), {}
    for r in got:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert r["taken"] in (0, r["size"], 2 * r["size"])
    assert abs(taken["a"] - target["a"]) <= 20 and abs(taken["b"] - target["b"]) <= 20


def test_settled_copies_leave_room_and_keep_expectations():
    rng = random.Random(2)
    sums = Counter()
    for seed in range(4000):
        copies = mixing.settle([(30, 0), (20, 1), (25, 2)], 175, 1.3 * 175, 2.0, str(seed))
        assert all(c in (0, 1, 2) for c in copies)
        for k, c in enumerate(copies):
            sums[k] += c
    assert all(abs(sums[k] / 4000 - 1.3) < 0.05 for k in range(3))
    for _ in range(300):
        sizes = [rng.randint(1, 100) for _ in range(rng.randint(1, 6))]
        rest = rng.randint(0, 100)
        total = sum(sizes) + rest
        due = rng.random() * 2 * total
        copies = mixing.settle([(s, k) for k, s in enumerate(sizes)], total, due, 2.0, str(due))
        got = sum(c * s for c, s in zip(copies, sizes))
        # the best that any choice of copies leaves to the short ones, but for the greedy order
        miss = max(0.0, got - due, due - got - 2 * rest)
        assert miss <= min(sizes) / 2 + max(0, max(sizes) - 2 * (total - max(sizes))) + max(sizes) / 2


def test_pivotal_keeps_expectations():
    hits = Counter()
    for seed in range(3000):
        rows = [[3, 0.2], [5, 0.7], [2, 0.5], [4, 0.35]]
        mixing.pivotal(rows, str(seed))
        assert sum(0 < r[1] < 1 for r in rows) <= 1
        assert abs(sum(r[0] * r[1] for r in rows) - (0.6 + 3.5 + 1 + 1.4)) < 1e-6
        for k, r in enumerate(rows):
            hits[k] += r[1]
    assert all(abs(hits[k] / 3000 - p) < 0.03 for k, p in enumerate([0.2, 0.7, 0.5, 0.35]))


PIECES = public_tokenizers.path("piece_bpe_32k.model")


def test_counts_match_the_tokenizer(docs, rows, empty):
    from tokenizers import Tokenizer, models, pre_tokenizers

    pieces = unigram_count.read_pieces(open(PIECES, "rb").read())
    low = min(s for _, s, k in pieces if k == 1)
    vocab = [(p if k in (1, 2, 6) else "\0" + p, s if k == 1 else low) for p, s, k in pieces]
    own = Tokenizer(models.Unigram(vocab, 0, True))
    own.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=False)
    got = Counter((r["doc_id"], r["n_tokens"]) for r in unigram_count.count_tokens(docs, PIECES).collect())
    short = [r for r in rows if len(r[1] or "") < 2000]
    want = Counter((r[0], len(own.encode(r[1] or "", add_special_tokens=False).ids)) for r in short)
    assert all(got[k] == n for k, n in want.items()) and sum(got.values()) == len(rows)
    assert unigram_count.count_tokens(empty, PIECES).count() == 0


def test_viterbi_is_the_best_path():
    pieces = [("a", -1.0, 1), ("b", -1.5, 1), ("ab", -2.5, 1), ("ba", -2.0, 1), ("aba", -3.5, 1), ("▁", -1.0, 1), ("<unk>", 0.0, 2)]
    counter = unigram_count.Counter(pieces)
    vocab = {p: s for p, s, k in pieces if k == 1}

    def best(text):
        if not text:
            return 0.0
        options = [vocab[text[:k]] + best(text[k:]) for k in range(1, len(text) + 1) if text[:k] in vocab]
        if text[0] not in vocab:
            options.append(min(vocab.values()) - 10 + best(text[1:]))
        return max(options)

    rng = random.Random(4)
    for _ in range(200):
        text = "".join(rng.choice("abc▁") for _ in range(rng.randint(1, 9)))
        assert abs(counter.viterbi(text)[0] - best(text)) < 1e-9


def test_html_rules(spark):
    page = (
        '<html><head><title>t</title><script>var x="</p>";</script></head><body><nav><a href="/">Home</a></nav><div class="cookie-notice">We use cookies and the like of it on all the pages that you see.</div>'
        '<div class="content with-sidebar"><h1>Title &amp; more</h1><p><b>First of the lines that is in the text, and it is long enough to be judged as good by the rules for the length of it and the words in it.<br><p>Short one.</p>'
        "<p>Second of the lines that is in the text, and it is long enough to be judged as good by the rules for the length of it and the words in it.</p></div>"
        '<div id="comments"><p>I think that this is one of the best of all the things that I have read in the last of the years, and it is so for you.</p></div><form><p>Your name and the like</p></form><footer>&copy; us</footer></body></html>'
    )
    want = ["Title & more", "First of the lines that is in the text, and it is long enough to be judged as good by the rules for the length of it and the words in it.", "Short one.", "Second of the lines that is in the text, and it is long enough to be judged as good by the rules for the length of it and the words in it."]
    assert html_extract.extract(page).split("\n") == want
    assert html_extract.extract("<article><h1>A&lt;b&gt;</h1><p>x\n y &#233;<aside>no</aside></article><p>out</p>") == "A<b>\nx y é"
    df = spark.createDataFrame([(1, "u", None, 9), (2, None, "", 9), (3, "v", page, 9), (3, "v", page, 9), (4, "w", "<p>a<!-- b", 9)], "page_id bigint, url string, html string, text int")
    got = sorted((r["page_id"], r["url"] or "", r["text"], r["n_chars"]) for r in html_extract.main_text(df).collect())
    joined = "\n".join(want)
    assert got == [(1, "u", "", 0), (2, "", "", 0), (3, "v", joined, len(joined)), (3, "v", joined, len(joined)), (4, "w", "a", 1)]


def plain_second_pass(labels, headings, parents):
    """The nearest decided neighbours by search."""
    good, bad, open_, near = html_extract.GOOD, html_extract.BAD, html_extract.OPEN, html_extract.NEAR_GOOD
    decided = [k for k, x in enumerate(labels) if x in (good, bad)]
    out = []
    for k, x in enumerate(labels):
        if x not in (open_, near):
            out.append(good if x == good else bad)
            continue
        left, right = max((m for m in decided if m < k), default=-1), min((m for m in decided if m > k), default=len(labels))
        at = lambda m: labels[m] if 0 <= m < len(labels) else bad
        if not decided or any(0 <= m < len(labels) and labels[m] == good and parents[m] == parents[k] for m in (left, right)):
            out.append(good)
        elif at(left) == at(right):
            out.append(at(left))
        elif x == near:
            out.append(good)
        elif headings[k]:
            out.append(at(right))
        else:
            out.append(bad if k - left == right - k else at(left) if k - left < right - k else at(right))
    return out


def test_second_pass_matches_brute_force():
    rng = random.Random(1)
    for _ in range(3000):
        n = rng.randint(0, 9)
        labels = [rng.choice([0, 1, -1, 2, None, -1]) for _ in range(n)]
        headings, parents = [rng.random() < 0.2 for _ in range(n)], [rng.randint(0, 3) for _ in range(n)]
        assert html_extract.second_pass(labels, headings, parents) == plain_second_pass(labels, headings, parents)


def test_generated_pages_give_back_their_articles(spark):
    """Pages built of known parts, against the parts they were built of."""
    rng = random.Random(2)
    words = "the of and to in a is that it was house river stone winter morning letter garden bridge window market".split()
    sentence = lambda n: " ".join(rng.choice(words) for _ in range(n)) + "."
    held, want = [], {}
    for k in range(40):
        paragraphs = [sentence(rng.randint(40, 90)) for _ in range(rng.randint(2, 6))]
        title = sentence(5)
        menu = "".join(f'<li><a href="/{j}">{rng.choice(words)}</a></li>' for j in range(8))
        wrap = rng.choice(["<article>{}</article>", '<div class="content">{}</div>', "<main><section>{}</section></main>"])
        body = f"<h1>{title}</h1>" + "".join(f"<p>{p.replace('and', 'a&#110;d')}</p>" for p in paragraphs)
        extra = f'<aside class="sidebar"><p>{sentence(50)}</p></aside><div class="ad-banner">{sentence(20)}</div><div id="comments"><p>{sentence(60)}</p></div><form><p>{sentence(30)}</p></form>'
        held.append((k, f"u{k}", f"<html><head><style>p{{}}</style><script>var a='<p>';</script></head><body><header><ul>{menu}</ul></header><nav>{menu}</nav>{wrap.format(body)}{extra}<footer>{sentence(12)}</footer></body></html>"))
        want[k] = "\n".join([title, *paragraphs])
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_extract.main_text(spark.createDataFrame(held, "page_id bigint, url string, html string")).collect()}
    assert got == {k: (t, len(t)) for k, t in want.items()}


def test_deep_and_broken_pages_take_linear_time():
    for page in ("<div>" * 60_000 + "text" + "</b>" * 60_000, "<b>x" * 60_000, "<textarea>a" * 60_000, '<a href="x' * 60_000, "</div>" * 60_000 + "<li>" * 60_000):
        began = time.perf_counter()
        html_extract.extract(page)
        assert time.perf_counter() - began < 5


def test_an_empty_table_of_pages(spark):
    assert html_extract.main_text(spark.createDataFrame([], "page_id bigint, url string, html string, text int, n_chars int")).count() == 0


def test_second_pass_takes_the_nearest_label():
    g, b, o, n = html_extract.GOOD, html_extract.BAD, html_extract.OPEN, html_extract.NEAR_GOOD
    assert html_extract.second_pass([g, o, o, b], [False] * 4) == [g, g, b, b]
    assert html_extract.second_pass([b, n, g], [False] * 3) == [b, g, g]
    assert html_extract.second_pass([b, o, g], [False, True, False]) == [b, g, g]
    assert html_extract.second_pass([b, o, b], [False] * 3) == [b, b, b]


@pytest.fixture(scope="module")
def labelled(spark):
    read = lambda t: spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet")
    return read("documents"), read("labels")


def test_quality_on_held_out_rows(labelled):
    docs, labels = labelled
    got = pu_quality.classify(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in got)
    assert sum(r["predicted"] == r["quality"] for r in held) >= 0.95 * len(held)


def test_toxicity_on_held_out_rows(labelled):
    docs, labels = labelled
    got = [r for r in toxicity.classify(docs, labels).join(labels, "doc_id").collect() if r["held_out"]]
    assert sum(r["predicted"] == r["toxic"] for r in got) >= 0.85 * len(got)


def test_only_copies_within_a_label_count_once(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    # unrelated texts that share common words, one word among many, and texts that are copies
    texts = [" ".join(["the", "of", "and", *[word() for _ in range(30)]]) for _ in range(80)]
    held = [(k, t, k % 2) for k, t in enumerate(texts)] + [(100, texts[0], 0), (101, texts[0], 1), (102, "  " + texts[2].replace(" ", "\n"), 0), (103, "so what", 0), (104, "what so", 0), (105, "so what", 0), (106, "", 1), (107, None, 1)]
    df = spark.createDataFrame(held, "doc_id bigint, text string, label int")
    for parts in (1, 5):
        got = toxicity.without_copies(df.repartition(parts))
        assert got.columns == df.columns
        assert sorted(r["doc_id"] for r in got.collect()) == [*range(80), 101, 103, 104, 106]


def test_a_bounded_sample_keeps_the_true_rate(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choice("red green blue some other word you".split()) for _ in range(30)) for _ in range(3000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, int(k % 10 == 3)) for k in range(3000)], "doc_id bigint, toxic int")
    # the texts tell nothing, so the mean score is the rate
    scores = [r["score"] for r in toxicity.score(docs, toxicity.fit(docs, labels, sample=120)).collect()]
    assert 0.05 < sum(scores) / len(scores) < 0.2
    x, y = np.array([1.0, 2.0, 3.0]), np.array([1.0, 0.0, 1.0])
    twice = toxicity.Isotonic(np.array([1.0, 2.0, 2.0, 3.0]), np.array([1.0, 0.0, 0.0, 1.0]))
    assert np.allclose(toxicity.Isotonic(x, y, np.array([1.0, 2.0, 1.0]))([1.5, 3.0]), twice([1.5, 3.0]))


def test_classifiers_take_odd_rows(spark, docs, empty, rows):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    some = spark.createDataFrame([(k, k % 2, None if k % 5 == 0 else int(k % 3 == 0)) for k in range(40)] + [(None, 1, 1)], "doc_id bigint, quality int, toxic int")
    for module in (pu_quality, toxicity):
        assert module.classify(empty, none).count() == 0
        assert module.classify(docs, none).count() == len(rows)
        assert module.classify(docs, some).count() == len(rows)


def test_features_see_through_obfuscation():
    f = toxicity.Features({"idiot": 5.0, "loser": 4.0})
    assert f("you are an idiot")[0] > 0 and f("you are an idiot")[5] > 0
    assert f("such an 1d10t here")[13] > 0 and f("what a l o s e r !")[13] > 0 and f("a lo*ser")[13] > 0
    assert f("nothing to see")[13] == 0 == f("nothing to see")[0]


def test_scores_do_not_depend_on_partitions(labelled):
    docs, labels = labelled
    for module in (pu_quality, toxicity):
        one = {r["doc_id"]: r["score"] for r in module.classify(docs, labels).collect()}
        two = {r["doc_id"]: r["score"] for r in module.classify(docs.repartition(7), labels.repartition(5)).collect()}
        assert one == two


def test_toxic_rows_are_found_and_clean_ones_left(labelled):
    docs, labels = labelled
    got = [r for r in toxicity.classify(docs, labels).join(labels, "doc_id").collect()]
    toxic = [r["predicted"] for r in got if r["toxic"]]
    clean = [r["predicted"] for r in got if not r["toxic"]]
    assert sum(toxic) >= 0.75 * len(toxic) and sum(clean) <= 0.05 * len(clean)


def test_repeated_ids_do_not_grow_the_samples(spark):
    held = [(k, f"text number {k} of some words you see") for k in range(60)] + [(3, f"again {j}") for j in range(200)]
    docs = spark.createDataFrame(held, "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, k % 2, int(k % 3 == 0)) for k in range(60)], "doc_id bigint, quality int, toxic int")
    got = toxicity.labelled_sample(docs, labels, "toxic", sample=20).collect()
    assert len(got) <= 40 and len({(r["doc_id"], r["label"]) for r in got}) == len(got)
    assert all(r["text"].startswith("again") for r in got if r["doc_id"] == 3)
    assert pu_quality.classify(docs, labels).count() == len(held)


def test_a_tree_takes_the_best_cut():
    from loomgraph.llm.learn import Trees, sigmoid

    rng = np.random.default_rng(3)
    x = rng.integers(0, 12, (60, 2)).astype(float)
    y = (x[:, 0] + rng.normal(0, 2, 60) > 6).astype(float)
    tree = Trees(trees=1, depth=1, least=5.0).fit(x, y)
    f, cut = tree.trees[0][0][:2]
    p = sigmoid(np.full(60, tree.base))
    g, h = p - y, p * (1 - p)
    gain = lambda left: g[left].sum() ** 2 / (h[left].sum() + 1) + g[~left].sum() ** 2 / (h[~left].sum() + 1)
    best = max(gain(x[:, k] <= c) for k in (0, 1) for c in range(12) if 5 <= (x[:, k] <= c).sum() <= 55)
    assert abs(gain(x[:, int(f)] <= cut) - best) < 1e-9


def test_isotonic_is_the_nearest_rising_sequence():
    from itertools import product

    from loomgraph.llm.learn import Isotonic

    rng = np.random.default_rng(5)
    for _ in range(30):
        n = 5
        y, w = rng.integers(0, 2, n).astype(float), rng.integers(1, 4, n).astype(float)
        pools = Isotonic(np.arange(n, dtype=float), y, w)
        levels = sorted({(y[i:j] * w[i:j]).sum() / w[i:j].sum() for i in range(n) for j in range(i + 1, n + 1)})
        rising = (v for v in product(levels, repeat=n) if all(a <= b for a, b in zip(v, v[1:])))
        best = min(((w * (np.array(v) - y) ** 2).sum(), v) for v in rising)[1]
        # the pools are the runs of equal values of the best sequence
        assert len(pools.y) == len(set(best))


def test_risk_is_least_on_a_grid():
    from loomgraph.llm.learn import fit_nnpu

    rng = np.random.default_rng(6)
    positive, unlabelled, prior = rng.normal(1, 1, (400, 1)), np.r_[rng.normal(1, 1, (300, 1)), rng.normal(-1, 1, (700, 1))], 0.3
    loss = lambda z: np.logaddexp(0, -z)

    def risk(w, b):
        zp, zu = positive[:, 0] * w + b, unlabelled[:, 0] * w + b
        return prior * loss(zp).mean() + max(0.0, loss(-zu).mean() - prior * loss(-zp).mean())

    w, b = fit_nnpu(positive, unlabelled, prior)
    best = min(risk(x, y) for x in np.arange(0, 4, 0.1) for y in np.arange(-3, 2, 0.1))
    assert risk(w, b) < best + 0.01


def test_class_prior_is_near_the_truth():
    from loomgraph.llm.learn import class_prior

    rng = np.random.default_rng(0)
    positive, negative = rng.normal(2, 1, 3000), rng.normal(-2, 1, 1200)
    assert abs(class_prior(positive[:1500], np.r_[positive[1500:], negative]) - 1500 / 2700) < 0.05


def test_mixed_keeps_rows_that_differ_in_other_columns(spark):
    """Every row is taken as often as the mix says; rows equal in all columns share their copies."""
    rows = [(k // 2, f"text number {k // 2} of some words", "en" if k % 2 else "de", "s", k % 2) for k in range(400)] + [(5, None, None, None, None), (6, "twin words", "en", "t", 1), (6, "twin words", "en", "t", 1)]
    for parts in (2, 5):
        got = Counter(map(tuple, mixing.mixed(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, x int").repartition(parts)).collect()))
        assert set(got) <= set(rows)
        assert all(1 <= got[r] <= 2 for r in rows[:400])
        assert sum(1 for r in rows[:400] if got[r] == 2 and r[2] == "en") > 50 and sum(1 for r in rows[:400] if got[r] == 2 and r[2] == "de") > 50
        assert sum(len(WORD.findall(r[1] or "")) * n for r, n in got.items() if r[3] == "s") == pytest.approx(1.5 * (400 * 6 + 4) - 8, abs=12)
        first = got if parts == 2 else first
        assert got == first


def test_too_many_sources_are_refused(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SOURCES", 3)
    with pytest.raises(ValueError, match="sources"):
        mixing.mix(spark.createDataFrame([(k, "a b", f"s{k}") for k in range(5)], "doc_id bigint, text string, source string"))


RUSSIAN = "Дерево стояло у самой воды, и ветви его касались реки. Никто не помнил, кто посадил его здесь! Старики говорили, что оно было всегда, и дети верили им без вопросов."
ITALIAN = "Ogni mattina passavamo davanti alla bottega chiusa, dove nessuno entrava da molti anni. Soltanto d'inverno vedevamo fumo sopra quel tetto rosso, poi silenzio ancora."
JAPANESE = "朝になると私たちは川のそばの古い家の前を通った。誰もその家に入ったことはなかった。冬になると屋根の上に煙が見えたが、すぐに消えてしまった。" * 3


@pytest.mark.parametrize("paragraphs", [[RUSSIAN, RUSSIAN[::1] + " Так и было."], [ITALIAN], [JAPANESE], [RUSSIAN, ITALIAN, JAPANESE]])
def test_articles_in_any_language_without_an_article_element(paragraphs):
    page = "<html><body><ul class='nav'><li><a href='/'>Home</a></li></ul><div id='x'>" + "".join(f"<p>{p}</p>" for p in paragraphs) + "</div><div class='footer'>© 2020 a b c.</div></body></html>"
    assert html_extract.extract(page) == "\n".join(paragraphs)


def test_formulas_are_text():
    page = "<article><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation encoding='application/x-tex'>x=2</annotation></math> be the answer.</p></article>"
    assert html_extract.extract(page) == "Let x=2 be the answer."
