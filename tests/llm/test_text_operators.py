"""Packing, fingerprints, token counts, mixing and quality rules against brute force on small fixtures."""

import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from driftline.functions import scratch
from driftline.llm import components, mixing, packing, quality, shared, simhash, token_counts

WORD_BPE, BYTE_BPE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, words string"
LONG = " ".join(f"w{i * i % 9973}x" for i in range(9000))
TEXTS = [
    None, "", "   \n\t ", "one", "A b C d", "a b c d e", "x  y\n\nz <|endoftext|> it's we'll 12,3", "é̈ ñ Σς ΣΑΣ İ 日本語テキスト 😀", "\x1c a\x85b\x0bc", "same text here for all of us", "same text here for all of us", "Same TEXT here for all of us",
    "aaaa" * 300, "rep rep rep rep rep rep rep rep rep rep rep", "l one two\nl one two\n\nl one two\nother # $ % line", LONG, LONG + " tail", " ".join(["the quick brown fox jumps over"] * 4), "word " * 3000,
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", ["a", "b", None, "é"][i % 4], len(t or ""), 7, "clash") for i, t in enumerate(TEXTS)]
    rows += [(None, "no key at all", None, None, None, None, None), rows[9], rows[9]]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_pack_round_trip(docs):
    tokenizer = Tokenizer.from_file(WORD_BPE)
    pieces = packing.pack(docs, WORD_BPE).withColumn("crc", F.crc32("ids")).collect()
    spans, sequences, content = defaultdict(list), defaultdict(list), {}
    for p in pieces:
        assert p.length == len(p.ids) // 4 > 0 and p.crc == zlib.crc32(bytes(p.ids))
        sequences[p.sequence_id].append((p.offset, p.length))
        spans[p.doc_id].append((p.start, p.length, bytes(p.ids), p.doc_tokens))
    for i, text in enumerate(TEXTS):
        want = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4").tobytes()
        copies = 3 if i == 9 else 1
        own = Counter(spans[i])
        assert all(s[3] == len(want) // 4 for s in own)
        if copies == 1:
            assert b"".join(s[2] for s in sorted(own)) == want
        assert sum(s[1] * n for s, n in own.items()) == copies * len(want) // 4
        content[i] = want
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end == packing.WINDOW or end & (end - 1) == 0


def test_pack_empty(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA), WORD_BPE).count() == 0


def test_plan_fills_windows():
    rng = np.random.default_rng(3)
    for n in (0, 1, 5, 400):
        lengths = np.minimum(rng.geometric(1 / 700, n) + 1, 9000).tolist()
        pieces, _ = packing.plan(lengths)
        got = Counter()
        for d, _, k in pieces:
            got[d] += k
        assert [got[i] for i in range(n)] == lengths
        rows = list(packing.lay(pieces))
        fill = Counter()
        for *_, k, w, o in rows:
            assert o == fill[w]
            fill[w] += k
        assert all(v == packing.WINDOW or v & (v - 1) == 0 for v in fill.values())


def test_word_ids_of_odd_texts():
    """Other scripts, signs beside letters, marks, spaces of all kinds and special strings give the library's ids."""
    path = public_tokenizers.path("word_bpe_49k.json")
    library, mine = Tokenizer.from_file(path), packing.WordIds(path)
    bits = [*"aéßÿµªZ1²½!_\n\t\x0b\x1c\x85\xa0\xad", "привет", "Ω", "ſ", "İ", "漢", "\u0301", "\u200b", "\u3000", ",", "ж", "'s", "'LL", " ", "  ", "<|endoftext|>", "</w>"]
    rng = np.random.default_rng(3)
    texts = ["", "привет, мир! ſ?", *("".join(rng.choice(bits, rng.integers(0, 40))) for _ in range(3000))]
    for t, got in zip(texts, mine.of(texts), strict=True):
        assert got == np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t


def test_nnls_matches_conditions():
    rng = np.random.default_rng(1)
    for _ in range(20):
        a, b = rng.random((8, 12)), rng.random(8)
        x = packing.nnls(a, b)
        gain = a.T @ (b - a @ x)
        assert (x >= 0).all() and (gain <= 1e-6).all() and abs(gain @ x) < 1e-6


def brute_print(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i : i + 4]) for i in range(max(len(w) - 3, 1))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(keys, prints):
    n = len(keys)
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 4:
                root[find(i)] = find(j)
    least = {}
    for i, k in enumerate(keys):
        if k is not None:
            least[find(i)] = min(least.get(find(i), k), k)
    return [least.get(find(i)) for i in range(n)]


def test_simhash_rows(docs):
    rows = docs.select("doc_id", "text").collect()
    prints = [brute_print(r.text) for r in rows]
    want = Counter((r.doc_id, f"{p:016x}", c) for r, p, c in zip(rows, prints, brute_components([r.doc_id for r in rows], prints), strict=True))
    assert Counter(map(tuple, simhash.near_duplicates(docs).collect())) == want


def test_position_sets_meet_every_four_positions():
    for width, n in ((3, 20), (4, 70)):
        sets = simhash.position_sets(width).tolist()
        assert len(sets) == n and all(any(set(x) <= set(four) for x in sets) for four in itertools.combinations(range(8), 4))


def test_count_filter_passes_over_pairs_with_few_shared_bytes():
    a = np.zeros(4, np.int64)
    b = np.array([0x01010101, 0x0101010101, 0x0101, 0x1F], np.int64)  # 4, 3, 6 and 7 bytes shared; 4, 5, 2 and 5 bits
    assert simhash.linked(a, b).tolist() == [True, False, True, False]


@pytest.mark.parametrize(("large", "wide"), [(2048, 1 << 27), (4, 1 << 27), (2048, 0), (4, 0)])
def test_fingerprint_links(spark, monkeypatch, large, wide):
    monkeypatch.setattr(simhash, "LARGE_POSTING", large)
    monkeypatch.setattr(simhash, "WIDE_FROM", wide)
    rng = np.random.default_rng(7)
    base = rng.integers(0, 2**63, 12, dtype=np.uint64)
    prints = set(rng.integers(0, 2**63, 150, dtype=np.uint64).tolist()) | {0}
    for b in base.tolist():
        for _ in range(15):
            x = b
            for i in rng.integers(0, 64, rng.integers(0, 7)):
                x ^= 1 << int(i)
            prints.add(x)
    prints = sorted(prints)
    frame = spark.createDataFrame([(p - 2**64 if p >= 2**63 else p,) for p in prints], "fp long")
    found = {r.node: r.root for r in components.components(simhash.fingerprint_links(frame)).collect()}
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    got, want = defaultdict(set), defaultdict(set)
    for p, s in zip(prints, signed, strict=True):
        got[found.get(s, s)].add(p)
    for p, c in zip(prints, brute_components(prints, prints), strict=True):
        want[c].add(p)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 501), (501, 502), (502, 500), (7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(201)} | {i: 500 for i in (500, 501, 502)}


def test_simhash_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_hot_keys_give_the_same_components(spark, monkeypatch):
    monkeypatch.setattr(scratch, "LEAST_HOT", 3)
    edges = [(0, i) for i in range(1, 60)] + [(i, i + 100) for i in range(1, 40)] + [(900, 901)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for e in edges[:-1] for i in e} | {900: 900, 901: 900}
    rows = spark.createDataFrame([(i % 7 if i < 60 else 7, f"text of {'many' if i > 20 else 'some'} words {i % 3}") for i in range(200)], "doc_id long, text string")
    prints = [brute_print(r.text) for r in rows.collect()]
    keys = [r.doc_id for r in rows.collect()]
    want = Counter((k, f"{p:016x}", c) for k, p, c in zip(keys, prints, brute_components(keys, prints), strict=True))
    assert Counter(map(tuple, simhash.near_duplicates(rows).collect())) == want


def test_keep_one(docs):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    rows = docs.select("doc_id", "text").collect()
    prints = [brute_print(r.text) for r in rows]
    want = [c for c in set(brute_components([r.doc_id for r in rows], prints)) if c is not None]
    got = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in got if i is not None) == sorted(want) and got.count(None) == 1


def test_keep_one_of_shared_and_missing_keys(spark):
    """Rows that share a key but no component stay apart; without keys one row of a component stays."""
    texts = ["one two three four five six", "seven eight nine ten eleven twelve", "one two three four five six"]
    rows = [(1, texts[0], "x"), (1, texts[1], "x"), (1, texts[1], "x"), (2, texts[0], "y"), (None, "a b c d e f g", "p"), (None, "a b c d e f g", "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string")
    got = sorted(map(tuple, simhash.keep_one(df).collect()), key=repr)
    assert got[:2] == [(1, texts[0], "x"), (1, texts[1], "x")] and len(got) == 3 and got[2][:2] == rows[4][:2]
    assert sorted(map(tuple, simhash.keep_one(df.repartition(5)).collect()), key=repr) == got


def test_token_counts_match_library(docs):
    tokenizer = Tokenizer.from_file(BYTE_BPE)
    want = Counter((r.doc_id, len((r.text or "").encode()), n := len(tokenizer.encode(r.text or "", add_special_tokens=False)), n > 1024) for r in docs.collect())
    assert Counter(map(tuple, token_counts.count_tokens(docs, BYTE_BPE).collect())) == want


def test_token_counts_of_odd_texts():
    tokenizer, merger = Tokenizer.from_file(BYTE_BPE), token_counts.merger(BYTE_BPE)
    rng = np.random.default_rng(2)
    letters = list(" \n\t'sabcAB1,.é̈ <|>　\x85") + ["<|endoftext|>", "  ", "'ll"]
    texts = ["".join(rng.choice(letters, rng.integers(0, 60))) for _ in range(2000)]
    assert merger.counts(texts) == [len(tokenizer.encode(t, add_special_tokens=False)) for t in texts]


def test_clashing_names(spark):
    rows = [(1, "a b", 3, 4, 5, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start int, n_tokens int, fp int, size int")
    assert packing.pack(df, WORD_BPE).columns[:2] == ["doc_id", "start"] and token_counts.count_tokens(df, BYTE_BPE).first().n_tokens == 2
    assert simhash.near_duplicates(df).first().component_id == 1 and simhash.keep_one(df).collect() == df.collect() and mixing.mix(df.withColumn("source", F.lit("s"))).first()["size"] == 2
    odd = spark.createDataFrame([(1, "a b", "s", 7, 8)], "doc_id long, text string, source string, row int, `at` int")
    assert mixing.mixed(odd, length=None).columns == odd.columns
    assert token_counts.count_tokens(df.limit(0), BYTE_BPE).count() == packing.pack(df.limit(0), WORD_BPE).count() == 0


def test_token_counts_with_a_small_store(monkeypatch):
    monkeypatch.setattr(token_counts, "CACHED", 5)
    tokenizer, merger = Tokenizer.from_file(BYTE_BPE), token_counts.Merger(BYTE_BPE)
    texts = [t or "" for t in TEXTS]
    for _ in range(2):
        assert merger.counts(texts) == [len(tokenizer.encode(t, add_special_tokens=False)) for t in texts]


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, target = 1.5 * sum(sizes.values()), {s: 0.0 for s in order}
    open_sources, left = set(order), total
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_sources) for s in open_sources}
        over = {s for s in open_sources if share[s] >= 2 * sizes[s]}
        if not over:
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_sources -= over
        if not open_sources:
            break
    return target | (share if open_sources else {})


def test_mix_meets_targets(docs):
    rows = mixing.mix(docs).collect()
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, mixing.mix(docs).collect()), key=repr)
    sizes, taken = Counter(), Counter()
    source = {r.doc_id: r.source for r in docs.collect()}
    for r in rows:
        sizes[source[r.doc_id]] += r["size"]
        taken[source[r.doc_id]] += r.taken
        assert 0 <= r.taken <= 2 * r["size"]
    want = brute_targets(sizes)
    for r in rows:
        assert r.source_size == sizes[source[r.doc_id]] and r.target == pytest.approx(want[source[r.doc_id]])
    for s, n in taken.items():
        assert abs(n - want[s]) <= 1
    assert Counter((r.doc_id, r["size"]) for r in rows) == Counter((r.doc_id, len(words(r.text))) for r in docs.collect())


def test_mixed_texts_hold_the_words_taken(docs):
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    got = Counter()
    for r in out.collect():
        got[r.doc_id] += len(words(r.text))
        assert r.n_chars == len(r.text)
    want = Counter()
    for r in mixing.mix(docs).collect():
        want[r.doc_id] += r.taken
    assert sum(got.values()) == sum(want.values())
    assert {k for k in got if k is not None} <= set(want)


def test_mix_does_not_depend_on_files(docs, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 5)
    want = Counter(map(tuple, mixing.mix(docs).collect()))
    assert Counter(map(tuple, mixing.mix(docs.orderBy(F.desc("doc_id")).repartition(7)).collect())) == want
    assert Counter(map(tuple, mixing.mixed(docs.repartition(7)).collect())) == Counter(map(tuple, mixing.mixed(docs).collect()))


def test_slots_follow_the_draw(spark, monkeypatch):
    """A shard takes as many blocks of a source as the multinomial draw says, and all slots are those of the targets."""
    targets = spark.createDataFrame([("a", 0, 64_000, 96_000.0), ("b", 1, 777, 1554.0), ("c", 2, 50, 0.0)], "source string, sid bigint, source_size bigint, target double")
    monkeypatch.setattr(mixing, "BLOCK", 8)
    one = sorted((r.sid, r.k, r.block, r.words) for r in mixing.drawn_slots(targets, 10).collect())
    monkeypatch.setattr(mixing, "GROUP_SHARDS", 3)
    slots = mixing.drawn_slots(targets, 10).collect()
    assert sorted((r.sid, r.k, r.block, r.words) for r in slots) == one
    sizes = np.array([3, 3, 3, 1])
    for sid, n in ((0, 12_000), (1, 196)):
        groups = np.random.default_rng([mixing.SEED, sid]).multinomial(n, sizes / 10)
        want = np.concatenate([np.random.default_rng([mixing.SEED, sid, g + 1]).multinomial(c, np.full(m, 1 / m)) for g, (c, m) in enumerate(zip(groups, sizes, strict=True))])
        got = Counter(r.shard for r in slots if r.sid == sid)
        assert [got[i] for i in range(10)] == want.tolist()
    times = Counter((r.sid, r.block) for r in slots)
    assert max(times.values()) == 2 and not any(r.sid == 2 for r in slots)


def test_blocks_of_shards_against_brute_force(docs, monkeypatch):
    """Lay each source's words out in the order of the rows' hashes, cut them into blocks and take the slots' blocks:
    the words of each shard's slots are those of the operator."""
    monkeypatch.setattr(mixing, "BLOCK", 16)
    monkeypatch.setattr(mixing, "SHARD_SLOTS", 100)
    hashed = docs.select("*", shared.row_hash(docs, 1).alias("h1"), shared.row_hash(docs, 2).alias("h2")).collect()
    order = sorted({r.source for r in hashed}, key=lambda s: (s is None, (s or "").encode()))
    streams = [[w for r in sorted((r for r in hashed if r.source == s), key=lambda r: (r.h1, r.h2)) for w in words(r.text)] for s in order]
    target = brute_targets({s: len(x) for s, x in zip(order, streams, strict=True)})
    shards = max(1, -(-int(1.5 * sum(map(len, streams))) // 1600))
    frame = docs.sparkSession.createDataFrame([(s or "", i, len(streams[i]), float(target[s])) for i, s in enumerate(order)], "source string, sid bigint, source_size bigint, target double")
    want = Counter((r.shard, w) for r in mixing.drawn_slots(frame, shards).collect() for w in streams[r.sid][16 * r.block : 16 * r.block + r.words])
    made = mixing.blocks(docs).collect()
    assert Counter((r.shard, w) for r in made for w in words(r.row.text)) == want and len({r.shard for r in made}) == shards > 3
    slots = defaultdict(list)
    for r in made:
        slots[r.shard, r.slot].append((r.start, len(words(r.row.text))))
    for parts in slots.values():
        parts.sort()
        assert sum(n for _, n in parts) <= 16 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False))


def test_mix_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mixing.mix(empty).count() == 0 and mixing.mixed(empty).count() == 0
    blank = spark.createDataFrame([(1, None, None, None, None, None, None)], SCHEMA)
    assert [tuple(r) for r in mixing.mix(blank).collect()] == [(1, 0, 0, 0.0, 0)]


def test_permutation_and_slots():
    for n in (1, 2, 3, 64, 1000):
        p = mixing.permute(np.arange(n), n, 99)
        assert sorted(p) == list(range(n))
        assert (mixing.permute(p, n, 99, backwards=True) == np.arange(n)).all()
    rng = np.random.default_rng(4)
    for _ in range(300):
        size = int(rng.integers(1, 1000))
        want = int(rng.integers(0, 2 * size + 1))
        blocks, slots, last = mixing.slots_of(size, want, 3, 64)
        got = 0
        for k in range(slots):
            b = int(mixing.permute(np.array([k % blocks]), blocks, mixing._key(3, k // blocks))[0])
            whole = min(64, size - b * 64)
            got += min(whole, last) if k == slots - 1 else whole
        assert got == want


def brute_quality(text):
    w = words(text)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    often, marked, seen, dup = Counter(grams), set(), set(), 0
    for i, g in enumerate(grams):
        if often[g] > 1:
            marked |= set(range(i, i + 5))
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    n, r = len(w), len(marked)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, r, n < 10 or 100 * r > 20 * n


def test_quality_measures(docs):
    rows = quality.judge(docs.select("doc_id", "text", "source")).collect()
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_quality(text[r.doc_id])
    assert len(rows) == docs.count()


def test_host_verdicts(spark):
    good, bad = "a b c d e f g h i j k l", "short"
    rows = [(i, good if s == "fine" or i % 10 == 0 else bad, None, s, 0, 0, None) for i in range(300) for s in ("fine", "poor", None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and {r.source for r in kept.collect()} == {"fine"} and kept.count() == 300
    judged = quality.judge(docs.select("doc_id", "text", "source"))
    assert judged.filter("kept").count() == 300 and judged.count() == 900


def test_quality_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert quality.keep_good(empty).count() == 0 and quality.judge(empty.select("doc_id", "text", "source")).count() == 0
