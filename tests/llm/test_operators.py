"""The training-data operators against brute force, on small documents with nulls, empties, repeats, ties and very long texts."""

import hashlib
import json
import os
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pointlake.llm import chat, fingerprints, mixing, packing, quality, simhash, substring, token_files, toxicity, warc
from pointlake.llm.tokens import Encoder

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, slot int, bucket int"


def invented(seed: int, words: int) -> str:
    rng = random.Random(seed)
    out = []
    for _ in range(words):
        out.append("".join(rng.choice(("ka", "lo", "mi", "ne", "ru", "té")) for _ in range(rng.randint(1, 4))))
        if rng.random() < 0.1:
            out[-1] += rng.choice((".", ",", "!\n", "?"))
    return " ".join(out)


PASSAGE = invented(999, 60)
TEXTS = [
    invented(1, 120),
    None,
    "",
    " \t\n ",
    "one",
    "Two words",
    invented(2, 90) + " " + PASSAGE + " " + invented(3, 40),
    PASSAGE,
    invented(1, 120),  # an exact copy
    invented(1, 119) + " changed",
    "same line here now\n" * 30,
    "a " * 3000,
    invented(4, 9000),
    invented(5, 13),
    invented(5, 13),
    "It's  two  spaces \n and\ttabs\r\n 12345 é́ 中文 <|endoftext|> \x1c!\x0b end ",
    invented(6, 30).upper(),
]


@pytest.fixture(scope="module")
def rows():
    return [(i, t, "en", f"s{i % 5}" if i % 7 else None, len(t or ""), 7, 7) for i, t in enumerate(TEXTS)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def encoded(path):
    t = Tokenizer.from_file(path)  # as it is: an end mark's string in a text is the end mark's id
    return [np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4") for x in TEXTS]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_encoding_of_random_strings_is_the_librarys(path):
    """Strings over characters at which pre-tokens and added tokens meet, with the added tokens' strings in them."""
    rng, whole, e = random.Random(5), Tokenizer.from_file(path), Encoder(path)
    bits = ["<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|", "|>", "endoftext", " ", "  ", "\n", "\t", "'s", "'", "a", "Word", "été", "42", "!", "\u00a0", "中", "e\u0301"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))
        assert e.encode(text) == np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), repr(text)


def test_id_width_follows_the_tokenizer(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(1, "a <|endoftext|> b")], "doc_id long, text string")
    folder = f"file://{tmp_path}/t"
    token_files.write_token_files(docs, folder, BYTE)
    assert json.loads((tmp_path / "t" / "manifest.json").read_text())["width"] == 2
    token_files.write_token_files(docs, folder, BYTE, end_id=70_000)
    assert json.loads((tmp_path / "t" / "manifest.json").read_text())["width"] == 4
    assert token_files.read_token_files(spark, folder).first().n_tokens == 5


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_cached_encoding_is_whole_text_encoding(path):
    e = Encoder(path, pieces=50, parts=50)  # small caches turn over
    for text, ids in zip(TEXTS, encoded(path), strict=True):
        assert e.encode(text) == ids[:-1].tobytes()


def test_token_files_round_trip(docs, none):
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.token_files(docs, BYTE).collect()}
    at = 0
    for i, ids in enumerate(encoded(BYTE)):
        assert got[i] == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert token_files.token_files(none, BYTE).count() == 0


def test_token_files_take_null_and_repeated_ids(spark):
    rows = spark.createDataFrame([(None, "b"), (3, "x"), (3, "x"), (None, None)], "doc_id long, text string")
    got = sorted((r.start, r.doc_id, r.n_tokens) for r in token_files.token_files(rows, BYTE).collect())
    assert got == [(0, None, 1), (1, None, 2), (3, 3, 2), (5, 3, 2)]


def test_fingerprints_equal_set_arithmetic(docs, none):
    got = {r.doc_id: r for r in fingerprints.fingerprint_documents(docs).collect()}
    texts = [t or "" for t in TEXTS]
    for i, text in enumerate(texts):
        after = texts[(i + 1) % len(texts)]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        a, b, c = (set(fingerprints.digests(t).tolist()) for t in (text, edited, after))
        like = lambda p, q: len(p & q) / len(p | q) if p | q else 1.0
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_edited == pytest.approx(like(a, b)) and r.near_next == pytest.approx(like(a, c))
    assert got[0].fingerprint == got[8].fingerprint and got[1].fingerprint == got[2].fingerprint != got[0].fingerprint
    assert fingerprints.fingerprint_documents(none).count() == 0


def test_fingerprint_of_a_single_document_follows_itself(spark):
    r = fingerprints.fingerprint_documents(spark.createDataFrame([(5, "alone here")], "doc_id long, text string")).first()
    assert r.near_next == 1.0


def test_sketches_grow_until_they_decode():
    """Digests come back whole from the fingerprints' texts alone, whatever the sizes."""
    rng = np.random.default_rng(0)
    a = [rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (0, 3, 500, 4000, *range(1, 40))]
    b = [np.concatenate([x[: len(x) // 2], rng.integers(0, 1 << 63, 7).astype(np.uint64)]) for x in a]
    first, second = (fingerprints.Sketches.parse([s.text(i) for i in range(len(a))]) for s in (fingerprints.fingerprints(a)[0], fingerprints.fingerprints(b)[0]))
    lost, gained, tries = fingerprints.differences(first, second)
    assert [sorted(x.tolist()) for x in lost] == [sorted(x[len(x) // 2 :].tolist()) for x in a]
    assert [sorted(x.tolist()) for x in gained] == [sorted(x[len(y) // 2 :].tolist()) for x, y in zip(b, a, strict=True)]
    assert tries[3] > 1 and first.peel()[2].all()


def test_sketch_cells_are_sums_over_their_digests():
    """Each digest is in one cell of each third; folding equals building at the smaller size."""
    keys = np.array([3, 1 << 40, (1 << 64) - 5], np.uint64)
    s = fingerprints.Sketches(np.array([48]))
    s.add(np.zeros(3, np.int64), keys, 1)
    cells = [[], [], []]
    for j, at in enumerate(s.places(np.zeros(3, np.int64), keys)):
        cells[j] = at.tolist()
        assert all(16 * j <= x < 16 * (j + 1) for x in at.tolist())
    for c in range(48):
        own = [int(k) for j in range(3) for k, x in zip(keys, cells[j], strict=True) if x == c]
        xor = 0
        for k in own:
            xor ^= k
        assert (s.count[c], int(s.key[c])) == (len(own), xor)
    small = fingerprints.Sketches(np.array([12]))
    small.add(np.zeros(3, np.int64), keys, 1)
    folded = s.folded(np.array([12]))
    assert all((getattr(folded, c) == getattr(small, c)).all() for c in ("count", "key", "check"))


def test_an_insertion_changes_the_paragraphs_around_it_alone():
    words = invented(77, 400).replace(".", "").replace("!", "").replace("?", "").replace("\n", " ").split()
    before, after = (set(fingerprints.paragraphs(" ".join(w))) for w in (words, [*words[:200], "inserted", *words[200:]]))
    assert len(before ^ after) <= 6 < len(before)


def brute_removal(rows, size):
    first = {}
    for d, text in sorted(rows):
        w = words(text)
        for i in range(len(w) - size + 1):
            first.setdefault(tuple(w[i : i + size]), d)
    out = {}
    for d, text in rows:
        w = words(text)
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if first[tuple(w[i : i + size])] < d:
                gone[i : i + size] = [True] * size
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[d] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize("size", [5, 13, 50])
def test_substring_dedup(docs, rows, none, size):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.remove_repeats(docs, size).collect()}
    want = brute_removal([(r[0], r[1]) for r in rows], size)
    assert got == want and sum(x[1] for x in want.values()) > 0
    assert substring.remove_repeats(none, size).count() == 0


def test_substring_dedup_on_few_words(spark):
    """Random texts over three words repeat at every level."""
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice("xyz") for _ in range(rng.randint(0, 60)))) for i in range(40)]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 9, 3).collect()}
    assert got == brute_removal(rows, 9)


def test_substring_levels_double():
    assert substring.levels(13) == [7, 13] and substring.levels(50) == [7, 13, 25, 50] and substring.levels(5) == [5]


def merkle_root(leaves, height):
    """The root over leaves as digests, 16 at a time, by the plainest means; all trees of an archive have one height."""
    for _ in range(height):
        leaves = [hashlib.sha256("".join(x.hex() for x in leaves[i : i + 16]).encode()).digest() for i in range(0, len(leaves), 16)]
    return leaves[0]


@pytest.mark.parametrize("roll", [128_000_000, 4_000])
def test_warc_round_trip_and_audit(spark, tmp_path, roll):
    pages = [(i, f"http://x/{i}", f"<p>{invented(i, 30)}</p>") for i in range(200)] + [(None, None, None), (7, "http://x/7", "<p></p>"), (7, "http://x/7", "<p></p>"), (9, None, "long " * 200_000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(2)
    folder = f"file://{tmp_path}/w"
    index = warc.write_warc(df, folder, ("a", "b"), roll=roll)
    back = sorted(((r.page_id, r.url, r.html) for r in warc.read_warc(index, folder).collect()), key=str)
    assert back == sorted(((p, u, h or "") for p, u, h in pages), key=str)
    listed = sorted(index.collect(), key=lambda r: (r.shard, r.record))
    assert (len({r.file for r in listed}) > 2) == (roll < 10_000)
    hit = [listed[3], listed[60], listed[-1]]
    for r in hit:
        with open(f"{tmp_path}/w/b/{r.file}", "r+b") as f:
            f.seek(r.offset + r.length // 2)
            x = f.read(1)
            f.seek(-1, os.SEEK_CUR)
            f.write(bytes([x[0] ^ 1]))
    left, right = warc.tree(index, folder, "a"), warc.tree(index, folder, "b")
    found = warc.audit(left, right).collect()
    assert sorted((r.shard, r.record) for r in found) == sorted((r.shard, r.record) for r in hit)
    roots = {(r.shard, r.node): bytes(r.digest) for r in left[-1].collect()}
    for shard in {r.shard for r in listed}:
        own = [r for r in listed if r.shard == shard]
        raw = (tmp_path / "w" / "a" / own[0].file).read_bytes()
        assert roots[shard, 0] == merkle_root([hashlib.sha256(raw[r.offset : r.offset + r.length]).digest() for r in own], len(left) - 1)
    assert warc.audited_pages(df.limit(0)).count() == 0


def test_warc_trees_are_higher_than_a_range(spark, tmp_path):
    """More records than a lot of 4096: the upper levels come from the engine."""
    df = spark.range(9000).selectExpr("id AS page_id", "concat('u', id) AS url", "concat('h', id) AS html").coalesce(1)
    folder = f"file://{tmp_path}/w"
    index = warc.write_warc(df, folder)
    levels = warc.tree(index, folder, "a")
    listed = sorted(index.collect(), key=lambda r: r.record)
    raw = (tmp_path / "w" / "a" / listed[0].file).read_bytes()
    assert len(levels) == 5 and bytes(levels[-1].first().digest) == merkle_root([hashlib.sha256(raw[r.offset : r.offset + r.length]).digest() for r in listed], 4)


def test_seeded_damage_is_found_and_nothing_else(spark):
    pages = [(i if i % 9 else None, f"http://x/{i}", f"<p>{i}</p>") for i in range(300)]
    got = warc.audited_pages(spark.createDataFrame(pages, "page_id long, url string, html string"), damage=(3, 10)).collect()
    assert len(got) == 300 and 0 < sum(not r.intact for r in got) < 100
    for r in got:
        assert r.intact == (xxhash.xxh64_intdigest(f"{r.page_id}|{r.url}", 3) % 10 != 0)
        assert r.payload_sha256 == hashlib.sha256(f"<p>{r.url[9:]}</p>".encode()).hexdigest()


def test_warc_missing_replica_file_is_damage(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "h")], "page_id long, url string, html string")
    folder = f"file://{tmp_path}/w"
    index = warc.write_warc(df, folder, ("a", "b"))
    os.remove(f"{tmp_path}/w/b/{index.first().file}")
    assert warc.audit(warc.tree(index, folder, "a"), warc.tree(index, folder, "b")).count() == 1


def brute_targets(sizes, weights=(1, 2, 3), most=3):
    order = sorted((s is None, s or "", s) for s in sizes)
    w = {s: weights[i % len(weights)] for i, (_, _, s) in enumerate(order)}
    total, clamped = sum(sizes.values()), set()
    while True:
        free = [s for s in sizes if s not in clamped]
        left = total - most * sum(sizes[s] for s in clamped)
        share = {s: w[s] * left / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > most * sizes[s]}
        if not over:
            return share | {s: float(most * sizes[s]) for s in clamped}
        clamped |= over


def test_mixing(spark, docs, rows, none):
    got = mixing.mix(docs).collect()
    size = {r[0]: len(words(r[1])) for r in rows}
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + size[r[0]]
    want = brute_targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        source = rows[r.doc_id][3]
        assert r.size == size[r.doc_id] and r.source_size == sizes[source] and r.target == pytest.approx(want[source]) and 0 <= r.taken <= 3 * r.size
        taken[source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    assert sorted(mixing.mix(docs.repartition(5)).collect()) == sorted(got)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    have = {r.source: r.n for r in out.groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("n")).collect()}
    assert all(have.get(s, 0) == taken[s] for s in sizes)
    assert mixing.mix(none).count() == 0 and mixing.mixed_documents(none).count() == 0


def test_mixing_clamps_small_sources(spark):
    rows = [(i, "w " * n, s) for i, (s, n) in enumerate([("a", 1000), ("b", 10), ("c", 500), ("d", 3), (None, 20)])]
    got = {r.doc_id: r for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    want = brute_targets({"a": 1000, "b": 10, "c": 500, "d": 3, None: 20})
    for i, _, s in rows:
        assert got[i].target == pytest.approx(want[s])


def reference_fingerprint(text):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, tau):
    parent = {d: d for d in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= tau:
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {d: find(d) for d in prints}


def test_near_duplicates(docs, rows, none):
    prints = {r[0]: reference_fingerprint(r[1]) for r in rows}
    want = brute_components(prints, 2)
    got = simhash.near_duplicates(docs).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {d: (f"{f:016x}", want[d]) for d, f in prints.items()}
    assert simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("tau", [0, 1, 2])
@pytest.mark.parametrize("small", [2, 64])
def test_links_connect_all_close_fingerprints(spark, monkeypatch, tau, small):
    """Chains and a dense cloud around one value, through both ways of verifying."""
    monkeypatch.setattr(simhash, "SMALL", small)
    rng = random.Random(tau)
    values = [rng.getrandbits(64) for _ in range(60)]
    for v in values[:10]:
        values += [v ^ 1 << rng.randrange(64), v ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64)]
    values += [values[0] ^ 1 << a ^ 1 << b for a in range(12) for b in range(a)]
    prints = {simhash._signed(v): v for v in set(values)}
    nodes = spark.createDataFrame([(k,) for k in prints], "fingerprint long")
    parent = {k: k for k in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in simhash.links(nodes, tau).collect():
        if small == 64:
            assert (prints[r.src] ^ prints[r.dst]).bit_count() <= 2 * tau
        parent[find(r.src)] = find(r.dst)
    want = brute_components({k: v for k, v in prints.items()}, tau)
    groups = lambda name: {frozenset(k for k in prints if name(k) == n) for n in {name(k) for k in prints}}
    assert groups(find) == groups(want.__getitem__)


def test_thresholds_keep_the_pigeonhole():
    rng = np.random.default_rng(1)
    bits = (rng.random((500, 64)) < rng.random(64)).astype(float)
    for n in (10**3, 10**6, 10**10):
        plan = simhash.allocate(n, bits.T @ bits / 500 * n, 2)
        masks = [m for m, _ in plan]
        assert sum(t + 1 for _, t in plan) == 3 and all(a & b == 0 for i, a in enumerate(masks) for b in masks[:i])
    for m in range(1, 7):
        groups = simhash.correlated_groups(500, bits.T @ bits, m)
        assert sorted(b for g in groups for b in g) == list(range(64)) and len(groups) == m


def test_packing(docs, none):
    capacity = 64
    got = packing.pack_sequences(docs, WORD, capacity, lot=10_000).collect()
    ids = encoded(WORD)
    by = {}
    for r in got:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and r.ids_crc32 == zlib.crc32(part.tobytes())
        by.setdefault(r.doc_id, []).append((r.piece, r.start, r.length))
    for d, pieces in by.items():
        pieces.sort()
        assert [p[0] for p in pieces] == list(range(len(pieces))) and all(p[2] == capacity for p in pieces[:-1]) and sum(p[2] for p in pieces) == len(ids[d])
    assert set(by) == set(range(len(TEXTS)))
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        own.sort()
        assert all(o == sum(x[1] for x in own[:i]) for i, (o, _) in enumerate(own)) and sum(x[1] for x in own) <= capacity
    assert len(bins) <= -(-sum(map(len, ids)) // capacity) + 2
    assert packing.pack_sequences(none, WORD, capacity).count() == 0


def test_packing_in_several_lots(docs):
    got = packing.pack_sequences(docs, WORD, 64, lot=20).collect()
    fill = {}
    for r in got:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert max(fill.values()) <= 64 and len(got) == packing.token_pieces(docs, WORD, 64).count()


def test_perspectives(spark):
    turns = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 2, "bob", "yo"), (1, 3, None, "hm"), (None, 0, "ann", "lone"), (2, 0, "system", "only")]
    got = chat.perspectives(spark.createDataFrame([(*t, 1) for t in turns], "conv_id long, turn long, role string, text string, key int")).collect()
    want = []
    for c in (1, None, 2):
        own = [(t, r or "unknown", x or "") for k, t, r, x in turns if k == c]
        for p in {r for _, r, _ in own if r != "system"}:
            for t, r, x in own:
                role = "assistant" if r == p else "system" if r == "system" else "user"
                name = r if role == "user" else None
                want.append((c, p, t, r, role, name, f"<|{role}{':' + name if name else ''}|>\n{x}<|end|>\n", int(r == p)))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert chat.perspectives(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_quality_measures(docs, rows, none):
    got = {r.doc_id: r for r in quality.ledger(docs).collect()}
    for d, text, *_ in rows:
        w, t = words(text), text or ""
        seen = {}
        for i in range(len(w) - 7):
            seen.setdefault(tuple(w[i : i + 8]), []).append(i)
        cover = {p for v in seen.values() if len(v) > 1 for i in v for p in range(i, i + 8)}
        lines = [x for x in t.split("\n") if words(x)]
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover))
        assert bool(r.fail_bits & 1) == (len(w) < 20) and bool(r.fail_bits & 2) == (100 * len(cover) > 30 * len(w))
    assert quality.ledger(none).count() == 0


def test_quality_policies_and_ablation(docs):
    led = quality.ledger(docs)
    web = quality.POLICIES["web", 1]
    judged = {r.doc_id: r for r in quality.judge(led, web).collect()}
    assert not judged[2].kept and judged[2].base_failed and judged[0].kept and not judged[10].kept
    for r in quality.ablation(led, web).collect():
        bit = 1 << r.rule
        bits = [x.fail_bits & web.mask for x in judged.values()]
        assert (r.failed, r.failed_alone, r.kept_without) == (sum(bool(b & bit) for b in bits), bits.count(bit), sum(b in (0, bit) for b in bits))


def test_grammar_states():
    seeds = toxicity.Grammar(toxicity._seeds())
    read = lambda text: dict(zip(toxicity.ARCS, seeds.compiled().features(text).tolist(), strict=True))
    fired = lambda text: [a for a, v in read(text).items() if v]
    assert fired("You are an idiot.") == [("insult", False, False, True)]
    assert fired("An idiot") == [("insult", False, False, False)]
    assert fired("you are not an idiot") == [("insult", True, False, True)]
    assert fired("he said you idiot") == [("insult", False, True, True)]
    assert fired("Not now. I kill you") == [("threat", False, False, True)]
    assert fired("unidiotic trashy") == [] and fired(None) == [] and fired("") == []


def test_toxicity_learns_new_words_from_training_rows_alone(spark):
    rng = random.Random(3)
    docs, labels = [], []
    for i in range(900):
        toxic = int(rng.random() < 0.3)
        w = [*words(invented(i, 40))]
        if toxic:
            w.insert(rng.randrange(40), "zorgl" + rng.choice(("a", "en", "ix")))
        docs.append((i, " ".join(w), "s"))
        labels.append((i, toxic))
    docs += [(None, None, "s"), (1000, "", "s")]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string")
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    grammar = toxicity.fit(d, known)
    got = {r.doc_id: r for r in toxicity.score_documents(d, grammar).collect()}
    truth = dict(labels)
    for i, r in got.items():
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
        assert r.held_out == (i is not None and zlib.crc32(str(i).encode()) % 3 == 1)
    held = [i for i in truth if got[i].held_out]
    assert sum(got[i].predicted == truth[i] for i in held) / len(held) > 0.97
    flipped = known.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.fit(d, flipped).lexicon == grammar.lexicon
    assert {r.doc_id for r in toxicity.keep_clean(d, grammar).collect()} == {i for i, r in got.items() if not r.predicted}
    assert toxicity.fit(d, known.limit(0)).lexicon == toxicity._seeds()
    assert toxicity.score_documents(d.limit(0), grammar).count() == 0
