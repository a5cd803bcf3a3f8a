"""BPE, packing, fingerprints, SimHash, sharding and line dedup against plain Python."""

import collections
import hashlib
import re
import struct
import zlib

import numpy as np
import public_tokenizers
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from mnemolake.llm import bpe, fingerprints, linededup, packing, sharding, simhash, splitters


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


BYTES, WORDS = (public_tokenizers.path(f"{n}.json") for n in ("byte_bpe_50k", "word_bpe_49k"))
LIBRARY = {p: Tokenizer.from_file(p) for p in (BYTES, WORDS)}
for t in LIBRARY.values():
    t.no_padding(), t.no_truncation()
PREFIX, WORDING = bpe.PrefixBpe(BYTES), packing.WordTokens(WORDS)
TEXTS = st.one_of(st.text(max_size=60), st.text("aabe the in'sldt \n1.<|>", max_size=80), st.text("etaoinshr", max_size=200), st.sampled_from(["<|endoftext|>", "a<|endoftext|><|endoftext|>b", "İ ΑΣ ς", "<|startoftext|>x"]))


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_bpe_is_the_library_s(text):
    ids = LIBRARY[BYTES].encode(text, add_special_tokens=False).ids
    got = PREFIX.encode(text)
    assert list(struct.unpack(f"<{len(got) // 4}I", got)) == ids
    assert PREFIX.decode(got) == LIBRARY[BYTES].decode(ids, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_words_are_the_library_s(text):
    assert np.frombuffer(WORDING.encode(text), "<u4").tolist() == LIBRARY[WORDS].encode(text, add_special_tokens=False).ids


def test_broken_bytes_decode_to_replacements():
    ids = struct.pack("<2I", *PREFIX.piece(b"\xe6\x97")[:1], PREFIX.piece(b"a")[0])
    assert PREFIX.decode(ids).endswith("a") and "�" in PREFIX.decode(ids)


def test_encode_documents(docs, none):
    rows = bpe.encode_documents(docs, BYTES, with_ids=True).collect()
    want = collections.Counter()
    for r in docs.collect():
        ids = LIBRARY[BYTES].encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha(r.text or ""), tuple(ids)] += 1
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, tuple(r.ids)) for r in rows) == want
    assert bpe.encode_documents(none, BYTES).count() == 0


def test_packing(docs, none):
    rows = packing.pack_documents(docs, WORDS, 256).collect()
    want = collections.Counter()
    for r in docs.collect():
        ids = [*LIBRARY[WORDS].encode(r.text or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 256):
            want[r.doc_id, k // 256, k, len(ids[k : k + 256]), zlib.crc32(np.array(ids[k : k + 256], "<u4").tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 256
    assert len(by) <= -(-sum(r.length for r in rows) // 256) * 1.1 + 1
    assert packing.pack_documents(none, WORDS).count() == 0


def test_plan_holds_every_piece():
    rng = np.random.default_rng(3)
    for most in (2, 30, 10**6):
        counts = rng.integers(0, most, 128)
        counts[0] = 0
        for plan in (packing.plan(counts, 128), list(packing.best_fit(counts, 128).items())):
            held = np.zeros(128, int)
            for config, times in plan:
                assert sum(config) <= 128 and times > 0
                np.add.at(held, list(config), times)
            assert (held == counts).all()
            assert sum(n for _, n in plan) <= 1.05 * max((counts * np.arange(128)).sum() / 128, counts[65:].sum()) + 2
    assert packing.plan(np.zeros(128, np.int64), 128) == [] and packing.solve(np.zeros(128), 128) == ({}, 0.0)


def test_program_meets_the_true_optimum():
    """Thirds, halves and lengths that only fit alone: the value is known."""
    counts = np.zeros(13, np.int64)
    counts[[4, 6, 11]] = 300, 200, 50
    found, bound = packing.solve(counts, 12)
    assert abs(sum(found.values()) - 250) <= 0.13 and 249.8 <= bound <= 250 + 1e-6
    assert sum(n for _, n in packing.plan(counts, 12)) == 250
    for price in packing._sure_prices(13, 12):
        assert packing._knapsack(price, 12)[0][-1] <= 1 + 1e-9


def test_best_configuration_is_the_best():
    import itertools

    value = np.array([0, 0, 3.0, 4.5, 0, 8.2])
    best = max(sum(value[x] for x in c) for n in range(7) for c in itertools.combinations_with_replacement([2, 3, 5], n) if sum(c) <= 12)
    assert abs(packing._knapsack(value, 12)[0][-1] - best) < 1e-9
    assert abs(sum(value[x] for x in packing._picked(packing._knapsack(value, 12)[1], 12)) - best) < 1e-9


def test_fingerprints(docs, none):
    rows = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    texts = {r.doc_id: r.text or "" for r in rows.collect()}
    got = {r.doc_id: r for r in fingerprints.fingerprint_documents(rows).collect()}
    assert got.keys() == texts.keys()
    likeness, truth = [], []
    weights = lambda t: collections.Counter(t.lower().split())
    order = sorted(texts, reverse=True)
    for i, d in enumerate(order):
        text, after = texts[d], texts[order[(i + 1) % len(order)]]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert (got[d].n_chars, got[d].edited_sha256) == (len(text), sha(edited))
        for a, b, near in ((text, edited, got[d].near_edited), (text, after, got[d].near_next)):
            a, b = weights(a), weights(b)
            truth.append(sum((a & b).values()) / sum((a | b).values()) if a | b else 1.0)
            likeness.append(near)
    assert np.abs(np.array(likeness) - truth).mean() < 0.06
    assert got[7].fingerprint == got[8].fingerprint != got[11].fingerprint
    assert fingerprints.fingerprint_documents(docs).count() == docs.count()
    assert fingerprints.fingerprint_documents(none).count() == 0


def test_one_document_follows_itself(spark):
    (r,) = fingerprints.fingerprint_documents(spark.createDataFrame([(4, "ab cd")], "doc_id long, text string")).collect()
    assert r.edited_sha256 == sha("ab ab") and r.near_next == 1.0


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(len(words) - 2, 1))]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def grouped(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_simhash(docs, none):
    rows = docs.collect()
    fp = {r.doc_id: plain_fingerprint(r.text) for r in rows if r.doc_id is not None}
    want = grouped([(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 2], fp)
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            assert (int(r.fingerprint, 16), r.component_id) == (fp[r.doc_id], want[r.doc_id])
    assert simhash.near_duplicates(none).count() == 0


def test_links_connect_what_is_near_also_in_full_buckets(spark, monkeypatch):
    rng = np.random.default_rng(1)
    for bucket in (48, 2):
        monkeypatch.setattr(simhash, "BUCKET", bucket)
        fps = {int(x) for x in rng.integers(0, 2**63, 20)}
        for x in [*fps][:6]:
            for _ in range(12):
                x ^= 1 << int(rng.integers(0, 63)) | 1 << int(rng.integers(0, 63))
                fps.add(x)
        fps = sorted(fps)
        near = [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 2]
        got = simhash.links(spark.createDataFrame(list(enumerate(fps)), "id long, fp long")).collect()
        assert grouped([tuple(x) for x in got], range(len(fps))) == grouped(near, range(len(fps)))
        assert {(min(x), max(x)) for x in got} <= {(min(x), max(x)) for x in near}


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    got = {r.id: r.root for r in simhash.components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_sharding(docs, none, spark):
    many = docs.select("doc_id", "text").union(spark.range(1000, 3000).selectExpr("id", "if(id % 3 = 0, 'one very common text', concat('text ', id * id))"))
    rows = sharding.shard(many, shards=8).collect()
    texts = collections.Counter((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in many.collect())
    assert collections.Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == texts
    by = collections.defaultdict(list)
    for r in rows:
        assert r.law == "bytes" and r.grown_shard is None
        by[r.shard].append(r)
    assert set(by) == set(range(8))
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    assert sharding.shard(none).count() == 0


def test_shards_are_even(spark):
    many = spark.range(40_000).selectExpr("id as doc_id", "if(id % 3 = 0, 'one very common text', repeat('x', cast(id % 97 as int))) as text")
    sizes = [r.b for r in sharding.shard(many).groupBy("shard").agg({"size": "sum"}).withColumnRenamed("sum(size)", "b").collect()]
    assert len(sizes) == 40 and max(sizes) < 1.05 * min(sizes)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(-(2**63), 2**63 - 1), max_size=20))
def test_range_of(spark, bounds):
    bounds = sorted(set(bounds))
    keys = [*bounds, *(b - 1 for b in bounds if b > -(2**63)), 0, 2**63 - 1, -(2**63)]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for r in df.select("k", splitters.range_of(df.k, bounds).alias("r")).collect():
        assert r.r == sum(b <= r.k for b in bounds)


def plain_dedup(rows, least=linededup.MIN_WORDS):
    whole, changed, shorter, lines, out = set(), set(), set(), set(), {}
    for key, text in sorted({(d, t) for d, t in rows if t is not None}):
        kept = []
        for line in text.split("\n"):
            w = tuple(line.split())
            cut = [w[:i] + w[i + 1 :] for i in range(len(w))]
            near = len(w) >= least and (any((i, len(w), x) in changed or (x in whole and len(x) >= least) for i, x in enumerate(cut)) or w in shorter)
            if not w or not (w in lines or near):
                kept.append(line)
            if w:
                lines.add(w)
                if len(w) >= least:
                    whole.add(w)
                    changed |= {(i, len(w), x) for i, x in enumerate(cut)}
                    shorter |= set(cut)
        out[key, text] = "\n".join(kept)
    return out


def test_line_dedup(spark, docs, none):
    w = "one two three four five six seven eight nine ten".split()
    edits = [" ".join(w), " ".join([*w[:4], "X", *w[5:]]), " ".join(w[:3] + w[4:]), " ".join([*w, "end"]), " ".join(["0", *w]), " ".join(w[::-1]), " ".join([*w[:4], *w[5:9]]), "short one", "short two", "short one", "", " "]
    rows = [(i, "\n".join(edits[i % 5 : i % 5 + 4]) + f"\nown line {i}") for i in range(12)] + [(20, None), (21, ""), (22, "\n".join(edits))]
    for data in (spark.createDataFrame(rows, "doc_id long, text string"), docs.where("doc_id is not null")):
        want = plain_dedup([(r.doc_id, r.text) for r in data.collect()])
        source = data.selectExpr("doc_id", "text", "text as was")
        for r in linededup.dedup_lines(source).collect():
            assert r.text == (None if r.was is None else want[r.doc_id, r.was])
    assert linededup.dedup_lines(docs).count() == docs.count()
    assert linededup.dedup_lines(none).count() == 0
