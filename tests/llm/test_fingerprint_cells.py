"""Samples slot by slot against plain Python, and an id that fills many cells."""

import collections
import hashlib
import math
import struct

import xxhash

from mnemolake.llm import fingerprints


def plain_sample(word, weight, slot):
    term = struct.pack("<q", as_long(xxhash.xxh64_intdigest(word.encode(), 42)))
    h = [xxhash.xxh64_intdigest(struct.pack("<i", 3 * slot + k), xxhash.xxh64_intdigest(term, 42)) for k in range(3)]
    gamma = lambda x: -math.log(((x & 0xFFFFFFFF) + 0.5) * 2.0**-32 * ((x >> 32) + 0.5) * 2.0**-32)
    r, c, b = gamma(h[0]), gamma(h[1]), (h[2] >> 11) * 2.0**-53
    return math.log(c) - r * (math.floor(math.log(weight) / r + b) + 1 - b)


def as_long(x):
    return x - (1 << 64) if x >> 63 else x


def test_each_slot_is_the_least_sample(spark):
    texts = {1: "a b c a a d", 2: "d d d e f", 3: "zz"}
    rows = [(d, as_long(xxhash.xxh64_intdigest(w.encode(), 42)), math.log(n)) for d, t in texts.items() for w, n in collections.Counter(t.split()).items()]
    got = fingerprints.signatures(spark.createDataFrame(rows, "doc long, term long, log_weight double"), ["doc"], 16).collect()
    assert len(got) == 3
    for r in got:
        for slot in range(16):
            want = min(plain_sample(w, n, slot) for w, n in collections.Counter(texts[r.doc].split()).items())
            assert abs(r[f"s{slot}"] - want) < 1e-9


def test_a_hot_id_fills_many_cells(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_BYTES", 200)
    rows = [(i, f"text {i} of some words {i * i}") for i in range(300)] + [(None, "the same text in all of these")] * 200 + [(150, f"again {i}") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert fingerprints._celled(docs.selectExpr("coalesce(doc_id, -1) as key", "length(text) as size"))[1] > 20
    got = fingerprints.fingerprint_documents(docs).collect()
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(r[0] for r in rows)
    texts = collections.defaultdict(list)
    for d, t in rows:
        texts[d].append(t)
    order = [*range(299, -1, -1), None]
    hashes = {t: h for t, h in docs.selectExpr("text", "xxhash64(text)").distinct().collect()}
    want = collections.Counter()
    for i, d in enumerate(order):
        after = min(texts[order[(i + 1) % len(order)]], key=hashes.get)
        for t in texts[d]:
            edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
            want[d, hashlib.sha256(edited.encode()).hexdigest()] += 1
    assert collections.Counter((r.doc_id, r.edited_sha256) for r in got) == want
    assert len({r.fingerprint for r in got if r.doc_id is None}) == 1
