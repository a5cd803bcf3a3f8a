"""Identical rows in great number, and columns with the operators' own names."""

import collections

from mnemolake.llm import linededup, sharding


def test_shards_stay_even_where_a_third_of_the_rows_is_one(spark):
    rows = [(None, "one text in a third of all rows")] * 4000 + [(i, f"text {i} " + "x" * (i * 7919 % 60)) for i in range(8000)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()
    size, slots, shards_of = collections.Counter(), collections.defaultdict(list), collections.defaultdict(set)
    for r in got:
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
        shards_of[r.text_crc32].add(r.shard)
    assert len(got) == len(rows) and sorted(size) == list(range(40))
    assert max(size.values()) < 1.05 * min(size.values())
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    (hot,) = (s for s in shards_of.values() if len(s) > 3)
    assert sorted(hot) == list(range(min(hot), max(hot) + 1))  # neighbours
    assert sum(len(s) > 1 for s in shards_of.values()) <= 40


def test_shards_are_written_with_their_rows(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "doc_id long, text string")
    sharding.write_shards(docs, f"file://{tmp_path}/out", shards=4)
    back = spark.read.parquet(f"file://{tmp_path}/out")
    assert {(r.doc_id, r.text) for r in back.collect()} == {(i, f"text {i}") for i in range(50)}
    assert back.select("shard").distinct().count() == 4


def test_line_dedup_keeps_columns_with_its_own_names(spark):
    names = ("kept", "text_hash", "stays", "hash_of_row", "of_id", "n_lines", "n_kept", "row", "wanted")
    line = "one two three four five six seven eight nine"
    docs = spark.createDataFrame([(1, f"{line}\n\na b", *names), (2, f"{line} ten\nc d", *names)], "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in names))
    out = linededup.dedup_lines(docs)
    assert out.columns == ["doc_id", "text", *(f"doc_{c}" if c in ("n_lines", "n_kept") else c for c in names), "n_lines", "n_kept"]
    got = {r.doc_id: r for r in out.collect()}
    assert (got[1].text, got[2].text, got[2].n_lines, got[2].n_kept) == (f"{line}\n\na b", "c d", 2, 1)
    assert (got[1].stays, got[1].doc_n_kept, got[2].wanted) == ("stays", "n_kept", "wanted")
