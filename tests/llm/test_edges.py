"""Crashes and losses that once happened: each of these failed before its mend."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from cadenza.llm import decontaminate, line_dedup, mixing, ngram_join, packing, sharding, url_filter


def test_near_duplicates_with_one_id_for_two_texts(spark):
    a, b, c = ("w%d x y z " * 20 % tuple(range(k, k + 20)) for k in (0, 100, 200))
    rows = [(1, a), (1, b), (2, a), (3, c), (3, c), (4, ""), (4, None), (4, ""), (None, a)]
    kept = ngram_join.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.text) for r in kept) == Counter([(1, a), (1, b), (3, c), (4, ""), (4, None), (None, a)])


def test_long_white_space_packs_and_comes_back(spark):
    texts = [" " * 1_000_000 + "a", "\n \t" * 5000, "b" + " " * 3000 + "c"]
    rows = packing.pack_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert sorted({r.doc_id for r in packing.unpack_rows(rows).collect()}) == [0, 1, 2]
    assert all("".join(packing.pieces(t)) == t for t in texts + ["", "x"])


def test_unpacking_knows_the_row_length(spark):
    docs = spark.createDataFrame([(1, "one two three four"), (2, "five " * 1500)], "doc_id long, text string")
    rows = packing.pack_documents(docs, seq_len=1024)
    sizes = rows.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("cu_seqlens") - 1),
                                              lambda i: F.get("cu_seqlens", i) - F.get("cu_seqlens", i - 1))).alias("n"))
    got = packing.unpack_rows(rows, 1024).agg(F.sum(F.length("piece"))).first()[0]
    assert got == 2 * sizes.agg(F.sum("n")).first()[0]
    with pytest.raises(Exception, match="seq_len"):
        packing.unpack_rows(rows).collect()


def test_many_shards_and_clashing_names(spark):
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("t").alias("_ring"), F.lit(1).alias("_cell"),
                                   F.lit(2).alias("shard"), F.lit(3).alias("_row"))
    out = sharding.shard_rows(docs, ["doc_id"], n_shards=40, virtual=32)
    assert sorted(out.columns) == sorted(["doc_id", "_ring", "_cell", "_row", "shard", "slot"])
    rows = out.collect()
    assert {(r["_ring"], r["_cell"], r["_row"]) for r in rows} == {("t", 1, 3)}
    sizes = Counter(r["shard"] for r in rows)
    assert len(sizes) == 40 and max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(n))


def test_ring_gives_rows_to_the_next_node_and_moves_few():
    """Without overflow every arc goes to its owner; one more shard takes arcs only into itself."""
    owners = sharding.arc_owners(8, 32)
    grown = sharding.arc_owners(9, 32)
    assert len(owners) == len(grown) == sharding.RING
    moved = [(a, b) for a, b in zip(owners, grown) if a != b]
    assert moved and all(b == 8 for _a, b in moved) and len(moved) < sharding.RING / 4
    loads = [0] * sharding.RING
    for s in range(8):                            # one arc of every shard
        loads[owners.index(s)] = 10
    assert sorted((a, s) for a, _f, _t, s, _slot in sharding.bounded_takes(loads, owners, 8)) == \
        sorted((owners.index(s), s) for s in range(8))


def test_mixing_tells_null_and_repeated_ids_apart(spark):
    rows = [(None, f"w{i} a b c", "s" if i % 3 else "t") for i in range(120)] + [(7, f"v{i} a", "u") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    staged = mixing.stage(mixing.sized(docs))
    out = mixing.mix(staged, mixing.mix_plan(staged)).groupBy("source").agg(
        F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r.taken - r.target) <= 4 for r in out)


def test_clashing_columns_of_lines_and_urls(spark):
    line = "the same rather long line of words here"
    docs = spark.createDataFrame([(1, f"{line}\nx", 5, 6, "r"), (2, f"y\n{line}", 7, 8, "s")],
                                 "doc_id long, text string, _d int, _dropped int, _row string")
    out = sorted(line_dedup.drop_repeated_lines(docs).collect())
    assert [tuple(r) for r in out] == [(1, f"{line}\nx", 5, 6, "r"), (2, "y", 7, 8, "s")]
    pages = spark.createDataFrame([("http://a.net/x", "k", "b", "h")], "url string, _keys string, _block string, host string")
    rules = spark.createDataFrame([("net", "/", "block")], "host string, path string, verdict string")
    assert url_filter.judge_urls(pages, rules).first().asDict() == {
        "url": "http://a.net/x", "_keys": "k", "_block": "b", "host": "a.net", "path": "/x", "rule": "net/", "verdict": "block"}
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0


def test_common_one_word_items_move_one_row_per_document(spark):
    """An item of one common word: one row per document, its last place, and no word list is joined back."""
    docs = spark.createDataFrame([(i, "the cat and the dog " * 40 + "end") for i in range(30)] + [(30, "no such word"), (31, None)],
                                 "doc_id long, text string")
    bench = spark.createDataFrame([(1, "The"), (2, "the dog"), (3, "dog end"), (4, "cat cat")], "item_id long, text string")
    out = decontaminate.contaminated(docs, bench)
    got = {(r["doc_id"], r["item_id"]): (r["doc_at"], r["equal_words"], r["window_words"], r["item_at"]) for r in out.collect()}
    assert got == {(d, i): v for d in range(30) for i, v in [(1, (198, 1, 1, 0)), (2, (198, 2, 2, 0)), (3, (199, 2, 2, 0))]}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1
    assert sorted(r["doc_id"] for r in decontaminate.drop_contaminated(docs, bench).collect()) == [30, 31]
