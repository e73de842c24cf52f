from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tessella.llm.queries import op5_sharding
from tessella.llm.sharding import add_slots, key_text, layout, place, shard_of


def test_one_more_shard_takes_rows_only_into_itself(spark):
    ids = spark.range(4000).withColumnRenamed("id", "doc_id")
    for n in (16, 17, 20):
        rows = place(ids, n).collect()
        assert all(r.grown_shard in (r.shard, n) for r in rows)
        assert any(r.grown_shard == n for r in rows)
    sizes = Counter(r.shard for r in place(ids, 16).collect())
    assert sorted(sizes) == list(range(16)) and max(sizes.values()) < 1.4 * min(sizes.values())


def test_weights_move_rows_only_through_the_changed_subtree(spark):
    ids = spark.range(3000).withColumnRenamed("id", "doc_id")
    before = layout(16)
    after = {**before, "region1": {**before["region1"], "rack3": before["region1"]["rack3"] + [99]}}
    rows = ids.select(shard_of(key_text("doc_id"), before).alias("a"), shard_of(key_text("doc_id"), after).alias("b")).collect()
    region = lambda s: int(s >= 8)
    assert {(region(r.a), region(r.b)) for r in rows if r.a != r.b} <= {(0, 1), (1, 1)}
    assert all(r.b >= 12 for r in rows if r.a >= 12)


def test_slots_have_no_gaps_even_for_one_hot_key(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id")).alias("doc_id"))
    rows = rows.union(spark.createDataFrame([(None,)] * 5, "doc_id long"))
    got = add_slots(place(rows, 16), "shard", ["doc_id"]).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert len(got) == 3005 and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_query_on_hard_rows(spark, hard, empty, clashing, tmp_path):
    import zlib

    for i, frame in enumerate((hard, empty, clashing)):
        frame.write.parquet(f"{tmp_path}/{i}/documents.parquet")
        rows = op5_sharding(spark, f"{tmp_path}/{i}").collect()
        texts = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in frame.collect())
        assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == texts
