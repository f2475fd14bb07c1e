"""Shared helpers: hot joins, bitmaps, scratch tables."""

from pyspark.sql import functions as F

from lodestone.llm.common import accepted, bitmap, crc_of, held_out, keep_rows, release, row_key, scratch, shared_dir, spread_join, text_batches, with_maybe
from lodestone.sources.files import Files


def test_spread_join_keeps_every_row_of_a_hot_key(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") < 2000, 7).otherwise(F.col("id") % 50).alias("k"))
    groups = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 10).alias("g"))
    got = spread_join(rows, groups, ["k"], "id", salts=16)
    assert got.columns == ["k", "id", "g"]
    want = {(r.id, r.k, r.k * 10) for r in rows.collect() if r.k < 40}
    assert {(r.id, r.k, r.g) for r in got.collect()} == want and got.count() == len(want)


def test_bitmap_has_no_false_negatives(spark):
    keys = spark.range(0, 5000, 3).select(F.col("id").alias("a"), F.lit("x").alias("b"))
    rows = spark.range(5000).select(F.col("id").alias("a"), F.lit("x").alias("b"))
    for bits in (15, 20):
        found = with_maybe(rows, bitmap(keys, ["a", "b"], bits), ["a", "b"], bits)
        assert found.columns == ["a", "b", "__maybe"] and found.count() == 5000
        hits = {r.a for r in found.filter("__maybe").collect()}
        assert hits >= set(range(0, 5000, 3)) and (bits == 15 or len(hits) < 1700)
    empty = with_maybe(rows, bitmap(keys.limit(0), ["a", "b"], 15), ["a", "b"], 15)
    assert empty.filter("__maybe").count() == 0 and empty.count() == 5000


def test_keep_rows_and_accepted(docs):
    made = docs([(1, "a"), (1, "a"), (1, "b"), (2, None), (None, "c"), (None, "c"), (3, "d")])
    keys = made.select(*row_key("doc_id", "text"))
    kept = made.filter("text in ('a', 'c') or text is null").select(*row_key("doc_id", "text"))
    got = keep_rows(made, keys, kept, "doc_id", "text")
    assert got.dtypes == made.dtypes and sorted(map(str, ((r.doc_id, r.text) for r in got.collect()))) == ["(1, 'a')", "(2, None)", "(None, 'c')"]
    out = accepted(made, "text", lambda texts: [t is None or t > "b" for t in texts])
    assert out.dtypes == made.dtypes and sorted(str(r.doc_id) for r in out.collect()) == ["2", "3", "None", "None"]


def test_held_out_is_crc32_of_the_id_as_text(spark):
    import zlib

    rows = spark.range(200).select("id").unionByName(spark.sql("select cast(null as long) as id"))
    for r in rows.select("id", crc_of("id").alias("c"), held_out("id", 4, 2).alias("h")).collect():
        want = None if r.id is None else zlib.crc32(str(r.id).encode())
        assert r.c == want and r.h == (want is not None and want % 4 == 2)


def test_scratch_tables_are_shared_and_released(spark):
    made = scratch(spark.range(10), "test")
    assert made.count() == 10 and any(shared_dir(spark) in f or shared_dir(spark).removeprefix("file://") in f for f in made.inputFiles())
    release(spark)
    assert not Files(spark).exists(shared_dir(spark))


def test_text_batches_keep_a_chosen_size(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    other = spark.newSession()
    text_batches(other)
    assert other.conf.get(key) == "1000"
    chosen = spark.newSession()
    chosen.conf.set(key, 10000)
    text_batches(chosen)
    assert chosen.conf.get(key) == "10000"
