"""What the text operators leave behind and send, which has to stay small on larger tables."""

import os
from urllib.parse import urlparse

from pyspark.sql import functions as F

from paceforge.llm import collocations, common, line_dedup, simhash


def shared(spark):
    return urlparse(common.shared_folder(spark)).path


def test_only_results_stay_in_the_shared_folder(spark):
    """The tables between the steps go, also those with the texts; the results can be read after that."""
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, text), (2, text), (3, text + " more"), (4, "other words than those of the first ones"), (5, None), (6, text)], "doc_id bigint, text string")
    for run, want in ((simhash.near_duplicates, {(1, 1), (2, 1), (3, 1), (4, 4), (5, 5), (6, 1)}), (line_dedup.removed_lines, {(2, 0), (3, 0), (6, 0)})):
        before = set(os.listdir(shared(spark)))
        out = run(df)
        left = {x for x in set(os.listdir(shared(spark))) - before if x.startswith(("table-", "scratch-"))}
        assert len(left) == 1 and not [x for x in left if x.startswith("scratch-")]
        assert {tuple(r)[:2] for r in out.collect()} == want


def test_shuffle_files_go_with_the_write(spark):
    """The setting holds for the write only."""
    seen = []
    df = spark.range(100).groupBy("id").count()

    class Writer:
        def parquet(self, path):
            seen.append(spark.conf.get(common.FREED))
            df.write.parquet(path)

    class Frame:
        sparkSession, schema, write = spark, df.schema, Writer()

    before = spark.conf.get(common.FREED)
    assert common.written(Frame()).count() == 100
    assert seen == ["true"] and spark.conf.get(common.FREED) == before


def test_rare_words_are_ranked_apart(spark):
    """Of many words that occur once hardly any shares its bucket with another, so that they have no lists."""
    words = [f"w{i}" for i in range(300_000)]
    df = spark.createDataFrame([(i, " ".join(words[i : i + 1000])) for i in range(0, len(words), 1000)], "doc_id bigint, text string")
    ranks = line_dedup.rarity(df)
    rank = line_dedup.look_up(ranks, line_dedup.BUCKETS, F.xxhash64("w"))
    assert df.select(F.explode(F.split("text", " ")).alias("w")).where(rank == 0).count() > 0.9 * len(words)


def test_a_run_of_words_is_a_row_of_few_tasks(spark):
    """Many partitions of a scan are counted in few tasks, with the same counts; what is in few stays."""
    words = "one two three four five six seven"
    texts = spark.range(0, 400, numPartitions=400).select(F.lit(b"en").alias("lang"), F.lit(words.encode()).alias("text"))
    tables = []
    for _ in range(3):
        tables.append(collocations.bit_table(collocations.slot_counts(texts.coalesce(4), tables), 100))
    fewer = collocations.in_fewer_tasks(texts)
    assert fewer.rdd.getNumPartitions() == max(collocations.WAVES * spark.sparkContext.defaultParallelism, 50)
    rows = collocations.counted_grams(fewer, tables).persist()
    assert rows.count() <= 7 * fewer.rdd.getNumPartitions() < 7 * 400
    assert {r.gram: r.n for r in rows.where("k = 5").groupBy("gram").agg(F.sum("n").alias("n")).collect()} == {" ".join(words.split()[i : i + 5]): 400 for i in range(3)}
    assert collocations.in_fewer_tasks(spark.range(0, 4, numPartitions=1)).rdd.getNumPartitions() == 1
    rows.unpersist()
