import random

from pyspark.sql import functions as F
from tidemill.llm import decontaminate, leaving, setsketch

DOC = "doc_id bigint, text string, source string"


def moved(spark):
    """Bytes that all stages so far have written for shuffles."""
    jvm, new = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    none = jvm.java.util.ArrayList()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(none, False, False, new(jvm.double, 0), none)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_texts_that_stay_are_not_shuffled(spark):
    """However few keys Spark would send to all tasks by itself."""
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choices("abcdefghij", k=9)) for _ in range(400)) for _ in range(300)]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(1000 + i, texts[i], "s") for i in range(10)]
    docs = spark.createDataFrame(rows, DOC)
    item = " ".join(texts[7].split()[20:60])
    benchmark = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for left, gone in ((setsketch.drop_near_copies(docs), {*range(1000, 1010)}), (decontaminate.drop_contaminated(docs, benchmark), {7, 1007})):
            at = moved(spark)
            assert {r.doc_id for r in left.collect()} == {i for i, _, _ in rows} - gone and left.schema == docs.schema
            assert moved(spark) - at < sum(map(len, texts)) / 5
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_keys_that_share_a_bit_are_told_apart(spark, monkeypatch):
    """One word of bits for all: most rows meet the keys, and those of another key, or not `also`, stay as often as they occur."""
    monkeypatch.setattr(leaving, "BITS", 1)
    docs = spark.createDataFrame([(i, None if i % 3 else "x", "s") for i in range(500)] * 2 + [(None, "y", "s")], DOC)
    gone = spark.createDataFrame([(i, i != 12) for i in range(0, 500, 4)], "_key bigint, _yes boolean")
    left = leaving.without(docs, gone, F.coalesce(docs["doc_id"], F.lit(-1)), gone["_yes"])
    want = [i for i in range(500) if i % 4 or i == 12] * 2
    assert sorted(r.doc_id for r in left.collect() if r.doc_id is not None) == sorted(want) and left.where("doc_id is null").count() == 1
