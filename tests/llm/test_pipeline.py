import zlib

import corpus_pipeline
import sentencepiece
from tests.llm.test_copies_and_pieces import plain_groups
from tidemill.llm import pieces, toxicity

SF = "/root/testdata/sf0.001"


def test_each_stage_against_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    by_hand = [(texts[i], y) for i, y in labels.items() if zlib.crc32(str(i).encode()) % 5]
    score = toxicity.scorer(toxicity.train(by_hand))
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, SF)
        rows = {r.doc_id: r for r in out.collect()}
        kept[name] = len(rows)
        if name == "toxicity":
            assert rows.keys() == {i for i, t in before.items() if score(t)[0] < 0.5}
        elif name == "near_dedup":
            assert rows.keys() == {i for i, (_, c) in plain_groups(before, 80).items() if c == i}
        elif name == "decontamination":
            assert not any(x in rows[i].text for i in rows for x in items) and len(rows) > 0.8 * len(before)
        else:
            sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
            assert rows.keys() == before.keys() and all(r.ids == sp.encode(before[i]) and r.round_trip for i, r in rows.items())
            break
        assert out.columns == docs.columns
        docs = spark.createDataFrame(list(rows.values()), docs.schema)
    assert corpus_pipeline.run(spark, SF).count() == kept["sentencepiece"]
