"""The pipeline's stages against plain Python, on a small table with odd rows."""

import zlib

import corpus_pipeline
import public_tokenizers
from tests.llm.test_corpus_operators import brute_components
from tests.llm.test_row_operators import secrets_by_hand, words

from tarnline.llm import packing


def test_pipeline(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    own = spark.read.parquet(f"{sf}/documents.parquet")
    first = own.orderBy("doc_id").first()
    leak = spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").first().text
    extra = spark.createDataFrame([(5000, None, None, None, None), (5001, "", "en", "s", 0), (5002, first.text, "en", "s", None), (5003, "Here it is: " + leak, "en", "s", 9), (5004, "password = hunter2hunter2 and more", "en", "s", 3), (None, "no id", "en", "s", 5)], own.schema)
    docs = own.unionByName(extra)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    kept, before = [], spark.read.parquet(f"{tmp_path}/documents.parquet")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, before, str(tmp_path))
        after.write.parquet(f"{tmp_path}/out{i}")
        before = spark.read.parquet(f"{tmp_path}/out{i}")
        kept.append(before)
        if i < 4:
            assert before.columns == own.columns
    rows = [[(r.doc_id, r.text) for r in k.collect()] for k in kept[:4]]
    assert len(rows[0]) > 0.8 * docs.count() and (5000, None) in rows[0] and (None, "no id") in rows[0]
    least = {c for _, _, c in brute_components([x for x in rows[0] if x[0] is not None], 5, 80)}
    assert {d for d, _ in rows[1]} == least | {None} and len(rows[1]) == len(least) + 1
    bench = [words(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    windows = {tuple(b[i : i + 10]) for b in bench for i in range(max(1, len(b) - 9))}
    sizes = {len(w) for w in windows}
    hit = lambda w: any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1))
    assert sorted(map(str, rows[2])) == sorted(str(r) for r in rows[1] if not hit(words(r[1])))
    assert 5003 not in {d for d, _ in rows[2]}
    assert {d for d, _ in rows[3]} == {d for d, _ in rows[2]} and not any(secrets_by_hand(t or "") for _, t in rows[3])
    assert {d: t for d, t in rows[3]}[5004] == "[secret] and more"
    ids = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    packed = {}
    for r in kept[4].collect():
        packed.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32))
    for doc, text in rows[3]:
        own_ids = ids.ids(text) + (2).to_bytes(4, "little")
        assert [(s, n, zlib.crc32(own_ids[4 * s : 4 * (s + n)])) for s, n, _ in sorted(packed[doc])] == sorted(packed[doc])


def test_pipeline_of_empty_tables(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    only = spark.createDataFrame([(1, None, None, None, None), (2, "", None, "s", 1), (3, "a word or two", "en", None, None), (3, "a word or two", "en", None, None)], spark.read.parquet(f"{sf}/documents.parquet").schema)
    only.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").collect()) == [1, 2, 3]
