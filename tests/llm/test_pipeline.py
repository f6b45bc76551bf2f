import corpus_pipeline as pipeline
from cohortry.llm import quality_classifier
from tests.llm import test_exact_dedup, test_minhash, test_packing, test_substring_dedup

FOLDER = "/root/testdata/sf0.001"


def pairs(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def test_stages_against_brute_force(spark, documents):
    packed = pipeline.run(spark, FOLDER).collect()
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    good = {r.doc_id for r in quality_classifier.classify(documents, labels).filter("predicted = 1").collect()}
    rows = [r for r in pairs(documents) if r[0] in good]
    assert 0 < len(rows) < documents.count()
    kept = {r[0] for r in test_exact_dedup.brute(rows) if r[3]}
    rows = [r for r in rows if r[0] in kept]
    kept = {r[0] for r in test_minhash.brute(rows) if r[2]}
    rows = [r for r in rows if r[0] in kept]
    removed = {r[0]: r[2] for r in test_substring_dedup.brute(rows, 50)}
    cut = [(d, test_substring_dedup.kept_text(rows, d, 50) if removed[d] else t) for d, t in rows]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == test_packing.brute(cut)
    test_packing.check_layout(packed, 2048)


def test_stages_take_odd_tables(spark, odd):
    docs = odd.selectExpr("*", "'en' AS lang", "'s' AS source", "length(text) AS n_chars")
    more = spark.createDataFrame([(None, "one", "x", "y", None, "en", "s", 3), (4, "one", "x", "y", None, "en", "s", 3)], docs.schema)
    for table in (docs.unionByName(more), docs.limit(0)):
        for name, stage in pipeline.STAGES:
            out = stage(spark, table, FOLDER)
            assert out.columns == docs.columns or name == "best_fit_packing"
            out.collect()


def test_exact_copies_of_repeated_and_null_ids(spark, table):
    docs = table([(1, "a  b"), (1, "c"), (2, "a b"), (None, "c"), (None, "d"), (3, None), (4, "")])
    got = pipeline.drop_exact_copies(spark, docs, FOLDER).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted([(1, "a  b"), (1, "c"), (None, "d"), (3, None)], key=str)


def test_near_copies_in_a_template_family_go(spark, table):
    rows = test_minhash.template_family(400, 80)
    kept = {r[0] for r in test_minhash.brute(rows) if r[2]}
    got = pipeline.drop_near_copies(spark, table(rows), FOLDER).collect()
    assert sorted(r.doc_id for r in got) == sorted(kept) and 100 < len(kept) <= 400
