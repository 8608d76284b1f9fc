"""The pipeline's stages one after the other over the smallest tables, and over odd rows."""

import corpus_pipeline
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quernlake.llm import bag_minhash, queries, site_quality, template_leaks
from quernlake.shared import write_shared
from quernlake.sources.tables import table

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = table(spark, SF, "documents")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, write_shared(stage(spark, docs, SF), name).frame
        assert docs.columns == columns
        kept[name] = {r.doc_id for r in docs.collect()}
        assert kept[name] <= {r.doc_id for r in before.collect()}
        if name == "near_duplicates":
            assert bag_minhash.near_duplicates(docs).where("NOT kept").count() == 0
            assert len(kept[name]) == bag_minhash.near_duplicates(before).select("class_id").distinct().count()
        if name == "quality":
            wanted = site_quality.classify(before, table(spark, SF, "labels")).where("kept")
            assert kept[name] == {r.doc_id for r in wanted.collect()}
        if name == "decontamination":
            assert template_leaks.leaked_items(docs, table(spark, SF, "benchmark")).where("contaminated").count() == 0
        if name == "lines":
            assert docs.where(F.length("text") != F.col("n_chars")).count() == 0
    library = Tokenizer.from_file(queries.tokenizer_path())
    library.no_truncation()
    library.no_padding()
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert set(got) == set(texts) and len(got) > 50
    for i, r in got.items():
        assert r.ids == library.encode(texts[i] or "", add_special_tokens=False).ids and r.n_tokens == len(r.ids)
        assert r.decoded == library.decode(r.ids, skip_special_tokens=False)


def test_odd_rows_and_no_rows(spark, odd, nothing, tmp_path):
    for name in ("labels", "benchmark"):
        table(spark, SF, name).where("false").write.parquet(str(tmp_path / f"{name}.parquet"))
    for docs in (odd, nothing):
        rows = docs
        for name, stage in corpus_pipeline.STAGES[:-1]:
            rows = write_shared(stage(spark, rows, str(tmp_path)), name).frame
            assert rows.columns == docs.columns
        assert {r.doc_id for r in rows.collect()} == ({None, 4, 5, 6} if docs is odd else set())  # of equal words the null id stays: it is the smallest
