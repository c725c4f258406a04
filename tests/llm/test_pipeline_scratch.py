"""The pipeline gives each stage's scratch tables back."""

import os

import corpus_pipeline
from corpusloom.session import note, shared_root


def test_scratch_of_earlier_stages_goes(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    root = shared_root(spark).removeprefix("file:")
    made = []
    for name, stage in corpus_pipeline.STAGES[:3]:
        with note():
            before = set(os.listdir(root))
            out = stage(spark, docs, sf_dir)
            out.write.parquet(str(tmp_path / name))
        made.append(set(os.listdir(root)) - before)
        docs = spark.read.parquet(str(tmp_path / name))
    assert made[0] and made[2] and not (made[0] | made[1]) & set(os.listdir(root)) and made[2] <= set(os.listdir(root))
    assert docs.count() > 0
