"""What the evidence queries gather from."""

from corpusloom.plans import provenance


def test_chunks_of_the_questions_documents_alone(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(provenance.gather, "gather", lambda questions, chunks, titles, budget: chunks)
    questions, _, chunks = provenance._gathered(spark, sf_dir)
    wanted = {d for r in questions.collect() for d in r.doc_ids}
    assert {r.doc_id for r in chunks.select("doc_id").distinct().collect()} == wanted
