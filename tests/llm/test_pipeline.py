"""The pipeline stage by stage against brute force, and on odd rows."""

import test_packing_leaks_simhash as brute

import corpus_pipeline
from labelmill.llm import queries, secrets

SF = "/root/testdata/sf0.001"


def stages(spark, docs, folder, sf=SF):
    """(name, rows before, rows after) of every stage but the last, and the last stage's rows."""
    out = []
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, columns = docs.collect(), docs.columns
        stage(spark, docs, sf).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
        if name != "packing":
            assert docs.columns == columns
        out.append((name, before, docs.collect()))
    return out


def test_stages_on_table(spark, tmp_path):
    found = {name: (before, after) for name, before, after in stages(
        spark, spark.read.parquet(f"{SF}/documents.parquet"), tmp_path)}
    before, after = found["language"]
    assert {r.doc_id for r in after} == {r.doc_id for r in before if r.text and any(map(str.isalpha, r.text))}
    before, after = found["near_duplicates"]
    fps = {r.doc_id: brute.brute_fingerprint(r.text) for r in before}
    root, least = brute.brute_components(fps.values()), {}
    for doc, fp in fps.items():
        least[root[fp]] = min(doc, least.get(root[fp], doc))
    assert sorted(r.doc_id for r in after) == sorted(least.values())
    before, after = found["decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hits = {doc for doc, _, _ in brute.brute_hits([(r.doc_id, r.text) for r in before], items)}
    assert {r.doc_id for r in after} == {r.doc_id for r in before} - hits and hits
    before, after = found["secret_scan"]
    texts = {r.doc_id: r.text for r in after}
    assert texts.keys() == {r.doc_id for r in before}
    for r in before:
        spans = secrets.base_spans(r.text)
        assert not secrets.base_spans(texts[r.doc_id]) and (not spans or "[SECRET]" in texts[r.doc_id])
        assert all(r.text[s:e] not in texts[r.doc_id] for s, _, e in spans)
    assert sum(texts[r.doc_id] != r.text for r in before if not secrets.base_spans(r.text)) <= 0.02 * len(before)
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    before, after = found["packing"]
    assert sum(p.length for p in after) == sum(len(brute.tokens(tokenizer, r.text)) for r in before)


def test_stages_on_odd_rows(spark, tmp_path):
    rows = [(i, t, None if i is None or i % 2 else "en", "s", 1, "x", 2) for i, t in brute.EDGE + [(20, "password=abcdefghijklmn " * 3)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, text_hash string, fp int")
    found = stages(spark, docs, tmp_path / "odd")
    assert {r.doc_id for _, _, after in found[:1] for r in after} <= {i for i, t in brute.EDGE if t} | {20}
    assert all(p.length >= 1 for p in found[-1][2])
    empty = stages(spark, docs.limit(0), tmp_path / "empty")
    assert [after for _, _, after in empty] == [[]] * 5


def test_run_is_registered(spark):
    assert corpus_pipeline.QUERIES == {"pipeline": corpus_pipeline.run} and corpus_pipeline.ORACLE_SQL is None
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "secret_scan", "packing"]
    assert corpus_pipeline.run(spark, SF).count() > 0
