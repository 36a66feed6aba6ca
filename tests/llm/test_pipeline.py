import hashlib
import os
import subprocess
import sys

import public_tokenizers
import sentencepiece

import corpus_pipeline
from tesselon.llm import mixing, pii, quality, simhash
from tests.llm.conftest import SF


def test_stages_do_what_they_say(spark, documents):
    labels, docs, columns = spark.read.parquet(f"{SF}/labels.parquet"), documents, documents.columns
    kept = corpus_pipeline.keep_good(spark, docs, SF).cache()
    good = {r["doc_id"] for r in quality.score_documents(docs, labels).filter("predicted = 1").collect()}
    assert {r["doc_id"] for r in kept.collect()} == good and kept.columns == columns
    single = corpus_pipeline.drop_near_duplicates(spark, kept, SF).cache()
    firsts = {r["component_id"] for r in simhash.near_duplicates(kept).collect()}
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(firsts) and single.columns == columns
    masked = corpus_pipeline.mask_personal_data(spark, single, SF).cache()
    assert masked.columns == columns and masked.count() == single.count()
    for r in masked.collect():
        assert pii.base_spans(r["text"] or "") == [] and r["n_chars"] == len(r["text"] or "")
    mixed = corpus_pipeline.mix_sources(spark, masked, SF).cache()
    copies = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.mix(masked).filter("taken > 0").collect()}
    found = {}
    for r in mixed.collect():
        found[r["doc_id"]] = found.get(r["doc_id"], 0) + 1
    assert found == copies and mixed.columns == columns
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    expected = {(r["doc_id"], hashlib.sha256(",".join(map(str, library.encode(r["text"]))).encode()).hexdigest()) for r in mixed.collect()}
    out = corpus_pipeline.encode_pieces(spark, mixed, SF).collect()
    assert {(r["doc_id"], r["ids_sha256"]) for r in out} == expected and len(out) == mixed.count()
    ran = corpus_pipeline.run(spark, SF).collect()
    assert sorted(map(tuple, ran)) == sorted(map(tuple, out))


def test_awkward_and_empty_documents(spark, awkward, tmp_path):
    """Nulls, ties, repeated rows and clashing names go through all stages; an empty table gives an empty result."""
    docs = awkward.selectExpr("doc_id", "text", "CASE WHEN doc_id > 2 THEN 'en' END AS lang", "source", "cast(length(text) AS long) AS n_chars", "h", "target")
    for name, df in (("rows", docs), ("none", docs.limit(0))):
        df.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(i, i % 2, 0) for i in range(8)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}/rows").collect()
    kept = {r["doc_id"] for r in corpus_pipeline.keep_good(spark, docs, f"{tmp_path}/rows").collect()}
    assert {r["doc_id"] for r in out} <= kept and all(len(r["ids_sha256"]) == 64 for r in out)
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []


def test_rest_works_without_the_subpackage(tmp_path):
    """Also where the pipeline's file is left: the other queries are registered, all other tests are found, those of the operators pass."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    subprocess.run(["cp", "-r", *(f"{root}/{x}" for x in ("tesselon", "tests", "__spark_entry__.py", "corpus_pipeline.py")), str(tmp_path)], check=True)
    for folder in ("tesselon", "tests"):
        subprocess.run(["mv", f"{tmp_path}/{folder}/llm", f"{tmp_path}/unused-{folder}"], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not [k for k in q if k.startswith('op') or k == 'pipeline']; assert set(e.oracle_sql()) <= set(q)"
    env = {**os.environ, "PYTHONPATH": os.pathsep.join([str(tmp_path), *(p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and not os.path.samefile(p, root))])}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=env)
    subprocess.run([sys.executable, "-m", "pytest", "-q", "-p", "no:cacheprovider", "tests/test_operators.py", "tests/test_entry.py::test_entry_and_registry"], cwd=tmp_path, check=True, env=env)
    found = subprocess.run([sys.executable, "-m", "pytest", "-q", "-p", "no:cacheprovider", "tests", "--collect-only"], cwd=tmp_path, check=True, env=env, capture_output=True, text=True)
    assert "test_query_equals_sql" in found.stdout and "tests/llm" not in found.stdout
    os.remove(tmp_path / "corpus_pipeline.py")
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=env)
