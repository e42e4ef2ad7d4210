import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tidewise.llm import quality
from tidewise.llm.mixing import rates
from test_near_copies import first_of_components
from tests_llm_brute import brute_count, brute_lines, good_text, junk_text


def corpus(spark, folder):
    rng = random.Random(12)
    rows = [(i, good_text(rng, i) if i % 4 else junk_text(rng), "en", f"s{i % 3}") for i in range(240)]
    passage = "\n".join(f"a shared line number {i} that many texts hold" for i in range(4))
    rows += [(300 + i, f"{good_text(rng, 900 + i)}\n{passage}\nend {i}", "en", "s0") for i in range(20)]
    rows += [(400 + i, rows[1][1], "en", "s1") for i in range(5)]
    base = good_text(rng, 5000, 900).split(" ")
    for i in range(5):
        words = list(base)
        words[100 * i] = f"changed{i}"
        rows.append((500 + i, " ".join(words), "en", "s2"))
    rows += [(600, None, None, None), (601, "", "en", "s1"), (602, good_text(rng, 7000) + " word" * 20_000, "en", "s1")]
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows


def test_each_stage_against_brute_force(spark, tmp_path):
    corpus(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "mixing", "packing"]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = sorted(((r.doc_id, r.text, r.source, r.n_chars) for r in docs.collect()), key=lambda r: (r[0], str(r)))
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        rows = after.collect()
        if name != "packing":
            assert after.columns == columns
            kept = sorted(r.doc_id for r in rows)
        if name == "quality":
            scores = {r.doc_id: r.score for r in quality.classify(docs, spark.read.parquet(f"{tmp_path}/labels.parquet")).collect()}
            assert kept == sorted(i for i, s in scores.items() if s >= 0.3)
            assert sum(i % 4 != 0 for i in kept if i < 240) >= 178 and sum(i % 4 == 0 for i in kept if i < 240) <= 2
        elif name == "line_dedup":
            want = {i: t for i, t in brute_lines([(i, t) for i, t, _, _ in before]).items() if t is None or t.strip() or not (dict((b[0], b[1]) for b in before)[i] or "").strip()}
            assert {r.doc_id: r.text for r in rows} == want
            assert all(r.n_chars == len(r.text or "") for r in rows)
        elif name == "near_dedup":
            assert kept == sorted(first_of_components([(i, t or "") for i, t, _, _ in before]))
        elif name == "mixing":
            mean = {r.source: r.rate for r in rates(docs, None, 0.7, None).collect()}
            assert kept == sorted(i for i, _, s, _ in before for _ in range(brute_count(i, mean[s])))
        else:
            word = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
            tokens = {i: np.array([*word.encode(t or "", add_special_tokens=False).ids, 1], np.uint32) for i, t, _, _ in before}
            assert sum(r.length for r in rows) == sum(len(tokens[i]) for i, _, _, _ in before)
            assert all(r.ids_crc32 == zlib.crc32(tokens[r.doc_id][r.start : r.start + r.length].tobytes()) for r in rows)
        docs = after


def test_run_gives_the_last_stages_rows(spark, tmp_path):
    corpus(spark, tmp_path)
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and out.count() > 100


def test_empty_documents(spark, tmp_path):
    corpus(spark, tmp_path / "full")
    for name in ("documents", "labels"):
        spark.read.parquet(f"{tmp_path}/full/{name}.parquet").where("false").write.parquet(f"{tmp_path}/none/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
