"""Two lines of many words together are a window in the pipeline's line dedup."""

import corpus_pipeline
from tidewise.llm.linededup import dedup_lines


def half(name, n):
    return " ".join(f"{name}{i}" for i in range(n))


A, B, C = half("a", 30), half("b", 25), half("c", 20)
ROWS = [(1, f"{A}\n{B}"), (2, f"start\n{A}\n\n {B}\t\nend"), (3, f"{B}\n{C}"), (4, f"x\n{B}\n{C}"), (5, f"{A}\n{B}"), (6, A), (7, ""), (8, None)]


def test_a_passage_of_two_lines_goes(spark):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in ROWS], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    got = {r.doc_id: r.text for r in dedup_lines(docs, pairs=True).collect()}
    assert got == dict(ROWS) | {2: "start\n\nend", 5: ""}  # 3 and 4 share 45 words only
    kept = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.line_dedup_stage(spark, docs, "").collect()}
    assert kept == {i: (t, len(t or "")) for i, t in got.items() if i != 5}
    assert {r.doc_id: r.text for r in dedup_lines(docs).collect()} == dict(ROWS)
