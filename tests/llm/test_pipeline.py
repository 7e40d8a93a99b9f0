"""The pipeline against a plain computation of its stages, and the rules its stages keep."""

import corpus_pipeline
from ledgerline.llm import bpe, mixing, simhash, toxicity
from tests_support import toxic_docs


def test_run(spark, tmp_path):
    rows = [(k, t) for k, t, _ in toxic_docs()]
    rows += [(1000 + k, t.upper()) for k, t in rows[:60]]  # exact copies after lower-casing
    rows += [(2000, None), (2001, "")]
    docs = spark.createDataFrame([(k, t, "en", f"s{k % 4}", len(t or "")) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, y) for k, _, y in toxic_docs()], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    machine = toxicity.train(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    clean = stages["toxicity"](spark, docs, str(tmp_path))
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = {k for k, t in texts.items() if machine.score([t])[0] < 0.5}
    assert {r.doc_id for r in clean.collect()} == want and clean.columns == docs.columns
    once = stages["exact dedup"](spark, clean, str(tmp_path))
    best: dict[str, int] = {}
    for k in want:
        t = (texts[k] or "").lower()
        best[t] = max(best.get(t, -1), k)
    assert {r.doc_id for r in once.collect()} == set(best.values())
    apart = stages["near dedup"](spark, once, str(tmp_path))
    left = {r.doc_id for r in apart.collect()}
    of = {r.doc_id: r.component_id for r in simhash.similar_dedup(once).collect()}
    assert left == set(of.values())
    grams = {k: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for k in best.values() for w in [(texts[k] or "").lower().split()]}
    near = {k for k in grams if any(j < k and len(grams[j] & grams[k]) >= 0.7 * len(grams[j] | grams[k]) for j in grams)}
    assert set(grams) - near <= left <= set(grams)  # who has no lesser neighbour stays
    mixed = stages["mixing"](spark, apart, str(tmp_path))
    assert mixed.columns == docs.columns
    targets = {r.source: r.target for r in mixing.source_targets(mixing.sized_rows(apart)).collect()}
    words: dict[str, int] = {}
    for r in mixed.collect():
        words[r.source] = words.get(r.source, 0) + len(r.text.split())
    assert words == {s: int(t + 0.5) for s, t in targets.items() if t}
    with open(bpe.tokenizer_path(), encoding="utf-8") as f:
        coder = bpe.BPE(f.read())
    got = sorted((r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == sorted((r.doc_id, len(coder.encode(r.text)) // 4) for r in mixed.collect())


def write(spark, tmp_path, rows, extra=""):
    names = "doc_id long, text string, lang string, source string, n_chars long" + extra
    spark.createDataFrame(rows, names).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, y) for k, _, y in toxic_docs()], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")


def test_run_of_an_empty_table(spark, tmp_path):
    write(spark, tmp_path, [])
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and "doc_id" in out.columns


def test_run_with_null_sources_repeats_and_clashing_columns(spark, tmp_path):
    """Rows that repeat, null keys, texts and sources, very long texts, and columns that have the stages' own names."""
    clash = "fp component_id size target taken score predicted keep_id _text _full k y t copy chunk uid".split()
    rows = [(k, t, None if k % 3 else "en", None if k % 2 else "s", len(t)) for k, t, _ in toxic_docs()[:150]]
    rows += [rows[1]] * 5 + [(None, None, None, None, None)] * 3 + [(900, "", "en", None, 0), (901, "balori sute " * 20_000, "en", "s", 240_000), (None, "a text without a key that is kept once", None, None, 3)]
    write(spark, tmp_path, [(*r, *range(len(clash))) for r in rows], "".join(f", {c} int" for c in clash))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == before.columns, name
        docs = spark.createDataFrame(docs.collect(), docs.schema)  # what is written and read again
    assert {r.source for r in docs.collect()} == {None, "s"}
    keys = [r.doc_id for r in docs.collect()]
    assert 901 in keys and None in keys and 900 not in keys  # whole long texts stay, texts without words don't come
    assert max(keys.count(k) for k in set(keys)) <= 2 and keys.count(rows[1][0]) <= 2  # repeated rows are one document, which a mix takes twice at most
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(str, keys)) == sorted(str(r.doc_id) for r in out.collect())


def test_run_leaves_one_folder(spark, tmp_path, monkeypatch):
    write(spark, tmp_path, [(k, t, "en", "s", len(t)) for k, t, _ in toxic_docs()[:60]])
    (tmp_path / "shared").mkdir()
    monkeypatch.setattr(corpus_pipeline, "shared_dir", lambda _: f"{tmp_path}/shared")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    assert len([p for p in (tmp_path / "shared").iterdir() if p.name.startswith("pipeline-")]) == 1
