"""The pipeline's stages against brute force, and the registry."""

import pytest

import __spark_entry__ as entry

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, tmp_path):
    from test_set_ops import brute_similar, check_packing

    from stratalint.llm import packing, pii, quality

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    outs = []
    for i, (_, f) in enumerate(pipeline.STAGES):
        f(spark, docs, d).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        outs.append(docs)
    columns = spark.read.parquet(f"{d}/documents.parquet").columns
    assert all(o.columns == columns for o in outs[:3])
    judged = {r["doc_id"]: r["kept"] for r in quality.op5(spark, d).collect()}
    first = {r["doc_id"]: r["text"] for r in outs[0].collect()}
    assert set(first) == {k for k, v in judged.items() if v}
    second = {r["doc_id"]: r["text"] for r in outs[1].collect()}
    assert set(second) == {c for _, _, _, c in brute_similar(list(first.items()))} and all(first[k] == t for k, t in second.items())
    third = {r["doc_id"]: r["text"] for r in outs[2].collect()}
    assert set(third) == set(second) and not any(pii.base_spans(t or "")[0] for t in third.values())
    import public_tokenizers as p

    e = packing.encoder(p.path("byte_bpe_50k.json"))
    check_packing(outs[3].collect(), sum(len(e.ids(t or "")) + 1 for t in third.values()))


def test_registry():
    q = entry.queries()
    assert "pipeline" in q and [sum(x.startswith(f"op{n}_") for x in q) for n in range(1, 11)] == [1] * 10


def test_run_with_nulls_repeats_and_long_texts(spark, tmp_path):
    import random

    from test_set_ops import check_packing

    from stratalint.llm import packing

    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(4, 6))) for _ in range(30_000)]
    one, two, three, long = (" ".join(words[a:b]) for a, b in ((0, 60), (100, 160), (200, 260), (300, 30_000)))
    rows = [(1, one, "en", "s"), (2, one, "en", "s"), (None, two, None, "s"), (None, two, None, "s"), (3, None, "en", "s"), (4, "", None, None), (5, three + " mail me.now@x.example.com", None, None), (6, long, "en", None), (6, long, "en", None)]
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "some/documents.parquet"))
    got = pipeline.run(spark, str(tmp_path / "some")).collect()
    import public_tokenizers as p

    e = packing.encoder(p.path("byte_bpe_50k.json"))
    want = {1: one, None: two, 5: three + " mail [EMAIL]", 6: long}
    sizes = {k: len(e.ids(t)) + 1 for k, t in want.items()}
    check_packing(got, sum(sizes.values()))
    assert {k: sum(r["length"] for r in got if r["doc_id"] == k) for k in {r["doc_id"] for r in got}} == sizes


def test_run_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    out = pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and "sequence_id" in out.columns


def test_only_missing_modules_are_forgiven(monkeypatch):
    """The guard lets a missing subpackage pass, but not a missing library."""
    import builtins

    real = builtins.__import__

    def without(name):
        def fake(module, *args, **kw):
            if module == name:
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)
            return real(module, *args, **kw)

        return fake

    monkeypatch.setattr(builtins, "__import__", without("corpus_pipeline"))
    assert entry._optional() == ({}, {})
    import sys

    for m in [m for m in sys.modules if m.startswith("stratalint.llm.quality")]:
        monkeypatch.delitem(sys.modules, m)
    monkeypatch.delitem(sys.modules, "corpus_pipeline", raising=False)
    monkeypatch.setattr(builtins, "__import__", without("numpy"))
    for m in [m for m in sys.modules if m.startswith("stratalint.llm")]:
        monkeypatch.delitem(sys.modules, m)
    with pytest.raises(ModuleNotFoundError):
        entry._optional()


def test_rows_stay_out_of_the_workers(spark):
    """Of a row that is filtered or redacted its text alone goes to a worker; nulls, long texts and other columns stay as they are."""
    from stratalint.llm import pii, quality

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("*", "array(doc_id, null) as `a.b`")
    long = docs.limit(1).selectExpr("doc_id", *[f"`{c}`" for c in docs.columns if c not in ("doc_id", "text", "a.b")], "repeat('some words are here, ', 900000) as text", "`a.b`").select(*[f"`{c}`" for c in docs.columns])
    docs = docs.union(long)
    for out in (quality.filter_documents(docs), pii.redact_documents(docs)):
        plan = out._jdf.queryExecution().sparkPlan().toString()
        assert "ArrowEvalPython" in plan and "MapInArrow" not in plan and out.columns == docs.columns
    rows = {(r["doc_id"], r["text"]): r["a.b"] for r in docs.collect()}
    kept = quality.filter_documents(docs).collect()
    assert 0 < len(kept) < len(rows) and all(rows[(r["doc_id"], r["text"])] == r["a.b"] for r in kept)
