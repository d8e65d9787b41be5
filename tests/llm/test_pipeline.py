"""The pipeline: what each stage keeps, against brute force on its own input."""

import importlib.util

import pytest

from quarrystone.llm.common import BATCH_BYTES, SCAN_ROWS, TOKENIZER, count_tokens
from quarrystone.llm.packing import CAPACITY

if importlib.util.find_spec("corpus_pipeline") is None:
    pytest.skip("there is no pipeline", allow_module_level=True)

import corpus_pipeline as P  # noqa: E402
from tests.llm.test_minhash import brute  # noqa: E402

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in P.STAGES:
        stage(spark, docs, SF).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
        out.append(docs)
    return out


def test_columns_and_counts(stages):
    assert [n for n, _ in P.STAGES] == ["quality_classifier", "line_dedup", "minhash_near_dedup", "mixing", "packing"]
    assert all(d.columns == stages[0].columns for d in stages[:-1])
    counts = [d.count() for d in stages]
    assert all(a > b > 0 for a, b in zip(counts[:-1], counts[1:-1], strict=False))


def test_good_documents_pass_the_classifier(spark, stages):
    kept = {r["doc_id"] for r in stages[1].collect()}
    good = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    assert len(good & kept) >= 0.99 * len(good & {r["doc_id"] for r in stages[0].collect()})


def test_lines_occur_once(stages):
    seen, want = set(), []
    for r in sorted(stages[1].collect(), key=lambda r: r["doc_id"]):
        lines = []
        for x in r["text"].split("\n"):
            if not x.strip() or x.strip() not in seen:
                lines.append(x)
            seen.add(x.strip())
        if "".join(lines).strip():
            want.append((r["doc_id"], "\n".join(lines)))
    assert sorted((r["doc_id"], r["text"]) for r in stages[2].collect()) == want


def test_no_near_duplicates_are_left(stages):
    before = brute(stages[2])
    after = brute(stages[3])
    assert before and len(after) <= 0.05 * len(before)
    partners = {x for a, b, _ in before for x in (a, b)}
    gone = {r["doc_id"] for r in stages[2].collect()} - {r["doc_id"] for r in stages[3].collect()}
    assert gone <= partners


def test_mixture_is_within_its_budget(stages):
    size = lambda d: sum(count_tokens([r["text"] for r in d.collect()], TOKENIZER))
    assert 0.49 * size(stages[3]) <= size(stages[4]) <= 0.5 * size(stages[3])


def test_all_tokens_are_packed(stages):
    rows = stages[5].collect()
    docs = {r["doc_id"]: r["text"] for r in stages[4].collect()}
    got = {}
    for r in rows:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["n_tokens"]
    assert got == dict(zip(docs, count_tokens(docs.values(), TOKENIZER), strict=True))
    packs = {}
    for r in rows:
        packs[r["pack_id"]] = packs.get(r["pack_id"], 0) + r["n_tokens"]
    assert max(packs.values()) <= CAPACITY
    assert sum(packs.values()) >= 0.95 * CAPACITY * (len(packs) - 1)


def test_run_gives_the_last_stage(spark, stages):
    assert sorted(map(tuple, P.run(spark, SF).collect()), key=str) == sorted(map(tuple, stages[5].collect()), key=str)


def test_odd_rows_and_nothing(odd, empty, spark, tmp_path):
    for name, start in (("odd", odd), ("empty", empty)):
        docs = start
        for stage, f in P.STAGES:
            f(spark, docs, SF).write.parquet(str(tmp_path / name / stage))
            docs = spark.read.parquet(str(tmp_path / name / stage))
            if stage != "packing":
                assert docs.columns == odd.columns
        assert (docs.count() > 0) == (name == "odd")


def test_stages_read_texts_in_bounded_batches(spark, odd):
    """The session's settings are lowered to the stages' bounds, and never raised."""
    names = {"spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES, "spark.sql.parquet.columnarReaderBatchSize": SCAN_ROWS}
    before = {n: spark.conf.get(n) for n in names}
    try:
        for n in names:
            spark.conf.unset(n)
        P.dedup_lines(spark, odd, SF)
        assert {n: spark.conf.get(n) for n in names} == {n: str(v) for n, v in names.items()}
        for n in names:
            spark.conf.set(n, "100")
        P.dedup_lines(spark, odd, SF)
        assert {spark.conf.get(n) for n in names} == {"100"}
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)
