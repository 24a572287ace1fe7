import os
import subprocess
import sys

import corpus_pipeline as C
from panelwright.llm import queries
from tests.llm.helpers import DATA, needs_data, odd_docs
from tests.llm.test_jaccard import shingle_set
from tests.llm.test_line_dedup import brute as line_brute


@needs_data
def test_stages_against_brute_force(spark):
    from panelwright.llm import decontaminate, toxicity
    from panelwright.llm.common import written

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    start, kept = docs, {}
    for name, stage in C.STAGES:
        docs = written(stage(spark, docs, DATA), "test-stage")
        kept[name] = {r.doc_id: r for r in docs.collect()}
        if name != C.STAGES[-1][0]:
            assert docs.schema == start.schema
    names = [n for n, _ in C.STAGES]
    scores = toxicity.score(start, toxicity.fit(start, spark.read.parquet(f"{DATA}/labels.parquet")))
    assert set(kept[names[0]]) == {r.doc_id for r in scores.collect() if not r.predicted}
    want = line_brute([(i, r.text) for i, r in kept[names[0]].items()])
    assert {k[0] for k in want} == set(kept[names[1]])
    lost = sum(k[2] for k in want)
    assert lost == sum(len((r.text or "").split("\n")) for r in kept[names[0]].values()) - sum(len(r.text.split("\n")) if r.text else (k[1] - k[2]) and 1 for k in want for r in [kept[names[1]][k[0]]])
    left = sorted(kept[names[2]])
    sets = {i: shingle_set(kept[names[1]][i].text) for i in kept[names[1]]}
    alone = lambda a, b: not sets[a] or len(sets[a] & sets[b]) < 0.8 * len(sets[a] | sets[b])
    assert all(alone(a, b) for n, a in enumerate(left) for b in left[n + 1 :])
    assert all(any(not alone(i, j) for j in sets if j < i) for i in set(sets) - set(left))
    hit = {r.doc_id for r in decontaminate.contaminated(spark.createDataFrame(list(kept[names[2]].values()), start.schema), spark.read.parquet(f"{DATA}/benchmark.parquet")).collect()}
    assert set(kept[names[3]]) == set(left) - hit and set(kept[names[4]]) == set(kept[names[3]])
    assert all(r.decoded == r.text and r.n_tokens == len(r.ids) for r in kept[names[4]].values())
    assert {r.doc_id for r in C.run(spark, DATA).select("doc_id").collect()} == set(kept[names[4]])


@needs_data
def test_stages_take_odd_rows(spark):
    for name, stage in C.STAGES:
        docs = odd_docs(spark)
        out = stage(spark, docs, DATA)
        assert out.count() >= 5 and stage(spark, docs.limit(0), DATA).count() == 0, name


def test_thirteen_queries_and_the_pipeline_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14)) and set(queries.SQL) <= set(queries.QUERIES)
    import __spark_entry__ as e

    assert {"pipeline", *queries.QUERIES} <= set(e.queries())


def test_entry_works_without_the_subpackage(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    os.makedirs(tmp_path / "panelwright")
    for p in os.listdir(root):
        if p not in ("corpus_pipeline.py", "panelwright", ".git"):
            os.symlink(f"{root}/{p}", tmp_path / p)
    for p in os.listdir(f"{root}/panelwright"):
        if p != "llm":
            os.symlink(f"{root}/panelwright/{p}", tmp_path / "panelwright" / p)
    got = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); print(len(q), any(n.startswith('op') or n == 'pipeline' for n in q))"], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert got.stdout.split()[1] == "False" and int(got.stdout.split()[0]) > 200, got.stderr[-500:]


def test_texts_reach_python_in_small_batches(spark):
    from pyspark.sql import functions as F

    from panelwright.llm.common import map_slices
    from panelwright.session import BATCH_BYTES

    docs = spark.range(4000, numPartitions=1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 2000).alias("text"))
    sizes = map_slices(docs, lambda b: {"n": [sum(x.size for x in b.column(1).buffers() if x)]}, "n long")  # a slice keeps its batch's buffers
    assert sizes.agg(F.max("n")).first()[0] < 3 * BATCH_BYTES
