"""What reviews found in the training-data operators."""

import glob

import pyarrow.parquet as pq

import corpus_pipeline
from seatwise.llm import quality, resample, simhash


def test_near_stage_groups_by_the_prints_of_op5(spark):
    words = [f"w{i * 7919 % 1009}" for i in range(100)]
    other = [*words[:49], "changed", "twice", *words[51:]]  # Jaccard similarity 0.88 of five-word shingles, prints more than two bits apart
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(words).upper()), (4, "quite another text")], "doc_id long, text string")
    own = {r.doc_id for r in simhash.near_duplicates(docs, words=3, distance=2).collect() if r.component_id == r.doc_id}
    assert {r.doc_id for r in corpus_pipeline.near_stage(spark, docs, "").collect()} == own == {1, 2, 4}
    assert {r.doc_id for r in simhash.first_of_each(docs, words=5, similarity=0.8).collect()} == {1, 4}


def test_no_plan_of_the_model_holds_all_levels(spark, monkeypatch):
    plans, write = [], quality.cut
    monkeypatch.setattr(quality, "cut", lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or write(df, name))
    texts = spark.createDataFrame([("one two three one two", "en"), ("ein zwei drei", "de"), (None, None)], "text string, lang string")
    model = quality.kneser_ney(texts)
    assert model.count() == model.select("gram").distinct().count() > 20 and model.filter("bits < 0 OR bits IS NULL").isEmpty()
    assert max(p.count("Aggregate [") for p in plans) <= 2  # before, one plan held the four levels over and over, and the driver all its generated code


def test_blocks_of_the_matrix_are_read_a_few_at_a_time(spark, monkeypatch):
    groups, drop, key = [], resample.drop, "spark.sql.execution.arrow.maxRecordsPerBatch"

    def limited(make, most):
        def of(*values):
            run = make(*values)

            def seen(batches):
                for b in batches:
                    if b.num_rows > most:
                        raise ValueError(f"{b.num_rows} blocks at a time")
                    yield b

            return lambda batches: run(seen(batches))

        return of

    def look(spark, matrix):
        files = glob.glob(matrix.__dict__["_cut_path"].removeprefix("file:") + "/*.parquet")
        groups.extend(m.row_group(k).num_rows for m in (pq.ParquetFile(f).metadata for f in files) for k in range(m.num_row_groups))
        drop(spark, matrix)

    docs = spark.createDataFrame([(i, " ".join(f"w{i * k % 61}" for k in range(30 + i % 9))) for i in range(100)], "doc_id long, text string").coalesce(1)
    target = spark.createDataFrame([(f"w{k} w{k + 1} other",) for k in range(50)], "text string").coalesce(1)
    plain = {tuple(r) for r in resample.resample(docs, target, buckets=97).collect()}
    before = spark.conf.get(key)
    monkeypatch.setattr(resample, "BLOCK", 1)  # a block for each text; at full size a block has 256 KB, and a task has hundreds
    monkeypatch.setattr(resample, "drop", look)
    for name in ("_product", "_column_sums"):
        monkeypatch.setattr(resample, name, limited(getattr(resample, name), resample.BLOCKS))
    assert {tuple(r) for r in resample.resample(docs, target, buckets=97).collect()} == plain and len(plain) == 100
    assert sum(groups) == 100 and max(groups) <= resample.BLOCKS
    assert spark.conf.get(key) == before
