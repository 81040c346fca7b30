"""Times of the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one line of JSON."""

from __future__ import annotations

import json
import os
import shutil
import sys
import tempfile
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [HERE, os.environ.get("PYTHONPATH")]))  # for the Python workers


def main() -> None:
    from pyspark.sql import SparkSession

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    shared = tempfile.mkdtemp(prefix="bench-")
    conf = {"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC", "spark.checkpoint.dir": shared}
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    from papyra.operators.index import build_index
    from papyra.operators.search import search
    from papyra.plans import catalog

    times: dict[str, float] = {}

    def timed(name, make):
        start = time.perf_counter()
        df = make()
        df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        return df

    spark.range(1000).selectExpr("sum(id)").collect()  # the session is up
    books = catalog._books(spark, sf_dir)
    start = time.perf_counter()
    index = build_index(books).cache()
    chunks = index.stats.first().n
    index.vocab.count()
    times["index_build"] = round(time.perf_counter() - start, 3)
    one = spark.createDataFrame([(0, "the theand of")], "qid long, text string")
    timed("search_first", lambda: search(index, one))
    timed("search_one", lambda: search(index, one))
    many = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id AS qid", "substring(text, 1, 60) AS text")
    n = many.count()
    timed("search_batch", lambda: search(index, many, fuzzy=False))
    for name in ("tokenize_counts", "posting_deltas", "rerank_api", "rerank_library", "dedup_exact", "html_text", "stem_tokens", "latency_quantiles"):
        timed(name, lambda name=name: catalog.queries()[name](spark, sf_dir))
    try:
        from papyra.llm import registry
    except ImportError:
        registry = None
    if registry:
        for name in ("op1_secret_scan", "op2_token_counts", "op3_sentencepiece", "op4_jaccard_join", "op5_line_dedup", "op7_decontaminate", "op8_license_scan", "op9_exact_top_k", "op10_language_id"):
            timed(name, lambda name=name: registry.queries()[name](spark, sf_dir))
        import corpus_pipeline

        timed("pipeline", lambda: corpus_pipeline.run(spark, sf_dir))
    extra = {"chunks": chunks, "chunks_per_sec": round(chunks / times["index_build"], 1), "batch_queries_per_sec": round(n / times["search_batch"], 1)}
    print(json.dumps({"metric": "headline_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir).removeprefix("sf"), **extra}), flush=True)
    spark.stop()
    shutil.rmtree(shared, ignore_errors=True)


if __name__ == "__main__":
    main()
