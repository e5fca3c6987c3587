import corpus_pipeline as P
from pixelwright.llm import langid, quality
from pixelwright.llm.common import table
from tests.conftest import SF
from tests.llm.test_near_duplicates import brute
from tests.llm.test_tokens import PATH, check_pieces

SF01 = SF.replace("0.001", "0.01")


def test_stages_by_hand(spark):
    """run() against the stages worked out one by one on collected rows."""
    from tokenizers import Tokenizer

    docs = {r["doc_id"]: r for r in table(spark, SF01, "documents").collect()}
    lang = langid.op10(spark, SF01).where("lang_pred <> 'und' and not ambiguous")
    kept = {r["doc_id"] for r in lang.collect()}
    good = quality.op3(spark, SF01).where("predicted = 1")
    kept &= {r["doc_id"] for r in good.collect()}
    comps = brute([(i, docs[i]["text"]) for i in kept])
    kept = {i for i in kept if comps[i][1] == i}
    t = Tokenizer.from_file(PATH)
    want = {i: t.encode(docs[i]["text"], add_special_tokens=False).ids + [1] for i in kept}
    pieces = P.run(spark, SF01).collect()
    assert {p["doc_id"] for p in pieces} == kept
    check_pieces(pieces, want, 2048)


def test_stages_keep_columns(spark):
    docs = table(spark, SF, "documents")
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() <= docs.count(), name


def test_clean_documents_stay(spark):
    """Labelled good documents pass the two filters."""
    docs = table(spark, SF01, "documents").join(table(spark, SF01, "labels").where("quality = 1"), "doc_id").select(*table(spark, SF01, "documents").columns)
    n = docs.count()
    assert P.language_id(spark, docs, SF01).count() >= 0.995 * n
    assert P.quality_classifier(spark, docs, SF01).count() >= 0.985 * n


def test_registered(spark):
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(k.startswith(f"op{n}_") for k in names) for n in range(1, 11))


LOW_HEAP = """
import sys
from pyspark.sql import SparkSession
import corpus_pipeline as P
spark = SparkSession.builder.master("local[1]").config("spark.driver.memory", "512m").config("spark.ui.enabled", "false").getOrCreate()
out = P.quality_classifier(spark, spark.read.parquet(sys.argv[1]), sys.argv[2])
out.write.mode("overwrite").format("noop").save()
"""


def test_long_texts_in_a_small_heap(spark, tmp_path):
    """Thousands of long texts in one file: a reader's batch of 4,096 of them doesn't fit the heap. Without labels the stage keeps all rows."""
    import subprocess
    import sys

    from pyspark.sql import functions as F

    text = F.concat(F.col("id").cast("string"), F.repeat(F.lit(" a word and a line.\n"), 4000))
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length(text).cast("long").alias("n_chars"))
    docs.coalesce(1).write.parquet(path := f"{tmp_path}/documents.parquet")
    table(spark, SF, "labels").where("false").write.parquet(f"{tmp_path}/labels.parquet")
    ran = subprocess.run([sys.executable, "-c", LOW_HEAP, path, str(tmp_path)], cwd=P.__file__.rpartition("/")[0], capture_output=True, text=True, timeout=300)
    assert ran.returncode == 0, ran.stderr[-2000:]
