from conftest import rows
from quillwave.plans import queries
from quillwave.streaming import text_stream


def test_stream_equals_batch_and_resumes(spark, small, folder):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    stream = text_stream.read_stream(spark, small, docs.schema, "documents.parquet")
    text_stream.run_available(text_stream.clean_stream(stream, "text").select("doc_id", "clean_text"), f"{folder}/out")
    batch = text_stream.clean_stream(docs, "text").select("doc_id", "clean_text")
    assert rows(spark.read.parquet(f"{folder}/out")) == rows(batch)


def test_tables_of_one_file_and_of_many(spark, small, folder):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    for place in (small, folder):
        got = queries.stream_clean_text(spark, place)
        assert rows(got) == rows(text_stream.clean_stream(docs, "text").select("doc_id", "clean_text"))
