"""Queries that decode what was sampled, and read what was damaged."""

from pyspark.sql import functions as F

from quantloom.llm import pieces, tokens, warc
from quantloom.llm.common import fresh_path

SF = "/root/testdata/sf0.001"


def test_four_samples_of_each_document_decode_to_it(spark):
    rows = pieces.gumbel_round_trip(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r["restored"] and r["n_samples"] == r["n_different"] <= 4 for r in rows) and sum(r["n_samples"] == 4 for r in rows) > len(rows) / 2


def test_pages_behind_damage_come_back_and_gaps_are_logged(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r["page_id"]: r["recovered"] for r in warc.warc_salvage_gaps(spark, SF).collect()}
    assert got == {r["page_id"]: r["page_id"] % 50 != 7 for r in pages.collect()} and not all(got.values())
    path = fresh_path(spark, "warc")
    warc.write_archive(pages, path, spoil=warc.spoilt)
    _, gaps = warc.read_archive(spark, path)
    lost = gaps.agg(F.count(F.lit(1)), F.min(F.col("stop") - F.col("start"))).first()
    assert 0 < lost[0] <= sum(not x for x in got.values()) and lost[1] > 0


def test_samples_are_decoded_where_they_are_drawn(spark):
    plan = pieces.gumbel_round_trip(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan
    rows = pieces.op2_gumbel_segmentations(spark, SF)
    assert rows.where("decodes").count() == rows.count() > 0


def test_what_weighs_next_to_nothing_is_sampled_too(spark):
    """At this alpha all segmentations of the word but one weigh less than 1e-13 of it together."""
    path = tokens.tokenizer_path("piece_bpe_32k.model")
    lat = pieces.Lattices(path, 16.0)
    state = int(lat.prepare([pieces.normal("that")])[0])
    assert 0 < lat.rest(state, [pieces.walk_one(lat, state, 1)[0]]) < 1e-13
    docs = spark.createDataFrame([(1, "that"), (2, "\n")], "doc_id bigint, text string")
    got = pieces.sampled(docs, path, k=3, alpha=16.0).collect()
    ids = [tuple(r["ids"]) for r in got if r["doc_id"] == 1]
    assert len(ids) == len(set(ids)) == 3 and all(0 < r["inclusion"] <= 1 for r in got)


def test_decoding_takes_long_rows_in_parts(spark):
    import pyarrow as pa

    from quantloom.llm.common import cut

    b = pa.RecordBatch.from_arrays([pa.array([[1] * 700, None, [2] * 700, [], [3] * 3000], pa.list_(pa.int32()))], ["ids"])
    assert [x.num_rows for x in cut(iter([b]), 0, 1000)] == [2, 2, 1]
