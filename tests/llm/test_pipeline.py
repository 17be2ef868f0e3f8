"""The pipeline against a brute-force chain of its stages, and the queries' registration."""

import duckdb

import __spark_entry__ as entry
import corpus_pipeline
from tessera.llm import pii, queries, sentpiece

from .helpers import near_components


def test_pipeline_equals_brute_force(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path))
    tokens = {}
    for r in got.select("doc_id", "tokens", "round_trip").collect():
        assert r["round_trip"]
        tokens.setdefault(r["doc_id"], []).append(r["tokens"])

    con = duckdb.connect()
    con.sql(f"create table documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    kept = {r[0] for r in con.sql(f"select doc_id from ({queries.quality_sql()}) where kept").fetchall()}
    rows = [r for r in con.sql("select doc_id, text, source from documents").fetchall() if r[0] in kept]
    group = near_components([(i, t) for i, t, _ in rows])
    anchors = pii.automaton()
    rows = [(i, pii.redact(t, pii.spans_of(t, anchors)) if t else t, s) for i, t, s in rows if group[i] == i]
    con.sql("drop table documents; create table documents (doc_id bigint, text varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?)", rows)
    times = dict(con.sql(f"select doc_id, case when size > 0 then taken // size else 0 end from ({queries.MIX_SQL})").fetchall())
    texts = {i: t for i, t, _ in rows}
    assert {i: len(x) for i, x in tokens.items()} == {i: n for i, n in times.items() if n}
    codec = sentpiece.Codec(sentpiece.load_pieces())
    assert all(codec.decode(x) == (texts[i] or "") for i, copies in tokens.items() for x in copies)


def test_stages_keep_columns_and_take_nothing(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for table, name in ((docs.where("false"), "empty"), (docs.limit(0), "none")):
        frame = table
        for i, (stage, function) in enumerate(corpus_pipeline.STAGES):
            out = function(spark, frame, str(tmp_path))
            if stage != "tokens":
                assert out.dtypes == docs.dtypes
            out.write.parquet(str(tmp_path / name / str(i)))
            frame = spark.read.parquet(str(tmp_path / name / str(i)))
        assert frame.count() == 0


def test_eleven_queries_are_registered():
    names = [n for n in entry.queries() if n.startswith("op") and n[2].isdigit()]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and "pipeline" in entry.queries()
    assert set(queries.ORACLES) <= set(queries.QUERIES)
