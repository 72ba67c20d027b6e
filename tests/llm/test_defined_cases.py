"""Every corpus query on empty tables and on tables with columns named like the operators' own."""

import pytest
from pyspark.sql import functions as F

from wayfare.llm.registry import queries

SMALL = "/root/testdata/sf0.001"
TABLES = {"documents": "doc_id", "embeddings": "vec_id", "labels": "doc_id"}
#: Names that operators use on the way.
OWN = """_id _text a anchor_block at b c cell chunk chunks chunk_id code component_id count d doc doc_tokens end first form form_n fp gram
    group h hash held_out hi id ids ids_crc32 is_query key keys kept labels least left length lo m member n n_links n_near n_words node
    nulls number offset part part_end part_start piece place predicted q query_id rank right root row rows score seq sequence_id set side
    size span spans start state tile tokens toxicity tree v value vec w word words x""".split()  # fmt: skip


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    made = {kind: str(tmp_path_factory.mktemp(kind)) for kind in ("empty", "plain", "clashing")}
    for name, key in TABLES.items():
        df = spark.read.parquet(f"{SMALL}/{name}.parquet").filter(F.col(key) < 150)
        df.filter("false").coalesce(1).write.parquet(f"{made['empty']}/{name}.parquet")
        df.coalesce(2).write.parquet(f"{made['plain']}/{name}.parquet")
        extra = [F.concat(F.lit("other"), F.col(key).cast("string")).alias(c) for c in OWN if c not in df.columns]
        df.select("*", *extra).coalesce(2).write.parquet(f"{made['clashing']}/{name}.parquet")
    return made


def rows(df):
    return sorted(df.columns), sorted(map(repr, df.select(*sorted(df.columns)).collect()))


@pytest.mark.parametrize("name", sorted(queries()))
def test_empty_tables_and_clashing_columns(spark, folders, name):
    query = queries()[name]
    columns, none = rows(query(spark, folders["empty"]))
    plain = rows(query(spark, folders["plain"]))
    assert none == [] and plain[0] == columns and plain[1]
    assert rows(query(spark, folders["clashing"])) == plain


def test_pipeline_on_empty_tables_and_clashing_columns(spark, folders):
    pipeline = pytest.importorskip("corpus_pipeline")
    assert pipeline.run(spark, folders["empty"]).collect() == []
    plain = rows(pipeline.run(spark, folders["plain"]))
    assert plain[1] and rows(pipeline.run(spark, folders["clashing"])) == plain
