"""Queries of the corpus operators and their SQL."""

from __future__ import annotations

import importlib

_OPS = {
    "op1_secrets": "op01_secrets",
    "op2_substrings": "op02_substrings",
    "op3_language": "op03_language",
    "op4_topk": "op04_topk",
    "op5_bpe": "op05_bpe",
    "op6_simhash": "op06_simhash",
    "op7_packing": "op07_packing",
    "op8_licenses": "op08_licenses",
    "op10_forest": "op10_forest",
    "op9_toxicity": "op09_toxicity",
    "op11_variants": "op11_variants",
    "op12_sentencepiece": "op12_pieces",
    "op13_negatives": "op13_negatives",
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"wayfare.llm.{module}"), name) for name, module in _OPS.items()}


#: Vectors as integer components; all vectors of the tables have one length.
_INTEGERS = """vec_id, list_transform(embedding, lambda x: floor({scale} * cast(x as double))) as v
  from embeddings where embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0"""

_SQL = {
    "op4_topk": f"""
with ints as (select {_INTEGERS.format(scale=64)}),
scores as (
  select q.vec_id as query_id, c.vec_id, cast(list_dot_product(q.v, c.v) as bigint) as score
  from ints q join ints c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0),
ranked as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from scores)
select query_id, rank, vec_id, score from ranked where rank <= 20
""",
    "op13_negatives": f"""
with ints as (
  select case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, {_INTEGERS.format(scale=256)} and label is not null),
scores as (
  select a.vec_id as anchor_id, o.vec_id, a.label = o.label as same, cast(list_dot_product(a.v, o.v) as bigint) as score
  from ints a join ints o on a.vec_id <> o.vec_id where a.vec_id % 100 = 0),
positives as (
  select anchor_id, vec_id as positive_id, score as positive_score from scores where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
negatives as (
  select p.*, s.vec_id as negative_id, s.score as negative_score,
    cast(row_number() over (partition by anchor_id, positive_id order by s.score desc, s.vec_id) as integer) as rank
  from positives p join scores s using (anchor_id)
  where not s.same and 80 * positive_score <= 100 * s.score and s.score <= positive_score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from negatives where rank <= 5
""",
}


def oracle_sql() -> dict[str, str]:
    return {name: sql.strip() for name, sql in _SQL.items()}
