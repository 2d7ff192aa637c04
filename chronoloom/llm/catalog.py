"""The registered queries of the corpus operators and the SQL that checks them where SQL can."""

from __future__ import annotations

import corpus_pipeline
from chronoloom.llm import ann, bpe, decontam, htmltext, licenses, lmscore, personal, quality, secrets, sharding, simhash, spelling, whiten

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_decontaminate": decontam.op1_decontaminate,
    "op2_licenses": licenses.op2_licenses,
    "op3_lm_scoring": lmscore.op3_lm_scoring,
    "op4_html": htmltext.op4_html,
    "op5_quality": quality.op5_quality,
    "op6_sharding": sharding.op6_sharding,
    "op7_simhash": simhash.op7_simhash,
    "op8_ann": ann.op8_ann,
    "op9_bpe": bpe.op9_bpe,
    "op10_secrets": secrets.op10_secrets,
    "op11_personal": personal.op11_personal,
    "op12_whitening": whiten.op12_whitening,
    "op13_spelling": spelling.op13_spelling,
}

OP8_SQL = """
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v) AS score FROM e q JOIN e c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

ORACLE_SQL = {
    "op1_decontaminate": decontam.OP1_SQL,
    "op2_licenses": licenses.op2_sql(),
    "op6_sharding": sharding.OP6_SQL,
    "op8_ann": OP8_SQL,
    "op13_spelling": spelling.OP13_SQL,
} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
