"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from auditlake.llm import (
    decontaminate,
    filter_audit,
    langid,
    minhash,
    packing,
    periodic_runs,
    quality_classifier,
    quality_rules,
    secrets,
    simhash,
    suffix_dedup,
    token_counts,
    warc,
)


def pipeline(spark, sf_dir: str):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_quality_rules": quality_rules.op2_quality_rules,
    "op3_langid": langid.op3_langid,
    "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
    "op5_quality_classifier": quality_classifier.op5_quality_classifier,
    "op6_token_counts": token_counts.op6_token_counts,
    "op7_simhash": simhash.op7_simhash,
    "op8_warc": warc.op8_warc,
    "op9_packing": packing.op9_packing,
    "op10_secrets": secrets.op10_secrets,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_minhash": minhash.op12_minhash,
    "op13_periodic_runs": periodic_runs.op13_periodic_runs,
    "packing_conversations": packing.pack_conversations_query,
    "pipeline": pipeline,
}
SQL = {"op8_warc": warc.OP8_SQL, "op11_filter_audit": filter_audit.OP11_SQL}
