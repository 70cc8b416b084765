"""Headline queries on local[$BENCH_CPUS] at $BENCH_SF_DIR; one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks import registry  # noqa: E402
from checks.session import session  # noqa: E402
from checks.views import load  # noqa: E402

HEADLINE = [
    "t1_commit_phrases", "t3_a8_sweep_metrics", "w2_first_seen", "w10_restamp_words",
    "t4_assemble_traces", "a1_latency_stats", "w12_running_latency_p50", "t6_shed_backlog",
    "t7_drift_control", "t8_session_watchdog", "s5_upsert_transcripts", "a6_billing_rollup",
    "j3_language_availability", "t12_superseded_rooms", "f1_word_errors", "f2_score_sessions",
    "f3_repetition_flags", "p2_normalise_token", "p7_segment_clauses", "u1_translate_fanout",
    "g2_audio_levels", "t10_utterances", "t11_context_windows", "a14_session_scorecard",
    "t6_shed_backlog_stream", "t2_commit_phrases_stream", "s4_read_audio_frames",
]

#: Rates the baseline promises: name, query, the view whose rows it works through, rows for each.
RATES = [
    ("hypotheses_per_s", "t1_commit_phrases", "fx_hyps", 1), ("sweep_hypotheses_per_s", "t3_a8_sweep_metrics", "fx_hyps", 12),
    ("marks_per_s", "t4_assemble_traces", "fx_marks", 1), ("pairs_per_s", "f1_word_errors", "fx_pairs", 1),
    ("stream_rows_per_s", "t6_shed_backlog_stream", "fx_pushlog", 1), ("phrase_stream_rows_per_s", "t2_commit_phrases_stream", "fx_paused", 1),
]


def run(spark, name: str, sf_dir: str) -> float:
    started = time.perf_counter()
    registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - started, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = session()
    # Start the JVM's and the Python workers' parts that every query needs.
    spark.read.parquet(f"{sf_dir}/nation.parquet").repartition(8).mapInPandas(lambda frames: frames, "n_nationkey int, n_name string, n_regionkey int").count()
    times = {name: run(spark, name, sf_dir) for name in names}
    rates = {rate: round(load(spark, sf_dir, view).count() * each / times[query], 1)
             for rate, query, view, each in RATES if query in times}
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "rates": rates, "streams": {name: registry.STREAMED[name] for name in times if name in registry.STREAMED}, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
