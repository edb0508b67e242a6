"""Turns enter the consensus whole."""

import json

from fieldtally.plans import merges


def test_whole_turns_and_all_sentences(spark, tmp_path):
    turns = [f"one two three four five {end}. " + ". ".join(f"s{i}" for i in range(9)) for end in ("six", "seven")]
    spark.createDataFrame([(1, k, "user", t) for k, t in enumerate(turns)], "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    rows = merges.turn_values(spark, str(tmp_path)).collect()
    for k, turn in enumerate(turns):
        assert [json.loads(r.value) for r in rows if r.field == "head" and r.trial == k] == [turn]
        assert [json.loads(r.value) for r in sorted((r for r in rows if r.field == "parts" and r.trial == k), key=lambda r: r.item)] == turn.split(". ")
