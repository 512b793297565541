"""Sampling metadata covers both ways of sampling for every user."""

from lumentrack import queries


def test_metadata_of_moving_and_failed_videos(spark):
    d = "/root/testdata/sf0.001"
    users = {r.user_id for r in spark.read.parquet(f"{d}/events.parquet").select("user_id").distinct().collect()}
    found = queries.QUERIES["sampling_metadata"](spark, d).collect()
    assert {r.video for r in found if r.sampling_strategy == "adaptive_motion_based"} == users
    failed = {r.video: r for r in found if r.sampling_strategy == "uniform_fallback"}
    assert set(failed) == {-1 - u for u in users} and len(found) == 2 * len(users)
    assert all(r.motion_segments is None and r.sampled_frames == min(28, r.total_frames) for r in failed.values())
