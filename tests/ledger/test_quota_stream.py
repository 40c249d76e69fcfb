"""What the quota keeper shows after good and failed polls, over restarts."""

import json

from ledgerloom.streaming import quota


def test_the_last_good_poll_stays(spark, tmp_path):
    at, n = lambda name: str(tmp_path / name), [0]

    def land(error="", *quotas):
        """A poll lands; a new stream keeps it. (status, used of five hours, providers kept)."""
        (tmp_path / f"poll-{n[0]}.json").write_text(json.dumps({"error": error, "quotas": list(quotas)}))
        n[0] += 1
        quota.quota_stream(spark, at("poll-*.json"), at("kept"), at("mark")).awaitTermination()
        return seen()

    def seen():
        row = quota.public_now(spark, at("kept")).collect()
        assert len(row) == 1
        return row[0]["status"], row[0]["five_hour_used"], sorted(r["provider"] for r in quota.current(spark, at("kept")).collect())

    codex = lambda used, error="": {"provider": "codex", "error": error, "windows": [{"unlimited": False, "name": "5 hours", "used": used}]}
    claude = {"provider": "claude", "error": "", "windows": []}
    assert seen() == ("loading", None, [])
    assert land("no answer") == ("unavailable", None, [])
    assert land("", codex(41.0), claude) == ("ready", 41.0, ["claude", "codex"])
    assert land("no answer") == ("unavailable", None, ["claude", "codex"])
    assert land("no answer") == ("unavailable", None, ["claude", "codex"])  # after a restart, failed again
    assert land("", codex(43.0)) == ("ready", 43.0, ["codex"])
    assert land("", codex(44.0, "reading failed")) == ("unavailable", None, ["codex"])
    assert land("", claude) == ("auth_required", None, ["claude"])
    before = quota.kept(spark, at("kept")).first()
    quota.keep(spark.createDataFrame([("again", None, None)], quota.POLL + ", landed timestamp"), at("kept"), before["batch"])
    assert quota.kept(spark, at("kept")).first() == before  # a batch that is kept is skipped
