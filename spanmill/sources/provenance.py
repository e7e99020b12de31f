"""Where results come from: commit, time, host and device, as columns."""

from __future__ import annotations

import platform
import subprocess
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def commit_of(folder: str) -> tuple[str, bool]:
    """(commit, whether files differ from it) of a working folder; ("unknown", True) if git cannot tell."""

    def git(*words: str) -> str:
        return subprocess.run(["git", "-C", folder, *words], capture_output=True, text=True, check=True).stdout.strip()

    try:
        return git("rev-parse", "HEAD"), bool(git("status", "--porcelain"))
    except (OSError, subprocess.CalledProcessError):
        return "unknown", True


def stamped(rows: DataFrame, folder: str | Path = ".", device: str = "cpu", host: str | None = None) -> DataFrame:
    """Rows with commit (`+` after it if files differ), timestamp (UTC, to the second), host and device."""
    commit, changed = commit_of(str(folder))
    values = {
        "commit": commit + ("+" if changed else ""),
        "timestamp": datetime.now(timezone.utc).isoformat(timespec="seconds"),
        "host": host or platform.node(),
        "device": device,
    }
    return rows.withColumns({k: F.lit(v) for k, v in values.items()})
